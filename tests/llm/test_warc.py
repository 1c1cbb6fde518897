"""Archives written and read: SQL, round trip, damage, edge cases."""

import struct
import uuid

import pytest
import zstandard
from pyspark.sql import functions as F

from lexweave.llm import warc
from lexweave.llm.warc import frames, parsed, read_archives, record, to_records, write_archives
from lexweave.session import checkpoint_dir, cut_lineage


def test_query(spark, same_as_sql):
    assert same_as_sql(spark, "op2_warc_archives", "/root/testdata/sf0.01") == 250


def written(spark, pages, **options):
    folder = f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    return cut_lineage(write_archives(to_records(pages, **options), folder, archive_bytes=1 << 20))


def raw(path):
    with open(path.removeprefix("file:"), "rb") as file:
        return file.read()


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    report = written(spark, pages.repartition(2))
    paths = [r.path for r in report.collect()]
    assert len(paths) > 3 and sum(r.records for r in report.collect()) == pages.count()
    got = {r.record_id: r for r in read_archives(report).collect()}
    for r in pages.collect():
        own = got[str(r.page_id)]
        assert own.url and own.error is None and own.payload_bytes == len(r.html.encode())
        assert (own.payload.decode() == r.html) if own.record_type == "response" else not own.payload
    whole = raw(paths[0])
    assert struct.unpack("<I", whole[:4])[0] == warc.DICTIONARY
    size = struct.unpack("<I", whole[4:8])[0]
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(whole[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(whole[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and zstandard.get_frame_parameters(whole[8 + size :]).dict_id == dictionary.dict_id()


class Stream:
    def __init__(self, data):
        self.data = data

    def read(self, n):
        out, self.data = self.data[: min(n, 7)], self.data[min(n, 7) :]
        return out


def test_frames_and_damage():
    one = record("a b>", "http://x/ü\r\n", b"body", 4, warc.digest(b"body"), None)
    two = record("b", None, None, 4, warc.digest(b"body"), "a b>")
    pack = zstandard.ZstdCompressor().compress
    data = pack(one) + struct.pack("<II", 0x184D2A53, 3) + b"xyz" + pack(two)
    assert list(frames(Stream(data))) == [one, two]
    kind, rid, url, refers, payload, size, sha = parsed(one)
    assert (kind, rid, refers, payload, size) == ("response", "a b>", None, b"body", 4) and sha == warc.digest(b"body") and "\n" not in url
    assert parsed(two)[:4] == ("revisit", "b", None, "a b>") and parsed(two)[5:] == (4, warc.digest(b"body"))
    plain = zstandard.ZstdCompressionDict(b"WARC/1.1 raw dictionary of some length")
    held = struct.pack("<II", warc.DICTIONARY, len(plain.as_bytes())) + plain.as_bytes()
    assert list(frames(Stream(held + zstandard.ZstdCompressor(dict_data=plain).compress(one)))) == [one]
    for bad in (data[:-3], data[:10], b"\x00\x01\x02\x03", pack(one) + b"\x28", struct.pack("<II", warc.DICTIONARY, 99) + b"x"):
        with pytest.raises(warc.Damaged):
            list(frames(Stream(bad)))
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"body", b"b0dy"), (b"WARC-Type: response\r\n", b""), (b"WARC-Date: ", b"WARC Date "), (b"\r\n\r\n" + b"HTTP", b"\r\n\r\nHTT"), (b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(warc.Damaged):
            parsed(one.replace(old, new))
    with pytest.raises(warc.Damaged):
        parsed(one + b"more")


def test_damaged_archives(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"text {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    report = written(spark, pages)
    path = report.first().path
    data = raw(path)
    broken = f"{path}.cut"
    with open(broken.removeprefix("file:"), "wb") as file:
        file.write(data[:-20])
    empty = f"{path}.empty"
    open(empty.removeprefix("file:"), "wb").close()
    paths = spark.createDataFrame([(broken,), (empty,), (None,)], "path string")
    rows = read_archives(paths, strict=False).collect()
    assert [r.error is None for r in rows] == [True] * 4 + [False]
    with pytest.raises(Exception, match="ends early"):
        read_archives(paths).collect()


def test_edge_cases(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "", "same"), (5, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "u", "é" * 300_000), (1, None, "same")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, size int")
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes) for r in read_archives(written(spark, pages)).collect())
    assert got == sorted(
        [("3", "revisit", "1", 4), ("1", "response", "", 4), ("1", "response", "", 4), ("2", "revisit", "1", 4), ("5", "revisit", "4", 0), ("4", "response", "", 0),
         ("", "revisit", "1", 4), ("", "response", "", 5), ("7", "response", "", 600_000)]
    )
    short = read_archives(written(spark, pages, min_bytes=5)).where(F.col("record_type") == "revisit")
    assert short.count() == 0
    assert read_archives(written(spark, pages.limit(0))).count() == 0
