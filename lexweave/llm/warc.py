"""WARC archives under Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writers run in the tasks, each with archives and dictionaries of its own, and report the
files they finished; readers stream the files of such a report, so neither holds more
than one record and a buffer. Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.tables import row_key, small_enough, text_of

# Fixed values of the formats.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY = 0x184D2A5D
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:record:"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of records that a writer holds back to train a dictionary on, and the dictionary's size.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 1 << 15
#: A writer begins a new archive beyond so many bytes of records.
ARCHIVE_BYTES = 64 << 20
BUFFER = 1 << 16
SALTS = 16
SMALL_ROWS = 500_000

REPORT = "path string, records long, bytes long"
RECORDS = (
    "path string, number long, record_type string, record_id string, url string, refers_to string, "
    "payload binary, payload_bytes long, payload_digest string, error string"
)


class Damaged(ValueError):
    """A frame or record that does not hold what it says."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(record_id: str) -> str:
    return f"<{ID}{quote(record_id, safe='')}>"


def record(record_id: str, url: str | None, payload: bytes | None, size: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the response's head and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {named(record_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=chr(37) + '/:?#[]@!$&()*+,;=~' + chr(39))}"] if url else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(refers_to)}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Writes records to one file; the dictionary is trained on the first of them."""

    def __init__(self, path: str):
        self.path, self.held, self.held_bytes = path, [], 0
        self.records = self.bytes = 0
        system, at = pafs.FileSystem.from_uri(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(at, compression=None)  # by default the name decides
        self.compress = None

    def start(self) -> None:
        dictionary = None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.held)
        except zstandard.ZstdError:
            pass  # too few or too short samples: an archive may go without
        if dictionary:
            body = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY, len(body)) + body)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True).compress
        held, self.held = self.held, []
        for data in held:
            self.out.write(self.compress(data))

    def write(self, data: bytes) -> None:
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.compress:
            self.out.write(self.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self.start()

    def close(self) -> tuple[str, int, int]:
        if not self.compress:
            self.start()
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (id, url, payload, size, digest, refers_to) as archives; gives (path, records, bytes) of each.

    The report must be kept, since reading it twice would write twice. A task that is run
    again writes new files; only those of the run that ended are reported. ``folder`` must
    be shared by all executors. Without rows there are no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get(), None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(6)]
                archive = archive or Archive(f"{folder}/{task.partitionId()}-{uuid.uuid4().hex}.warc.zst")
                archive.write(record(*row))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])

    return records.select("id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, REPORT)


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive; the stream needs ``read(n)``."""
    held = b""
    dictionary = None
    first = True

    def take(n: int) -> bytes:
        nonlocal held
        parts, got = [held], len(held)
        while got < n:
            more = stream.read(max(BUFFER, n - got))
            if not more:
                break
            parts.append(bytes(more))
            got += len(more)
        held = b"".join(parts)
        out, held = held[:n], held[n:]
        return out

    while True:
        head = take(4)
        if not head:
            return
        if len(head) < 4:
            raise Damaged("a frame ends within its head")
        magic = struct.unpack("<I", head)[0]
        if magic in SKIPPABLE:
            size = take(4)
            body = take(struct.unpack("<I", size)[0]) if len(size) == 4 else b""
            if len(size) < 4 or len(body) < struct.unpack("<I", size)[0]:
                raise Damaged("a skippable frame ends early")
            if first and magic == DICTIONARY:
                if body[:4] == struct.pack("<I", FRAME):
                    try:
                        body = zstandard.ZstdDecompressor().decompress(body)
                    except zstandard.ZstdError as error:
                        raise Damaged(f"the dictionary is damaged: {error}") from error
                dictionary = zstandard.ZstdCompressionDict(body)
        elif magic == FRAME:
            unpack = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            out, data = [], head + held
            held = b""
            while True:
                try:
                    out.append(unpack.decompress(data))
                except zstandard.ZstdError as error:
                    raise Damaged(f"a frame is damaged: {error}") from error
                if unpack.eof:
                    held = unpack.unused_data
                    break
                data = bytes(stream.read(BUFFER))
                if not data:
                    raise Damaged("a frame ends early")
            yield b"".join(out)
        else:
            raise Damaged("no frame begins here")
        first = False


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Damaged(f"no header: {line[:60]!r}")
        try:
            out.setdefault(name.decode("ascii").lower(), value.strip().decode())
        except UnicodeDecodeError as error:
            raise Damaged(f"no header: {line[:60]!r}") from error
    return out


def parsed(data: bytes) -> tuple:
    """(record_type, record_id, url, refers_to, payload, payload_bytes, payload_digest) of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("no record head")
    own = headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not own.get(name):
            raise Damaged(f"{name} is missing")
    length = own["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("content-length does not fit the frame")
    block = rest[:-4]
    if own.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise Damaged("the block digest does not fit")

    def bare(name: str) -> str | None:
        value = own.get(name)
        if value is None:
            return None
        return unquote(value[len(ID) + 1 : -1]) if value.startswith(f"<{ID}") and value.endswith(">") else value

    payload, size = block, len(block)
    if own.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise Damaged("no response head")
        said = headers(http.split(b"\r\n")[1:]).get("content-length")
        size = int(said) if said and said.isdigit() else len(payload)
    stated = own.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if own["warc-type"] == "revisit":
        if not bare("warc-refers-to"):
            raise Damaged("a revisit refers to nothing")
    elif size != len(payload):
        raise Damaged("the payload's length does not fit")
    elif stated not in (None, digest(payload)):
        raise Damaged("the payload digest does not fit")
    else:
        stated = digest(payload)
    return own["warc-type"], bare("warc-record-id"), own.get("warc-target-uri"), bare("warc-refers-to"), payload, size, stated


def read_archives(paths: DataFrame, *, path_col: str = "path", strict: bool = True) -> DataFrame:
    """The records of the archives named by ``path_col``, see RECORDS; archives are dealt over the tasks.

    Every record is checked: its head, the length of its block and payload, their digests
    and that its frame holds nothing else. A damaged record ends the query, or with
    ``strict`` false becomes a row with ``error``; a damaged frame then ends its archive, as
    what follows it cannot be found. Null paths are passed over; a file of no bytes has no
    records.
    """
    kinds = {"number": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64()}
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]

    def records(path: str) -> Iterator[tuple]:
        system, at = pafs.FileSystem.from_uri(path)
        with system.open_input_stream(at, compression=None) as stream:
            number = -1
            try:
                for number, data in enumerate(frames(stream)):
                    try:
                        yield path, number, *parsed(data), None
                    except Damaged as error:
                        if strict:
                            raise
                        yield path, number, None, None, None, None, None, None, None, str(error)
            except Damaged as error:
                if strict:
                    raise Damaged(f"{path}, record {number + 1} or before: {error}") from error
                yield path, number + 1, None, None, None, None, None, None, None, str(error)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in records(path) if path else ():
                    rows.append(row)
                    held += len(row[6] or b"") + 200
                    if held >= 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return paths.select(F.col(path_col).cast("string")).mapInArrow(run, RECORDS)


def to_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, size, digest, refers_to) of each page: of equal payloads all but one are revisits.

    Of payloads of ``min_bytes`` bytes or more, that of the smallest id is the response
    and the others refer to it; shorter ones are all responses. A page is found again by
    a hash of id and payload, so that payloads are not shuffled while the revisits are few.
    Null payloads count as empty; a null id is written as an empty one and is never
    referred to while an equal payload has an id; rows repeated in id and payload are of
    one kind.
    """
    text = text_of(pages, payload_col)
    rows = pages.select(pages[id_col].alias("page"), pages[url_col].cast("string").alias("url"), text.alias("text"))
    rows = rows.withColumn("key", row_key(F.col("page"), F.col("text"))).withColumn("size", F.octet_length("text").cast("long"))
    rows = rows.withColumn("sha", F.sha1(F.col("text").cast("binary")))
    small = rows.where(F.col("size") >= min_bytes).select("sha", "page", "key")
    firsts = small.groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = small.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    again = salted.join(spread, ["sha", "salt"]).where(~F.col("page").eqNullSafe(F.col("first"))).select("key", "first").distinct()
    joined = rows.join(small_enough(again, SMALL_ROWS), "key", "left")
    return joined.select(
        F.coalesce(F.col("page").cast("string"), F.lit("")).alias("id"),
        "url",
        F.when(F.col("first").isNull(), F.col("text").cast("binary")).alias("payload"),
        "size",
        F.col("sha").alias("sha"),
        F.col("first").cast("string").alias("refers_to"),
    ).withColumn("digest", base32(F.col("sha")))


def base32(hexes):
    """Upper-case base32 of a column of 40 hex digits: every five digits make four characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def letter(i):
        value = F.conv(F.substr(hexes, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("long")
        place = F.floor(value / F.pow(F.lit(2), 15 - (i % 4) * 5)) % 32
        return F.substr(letters, (place + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")
