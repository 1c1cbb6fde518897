"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked id pairs.

Each task encodes its documents by both sides and cuts them where tokens of both end. An
A token and a B token are linked where their bytes overlap; between two neighbouring token
ends of either side there is just one link. Links are counted by external spilling: a task
gathers a run of (pair, document) records, sorts it, parts it by a radix of the B id and
writes the parts as zstd blocks. A k-way heap merge over the blocks of one radix counts
each pair; pairs are in B-major order, so the highest count of a B id is known when its
pairs are. The blocks are then streamed once more, and every record adds its pair's count
to its document.

A group of the merge is a radix and a salt over the blocks; the number of salts grows with
the records, so no group holds more than about ``GROUP_RECORDS``, whatever B id is hot.
Records are kept by document once, however often the pair is linked in it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import words as W
from lexweave.llm.tables import text_of
from lexweave.session import cut_lineage

RADICES = 32
#: Links after which a run is written.
RUN_LINKS = 2_000_000
#: Documents of a run; their numbers fit in 16 bits.
RUN_DOCS = 1 << 16
BLOCK_RECORDS = 1 << 16
GROUP_RECORDS = 8_000_000


@dataclass(frozen=True)
class Table:
    """Byte strings in one array."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Table:
        size = np.array([len(s) for s in strings], np.int64)
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The strings of ``ids`` one after the other."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in zip([*plain, *range(256, 256 + len(other))], plain + other)}


@dataclass(frozen=True)
class Side:
    """A tokenizer: texts to ids, the bytes of each id, and whether it puts a space before a text itself."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: Table
    adds_space: bool


@functools.cache
def byte_side(path: str, ranks: str | None = None) -> Side:
    """A byte-level BPE of the ``tokenizers`` file ``path``; strings of special tokens are plain text.

    ``ranks`` may name the same vocabulary as merge ranks, which another library applies faster.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    strings = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        strings[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    if ranks is None:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        return Side(lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts], Table.of(strings), False)
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Side(lambda texts: [fast.encode_ordinary(t) for t in texts], Table.of(strings), False)


@functools.cache
def piece_side(path: str) -> Side:
    """A piece model of ``sentencepiece``; U+2581 stands for a space, <0xHH> for a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def content(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda texts: model.encode(texts, num_threads=1), Table.of([content(i) for i in range(model.get_piece_size())]), True)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    count = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(count.sum())), count


def _spans(count: np.ndarray) -> Iterator[slice]:
    ends = np.cumsum(count)
    return (slice(e - n, e) for e, n in zip(ends.tolist(), count.tolist()))


@dataclass
class Aligned:
    """Tokens, groups and links of a slice of documents."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]  # ``a1,a2|b1;a3|b2,b3`` per document
    doc: np.ndarray  # per link: document, A id, B id
    a: np.ndarray
    b: np.ndarray


@functools.cache
def _decimals(n: int) -> Table:
    """Decimal strings of 0 to n - 1, each with one byte more for what follows it."""
    return Table.of([b"%d " % i for i in range(n)])


def aligned(texts: list[str | None], a: Side, b: Side) -> Aligned:
    """Tokens of both sides, cut where both end. Documents whose joined tokens differ from
    a space and the text have none; so have null and empty ones."""
    texts = [t or "" for t in texts]
    sides = []
    good = np.array([t != "" for t in texts], bool)
    for side in (a, b):
        ids, count = _flat(side.encode([t if side.adds_space else " " + t for t in texts]))
        sizes = np.array([int(side.tokens.size[ids[s]].sum()) for s in _spans(count)], np.int64)
        data = side.tokens.joined(ids).tobytes()
        for i, s in enumerate(_spans(sizes)):
            good[i] &= data[s] == b" " + texts[i].encode()
        sides.append((ids, count))
    kept = []
    for (ids, count), side in zip(sides, (a, b)):
        ids = ids[np.repeat(good, count)]
        # a token without bytes ends where the one before does and cannot be aligned
        ids, count = ids[side.tokens.size[ids] > 0], np.where(good, count, 0)
        if len(ids) != count.sum():
            raise ValueError("a token has no bytes")
        kept.append((ids, count, np.cumsum(side.tokens.size[ids])))
    (ids_a, n_a, ends_a), (ids_b, n_b, ends_b) = kept
    n = len(texts)
    if not len(ids_a):
        zero = np.zeros(n, np.int64)
        none = np.zeros(0, np.int64)
        return Aligned(zero, zero, zero, zero, [b""] * n, none, none, none)
    doc_of_a = np.repeat(np.arange(n), n_a)
    # a link for every stretch between neighbouring ends of either side
    cuts = np.union1d(ends_a, ends_b)
    at_a = np.searchsorted(ends_a, cuts)
    doc = doc_of_a[at_a]
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    n_groups = np.bincount(doc_of_a[np.searchsorted(ends_a, both)], minlength=n)
    # tokens in the order they are written: the A ids of a group, then its B ids
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[place_a], order[place_b] = ids_a, ids_b
    mark = np.full(len(order), ord(","), np.uint8)
    mark[place_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
    mark[place_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
    decimals = _decimals(max(len(a.tokens.size), len(b.tokens.size)))
    line = decimals.joined(order)
    ends = np.cumsum(decimals.size[order])
    line[ends - 1] = mark
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    written = line.tobytes()
    groups = [written[lo : max(lo, hi - 1)] for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist())]
    return Aligned(n_a, n_b, n_groups, np.bincount(doc, minlength=n), groups, doc, ids_a[at_a], ids_b[np.searchsorted(ends_b, cuts)])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, each cut to its narrowest unsigned type."""
    parts = [struct.pack("<B", len(arrays))]
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(k[2]))
        parts.append(struct.pack("<BQ", int(kind[2]), len(x)) + x.astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1, []
    for _ in range(raw[0]):
        width, n = struct.unpack_from("<BQ", raw, at)
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return out


def run_blocks(ord_: np.ndarray, pair: np.ndarray, n_a: int, radices: int = RADICES, size: int = BLOCK_RECORDS) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """A run's records as blocks (radix, number, records, pairs, documents), each sorted by pair and document.

    ``pairs`` packs the block's distinct pairs as steps, how many documents have each, and
    their links; ``documents`` packs each record's document and its links.
    """
    key = pair * RUN_DOCS + ord_
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    links = np.diff(np.append(first, len(key)))
    pair, ord_ = np.divmod(key[first], RUN_DOCS)
    radix = (pair // n_a) % radices
    order = np.argsort(radix, kind="stable")
    bounds = np.searchsorted(radix[order], np.arange(radices + 1))
    for r in range(radices):
        for number, lo in enumerate(range(bounds[r], bounds[r + 1], size)):
            rows = order[lo : min(lo + size, bounds[r + 1])]
            p, m = pair[rows], links[rows]
            new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            steps = np.diff(p[new], prepend=0)
            yield r, number, len(rows), _packed(steps, np.diff(np.append(new, len(rows))), np.add.reduceat(m, new)), _packed(ord_[rows], m)


def merged(blocks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums per key over sorted (keys, values) streams, in ascending order, by a k-way heap merge.

    The heap holds the last key of each open stream; everything up to the least of them is
    summed and handed on at once.
    """
    opened = sorted(blocks, key=lambda x: int(x[0][0]))
    heap: list[tuple[int, int]] = []
    at = [0] * len(opened)
    waiting = 0
    while heap or waiting < len(opened):
        if not heap:
            heapq.heappush(heap, (int(opened[waiting][0][-1]), waiting))
            waiting += 1
        while waiting < len(opened) and int(opened[waiting][0][0]) <= heap[0][0]:
            heapq.heappush(heap, (int(opened[waiting][0][-1]), waiting))
            waiting += 1
        bound = heap[0][0]
        keys, values = [], []
        for _, i in heap:
            k, v = opened[i]
            end = int(np.searchsorted(k, bound, "right"))
            if end > at[i]:
                keys.append(k[at[i] : end])
                values.append(v[at[i] : end])
                at[i] = end
        while heap and heap[0][0] <= bound:
            heapq.heappop(heap)
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield key[new], np.add.reduceat(value, new)


def align(
    docs: DataFrame, a: Callable[[], Side], b: Callable[[], Side], *, n_a: int, id_col: str = "doc_id", text_col: str = "text",
    radices: int = RADICES, run_links: int = RUN_LINKS, group_records: int = GROUP_RECORDS,
) -> tuple[DataFrame, DataFrame]:
    """Per document its alignment, and per linked id pair its count.

    ``a`` and ``b`` make the two sides inside a task; ids of A are below ``n_a``. The first
    frame has (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one
    row per document: ``n_best`` counts the links whose pair is linked most often in the
    corpus of all pairs of its B id (ties included), ``count_sum`` adds up the counts of
    their pairs. The second has (a, b, n_links, is_best) over the whole corpus.

    Null and empty texts, and those whose tokens do not give back a space and the text,
    have zeros and an empty digest; a null id stays null; repeated rows are documents of
    their own, counted each; an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    counts = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([
        T.StructField("run", T.LongType()), T.StructField("ord", T.IntegerType()), rows.schema["id"],
        *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups_sha256", T.StringType()),
        T.StructField("radix", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("records", T.LongType()),
        T.StructField("pairs", T.BinaryType()), T.StructField("documents", T.BinaryType()),
    ])

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = a(), b()
        run = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_docs = n_links = 0

        def written() -> pa.RecordBatch:
            ord_, pair = (np.concatenate(x) for x in zip(*held))
            blocks = list(run_blocks(ord_, pair, n_a, radices))
            k = len(blocks)
            radix, number, records, pairs, documents = zip(*blocks)
            nulls = [pa.nulls(k, f) for f in arrow[1:8]]
            return pa.RecordBatch.from_arrays(
                [pa.array([run] * k, pa.int64()), *nulls, pa.array(radix, pa.int32()), pa.array(number, pa.int32()),
                 pa.array(records, pa.int64()), pa.array(pairs, pa.binary()), pa.array(documents, pa.binary())], names=schema.names,
            )

        arrow: list[pa.DataType] = []
        for batch in batches:
            arrow = [pa.int64(), pa.int32(), batch.column(0).type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            for lo, hi in W.slices(batch.column(1)):
                for begin in range(lo, hi, RUN_DOCS):
                    part = batch.slice(begin, min(hi - begin, RUN_DOCS))
                    k = part.num_rows
                    if held and (n_docs + k > RUN_DOCS or n_links >= run_links):
                        yield written()
                        held.clear()
                        n_links = 0
                    if not held:
                        run, n_docs = run + 1, 0
                    x = aligned(part.column(1).to_pylist(), side_a, side_b)
                    ord_ = np.arange(n_docs, n_docs + k)
                    held.append((ord_[x.doc], x.b * n_a + x.a))
                    n_docs, n_links = n_docs + k, n_links + len(x.doc)
                    sha = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([run] * k, pa.int64()), pa.array(ord_, pa.int32()), part.column(0), *[pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)],
                         pa.array(sha, pa.string()), *[pa.nulls(k, f) for f in arrow[8:]]], names=schema.names,
                    )
        if held and sum(len(x) for x, _ in held):
            yield written()

    runs = cut_lineage(rows.mapInArrow(spill, schema))
    blocks = runs.where("radix IS NOT NULL")
    records = blocks.agg(F.sum("records")).first()[0] or 0
    salts = -(-records // group_records) or 1
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("run", "block"), F.lit(salts)).cast("int"))

    def count(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        streams = []
        for packed in found["pairs"]:
            steps, _, links = _unpacked(packed)
            streams.append((np.cumsum(steps), links))
        pair, links = (np.concatenate(x) for x in zip(*merged(streams)))
        return pd.DataFrame({"radix": key[0], "salt": key[1], "pair": pair, "links": links})

    partial = cut_lineage(
        salted.select("radix", "salt", "pairs").groupBy("radix", "salt").applyInPandas(count, "radix int, salt int, pair long, links long")
    )
    # B-major: all pairs of a B id, at most the size of A, give its highest count
    totals = partial.groupBy("pair").agg(F.sum("links").alias("total")).withColumn("b", F.floor(F.col("pair") / F.lit(n_a)).cast("int"))
    totals = cut_lineage(totals.withColumn("best", F.col("total") == F.max("total").over(Win.partitionBy("b"))))
    known = partial.join(totals, "pair").select("radix", "salt", "pair", "total", "best")

    def contribute(key: tuple, found: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        counted = counted.sort_values("pair")
        pairs, total, best = (counted[c].to_numpy() for c in ("pair", "total", "best"))
        out = []
        for run, packed, documents in zip(found["run"], found["pairs"], found["documents"]):
            steps, n_docs, _ = _unpacked(packed)
            ord_, links = _unpacked(documents)
            at = np.repeat(np.searchsorted(pairs, np.cumsum(steps)), n_docs)
            order = np.argsort(ord_.astype(np.uint16), kind="stable")
            ord_ = ord_[order]
            new = np.flatnonzero(np.append(True, ord_[1:] != ord_[:-1]))
            sums = [np.add.reduceat((v * links)[order], new) for v in (best[at].astype(np.int64), total[at])]
            out.append(pd.DataFrame({"run": run, "ord": ord_[new], "n_best": sums[0], "count_sum": sums[1]}))
        return pd.concat(out)

    added = salted.select("radix", "salt", "run", "pairs", "documents").groupBy("radix", "salt").cogroup(known.groupBy("radix", "salt"))
    added = added.applyInPandas(contribute, "run long, ord int, n_best long, count_sum long")
    added = added.groupBy("run", "ord").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    aligned_docs = runs.where("ord IS NOT NULL").select("run", "ord", "id", *counts, "groups_sha256").join(added, ["run", "ord"], "left")
    zero = F.lit(0).cast("long")
    return (
        aligned_docs.select(
            F.col("id").alias(id_col), *counts, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
        ),
        totals.select((F.col("pair") % n_a).cast("int").alias("a"), "b", F.col("total").alias("n_links"), F.col("best").alias("is_best")),
    )
