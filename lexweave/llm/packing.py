"""Mixture-controlled packing of token streams into sequences of fixed length.

Every source is a queue of tokens. A deficit round-robin serves the queues in grains:
each window (one sequence) adds to a queue's deficit its share of the window, whole
grains are served from the deficit, and what is left over goes to the queues with the
largest deficits; deficits are carried to the next window. The round-robin is run once
over a period of bounded length and repeats; grains that do not divide evenly among the
periods are a queue of their own in it, dealt in the same way. So the place of any grain
in the output follows from its place in its queue alone. Tasks therefore carry on each other's
deficits without talking to each other, and a hot source is cut like any other.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import words as W
from lexweave.llm.tables import small_enough, text_of
from lexweave.session import cut_lineage

LENGTH = 1024
GRAIN = 64
#: Longest period of the round-robin, in grains.
PERIOD = 16_384
#: Most uneven grains whose places are held in memory and not worked out when asked for.
HELD = 1 << 20
#: Sources with a queue of their own; all others share one, spread evenly in it.
MAX_QUEUES = 256
CHUNKS_PER_GROUP = 4096


@functools.cache
def encoder(path: str, ranks: str | None):
    """A function text -> token ids, equal to ``tokenizers`` on the file ``path``.

    ``ranks`` may name the same vocabulary as merge ranks, which another library reads
    and applies faster; texts holding a special token's string keep to ``path``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if ranks is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def round_robin(weights: np.ndarray, window: int) -> list[np.ndarray]:
    """Places of each queue's grains when ``weights`` grains are dealt over windows of ``window`` grains.

    Places count from 0 to ``weights.sum()`` - 1 without gaps; within a window a queue's
    grains are together, queues in order.
    """
    weights = weights.astype(np.int64)
    total = int(weights.sum())
    places: list[list[np.ndarray]] = [[] for _ in weights]
    served = np.zeros(len(weights), np.int64)
    at = 0
    while at < total:
        here = min(window, total - at)
        # the deficit of a queue is its share so far less what it got, here times ``total``
        deficit = weights * (at + here) - served * total
        grains = np.maximum(deficit // total, 0)
        short = here - int(grains.sum())
        if short > 0:
            left = deficit - grains * total
            grains[np.lexsort((np.arange(len(weights)), -left))[:short]] += 1
        elif short < 0:
            spare = np.flatnonzero(grains)
            order = spare[np.lexsort((spare, (deficit - grains * total)[spare]))]
            grains[order[:-short]] -= 1
        for s in np.flatnonzero(grains):
            places[s].append(np.arange(at, at + grains[s]))
            at += int(grains[s])
        served += grains
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in places]


class Spread:
    """Places of one queue's grains over ``laps`` periods and a last part, in order.

    ``own`` are its places in every period. ``extra`` are the places in a period that all
    queues share for what does not divide by ``laps``; ``rest`` are this queue's numbers
    among the extra places of all periods. ``last`` are its places after the periods.
    """

    def __init__(self, laps: int, period: int, own: np.ndarray, extra: np.ndarray, rest: np.ndarray | Spread, last: np.ndarray):
        self.laps, self.period, self.own, self.extra, self.rest, self.last = laps, period, own, extra, rest, last
        self.held = self.number(np.arange(len(rest))) if isinstance(rest, np.ndarray) else None

    def __len__(self) -> int:
        return self.laps * len(self.own) + len(self.rest) + len(self.last)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self[np.arange(len(self))].astype(dtype or np.int64)

    def number(self, i: np.ndarray) -> np.ndarray:
        """Which grain of the queue its extra grain ``i`` is."""
        if not len(i):
            return np.zeros(0, np.int64)
        lap, at = np.divmod(self.rest[i], len(self.extra))
        return i + lap * len(self.own) + np.searchsorted(self.own, self.extra[at])

    def extras_before(self, g: np.ndarray) -> np.ndarray:
        if self.held is not None:
            return np.searchsorted(self.held, g)
        low, high = np.zeros(len(g), np.int64), np.full(len(g), len(self.rest))
        while (low < high).any():
            middle = (low + high) // 2
            less = (low < high) & (self.number(np.minimum(middle, len(self.rest) - 1)) < g)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
        return low

    def __getitem__(self, g: np.ndarray) -> np.ndarray:
        out = np.empty(len(g), np.int64)
        end = len(self) - len(self.last)
        late = g >= end
        out[late] = self.laps * self.period + self.last[g[late] - end]
        here = np.flatnonzero(~late)
        i = self.extras_before(g[here])
        extra = np.zeros(len(here), bool)
        some = np.flatnonzero(i < len(self.rest))
        extra[some] = self.number(i[some]) == g[here[some]]
        lap, at = np.divmod(self.rest[i[extra]], max(1, len(self.extra)))
        out[here[extra]] = lap * self.period + self.extra[at]
        lap, at = np.divmod((g[here] - i)[~extra], max(1, len(self.own)))
        out[here[~extra]] = lap * self.period + self.own[at]
        return out


def dealt(grains: np.ndarray, window: int, period: int = PERIOD) -> list[np.ndarray | Spread]:
    """Places of each queue's grains as of ``round_robin``, from one of ``period`` grains at most.

    The mixture is kept over the whole length: what a period leaves of each queue is dealt
    among the periods and never put behind them.
    """
    total = int(grains.sum())
    period = max(period, 4 * len(grains))
    period = max(window, period - period % window)
    if total <= period:
        return round_robin(grains, window)
    laps, left = divmod(total, period)
    last, over = grains * left // total, grains * left % total
    last[np.lexsort((np.arange(len(grains)), -over))[: left - int(last.sum())]] += 1
    own, rest = np.divmod(grains - last, laps)
    *places, extra = round_robin(np.append(own, period - own.sum()), window)
    inner = dealt(rest, max(1, window // 4), period) if len(extra) else [np.zeros(0, np.int64)] * len(grains)
    if rest.sum() <= HELD:
        inner = [np.asarray(x) for x in inner]
    return [Spread(laps, period, *x) for x in zip(places, [extra] * len(grains), inner, round_robin(last, window))]


@dataclass
class Block:
    """``repeats`` periods of one round-robin, beginning at grain ``base`` of the output."""

    base: int
    repeats: int
    period: int
    places: list[np.ndarray | Spread]


def schedule(full: np.ndarray, share: np.ndarray | None, window: int, period: int = PERIOD) -> list[Block]:
    """Blocks that deal out ``full`` whole grains of each queue.

    With ``share`` None a queue's target is its part of all grains, so all queues end
    together. Otherwise targets are in proportion to ``share``; when a queue ends, the rest
    share its place, and queues of share 0 come last.
    """
    left = full.astype(np.int64).copy()
    blocks: list[Block] = []
    base = 0
    while left.any():
        if share is None:
            phase = left.copy()
        else:
            use = np.where(left > 0, share, 0.0)
            use = use if use.any() else left.astype(float)
            has = use > 0
            ratio = (left[has] / use[has]).min()
            phase = np.zeros(len(left), np.int64)
            phase[has] = np.minimum(left[has], np.floor(ratio * use[has] + 1e-9).astype(np.int64))
            ends = has & (np.divide(left, use, out=np.full(len(left), np.inf), where=has) <= ratio)
            phase[ends] = left[ends]
        left -= phase
        if phase.any():
            blocks.append(Block(base, 1, int(phase.sum()), dealt(phase, window, period)))
            base += int(phase.sum())
    return blocks


def pieces_of(
    queue: np.ndarray, start: np.ndarray, count: np.ndarray, full: np.ndarray, tail: np.ndarray, blocks: list[Block],
    grain: int, length: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start in it, tokens, place in the output) of the pieces, document by document.

    ``start`` is a document's place in its queue, ``full`` the queues' whole grains and
    ``tail`` where the tokens after them begin in the output.
    """
    first, last = start // grain, (start + count - 1) // grain
    parts = last - first + 1
    doc = np.repeat(np.arange(len(queue)), parts)
    number = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.maximum(number * grain, start[doc])
    end = np.minimum((number + 1) * grain, (start + count)[doc])
    place = np.empty(len(doc), np.int64)
    for s in np.unique(queue):
        own = np.flatnonzero(queue[doc] == s)
        g = number[own]
        slot = np.full(len(own), -1, np.int64)
        done = 0
        for block in blocks:
            weight = len(block.places[s])
            if weight:
                here = (g >= done) & (g < done + weight * block.repeats)
                lap, at = np.divmod(g[here] - done, weight)
                slot[here] = block.base + lap * block.period + block.places[s][at]
                done += weight * block.repeats
        rest = g >= full[s]
        slot[rest] = 0
        place[own] = np.where(rest, tail[s] + begin[own] - full[s] * grain, slot * grain + begin[own] - g * grain)
    # only tokens after the whole grains can cross the end of a sequence, and once at most
    room = length - place % length
    cross = np.flatnonzero(end - begin > room)
    if len(cross):
        twice = np.sort(np.concatenate([np.arange(len(doc)), cross]))
        second = np.zeros(len(twice), bool)
        second[1:] = twice[1:] == twice[:-1]
        lead = np.append(second[1:], False)
        doc, begin, end, place, room = doc[twice], begin[twice], end[twice], place[twice], room[twice]
        end = np.where(lead, begin + room, end)
        begin, place = np.where(second, begin + room, begin), np.where(second, place + room, place)
    joined = np.zeros(len(doc), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + (end - begin)[:-1]) & (place[1:] % length != 0)
    head = np.flatnonzero(~joined)
    size = np.add.reduceat(end - begin, head) if len(head) else head
    return doc[head], (begin - start[doc])[head], size, place[head]


def tokenised(docs: DataFrame, queues: list[str], *, id_col: str, text_col: str, source_col: str, path: str, ranks: str | None, end_id: int) -> DataFrame:
    """(id, queue, chunk, start, doc_tokens, ids, n, source): one row per document, ids little-endian 16 or 32 bits.

    ``chunk`` is the task, ``start`` the tokens of the queue before the document in it, ``n``
    the documents before it. ``source`` is the source of a document in the pooled queue.
    """
    number = F.create_map(*[x for i, q in enumerate(queues) for x in (F.lit(q), F.lit(i))]) if queues else None
    own = number[queue_name(docs, source_col)] if queues else F.lit(None).cast("int")
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(own, F.lit(len(queues))).alias("queue"), text_of(docs, text_col).alias("text"),
        F.when(own.isNull(), queue_name(docs, source_col)).alias("source"),
    )
    schema = T.StructType(
        [
            rows.schema["id"],
            *[T.StructField(n, k) for n, k in (("queue", T.IntegerType()), ("chunk", T.LongType()), ("start", T.LongType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType()), ("n", T.LongType()), ("source", T.StringType()))],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        chunk = TaskContext.get().partitionId()
        done = np.zeros(len(queues) + 1, np.int64)
        docs_done = 0
        for batch in batches:
            for lo, hi in W.slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                queue = part.column(1).to_numpy()
                ids = [np.array([*encode(t), end_id], "<u4").tobytes() for t in part.column(2).to_pylist()]
                count = np.array([len(x) // 4 for x in ids], np.int64)
                start = np.zeros(len(ids), np.int64)
                for s in np.unique(queue):
                    own = queue == s
                    start[own] = done[s] + np.cumsum(count[own]) - count[own]
                    done[s] += count[own].sum()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(ids), chunk)), pa.array(start), pa.array(count), pa.array([narrow(x) for x in ids], pa.binary()),
                     pa.array(docs_done + np.arange(len(ids))), part.column(3)],
                    names=schema.names,
                )
                docs_done += len(ids)

    return rows.mapInArrow(run, schema)


def narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones where all fit, marked by the first byte."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 65536 else b"\x04" + ids


def widen(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1)


def queue_name(docs: DataFrame, source_col: str):
    source = docs[source_col].cast("string")
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def before(tokens: DataFrame) -> DataFrame:
    """(queue, chunk, offset): tokens of the queue in earlier chunks, by running sums in two steps."""
    sums = tokens.groupBy("queue", "chunk").agg(F.sum("doc_tokens").alias("n"))
    sums = sums.withColumn("part", F.expr(f"chunk div {CHUNKS_PER_GROUP}"))
    inner = Win.partitionBy("queue", "part").orderBy("chunk")
    outer = Win.partitionBy("queue").orderBy("part")
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("whole"))
    parts = parts.withColumn("earlier", F.sum("whole").over(outer) - F.col("whole"))
    within = sums.withColumn("inside", F.sum("n").over(inner) - F.col("n"))
    return within.join(parts, ["queue", "part"]).select("queue", "chunk", (F.col("inside") + F.col("earlier")).alias("offset"))


def spread_out(tokens: DataFrame, queue: int) -> DataFrame:
    """(chunk, n, start): places of the documents in the pooled ``queue``, its sources spread evenly.

    A document stands where its source is as far through its own tokens: at the tokens
    before it plus a part of its own, chosen by the source's hash, over all tokens of the
    source. So by any place in the queue every source has had its share, to a document.
    """
    light = tokens.where(F.col("queue") == queue).select("chunk", "n", "source", "doc_tokens")
    own = Win.partitionBy("source", "chunk").orderBy("n")
    shift = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    inside = F.sum("doc_tokens").over(own.rowsBetween(Win.unboundedPreceding, 0)) - F.col("doc_tokens")
    chunks = before(light.select(F.col("source").alias("queue"), "chunk", "doc_tokens")).withColumnRenamed("queue", "source")
    whole = light.groupBy("source").agg(F.sum("doc_tokens").alias("whole"))
    at = light.withColumn("inside", inside).join(chunks, ["source", "chunk"]).join(whole, "source")
    at = at.withColumn("at", (F.col("inside") + F.col("offset") + shift * F.col("doc_tokens")) / F.col("whole"))
    order = ["at", "source", "chunk", "n"]
    placed = cut_lineage(
        at.select(*order, "doc_tokens").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id())
    )
    ranges = before(placed.select(F.lit(queue).alias("queue"), F.col("part").alias("chunk"), "doc_tokens"))
    inside = F.sum("doc_tokens").over(Win.partitionBy("part").orderBy("place").rowsBetween(Win.unboundedPreceding, 0)) - F.col("doc_tokens")
    return placed.withColumn("inside", inside).join(ranges.select(F.col("chunk").alias("part"), "offset"), "part").select("chunk", "n", (F.col("inside") + F.col("offset")).alias("start"))


def pack(
    docs: DataFrame,
    *,
    path: str,
    ranks: str | None = None,
    targets: dict[str | None, float] | None = None,
    length: int = LENGTH,
    grain: int = GRAIN,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """Pieces (id_col, start, length, ids, doc_tokens, sequence_id, offset) of the packed documents.

    A document is its token ids and ``end_id``; every id lies in one piece. ``ids`` are
    little-endian 32-bit. Sequences hold ``length`` tokens, only the last may hold fewer.
    ``targets`` gives the token share of each source (null is a source; those it does not
    name get 0 and come after the others); by default each source's part of the corpus. Every window
    of a mixture is within a few grains of its targets for each queue. Sources beyond the
    ``max_queues`` with most documents share a queue (with ``targets``: all that it does
    not name), in which each of them is spread evenly, to a document. After the whole grains come the less than ``grain`` last tokens of each queue.

    Null text counts as empty and makes a piece of ``end_id`` alone, a null id stays null,
    repeated rows are packed each for itself, an empty table gives no pieces, and other
    columns are not looked at.
    """
    if length % grain:
        raise ValueError("grain must divide length")
    if targets is None:
        name = queue_name(docs, source_col)
        queues = [r.q for r in docs.groupBy(name.alias("q")).count().orderBy(F.desc("count"), "q").limit(max_queues).collect()]
        share = None
    else:
        queues = ["null" if s is None else f"={s}" for s in targets]
        share = np.array([*targets.values(), 0.0])
    tokens = cut_lineage(
        tokenised(docs, queues, id_col=id_col, text_col=text_col, source_col=source_col, path=path, ranks=ranks, end_id=end_id)
    )
    total = np.zeros(len(queues) + 1, np.int64)
    for r in tokens.groupBy("queue").agg(F.sum("doc_tokens").alias("n")).collect():
        total[r.queue] = r.n
    full, rest = total // grain, total % grain
    tail = int(full.sum()) * grain + np.cumsum(rest) - rest
    blocks = schedule(full, share, length // grain)
    pooled = len(queues)
    placed = tokens.where(F.col("queue") < pooled).join(small_enough(before(tokens), 200_000), ["queue", "chunk"]).select(
        "id", "queue", (F.col("start") + F.col("offset")).alias("start"), "doc_tokens", "ids"
    )
    if total[pooled]:
        rest_docs = tokens.where(F.col("queue") == pooled).drop("start").join(spread_out(tokens, pooled), ["chunk", "n"])
        placed = placed.unionByName(rest_docs.select("id", "queue", "start", "doc_tokens", "ids"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *[T.StructField(n, k) for n, k in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))],
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 250_000, "right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                queue, start, count = (part.column(i).to_numpy() for i in (1, 2, 3))
                doc, at, size, place = pieces_of(queue, start, count, full, tail, blocks, grain, length)
                data = np.concatenate([widen(x) for x in part.column(4).to_pylist()]).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(at), pa.array(size), ids, part.column(3).take(take), pa.array(place // length), pa.array(place % length)],
                    names=schema.names,
                )

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens): the packed sequences, each from its few pieces."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), "n_tokens")
