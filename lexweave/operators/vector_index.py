"""Nearest neighbours in cells of a coarse quantiser, with exact scores: the large form of ``knn``.

Centroids are fitted on a bounded sample; every base row is filed in the cell of its
nearest centroid, in a written table. A query meets only the rows of its ``probes`` nearest
cells, each scored exactly. How many cells that takes for the wanted recall is measured on
a few hundred queries against exact neighbours, so it holds for clustered and for shapeless
vectors alike. Tasks hold even blocks of queries, which the rows pass cell by cell, so a dense
cluster is no task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.vectors import LEAST_ROWS, SCORE_DIGITS, TILE_BYTES, _matrix, knn
from lexweave.session import cut_lineage

#: Rows, in expectation, on which centroids are fitted.
SAMPLE_ROWS = 20_000
#: Rows of the base that ask for their neighbours to measure the recall.
TUNE_QUERIES = 256
#: Most centroids; they are sent to every task.
MAX_CELLS = 4_096
#: Queries that a task holds while the base passes them, and rows of the base that pass in one task.
QUERY_ROWS = 60_000
PASS_ROWS = 2_000_000
#: Hits that a task keeps before it merges them, and hits it returns at a time.
MERGE_ROWS = 2_000_000
HIT_ROWS = 200_000
#: Bytes of vectors, about, that a task files in cells at a time.
BATCH_BYTES = 16 << 20


@dataclass
class VectorIndex:
    """``rows`` (id, vec, cell) is a written table, ``sizes`` the rows of each cell."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: np.ndarray
    probes: int


def _unit(mat: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)


def fit_centroids(sample: np.ndarray, cells: int, *, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means over unit rows; an empty cell takes a random row."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.bincount(near, minlength=len(centroids)) == 0
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        centroids = _unit(sums)
    return centroids


def _in_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``rows`` (id, vec) with the ``probes`` nearest ``cell`` s, a row for each; ``place`` counts them."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 22) // len(shared.value))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                near = _matrix(pa.table({"vec": part.column(1)})).astype(np.float32) @ shared.value.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                place = np.arange(probes, dtype=np.int32)
                # a row is copied for each of its cells: few rows at a time, and many cells of one row in turn
                at, most = np.repeat(np.arange(part.num_rows), probes), max(1, BATCH_BYTES // (8 * shared.value.shape[1]))
                for begin in range(0, len(at), most):
                    take = pa.array(at[begin : begin + most])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(order.ravel()[begin : begin + most].astype(np.int32)),
                         pa.array(np.resize(np.roll(place, -(begin % probes)), len(take)))],
                        names=["id", "vec", "cell", "place"],
                    )

    return rows.mapInArrow(run, f"id string, vec {dict(rows.dtypes)['vec']}, cell int, place int")


def _plain(df: DataFrame) -> DataFrame:
    """(id, vec) as texts and doubles; floats are moved as they are and widened in the tasks."""
    kind = dict(df.dtypes)["vec"]
    return df.select(F.col("id").cast("string").alias("id"), F.col("vec").cast(kind if kind == "array<float>" else "array<double>").alias("vec"))


def build_index(
    base: DataFrame, *, cells: int | None = None, k: int = 10, recall: float = 0.9, sample_rows: int = SAMPLE_ROWS,
    tune_queries: int = TUNE_QUERIES, rows: int | None = None, seed: int = 5,
) -> VectorIndex:
    """Index of ``base`` (id, vec) for about ``recall`` of the true top ``k``.

    Only the centroids come from a sample, of about ``sample_rows`` rows; every row is
    filed. ``cells`` is the square root of the rows unless given (at most MAX_CELLS). The
    number of cells a query looks into is the least that reaches ``recall`` and a margin for
    ``tune_queries`` sampled rows. ``rows`` saves counting the base.
    """
    base = _plain(base)
    n = base.count() if rows is None else rows
    if not n:
        return VectorIndex(np.zeros((0, 1)), cut_lineage(base.withColumn("cell", F.lit(0))), np.zeros(0, np.int64), 0)
    hashed = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    sample = base.where(hashed < int((1 << 40) * min(1.0, sample_rows / n))).select("vec").toArrow()
    if not sample.num_rows:
        sample = base.limit(1).select("vec").toArrow()
    fitted = _matrix(sample)
    cells = min(cells or math.ceil(math.sqrt(n)), MAX_CELLS, len(fitted))
    centroids = fit_centroids(fitted, cells, seed=seed)
    filed = cut_lineage(_in_cells(base, centroids, 1).drop("place"))
    sizes = np.zeros(cells, np.int64)
    for r in filed.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    # the rank, among the cells of a query, of the cell each true neighbour lies in
    asked = filed.where(hashed >= (1 << 40) - int((1 << 40) * min(1.0, tune_queries / n))).select("id", "vec")
    true = knn(asked, filed.select("id", "vec"), k)
    order = _in_cells(asked, centroids, cells).select(F.col("id").alias("query_id"), "cell", "place")
    places = (
        true.join(filed.select(F.col("id").alias("neighbour_id"), "cell"), "neighbour_id").join(order, ["query_id", "cell"])
        .groupBy("place").count().orderBy("place").collect()
    )
    counts = np.zeros(cells)
    for r in places:
        counts[r["place"]] = r["count"]
    reached = np.cumsum(counts) / max(1.0, counts.sum())
    wanted = min(1.0, recall + (1 - recall) / 2)
    probes = int(np.searchsorted(reached, wanted - 1e-12)) + 1 if counts.sum() else cells
    return VectorIndex(centroids, filed, sizes, min(probes, cells))


class _Block:
    """Queries held in memory, which the rows of the base pass in the order of their cells."""

    def __init__(self, k: int, min_sim: float | None, probes: int, centroids: np.ndarray):
        self.k, self.probes, self.centroids = k, probes, centroids
        self.least = np.finfo(np.float64).min if min_sim is None else min_sim
        self.queries: list[pa.RecordBatch] = []
        self.mat: np.ndarray | None = None
        self.names: list[pa.Array] = []
        self.passed = 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: pa.RecordBatch) -> None:
        cells = rows.column("cell").to_numpy()
        asked = int(np.searchsorted(cells, 0))  # queries have cell -1 and come first
        if asked:
            self.queries.append(rows.slice(0, asked))
        if asked == len(cells) or not self.queries:
            return
        if self.mat is None:
            self._ready()
        rows, cells = rows.slice(asked), cells[asked:]
        self.names.append(rows.column("id"))
        base = _matrix(pa.table({"vec": rows.column("vec")}))
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            self._meet(int(cells[lo]), base[lo:hi], self.passed + lo)
        self.passed += len(cells)

    def _ready(self) -> None:
        table = pa.Table.from_batches(self.queries)
        self.ids, self.mat = table.column("id").combine_chunks(), _matrix(table)
        self.queries = [self.queries[0].slice(0, 0)]
        self.bound = np.full(len(self.mat), self.least)
        cells = len(self.centroids)
        # a bit for each cell that a query looks into
        self.bits = None
        if self.probes < cells:
            self.bits = np.zeros((len(self.mat), -(-cells // 8)), np.uint8)
            step = max(1, (1 << 22) // cells)
            for lo in range(0, len(self.mat), step):
                near = self.mat[lo : lo + step].astype(np.float32) @ self.centroids.T
                order = np.argsort(-near, axis=1, kind="stable")[:, : self.probes]
                into = np.zeros(near.shape, bool)
                np.put_along_axis(into, order, True, axis=1)
                self.bits[lo : lo + step] = np.packbits(into, axis=1)

    def _meet(self, cell: int, base: np.ndarray, first: int) -> None:
        """Scores of one cell with the queries that look into it; what cannot be among the k best is dropped."""
        at = np.arange(len(self.mat)) if self.bits is None else np.flatnonzero(self.bits[:, cell >> 3] >> (7 - (cell & 7)) & 1)
        step = max(1, TILE_BYTES // (8 * len(base)))
        for lo in range(0, len(at), step):
            mine = at[lo : lo + step]
            score = self.mat[mine] @ base.T
            np.round(score, SCORE_DIGITS, out=score)
            wanted = score >= self.bound[mine, None]  # not-a-number is not
            if self.k < len(base):
                over = np.flatnonzero(wanted.sum(axis=1) > self.k)
                if len(over):
                    some = np.where(wanted[over], score[over], -np.inf)
                    wanted[over] &= some >= np.partition(some, len(base) - self.k, axis=1)[:, len(base) - self.k, None]
            q, hit = np.nonzero(wanted)
            self.held.append((mine[q].astype(np.int32), (hit + first).astype(np.int64), score[q, hit]))
            self.size += len(q)
        if self.size > max(MERGE_ROWS, 2 * self.k * len(self.mat)):
            self._merge()

    def _merge(self) -> None:
        """The k best so far of each query; of equal scores the lower id, then whichever came first."""
        if not self.held:
            return
        q, row, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        some, where = np.unique(row, return_inverse=True)
        place = np.empty(len(some), np.int64)
        place[pc.sort_indices(pa.chunked_array(self.names, pa.string()).take(pa.array(some)), null_placement="at_start").to_numpy()] = np.arange(len(some))
        best = np.lexsort((place[where], -score, q))
        q = q[best]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        best, q = best[kept], q[kept]
        row, score = row[best], score[best]
        full = np.flatnonzero(np.bincount(q, minlength=len(self.mat)) >= self.k)
        self.bound[full] = score[np.searchsorted(q, full, side="right") - 1]
        self.held, self.size = [(q, row, score)], len(q)

    def hits(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.size:
            (q, row, score), names = self.held[0], pa.chunked_array(self.names, pa.string())
            for lo in range(0, len(q), HIT_ROWS):
                one = slice(lo, lo + HIT_ROWS)
                found = names.take(pa.array(row[one])).combine_chunks()
                found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q[one])), found, pa.array(score[one])], names=["query_id", "neighbour_id", "score"])


def _passing(k: int, min_sim: float | None, probes: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = None, None
        for batch in batches:
            at = batch.column("_at").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if at[lo] != own:
                    if block:
                        yield from block.hits()
                    own, block = at[lo], _Block(k, min_sim, probes, shared.value)
                block.add(batch.slice(lo, hi - lo))
        if block:
            yield from block.hits()

    return run


def search(
    index: VectorIndex, queries: DataFrame, k: int, *, min_sim: float | None = None, probes: int | None = None, block_rows: int = QUERY_ROWS
) -> DataFrame:
    """Rows as of ``knn`` (query_id, neighbour_id, score, rank), from the nearest cells of each query.

    Scores are exact, so a row that is found has its true score; ``probes`` overrides the
    measured number of cells, and the number of all cells gives the exact result. About ``block_rows``
    queries are held by a task, and the base passes them in the order of its cells: a query is moved
    once and a row of the base once for each such task, however many cells are looked into.
    """
    spark = queries.sparkSession
    if not len(index.sizes):
        return spark.createDataFrame([], "query_id string, neighbour_id string, score double, rank int")
    shared = spark.sparkContext.broadcast(index.centroids.astype(np.float32))
    probes = min(index.probes if probes is None else probes, len(index.sizes))
    asked, cores = _plain(queries), spark.sparkContext.defaultParallelism
    n, rows = asked.count(), int(index.sizes.sum())
    # a task keeps k hits of each of its queries
    blocks = max(1, -(-n // max(1, min(block_rows, MERGE_ROWS // k))), min(cores, -(-n // LEAST_ROWS)))
    parts = max(-(-rows // PASS_ROWS), min(-(-cores // blocks), -(-rows // LEAST_ROWS)))
    kind = "array<float>" if {dict(df.dtypes)["vec"] for df in (asked, index.rows)} == {"array<float>"} else "array<double>"
    vec, both = F.col("vec").cast(kind).alias("vec"), lambda block, part: (block * parts + part).cast("int").alias("_at")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    left = asked.select("id", vec, F.lit(-1).alias("cell"), own(blocks).alias("_b"), every(parts).alias("_p"))
    right = index.rows.select("id", vec, "cell", own(parts).alias("_p"), every(blocks).alias("_b"))
    cols = lambda df: df.select(both(F.col("_b"), F.col("_p")), "cell", "id", "vec")
    dealt = cols(left).unionByName(cols(right)).repartitionById(blocks * parts, F.col("_at")).sortWithinPartitions("_at", "cell")
    hits = dealt.mapInArrow(_passing(k, min_sim, probes, shared), "query_id string, neighbour_id string, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbour_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def near_in(index: VectorIndex):
    """A stand-in for ``knn`` over the rows of the index, for operators that take one."""
    return lambda queries, base, k, *, min_sim=None: search(index, queries, k, min_sim=min_sim)


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query_id, recall): part of the true neighbours of each query that were found.

    A neighbour of a score equal to the last true one counts as well, whichever tied id was found.
    """
    worst = true.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(worst, "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("hits"))
    return worst.join(good, "query_id", "left").select("query_id", (F.least(F.coalesce("hits", F.lit(0)), F.col("n")) / F.col("n")).alias("recall"))
