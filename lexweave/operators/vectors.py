"""Exact nearest neighbours by cosine, and the joins that follow them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

BLOCK_ROWS = 20_000
LEAST_ROWS = 1_000
SCORE_DIGITS = 6
#: Bytes of vectors sent to the tasks at a time, how often for one pass over the queries, and most passes.
SENT_BYTES = 32 << 20
SENT_PIECES = 4
SENT_PASSES = 8
#: Bytes of scores that a task works out at a time.
TILE_BYTES = 4 << 20


def _matrix(table: pa.Table) -> np.ndarray:
    """Row-normalised matrix of the ``vec`` column; zero rows stay zero."""
    col = table.column("vec").combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    mat = flat.reshape(len(col), -1)
    # row by row in place: one matrix is held, not three
    step = max(1, TILE_BYTES // (8 * max(1, mat.shape[1])))
    for start in range(0, len(mat), step):
        tile = mat[start : start + step]
        norm = np.sqrt((tile * tile).sum(axis=1, keepdims=True))
        np.divide(tile, norm, out=tile, where=norm > 0)
    return mat


def _block_topk(k: int, min_sim: float | None, same_part: bool):
    """Top k base rows of one block for every query row of one block."""

    out_schema = pa.schema(
        [("query_id", pa.string()), ("neighbour_id", pa.string()), ("score", pa.float64())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out_schema.empty_table()
        # ids stay in Arrow: a text of Python for each of them takes several times as much
        order = pc.sort_indices(right.column("id"))
        right = right.take(order)
        base, query = _matrix(right), _matrix(left)
        n = len(base)
        if same_part:
            both = pa.chunked_array([*left.column("part").chunks, *right.column("part").chunks]).combine_chunks()
            codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            q_part, b_part = codes[: len(query)], codes[len(query) :]
        take = min(k, n)
        least = np.finfo(np.float64).min if min_sim is None else min_sim
        rows_q, rows_b, rows_s = [], [], []
        step = max(1, TILE_BYTES // (8 * n))
        for start in range(0, len(query), step):
            score = query[start : start + step] @ base.T
            np.round(score, SCORE_DIGITS, out=score)
            score[np.isnan(score)] = -np.inf
            if same_part:
                score[q_part[start : start + step, None] != b_part[None, :]] = -np.inf
            # the k best of a row and whatever equals the last of them
            wanted = score >= least
            if take < n:
                wanted &= score >= np.partition(score, n - take, axis=1)[:, n - take, None]
            at, hit = np.nonzero(wanted)
            value = score[at, hit]
            # base ids are ascending, so a stable sort breaks ties by id
            best = np.lexsort((-value, at))
            at, hit, value = at[best], hit[best], value[best]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            kept = place < take
            rows_q.append((at[kept] + start).astype(np.int32))
            rows_b.append(hit[kept].astype(np.int32))
            rows_s.append(value[kept])
        ids = lambda table, rows: table.column("id").take(pa.array(np.concatenate(rows)))
        return pa.table([ids(left, rows_q), ids(right, rows_b), pa.array(np.concatenate(rows_s), pa.float64())], schema=out_schema)

    return run


def _sides(rows: DataFrame) -> int:
    """Blocks of a side that busy every core with the pairs of two."""
    return math.ceil(math.sqrt(rows.sparkSession.sparkContext.defaultParallelism))


def blocks_of(rows: DataFrame, block_rows: int) -> int:
    """Even blocks of at most about ``block_rows`` rows, and of ``LEAST_ROWS`` at least where that busies more tasks."""
    n = rows.count()
    return max(1, math.ceil(n / block_rows), min(_sides(rows), math.ceil(n / LEAST_ROWS)))


def _bucket_blocks(queries: DataFrame, base: DataFrame, part: Column, block_rows: int) -> tuple[Column, DataFrame]:
    """The bucket of a part, and (_bucket, _q_blocks, _b_blocks) of the buckets that both sides have rows in.

    There are as many buckets as blocks of the base, so a part is met by few others.
    """
    bucket = F.pmod(F.xxhash64(part), F.lit(blocks_of(base, block_rows))).cast("int")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        more = F.least(F.lit(_sides(df)), F.ceil(n / LEAST_ROWS).cast("int"))
        return df.groupBy(bucket.alias("_bucket")).agg(F.greatest(F.ceil(n / block_rows).cast("int"), more).alias(name))

    return bucket, cut_lineage(blocks(queries, "_q_blocks").join(blocks(base, "_b_blocks"), "_bucket"))


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    min_sim: float | None = None,
    part_col: str | None = None,
    base_filter: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top ``k`` of ``base`` for every row of ``queries`` (columns id, vec).

    Both sides are hashed into blocks of about ``block_rows`` rows. One task
    multiplies one query block with one base block and keeps only k rows per
    query, so the n x m pairs never exist as rows. Hash blocks stay even however
    the vectors cluster. ``part_col`` limits neighbours to the same value
    (a namespace or category); a null part has no neighbours, and blocks are made
    within buckets of parts, so that other parts are hardly met. Scores are rounded to 6
    digits and ties go to the lower id. Result: query_id, neighbour_id, score, rank.
    """
    if base_filter is not None:
        base = base.filter(base_filter)
    part = F.col(part_col).cast("string") if part_col else F.lit("")
    # floats are moved as they are and widened in the tasks
    kept = F.col("vec").cast("array<float>") if {dict(df.dtypes)["vec"] for df in (queries, base)} == {"array<float>"} else F.col("vec").cast("array<double>")
    if part_col:
        base = base.filter(F.col(part_col).isNotNull())
        queries = queries.filter(F.col(part_col).isNotNull())
        bucket, sizes = _bucket_blocks(queries, base, part, block_rows)
    else:
        bucket = F.lit(0)
        q_blocks, b_blocks = blocks_of(queries, block_rows), blocks_of(base, block_rows)
    own = ["_bucket", "_qb", "_bb"]

    def side(df: DataFrame, block: str, other: str) -> DataFrame:
        cols = df.select(F.col("id").cast("string").alias("id"), kept.alias("vec"), part.alias("part"), bucket.alias("_bucket"))
        if part_col:
            # one row per bucket, of which there are as many as blocks
            cols = cols.join(F.broadcast(sizes), "_bucket")
        else:
            cols = cols.withColumns({"_q_blocks": F.lit(q_blocks), "_b_blocks": F.lit(b_blocks)})
        blocks = {"_qb": F.col("_q_blocks"), "_bb": F.col("_b_blocks")}
        cols = cols.withColumn(block, F.pmod(F.xxhash64("id"), blocks[block]).cast("int"))
        cols = cols.withColumn(other, F.explode(F.sequence(F.lit(0), blocks[other] - 1)))
        return cols.select("id", "vec", "part", *own)

    left, right = side(queries, "_qb", "_bb"), side(base, "_bb", "_qb")
    hits = (
        left.groupBy(*own)
        .cogroup(right.groupBy(*own))
        .applyInArrow(
            _block_topk(k, min_sim, part_col is not None),
            "query_id string, neighbour_id string, score double",
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbour_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_sent(queries: DataFrame, base: DataFrame, k: int, *, min_sim: float | None = None, base_filter: Column | None = None) -> DataFrame:
    """Rows as of ``knn`` for many queries and a smaller base: the base is sent to the tasks, queries stay where they are.

    It is sent in pieces of about SENT_BYTES, SENT_PIECES of them in one pass over the queries. A base
    of more than SENT_PASSES passes is left to ``knn``.
    """
    if base_filter is not None:
        base = base.filter(base_filter)
    kind = "array<float>" if dict(base.dtypes)["vec"] == "array<float>" else "array<double>"
    base = base.select(F.col("id").cast("string").alias("id"), F.col("vec").cast(kind).alias("vec"))
    size = base.agg(F.sum(F.size("vec").cast("long")).alias("values")).first()["values"] or 0
    pieces = max(1, -(-size * (4 if kind == "array<float>" else 8) // SENT_BYTES))
    if pieces > SENT_PIECES * SENT_PASSES:
        return knn(queries, base, k, min_sim=min_sim)
    asked = queries.select(F.col("id").cast("string").alias("id"), "vec")
    sc = queries.sparkSession.sparkContext
    hits = []
    for begin in range(0, pieces, SENT_PIECES):
        some = range(begin, min(pieces, begin + SENT_PIECES))
        sent = [sc.broadcast(base.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == p).toArrow()) for p in some]
        hits.append(asked.mapInArrow(_meeting(sent, k, min_sim), "query_id string, neighbour_id string, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbour_id"))
    return reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _meeting(sent: list, k: int, min_sim: float | None):
    top = _block_topk(k, min_sim, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met() -> Iterator[pa.RecordBatch]:
            left = pa.Table.from_batches(held)
            for piece in sent:
                yield from top(left, piece.value).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield from met()
                held = []
        if held:
            yield from met()

    return run


def is_chunk_id(col: str | Column, prefix: str = "doc_chunk_") -> Column:
    """Chunk vectors share the index with terms under an id prefix."""
    return (F.col(col) if isinstance(col, str) else col).startswith(prefix)


def hydrate(matches: DataFrame, atoms: DataFrame, *, drop_status: str = "rejected") -> DataFrame:
    """Vector hits joined to their rows; rejected rows leave, score order stays."""
    keep = atoms.filter(F.col("status") != drop_status).withColumnRenamed("id", "neighbour_id")
    return matches.join(keep, "neighbour_id").orderBy(
        "query_id", F.desc("score"), F.asc("neighbour_id")
    )


def semantic_search(
    queries: DataFrame,
    vectors: DataFrame,
    atoms: DataFrame,
    *,
    k: int = 20,
    categories: list[str] | None = None,
    min_sim: float | None = None,
    chunk_prefix: str = "doc_chunk_",
) -> DataFrame:
    """Batch search: nearest terms per query, then rows, then the category list."""
    hits = knn(
        queries, vectors, k, min_sim=min_sim, base_filter=~is_chunk_id("id", chunk_prefix)
    )
    found = hydrate(hits, atoms)
    return found.filter(F.col("category_slug").isin(categories)) if categories else found


def redundancy(
    new_vectors: DataFrame, vectors: DataFrame, threshold: float = 0.92
) -> DataFrame:
    """The nearest known vector of a new term, when it is closer than ``threshold``.

    Two neighbours are read so that a term already in the index does not report
    itself.
    """
    near = (
        knn(new_vectors, vectors, 2)
        .filter(F.col("query_id") != F.col("neighbour_id"))
        .groupBy("query_id")
        .agg(
            F.max_by("neighbour_id", F.struct("score", -F.col("rank"))).alias("similar_id"),
            F.max("score").alias("similarity"),
        )
    )
    return near.filter(F.col("similarity") > threshold).withColumnRenamed("query_id", "id")
