"""Pairing a large table with a reference table without a cartesian product.

The reference table is packed into array chunks of at most ``chunk_rows`` rows.
One chunk is broadcast after its size was checked; more chunks are joined on
(chunk, salt), so no key holds more than 1/salts of the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 2_000
SALTS = 64
#: Rows, about, of a task where the tasks grow in number with a table.
TASK_ROWS = 250_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a side proven small; otherwise Catalyst and AQE choose.

    The bound is in bytes: texts and nested values count as long as they are, other
    values sixteen each. No more rows are read than the bound could hold.
    """
    width = F.lit(16)
    for name, kind in df.dtypes:
        long = kind in ("string", "binary") or "<" in kind
        value = F.col(f"`{name}`").cast("string")
        width = width + (F.coalesce(F.octet_length(value), F.lit(0)) if long else F.lit(16))
    most = max_bytes // 16
    size = df.limit(most + 1).agg(F.sum(width).alias("bytes"), F.count("*").alias("n")).first()
    return F.broadcast(df) if size.n <= most and (size.bytes or 0) <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores: a short table lies in a file or two, and each row of it may be much work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def tasks_for(*tables: DataFrame) -> int:
    """Tasks of about TASK_ROWS rows that the tables need together, the session's number of them at least."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(t.count() for t in tables) // TASK_ROWS))


def attach_packed(
    large: DataFrame,
    small: DataFrame,
    name: str,
    *,
    chunk_rows: int = CHUNK_ROWS,
    salts: int = SALTS,
) -> tuple[DataFrame, bool]:
    """Add to every row of ``large`` an array ``name`` of structs of ``small``.

    Returns the frame and whether it is single-chunk. With several chunks each
    row of ``large`` appears once per chunk and the caller merges the parts.
    """
    packed_cols = F.struct(*[F.col(c) for c in small.columns])
    if fits(small, chunk_rows):
        one = small.agg(F.collect_list(packed_cols).alias(name)).withColumn("_chunk", F.lit(0))
        joined = large.withColumn("_chunk", F.lit(0)).join(F.broadcast(one), "_chunk")
        return joined.drop("_chunk"), True
    chunks = -(-small.count() // chunk_rows)
    packed = (
        small.withColumn("_chunk", F.pmod(F.xxhash64(*small.columns), F.lit(chunks)).cast("int"))
        .groupBy("_chunk")
        .agg(F.collect_list(packed_cols).alias(name))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    spread = large.withColumn(
        "_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")
    ).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    joined = spread.join(packed, ["_chunk", "_salt"], "left").withColumn(
        name, F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType))
    )
    return joined.drop("_chunk", "_salt"), False

