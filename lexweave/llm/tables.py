"""Shared helpers of the training-data operators: columns, keys and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut_lineage


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text of a row; a null text counts as an empty one."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def row_key(id_col: Column, text: Column) -> Column:
    """A key of (id, text) that is never null; only rows repeated in both share it."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("~")), F.lit("\u0001"), text))


def small_enough(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side of at most ``max_rows`` rows, else the side as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (node, root), root the smallest id.

    Large-star and small-star rounds alternate until nothing changes. Each round takes
    the smallest neighbour with an aggregate that combines in the map tasks and joins it
    back, so a hub is a splittable join key and never a collected list. Rounds are
    written to the shared checkpoint folder. Raises if ``max_rounds`` do not suffice.
    """
    current = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark == (now.n, now.s):
            break
        mark = (now.n, now.s)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
