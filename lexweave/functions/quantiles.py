"""Exact quantiles without a buffer of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketch of the first pass, as one part in so many of the rows.
ACCURACY = 2_000


def exact_median(rows: DataFrame, keys: list[str], value: str, *, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, median): the median of the values that are not null, in two passes.

    A mergeable sketch gives a range that the middle must lie in; the second pass counts
    what is below it and sorts only the distinct values inside, about 8 / ``accuracy`` of
    the rows. Equal values are one row with a count, so a value that fills a third of the
    table does no harm. Of an even number the two middle values are averaged.
    """
    named = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    step = 2.0 / accuracy
    bounds = named.groupBy(*keys).agg(
        F.percentile_approx("_v", [0.5 - step, 0.5 + step], accuracy).alias("_b"), F.count("*").alias("_n")
    )
    bounds = bounds.select(*keys, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"), "_n")
    joined = named.join(F.broadcast(bounds), keys) if keys else named.withColumn("_k", F.lit(1)).join(F.broadcast(bounds.withColumn("_k", F.lit(1))), "_k")
    # everything below the range is one group, everything above leaves
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counted = joined.where(F.col("_v") <= F.col("_hi")).groupBy(*keys, "_n", inside.alias("_v")).agg(F.count("*").alias("_c"))
    window = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    upto = counted.withColumn("_upto", F.sum("_c").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = [(F.col("_upto") >= at) & (F.col("_upto") - F.col("_c") < at) for at in (low, high)]
    out = upto.groupBy(*keys).agg(*[F.max(F.when(h, F.col("_v"))).alias(f"_m{i}") for i, h in enumerate(holds)])
    return out.select(*keys, ((F.col("_m0") + F.col("_m1")) / 2).alias("median"))
