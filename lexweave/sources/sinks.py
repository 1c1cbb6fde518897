"""Writers: manifests with a sidecar, dated layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_manifest(entries: DataFrame, stats: DataFrame, path: str) -> None:
    """Manifest entries as gzip JSON, a folder per slug, and one stats row per slug
    beside them. Every task writes its own part; nothing passes the driver."""
    entries.write.mode("overwrite").partitionBy("slug").json(f"{path}/entries", compression="gzip")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def write_partitioned(df: DataFrame, path: str, kind: str, date: str = "date") -> str:
    """Append ``df`` under ``kind`` with a folder per date.

    Rows are spread by (date, hash) first, so one busy date is written by several
    tasks and a quiet one by few.
    """
    target = f"{path}/{kind}"
    spread = df.withColumn("_spread", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    rows = spread.repartition(F.col(date), F.col("_spread")).drop("_spread")
    rows.write.mode("append").partitionBy(date).parquet(target)
    return target
