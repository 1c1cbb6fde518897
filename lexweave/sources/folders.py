"""Folders of a shared store, by their names alone: what was finished, and whole partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

#: Rows of a partition that one task writes.
WRITE_ROWS = 500_000


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def parts(spark: SparkSession, folder: str, name: str, *, finished: bool = False) -> dict[str, str]:
    """Value -> path of the folders ``name``=value in ``folder``; with ``finished`` only those a job has completed."""
    path, store = _path(spark, folder)
    if not store.exists(path):
        return {}
    out = {}
    for found in store.listStatus(path):
        own = found.getPath().getName()
        if found.isDirectory() and own.startswith(f"{name}="):
            if not finished or store.exists(spark._jvm.org.apache.hadoop.fs.Path(found.getPath(), "_SUCCESS")):
                out[own[len(name) + 1 :]] = found.getPath().toString()
    return out


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below ``folder`` that match; none is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def upsert_parts(
    new: DataFrame, folder: str, part: str, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> list[str]:
    """Merge ``new`` into the table in ``folder``, a folder per value of ``part``; returns the values touched.

    Only the partitions that ``new`` has rows of are read and written: ``merge`` gets their
    old rows and the new ones. They are staged and put in place when the job commits, so a
    run that fails leaves the old table, and the files of the others keep their names. A
    null ``part`` is a partition like any other. A partition of many rows is dealt over
    tasks that write about WRITE_ROWS each.
    """
    spark = new.sparkSession
    new = cut_lineage(new)
    # one value per partition to be written, each of them a folder
    touched = [r[0] for r in new.select(part).distinct().collect()]
    path, store = _path(spark, folder)
    rows = new
    if touched and store.exists(path):
        here = F.col(part).isin([v for v in touched if v is not None])
        old = spark.read.schema(new.schema).parquet(folder).where(here | F.col(part).isNull() if None in touched else here)
        rows = cut_lineage(merge(old, new))
    if touched:
        salts = -(-rows.count() // WRITE_ROWS)
        salt = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(max(1, salts)))
        dealt = rows.withColumn("_salt", salt).repartition(len(touched) * max(1, salts), part, "_salt").drop("_salt")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)
    return sorted(str(v) for v in touched)


def drop_parts(spark: SparkSession, folder: str, part: str, before: str) -> list[str]:
    """Delete the partitions whose value is less than ``before`` as text, unread; returns their values."""
    gone = {v: p for v, p in parts(spark, folder, part).items() if v < before and v != "__HIVE_DEFAULT_PARTITION__"}
    for found in gone.values():
        path, store = _path(spark, found)
        store.delete(path, True)
    return sorted(gone)
