"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder; a cluster session without one is an error,
    because a folder on one machine does not outlive that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="lexweave-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def clear_written(spark: SparkSession) -> None:
    """Delete what this session has written to its checkpoint folder.

    Frames that still read from there can no longer be computed, so this is for the end
    of a session or between independent jobs.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it back.

    The table survives lost executors, its plan is one scan, and its real size lets
    Catalyst choose a broadcast by itself.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
