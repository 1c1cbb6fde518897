"""Edge counts per term, kept up to date by signed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.folders import parts


def signed_changes(changes: DataFrame, provenance: str = "semantic") -> DataFrame:
    """(id, n): how a batch of edge changes moves the counts of both ends.

    ``changes``: op (insert, delete or update), atom_a_id, atom_b_id, provenance,
    old_provenance. Only edges of ``provenance`` count, so an update counts when it moves an
    edge in or out of it. Sums are made in the map tasks, so a hub is a row per task.
    """

    def counts(c: str) -> Column:
        return F.coalesce((F.col(c) == provenance).cast("int"), F.lit(0))

    step = (
        F.when(F.col("op") == "insert", counts("provenance")).when(F.col("op") == "delete", -counts("provenance"))
        .otherwise(counts("provenance") - counts("old_provenance"))
    )
    ends = changes.select(step.alias("n"), F.explode(F.array("atom_a_id", "atom_b_id")).alias("id")).filter(F.col("n") != 0)
    return ends.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


class EdgeCounter:
    """Counts in ``folder``: folded ones, and the batches that came after.

    Batches are numbered; one that runs again replaces itself, or does nothing if it is
    folded already. Folding writes a new table and is in force once that is complete.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _upto(self) -> int:
        return max((int(v) for v in parts(self.spark, f"{self.folder}/folded", "upto", finished=True)), default=-1)

    def apply(self, batch: int, changes: DataFrame, provenance: str = "semantic") -> None:
        if batch > self._upto():
            signed_changes(changes, provenance).write.mode("overwrite").parquet(f"{self.folder}/steps/batch={batch}")

    def _sums(self, upto: int | None = None) -> DataFrame:
        base = self._upto()
        rows = self.spark.createDataFrame([], "id string, n long")
        if base >= 0:
            rows = rows.union(self.spark.read.schema("id string, n long").parquet(f"{self.folder}/folded/upto={base}"))
        later = [p for v, p in parts(self.spark, f"{self.folder}/steps", "batch", finished=True).items() if int(v) > base and (upto is None or int(v) <= upto)]
        if later:
            rows = rows.union(self.spark.read.schema("id string, n long").parquet(*later))
        return rows.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)

    def fold(self, upto: int) -> None:
        """Fold all batches up to ``upto`` into one table."""
        if upto > self._upto():
            self._sums(upto).write.mode("overwrite").parquet(f"{self.folder}/folded/upto={upto}")

    def degrees(self) -> DataFrame:
        """(id, degree) as ``edge_degree`` would count them now."""
        return self._sums().select("id", F.col("n").alias("degree"))
