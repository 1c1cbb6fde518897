"""Names that mean the same, as connected components over nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.vectors import knn
from lexweave.session import cut_lineage


def least_label(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(node, root): the least node each node of ``edges`` (u, v) is connected with.

    Every round a node takes the least label of its neighbours, then the label that this
    label itself has, so chains halve. Labels are combined in the map tasks before they
    meet, so a hub is a row per task, never a list. A round is a written table; the rounds
    end when no label has changed.
    """
    both = cut_lineage(
        edges.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v").distinct()
    )
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("least"))
        taken = labels.join(near, "node").select("node", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        taken = cut_lineage(taken)
        above = taken.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        moved = cut_lineage(taken.join(above, "root", "left").select("node", F.least("root", F.coalesce("higher", "root")).alias("root"), "old"))
        labels = moved.select("node", "root")
        if not moved.where("root <> old").take(1):
            return labels
    raise RuntimeError(f"labels have not settled in {max_rounds} rounds")


def name_clusters(vectors: DataFrame, *, min_sim: float, k: int = 10, near: Callable[..., DataFrame] = knn) -> DataFrame:
    """(name, cluster) of the names of ``vectors`` (id, vec) that are linked to others.

    A name is linked to those of its ``k`` nearest that are at least ``min_sim`` alike;
    linked names are a cluster, called by its least name. ``near`` may look into an index.
    """
    links = near(vectors, vectors, k, min_sim=min_sim)
    found = least_label(links.select(F.col("query_id").alias("u"), F.col("neighbour_id").alias("v")))
    return found.select(F.col("node").alias("name"), F.col("root").alias("cluster"))
