"""Edge building: capped semantic edges, degrees, neighbours, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.vectors import is_chunk_id, knn

# Thresholds and caps of edge discovery.
NEIGHBOURS = 50
CROSS_THRESHOLD = 0.65
INTRA_THRESHOLD = 0.75
CROSS_CAP = 10
INTRA_CAP = 5
RESONATES_FROM = 0.75
EDGE_KEY = ["atom_a_id", "atom_b_id", "relationship_type", "arrangement_scope"]


def capped_neighbours(
    pairs: DataFrame, cross_cap: int = CROSS_CAP, intra_cap: int = INTRA_CAP
) -> DataFrame:
    """Keep the best neighbours per (query_id, same_category), each with its cap."""
    best = Window.partitionBy("query_id", "same_category").orderBy(
        F.desc("score"), F.asc("neighbour_id")
    )
    cap = F.when(F.col("same_category"), intra_cap).otherwise(cross_cap)
    # the literal limit lets Spark cut each group before the shuffle
    placed = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= max(cross_cap, intra_cap))
    return placed.filter(F.col("place") <= cap)


def ordered_pair(left: str, right: str) -> list[Column]:
    """Endpoints of an undirected edge in text order."""
    return [
        F.least(left, right).alias("atom_a_id"),
        F.greatest(left, right).alias("atom_b_id"),
    ]


def semantic_edges(
    vectors: DataFrame,
    atoms: DataFrame | None = None,
    *,
    k: int = NEIGHBOURS,
    cross: float = CROSS_THRESHOLD,
    intra: float = INTRA_THRESHOLD,
    cross_cap: int = CROSS_CAP,
    intra_cap: int = INTRA_CAP,
    resonates_from: float = RESONATES_FROM,
    near: Callable[..., DataFrame] = knn,
) -> DataFrame:
    """Semantic edges of ``vectors`` (id, vec, category_slug), one per pair and type.

    The top ``k`` of each vector is cut by threshold and cap, separately for
    neighbours of the same and of another category. ``atoms`` drops stale ids.
    ``near`` may be ``vector_index.near_in(index)`` where exact neighbours cost too much.
    """
    cats = vectors.select("id", "category_slug")
    hits = (
        near(vectors, vectors, k, min_sim=min(cross, intra))
        .filter(F.col("query_id") != F.col("neighbour_id"))
        .join(cats.select(F.col("id").alias("query_id"), F.col("category_slug").alias("q_cat")), "query_id")
        .join(
            cats.filter(F.col("category_slug").isNotNull()).select(
                F.col("id").alias("neighbour_id"), F.col("category_slug").alias("n_cat")
            ),
            "neighbour_id",
        )
        .withColumn("same_category", F.coalesce(F.col("q_cat") == F.col("n_cat"), F.lit(False)))
        .filter(F.col("score") >= F.when(F.col("same_category"), intra).otherwise(cross))
    )
    edges = (
        capped_neighbours(hits, cross_cap, intra_cap)
        .select(
            *ordered_pair("query_id", "neighbour_id"),
            F.when(F.col("score") >= resonates_from, "resonates")
            .otherwise("evokes")
            .alias("relationship_type"),
            F.round("score", 3).alias("strength"),
            F.when(F.col("same_category"), "intra_category")
            .otherwise("cross_category")
            .alias("scope"),
        )
        .groupBy("atom_a_id", "atom_b_id", "relationship_type")
        .agg(F.max("strength").alias("strength"), F.max("scope").alias("scope"))
    )
    return keep_known(edges, atoms) if atoms is not None else edges


def keep_known(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges whose both endpoints are rows of ``atoms``."""
    ids = atoms.select("id")
    return edges.join(ids, edges.atom_a_id == ids.id, "left_semi").join(
        ids, edges.atom_b_id == ids.id, "left_semi"
    )


def upsert_max(target: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Merge edges on their key: the higher strength stays, and every key of the
    new batch counts as reinforced at ``as_of``. The first provenance stays."""
    old = target.select(
        *EDGE_KEY, "strength", "provenance", "last_reinforced_at", F.lit(0).alias("_new")
    )
    fresh = new.select(
        *EDGE_KEY, "strength", "provenance", as_of.alias("last_reinforced_at"), F.lit(1).alias("_new")
    )
    return (
        old.unionByName(fresh)
        .groupBy(*EDGE_KEY)
        .agg(
            F.max("strength").alias("strength"),
            F.min_by("provenance", F.struct("_new", "provenance")).alias("provenance"),
            F.max_by("last_reinforced_at", F.struct("_new", "last_reinforced_at")).alias(
                "last_reinforced_at"
            ),
        )
    )


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids seen at either end."""
    return edges.select(F.explode(F.array("atom_a_id", "atom_b_id")).alias("id")).distinct()


def edge_degree(edges: DataFrame, provenance: str | None = "semantic") -> DataFrame:
    """Number of edges per endpoint; partial counts are combined before the shuffle."""
    if provenance is not None:
        edges = edges.filter(F.col("provenance") == provenance)
    return (
        edges.select(F.explode(F.array("atom_a_id", "atom_b_id")).alias("id"))
        .groupBy("id")
        .agg(F.count("*").alias("degree"))
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge once from each end, as (id, neighbour_id, ...)."""
    rest = [c for c in edges.columns if c not in ("atom_a_id", "atom_b_id")]
    ends = F.explode(
        F.array(
            F.struct(F.col("atom_a_id").alias("id"), F.col("atom_b_id").alias("neighbour_id")),
            F.struct(F.col("atom_b_id").alias("id"), F.col("atom_a_id").alias("neighbour_id")),
        )
    )
    return edges.select(ends.alias("e"), *rest).select("e.id", "e.neighbour_id", *rest)


def edge_neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours on either end, with the text of the neighbour."""
    text = nodes.select(F.col("id").alias("neighbour_id"), F.col("text").alias("neighbour_text"))
    return both_directions(edges).join(text, "neighbour_id")


def isolated_edges(
    vectors: DataFrame,
    degree: DataFrame,
    *,
    k: int = 8,
    min_sim: float = 0.8,
    min_edges: int = 3,
    chunk_prefix: str = "doc_chunk_",
) -> DataFrame:
    """``resonates`` edges for terms with fewer than ``min_edges`` semantic edges."""
    lonely = vectors.join(
        degree.filter(F.col("degree") >= min_edges).select("id"), "id", "left_anti"
    )
    return (
        knn(lonely, vectors, k, min_sim=min_sim)
        .filter((F.col("query_id") != F.col("neighbour_id")) & ~is_chunk_id("neighbour_id", chunk_prefix))
        .select(*ordered_pair("query_id", "neighbour_id"), "score")
        .groupBy("atom_a_id", "atom_b_id")
        .agg(F.max("score").alias("strength"))
        .withColumn("relationship_type", F.lit("resonates"))
        .withColumn("id", F.concat_ws(":", F.lit("con"), "atom_a_id", "atom_b_id"))
    )
