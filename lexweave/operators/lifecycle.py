"""Encounters, promotion, tiers, pruning, retention and cascades."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

CONFIRM_AT = 3

# Days each table keeps.
RETENTION_DAYS = {
    "execution_log": 7,
    "quality_gate_log": 30,
    "topic_signals": 30,
    "scans": 14,
    "extractions": 30,
    "trends": 90,
    "cache": 7,
}


def encounter(atoms: DataFrame, sightings: DataFrame, confirm_at: int = CONFIRM_AT) -> DataFrame:
    """Terms after a batch of sightings (atom_id): counts added, and a provisional
    term confirmed when the sum reaches ``confirm_at``."""
    seen = sightings.groupBy(F.col("atom_id").alias("id")).agg(F.count("*").alias("seen"))
    total = F.col("encounter_count") + F.col("seen")
    confirm = (F.col("status") == "provisional") & (total >= confirm_at)
    return (
        atoms.join(seen, "id", "left")
        .withColumn("confirmed_now", F.coalesce(confirm, F.lit(False)))
        .withColumn("encounter_count", F.coalesce(total, F.col("encounter_count")))
        .withColumn("status", F.when(F.col("confirmed_now"), "confirmed").otherwise(F.col("status")))
        .drop("seen")
    )


def gates() -> Column:
    """Classified, embedded, profiled and tagged."""
    return (
        F.col("category_slug").isNotNull()
        & (F.col("category_slug") != "")
        & (F.col("embedding_status") == "complete")
        & F.col("hardness").isNotNull()
        & (F.col("tag_version") > 0)
    )


def promotable(atoms: DataFrame) -> DataFrame:
    return atoms.filter((F.col("status") == "provisional") & gates())


def promote(atoms: DataFrame) -> DataFrame:
    ready = (F.col("status") == "provisional") & gates()
    return atoms.withColumn("status", F.when(ready, "confirmed").otherwise(F.col("status")))


def recalculate_tiers(atoms: DataFrame, edges: DataFrame, exemplars: DataFrame) -> DataFrame:
    """``new_tier`` of confirmed terms: exemplar with edge 1, edge 2, else 3."""
    ends = edges.select(F.explode(F.array("atom_a_id", "atom_b_id")).alias("id")).distinct()
    shown = exemplars.select(F.col("atom_id").alias("id")).distinct()
    flags = (
        atoms.filter(F.col("status") == "confirmed")
        .join(ends.withColumn("_edge", F.lit(True)), "id", "left")
        .join(shown.withColumn("_shown", F.lit(True)), "id", "left")
    )
    tier = F.when(F.col("_edge") & F.col("_shown"), 1).when(F.col("_edge"), 2).otherwise(3)
    return flags.withColumn("new_tier", tier).drop("_edge", "_shown")


def mark_enriched(atoms: DataFrame, as_of: Column) -> DataFrame:
    """Set ``fully_enriched_at`` once every phase is done; an older mark stays."""
    done = gates() & F.col("register").isNotNull() & (F.col("degree") > 0)
    return atoms.withColumn("fully_enriched_at", F.coalesce("fully_enriched_at", F.when(done, as_of)))


def prune_edges(edges: DataFrame, as_of: Column, *, days: int = 90, below: float = 0.5) -> DataFrame:
    """Edges that stay when weak, long unreinforced semantic ones are dropped."""
    drop = (
        (F.col("provenance") == "semantic")
        & (F.col("strength") < below)
        & (F.col("last_reinforced_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    )
    return edges.filter(~F.coalesce(drop, F.lit(False)))


def purge_provenance(edges: DataFrame, provenance: str = "semantic") -> DataFrame:
    return edges.filter(F.col("provenance") != provenance)


def retention(df: DataFrame, table: str, column: str, as_of: Column, days: int | None = None) -> DataFrame:
    """Rows of ``table`` within its day limit. A partition column prunes whole files."""
    keep = RETENTION_DAYS[table] if days is None else days
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {int(keep)} DAYS"))


def purge_sessions(
    conversations: DataFrame,
    messages: DataFrame,
    feedback: DataFrame,
    users: DataFrame,
    as_of: Column,
    days: int = 30,
) -> dict[str, DataFrame]:
    """What stays of each table when stale anonymous conversations are removed.

    Messages and feedback follow their conversation; an anonymous user follows
    when none of their conversations is left.
    """
    anonymous = users.filter("anonymous").select("user_id")
    stale = (
        conversations.filter(F.col("updated_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
        .join(anonymous, "user_id", "left_semi")
        .select("conversation_id", "user_id")
    )
    gone = stale.select("conversation_id")
    kept = conversations.join(gone, "conversation_id", "left_anti")
    lost = stale.select("user_id").distinct().join(kept.select("user_id"), "user_id", "left_anti")
    return {
        "conversations": kept,
        "messages": messages.join(gone, "conversation_id", "left_anti"),
        "feedback": feedback.join(gone, "conversation_id", "left_anti"),
        "users": users.join(lost, "user_id", "left_anti"),
    }


def stale_vectors(atoms: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of rejected terms."""
    return vectors.join(atoms.filter(F.col("status") == "rejected").select("id"), "id", "left_semi")


def collection_tree(collections: DataFrame) -> DataFrame:
    """(slug, path, depth) from the roots down; an unknown parent makes a root.

    One join per level, until a level is empty. A slug is not taken below itself, so a
    repeated slug cannot go round; ``collection_cycles`` names what no root reaches.
    """
    known = collections.select(F.col("slug").alias("parent_slug")).distinct()
    rooted = collections.join(known.withColumn("_known", F.lit(True)), "parent_slug", "left")
    level = rooted.filter(F.col("_known").isNull()).select(
        "slug", F.col("slug").alias("path"), F.lit(0).alias("depth")
    )
    tree = level
    for depth in itertools.count(1):
        above = level.select(F.col("slug").alias("parent_slug"), F.col("path").alias("above"))
        level = cut_lineage(
            collections.join(above, "parent_slug").filter(~F.array_contains(F.split("above", "/"), F.col("slug"))).select(
                "slug", F.concat_ws("/", "above", "slug").alias("path"), F.lit(depth).alias("depth")
            )
        )
        if level.isEmpty():
            break
        tree = tree.unionByName(level)
    return tree


def collection_cycles(collections: DataFrame, tree: DataFrame) -> DataFrame:
    """Collections that no root reaches: those on a cycle of parents, and those below one."""
    return collections.join(tree.select("slug").distinct(), "slug", "left_anti")


def creators(films: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (name, role) with a hashed id, and the links to their films."""
    from lexweave.functions.text import sha_key

    rows = films.select("film_id", F.explode("people").alias("p")).select(
        "film_id", F.trim("p.name").alias("name"), F.col("p.role").alias("role")
    ).filter(F.col("name") != "")
    rows = rows.withColumn("creator_id", sha_key(F.lower("name"), "role"))
    # a task holds distinct rows, not all rows, where minima of texts would be sorted
    people = rows.select("creator_id", "name", "role").distinct().groupBy("creator_id").agg(F.min("name").alias("name"), F.min("role").alias("role"))
    return people, rows.select("film_id", "creator_id").distinct()
