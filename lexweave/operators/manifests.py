"""Filtered subgraphs as manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.maths import DIMENSIONS
from lexweave.functions.sizing import attach_packed, broadcast_if_small
from lexweave.operators.edges import both_directions

# Provenances a manifest carries unless its spec names others.
DEFAULT_PROVENANCES = ["harmonic", "semantic"]
RELATIONS_PER_PART = 1_000

SPEC_SCHEMA = (
    "v int, slug string, name string, description string, "
    "include struct<category_prefixes:array<string>,category_exact:array<string>,"
    "tag_categories:array<string>,tags:array<string>>, "
    "exclude struct<category_prefixes:array<string>,tags:array<string>>, "
    "correspondence_filter struct<internal_only:boolean,provenances:array<string>>"
)


def parse_specs(raw: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid specs, skipped with reasons) of JSON rows (key, raw)."""
    rows = raw.withColumn("s", F.from_json("raw", SPEC_SCHEMA))
    ok = (
        (F.col("s.v") == 1)
        & (F.coalesce("s.slug", F.lit("")) != "")
        & F.col("s.name").isNotNull()
        & F.col("s.description").isNotNull()
        & F.col("s.include.category_prefixes").isNotNull()
    )
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    valid = rows.filter("_ok").select("s.*")
    skipped = rows.filter("NOT _ok").select(F.coalesce("s.slug", "key").alias("slug"), F.lit("invalid spec").alias("reason"))
    if wanted:
        asked = raw.sparkSession.createDataFrame([(w,) for w in wanted], "slug string")
        lost = asked.join(valid.select("slug"), "slug", "left_anti").withColumn("reason", F.lit("spec not found"))
        skipped = skipped.unionByName(lost)
        valid = valid.join(asked, "slug", "left_semi")
    return valid, skipped


def graph_snapshot(
    atoms: DataFrame, atom_tags: DataFrame, memberships: DataFrame, edges: DataFrame, provenances: list[str] | None = None
) -> dict[str, DataFrame]:
    """Nodes with their tags and poles, and relations read from both ends.

    Relations stay rows: a hub may hold a large share of all edges.
    """
    tags = atom_tags.groupBy(F.col("atom_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.struct("slug", "category"))).alias("tags")
    )
    poles = memberships.groupBy(F.col("atom_id").alias("id")).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("axis_slug", "pole")))).alias("poles")
    )
    live = atoms.filter((F.col("status") != "rejected") & F.col("category_slug").isNotNull())
    nodes = (
        live.select(
            "id",
            "text",
            "category_slug",
            F.struct(*[F.coalesce(d, F.lit(0.5)).alias(d) for d in [*DIMENSIONS, "register"]]).alias("h"),
            F.col("hardness").isNotNull().alias("parsed"),
        )
        .join(tags, "id", "left")
        .join(poles, "id", "left")
    )
    kept = edges if provenances is None else edges.filter(F.col("provenance").isin(provenances))
    relations = both_directions(kept.select("atom_a_id", "atom_b_id", "relationship_type", "strength", "provenance"))
    return {"nodes": nodes, "relations": relations}


def _matches(spec: Column) -> Column:
    """Whether a node row belongs to a spec."""
    cat, tags = F.col("category_slug"), F.coalesce("tags", F.array().cast("array<struct<slug:string,category:string>>"))
    some = lambda values, test: F.exists(F.coalesce(values, F.array().cast("array<string>")), test)
    include = spec["include"]
    inside = (
        some(include["category_prefixes"], lambda p: F.startswith(cat, p))
        | some(include["category_exact"], lambda p: cat == p)
        | some(include["tag_categories"], lambda c: F.exists(tags, lambda t: t["category"] == c))
        | some(include["tags"], lambda s: F.exists(tags, lambda t: t["slug"] == s))
    )
    exclude = spec["exclude"]
    outside = some(exclude["category_prefixes"], lambda p: F.startswith(cat, p)) | some(
        exclude["tags"], lambda s: F.exists(tags, lambda t: t["slug"] == s)
    )
    return inside & ~outside


def manifest_atoms(specs: DataFrame, snapshot: dict[str, DataFrame]) -> DataFrame:
    """Nodes of every spec, in one pass over the nodes."""
    packed, _ = attach_packed(snapshot["nodes"], specs.select("slug", "include", "exclude"), "specs")
    hits = F.transform(F.filter("specs", _matches), lambda s: s["slug"])
    return packed.withColumn("slug", F.explode(hits)).drop("specs")


def manifest_relations(specs: DataFrame, atoms: DataFrame, snapshot: dict[str, DataFrame]) -> DataFrame:
    """Relations of every spec: of its provenances, inside the spec by default."""
    default = F.array(*[F.lit(p) for p in DEFAULT_PROVENANCES])
    rules = specs.select(
        "slug",
        F.coalesce("correspondence_filter.internal_only", F.lit(True)).alias("internal_only"),
        F.coalesce("correspondence_filter.provenances", default).alias("provenances"),
    )
    member = atoms.select("slug", "id")
    rows = (
        snapshot["relations"]
        .join(member, "id")
        .join(broadcast_if_small(rules), "slug")
        .filter(F.array_contains("provenances", F.col("provenance")))
        .join(member.select("slug", F.col("id").alias("neighbour_id"), F.lit(True).alias("_in")), ["slug", "neighbour_id"], "left")
    )
    return rows.filter(F.col("_in") | ~F.col("internal_only")).select(
        "slug", "id", "neighbour_id", "relationship_type", "strength", "provenance"
    )


def manifest_stats(atoms: DataFrame, relations: DataFrame) -> DataFrame:
    """Atoms, distinct undirected edges, distinct tags and members per spec."""
    nodes = atoms.groupBy("slug").agg(F.count("*").alias("atom_count"), F.count("poles").alias("membership_count"))
    tags = atoms.select("slug", F.explode("tags.slug").alias("t")).distinct().groupBy("slug").agg(F.count("*").alias("tag_count"))
    pairs = (
        relations.select("slug", F.least("id", "neighbour_id").alias("a"), F.greatest("id", "neighbour_id").alias("b"), "relationship_type")
        .distinct()
        .groupBy("slug")
        .agg(F.count("*").alias("correspondence_count"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(tags, "slug", "left").join(pairs, "slug", "left").select(
        "slug", "atom_count", "membership_count", zero("tag_count"), zero("correspondence_count")
    )


def manifest_entries(atoms: DataFrame, relations: DataFrame, per_part: int = RELATIONS_PER_PART) -> DataFrame:
    """Manifest rows ready to write: a node with its relations in bounded parts.

    The number of parts comes from the degree, so the relations of a hub are
    spread over rows of about ``per_part`` instead of one row.
    """
    degree = relations.groupBy("slug", "id").agg(F.ceil(F.count("*") / per_part).alias("_parts"))
    parts = (
        relations.join(degree, ["slug", "id"])
        .withColumn("part", F.pmod(F.xxhash64("neighbour_id", "relationship_type", "provenance"), F.col("_parts")))
        .groupBy("slug", "id", "part")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("neighbour_id", "relationship_type", "strength", "provenance"))
            ).alias("rel")
        )
    )
    return atoms.join(parts, ["slug", "id"], "left").withColumn("part", F.coalesce("part", F.lit(0)))


def build_all(
    raw_specs: DataFrame,
    atoms: DataFrame,
    atom_tags: DataFrame,
    memberships: DataFrame,
    edges: DataFrame,
    wanted: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Every valid wanted spec over one snapshot: atoms, relations, stats, skipped."""
    specs, skipped = parse_specs(raw_specs, wanted)
    snapshot = graph_snapshot(atoms, atom_tags, memberships, edges)
    nodes = manifest_atoms(specs, snapshot)
    relations = manifest_relations(specs, nodes, snapshot)
    return {"atoms": nodes, "relations": relations, "stats": manifest_stats(nodes, relations), "skipped": skipped}
