"""Bulk edits of the graph: migrate, reject, recategorise, create, merge, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.maths import DIMENSIONS
from lexweave.functions.sizing import tasks_for
from lexweave.functions.text import sha_key, text_key
from lexweave.operators.joins import resolve_edge_names
from lexweave.operators.predicates import AtomFilter, CANDIDATE_SCHEMA
from lexweave.operators.upserts import first_per_key
from lexweave.session import cut_lineage


def running_index(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """Zero-based position of each row within its group, by the unique ``order``.

    A group of any size: rows are range-partitioned by (group, order) and kept in
    the checkpoint folder with their partition number, so that both uses below see
    the same split; then they are numbered inside their partition and shifted by
    the counts of the partitions before, one row per (partition, group).
    """
    spread = cut_lineage(df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(order)
    sizes = spread.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        spread.withColumn("_place", F.row_number().over(inside) - 1)
        .join(before, ["_part", *group])
        .withColumn(name, F.col("_place") + F.col("_before"))
        .drop("_part", "_place", "_before")
    )


def set_metadata(metadata: str, pairs: dict[str, Column]) -> Column:
    """JSON object text with keys added or replaced."""
    old = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(list(pairs)))
    new = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_concat(kept, new))


def migrate_to_chunks(
    atoms: DataFrame, spec: AtomFilter, *, title: str, tags: list[str], dry_run: bool = False
) -> dict[str, DataFrame]:
    """Matching terms become the chunks of one document and are rejected.

    A dry run returns only the counts of what would change.
    """
    hit = spec.column()
    counts = atoms.filter(hit).agg(
        F.count("*").alias("chunks_created"), F.coalesce(F.sum(F.ceil(F.length("text") / 4)), F.lit(0)).alias("token_count")
    )
    if dry_run:
        return {"counts": counts}
    doc = F.sha2(F.lit(title), 256)
    rows = running_index(atoms.filter(hit).select("id", "text", "category_slug", "collection_slug"), [], "id", "chunk_index")
    chunks = rows.select(
        F.concat(F.lit("doc_chunk_"), sha_key(doc, "id")).alias("chunk_id"),
        doc.alias("document_id"),
        "chunk_index",
        F.col("text").alias("content"),
        "category_slug",
        F.to_json(F.struct(F.col("id").alias("source_atom_id"), F.col("collection_slug").alias("source_collection"))).alias("metadata"),
    )
    document = counts.select(
        doc.alias("document_id"), F.lit(title).alias("title"), F.col("chunks_created").alias("chunk_count"), "token_count"
    )
    reason = F.lit(tags[0] if tags else "migrated")
    done = atoms.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    meta = set_metadata("metadata", {"migrated_to_doc": doc, "migration_reason": reason})
    after = done.withColumn("metadata", F.when(F.col("_hit"), meta).otherwise(F.col("metadata"))).withColumn(
        "status", F.when(F.col("_hit"), "rejected").otherwise(F.col("status"))
    ).drop("_hit")
    return {"counts": counts, "document": document, "chunks": chunks, "atoms": after}


def reject_atoms(atoms: DataFrame, spec: AtomFilter, reason: str, *, dry_run: bool = False) -> DataFrame:
    """Matching terms rejected with the reason in their metadata, or their count."""
    hit = F.coalesce(spec.column(), F.lit(False))
    if dry_run:
        return atoms.agg(F.count_if(hit).alias("atoms_rejected"))
    meta = set_metadata("metadata", {"rejection_reason": F.lit(reason)})
    done = atoms.withColumn("_hit", hit)
    return done.withColumn("metadata", F.when(F.col("_hit"), meta).otherwise(F.col("metadata"))).withColumn(
        "status", F.when(F.col("_hit"), "rejected").otherwise(F.col("status"))
    ).drop("_hit")


def recategorize(
    atoms: DataFrame, categories: DataFrame, hit: Column, target: str, *, reset_tags: bool = True
) -> DataFrame:
    """Live terms under ``hit`` moved to ``target``, when that category exists."""
    known = categories.filter(F.col("slug") == target).select(F.lit(True).alias("_known"), F.lit(target).alias("_target"))
    rows = atoms.withColumn("_target", F.when(hit & (F.col("status") != "rejected"), target))
    rows = rows.join(known, "_target", "left")
    moved = F.coalesce(F.col("_known"), F.lit(False))
    return (
        rows.withColumn("recategorized", moved)
        .withColumn("category_slug", F.when(moved, F.col("_target")).otherwise(F.col("category_slug")))
        .withColumn("tag_version", F.when(moved & F.lit(reset_tags), 0).otherwise(F.col("tag_version")))
        .drop("_target", "_known")
    )


def heal_drift(atoms: DataFrame, assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """Outcome per assignment (atom_id, new_category): healed, or why not."""
    known = categories.select(F.col("slug").alias("new_category"), F.lit(True).alias("_known"))
    held = atoms.select(F.col("id").alias("atom_id"), "category_slug")
    rows = assignments.join(known, "new_category", "left").join(held.withColumn("_found", F.lit(True)), "atom_id", "left")
    return rows.select(
        "atom_id",
        "new_category",
        F.when(F.col("_known").isNull(), "invalid_category_slug")
        .when(F.col("_found").isNull(), "atom_not_found")
        .when(F.col("category_slug") == F.col("new_category"), "already_assigned")
        .otherwise("healed")
        .alias("outcome"),
    )


def assign_modality(atoms: DataFrame, categories: DataFrame) -> DataFrame:
    """Modality from the default of the category, where it has one."""
    default = categories.select(F.col("slug").alias("category_slug"), "default_modality")
    return atoms.join(default, "category_slug", "left").withColumn(
        "modality", F.coalesce("default_modality", "modality")
    ).drop("default_modality")


def force_create(rows: DataFrame, atoms: DataFrame, categories: DataFrame, collections: DataFrame) -> DataFrame:
    """Outcome per curator row: created, or why not.

    Overrides outside 0..1 and unknown categories fail first, then repeats within
    the request, then conflicts with stored terms.
    """
    bad = F.lit(False)
    for d in DIMENSIONS:
        bad = bad | F.coalesce(~F.col(d).between(0, 1), F.lit(False))
    known = categories.select(F.col("slug").alias("category_slug"), F.lit(True).alias("_known"))
    out = (
        rows.withColumn("text_lower", text_key("text"))
        .join(known, "category_slug", "left")
        .join(collections.select("category_slug", "collection_slug"), "category_slug", "left")
        .withColumn("collection_slug", F.coalesce("collection_slug", F.lit("uncategorized")))
        .withColumn("_bad", bad)
    )
    usable = out.filter(F.col("_known").isNotNull() & ~F.col("_bad") & (F.col("text_lower") != ""))
    keys = ["text_lower", "collection_slug"]
    first = usable.groupBy(*keys).agg(F.min("row_id").alias("_first"))
    held = atoms.select(*keys).distinct().withColumn("_held", F.lit(True))
    return out.join(first, keys, "left").join(held, keys, "left").select(
        "row_id",
        "text_lower",
        "collection_slug",
        F.when(F.col("text_lower") == "", "empty_text")
        .when(F.col("_bad"), "harmonics_out_of_range")
        .when(F.col("_known").isNull(), "invalid_category_slug")
        .when(F.col("row_id") != F.col("_first"), "duplicate_in_request")
        .when(F.col("_held"), "unique_conflict")
        .otherwise("created")
        .alias("outcome"),
        F.when(F.coalesce(*DIMENSIONS).isNotNull(), "override").otherwise("pending").alias("harmonics_source"),
    )


def valid_merges(merges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Merges (merge_id, canonical_id) of two live terms with the same text."""
    row = atoms.filter(~F.col("status").isin("rejected", "merged")).select("id", "text_lower")
    return (
        merges.filter(F.col("merge_id") != F.col("canonical_id"))
        .join(row.withColumnsRenamed({"id": "merge_id", "text_lower": "_m"}), "merge_id")
        .join(row.withColumnsRenamed({"id": "canonical_id", "text_lower": "_c"}), "canonical_id")
        .filter(F.col("_m") == F.col("_c"))
        .select("merge_id", "canonical_id")
        .distinct()
    )


def merge_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after a merge, with ``moved``: ends point to the kept term, self edges
    leave, and of equal edges the one that was there before stays."""
    a = merges.select(F.col("merge_id").alias("atom_a_id"), F.col("canonical_id").alias("_a"))
    b = merges.select(F.col("merge_id").alias("atom_b_id"), F.col("canonical_id").alias("_b"))
    rows = edges.join(a, "atom_a_id", "left").join(b, "atom_b_id", "left")
    left, right = F.coalesce("_a", "atom_a_id"), F.coalesce("_b", "atom_b_id")
    moved = rows.select(
        F.least(left, right).alias("atom_a_id"),
        F.greatest(left, right).alias("atom_b_id"),
        "relationship_type",
        F.coalesce("arrangement_scope", F.lit("")).alias("arrangement_scope"),
        "strength",
        "provenance",
        (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("moved"),
    ).filter(F.col("atom_a_id") != F.col("atom_b_id"))
    return first_per_key(
        moved,
        ["atom_a_id", "atom_b_id", "relationship_type", "arrangement_scope"],
        [F.col("moved"), -F.col("strength"), F.col("provenance")],
    )


def merge_atoms(atoms: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged terms rejected with a pointer to the kept one, whose tags are reset."""
    gone = merges.select(F.col("merge_id").alias("id"), "canonical_id")
    kept = merges.select(F.col("canonical_id").alias("id")).distinct().withColumn("_kept", F.lit(True))
    rows = atoms.join(gone, "id", "left").join(kept, "id", "left")
    merged = F.col("canonical_id").isNotNull()
    meta = set_metadata("metadata", {"merged_into": F.col("canonical_id"), "merge_reason": F.lit("duplicate")})
    return (
        rows.withColumn("metadata", F.when(merged, meta).otherwise(F.col("metadata")))
        .withColumn("status", F.when(merged, "rejected").otherwise(F.col("status")))
        .withColumn("tag_version", F.when(F.col("_kept"), 0).otherwise(F.col("tag_version")))
        .drop("canonical_id", "_kept")
    )


# Utilities of image terms.
UTILITY = {"directive": "visual", "modifier": "literary", "descriptor": "dual"}


def utility_of(c: str) -> Column:
    out = F.lit("visual")
    for name, value in UTILITY.items():
        out = F.when(F.col(c) == name, value).otherwise(out)
    return out


def review_candidates(
    candidates: DataFrame, actions: DataFrame, atoms: DataFrame, categories: DataFrame
) -> DataFrame:
    """Outcome of each review action (id, action).

    Approved terms count first, so edges of the same batch find them. An edge
    needs both names; a term keeps its category only when that exists. Rows that
    were reviewed before fail.
    """
    tasks = tasks_for(actions, candidates)
    rows = actions.repartition(tasks, "id").join(candidates.repartition(tasks, "id"), "id", "left").withColumn("d", F.from_json("candidate_data", CANDIDATE_SCHEMA))
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    approve = F.col("action") == "approve"
    new_atoms = rows.filter(pending & approve & (F.col("candidate_type") == "atom")).select(
        F.concat(F.lit("candidate:"), "id").alias("id"), text_key("d.name").alias("text_lower")
    )
    pool = atoms.select("id", "text_lower").unionByName(new_atoms)
    cats = categories.select(F.col("slug").alias("_cat"), F.lit(True).alias("_known"))
    rows = rows.withColumns({"_cat": F.col("d.suggested_category"), "source_name": F.col("d.source_name"), "target_name": F.col("d.target_name")})
    rows = resolve_edge_names(rows.join(cats, "_cat", "left"), pool, tasks=tasks)
    edge = F.col("candidate_type") == "correspondence"
    error = (
        F.when(F.col("candidate_type").isNull(), "not_found")
        .when(~pending, "already_reviewed")
        .when(approve & edge & (F.col("resolution") != "resolved"), F.col("resolution"))
    )
    return rows.withColumn("error", error).select(
        "id",
        F.when(F.col("error").isNotNull(), "failed").when(approve, "approved").otherwise("rejected").alias("outcome"),
        "error",
        F.when(F.col("error").isNull() & approve & ~edge & F.col("_known"), F.col("_cat")).alias("category_slug"),
        F.when(F.col("error").isNull() & approve & edge, F.when(F.col("d.strength") >= 0.75, "resonates").otherwise("evokes")).alias(
            "relationship_type"
        ),
    )


def dropped_atoms(aggregates: DataFrame, categories: DataFrame) -> DataFrame:
    """Audit rows of aggregate entries whose category is unknown, once per
    (moodboard_id, atom_name, bucket). ``entries`` is array<(bucket, name, category)>."""
    flat = aggregates.select("moodboard_id", F.explode("entries").alias("e")).select(
        "moodboard_id", F.trim("e.name").alias("atom_name"), F.col("e.bucket").alias("bucket"), F.col("e.category").alias("rejected_slug")
    ).filter(F.col("atom_name") != "")
    known = categories.select(F.col("slug").alias("rejected_slug"))
    lost = flat.filter(F.col("rejected_slug").isNotNull()).join(known, "rejected_slug", "left_anti")
    return first_per_key(lost, ["moodboard_id", "atom_name", "bucket"], [F.col("rejected_slug")])


def bucket_concepts(
    extractions: DataFrame, *, clusters: DataFrame | None = None, invariant: float = 0.66, vector: float = 0.33, low: float = 0.22
) -> DataFrame:
    """Share of sources that name a concept, and its bucket; the rest leaves.

    With ``clusters`` (name, cluster) all names of a cluster count as one concept.
    """
    if clusters is not None:
        same = clusters.select(text_key("name").alias("_name"), "cluster")
        extractions = extractions.join(same, text_key("atom_name") == F.col("_name"), "left").withColumn(
            "atom_name", F.coalesce("cluster", "atom_name")
        )
    total = extractions.groupBy("moodboard_id").agg(F.count_distinct("source_url").alias("sources"))
    named = extractions.groupBy("moodboard_id", text_key("atom_name").alias("atom_name")).agg(
        F.count_distinct("source_url").alias("seen"), F.avg("confidence").alias("mean")
    )
    share = F.round(F.col("seen") / F.col("sources"), 6)
    return (
        named.join(total, "moodboard_id")
        .select(
            "moodboard_id",
            "atom_name",
            share.alias("frequency"),
            F.round(F.round("mean", 9), 4).alias("confidence"),
            F.when(share >= invariant, "invariant").when(share >= vector, "vector").when(share <= low, "low").alias("bucket"),
        )
        .filter(F.col("bucket").isNotNull())
    )


def board_ready(boards: DataFrame, candidates: DataFrame) -> DataFrame:
    """Boards with their sources so far and the status that follows."""
    seen = candidates.filter(F.col("moodboard_id").isNotNull()).groupBy("moodboard_id").agg(
        F.count_distinct("source_url").alias("sources")
    )
    have = F.coalesce("sources", F.lit(0))
    ready = have >= F.col("expected")
    return boards.join(seen, "moodboard_id", "left").select(
        "moodboard_id",
        have.alias("sources"),
        ready.alias("ready"),
        F.when((F.col("status") == "pending") & ready, "extracted")
        .when((F.col("status") == "extracted") & F.col("aggregated"), "aggregated")
        .otherwise(F.col("status"))
        .alias("status"),
    )


def ingest_axis_manifest(
    slugs: DataFrame, atoms: DataFrame, memberships: DataFrame, *, axis: str, pole: str, category: str | None = None
) -> DataFrame:
    """Each listed slug: insert, already, conflict (on the other pole) or missing."""
    wanted = slugs.select(text_key("slug").alias("text_lower")).filter(F.col("text_lower") != "").distinct()
    pool = atoms.filter(F.col("category_slug") == category) if category else atoms
    ids = pool.groupBy("text_lower").agg(F.min("id").alias("atom_id"))
    held = memberships.filter(F.col("axis_slug") == axis).select("atom_id", F.col("pole").alias("current_pole"))
    return wanted.join(ids, "text_lower", "left").join(held, "atom_id", "left").select(
        "text_lower",
        "atom_id",
        F.when(F.col("atom_id").isNull(), "missing")
        .when(F.col("current_pole").isNull(), "insert")
        .when(F.col("current_pole") == pole, "already")
        .otherwise("conflict")
        .alias("outcome"),
    )
