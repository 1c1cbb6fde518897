"""Look-ups between terms, edges, categories, profiles and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import head, text_key
from lexweave.operators.edges import both_directions


def lookup_exact(
    terms: DataFrame,
    atoms: DataFrame,
    *,
    text: str = "term",
    prefer_collection: str | None = None,
    confirmed_only: bool = False,
) -> DataFrame:
    """Each term with the id of its match, or null.

    The best row per text is chosen on the term table first (preferred
    collection, then lowest id), so a frequent text never multiplies rows.
    """
    rows = atoms.filter(F.col("status") == "confirmed") if confirmed_only else atoms
    preferred = F.lit(0) if prefer_collection is None else F.when(
        F.col("collection_slug") == prefer_collection, 0
    ).otherwise(1)
    best = rows.groupBy("text_lower").agg(F.min_by("id", F.struct(preferred, F.col("id"))).alias("atom_id"))
    return (
        terms.withColumn("text_lower", text_key(text)).join(best, "text_lower", "left")
    )


def existing_terms(terms: DataFrame, atoms: DataFrame, text: str = "term") -> tuple[DataFrame, DataFrame]:
    """(known, new) split of a term list by lower-case text."""
    keyed = terms.withColumn("text_lower", text_key(text))
    known = atoms.select("text_lower").distinct()
    return keyed.join(known, "text_lower", "left_semi"), keyed.join(known, "text_lower", "left_anti")


def orphan_edges(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges with a missing endpoint. Each end is an anti join; an edge with both
    ends missing is reported once."""
    ids = atoms.select("id")
    left = edges.join(ids, edges.atom_a_id == ids.id, "left_anti")
    right = edges.join(ids, edges.atom_a_id == ids.id, "left_semi").join(
        ids, edges.atom_b_id == ids.id, "left_anti"
    )
    return left.unionByName(right)


def ungraphed_atoms(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Embedded live terms without any edge."""
    ends = edges.select(F.explode(F.array("atom_a_id", "atom_b_id")).alias("id"))
    return atoms.filter(
        (F.col("embedding_status") == "complete") & (F.col("status") != "rejected")
    ).join(ends, "id", "left_anti")


def dangling_reference(df: DataFrame, column: str, target: DataFrame, key: str = "slug") -> DataFrame:
    """Rows whose non-empty ``column`` names no row of ``target``."""
    named = df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return named.join(target.select(F.col(key).alias(column)), column, "left_anti")


def empty_categories(categories: DataFrame, atoms: DataFrame) -> DataFrame:
    used = atoms.select(F.col("category_slug").alias("slug"))
    return categories.join(used, "slug", "left_anti")


def arrangement_missing_category(arrangements: DataFrame, categories: DataFrame) -> DataFrame:
    """(slug, category_slug) of profile weights that name no category."""
    keys = arrangements.select("slug", F.explode(F.map_keys("category_weights")).alias("category_slug"))
    return dangling_reference(keys, "category_slug", categories)


def routing_for_app(routing: DataFrame, atoms: DataFrame, app: str) -> DataFrame:
    return (
        routing.filter(F.col("app") == app)
        .join(atoms.select(F.col("id").alias("atom_id"), "text", "category_slug"), "atom_id")
        .orderBy("routing", "text", "atom_id")
    )


def related_atoms(
    relations: DataFrame,
    atoms: DataFrame,
    ids: DataFrame,
    relation_type: str,
    *,
    context: str | None = None,
    k: int | None = None,
) -> DataFrame:
    """Partners of ``ids`` over one relation type, read from both ends.

    A relation without a context always counts; one with a context only when it
    equals ``context``. Strongest first, then most confident.
    """
    fits = F.col("context").isNull()
    if context is not None:
        fits = fits | (F.col("context") == context)
    rows = relations.filter((F.col("relation_type") == relation_type) & fits)
    ends = both_directions(
        rows.withColumnsRenamed({"source_atom_id": "atom_a_id", "target_atom_id": "atom_b_id"})
    ).withColumnsRenamed({"id": "atom_id", "neighbour_id": "partner_id"})
    text = atoms.select(F.col("id").alias("partner_id"), F.col("text").alias("partner_text"))
    out = ends.join(ids.select(F.col("id").alias("atom_id")), "atom_id", "left_semi").join(text, "partner_id")
    if k is None:
        return out
    order = Window.partitionBy("atom_id").orderBy(
        F.desc("strength"), F.desc("confidence"), "partner_id", F.coalesce("context", F.lit(""))
    )
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def compositional_partners(relations, atoms, ids, *, context=None, k: int = 10) -> DataFrame:
    """Terms that combine well with each id."""
    return related_atoms(relations, atoms, ids, "compositional", context=context, k=k)


def oppositional_atoms(relations, atoms, ids, *, context=None) -> DataFrame:
    """Terms that conflict with each id."""
    return related_atoms(relations, atoms, ids, "oppositional", context=context)


# Order of severities.
SEVERITY_RANK = {"breaking": 0, "warning": 1}


def severity_rank(c: str | Column) -> Column:
    out = F.lit(2)
    for name, place in SEVERITY_RANK.items():
        out = F.when((F.col(c) if isinstance(c, str) else c) == name, place).otherwise(out)
    return out


def provider_warnings(picks: DataFrame, behaviours: DataFrame, provider: str, mode: str | None) -> DataFrame:
    """Provider behaviours that apply to each pick (atom_id, category_slug).

    A null key of a behaviour is a wildcard, so each of the four null patterns is
    one equality join on the keys that are set. Most severe first.
    """
    rows = behaviours.filter(F.col("provider") == provider)
    if mode is not None:
        rows = rows.filter(F.col("render_mode").isNull() | (F.col("render_mode") == mode))
    by_atom, by_category = F.col("atom_id").isNotNull(), F.col("atom_category").isNotNull()
    cols = ["pick_id", "category_slug", "behavior", "render_mode", "severity"]
    left = picks.select(F.col("atom_id").alias("pick_id"), "category_slug")
    body = ["behavior", "render_mode", "severity"]
    both = left.join(
        rows.filter(by_atom & by_category).select(
            F.col("atom_id").alias("pick_id"), F.col("atom_category").alias("category_slug"), *body
        ),
        ["pick_id", "category_slug"],
    )
    atom = left.join(
        rows.filter(by_atom & ~by_category).select(F.col("atom_id").alias("pick_id"), *body), "pick_id"
    )
    category = left.join(
        rows.filter(~by_atom & by_category).select(F.col("atom_category").alias("category_slug"), *body),
        "category_slug",
    )
    # behaviours of a whole provider: each packed once with its number, picks dealt over the tasks
    from lexweave.functions.sizing import attach_packed, spread

    whole = rows.filter(~by_atom & ~by_category).groupBy(*body).agg(F.count("*").cast("int").alias("times"))
    general, _ = attach_packed(spread(left), whole, "b")
    everyone = (
        general.select("pick_id", "category_slug", F.explode("b").alias("b"))
        .select("pick_id", "category_slug", "b.behavior", "b.render_mode", "b.severity", F.explode(F.sequence(F.lit(1), F.col("b.times"))).alias("_"))
    )
    parts = [d.select(*cols) for d in (both, atom, category, everyone)]
    return reduce(DataFrame.unionByName, parts).withColumn("severity_rank", severity_rank("severity"))


def opposition_pairs(selected: DataFrame, edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """``opposes`` edges with both ends in ``selected`` (id), with texts."""
    ids = selected.select("id").distinct()
    inside = (
        edges.filter(F.col("relationship_type") == "opposes")
        .join(ids, edges.atom_a_id == ids.id, "left_semi")
        .join(ids, edges.atom_b_id == ids.id, "left_semi")
    )
    text = atoms.select("id", "text")
    return inside.join(
        text.select(F.col("id").alias("atom_a_id"), F.col("text").alias("text_a")), "atom_a_id"
    ).join(text.select(F.col("id").alias("atom_b_id"), F.col("text").alias("text_b")), "atom_b_id")


def relations_touching(relations: DataFrame, slugs: DataFrame) -> DataFrame:
    """Category relations with either side in ``slugs``, each once."""
    s = slugs.select(F.col("slug").alias("_slug")).distinct()
    left = relations.join(s, relations.source_slug == s._slug, "left_semi")
    right = relations.join(s, relations.source_slug == s._slug, "left_anti").join(
        s, relations.target_slug == s._slug, "left_semi"
    )
    return left.unionByName(right)


def resolve_edge_names(candidates: DataFrame, atoms: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Named edges (source_name, target_name) with both ids and a status that says
    which side is unknown; looked up in ``tasks`` tasks, if given. Rows without a name are dealt evenly."""
    best = atoms.groupBy("text_lower").agg(F.min("id").alias("id"))
    out = candidates.withColumn("_s", text_key("source_name")).withColumn("_t", text_key("target_name"))
    # rows without a name are dealt evenly, and what they meet does not count
    place = F.concat(F.lit("\0"), F.xxhash64(*[c for c, kind in candidates.dtypes if "map<" not in kind]).cast("string"))
    for key, found in (("_s", "source_id"), ("_t", "target_id")):
        out = out.withColumn("_key", F.coalesce(key, place))
        known = best.select(F.col("text_lower").alias("_key"), F.col("id").alias(found))
        if tasks:
            out, known = out.repartition(tasks, "_key"), known.repartition(tasks, "_key")
        out = out.join(known, "_key", "left")
        out = out.withColumn(found, F.when(F.col(key).isNotNull(), F.col(found)))
    return out.drop("_s", "_t", "_key").withColumn(
        "resolution",
        F.when(F.col("source_id").isNull() & F.col("target_id").isNull(), "both_unknown")
        .when(F.col("source_id").isNull(), "source_unknown")
        .when(F.col("target_id").isNull(), "target_unknown")
        .otherwise("resolved"),
    )


def arrangement_detail(arrangements: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each profile with the guidance of its context, category by category."""
    return arrangements.join(
        contexts.withColumnRenamed("context", "context_key"), "context_key", "left"
    )


def document_profile(documents: DataFrame, chunk_profiles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct profiles of a document: from the join table with score 1, else from
    the array column of its chunks with score 0.6, else none with score 0."""
    table = (
        chunks.select("chunk_id", "document_id")
        .join(chunk_profiles.select("chunk_id", "arrangement_slug"), "chunk_id")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_set("arrangement_slug")).alias("from_table"))
    )
    column = (
        chunks.select("document_id", F.explode("arrangement_slugs").alias("slug"))
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_set("slug")).alias("from_column"))
    )
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    out = reduce(
        lambda a, b: a.join(b, "document_id", "left"), [table, column, counts], documents.select("document_id")
    )
    empty = F.array().cast("array<string>")
    return out.select(
        "document_id",
        F.coalesce("from_table", "from_column", empty).alias("arrangements"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.when(F.col("from_table").isNotNull(), 1.0)
        .when(F.col("from_column").isNotNull(), 0.6)
        .otherwise(0.0)
        .alias("score"),
    )


def match_reviews(
    reviews: DataFrame,
    sources: DataFrame,
    *,
    min_chars: int = 100,
    per_source: int | None = 5,
    max_chars: int | None = 2000,
) -> DataFrame:
    """Reviews joined to a source by the first key, else by the second.

    Texts of at least ``min_chars`` count; the first ``per_source`` per source stay,
    each shortened to ``max_chars`` (None: all of them, whole).
    """
    one = sources.filter(F.col("key_one").isNotNull()).groupBy("key_one").agg(F.min("source_id").alias("by_one"))
    two = sources.filter(F.col("key_two").isNotNull()).groupBy("key_two").agg(F.min("source_id").alias("by_two"))
    matched = (
        reviews.filter(F.length("text") >= min_chars)
        .join(one, "key_one", "left")
        .join(two, "key_two", "left")
        .withColumn("source_id", F.coalesce("by_one", "by_two"))
        .filter(F.col("source_id").isNotNull())
    )
    order = Window.partitionBy("source_id").orderBy("review_id")
    placed = matched.withColumn("place", F.row_number().over(order))
    kept = placed if per_source is None else placed.filter(F.col("place") <= per_source)
    return kept.select("review_id", "source_id", "place", head("text", max_chars).alias("text"))
