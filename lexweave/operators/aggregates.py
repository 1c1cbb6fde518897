"""Counts, status reports and rollups. Each report is as few passes as its keys allow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.quantiles import exact_median
from lexweave.functions.maths import DIMENSIONS

# Families of aesthetic and visual categories.
AESTHETIC_PARENTS = ["style", "color", "lighting", "effect", "composition", "camera"]
AESTHETIC_CATEGORIES = ["narrative.mood", "environment.atmosphere"]
VISUAL_PARENTS = ["camera", "lighting", "color", "composition"]
VISUAL_CATEGORIES = ["style.medium", "style.genre", "style.rendering"]


def long_counts(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One pass of named aggregates, as (metric, value) rows."""
    one = df.agg(*[expr.cast("double").alias(name) for name, expr in counts.items()])
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in counts]
    return one.select(F.explode(F.array(*pairs)).alias("m")).select("m.metric", "m.value")


def atom_stats(atoms: DataFrame) -> DataFrame:
    """Total, and counts by collection, status and source, in one pass."""
    keys = ["collection_slug", "status", "source"]
    sets = [[], *[[F.col(k)] for k in keys]]
    grouped = atoms.groupingSets(sets, *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "collection").when(F.col("g") == 5, "status").when(F.col("g") == 6, "source")
    return grouped.select(
        F.coalesce(name, F.lit("total")).alias("facet"), F.coalesce(*keys).alias("key"), "n"
    )


def phase_status(
    atoms: DataFrame, runs: DataFrame, as_of: Column, *, stale_minutes: int = 45
) -> tuple[DataFrame, DataFrame]:
    """Totals of the term table, and per phase the last run of 24 hours with its
    failures and whether it is stale."""
    status = F.col("embedding_status")
    totals = long_counts(
        atoms,
        {
            "total": F.count("*"),
            "classified": F.count("category_slug"),
            "unclassified": F.count_if(F.col("category_slug").isNull()),
            **{f"embedding_{s}": F.count_if(status == s) for s in ("pending", "processing", "complete", "failed")},
        },
    )
    phases = (
        runs.filter(F.col("completed_at") > as_of - F.expr("INTERVAL 24 HOURS"))
        .groupBy("phase")
        .agg(F.max("completed_at").alias("last_run"), F.sum("items_failed").alias("recent_failures"))
        .withColumn("stale", F.col("last_run") < as_of - F.expr(f"INTERVAL {int(stale_minutes)} MINUTES"))
    )
    return totals, phases


def classifier_status(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditional counts, and the uncategorised terms by collection."""
    totals = long_counts(
        atoms,
        {
            "total": F.count("*"),
            "categorized": F.count("category_slug"),
            "has_harmonics": F.count("hardness"),
            "uncategorized": F.count_if(F.col("category_slug").isNull()),
        },
    )
    rest = (
        atoms.filter(F.col("category_slug").isNull())
        .groupBy("collection_slug")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "collection_slug")
    )
    return totals, rest


def harvest_health(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Stage counts per collection, with the terms that start an edge."""
    classified = F.col("category_slug").isNotNull()
    embedded = F.col("embedding_status") == "complete"
    harmonized = F.col("hardness").isNotNull()
    tagged = F.col("tag_version") > 0
    sources = edges.select(F.col("atom_a_id").alias("id")).distinct().withColumn("is_source", F.lit(1))
    return (
        atoms.join(sources, "id", "left")
        .groupBy("collection_slug")
        .agg(
            F.count("*").alias("total"),
            *[F.count_if(F.col("status") == s).alias(s) for s in ("provisional", "confirmed", "rejected")],
            F.count_if(classified).alias("classified"),
            F.count_if(embedded).alias("embedded"),
            F.count_if(harmonized).alias("harmonized"),
            F.count_if(tagged).alias("tagged"),
            F.count_if(classified & embedded & harmonized & tagged).alias("fully_processed"),
            F.count("is_source").alias("edge_sources"),
        )
    )


def latest_per_group(df: DataFrame, group: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group in ``order``."""
    return df.withColumn(
        "place", F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ).filter(F.col("place") <= n)


def daily_review(
    atoms: DataFrame,
    gate_log: DataFrame,
    failures: DataFrame,
    runs: DataFrame,
    discoveries: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Metrics of the last 24 hours as (section, key, value) rows."""
    since = as_of - F.expr("INTERVAL 1 DAY")
    created, updated = F.col("created_at") > since, F.col("updated_at") > since
    hours = (F.unix_micros("fully_enriched_at") - F.unix_micros("created_at")) / 3.6e9
    done = F.col("fully_enriched_at") > since
    totals = long_counts(
        atoms,
        {
            "new_atoms": F.count_if(created),
            "updated_atoms": F.count_if(updated & ~created),
            "latency_avg_hours": F.round(F.avg(F.when(done, hours)), 6),
            "latency_min_hours": F.round(F.min(F.when(done, hours)), 6),
            "latency_max_hours": F.round(F.max(F.when(done, hours)), 6),
            "latency_count": F.count_if(done),
        },
    ).select(F.lit("totals").alias("section"), F.col("metric").alias("key"), "value")

    def counted(df: DataFrame, section: str, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value")).select(
            F.lit(section).alias("section"), "key", "value"
        )

    top = (
        counted(atoms.filter(created & F.col("category_slug").isNotNull()), "new_by_category", "category_slug")
        .orderBy(F.desc("value"), "key")
        .limit(15)
    )
    late = runs.filter(F.col("completed_at") > since).groupBy("phase").agg(
        F.sum("items_processed").cast("double").alias("items"), F.sum("items_failed").cast("double").alias("errors")
    )
    phases = late.select(
        F.explode(
            F.array(
                F.struct(F.lit("phase_items").alias("section"), F.col("phase").alias("key"), F.col("items").alias("value")),
                F.struct(F.lit("phase_errors").alias("section"), F.col("phase").alias("key"), F.col("errors").alias("value")),
            )
        ).alias("p")
    ).select("p.*")
    parts = [
        totals,
        top,
        counted(gate_log.filter(F.col("checked_at") > since), "gate", "result"),
        long_counts(failures.filter(F.col("failed_at") > since), {"failures": F.count("*")}).select(
            F.lit("totals").alias("section"), F.col("metric").alias("key"), "value"
        ),
        phases,
        long_counts(discoveries, {"pending_review": F.count_if(F.col("status") == "pending")}).select(
            F.lit("totals").alias("section"), F.col("metric").alias("key"), "value"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def strongest_edges(edges: DataFrame, atoms: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    """The strongest edges of the last day, with both texts."""
    recent = edges.filter(F.col("created_at") > as_of - F.expr("INTERVAL 1 DAY"))
    text = atoms.select("id", "text")
    return (
        recent.join(text.select(F.col("id").alias("atom_a_id"), F.col("text").alias("text_a")), "atom_a_id")
        .join(text.select(F.col("id").alias("atom_b_id"), F.col("text").alias("text_b")), "atom_b_id")
        .orderBy(F.desc("strength"), "atom_a_id", "atom_b_id", "relationship_type")
        .limit(n)
    )


def bulk_import_alert(atoms: DataFrame, as_of: Column, threshold: int = 50, hours: int = 1) -> DataFrame:
    """Source apps with more than ``threshold`` inserts in the last hour."""
    recent = atoms.filter(
        F.col("source_app").isNotNull() & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    )
    return recent.groupBy("source_app").agg(F.count("*").alias("inserts")).filter(F.col("inserts") > threshold)


def duplicate_groups(
    atoms: DataFrame, *, min_count: int = 2, text_like: str | None = None, limit: int | None = None
) -> DataFrame:
    """Texts shared by several live terms, largest group first."""
    from lexweave.functions.text import like

    rows = atoms.filter(F.col("status") != "rejected")
    if text_like:
        rows = rows.filter(like(F.col("text_lower"), text_like))
    groups = (
        rows.groupBy("text_lower")
        .agg(F.count("*").alias("atom_count"))
        .filter(F.col("atom_count") >= min_count)
        .orderBy(F.desc("atom_count"), "text_lower")
    )
    return groups.limit(limit) if limit else groups


def duplicate_members(atoms: DataFrame, groups: DataFrame, degree: DataFrame) -> DataFrame:
    """Live terms of the duplicate groups with their edge counts."""
    return (
        atoms.filter(F.col("status") != "rejected")
        .join(groups, "text_lower")
        .join(degree, "id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
    )


def recommended_canonical(members: DataFrame) -> DataFrame:
    """The term to keep per group: manual source, more edges, newer tags, has a
    register, lower id. An ordered minimum needs no sort and combines early, so a
    group of any size is reduced where its rows are."""
    order = F.struct(
        F.when(F.col("source") == "manual", 0).otherwise(1),
        -F.col("degree"),
        -F.col("tag_version"),
        F.when(F.col("register").isNotNull(), 0).otherwise(1),
        F.col("id"),
    )
    return members.groupBy("text_lower").agg(
        F.count("*").alias("atom_count"), F.min_by("id", order).alias("canonical_id")
    )


def cache_stats(cache: DataFrame, low: float = 0.7, attempts: int = 3) -> DataFrame:
    weak = F.col("confidence") < low
    return cache.agg(
        F.count("*").alias("total_entries"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("total_hits"),
        F.count_if(weak).alias("low_confidence"),
        F.count_if(weak & (F.col("reclassify_count") >= attempts)).alias("exhausted"),
        F.count_distinct("category_slug").alias("categories_cached"),
    )


def failed_summary(failures: DataFrame, queue: str | None = None, status: str | None = None) -> DataFrame:
    """Active and permanent failures per queue."""
    rows = failures
    if queue:
        rows = rows.filter(F.col("queue") == queue)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.groupBy("queue").agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "permanent").alias("permanent"),
        F.max("failed_at").alias("last_failed_at"),
    )


def trend_rollup(
    signals: DataFrame, as_of: Column, *, days: int = 7, pain_cap: int = 10, request_cap: int = 5
) -> DataFrame:
    """Topic trends of the current window and their velocity against the one before.

    One scan of both windows. The current one has ``days`` + 1 dates, counting
    today. Lists keep the values seen latest, then in text order; values are
    reduced per (topic, value) first, so a hot topic never meets one task whole.
    """
    seen = F.col("scan_date")
    both = signals.filter(seen >= F.date_sub(as_of, 2 * days))
    current = seen >= F.date_sub(as_of, days)
    base = both.groupBy("topic").agg(
        F.count_if(current).alias("mentions"),
        F.count_if(~current).alias("prior_mentions"),
        F.min(F.when(current, seen)).alias("first_seen"),
    ).filter(F.col("mentions") > 0)
    rows = both.filter(current)

    def listed(column: str, name: str, cap: int | None) -> DataFrame:
        values = rows.select("topic", seen, F.explode(column).alias("v")) if cap else rows.select(
            "topic", seen, F.col(column).alias("v")
        )
        per_value = values.groupBy("topic", "v").agg(F.max("scan_date").alias("last"), F.count("*").alias("n"))
        if cap is None:
            return per_value
        order = Window.partitionBy("topic").orderBy(F.desc("last"), "v")
        return (
            per_value.withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= cap)
            .groupBy("topic")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda s: s["v"]).alias(name))
        )

    sentiment = listed("sentiment", "", None).groupBy("topic").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("sentiments")
    )
    places = listed("subreddit", "", None).groupBy("topic").agg(F.count("*").alias("subreddits"))
    parts = [
        base,
        sentiment,
        places,
        listed("pain_points", "top_pain_points", pain_cap),
        listed("feature_requests", "top_feature_requests", request_cap),
    ]
    return reduce(lambda a, b: a.join(b, "topic", "left"), parts).withColumn(
        "velocity", F.col("mentions") - F.col("prior_mentions")
    )


def coverage_by_arrangement(arrangement_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """Confirmed terms per (profile, category)."""
    live = atoms.filter(F.col("status") == "confirmed").select(F.col("id").alias("atom_id"), "category_slug")
    return (
        arrangement_atoms.join(live, "atom_id")
        .groupBy("arrangement_slug", "category_slug")
        .agg(F.count("*").alias("atom_count"))
    )


def context_coverage(targets: DataFrame, contexts: DataFrame, minimum: int | None = None) -> DataFrame:
    """Guidance rows per target context, thinnest first."""
    have = contexts.groupBy("context").agg(F.count("*").alias("contexts"))
    out = targets.select("context").distinct().join(have, "context", "left").withColumn(
        "contexts", F.coalesce("contexts", F.lit(0))
    )
    if minimum is not None:
        out = out.filter(F.col("contexts") < minimum)
    return out.orderBy("contexts", "context")


def verify_ingest(atoms: DataFrame, category_prefix: str) -> DataFrame:
    """Counts by status, source and embedding status of one domain, in one pass."""
    rows = atoms.filter(F.col("category_slug").startswith(category_prefix))
    keys = ["status", "source", "category_slug", "embedding_status"]
    grouped = rows.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g")
    )
    facet = F.lit(None).cast("string")
    for i, key in enumerate(keys):
        facet = F.when(F.col("g") == 15 - (1 << (3 - i)), key).otherwise(facet)
    return grouped.select(facet.alias("facet"), F.coalesce(*keys).alias("key"), "n")


def import_audit(sources: DataFrame, creators: DataFrame, links: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rows of each table of an import, and the terms that name a source."""
    linked = atoms.join(sources.select("source_id"), "source_id", "left_semi")
    named = [("sources", sources), ("creators", creators), ("links", links), ("linked_atoms", linked)]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in named]
    return reduce(DataFrame.unionByName, parts)


def request_completion(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests in ingestion none of whose entries is unfinished, with counts."""
    state = F.col("extraction_status")
    counts = entries.groupBy("request_id").agg(
        F.count("*").alias("total"),
        F.count_if(state == "complete").alias("succeeded"),
        F.count_if(state == "failed").alias("failed"),
        F.every(state.isin("complete", "failed")).alias("finished"),
    )
    out = requests.filter(F.col("status") == "ingesting").join(counts, "request_id", "left")
    return out.filter(F.coalesce("finished", F.lit(True))).select(
        "request_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "succeeded", "failed")]
    )


def arrangement_rollup(
    chunks: DataFrame, arrangements: DataFrame, *, top_n: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Per document: the profiles with most chunk quality and their share, and the
    mean profile of those."""
    total = chunks.groupBy("document_id").agg(F.sum("quality").alias("total"))
    weight = (
        chunks.select("document_id", "quality", F.explode("arrangement_slugs").alias("slug"))
        .groupBy("document_id", "slug")
        .agg(F.sum("quality").alias("w"))
    )
    order = Window.partitionBy("document_id").orderBy(F.desc("w"), "slug")
    top = (
        weight.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top_n)
        .join(total, "document_id")
        .select(
            "document_id",
            "slug",
            "place",
            F.round(F.round(F.col("w") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")), 9), 3).alias("confidence"),
        )
    )
    means = [
        F.coalesce(F.round(F.round(F.avg(F.when(F.col("known"), F.coalesce(d, F.lit(0.5)))), 9), 3), F.lit(0.5)).alias(d)
        for d in DIMENSIONS
    ]
    profile = (
        top.join(arrangements.select("slug", *DIMENSIONS, F.lit(True).alias("known")), "slug", "left")
        .groupBy("document_id")
        .agg(*means)
    )
    return top, profile


def eval_stats(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, median, population spread and range of each metric.

    The median is exact and needs no buffer of all values of a metric.
    """
    long = scores.unpivot([], metrics, "metric", "value").filter(F.col("value").isNotNull())
    rest = long.groupBy("metric").agg(
        F.round(F.round(F.avg("value"), 9), 4).alias("mean"),
        F.round(F.round(F.stddev_pop("value"), 9), 4).alias("stdev"),
        F.round(F.min("value"), 4).alias("low"),
        F.round(F.max("value"), 4).alias("high"),
    )
    middle = exact_median(long, ["metric"], "value").withColumn("median", F.round(F.round("median", 9), 4))
    return rest.join(middle, "metric").select("metric", "mean", "median", "stdev", "low", "high")


def top_counts(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Most frequent values first; used for missed terms and divergence types."""
    out = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(k) if k else out


def term_frequency(terms: DataFrame) -> DataFrame:
    """Prompts and distinct images per (term, term_type)."""
    return terms.groupBy("term", "term_type").agg(
        F.count_distinct("prompt_id").alias("prompts"), F.count_distinct("image_id").alias("images")
    )


def vocab_audit_summary(audit: DataFrame) -> DataFrame:
    """Outcome counts per term type."""
    return audit.groupBy("term_type").agg(
        F.count("*").alias("terms"),
        F.count_if(F.col("status") == "found").alias("found"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("issue").isNotNull()).alias("issues"),
    )


def arrangement_engagement(posts: DataFrame, as_of: Column, *, days: int = 7, top: int = 10) -> DataFrame:
    """Impressions plus ten times likes per profile over the leading posts of a week."""
    seen = F.coalesce(F.get_json_object("engagement", "$.impression_count").cast("long"), F.lit(0))
    likes = F.coalesce(F.get_json_object("engagement", "$.like_count").cast("long"), F.lit(0))
    leaders = (
        posts.filter(
            (F.col("posted_at") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & F.col("engagement").isNotNull()
        )
        .withColumns({"impressions": seen, "likes": likes})
        .orderBy(F.desc("impressions"), "post_id")
        .limit(top)
    )
    return (
        leaders.filter(F.col("arrangement_slug").isNotNull())
        .groupBy("arrangement_slug")
        .agg(F.sum(F.col("impressions") + F.col("likes") * 10).alias("score"))
    )


def is_aesthetic(c: str = "category_slug") -> Column:
    return F.split_part(c, F.lit("."), F.lit(1)).isin(AESTHETIC_PARENTS) | F.col(c).isin(AESTHETIC_CATEGORIES)


def is_visual(c: str = "category_slug") -> Column:
    return F.split_part(c, F.lit("."), F.lit(1)).isin(VISUAL_PARENTS) | F.col(c).isin(VISUAL_CATEGORIES)


def atom_signals(hits: DataFrame, aesthetic: Column | None = None, top: int = 5) -> DataFrame:
    """Per query: aesthetic and other matches, and the most frequent categories."""
    cat = F.coalesce("category_slug", F.lit("unknown"))
    rows = hits.withColumn("category_slug", cat)
    test = is_aesthetic() if aesthetic is None else aesthetic
    split = rows.groupBy("query_id").agg(
        F.count_if(test).alias("aesthetic_matches"), F.count_if(~test).alias("texture_matches")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "category_slug")
    best = (
        rows.groupBy("query_id", "category_slug")
        .agg(F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "category_slug"))), lambda s: s["category_slug"]).alias("top_categories"))
    )
    return split.join(best, "query_id")


def connectivity_daily(runs: DataFrame, counters: list[str]) -> DataFrame:
    """Per-day totals of run counters."""
    return runs.groupBy(F.to_date("completed_at").alias("day")).agg(
        F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in counters]
    )


def candidate_counts(candidates: DataFrame, board: str = "moodboard_id") -> DataFrame:
    return candidates.filter(F.col(board).isNotNull()).groupBy(board).agg(
        F.count("*").alias("candidates"), F.count_distinct("source_url").alias("sources")
    )


def vocabulary_summary(atoms: DataFrame, documents: DataFrame) -> DataFrame:
    n = atoms.agg(F.count_if(F.col("status") == "confirmed").alias("n")).select(F.lit("confirmed_atoms").alias("metric"), "n")
    d = documents.agg(F.count("*").alias("n")).select(F.lit("documents").alias("metric"), "n")
    return n.unionByName(d)


def ingest_counters(stages: DataFrame) -> DataFrame:
    """Matched, created, relation and error counts per run from its stage rows."""
    kind = F.col("outcome")
    return stages.groupBy("run_id").agg(
        *[F.count_if(kind == k).alias(k) for k in ("matched", "created", "relation", "error")]
    )


def documents_completed(chunks: DataFrame) -> DataFrame:
    """Documents whose every chunk is enriched."""
    return (
        chunks.groupBy("document_id")
        .agg(F.count("*").alias("chunks"), F.every(F.col("enriched")).alias("complete"))
        .filter("complete")
        .drop("complete")
    )


def evolve_report(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Term counts by status, edge counts by type and provenance, orphan terms."""
    a = atoms.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("facet"), F.col("status").alias("key"), "n")
    e = edges.groupBy("relationship_type").agg(F.count("*").alias("n")).select(
        F.lit("edge_type").alias("facet"), F.col("relationship_type").alias("key"), "n"
    )
    p = edges.groupBy("provenance").agg(F.count("*").alias("n")).select(
        F.lit("provenance").alias("facet"), F.col("provenance").alias("key"), "n"
    )
    ends = edges.select(F.explode(F.array("atom_a_id", "atom_b_id")).alias("id"))
    o = atoms.filter(F.col("status") != "rejected").join(ends, "id", "left_anti").agg(F.count("*").alias("n")).select(
        F.lit("orphans").alias("facet"), F.lit("all").alias("key"), "n"
    )
    return reduce(DataFrame.unionByName, [a, e, p, o])


def curate(hits: DataFrame, visual: Column | None = None, *, content_n: int = 15, visual_n: int = 10) -> DataFrame:
    """Per theme: the best content terms and the best visual terms."""
    test = is_visual() if visual is None else visual
    rows = hits.withColumn("kind", F.when(test, "visual").otherwise("content"))
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "neighbour_id")
    cap = F.when(F.col("kind") == "visual", visual_n).otherwise(content_n)
    placed = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(content_n, visual_n))
    return placed.filter(F.col("place") <= cap)
