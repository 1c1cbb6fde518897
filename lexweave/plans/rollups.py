"""Reports, rollups, upserts, audits and lifecycle on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.sizing import tasks_for
from lexweave.operators import aggregates as ag
from lexweave.operators import audits as au
from lexweave.operators import edges as ed
from lexweave.operators import lifecycle as lc
from lexweave.operators import upserts as up
from lexweave.plans.registry import Inputs, query
from lexweave.plans.terms import DEGREE, weighted_arrangements, with_degree
from lexweave.plans.views import VIEWS

VIEWS.update(
    {
        "v_gate_log": """
            SELECT event_id AS log_id, ts AS checked_at, CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'flag'
                   WHEN 'click' THEN 'redirect_merge' ELSE 'pass' END AS result FROM {events}""",
        "v_failures": """
            SELECT event_id AS failure_id, 'queue-' || (user_id % 5) AS queue, ts AS failed_at,
                   CASE WHEN value > 20 THEN 'permanent' ELSE 'active' END AS status
            FROM {events} WHERE event_type = 'error'""",
        "v_cache": """
            SELECT o_orderkey AS cache_id, 'cat-' || o_orderpriority AS category_slug, round(o_totalprice / 500000, 4) AS confidence,
                   o_custkey % 9 AS access_count, o_custkey % 5 AS reclassify_count FROM {orders}""",
        "v_entries": """
            SELECT l_orderkey AS request_id, l_linenumber AS entry_id,
                   CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'complete'
                        ELSE CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'pending' END END AS extraction_status
            FROM {lineitem}""",
        "v_edges_dated": """
            SELECT e.*, last_reinforced_at AS created_at FROM {v_edges} e""",
    }
)

AS_OF = "2024-01-30 12:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


def day(text: str):
    return F.lit(text).cast("date")


@query("atom_stats", "A1", """
    SELECT 'total' AS facet, NULL AS key, count(*) AS n FROM v_atoms
    UNION ALL SELECT 'collection', collection_slug, count(*) FROM v_atoms GROUP BY 2
    UNION ALL SELECT 'status', status, count(*) FROM v_atoms GROUP BY 2
    UNION ALL SELECT 'source', source, count(*) FROM v_atoms GROUP BY 2""")
def atom_stats(t: Inputs):
    return ag.atom_stats(t.v_atoms)


@query("phase_totals", "A2", """
    SELECT unnest(['total', 'classified', 'unclassified', 'embedding_pending', 'embedding_processing', 'embedding_complete', 'embedding_failed']) AS metric,
           unnest([count(*), count(category_slug), count(*) - count(category_slug), count(*) FILTER (embedding_status = 'pending'),
             count(*) FILTER (embedding_status = 'processing'), count(*) FILTER (embedding_status = 'complete'),
             count(*) FILTER (embedding_status = 'failed')])::DOUBLE AS value FROM v_atoms""")
def phase_totals(t: Inputs):
    return ag.phase_status(t.v_atoms, t.v_runs, ts(AS_OF))[0]


@query("phase_status", "A2", """
    SELECT phase, CAST(max(completed_at) AS VARCHAR)[1:19] AS last_run, sum(items_failed)::BIGINT AS recent_failures,
           max(completed_at) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 45 MINUTE AS stale
    FROM v_runs WHERE completed_at > TIMESTAMP '2024-01-29 12:00:00' GROUP BY phase""")
def phase_status(t: Inputs):
    out = ag.phase_status(t.v_atoms, t.v_runs, ts(AS_OF))[1]
    return out.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


@query("classifier_totals", "A3", """
    SELECT unnest(['total', 'categorized', 'has_harmonics', 'uncategorized']) AS metric,
           unnest([count(*), count(category_slug), count(hardness), count(*) - count(category_slug)])::DOUBLE AS value FROM v_atoms""")
def classifier_totals(t: Inputs):
    return ag.classifier_status(t.v_atoms)[0]


@query("classifier_uncategorized", "A3", "SELECT collection_slug, count(*) AS n FROM v_atoms WHERE category_slug IS NULL GROUP BY 1")
def classifier_uncategorized(t: Inputs):
    return ag.classifier_status(t.v_atoms)[1]


@query("harvest_health", "A4", """
    SELECT collection_slug, count(*) AS total, count(*) FILTER (status = 'provisional') AS provisional,
      count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected,
      count(category_slug) AS classified, count(*) FILTER (embedding_status = 'complete') AS embedded, count(hardness) AS harmonized,
      count(*) FILTER (tag_version > 0) AS tagged,
      count(*) FILTER (category_slug IS NOT NULL AND embedding_status = 'complete' AND hardness IS NOT NULL AND tag_version > 0) AS fully_processed,
      count(*) FILTER (id IN (SELECT atom_a_id FROM v_edges)) AS edge_sources
    FROM v_atoms GROUP BY 1""")
def harvest_health(t: Inputs):
    return ag.harvest_health(t.v_atoms, t.v_edges)


@query("harvest_samples", "A4", """
    SELECT collection_slug, id, text, row_number() OVER (PARTITION BY collection_slug ORDER BY created_at DESC, id) AS place
    FROM v_atoms QUALIFY place <= 5""")
def harvest_samples(t: Inputs):
    out = ag.latest_per_group(t.v_atoms, "collection_slug", [F.desc("created_at"), F.asc("id")], 5)
    return out.select("collection_slug", "id", "text", "place")


@query("daily_review", "A5 X6", """
    WITH a AS (SELECT *, CASE WHEN p > 0.5 THEN updated_at + INTERVAL 6 HOUR END AS done FROM (SELECT *, temperature AS p FROM v_atoms)),
    cut AS (SELECT TIMESTAMP '2024-01-29 12:00:00' AS c)
    SELECT 'totals' AS section, unnest(['new_atoms', 'updated_atoms', 'latency_avg_hours', 'latency_min_hours', 'latency_max_hours', 'latency_count']) AS key,
      unnest([count(*) FILTER (created_at > c), count(*) FILTER (updated_at > c AND created_at <= c),
        round(avg(epoch(done - created_at) / 3600) FILTER (done > c), 6), round(min(epoch(done - created_at) / 3600) FILTER (done > c), 6),
        round(max(epoch(done - created_at) / 3600) FILTER (done > c), 6), count(*) FILTER (done > c)]::DOUBLE[]) AS value FROM a, cut
    UNION ALL (SELECT 'new_by_category', category_slug, count(*) FROM v_atoms, cut WHERE created_at > c AND category_slug IS NOT NULL
      GROUP BY 2 ORDER BY count(*) DESC, category_slug LIMIT 15)
    UNION ALL SELECT 'gate', result, count(*) FROM v_gate_log, cut WHERE checked_at > c GROUP BY 2
    UNION ALL SELECT 'totals', 'failures', count(*) FROM v_failures, cut WHERE failed_at > c
    UNION ALL SELECT 'phase_items', phase, sum(items_processed) FROM v_runs, cut WHERE completed_at > c GROUP BY 2
    UNION ALL SELECT 'phase_errors', phase, sum(items_failed) FROM v_runs, cut WHERE completed_at > c GROUP BY 2
    UNION ALL SELECT 'totals', 'pending_review', count(*) FROM v_atoms WHERE status = 'provisional'""")
def daily_review(t: Inputs):
    done = F.when(F.col("temperature") > 0.5, F.col("updated_at") + F.expr("INTERVAL 6 HOURS"))
    atoms = t.v_atoms.withColumn("fully_enriched_at", done)
    waiting = t.v_atoms.select(F.when(F.col("status") == "provisional", "pending").otherwise("done").alias("status"))
    return ag.daily_review(atoms, t.v_gate_log, t.v_failures, t.v_runs, waiting, ts(AS_OF))


@query("strongest_edges", "K1 A5", """
    SELECT a.text AS text_a, b.text AS text_b, e.strength, e.relationship_type
    FROM v_edges_dated e JOIN v_atoms a ON a.id = atom_a_id JOIN v_atoms b ON b.id = atom_b_id
    WHERE e.created_at > TIMESTAMP '2000-06-15' - INTERVAL 1 DAY
    ORDER BY strength DESC, atom_a_id, atom_b_id, relationship_type LIMIT 5""")
def strongest_edges(t: Inputs):
    return ag.strongest_edges(t.v_edges_dated, t.v_atoms, ts("2000-06-15")).select("text_a", "text_b", "strength", "relationship_type")


@query("evolve_report", "A7", """
    SELECT 'status' AS facet, status AS key, count(*) AS n FROM v_atoms GROUP BY 2
    UNION ALL SELECT 'edge_type', relationship_type, count(*) FROM v_edges GROUP BY 2
    UNION ALL SELECT 'provenance', provenance, count(*) FROM v_edges GROUP BY 2
    UNION ALL SELECT 'orphans', 'all', count(*) FROM v_atoms WHERE status <> 'rejected'
      AND id NOT IN (SELECT atom_a_id FROM v_edges UNION SELECT atom_b_id FROM v_edges)""")
def evolve_report(t: Inputs):
    return ag.evolve_report(t.v_atoms, t.v_edges)


@query("bulk_import_alert", "A8", """
    SELECT source_app, count(*) AS inserts FROM v_atoms WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 240 HOUR
    GROUP BY 1 HAVING count(*) > 50""")
def bulk_import_alert(t: Inputs):
    return ag.bulk_import_alert(t.v_atoms, ts(AS_OF), hours=240)


@query("duplicate_groups", "A9", """
    SELECT text_lower, count(*) AS atom_count FROM v_atoms WHERE status <> 'rejected' AND text_lower ILIKE '%i%'
    GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 30""")
def duplicate_groups(t: Inputs):
    return ag.duplicate_groups(t.v_atoms, text_like="%i%", limit=30)


@query("recommended_canonical", "W1 A9", f"""
    WITH {DEGREE}, m AS (SELECT v.*, coalesce(degree, 0) AS degree FROM v_atoms v LEFT JOIN deg ON v.id = deg.id WHERE status <> 'rejected')
    SELECT text_lower, count(*) AS atom_count, first(id ORDER BY CASE source WHEN 'manual' THEN 0 ELSE 1 END, degree DESC, tag_version DESC,
           CASE WHEN register IS NULL THEN 1 ELSE 0 END, id) AS canonical_id
    FROM m GROUP BY 1 HAVING count(*) >= 2""")
def recommended_canonical(t: Inputs):
    degree = ed.edge_degree(t.v_edges)
    groups = ag.duplicate_groups(t.v_atoms).select("text_lower")
    return ag.recommended_canonical(ag.duplicate_members(t.v_atoms, groups, degree))


@query("cache_stats", "A11", """
    SELECT count(*) AS total_entries, sum(access_count)::BIGINT AS total_hits, count(*) FILTER (confidence < 0.7) AS low_confidence,
      count(*) FILTER (confidence < 0.7 AND reclassify_count >= 3) AS exhausted, count(DISTINCT category_slug) AS categories_cached FROM v_cache""")
def cache_stats(t: Inputs):
    return ag.cache_stats(t.v_cache)


@query("failed_summary", "A12", """
    SELECT queue, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'permanent') AS permanent,
           CAST(max(failed_at) AS VARCHAR)[1:19] AS last_failed_at FROM v_failures GROUP BY 1""")
def failed_summary(t: Inputs):
    return ag.failed_summary(t.v_failures).withColumn("last_failed_at", F.date_format("last_failed_at", "yyyy-MM-dd HH:mm:ss"))


TREND_LIST = """
    {name} AS (SELECT topic, string_agg(v, '|' ORDER BY last DESC, v) AS {name} FROM (
      SELECT topic, {col} AS v, max(scan_date) AS last FROM cur GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY topic ORDER BY max(scan_date) DESC, {col}) <= {cap}) GROUP BY 1)"""


@query("trend_rollup", "A13 W5 X8", f"""
    WITH cur AS (SELECT * FROM v_signals WHERE scan_date >= DATE '2024-01-30' - 7),
    prior AS (SELECT topic, count(*) AS prior_mentions FROM v_signals WHERE scan_date >= DATE '2024-01-30' - 14 AND scan_date < DATE '2024-01-30' - 7 GROUP BY 1),
    sent AS (SELECT topic, string_agg(sentiment || '=' || n, ',' ORDER BY sentiment) AS sentiments FROM (SELECT topic, sentiment, count(*) AS n FROM cur GROUP BY 1, 2) GROUP BY 1),
    {TREND_LIST.format(name='top_pain_points', col='pain_point', cap=10)},
    {TREND_LIST.format(name='top_feature_requests', col='feature_request', cap=5)}
    SELECT c.topic, count(*) AS mentions, coalesce(any_value(prior_mentions), 0) AS prior_mentions, CAST(min(scan_date) AS VARCHAR) AS first_seen,
      any_value(sentiments) AS sentiments, count(DISTINCT subreddit) AS subreddits, any_value(top_pain_points) AS top_pain_points,
      any_value(top_feature_requests) AS top_feature_requests, count(*) - coalesce(any_value(prior_mentions), 0) AS velocity
    FROM cur c LEFT JOIN prior USING (topic) LEFT JOIN sent USING (topic) LEFT JOIN top_pain_points USING (topic)
    LEFT JOIN top_feature_requests USING (topic) GROUP BY 1""")
def trend_rollup(t: Inputs):
    rows = t.v_signals.withColumns({"pain_points": F.array("pain_point"), "feature_requests": F.array("feature_request")})
    out = ag.trend_rollup(rows, day("2024-01-30"))
    pairs = F.transform(F.map_entries("sentiments"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(
        "topic", "mentions", "prior_mentions", F.col("first_seen").cast("string").alias("first_seen"),
        F.array_join(pairs, ",").alias("sentiments"), "subreddits", F.array_join("top_pain_points", "|").alias("top_pain_points"),
        F.array_join("top_feature_requests", "|").alias("top_feature_requests"), "velocity",
    )


@query("coverage_by_arrangement", "A14", """
    SELECT arrangement_slug, category_slug, count(*) AS atom_count FROM v_arrangement_atoms x JOIN v_atoms a ON a.id = x.atom_id
    WHERE status = 'confirmed' GROUP BY 1, 2""")
def coverage_by_arrangement(t: Inputs):
    return ag.coverage_by_arrangement(t.v_arrangement_atoms, t.v_atoms)


@query("context_coverage", "A15", """
    SELECT p.context, count(c.context) AS contexts FROM (SELECT DISTINCT o_orderstatus AS context FROM orders
      UNION SELECT DISTINCT o_orderpriority FROM orders) p
    LEFT JOIN v_category_contexts c ON c.context = p.context GROUP BY 1 HAVING count(c.context) < 3""")
def context_coverage(t: Inputs):
    names = t.orders.select(F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("context"))
    return ag.context_coverage(names, t.v_category_contexts, 3)


@query("verify_ingest", "A16", """
    WITH d AS (SELECT * FROM v_atoms WHERE starts_with(category_slug, 'line.'))
    SELECT 'status' AS facet, status AS key, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY 2
    UNION ALL SELECT 'category_slug', category_slug, count(*) FROM d GROUP BY 2
    UNION ALL SELECT 'embedding_status', embedding_status, count(*) FROM d GROUP BY 2""")
def verify_ingest(t: Inputs):
    return ag.verify_ingest(t.v_atoms, "line.")


@query("import_audit", "A17", """
    SELECT 'sources' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'creators', count(*) FROM supplier
    UNION ALL SELECT 'links', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
    UNION ALL SELECT 'linked_atoms', count(*) FROM part WHERE p_partkey IN (SELECT o_orderkey FROM orders)""")
def import_audit(t: Inputs):
    return ag.import_audit(
        t.orders.select(F.col("o_orderkey").alias("source_id")), t.supplier, t.lineitem.select("l_orderkey", "l_suppkey").distinct(),
        t.part.select(F.col("p_partkey").alias("source_id")),
    )


@query("request_completion", "A18", """
    SELECT o_orderkey AS request_id, count(entry_id) AS total, count(*) FILTER (extraction_status = 'complete') AS succeeded,
           count(*) FILTER (extraction_status = 'failed') AS failed
    FROM orders LEFT JOIN v_entries ON request_id = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1
    HAVING count(*) FILTER (extraction_status NOT IN ('complete', 'failed')) = 0""")
def request_completion(t: Inputs):
    status = F.when(F.col("o_orderstatus") == "F", "ingesting").otherwise("pending")
    return ag.request_completion(t.orders.select(F.col("o_orderkey").alias("request_id"), status.alias("status")), t.v_entries)


ROLL = """
    ch AS (SELECT source AS document_id, coalesce(quality, 0)::DOUBLE AS quality, unnest(CASE WHEN lang = 'en' THEN ['small-ring', 'red-widget', 'ghost'] WHEN lang = 'fr' THEN ['small-ring', 'blue-bolt', 'hot-gear', 'red-gear'] ELSE ['cold-nut'] END) AS slug
      FROM documents LEFT JOIN labels USING (doc_id)),
    tot AS (SELECT source AS document_id, sum(coalesce(quality, 0))::DOUBLE AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
    w AS (SELECT document_id, slug, sum(quality) AS w FROM ch GROUP BY 1, 2),
    top AS (SELECT document_id, slug, row_number() OVER (PARTITION BY document_id ORDER BY w DESC, slug) AS place,
      round(round(w / CASE WHEN total = 0 THEN 1 ELSE total END, 9), 3) AS confidence FROM w JOIN tot USING (document_id) QUALIFY place <= 4)"""


def _rollup(t: Inputs):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("source").alias("document_id"), F.coalesce("quality", F.lit(0)).cast("double").alias("quality"),
        F.when(F.col("lang") == "en", F.array(*map(F.lit, ["small-ring", "red-widget", "ghost"])))
        .when(F.col("lang") == "fr", F.array(*map(F.lit, ["small-ring", "blue-bolt", "hot-gear", "red-gear"])))
        .otherwise(F.array(F.lit("cold-nut"))).alias("arrangement_slugs"),
    )
    return ag.arrangement_rollup(rows, t.v_arrangements)


@query("arrangement_rollup", "A21", f"WITH {ROLL} SELECT * FROM top")
def arrangement_rollup(t: Inputs):
    return _rollup(t)[0]


@query("arrangement_rollup_profile", "A21", f"""
    WITH {ROLL} SELECT document_id, {', '.join(f'coalesce(round(round(avg({d}), 9), 3), 0.5) AS {d}' for d in ag.DIMENSIONS)}
    FROM top LEFT JOIN v_arrangements USING (slug) GROUP BY 1""")
def arrangement_rollup_profile(t: Inputs):
    return _rollup(t)[1]


@query("eval_stats", "A22", """
    SELECT metric, round(round(avg(value), 9), 4) AS mean, round(round(median(value), 9), 4) AS median, round(round(stddev_pop(value), 9), 4) AS stdev,
           round(min(value), 4) AS low, round(max(value), 4) AS high
    FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY 1""")
def eval_stats(t: Inputs):
    return ag.eval_stats(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query("top_missed_terms", "A23", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def top_missed_terms(t: Inputs):
    return ag.top_counts(t.part, "p_name", 20)


@query("arrangement_engagement", "A26", """
    SELECT arrangement_slug, sum(imp + 10 * likes)::BIGINT AS score FROM (
      SELECT 'profile-' || event_type AS arrangement_slug, CAST(props->>'$.k' AS BIGINT) AS imp, user_id AS likes FROM events
      WHERE ts > TIMESTAMP '2024-01-23 12:00:00' ORDER BY imp DESC, event_id LIMIT 10) GROUP BY 1""")
def arrangement_engagement(t: Inputs):
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("impression_count"), F.col("user_id").alias("like_count")))
    posts = t.events.select(
        F.col("event_id").alias("post_id"), F.col("ts").alias("posted_at"), F.concat(F.lit("profile-"), "event_type").alias("arrangement_slug"),
        body.alias("engagement"),
    )
    return ag.arrangement_engagement(posts, ts(AS_OF))


HITS = """
    hits AS (
      SELECT a.id AS query_id, b.id AS neighbour_id, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) DESC, b.id) AS rank
      FROM v_vectors a, v_vectors b),
    found AS (SELECT h.*, coalesce(v.category_slug, 'unknown') AS category_slug FROM hits h JOIN v_atoms v ON v.id = neighbour_id WHERE rank <= 50 AND status <> 'rejected')"""


def _hits(t: Inputs):
    from lexweave.operators.vectors import semantic_search

    return semantic_search(t.v_vectors, t.v_vectors, t.v_atoms.select("id", "category_slug", "status"), k=50)


@query("atom_signals", "A27 V10", f"""
    WITH {HITS}
    SELECT query_id, any_value(aes) AS aesthetic_matches, any_value(tex) AS texture_matches, string_agg(category_slug, '|' ORDER BY n DESC, category_slug) AS top_categories FROM (
      SELECT *, sum(n) FILTER (starts_with(category_slug, 'size.')) OVER (PARTITION BY query_id)::BIGINT AS aes,
        sum(n) FILTER (NOT starts_with(category_slug, 'size.')) OVER (PARTITION BY query_id)::BIGINT AS tex,
        row_number() OVER (PARTITION BY query_id ORDER BY n DESC, category_slug) AS place
      FROM (SELECT query_id, category_slug, count(*) AS n FROM found GROUP BY 1, 2))
    WHERE place <= 5 GROUP BY 1""")
def atom_signals(t: Inputs):
    out = ag.atom_signals(_hits(t), F.col("category_slug").startswith("size."))
    return out.withColumn("top_categories", F.array_join("top_categories", "|"))


@query("curate", "K5", f"""
    WITH {HITS}
    SELECT query_id, neighbour_id, CASE WHEN starts_with(category_slug, 'size.') THEN 'visual' ELSE 'content' END AS kind,
      row_number() OVER (PARTITION BY query_id, starts_with(category_slug, 'size.') ORDER BY score DESC, neighbour_id) AS place
    FROM found QUALIFY place <= CASE WHEN starts_with(category_slug, 'size.') THEN 10 ELSE 15 END""")
def curate(t: Inputs):
    test = F.coalesce(F.col("category_slug").startswith("size."), F.lit(False))
    return ag.curate(_hits(t), test).select("query_id", "neighbour_id", "kind", "place")


@query("connectivity_daily", "A28", """
    SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, count(*) AS runs, sum(items_processed)::BIGINT AS items_processed,
           sum(items_failed)::BIGINT AS items_failed FROM v_runs GROUP BY 1""")
def connectivity_daily(t: Inputs):
    return ag.connectivity_daily(t.v_runs, ["items_processed", "items_failed"]).withColumn("day", F.col("day").cast("string"))


@query("candidate_counts", "A30", """
    SELECT 'board-' || (l_suppkey) AS moodboard_id, count(*) AS candidates, count(DISTINCT 'url-' || l_orderkey) AS sources
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def candidate_counts(t: Inputs):
    rows = t.lineitem.select(
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("board-"), "l_suppkey")).alias("moodboard_id"), F.concat(F.lit("url-"), "l_orderkey").alias("source_url")
    )
    return ag.candidate_counts(rows)


@query("vocabulary_summary", "A32", """
    SELECT 'confirmed_atoms' AS metric, count(*) AS n FROM v_atoms WHERE status = 'confirmed' UNION ALL SELECT 'documents', count(*) FROM documents""")
def vocabulary_summary(t: Inputs):
    return ag.vocabulary_summary(t.v_atoms, t.documents)


@query("ingest_counters", "A33", """
    SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS matched, count(*) FILTER (event_type = 'signup') AS created,
           count(*) FILTER (event_type = 'purchase') AS relation, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def ingest_counters(t: Inputs):
    kinds = {"view": "matched", "signup": "created", "purchase": "relation", "error": "error"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    return ag.ingest_counters(t.events.select(F.col("user_id").alias("run_id"), kind.alias("outcome")))


@query("documents_completed", "A34", """
    SELECT l_orderkey AS document_id, count(*) AS chunks FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')""")
def documents_completed(t: Inputs):
    return ag.documents_completed(t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_linestatus") == "F").alias("enriched")))


# --- set operations -------------------------------------------------------


@query("insert_ignore", "U1", """
    WITH old AS (SELECT text_lower, collection_slug FROM v_atoms WHERE status = 'confirmed'),
    new AS (SELECT * FROM v_atoms WHERE status <> 'confirmed')
    SELECT text_lower, collection_slug, min(id) AS id FROM new
    WHERE (text_lower, collection_slug) NOT IN (SELECT (text_lower, collection_slug) FROM old) GROUP BY 1, 2""")
def insert_ignore(t: Inputs):
    old = t.v_atoms.filter(F.col("status") == "confirmed")
    new = t.v_atoms.filter(F.col("status") != "confirmed").select("text_lower", "collection_slug", "id")
    return up.insert_ignore(old, new, ["text_lower", "collection_slug"], [F.col("id")])[0]


@query("insert_ignore_counts", "U1", """
    WITH old AS (SELECT text_lower, collection_slug FROM v_atoms WHERE status = 'confirmed'),
    new AS (SELECT * FROM v_atoms WHERE status <> 'confirmed'),
    ins AS (SELECT DISTINCT text_lower, collection_slug FROM new WHERE (text_lower, collection_slug) NOT IN (SELECT (text_lower, collection_slug) FROM old))
    SELECT (SELECT count(*) FROM ins) AS inserted, (SELECT count(*) FROM new) - (SELECT count(*) FROM ins) AS duplicates""")
def insert_ignore_counts(t: Inputs):
    old = t.v_atoms.filter(F.col("status") == "confirmed")
    new = t.v_atoms.filter(F.col("status") != "confirmed").select("text_lower", "collection_slug", "id")
    return up.insert_ignore(old, new, ["text_lower", "collection_slug"], [F.col("id")])[1]


@query("insert_replace", "U3", """
    SELECT atom_id, app, first(routing ORDER BY version DESC, n DESC, routing DESC) AS routing, max(version) AS version FROM (
      SELECT l_partkey AS atom_id, 'app-' || l_linenumber AS app, l_returnflag AS routing, l_orderkey AS version, 0 AS n FROM lineitem WHERE l_linestatus = 'F'
      UNION ALL SELECT l_partkey, 'app-' || l_linenumber, l_returnflag, l_orderkey, 1 FROM lineitem WHERE l_linestatus <> 'F') GROUP BY 1, 2""")
def insert_replace(t: Inputs):
    rows = t.lineitem.select(
        F.col("l_partkey").alias("atom_id"), F.concat(F.lit("app-"), "l_linenumber").alias("app"), F.col("l_returnflag").alias("routing"),
        F.col("l_orderkey").alias("version"), "l_linestatus",
    )
    old = rows.filter(F.col("l_linestatus") == "F").drop("l_linestatus")
    new = rows.filter(F.col("l_linestatus") != "F").drop("l_linestatus")
    return up.insert_replace(old, new, ["atom_id", "app"], "version")


@query("distinct_taxonomy", "U4", "SELECT collection_slug AS slug FROM v_atoms UNION SELECT slug FROM v_collections")
def distinct_taxonomy(t: Inputs):
    return up.distinct_taxonomy(t.v_atoms, t.v_collections)


@query("dedup_first", "U6", """
    SELECT lower(trim(text)) AS text_lower, min(text_id) AS text_id FROM v_texts WHERE lower(trim(text)) <> '' GROUP BY 1""")
def dedup_first(t: Inputs):
    return up.dedup_first(t.v_texts, "text", [F.col("text_id")]).select("text_lower", "text_id")


@query("provenance_union", "U7", "SELECT DISTINCT 'prov-' || unnest([l_returnflag, l_linestatus]) AS provenance FROM lineitem")
def provenance_union(t: Inputs):
    specs = t.lineitem.select(F.transform(F.array("l_returnflag", "l_linestatus"), lambda p: F.concat(F.lit("prov-"), p)).alias("provenances"))
    return up.provenance_union(specs)


@query("merge_found_in", "U8", """
    SELECT l_partkey AS item_id, arg_min('title ' || l_linenumber, l_linenumber) AS title, string_agg(DISTINCT 'q' || l_linenumber, '|' ORDER BY 'q' || l_linenumber) AS found_in
    FROM lineitem GROUP BY 1""")
def merge_found_in(t: Inputs):
    rows = t.lineitem.select(F.col("l_partkey").alias("item_id"), F.concat(F.lit("title "), "l_linenumber").alias("title"), F.concat(F.lit("q"), "l_linenumber").alias("query"))
    return up.merge_found_in(rows).withColumn("found_in", F.array_join("found_in", "|"))


@query("seen_entries", "U9 X4", """
    SELECT source AS source_id, 'u' || doc_id AS url, sha256(text || '|u' || doc_id) AS content_hash FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def seen_entries(t: Inputs):
    items = t.documents.select(F.col("source").alias("source_id"), F.concat(F.lit("u"), "doc_id").alias("url"), F.col("text").alias("title"))
    old = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("source_id"), F.concat(F.lit("u"), "doc_id").alias("url"))
    return up.seen_entries(items, old).select("source_id", "url", "content_hash")


@query("dedup_external", "U10", """
    SELECT s.source, s.fetched, coalesce(f.fresh, 0) AS fresh, s.fetched - coalesce(f.fresh, 0) AS skipped
    FROM (SELECT l_returnflag AS source, count(*) AS fetched FROM lineitem GROUP BY 1) s
    LEFT JOIN (SELECT l_returnflag AS source, count(DISTINCT l_partkey) AS fresh FROM lineitem
      WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1) f ON s.source = f.source""")
def dedup_external(t: Inputs):
    rows = t.lineitem.select(F.col("l_returnflag").alias("source"), F.concat(F.lit("uri:"), "l_partkey").alias("external_uri"))
    flags = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("source")
    known = t.supplier.select(flags, F.concat(F.lit("uri:"), "s_suppkey").alias("external_uri"))
    return up.dedup_external(rows, known)[1]


@query("dedup_urls", "U11", """
    WITH done AS (SELECT url FROM pages WHERE contains(url, '/fr/') UNION SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE contains(url, '/fr/'))
    SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM done) AND regexp_replace(url, '[?#].*$', '') NOT IN (SELECT url FROM done)""")
def dedup_urls(t: Inputs):
    rows = t.pages.select(
        "page_id", F.col("url").alias("requested_url"), F.regexp_replace("url", "[?#].*$", "").alias("resolved_url"),
        F.when(F.contains("url", F.lit("/fr/")), "complete").otherwise("failed").alias("status"),
    )
    return up.dedup_urls(rows, rows).select("page_id")


@query("gap_dedup", "U12", """
    SELECT slug FROM v_arrangements WHERE slug NOT IN (SELECT lower(replace(p_name, ' ', '-')) FROM part WHERE p_size = 3)""")
def gap_dedup(t: Inputs):
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    requests = t.part.select(
        F.to_json(F.array(F.lower(slug))).alias("target_arrangements"), F.when(F.col("p_size") == 3, "claimed").otherwise("complete").alias("status")
    )
    return up.gap_dedup(t.v_arrangements.select("slug"), requests)


@query("sample_terms", "K3", "SELECT id, text FROM v_atoms WHERE status <> 'rejected' ORDER BY md5(id || ':7'), id LIMIT 25")
def sample_terms(t: Inputs):
    return up.sample_terms(t.v_atoms.filter(F.col("status") != "rejected").select("id", "text"), 25, seed=7)


@query("sample_per_category", "K3", "SELECT id, category_slug FROM v_atoms QUALIFY row_number() OVER (PARTITION BY category_slug ORDER BY md5(id || ':7'), id) <= 5")
def sample_per_category(t: Inputs):
    return up.sample_per_group(t.v_atoms.select("id", "category_slug"), "category_slug", 5, seed=7)


# --- audits ---------------------------------------------------------------


@query("two_cycles", "N2", """
    WITH e AS (SELECT atom_a_id AS s, atom_b_id AS t FROM v_edges
      UNION SELECT CASE provenance WHEN 'semantic' THEN atom_b_id ELSE atom_a_id END, CASE provenance WHEN 'semantic' THEN atom_a_id ELSE atom_b_id END FROM v_edges)
    SELECT DISTINCT a.s AS source_slug, a.t AS target_slug FROM e a JOIN e b ON a.s = b.t AND a.t = b.s WHERE a.s <= a.t""")
def two_cycles(t: Inputs):
    # every edge, and once more: semantic ones the other way round
    a, b, turned = F.col("atom_a_id"), F.col("atom_b_id"), F.col("provenance") == "semantic"
    there = t.v_edges.select(a.alias("source_slug"), b.alias("target_slug"))
    back = t.v_edges.select(F.when(turned, b).otherwise(a).alias("source_slug"), F.when(turned, a).otherwise(b).alias("target_slug"))
    return au.two_cycles(there.unionByName(back))


@query("contradictory_weights", "N3", """
    SELECT category_slug, count(*) AS profiles, round(max(weight) - min(weight), 4) AS spread FROM v_arrangement_weights GROUP BY 1
    HAVING count(*) > 1 AND round(max(weight) - min(weight), 4) > 0.1""")
def contradictory_weights(t: Inputs):
    return au.contradictory_weights(weighted_arrangements(t), 0.1)


DRIFT = """
    SELECT 'missing_category' AS issue, 'high' AS severity, id AS subject, category_slug AS detail FROM v_atoms
      WHERE category_slug NOT IN (SELECT slug FROM v_categories)
    UNION ALL SELECT 'orphan', 'medium', id, collection_slug FROM v_atoms WHERE collection_slug NOT IN (SELECT slug FROM v_collections WHERE slug > 'brand-2')
    UNION ALL SELECT 'missing_category', 'medium', slug, category_slug FROM v_arrangement_weights WHERE category_slug NOT IN (SELECT slug FROM v_categories)
    UNION ALL SELECT 'embedding_gap', 'medium', 'atoms', CAST(count(*) AS VARCHAR) FROM v_atoms WHERE embedding_status = 'complete' AND status <> 'rejected'
      AND id NOT IN (SELECT atom_a_id FROM v_edges UNION SELECT atom_b_id FROM v_edges) HAVING count(*) > 0
    UNION ALL SELECT 'orphaned_ref', 'high', 'edges', CAST(count(*) AS VARCHAR) FROM v_edges WHERE
      (atom_a_id NOT IN (SELECT id FROM v_atoms) OR atom_b_id NOT IN (SELECT id FROM v_atoms)) HAVING count(*) > 0
    UNION ALL SELECT 'coverage_gap', 'low', slug, 'no atoms' FROM v_categories WHERE slug NOT IN (SELECT category_slug FROM v_atoms WHERE category_slug IS NOT NULL)"""


def _drift(t: Inputs):
    return (
        t.v_atoms, t.v_edges, t.v_categories,
        # the first collections stand under other slugs, so that their terms are orphans
        t.v_collections.withColumn("slug", F.when(F.col("slug") > "brand-2", F.col("slug")).otherwise(F.concat(F.lit("x-"), "slug"))),
        weighted_arrangements(t),
    )


@query("drift_report", "N4 J4 J5 J6 J7 J8", DRIFT)
def drift_report(t: Inputs):
    return au.drift_report(*_drift(t))


@query("integrity_scan", "N5 A8", f"""
    SELECT issue, severity, count(*) AS n FROM ({DRIFT}
      UNION ALL SELECT 'coverage_gap', 'high', source_app, '' FROM v_atoms WHERE created_at >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 1 HOUR GROUP BY source_app HAVING count(*) > 20
      UNION ALL SELECT DISTINCT 'circular_ref', 'medium', a.source_slug, a.target_slug FROM v_category_relations a JOIN v_category_relations b
        ON a.source_slug = b.target_slug AND a.target_slug = b.source_slug WHERE a.source_slug <= a.target_slug) GROUP BY 1, 2
    UNION ALL SELECT 'promoted', 'info', count(*) FROM v_atoms WHERE status = 'provisional' AND category_slug IS NOT NULL AND embedding_status = 'complete' AND tag_version > 0
    UNION ALL SELECT 'tier_fixes', 'info', count(*) FROM (SELECT tier, CASE WHEN id IN (SELECT atom_a_id FROM v_edges UNION SELECT atom_b_id FROM v_edges)
        THEN CASE WHEN id IN (SELECT 'a' || l_partkey FROM lineitem) THEN 1 ELSE 2 END ELSE 3 END AS new_tier
      FROM v_atoms WHERE status = 'confirmed') WHERE tier <> new_tier""")
def integrity_scan(t: Inputs):
    shown = t.lineitem.select(F.concat(F.lit("a"), "l_partkey").alias("atom_id"))
    return au.integrity_scan(*_drift(t), t.v_category_relations, shown, ts("2024-02-10"), 20)


@query("neighbourhood", "N1", """
    WITH both_ways AS (SELECT atom_a_id AS id, atom_b_id AS n FROM v_edges
               UNION SELECT atom_b_id, atom_a_id FROM v_edges),
    start AS (SELECT id FROM v_atoms WHERE text_lower = 'red bolt'),
    one AS (SELECT DISTINCT s.id AS start_id, b.n AS id FROM start s JOIN both_ways b ON s.id = b.id WHERE b.n <> s.id),
    two AS (SELECT DISTINCT o.start_id, b.n AS id FROM one o JOIN both_ways b ON o.id = b.id
            WHERE b.n <> o.start_id AND (o.start_id, b.n) NOT IN (SELECT (start_id, id) FROM one))
    SELECT id AS start_id, id, 0 AS hops FROM start UNION ALL SELECT start_id, id, 1 FROM one UNION ALL SELECT start_id, id, 2 FROM two""")
def neighbourhood(t: Inputs):
    return au.neighbourhood(t.v_edges, t.v_atoms.filter(F.col("text_lower") == "red bolt"))


@query("neighbourhood_hubs", "N1", """
    WITH both_ways AS (SELECT atom_a_id AS id, atom_b_id AS n FROM v_edges UNION SELECT atom_b_id, atom_a_id FROM v_edges),
    deg AS (SELECT id, count(*) > 40 AS hub FROM both_ways GROUP BY 1),
    zero AS (SELECT id AS start_id, id, coalesce(hub, FALSE) AS hub FROM v_atoms LEFT JOIN deg USING (id) WHERE text_lower = 'red bolt'),
    one AS (SELECT DISTINCT s.start_id, b.n AS id, d.hub FROM zero s JOIN both_ways b ON s.id = b.id JOIN deg d ON d.id = b.n WHERE NOT s.hub AND b.n <> s.id),
    two AS (SELECT DISTINCT o.start_id, b.n AS id FROM one o JOIN both_ways b ON o.id = b.id WHERE NOT o.hub AND b.n <> o.start_id AND (o.start_id, b.n) NOT IN (SELECT (start_id, id) FROM one))
    SELECT start_id, id, 0 AS hops, hub AS left_out FROM zero UNION ALL SELECT start_id, id, 1, hub FROM one UNION ALL SELECT start_id, id, 2, FALSE FROM two""")
def neighbourhood_hubs(t: Inputs):
    """Terms of more than 40 neighbours are reached but not gone through."""
    return au.neighbourhood(t.v_edges, t.v_atoms.filter(F.col("text_lower") == "red bolt"), max_degree=40)


@query("neighbourhood_siblings", "N1", """
    WITH both_ways AS (SELECT atom_a_id AS id, atom_b_id AS n FROM v_edges UNION SELECT atom_b_id, atom_a_id FROM v_edges),
    start AS (SELECT id, category_slug FROM v_atoms WHERE text_lower = 'red bolt'),
    one AS (SELECT DISTINCT s.id AS start_id, b.n AS id FROM start s JOIN both_ways b ON s.id = b.id WHERE b.n <> s.id),
    reached AS (SELECT id AS start_id, id, 0 AS hops FROM start UNION ALL SELECT start_id, id, 1 FROM one)
    SELECT * FROM reached UNION ALL SELECT s.id, a.id, NULL FROM start s JOIN v_atoms a ON a.category_slug = s.category_slug
    WHERE (s.id, a.id) NOT IN (SELECT (start_id, id) FROM reached)""")
def neighbourhood_siblings(t: Inputs):
    return au.neighbourhood(t.v_edges, t.v_atoms.filter(F.col("text_lower") == "red bolt"), 1, t.v_atoms.select("id", "category_slug"))


# --- lifecycle ------------------------------------------------------------


@query("encounter", "L1", """
    WITH s AS (SELECT 'a' || user_id AS id, count(*) AS seen FROM events GROUP BY 1)
    SELECT a.id, encounter_count + coalesce(seen, 0) AS encounter_count,
      CASE WHEN status = 'provisional' AND seen IS NOT NULL AND encounter_count + seen >= 3 THEN 'confirmed' ELSE status END AS status,
      status = 'provisional' AND seen IS NOT NULL AND encounter_count + coalesce(seen, 0) >= 3 AS confirmed_now
    FROM v_atoms a LEFT JOIN s ON a.id = s.id""")
def encounter(t: Inputs):
    seen = t.events.select(F.concat(F.lit("a"), "user_id").alias("atom_id"))
    return lc.encounter(t.v_atoms, seen).select("id", "encounter_count", "status", "confirmed_now")


@query("promote", "L2", """
    SELECT id, CASE WHEN status = 'provisional' AND category_slug IS NOT NULL AND embedding_status = 'complete' AND tag_version > 0
                    THEN 'confirmed' ELSE status END AS status
    FROM (SELECT id, status, category_slug, tag_version, CASE WHEN weight > 0.5 THEN 'complete' ELSE embedding_status END AS embedding_status FROM v_atoms)""")
def promote(t: Inputs):
    rows = t.v_atoms.withColumn("embedding_status", F.when(F.col("weight") > 0.5, "complete").otherwise(F.col("embedding_status")))
    return lc.promote(rows).select("id", "status")


@query("recalculate_tiers", "L3", """
    SELECT id, tier, CASE WHEN id IN (SELECT atom_a_id FROM v_edges UNION SELECT atom_b_id FROM v_edges)
      THEN CASE WHEN id IN (SELECT 'a' || l_partkey FROM lineitem) THEN 1 ELSE 2 END ELSE 3 END AS new_tier
    FROM v_atoms WHERE status = 'confirmed'""")
def recalculate_tiers(t: Inputs):
    shown = t.lineitem.select(F.concat(F.lit("a"), "l_partkey").alias("atom_id"))
    out = lc.recalculate_tiers(t.v_atoms, t.v_edges, shown)
    return out.select("id", "tier", "new_tier")


@query("mark_enriched", "L4", f"""
    WITH {DEGREE}
    SELECT v.id, CASE WHEN category_slug IS NOT NULL AND embedding_status = 'complete' AND tag_version > 0 AND register IS NOT NULL
                      AND coalesce(degree, 0) > 0 THEN '2024-03-01 00:00:00' END AS fully_enriched_at
    FROM v_atoms v LEFT JOIN deg ON v.id = deg.id""")
def mark_enriched(t: Inputs):
    rows = with_degree(t).withColumn("fully_enriched_at", F.lit(None).cast("timestamp"))
    out = lc.mark_enriched(rows, ts("2024-03-01"))
    return out.select("id", F.date_format("fully_enriched_at", "yyyy-MM-dd HH:mm:ss").alias("fully_enriched_at"))


@query("prune_edges", "L5", """
    SELECT provenance, relationship_type, count(*) AS n FROM v_edges
    WHERE NOT (provenance = 'semantic' AND strength < 0.5 AND last_reinforced_at < TIMESTAMP '2000-01-01' - INTERVAL 90 DAY) GROUP BY 1, 2""")
def prune_edges(t: Inputs):
    return lc.prune_edges(t.v_edges, ts("2000-01-01")).groupBy("provenance", "relationship_type").agg(F.count("*").alias("n"))


@query("purge_provenance", "L5", "SELECT count(*) AS n FROM v_edges WHERE provenance <> 'semantic'")
def purge_provenance(t: Inputs):
    return lc.purge_provenance(t.v_edges).agg(F.count("*").alias("n"))


@query("retention", "L6", """
    SELECT 'execution_log' AS table_name, count(*) AS n FROM v_runs WHERE completed_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY
    UNION ALL SELECT 'scans', count(*) FROM v_runs WHERE completed_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 14 DAY
    UNION ALL SELECT 'quality_gate_log', count(*) FROM v_gate_log WHERE checked_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 DAY""")
def retention(t: Inputs):
    parts = [("execution_log", t.v_runs, "completed_at"), ("scans", t.v_runs, "completed_at"), ("quality_gate_log", t.v_gate_log, "checked_at")]
    rows = [
        lc.retention(df, name, c, ts(AS_OF)).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df, c in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("purge_sessions", "L7", """
    WITH anon AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    stale AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01' - INTERVAL 30 DAY AND o_custkey IN (SELECT * FROM anon)),
    kept AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stale))
    SELECT 'conversations' AS table_name, count(*) AS n FROM kept
    UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM stale)
    UNION ALL SELECT 'feedback', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM stale)
    UNION ALL SELECT 'users', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM stale WHERE o_custkey NOT IN (SELECT o_custkey FROM kept))""")
def purge_sessions(t: Inputs):
    conversations = t.orders.select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"))
    messages = t.lineitem.select(F.col("l_orderkey").alias("conversation_id"), "l_returnflag")
    users = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_mktsegment") == "BUILDING").alias("anonymous"))
    out = lc.purge_sessions(conversations, messages, messages.filter(F.col("l_returnflag") == "R"), users, ts("1999-06-01"))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("stale_vectors", "L9", "SELECT id FROM v_vectors WHERE id IN (SELECT id FROM v_atoms WHERE status = 'rejected')")
def stale_vectors(t: Inputs):
    return lc.stale_vectors(t.v_atoms, t.v_vectors).select("id")


@query("collection_tree", "L10", """
    WITH RECURSIVE tree AS (
      SELECT slug, slug AS path, 0 AS depth FROM v_collections WHERE parent_slug IS NULL OR parent_slug NOT IN (SELECT slug FROM v_collections)
      UNION ALL SELECT c.slug, t.path || '/' || c.slug, t.depth + 1 FROM v_collections c JOIN tree t ON c.parent_slug = t.slug)
    SELECT slug, path, depth FROM tree""")
def collection_tree(t: Inputs):
    return lc.collection_tree(t.v_collections)


@query("creators", "L11", """
    WITH r AS (SELECT l_orderkey AS film_id, 'Supplier ' || l_suppkey AS name, CASE l_linenumber WHEN 1 THEN 'director' ELSE 'cast' END AS role FROM lineitem)
    SELECT sha256(lower(name) || '|' || role) AS creator_id, min(name) AS name, min(role) AS role, count(DISTINCT film_id) AS films FROM r GROUP BY 1""")
def creators(t: Inputs):
    person = F.struct(F.concat(F.lit(" Supplier "), "l_suppkey").alias("name"), F.when(F.col("l_linenumber") == 1, "director").otherwise("cast").alias("role"))
    # people are grouped, and links told apart, in the tasks to which their film is dealt
    lines = t.lineitem.repartition(tasks_for(t.lineitem), "l_orderkey")
    films = lines.groupBy(F.col("l_orderkey").alias("film_id")).agg(F.collect_list(person).alias("people"))
    people, links = lc.creators(films)
    return people.join(links.groupBy("creator_id").agg(F.count("*").alias("films")), "creator_id")
