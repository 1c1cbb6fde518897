"""Term filters, look-ups and screening on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.maths import sigmoid
from lexweave.functions.text import slugify
from lexweave.operators import joins, predicates as pr, screening as sc
from lexweave.plans.registry import Inputs, query
from lexweave.plans.views import VIEWS

VIEWS.update(
    {
        # texts of every length: part names, messages and documents
        "v_texts": """
            SELECT 'p' || p_partkey AS text_id, p_name AS text, 'line.' || lower(p_type) AS category FROM {part}
            UNION ALL
            SELECT 'd' || doc_id AS text_id, text, CASE lang WHEN 'en' THEN 'narrative.scene' WHEN 'fr' THEN 'style.aesthetic'
                   WHEN 'de' THEN 'reference.person' ELSE NULL END AS category FROM {documents}
            UNION ALL
            SELECT 'n' || n_nationkey AS text_id, substr(n_name, 8) AS text, NULL AS category FROM {nation}
            UNION ALL
            SELECT 'c' || conv_id || '-' || turn AS text_id, text, 'covering.' || role AS category FROM {conversations}""",
        "v_films": """
            SELECT o_orderkey AS film_id, 'Film ' || o_orderkey AS title,
                   CASE o_orderpriority WHEN '1-URGENT' THEN 'Horror, Drama' WHEN '2-HIGH' THEN 'Comedy'
                        WHEN '3-MEDIUM' THEN 'Science Fiction' ELSE 'Romance' END AS genres,
                   (CAST(extract(year FROM o_orderdate) AS int) - 27) || '-01-02' AS release_date,
                   'Customer#' || o_custkey AS director, CAST(o_totalprice * 110 AS double) AS budget,
                   CAST(o_totalprice * 300 AS double) AS revenue, o_orderstatus AS overview
            FROM {orders}""",
        "v_directors": "SELECT 'Customer#' || c_custkey AS name FROM {customer} WHERE c_acctbal > 9000",
        "v_behaviours": """
            SELECT CASE p_size WHEN 1 THEN 'acme' ELSE 'other' END AS provider,
                   CASE WHEN p_type IN ('SMALL', 'LARGE') THEN NULL ELSE 'a' || p_partkey END AS atom_id,
                   CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'line.' || lower(p_type) ELSE NULL END AS atom_category,
                   'note ' || p_brand AS behavior,
                   CASE WHEN p_brand < 'Brand#2' THEN NULL ELSE 'photo' END AS render_mode,
                   CASE WHEN p_type = 'PROMO' THEN 'breaking' WHEN p_type = 'LARGE' THEN 'info' ELSE 'warning' END AS severity
            FROM {part}""",
    }
)

REASON = r"""
    CASE WHEN length(t) < 3 THEN 'too_short' WHEN length(t) > 80 THEN 'too_long'
         WHEN starts_with(t, '#') OR starts_with(t, '//') OR starts_with(t, '--') THEN 'comment'
         WHEN contains(t, chr(10)) THEN 'multiline'
         WHEN len(regexp_split_to_array(t, '\s+')) > 6 THEN 'too_many_words'
         WHEN regexp_matches(t, '(?i)^:[a-z<>()3dp]{1,2}$') THEN 'emoticon'
         WHEN regexp_matches(t, '^[^A-Za-z_]+$') THEN 'non_text'
         WHEN regexp_matches(t, '(?i)stock photo|clip ?art|vector illustration') THEN 'stock_caption'
         ELSE 'valid' END"""


@query("validate_atoms", "F5", f"SELECT text_id, {REASON} AS reason FROM (SELECT text_id, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS t FROM v_texts)")
def validate_atoms(t: Inputs):
    return pr.validate_atoms(t.v_texts).select("text_id", "reason")


@query("route_content", "F6", f"""
    WITH r AS (SELECT text_id, t, coalesce(category, '') AS c, {REASON} AS reason
               FROM (SELECT text_id, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS t, category FROM v_texts)),
    d AS (SELECT *, CASE WHEN reason = 'valid' THEN 'atom'
                         WHEN reason IN ('emoticon','non_text','stock_caption','comment','too_short') THEN 'reject'
                         ELSE 'document_chunk' END AS destination FROM r)
    SELECT text_id, destination,
      CASE destination WHEN 'atom' THEN 'valid_atom' WHEN 'reject' THEN reason ELSE reason || '_routed' END AS reason,
      CASE WHEN destination = 'document_chunk' THEN
        CASE WHEN ends_with(c, '.aesthetic') THEN 'Aesthetic Definitions'
             WHEN contains(t, '__') AND contains(t, '/') THEN 'Art and Reference Taxonomy'
             WHEN starts_with(c, 'reference.') THEN 'Character Briefs Collection'
             WHEN starts_with(c, 'narrative.') THEN 'Scene Compositions'
             WHEN starts_with(c, 'environment.') THEN 'Setting and Environment Descriptions'
             WHEN starts_with(c, 'covering.') THEN 'Costume and Outfit Descriptions'
             ELSE 'Uncategorized Knowledge' END END AS document
    FROM d""")
def route_content(t: Inputs):
    return pr.route_content(t.v_texts).select("text_id", "destination", "reason", "document")


@query("generic_terms", "F7", """
    SELECT text_id, lower(trim(text)) IN (
      'prominent', 'beautiful', 'large', 'nice', 'good', 'bad', 'small', 'big', 'pretty', 'ugly', 'simple', 'complex',
      'detailed', 'amazing', 'interesting', 'cool', 'awesome', 'realistic', 'perfect', 'great', 'fine', 'strong', 'weak',
      'normal', 'regular', 'basic', 'standard', 'typical', 'high', 'low', 'medium', 'long', 'short', 'wide', 'narrow') AS is_generic
    FROM (SELECT text_id, text FROM v_texts UNION ALL SELECT 't' || p_partkey, p_type FROM part)""")
def generic_terms(t: Inputs):
    types = t.part.select(F.concat(F.lit("t"), "p_partkey").alias("text_id"), F.col("p_type").alias("text"))
    return t.v_texts.select("text_id", "text").unionByName(types).select("text_id", pr.is_generic("text").alias("is_generic"))


@query("list_atoms", "F1", """
    SELECT id, text, status FROM v_atoms WHERE status = 'confirmed' AND source = 'manual' AND contains(text_lower, 'ri')
    ORDER BY created_at DESC, id LIMIT 40 OFFSET 10""")
def list_atoms(t: Inputs):
    page, _ = pr.list_atoms(t.v_atoms, status="confirmed", source="manual", q=" RI", limit=40, offset=10)
    return page.select("id", "text", "status")


@query("list_atoms_totals", "F1", """
    SELECT count(*) AS total, count(*) FILTER (id > 'a5') AS total_after
    FROM v_atoms WHERE status = 'confirmed' AND source_app = 'app-promo'""")
def list_atoms_totals(t: Inputs):
    return pr.list_atoms(t.v_atoms, status="confirmed", source_app="app-promo", after="a5")[1]


@query("filter_atoms", "F2 X1", """
    SELECT id FROM v_atoms WHERE status <> 'rejected' AND length(text_lower) > 6 AND length(text_lower) <= 12
      AND category_slug ILIKE 'LINE.%' AND text_lower NOT IN ('red bolt', 'hot ring') AND text_lower GLOB '*[rs]in?*'
      AND text ILIKE '%r%'""")
def filter_atoms(t: Inputs):
    spec = pr.AtomFilter(
        min_length=6, max_length=12, category_like="LINE.%", text_not_in=["red bolt", "hot ring"],
        text_glob="*[rs]in?*", text_pattern="%R%",
    )
    return pr.filter_atoms(t.v_atoms, spec).select("id")


@query("category_patterns", "F3", """
    SELECT slug, CASE WHEN slug = 'line.promo' THEN 0 WHEN parent = 'region' THEN 1 WHEN parent = 'line' THEN 2 END AS place
    FROM v_categories WHERE slug = 'line.promo' OR parent IN ('region', 'line')""")
def category_patterns(t: Inputs):
    return pr.resolve_category_patterns(t.v_categories, ["line.promo", "region.*", "line.*"]).select("slug", "place")


@query("list_categories", "F4", "SELECT slug, label FROM v_categories WHERE parent = 'size'")
def list_categories(t: Inputs):
    return pr.list_categories(t.v_categories, "size").select("slug", "label")


@query("category_contexts", "F4", "SELECT context, guidance FROM v_category_contexts WHERE category_slug = 'size.small'")
def category_contexts(t: Inputs):
    return pr.category_contexts(t.v_category_contexts, "size.small").select("context", "guidance")


@query("contexts_for_categories", "J16", """
    SELECT category_slug, context, guidance FROM v_category_contexts
    WHERE context IN ('F', 'default') AND category_slug IN (SELECT slug FROM v_categories WHERE parent <> 'region')""")
def contexts_for_categories(t: Inputs):
    slugs = t.v_categories.filter(F.col("parent") != "region")
    return pr.contexts_for_categories(t.v_category_contexts, slugs, ["F"]).select("category_slug", "context", "guidance")


DEGREE = """
    deg AS (SELECT id, count(*) AS degree FROM (
      SELECT atom_a_id AS id FROM v_edges WHERE provenance = 'semantic'
      UNION ALL SELECT atom_b_id FROM v_edges WHERE provenance = 'semantic') GROUP BY id)"""


def with_degree(t: Inputs):
    from lexweave.operators.edges import edge_degree

    degree = edge_degree(t.v_edges)
    return t.v_atoms.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


@query("pending_chunks", "F8", "SELECT chunk_id AS id, 'vectorize_chunks' AS phase FROM v_chunks WHERE n_chars % 3 = 0")
def pending_chunks(t: Inputs):
    state = F.when(F.col("n_chars") % 3 == 0, "pending").otherwise("complete")
    return pr.pending_chunks(t.v_chunks.withColumn("embedding_status", state))


@query("slugs", "X1", r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents""")
def slugs(t: Inputs):
    return t.documents.select("doc_id", F.sha2(slugify("text"), 256).alias("slug"))


@query("reranked_scores", "X5", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 25)), 9) AS score FROM events")
def reranked_scores(t: Inputs):
    return t.events.select("event_id", F.round(sigmoid((F.col("value") - 50) / 25), 9).alias("score"))


@query("phase_candidates", "F8 X6", f"""
    WITH {DEGREE},
    a AS (SELECT v.*, coalesce(degree, 0) AS degree FROM v_atoms v LEFT JOIN deg ON v.id = deg.id
          WHERE last_enqueued_at IS NULL OR last_enqueued_at < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 MINUTE)
    SELECT id, 'classify' AS phase FROM a WHERE category_slug IS NULL
    UNION ALL SELECT id, 'vectorize' FROM a WHERE embedding_status = 'pending' AND category_slug IS NOT NULL
    UNION ALL SELECT id, 'tagging' FROM a WHERE category_slug IS NOT NULL AND tag_version < 30 AND status <> 'rejected'
    UNION ALL SELECT id, 'register' FROM a WHERE category_slug IS NOT NULL AND register IS NULL
    UNION ALL SELECT id, 'correspondences' FROM a WHERE degree = 0 AND embedding_status = 'complete' AND category_slug IS NOT NULL""")
def phase_candidates(t: Inputs):
    return pr.phase_candidates(with_degree(t), F.lit("2024-03-01").cast("timestamp"))


@query("review_queue", "F9", """
    SELECT id, encounter_count FROM v_atoms WHERE status = 'provisional'
    ORDER BY encounter_count DESC, created_at, id LIMIT 50""")
def review_queue(t: Inputs):
    return pr.review_queue(t.v_atoms).select("id", "encounter_count")


@query("list_candidates", "F10", """
    SELECT source_url, count(*) AS candidates, count(*) FILTER (candidate_type = 'atom') AS atoms, max(conf) AS best_confidence
    FROM (SELECT 'src-' || user_id AS source_url, CASE WHEN value > 3 THEN 'atom' ELSE 'correspondence' END AS candidate_type,
                 CASE WHEN value > 3 THEN round(value / 500, 4) END AS conf
          FROM events WHERE event_type IN ('view', 'click'))
    WHERE candidate_type <> 'atom' OR conf >= 0.05 GROUP BY 1""")
def list_candidates(t: Inputs):
    ev = t.events
    payload = F.to_json(F.struct(F.col("event_type").alias("name"), F.when(F.col("value") > 3, F.round(F.col("value") / 500, 4)).alias("confidence")))
    rows = ev.select(
        F.concat(F.lit("src-"), "user_id").alias("source_url"),
        F.when(F.col("value") > 3, "atom").otherwise("correspondence").alias("candidate_type"),
        payload.alias("candidate_data"),
        F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("approved").alias("status"),
    )
    return pr.candidates_by_source(pr.list_candidates(rows, min_confidence=0.05))


@query("filter_films", "F11", """
    SELECT film_id, CASE WHEN genres IN ('Horror, Drama', 'Science Fiction') THEN 'genre'
             WHEN CAST(split_part(release_date, '-', 1) AS INT) < 1970 THEN 'year'
             WHEN director IN (SELECT name FROM v_directors) THEN 'director'
             WHEN budget >= 50000000 OR revenue >= 200000000 THEN 'budget_revenue' END AS filter_reason
    FROM v_films WHERE filter_reason IS NOT NULL""")
def filter_films(t: Inputs):
    return sc.filter_films(t.v_films, t.v_directors).select("film_id", "filter_reason")


@query("film_filter_stats", "F11", """
    WITH f AS (SELECT genres IN ('Horror, Drama', 'Science Fiction') AS g, CAST(split_part(release_date, '-', 1) AS INT) < 1970 AS y,
       director IN (SELECT name FROM v_directors) AS d, budget >= 50000000 OR revenue >= 200000000 AS b FROM v_films)
    SELECT count(*) AS total, count(*) FILTER (g) AS genre, count(*) FILTER (y) AS year, count(*) FILTER (d) AS director,
           0 AS overview, count(*) FILTER (b) AS budget, count(*) FILTER (g OR y OR d OR b) AS passed FROM f""")
def film_filter_stats(t: Inputs):
    return sc.film_filter_stats(sc.film_flags(t.v_films, t.v_directors))


@query("filter_terms", "F12", """
    SELECT text_id FROM v_texts WHERE length(text) BETWEEN 3 AND 80
      AND NOT contains(lower(text), 'acting') AND NOT contains(lower(text), 'ring') AND NOT contains(lower(text), 'blue')""")
def filter_terms(t: Inputs):
    return sc.filter_terms(t.v_texts, "text", ["acting", "ring", "blue"]).select("text_id")


@query("filter_image_posts", "F13", r"""
    WITH p AS (
      SELECT page_id, CASE WHEN length(html) < 6000 THEN 'image' ELSE 'link' END AS hint,
             CASE WHEN contains(html, '<table') THEN true ELSE false END AS gallery,
             CASE WHEN contains(url, '?') THEN url ELSE url || '.JPG' END AS url,
             CASE WHEN contains(url, '#') THEN 'moderator' END AS removed_by FROM pages)
    SELECT page_id FROM p WHERE NOT gallery AND removed_by IS NULL
      AND (hint = 'image' OR regexp_matches(url, '(?i)\.(jpg|jpeg|png|webp|gif)$'))""")
def filter_image_posts(t: Inputs):
    f = F.lit(False)
    posts = t.pages.select(
        "page_id",
        F.when(F.length("html") < 6000, "image").otherwise("link").alias("post_hint"),
        F.contains("html", F.lit("<table")).alias("is_gallery"),
        f.alias("is_video"), f.alias("over_18"), f.alias("stickied"),
        F.when(F.contains("url", F.lit("?")), F.col("url")).otherwise(F.concat("url", F.lit(".JPG"))).alias("url"),
        F.when(F.contains("url", F.lit("#")), "moderator").alias("removed_by"),
    )
    return sc.filter_image_posts(posts).select("page_id")


@query("valid_page_titles", "F14", """
    SELECT page_id, title FROM (
      SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'List of ' ELSE '' END ||
             regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    WHERE NOT contains(title, 'List of') AND NOT ends_with(title, '(disambiguation)')
      AND NOT regexp_matches(title, '^(Template|User|Category|File|Help|Special|MediaWiki|Module|Portal):')""")
def valid_page_titles(t: Inputs):
    title = F.concat(
        F.when(F.contains("url", F.lit("/fr/")), "List of ").otherwise(""),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1),
    )
    return sc.valid_page_titles(t.pages.select("page_id", title.alias("title")))


@query("harmonic_range", "F15", """
    SELECT id, 'low' AS "end", weight AS value FROM v_atoms WHERE weight <= 0.5 AND status <> 'rejected' AND category_slug LIKE 'line.%'
    UNION ALL
    SELECT id, 'high', weight FROM v_atoms WHERE weight >= 0.75 AND status <> 'rejected' AND category_slug LIKE 'line.%'""")
def harmonic_range(t: Inputs):
    cats = ["line.economy", "line.promo", "line.standard"]
    return pr.harmonic_range(t.v_atoms, "weight", 0.5, 0.75, cats).select("id", "end", "value")


@query("signals_by_topic", "F16", """
    SELECT signal_id, topic, subreddit, intensity FROM v_signals WHERE topic ILIKE '%CLI%' AND scan_date >= DATE '2024-01-30' - 7
    ORDER BY scan_date DESC, intensity DESC, signal_id LIMIT 100""")
def signals_by_topic(t: Inputs):
    out = pr.recent_signals(t.v_signals, F.lit("2024-01-30").cast("date"), topic_like="CLI")
    return out.select("signal_id", "topic", "subreddit", "intensity")


@query("signals_by_subreddit", "F16", """
    SELECT signal_id, topic, intensity FROM v_signals WHERE subreddit = 'sub-7' AND scan_date >= DATE '2024-01-30' - 14
    ORDER BY scan_date DESC, intensity DESC, signal_id LIMIT 100""")
def signals_by_subreddit(t: Inputs):
    out = pr.recent_signals(t.v_signals, F.lit("2024-01-30").cast("date"), subreddit="sub-7", days=14)
    return out.select("signal_id", "topic", "intensity")


@query("block_quality", "F17", r"""
    WITH x AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS lines FROM documents),
    y AS (SELECT *, len(lines) AS n, len(regexp_split_to_array(text, '\s+')) AS w FROM x)
    SELECT doc_id,
      n > 5 AND len(regexp_replace(text, '\S', '', 'g')) / length(text) > 0.6
        AND len(list_filter(lines, lambda s: length(trim(s)) >= 80)) = 0 AS infobox,
      n > 0 AND len(list_filter(lines, lambda s: regexp_matches(s, '[.?!]') OR length(trim(s)) > 80)) / n >= 0.3
        AND NOT (list_sum(list_transform(lines, lambda s: length(trim(s)))) / n < 50 AND n > 5) AS prose,
      w >= 10 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: regexp_matches(s, '^\d+[.,\-]*$'))) / w > 0.4 AS index_page
    FROM y""")
def block_quality(t: Inputs):
    return t.documents.select(
        "doc_id", sc.is_infobox("text").alias("infobox"), sc.is_prose("text").alias("prose"), sc.is_index_page("text").alias("index_page")
    )


@query("validate_posts", "F18", r"""
    SELECT conv_id, turn, concat_ws('|', CASE WHEN length(text) > 280 THEN 'text_too_long' END,
      CASE WHEN length(text) < 20 THEN 'text_too_short' END,
      CASE WHEN regexp_matches(lower(text), 'as an ai|as a language model|i cannot|i''m sorry, but|it''s important to note|in conclusion|let me help you|here''s a|here is a|delve into|it is worth noting|certainly!|absolutely!|great question') THEN 'banned_phrase' END,
      CASE WHEN len(regexp_extract_all(text, '#\w+')) > 2 THEN 'too_many_hashtags' END,
      CASE WHEN contains(text, '—') OR contains(text, '–') THEN 'dash' END,
      CASE WHEN length(role) < 10 THEN 'alt_text' END) AS errors
    FROM conversations""")
def validate_posts(t: Inputs):
    out = sc.validate_posts(t.conversations.withColumn("alt_text", F.col("role")))
    return out.select("conv_id", "turn", F.array_join("errors", "|").alias("errors"))


@query("validate_articles", "F18", r"""
    WITH a AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source || '_' || lang AS slug, text AS excerpt, text AS body_md, lang AS hero FROM documents)
    SELECT doc_id, concat_ws('|', CASE WHEN title = '' THEN 'title_required' END,
      CASE WHEN excerpt = '' THEN 'excerpt_required' END, CASE WHEN body_md = '' THEN 'body_md_required' END,
      CASE WHEN title <> '' AND length(title) NOT BETWEEN 10 AND 100 THEN 'title_length' END,
      CASE WHEN excerpt <> '' AND length(excerpt) NOT BETWEEN 50 AND 200 THEN 'excerpt_length' END,
      CASE WHEN body_md <> '' AND length(body_md) NOT BETWEEN 200 AND 5000 THEN 'body_length' END,
      'slug_format',
      CASE WHEN regexp_matches(lower(body_md), 'in conclusion|to summarize|in summary|let''s dive in|without further ado|let''s explore|it''s worth noting|it should be noted|needless to say|at the end of the day|when all is said and done|game-changer|revolutionary|cutting-edge|groundbreaking|leverage|utilize|synergy|ecosystem|in today''s world|in the digital age|as we all know|going forward|moving forward') THEN 'banned_phrase' END) AS errors
    FROM a""")
def validate_articles(t: Inputs):
    rows = t.documents.select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat_ws("_", "source", "lang").alias("slug"),
        F.col("text").alias("excerpt"), F.col("text").alias("body_md"), F.array("lang").alias("tags"),
        F.col("lang").alias("hero_direction"),
    )
    return sc.validate_articles(rows).select("doc_id", F.array_join("errors", "|").alias("errors"))


@query("missing_terms", "F19 J2", """
    SELECT DISTINCT lower(trim(text)) AS text_lower FROM v_texts
    WHERE lower(trim(text)) NOT IN (SELECT text_lower FROM v_atoms)""")
def missing_terms(t: Inputs):
    return pr.missing_terms(t.v_texts, t.v_atoms).select("text_lower").distinct()


@query("lookup_exact", "J1", """
    WITH best AS (SELECT text_lower, arg_min(id, (CASE WHEN collection_slug = 'brand-7' THEN 0 ELSE 1 END, id)) AS atom_id
                  FROM v_atoms GROUP BY 1)
    SELECT text_id, atom_id FROM v_texts LEFT JOIN best ON lower(trim(text)) = text_lower""")
def lookup_exact(t: Inputs):
    return joins.lookup_exact(t.v_texts, t.v_atoms, text="text", prefer_collection="brand-7").select("text_id", "atom_id")


@query("existing_terms", "J2", """
    SELECT 'known' AS side, count(*) AS n FROM v_texts WHERE lower(trim(text)) IN (SELECT text_lower FROM v_atoms)
    UNION ALL SELECT 'new', count(*) FROM v_texts WHERE lower(trim(text)) NOT IN (SELECT text_lower FROM v_atoms)""")
def existing_terms(t: Inputs):
    known, new = joins.existing_terms(t.v_texts, t.v_atoms, "text")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(known, "known").unionByName(count(new, "new"))


@query("orphan_edges", "J4", """
    SELECT atom_a_id, atom_b_id, relationship_type, arrangement_scope FROM v_edges
    WHERE atom_a_id NOT IN (SELECT id FROM v_atoms WHERE status <> 'rejected')
       OR atom_b_id NOT IN (SELECT id FROM v_atoms WHERE status <> 'rejected')""")
def orphan_edges(t: Inputs):
    live = t.v_atoms.filter(F.col("status") != "rejected")
    return joins.orphan_edges(t.v_edges, live).select("atom_a_id", "atom_b_id", "relationship_type", "arrangement_scope")


@query("ungraphed_atoms", "J5", """
    SELECT id FROM v_atoms WHERE embedding_status = 'complete' AND status <> 'rejected'
      AND id NOT IN (SELECT atom_a_id FROM v_edges WHERE strength = 1 AND provenance = 'semantic'
                     UNION SELECT atom_b_id FROM v_edges WHERE strength = 1 AND provenance = 'semantic')""")
def ungraphed_atoms(t: Inputs):
    # the other edges stand under other ids, so that their terms count as without one
    strong = (F.col("strength") == 1) & (F.col("provenance") == "semantic")
    ends = [F.when(strong, F.col(c)).otherwise(F.concat(F.lit("x-"), c)).alias(c) for c in ("atom_a_id", "atom_b_id")]
    return joins.ungraphed_atoms(t.v_atoms, t.v_edges.select(*ends)).select("id")


@query("bad_category", "J6", """
    SELECT id, category_slug FROM v_atoms WHERE category_slug IS NOT NULL AND category_slug NOT IN (SELECT slug FROM v_categories)""")
def bad_category(t: Inputs):
    return joins.dangling_reference(t.v_atoms, "category_slug", t.v_categories).select("id", "category_slug")


@query("empty_categories", "J7", "SELECT slug FROM v_categories WHERE slug NOT IN (SELECT category_slug FROM v_atoms WHERE category_slug IS NOT NULL)")
def empty_categories(t: Inputs):
    return joins.empty_categories(t.v_categories, t.v_atoms).select("slug")


def weighted_arrangements(t: Inputs):
    weights = t.v_arrangement_weights.groupBy("slug").agg(
        F.map_from_entries(F.collect_list(F.struct("category_slug", "weight"))).alias("category_weights")
    )
    return t.v_arrangements.join(weights, "slug")


@query("arrangement_missing_category", "J8", """
    SELECT slug, category_slug FROM v_arrangement_weights WHERE category_slug NOT IN (SELECT slug FROM v_categories)""")
def arrangement_missing_category(t: Inputs):
    return joins.arrangement_missing_category(weighted_arrangements(t), t.v_categories)


@query("routing_for_app", "J10", """
    SELECT r.atom_id, r.routing, a.text FROM (SELECT DISTINCT 'a' || l_partkey AS atom_id, 'app-' || l_linestatus AS app,
      CASE l_returnflag WHEN 'R' THEN 'negative' ELSE 'positive' END AS routing FROM lineitem) r
    JOIN v_atoms a ON a.id = r.atom_id WHERE r.app = 'app-F'""")
def routing_for_app(t: Inputs):
    routing = t.lineitem.select(
        F.concat(F.lit("a"), "l_partkey").alias("atom_id"), F.concat(F.lit("app-"), "l_linestatus").alias("app"),
        F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("routing"),
    ).distinct()
    return joins.routing_for_app(routing, t.v_atoms, "app-F").select("atom_id", "routing", "text")


BOTH_WAYS = """
    ends AS (SELECT source_atom_id AS atom_id, target_atom_id AS partner_id, relation_type, context, strength, confidence FROM v_relations
             UNION ALL SELECT target_atom_id, source_atom_id, relation_type, context, strength, confidence FROM v_relations)"""


@query("compositional_partners", "J11", f"""
    WITH {BOTH_WAYS}
    SELECT atom_id, partner_id, a.text AS partner_text, strength, ends.confidence,
           row_number() OVER (PARTITION BY atom_id ORDER BY strength DESC, ends.confidence DESC, partner_id, coalesce(context, '')) AS place
    FROM ends JOIN v_atoms a ON a.id = partner_id
    WHERE relation_type = 'compositional' AND (context IS NULL OR context = 'ctx-3')
      AND atom_id IN (SELECT id FROM v_atoms WHERE status = 'confirmed') QUALIFY place <= 10""")
def compositional_partners(t: Inputs):
    live = t.v_atoms.filter(F.col("status") == "confirmed")
    out = joins.compositional_partners(t.v_relations, t.v_atoms, live, context="ctx-3")
    return out.select("atom_id", "partner_id", "partner_text", "strength", "confidence", "place")


@query("oppositional_atoms", "J12", f"""
    WITH {BOTH_WAYS}
    SELECT atom_id, partner_id, a.text AS partner_text, strength, ends.confidence FROM ends JOIN v_atoms a ON a.id = partner_id
    WHERE relation_type = 'oppositional' AND context IS NULL""")
def oppositional_atoms(t: Inputs):
    out = joins.oppositional_atoms(t.v_relations, t.v_atoms, t.v_atoms)
    return out.select("atom_id", "partner_id", "partner_text", "strength", "confidence")


@query("provider_warnings", "J13", """
    SELECT a.id AS pick_id, b.behavior, b.severity, CASE b.severity WHEN 'breaking' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank
    FROM v_atoms a JOIN v_behaviours b
      ON (b.atom_id IS NULL OR b.atom_id = a.id) AND (b.atom_category IS NULL OR b.atom_category = a.category_slug)
    WHERE b.provider = 'acme' AND (b.render_mode IS NULL OR b.render_mode = 'photo')""")
def provider_warnings(t: Inputs):
    picks = t.v_atoms.select(F.col("id").alias("atom_id"), "category_slug")
    return joins.provider_warnings(picks, t.v_behaviours, "acme", "photo").select("pick_id", "behavior", "severity", "severity_rank")


@query("opposition_pairs", "J14", """
    SELECT atom_a_id, atom_b_id, arrangement_scope, a.text AS text_a, b.text AS text_b
    FROM v_edges JOIN v_atoms a ON a.id = atom_a_id JOIN v_atoms b ON b.id = atom_b_id
    WHERE relationship_type = 'opposes' AND a.status = 'confirmed' AND b.status = 'confirmed'""")
def opposition_pairs(t: Inputs):
    out = joins.opposition_pairs(t.v_atoms.filter(F.col("status") == "confirmed"), t.v_edges, t.v_atoms)
    return out.select("atom_a_id", "atom_b_id", "arrangement_scope", "text_a", "text_b")


@query("match_reviews", "J15", """
    WITH r AS (SELECT conv_id || '-' || turn AS review_id, 'src' || turn AS key_one, role AS key_two, text FROM conversations),
    one AS (SELECT source AS key_one, 'film-' || source AS by_one FROM documents GROUP BY source),
    two AS (SELECT 'user' AS key_two, min('lang-' || lang) AS by_two FROM documents),
    m AS (SELECT review_id, coalesce(by_one, by_two) AS source_id, text FROM r LEFT JOIN one USING (key_one) LEFT JOIN two USING (key_two)
          WHERE length(text) >= 100)
    SELECT review_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY review_id) AS place, left(text, 2000) AS text
    FROM m WHERE source_id IS NOT NULL QUALIFY place <= 5""")
def match_reviews(t: Inputs):
    reviews = t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("review_id"), F.concat(F.lit("src"), "turn").alias("key_one"),
        F.col("role").alias("key_two"), "text",
    )
    none = F.lit(None).cast("string")
    sources = t.documents.select(F.concat(F.lit("film-"), "source").alias("source_id"), F.col("source").alias("key_one"), none.alias("key_two")).distinct().unionByName(
        t.documents.select(F.concat(F.lit("lang-"), "lang").alias("source_id"), none.alias("key_one"), F.lit("user").alias("key_two")).distinct()
    )
    return joins.match_reviews(reviews, sources)


@query("relations_touching", "J17", """
    SELECT source_slug, target_slug, relation FROM v_category_relations
    WHERE source_slug IN (SELECT slug FROM v_categories WHERE label < 'D') OR target_slug IN (SELECT slug FROM v_categories WHERE label < 'D')""")
def relations_touching(t: Inputs):
    return joins.relations_touching(t.v_category_relations, t.v_categories.filter(F.col("label") < "D"))


@query("resolve_edge_names", "J20", """
    WITH best AS (SELECT text_lower, min(id) AS id FROM v_atoms GROUP BY 1),
    c AS (SELECT text_id, text AS source_name, category AS target_name FROM v_texts)
    SELECT text_id, s.id AS source_id, g.id AS target_id,
      CASE WHEN s.id IS NULL AND g.id IS NULL THEN 'both_unknown' WHEN s.id IS NULL THEN 'source_unknown'
           WHEN g.id IS NULL THEN 'target_unknown' ELSE 'resolved' END AS resolution
    FROM c LEFT JOIN best s ON s.text_lower = lower(trim(source_name)) LEFT JOIN best g ON g.text_lower = lower(trim(target_name))""")
def resolve_edge_names(t: Inputs):
    named = t.v_texts.select("text_id", F.col("text").alias("source_name"), F.col("category").alias("target_name"))
    return joins.resolve_edge_names(named, t.v_atoms).select("text_id", "source_id", "target_id", "resolution")


@query("arrangement_detail", "J21", """
    SELECT a.slug, a.context_key, c.category_slug, c.guidance
    FROM (SELECT slug, CASE WHEN register IS NULL THEN 'F' ELSE 'none' END AS context_key FROM v_arrangements) a
    LEFT JOIN v_category_contexts c ON c.context = a.context_key""")
def arrangement_detail(t: Inputs):
    rows = t.v_arrangements.select("slug", F.when(F.col("register").isNull(), "F").otherwise("none").alias("context_key"))
    return joins.arrangement_detail(rows, t.v_category_contexts).select("slug", "context_key", "category_slug", "guidance")


@query("document_profile", "J22", """
    WITH c AS (SELECT chunk_id, document_id, lang FROM v_chunks),
    tab AS (SELECT document_id, string_agg(DISTINCT lang, '|' ORDER BY lang) AS s FROM c WHERE document_id < 'src15' GROUP BY 1),
    own AS (SELECT document_id, string_agg(DISTINCT 'fb-' || lang, '|' ORDER BY 'fb-' || lang) AS s FROM c WHERE lang <> 'en' GROUP BY 1),
    n AS (SELECT document_id, count(*) AS chunk_count FROM c GROUP BY 1)
    SELECT document_id, coalesce(tab.s, own.s, '') AS arrangements, chunk_count,
           CASE WHEN tab.s IS NOT NULL THEN 1.0 WHEN own.s IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS score
    FROM n LEFT JOIN tab USING (document_id) LEFT JOIN own USING (document_id)""")
def document_profile(t: Inputs):
    chunks = t.v_chunks.withColumn(
        "arrangement_slugs", F.when(F.col("lang") != "en", F.array(F.concat(F.lit("fb-"), "lang"))).otherwise(F.array().cast("array<string>"))
    )
    # chunks of the later sources are listed under other ids, so that those documents fall back to their own lists
    listed = F.when(F.col("document_id") < "src15", F.col("chunk_id")).otherwise(F.concat(F.lit("x-"), "chunk_id"))
    table = t.v_chunks.select(listed.alias("chunk_id"), F.col("lang").alias("arrangement_slug"))
    out = joins.document_profile(chunks.select("document_id").distinct(), table, chunks)
    return out.withColumn("arrangements", F.array_join("arrangements", "|"))
