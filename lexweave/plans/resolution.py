"""Phrase resolution, full-text search, manifests and curation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import arrangements as arr
from lexweave.operators import curation as cu
from lexweave.operators import manifests as mf
from lexweave.operators import postings as ps
from lexweave.operators import resolve as rs
from lexweave.operators.predicates import AtomFilter
from lexweave.plans.registry import Inputs, query
from lexweave.plans.views import VIEWS

VIEWS.update(
    {
        # known terms: part names, part types, and the longer words of the benchmark texts
        "v_benchmark_words": (
            """SELECT DISTINCT w AS text_lower FROM (
                 SELECT explode(split(lower(regexp_replace(text, '[^A-Za-z]', ' ')), ' +')) AS w FROM {benchmark}) WHERE length(w) >= 4""",
            """SELECT DISTINCT w AS text_lower FROM (
                 SELECT unnest(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), ' +')) AS w FROM {benchmark}) WHERE length(w) >= 4""",
        ),
        "v_vocabulary": """
            SELECT id, text, text_lower, status, collection_slug FROM {v_atoms}
            UNION ALL SELECT DISTINCT 't' || p_type AS id, p_type AS text, lower(p_type) AS text_lower, 'confirmed' AS status, 'types' AS collection_slug FROM {part}
            UNION ALL SELECT 'w' || text_lower AS id, text_lower AS text, text_lower, 'confirmed' AS status, 'words' AS collection_slug FROM {v_benchmark_words}""",
        "v_phrases": """
            SELECT 'd' || doc_id AS phrase_id, text AS phrase FROM {documents}
            UNION ALL SELECT 'p' || p_partkey AS phrase_id, 'The ' || p_name || ', ' || lower(p_type) || 'ness of ' || p_name || ' ' || p_brand AS phrase FROM {part}
            UNION ALL SELECT 'q' || n_nationkey AS phrase_id, 'of the' AS phrase FROM {nation}""",
        "v_concepts": """
            SELECT 'p' || p_partkey AS term_id, p_name || 's' AS term FROM {part}
            UNION ALL SELECT 'q' || p_partkey AS term_id, p_name AS term FROM {part}
            UNION ALL SELECT DISTINCT 't' || split_part(p_name, ' ', 2) AS term_id, split_part(p_name, ' ', 2) AS term FROM {part}
            UNION ALL SELECT 'n' || n_nationkey AS term_id, n_name AS term FROM {nation}""",
    }
)

SUFFIXES = "['ed','ing','ly','ness','tion','ment','ous','ive','ful','less','ity']"
RESOLVED = rf"""
    toks AS (
      SELECT phrase_id, list_filter(regexp_split_to_array(regexp_replace(lower(phrase), '[^\p{{L}}\p{{N}}\s''-]', ' ', 'g'), '\s+'),
             lambda w: w <> '' AND w NOT IN ('the','a','an','of','in','on','with','and','or','for','to','by','from','as','at','into')) AS words
      FROM v_phrases),
    texts AS (SELECT text_lower, min(id) AS hit FROM v_vocabulary WHERE status = 'confirmed' GROUP BY 1),
    pos AS (SELECT phrase_id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos, words FROM toks),
    pairs AS (SELECT p.phrase_id, p.pos, p.token, p.token || ' ' || p.words[p.pos + 2] AS pair FROM pos p),
    stems AS (SELECT token, arg_max(hit, length(cand)) AS stem_hit FROM (
        SELECT token, unnest(list_concat([token], list_transform(list_filter({SUFFIXES}, lambda s: ends_with(token, s) AND length(token) - length(s) >= 3),
               lambda s: left(token, length(token) - length(s))))) AS cand FROM (SELECT DISTINCT token FROM pos))
      JOIN texts ON cand = text_lower GROUP BY 1),
    found AS (SELECT p.*, a.hit AS pair_hit, b.hit AS word_hit, s.stem_hit FROM pairs p
              LEFT JOIN texts a ON p.pair = a.text_lower LEFT JOIN texts b ON p.token = b.text_lower LEFT JOIN stems s ON p.token = s.token),
    runs AS (SELECT *, pos - row_number() OVER (PARTITION BY phrase_id, pair_hit IS NOT NULL ORDER BY pos) AS run FROM found),
    take AS (SELECT *, pair_hit IS NOT NULL AND row_number() OVER (PARTITION BY phrase_id, pair_hit IS NOT NULL, run ORDER BY pos) % 2 = 1 AS taken FROM runs),
    inside AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY phrase_id ORDER BY pos), false) AS eaten FROM take),
    resolved AS (
      SELECT phrase_id, pos, token,
        CASE WHEN taken THEN 'exact' WHEN eaten THEN 'consumed' WHEN word_hit IS NOT NULL THEN 'exact' WHEN stem_hit IS NOT NULL THEN 'prefix' END AS match_type,
        CASE WHEN taken THEN pair_hit WHEN eaten THEN NULL ELSE coalesce(word_hit, stem_hit) END AS atom_id,
        CASE WHEN taken THEN 'bg:' || pair WHEN eaten THEN NULL WHEN word_hit IS NOT NULL THEN 'tok:' || token WHEN stem_hit IS NOT NULL THEN 'stem:' || token END AS match_key
      FROM inside)"""


def _resolved(t: Inputs):
    return rs.resolve_phrases(t.v_phrases, t.v_vocabulary)


@query("resolve_phrases", "R1 X2", f"""
    WITH {RESOLVED}
    SELECT phrase_id, pos, token, match_type, atom_id, match_key FROM resolved
    UNION ALL SELECT phrase_id, NULL, NULL, NULL, NULL, NULL FROM toks WHERE len(words) = 0""")
def resolve_phrases(t: Inputs):
    return _resolved(t).select("phrase_id", "pos", "token", "match_type", "atom_id", "match_key")


@query("resolve_phrases_semantic", "R1 V1", f"""
    WITH {RESOLVED},
    asked AS (SELECT token, list_concat(vec[2:], vec[:1])::DOUBLE[] AS vec FROM (SELECT DISTINCT token FROM resolved WHERE match_type IS NULL)
      JOIN v_vectors ON id = 'a' || (('0x' || left(md5(token), 6))::BIGINT % (SELECT count(*) FROM embeddings))),
    near AS (SELECT token, arg_max(id, (score, -label)) AS near, max(score) AS score FROM (
      SELECT token, v.id, label, round(list_cosine_similarity(a.vec, v.vec::DOUBLE[]), 6) AS score FROM asked a, v_vectors v) WHERE score >= 0.2 GROUP BY 1)
    SELECT phrase_id, pos, token, match_type, atom_id, match_key FROM resolved WHERE match_type IS NOT NULL
    UNION ALL SELECT phrase_id, pos, r.token, CASE WHEN near IN (SELECT id FROM v_vocabulary WHERE status = 'confirmed') THEN 'semantic' END,
      CASE WHEN near IN (SELECT id FROM v_vocabulary WHERE status = 'confirmed') THEN near END, CASE WHEN near IN (SELECT id FROM v_vocabulary WHERE status = 'confirmed') THEN 'sem:' || r.token END
      FROM resolved r LEFT JOIN near USING (token) WHERE match_type IS NULL
    UNION ALL SELECT phrase_id, NULL, NULL, NULL, NULL, NULL FROM toks WHERE len(words) = 0""")
def resolve_phrases_semantic(t: Inputs):
    """Phrases whose open tokens also look for a near vector; a token's vector is a turned one of the table."""
    n = t.embeddings.agg(F.count("*").alias("n"))
    tokens = rs.phrase_tokens(t.v_phrases).filter("token IS NOT NULL").select("token").distinct()
    drawn = F.conv(F.left(F.md5("token"), F.lit(6)), 16, 10).cast("long")
    placed = tokens.withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one").select("token", F.concat(F.lit("a"), (drawn % F.col("n")).cast("string")).alias("id"))
    turned = F.concat(F.slice("vec", F.lit(2), F.size("vec") - 1), F.slice("vec", 1, 1))
    vectors = placed.join(t.v_vectors, "id").select("token", turned.alias("vec"))
    out = rs.resolve_phrases(t.v_phrases, t.v_vocabulary, token_vectors=vectors, vectors=t.v_vectors, min_confidence=0.2)
    return out.select("phrase_id", "pos", "token", "match_type", "atom_id", "match_key")


@query("resolved_atoms", "R1", f"""
    WITH {RESOLVED}
    SELECT phrase_id, match_key, any_value(atom_id) AS atom_id, any_value(CASE match_type WHEN 'prefix' THEN 0.9 ELSE 1.0 END)::DOUBLE AS confidence
    FROM resolved WHERE atom_id IS NOT NULL GROUP BY 1, 2""")
def resolved_atoms(t: Inputs):
    return rs.resolved_atoms(_resolved(t)).select("phrase_id", "match_key", "atom_id", "confidence")


@query("resolve_stats", "R1", f"""
    WITH {RESOLVED},
    s AS (SELECT phrase_id, count(*) AS n, count(*) FILTER (match_type IS NULL) AS open FROM resolved GROUP BY 1
          UNION ALL SELECT phrase_id, 0, 0 FROM toks WHERE len(words) = 0)
    SELECT CASE WHEN open = 0 THEN 'full' WHEN open = n THEN 'none' ELSE 'partial' END AS state, count(*) AS phrases FROM s GROUP BY 1""")
def resolve_stats(t: Inputs):
    return rs.resolve_stats(_resolved(t))


SEARCH = """
    live AS (SELECT id, text_lower FROM v_atoms WHERE status <> 'rejected'),
    hits AS (SELECT term_id, term, lower(trim(term)) AS key, id AS atom_id, text_lower AS hit_text FROM v_concepts JOIN live
      ON contains(' ' || text_lower || ' ', ' ' || regexp_replace(replace(lower(term), '_', ' '), 's$', '') || ' '))"""


@query("text_search", "T1", f"WITH {SEARCH} SELECT term_id, atom_id FROM hits")
def text_search(t: Inputs):
    return ps.text_search(t.v_concepts, t.v_atoms)


@query("match_vocabulary", "R2", f"""
    WITH {SEARCH},
    exact AS (SELECT term_id, min(id) AS atom_id FROM v_concepts JOIN v_atoms ON lower(trim(term)) = text_lower GROUP BY 1),
    tally AS (SELECT term_id, any_value(key) AS key, count(*) AS n, min(atom_id) AS only_id, arg_min(hit_text, atom_id) AS only_text FROM hits
              WHERE term_id NOT IN (SELECT term_id FROM exact) GROUP BY 1),
    few AS (SELECT term_id, string_agg(atom_id, '|' ORDER BY atom_id) AS candidates FROM (
      SELECT term_id, atom_id FROM hits QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY abs(length(hit_text) - length(term)), atom_id) <= 5) GROUP BY 1)
    SELECT c.term_id, CASE WHEN e.atom_id IS NOT NULL THEN 'exact' WHEN t.n IS NULL THEN 'new'
        WHEN n = 1 AND least(length(key), length(only_text)) / greatest(length(key), length(only_text)) > 0.6 AND (contains(key, only_text) OR contains(only_text, key)) THEN 'single'
        ELSE 'ambiguous' END AS outcome,
      CASE outcome WHEN 'exact' THEN e.atom_id WHEN 'single' THEN only_id END AS atom_id,
      CASE outcome WHEN 'exact' THEN 1.0 WHEN 'single' THEN 0.85 END::DOUBLE AS confidence,
      CASE outcome WHEN 'ambiguous' THEN candidates END AS candidates
    FROM v_concepts c LEFT JOIN exact e USING (term_id) LEFT JOIN tally t USING (term_id) LEFT JOIN few USING (term_id)""")
def match_vocabulary(t: Inputs):
    return rs.match_vocabulary(t.v_concepts, t.v_atoms).withColumn("candidates", F.array_join("candidates", "|"))


@query("harvest_relations", "R3 J1", """
    WITH best AS (SELECT text_lower, arg_min(id, (CASE collection_slug WHEN 'brand-7' THEN 0 ELSE 1 END, id)) AS target FROM v_atoms GROUP BY 1),
    named AS (SELECT DISTINCT a.id, CASE WHEN n.x = 1 THEN a.text ELSE a.category_slug END AS target_text
              FROM v_atoms a, (SELECT 1 AS x UNION ALL SELECT 2) n WHERE a.collection_slug = 'brand-7')
    SELECT n.id AS source_atom_id, target_text, target AS target_atom_id,
      CASE WHEN target IS NULL THEN 'unmatched' WHEN (n.id, target) IN (SELECT (source_atom_id, target_atom_id) FROM v_relations WHERE relation_type = 'modifier') THEN 'matched' ELSE 'created' END AS status
    FROM named n LEFT JOIN best ON lower(trim(target_text)) = text_lower
    WHERE target_text IS NOT NULL AND (target IS NULL OR target <> n.id)""")
def harvest_relations(t: Inputs):
    labels = F.transform(F.array("text", "category_slug"), lambda x: F.struct(x.alias("label")))
    atoms = t.v_atoms.withColumn("metadata", F.to_json(F.struct(labels.alias("influenced_by"))))
    out = rs.harvest_relations(atoms, t.v_relations, collection="brand-7", key="influenced_by", relation_type="modifier", many=True)
    return out.select("source_atom_id", "target_text", "target_atom_id", "status")


@query("accept_relations", "R4", """
    WITH v AS (SELECT text_lower AS term_lower, min(id) AS atom_id FROM v_atoms GROUP BY 1)
    SELECT s.atom_id AS source_atom_id, t.atom_id AS target_atom_id, relation_type, greatest(0.0, least(1.0, strength)) AS strength
    FROM (SELECT p.p_name AS s, r.p_name AS t, CASE l_returnflag WHEN 'A' THEN 'derives_from' WHEN 'R' THEN 'modifies' ELSE 'odd' END AS relation_type, l_tax * 20 - 0.2 AS strength
      FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part r ON r.p_partkey = l_suppkey)
    JOIN v s ON lower(s) = s.term_lower JOIN v t ON lower(t) = t.term_lower WHERE relation_type <> 'odd' AND s.atom_id <> t.atom_id""")
def accept_relations(t: Inputs):
    names = t.part.select("p_partkey", "p_name")
    raw = (
        t.lineitem.join(names.toDF("l_partkey", "source_term"), "l_partkey")
        .join(names.toDF("l_suppkey", "target_term"), "l_suppkey")
        .select(
            "source_term", "target_term", (F.col("l_tax") * 20 - 0.2).alias("strength"),
            F.when(F.col("l_returnflag") == "A", "derives_from").when(F.col("l_returnflag") == "R", "modifies").otherwise("odd").alias("relation_type"),
        )
    )
    vocabulary = t.v_atoms.groupBy(F.col("text_lower").alias("term_lower")).agg(F.min("id").alias("atom_id"))
    return rs.accept_relations(raw, vocabulary).select("source_atom_id", "target_atom_id", "relation_type", "strength")


@query("link_terms", "R5", """
    WITH best AS (SELECT text_lower, min(id) AS id FROM v_atoms GROUP BY 1)
    SELECT DISTINCT lang AS source_id, lower(trim(term)) AS text_lower, coalesce(id, 'new:' || sha256(lower(trim(term)) || '|film')) AS atom_id, id IS NULL AS is_new
    FROM (SELECT 'film-' || n_nationkey AS lang, n_name AS term FROM nation UNION ALL SELECT p_brand, p_name FROM part)
    LEFT JOIN best ON lower(trim(term)) = text_lower""")
def link_terms(t: Inputs):
    terms = t.nation.select(F.concat(F.lit("film-"), "n_nationkey").alias("source_id"), F.col("n_name").alias("term")).unionByName(
        t.part.select(F.col("p_brand").alias("source_id"), F.col("p_name").alias("term"))
    )
    return rs.link_terms(terms, t.v_atoms, "film")


@query("index_concepts", "R6", """
    SELECT p_brand || ' ' || p_partkey AS term, coalesce(m.slug, h.slug) AS category_slug, CASE WHEN p_size > 20 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence
    FROM part LEFT JOIN v_categories m ON p_size > 20 AND m.slug = 'size.' || lower(p_type) LEFT JOIN v_categories h ON h.slug = 'line.' || lower(p_type)""")
def index_concepts(t: Inputs):
    term = F.concat_ws(" ", "p_brand", "p_partkey")
    rows = t.part.select(term.alias("term"), F.concat(F.lit("line."), F.lower("p_type")).alias("category_hint"))
    model = t.part.filter(F.col("p_size") > 20).select(F.upper(term).alias("term"), F.concat(F.lit("size."), F.lower("p_type")).alias("model_category"))
    return rs.index_concepts(rows, model, t.v_categories)


@query("process_discoveries", "R7", """
    WITH best AS (SELECT text_lower, min(id) AS id FROM v_atoms GROUP BY 1)
    SELECT text_id AS discovery_id, CASE WHEN id IS NULL THEN 'accepted' ELSE 'merged' END AS resolution, id AS duplicate_of,
      CASE WHEN id IS NULL THEN 0.6 END::DOUBLE AS confidence, CASE WHEN id IS NULL THEN coalesce(category, 'uncategorized') END AS collection_slug
    FROM v_texts LEFT JOIN best ON text_lower = lower(trim(text))""")
def process_discoveries(t: Inputs):
    queue = t.v_texts.select(
        F.col("text_id").alias("discovery_id"), F.col("text").alias("term"), F.col("category").alias("suggested_collection"), F.lit("pending").alias("status")
    )
    return rs.process_discoveries(queue, t.v_atoms)


@query("link_concepts", "R8", """
    WITH v AS (SELECT DISTINCT source AS document_id, text_lower AS term_lower FROM documents, v_benchmark_words),
    h AS (SELECT v.document_id, term_lower, min(chunk_index) AS hit FROM v JOIN v_chunks c ON c.document_id = v.document_id AND contains(lower(content), term_lower) GROUP BY 1, 2),
    f AS (SELECT document_id, min(chunk_index) AS first FROM v_chunks GROUP BY 1)
    SELECT v.document_id, v.term_lower, 'doc_chunk_' || coalesce(hit, first) AS chunk_id, CASE WHEN hit IS NULL THEN 'page-level' ELSE c.lang END AS context
    FROM v LEFT JOIN h USING (document_id, term_lower) JOIN f USING (document_id) JOIN v_chunks c ON c.chunk_index = coalesce(hit, first)""")
def link_concepts(t: Inputs):
    words = t.v_benchmark_words
    from lexweave.functions.sizing import attach_packed

    pairs, _ = attach_packed(t.documents.select(F.col("source").alias("document_id")).distinct(), words, "w")
    vocabulary = pairs.select("document_id", F.explode("w.text_lower").alias("term_lower")).withColumn("atom_id", F.concat(F.lit("w"), "term_lower"))
    out = rs.link_concepts(vocabulary, t.v_chunks.withColumn("section_heading", F.col("lang")))
    return out.select("document_id", "term_lower", "chunk_id", "context")


@query("discover_terms", "R9 F7", """
    WITH best AS (SELECT text_lower, min(id) AS id FROM v_atoms GROUP BY 1),
    t AS (SELECT text_id AS term_id, text AS term FROM v_texts UNION ALL SELECT DISTINCT 'type-' || p_type, p_type FROM part),
    m AS (SELECT DISTINCT lower(n_name[8:]) AS text_lower, 'size.small' AS category_slug FROM nation WHERE n_nationkey > 9),
    x AS (SELECT term_id, id, m.category_slug, CASE WHEN lower(trim(term)) IN ('small', 'medium', 'large', 'standard') THEN 'rejected_generic' WHEN id IS NOT NULL THEN 'encountered'
            WHEN m.category_slug IS NULL THEN 'unanswered' ELSE 'created' END AS outcome
          FROM t LEFT JOIN best ON best.text_lower = lower(trim(term)) LEFT JOIN m ON m.text_lower = lower(trim(term)))
    SELECT term_id, outcome, CASE outcome WHEN 'encountered' THEN id END AS atom_id, CASE outcome WHEN 'created' THEN category_slug END AS category_slug,
           CASE outcome WHEN 'created' THEN 'col-SMALL' END AS collection_slug, CASE outcome WHEN 'created' THEN 'provisional' END AS status FROM x""")
def discover_terms(t: Inputs):
    terms = t.v_texts.select(F.col("text_id").alias("term_id"), F.col("text").alias("term")).unionByName(
        t.part.select(F.concat(F.lit("type-"), "p_type").alias("term_id"), F.col("p_type").alias("term")).distinct()
    )
    model = t.nation.filter(F.col("n_nationkey") > 9).select(F.lower(F.substring("n_name", 8, 9)).alias("text_lower"), F.lit("size.small").alias("category_slug")).distinct()
    mapped = t.v_categories.select(F.col("slug").alias("category_slug"), F.concat(F.lit("col-"), "label").alias("collection_slug"))
    return rs.discover_terms(terms, t.v_atoms, model, mapped)


@query("decompose_terms", "R10", """
    WITH best AS (SELECT text_lower, min(id) AS id FROM v_atoms GROUP BY 1),
    f AS (SELECT p_partkey AS request_id, p_name AS term, 'line.' || lower(p_type) AS category_slug FROM part WHERE p_name <> ''
          UNION ALL SELECT p_partkey, p_brand, 'size.' || lower(p_type) FROM part)
    SELECT request_id, term, f.category_slug, id AS atom_id, CASE WHEN slug IS NULL THEN 'unknown_category' WHEN id IS NOT NULL THEN 'encountered' ELSE 'created' END AS outcome
    FROM f LEFT JOIN v_categories ON slug = f.category_slug LEFT JOIN best ON text_lower = lower(term)""")
def decompose_terms(t: Inputs):
    item = lambda text, group: F.struct(text.alias("text"), F.concat(F.lit(group), F.lower("p_type")).alias("category"))
    terms = F.array(item(F.concat(F.lit(" "), "p_name"), "line."), item(F.col("p_brand"), "size."), item(F.lit("  "), "line."))
    return rs.decompose_terms(t.part.select(F.col("p_partkey").alias("request_id"), terms.alias("terms")), t.v_categories, t.v_atoms)


# --- manifests ------------------------------------------------------------

MANIFEST = """
    tags AS (SELECT DISTINCT atom_id, tag_id AS slug, split_part(tag_id, '-', 1) AS category FROM v_atom_tags),
    nodes AS (SELECT id, category_slug FROM v_atoms WHERE status <> 'rejected' AND category_slug IS NOT NULL),
    m AS (
      SELECT 'lines' AS slug, id FROM nodes WHERE starts_with(category_slug, 'line.')
        AND NOT starts_with(category_slug, 'line.promo') AND id NOT IN (SELECT atom_id FROM tags WHERE slug = 'tag-3')
      UNION ALL SELECT 'tagged', id FROM nodes WHERE category_slug = 'size.small' OR id IN (SELECT atom_id FROM tags WHERE category = 'half') OR id IN (SELECT atom_id FROM tags WHERE slug = 'tag-1')),
    rel AS (SELECT s.slug, d.id, d.n AS neighbour_id, relationship_type, strength, provenance
      FROM (SELECT atom_a_id AS id, atom_b_id AS n, relationship_type, strength, provenance FROM v_edges UNION ALL SELECT atom_b_id, atom_a_id, relationship_type, strength, provenance FROM v_edges) d
      JOIN m s ON s.id = d.id
      WHERE (s.slug = 'lines' AND provenance = 'harmonic' AND (s.slug, d.n) IN (SELECT (slug, id) FROM m)) OR (s.slug = 'tagged' AND provenance = 'semantic'))"""


def _manifest(t: Inputs):
    import json

    specs = [
        {"v": 1, "slug": "lines", "name": "Lines", "description": "", "include": {"category_prefixes": ["line."]},
         "exclude": {"category_prefixes": ["line.promo"], "tags": ["tag-3"]}, "correspondence_filter": {"provenances": ["harmonic"]}},
        {"v": 1, "slug": "tagged", "name": "Tagged", "description": "", "include": {"category_prefixes": [], "category_exact": ["size.small"], "tag_categories": ["half"], "tags": ["tag-1"]},
         "correspondence_filter": {"internal_only": False, "provenances": ["semantic"]}},
        {"v": 2, "slug": "broken", "name": "Broken"},
    ]
    raw = t.spark.createDataFrame([(f"specs/{i}", json.dumps(s)) for i, s in enumerate(specs)], "key string, raw string")
    tags = t.v_atom_tags.select("atom_id", F.col("tag_id").alias("slug"), F.split_part("tag_id", F.lit("-"), F.lit(1)).alias("category"))
    return mf.build_all(raw, t.v_atoms, tags, t.v_memberships, t.v_edges)


@query("manifest_atoms", "M1 M2 M3", f"WITH {MANIFEST} SELECT slug, id FROM m")
def manifest_atoms(t: Inputs):
    return _manifest(t)["atoms"].select("slug", "id")


@query("manifest_relations", "M2 M3", f"WITH {MANIFEST} SELECT * FROM rel")
def manifest_relations(t: Inputs):
    return _manifest(t)["relations"]


@query("manifest_stats", "A29 M3", f"""
    WITH {MANIFEST}
    SELECT m.slug, count(*) AS atom_count, count(*) FILTER (m.id IN (SELECT atom_id FROM v_memberships)) AS membership_count,
      (SELECT count(DISTINCT t.slug) FROM tags t JOIN m x ON x.id = t.atom_id WHERE x.slug = m.slug) AS tag_count,
      (SELECT count(DISTINCT (least(r.id, neighbour_id), greatest(r.id, neighbour_id), relationship_type)) FROM rel r WHERE r.slug = m.slug) AS correspondence_count
    FROM m GROUP BY 1""")
def manifest_stats(t: Inputs):
    return _manifest(t)["stats"]


@query("manifest_entries", "M1 S9", f"""
    WITH {MANIFEST} SELECT m.slug, m.id, count(neighbour_id) AS relations FROM m LEFT JOIN rel r ON r.slug = m.slug AND r.id = m.id GROUP BY 1, 2""")
def manifest_entries(t: Inputs):
    out = _manifest(t)
    rows = mf.manifest_entries(out["atoms"], out["relations"], per_part=20)
    return rows.groupBy("slug", "id").agg(F.sum(F.coalesce(F.array_size("rel"), F.lit(0))).alias("relations"))


# --- curation -------------------------------------------------------------

SPEC = AtomFilter(min_length=5, category_like="size.%", text_like="%i%")
SPEC_SQL = "status <> 'rejected' AND length(text_lower) > 5 AND category_slug LIKE 'size.%' AND text_lower LIKE '%i%'"


def with_metadata(t: Inputs):
    return t.v_atoms.withColumn("metadata", F.to_json(F.struct(F.col("source_app").alias("app"))))


@query("migrate_to_chunks", "Q2", f"""
    SELECT 'doc_chunk_' || sha256(sha256('Moved terms') || '|' || id) AS chunk_id, row_number() OVER (ORDER BY id) - 1 AS chunk_index, text AS content, category_slug
    FROM v_atoms WHERE {SPEC_SQL}""")
def migrate_to_chunks(t: Inputs):
    out = cu.migrate_to_chunks(with_metadata(t), SPEC, title="Moved terms", tags=["bulk"])
    return out["chunks"].select("chunk_id", "chunk_index", "content", "category_slug")


@query("migrate_dry_run", "Q2", f"SELECT count(*) AS chunks_created, sum(ceil(length(text) / 4))::BIGINT AS token_count FROM v_atoms WHERE {SPEC_SQL}")
def migrate_dry_run(t: Inputs):
    return cu.migrate_to_chunks(with_metadata(t), SPEC, title="Moved terms", tags=["bulk"], dry_run=True)["counts"]


@query("reject_atoms", "Q3 X7", f"""
    SELECT id, CASE WHEN coalesce({SPEC_SQL}, false) THEN 'rejected' ELSE status END AS status, CASE WHEN coalesce({SPEC_SQL}, false) THEN 'too vague' END AS reason, source_app AS app FROM v_atoms""")
def reject_atoms(t: Inputs):
    out = cu.reject_atoms(with_metadata(t), SPEC, "too vague")
    return out.select(
        "id", "status", F.get_json_object("metadata", "$.rejection_reason").alias("reason"), F.get_json_object("metadata", "$.app").alias("app")
    )


@query("recategorize", "Q4", """
    SELECT id, CASE WHEN hit THEN 'size.small' ELSE category_slug END AS category_slug, CASE WHEN hit THEN 0 ELSE tag_version END AS tag_version, hit AS recategorized
    FROM (SELECT *, coalesce(category_slug = 'line.promo' AND status <> 'rejected', false) AS hit FROM v_atoms)""")
def recategorize(t: Inputs):
    out = cu.recategorize(t.v_atoms, t.v_categories, F.col("category_slug") == "line.promo", "size.small")
    return out.select("id", "category_slug", "tag_version", "recategorized")


@query("heal_drift", "Q4", """
    SELECT 'a' || o_custkey AS atom_id, 'size.' || CASE o_orderstatus WHEN 'F' THEN 'small' WHEN 'O' THEN 'medium' ELSE 'huge' END AS new_category,
      CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'invalid_category_slug' WHEN a.id IS NULL THEN 'atom_not_found'
           WHEN a.category_slug = 'size.' || CASE o_orderstatus WHEN 'F' THEN 'small' ELSE 'medium' END THEN 'already_assigned' ELSE 'healed' END AS outcome
    FROM orders LEFT JOIN v_atoms a ON a.id = 'a' || o_custkey AND a.status <> 'rejected'""")
def heal_drift(t: Inputs):
    group = F.when(F.col("o_orderstatus") == "F", "size.small").when(F.col("o_orderstatus") == "O", "size.medium").otherwise("size.huge")
    asked = t.orders.select(F.concat(F.lit("a"), "o_custkey").alias("atom_id"), group.alias("new_category"))
    return cu.heal_drift(t.v_atoms.filter(F.col("status") != "rejected"), asked, t.v_categories)


@query("assign_modality", "Q4", """
    SELECT a.id, CASE WHEN c.parent = 'size' THEN 'visual' ELSE a.modality END AS modality FROM v_atoms a LEFT JOIN v_categories c ON c.slug = a.category_slug""")
def assign_modality(t: Inputs):
    cats = t.v_categories.withColumn("default_modality", F.when(F.col("parent") == "size", "visual"))
    return cu.assign_modality(t.v_atoms, cats).select("id", "modality")


@query("force_create", "Q5", """
    WITH r AS (SELECT p_partkey AS row_id, lower(trim(p_name)) || CASE WHEN p_size < 25 THEN ' new' ELSE '' END AS text_lower, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size.' ELSE 'line.' END || lower(p_type) AS cat,
                p_size / 45.0 AS hardness, lower(replace(p_brand, '#', '-')) AS col FROM part),
    ok AS (SELECT r.*, slug IS NOT NULL AS known, hardness > 1 AS bad FROM r LEFT JOIN v_categories ON slug = cat),
    col AS (SELECT *, CASE WHEN known THEN cat ELSE 'uncategorized' END AS collection_slug FROM ok),
    first AS (SELECT text_lower, collection_slug, min(row_id) AS f FROM col WHERE known AND NOT bad GROUP BY 1, 2)
    SELECT row_id, outcome, count(*) AS n FROM (SELECT row_id, CASE WHEN bad THEN 'harmonics_out_of_range' WHEN NOT known THEN 'invalid_category_slug' WHEN row_id <> f THEN 'duplicate_in_request'
      WHEN (text_lower, collection_slug) IN (SELECT (text_lower, category_slug) FROM v_atoms WHERE category_slug IS NOT NULL AND status = 'provisional') THEN 'unique_conflict' ELSE 'created' END AS outcome
    FROM col LEFT JOIN first USING (text_lower, collection_slug)) GROUP BY 1, 2""")
def force_create(t: Inputs):
    rows = t.part.select(
        F.col("p_partkey").alias("row_id"), F.concat(F.lit(" "), "p_name", F.when(F.col("p_size") < 25, " new").otherwise("")).alias("text"),
        F.concat(F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), "size.").otherwise("line."), F.lower("p_type")).alias("category_slug"),
        (F.col("p_size") / 45.0).alias("hardness"), *[F.lit(None).cast("double").alias(d) for d in cu.DIMENSIONS[1:]],
    )
    held = t.v_atoms.filter(F.col("category_slug").isNotNull() & (F.col("status") == "provisional")).select("text_lower", F.col("category_slug").alias("collection_slug"))
    mapped = t.v_categories.select(F.col("slug").alias("category_slug"), F.col("slug").alias("collection_slug"))
    return cu.force_create(rows, held, t.v_categories, mapped).groupBy("row_id", "outcome").agg(F.count("*").alias("n"))


def _merges(t: Inputs):
    live = t.v_atoms.filter(F.col("status") != "rejected")
    first = live.groupBy("text_lower").agg(F.min("id").alias("canonical_id"))
    asked = live.filter(F.col("collection_slug") < "brand-15").join(first, "text_lower").select(F.col("id").alias("merge_id"), "canonical_id")
    return cu.valid_merges(asked, t.v_atoms)


MERGES = """
    mp AS (SELECT a.id AS merge_id, f.c AS canonical_id FROM v_atoms a JOIN (SELECT text_lower, min(id) AS c FROM v_atoms WHERE status <> 'rejected' GROUP BY 1) f USING (text_lower)
           WHERE a.status <> 'rejected' AND a.collection_slug < 'brand-15' AND a.id <> f.c)"""


@query("merge_edges", "Q6", f"""
    WITH {MERGES},
    m AS (SELECT least(coalesce(x.canonical_id, atom_a_id), coalesce(y.canonical_id, atom_b_id)) AS atom_a_id, greatest(coalesce(x.canonical_id, atom_a_id), coalesce(y.canonical_id, atom_b_id)) AS atom_b_id,
        relationship_type, arrangement_scope, strength, provenance, x.merge_id IS NOT NULL OR y.merge_id IS NOT NULL AS moved
      FROM v_edges LEFT JOIN mp x ON x.merge_id = atom_a_id LEFT JOIN mp y ON y.merge_id = atom_b_id)
    SELECT * FROM m WHERE atom_a_id <> atom_b_id
    QUALIFY row_number() OVER (PARTITION BY atom_a_id, atom_b_id, relationship_type, arrangement_scope ORDER BY moved, strength DESC, provenance) = 1""")
def merge_edges(t: Inputs):
    return cu.merge_edges(t.v_edges, _merges(t))


@query("merge_atoms", "Q6", f"""
    WITH {MERGES}
    SELECT a.id, CASE WHEN m.merge_id IS NOT NULL THEN 'rejected' ELSE status END AS status, m.canonical_id AS merged_into,
           CASE WHEN a.id IN (SELECT canonical_id FROM mp) THEN 0 ELSE tag_version END AS tag_version
    FROM v_atoms a LEFT JOIN mp m ON m.merge_id = a.id""")
def merge_atoms(t: Inputs):
    out = cu.merge_atoms(with_metadata(t), _merges(t))
    return out.select("id", "status", F.get_json_object("metadata", "$.merged_into").alias("merged_into"), "tag_version")


@query("review_candidates", "Q7 J20", """
    WITH c AS (SELECT event_id AS id, CASE WHEN value < 2 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN event_type IN ('view', 'click') THEN 'correspondence' ELSE 'atom' END AS kind,
        CASE WHEN event_type = 'signup' THEN 'line.promo' ELSE 'nowhere' END AS cat, 'name ' || user_id AS name, 'name ' || (user_id + 1) AS target, value / 500 AS strength,
        CASE WHEN value > 60 THEN 'reject' ELSE 'approve' END AS action FROM events),
    pool AS (SELECT DISTINCT name FROM c WHERE status = 'pending' AND action = 'approve' AND kind = 'atom'),
    e AS (SELECT *, CASE WHEN status <> 'pending' THEN 'already_reviewed' WHEN action = 'approve' AND kind = 'correspondence' THEN
        CASE WHEN name NOT IN (SELECT * FROM pool) AND target NOT IN (SELECT * FROM pool) THEN 'both_unknown' WHEN name NOT IN (SELECT * FROM pool) THEN 'source_unknown'
             WHEN target NOT IN (SELECT * FROM pool) THEN 'target_unknown' END END AS error FROM c)
    SELECT id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome, error,
      CASE WHEN error IS NULL AND action = 'approve' AND kind = 'atom' AND cat = 'line.promo' THEN cat END AS category_slug,
      CASE WHEN error IS NULL AND action = 'approve' AND kind = 'correspondence' THEN CASE WHEN strength >= 0.75 THEN 'resonates' ELSE 'evokes' END END AS relationship_type FROM e""")
def review_candidates(t: Inputs):
    edge = F.col("event_type").isin("view", "click")
    name = F.concat(F.lit("name "), "user_id")
    data = F.to_json(
        F.struct(
            F.when(~edge, name).alias("name"), F.when(F.col("event_type") == "signup", "line.promo").otherwise("nowhere").alias("suggested_category"),
            F.when(edge, name).alias("source_name"), F.when(edge, F.concat(F.lit("name "), F.col("user_id") + 1)).alias("target_name"), (F.col("value") / 500).alias("strength"),
        )
    )
    rows = t.events.select(
        F.col("event_id").alias("id"), F.when(F.col("value") < 2, "approved").otherwise("pending").alias("status"),
        F.when(edge, "correspondence").otherwise("atom").alias("candidate_type"), data.alias("candidate_data"),
    )
    actions = t.events.select(F.col("event_id").alias("id"), F.when(F.col("value") > 60, "reject").otherwise("approve").alias("action"))
    return cu.review_candidates(rows, actions, t.v_atoms, t.v_categories)


@query("dropped_atoms", "Q8", """
    SELECT 'b' || l_suppkey AS moodboard_id, p_name AS atom_name, 'bucket-' || l_returnflag AS bucket, min('line.' || lower(p_type)) AS rejected_slug
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE 'line.' || lower(p_type) NOT IN (SELECT slug FROM v_categories) GROUP BY 1, 2, 3""")
def dropped_atoms(t: Inputs):
    entry = F.struct(F.concat(F.lit("bucket-"), "l_returnflag").alias("bucket"), F.col("p_name").alias("name"), F.concat(F.lit("line."), F.lower("p_type")).alias("category"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", F.concat(F.lit("b"), "l_suppkey").alias("moodboard_id"))
    return cu.dropped_atoms(rows.agg(F.collect_list(entry).alias("entries")), t.v_categories)


@query("bucket_concepts", "Q9", """
    WITH x AS (SELECT l_returnflag || l_linenumber AS moodboard_id, l_suppkey AS src, lower(p_name) AS atom_name, l_discount AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT moodboard_id, atom_name, round(count(DISTINCT src) / (SELECT count(DISTINCT src) FROM x y WHERE y.moodboard_id = x.moodboard_id), 6) AS frequency, round(round(avg(confidence), 9), 4) AS confidence FROM x GROUP BY 1, 2)
    SELECT *, CASE WHEN frequency >= 0.66 THEN 'invariant' WHEN frequency >= 0.33 THEN 'vector' ELSE 'low' END AS bucket FROM f WHERE frequency >= 0.33 OR frequency <= 0.22""")
def bucket_concepts(t: Inputs):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat("l_returnflag", "l_linenumber").alias("moodboard_id"), F.col("l_suppkey").alias("source_url"), F.col("p_name").alias("atom_name"), F.col("l_discount").alias("confidence")
    )
    return cu.bucket_concepts(rows)


@query("board_ready", "Q10 A30", """
    SELECT o.o_orderkey AS moodboard_id, coalesce(n, 0) AS sources, coalesce(n, 0) >= 4 AS ready,
      CASE WHEN o_orderstatus = 'O' AND coalesce(n, 0) >= 4 THEN 'extracted' WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'aggregated' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'extracted' ELSE 'reviewed' END AS status
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def board_ready(t: Inputs):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "extracted").otherwise("reviewed")
    boards = t.orders.select(F.col("o_orderkey").alias("moodboard_id"), F.lit(4).alias("expected"), status.alias("status"), (F.col("o_orderpriority") == "2-HIGH").alias("aggregated"))
    seen = t.lineitem.select(F.col("l_orderkey").alias("moodboard_id"), F.col("l_suppkey").alias("source_url"))
    return cu.board_ready(boards, seen)


@query("axis_manifest", "N10", """
    WITH s AS (SELECT lower(trim(p_name)) AS text_lower FROM part UNION SELECT lower(n_name) FROM nation),
    i AS (SELECT text_lower, min(id) AS atom_id FROM v_atoms WHERE category_slug = 'line.promo' GROUP BY 1)
    SELECT s.text_lower, i.atom_id, CASE WHEN i.atom_id IS NULL THEN 'missing' WHEN pole IS NULL THEN 'insert' WHEN pole = 'low' THEN 'already' ELSE 'conflict' END AS outcome
    FROM s LEFT JOIN i USING (text_lower) LEFT JOIN v_memberships m ON m.atom_id = i.atom_id AND axis_slug = 'axis-half'""")
def axis_manifest(t: Inputs):
    slugs = t.part.select(F.col("p_name").alias("slug")).unionByName(t.nation.select(F.col("n_name").alias("slug")))
    return cu.ingest_axis_manifest(slugs, t.v_atoms, t.v_memberships, axis="axis-half", pole="low", category="line.promo")


@query("board_mass", "H5 R1", f"""
    WITH {RESOLVED},
    board AS (SELECT DISTINCT left(phrase_id, 2) AS board, atom_id FROM resolved WHERE atom_id IS NOT NULL),
    positions AS (
      SELECT b.board, m.axis_slug, CASE m.axis_slug WHEN 'axis-half' THEN a.hardness ELSE a.register END AS coord
      FROM board b JOIN v_memberships m USING (atom_id) JOIN v_atoms a ON a.id = b.atom_id)
    SELECT board, axis_slug, count(*) AS matched, round(round(avg(coord), 9), 4) AS mean, round(round(stddev_pop(coord), 9), 4) AS stdev,
      CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 16 THEN 'medium' ELSE 'high' END AS confidence
    FROM positions WHERE coord IS NOT NULL GROUP BY 1, 2""")
def board_mass(t: Inputs):
    """Boards of phrases, resolved to terms and placed on the axes."""
    axes = t.v_memberships.select("axis_slug").distinct().withColumn(
        "harmonic_key", F.when(F.col("axis_slug") == "axis-half", "hardness").otherwise("register")
    )
    phrases = t.v_phrases.select("phrase_id", F.left("phrase_id", F.lit(2)).alias("board"))
    board = arr.boards_of_phrases(phrases, _resolved(t))
    return arr.center_of_mass(arr.board_positions(board, t.v_memberships, axes, t.v_atoms))
