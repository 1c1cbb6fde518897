"""Prompts, grading, templates and bootstrap files on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.operators import aggregates as ag
from lexweave.operators import bootstrap as bs
from lexweave.operators import evaluate as ev
from lexweave.operators import prompts as pm
from lexweave.operators import templates as tp
from lexweave.plans.registry import Inputs, query
from lexweave.plans.terms import DEGREE  # noqa: F401  (views of terms are registered there)
from lexweave.plans.views import VIEWS
from lexweave.session import cut_lineage

VIEWS.update(
    {
        # prompts: order lines put into words
        "v_prompts": """
            SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS prompt_id, l_orderkey AS image_id,
                   p_name || ' study, ' || CASE l_linenumber WHEN 1 THEN 'moody dreamcore light' WHEN 2 THEN '8k uhd' WHEN 3 THEN 'shot on Portra 400'
                     WHEN 4 THEN 'dark red and pale blue' WHEN 5 THEN 'in the style of Vaporwave' WHEN 6 THEN 'nikon d850' ELSE 'octane render' END
                   || ', in the style of ' || p_brand || ', ' || lower(p_type) || ' scene' AS prompt
            FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
        # pairs: the last answer of a conversation against its questions
        "v_files": "SELECT DISTINCT replace(lower(p_name), ' ', '_') || CASE WHEN p_type = 'PROMO' THEN 'ism' WHEN p_type = 'SMALL' THEN '_painters' WHEN p_type = 'LARGE' THEN '_combinations' ELSE '' END || '.txt' AS file FROM {part} UNION ALL SELECT 'material_' || r_name || '.txt' AS file FROM {region} UNION ALL SELECT 'body-tall.txt' AS file FROM {region} WHERE r_regionkey = 0",
        "v_file_terms": "SELECT replace(lower(p_name), ' ', '_') || CASE WHEN p_type = 'PROMO' THEN 'ism' WHEN p_type = 'SMALL' THEN '_painters' WHEN p_type = 'LARGE' THEN '_combinations' ELSE '' END || '.txt' AS file, 'a' || p_partkey AS atom_id FROM {part} UNION ALL SELECT 'body-tall.txt' AS file, 'a' || p_partkey AS atom_id FROM {part} WHERE p_size > 45",
    }
)

TYPED = """
    seg AS (SELECT prompt_id, image_id, trim(s) AS s FROM (SELECT prompt_id, image_id, unnest(string_split(prompt, ',')) AS s FROM v_prompts) WHERE NOT starts_with(lower(trim(s)), 'in the style of')),
    art AS (SELECT prompt_id, image_id, lower(trim(s[17:])) AS s FROM (SELECT prompt_id, image_id, trim(unnest(string_split(prompt, ','))) AS s FROM v_prompts) WHERE starts_with(lower(s), 'in the style of')),
    typed AS (
      SELECT *, CASE WHEN contains(lower(s), 'dreamcore') THEN 'core' WHEN contains(lower(s), 'vaporwave') THEN 'wave' WHEN contains(lower(s), 'octane render') THEN 'rendering_engine' WHEN contains(lower(s), '8k uhd') THEN 'quality_booster'
        WHEN contains(lower(s), 'portra') THEN 'film_stock' WHEN contains(lower(s), 'nikon') THEN 'camera_body' WHEN contains(lower(s), ' and ') THEN 'color_pair' WHEN artist THEN 'artist' END AS term_type
      FROM (SELECT *, false AS artist FROM seg UNION ALL SELECT *, true FROM art)),
    terms AS (SELECT prompt_id, image_id, CASE term_type WHEN 'core' THEN 'dreamcore' WHEN 'wave' THEN 'vaporwave' ELSE lower(s) END AS term, term_type FROM typed WHERE term_type IS NOT NULL)"""


@query("extract_terms", "Q22", f"WITH {TYPED} SELECT * FROM terms")
def extract_terms(t: Inputs):
    return pm.extract_terms(t.v_prompts)


@query("term_frequency", "A24", f"WITH {TYPED} SELECT term, term_type, count(DISTINCT prompt_id) AS prompts, count(DISTINCT image_id) AS images FROM terms GROUP BY 1, 2")
def term_frequency(t: Inputs):
    return ag.term_frequency(pm.extract_terms(t.v_prompts))


AUDIT = f"""
    {TYPED},
    freq AS (SELECT term, term_type, count(DISTINCT image_id) AS images FROM terms GROUP BY 1, 2),
    hits AS (SELECT term, term_type, id, category_slug FROM freq JOIN v_atoms ON status <> 'rejected' AND text_lower = CASE term WHEN 'brand#2' THEN 'red bolt' ELSE 'none' END),
    per AS (SELECT term, term_type, count(*) AS atoms FROM hits GROUP BY 1, 2),
    audit AS (SELECT f.term, f.term_type, images, CASE WHEN f.term_type IN ('film_stock', 'camera_body', 'quality_booster', 'rendering_engine') THEN 'skipped' WHEN atoms > 0 THEN 'found' ELSE 'missing' END AS status,
      CASE WHEN atoms > 1 THEN 'classification_inconsistency' END AS issue, coalesce(atoms, 0) AS atoms FROM freq f LEFT JOIN per USING (term, term_type))"""


def _audit(t: Inputs):
    freq = ag.term_frequency(pm.extract_terms(t.v_prompts)).select("term", "term_type", "images")
    atoms = t.v_atoms.withColumn("text_lower", F.when(F.col("text_lower") == "red bolt", "brand#2").otherwise(F.concat(F.lit("x"), "text_lower")))
    return pm.audit_terms(freq, atoms)


@query("audit_terms", "Q23 T1", f"WITH {AUDIT} SELECT term, term_type, images, status, issue, atoms FROM audit")
def audit_terms(t: Inputs):
    return _audit(t).drop("via")


@query("audit_terms_whole", "Q23 T1 V1", """
    WITH live AS (SELECT id, text_lower, category_slug FROM v_atoms WHERE status <> 'rejected'),
    terms AS (
      SELECT DISTINCT lower(p_name) AS term, 'core' AS term_type, 1 AS images FROM part
      UNION ALL SELECT DISTINCT split_part(lower(p_name), ' ', 1), 'punk', 1 FROM part
      UNION ALL SELECT 'near ' || id, 'artist', 1 + label FROM v_vectors
      UNION ALL SELECT DISTINCT lower(p_type), 'camera_body', 9 FROM part),
    exact AS (SELECT term, id, category_slug FROM (SELECT DISTINCT term FROM terms WHERE term_type <> 'camera_body') JOIN live ON text_lower = term),
    found AS (SELECT term, id, category_slug FROM (SELECT DISTINCT term FROM terms WHERE term_type IN ('core', 'punk') AND term NOT IN (SELECT term FROM exact)) JOIN live
      ON contains(' ' || text_lower || ' ', ' ' || term || ' ')),
    sims AS (SELECT a.id AS q, b.id AS n, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS score FROM v_vectors a, v_vectors b WHERE a.label >= 2),
    near AS (SELECT 'near ' || q AS term, n AS id FROM sims QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, n) = 1 AND score >= 0.6),
    hits AS (
      SELECT *, 'exact' AS via FROM exact UNION ALL SELECT *, 'search' FROM found
      UNION ALL SELECT near.term, live.id, category_slug, 'semantic' FROM near JOIN live ON live.id = near.id),
    per AS (
      SELECT t.term, t.term_type, min(via) AS via, count(*) AS atoms,
        count(*) FILTER (category_slug IS NOT NULL AND category_slug NOT IN ('style.genre', 'style.medium', 'style.era', 'reference.person', 'reference.film')) AS odd
      FROM terms t JOIN hits h USING (term) WHERE t.term_type <> 'camera_body' GROUP BY 1, 2)
    SELECT t.term, t.term_type, t.images, CASE WHEN t.term_type = 'camera_body' THEN 'skipped' WHEN atoms > 0 THEN 'found' ELSE 'missing' END AS status, via,
      CASE WHEN odd > 0 THEN 'classification_inconsistency' WHEN atoms > 1 THEN 'duplicate' END AS issue, coalesce(atoms, 0) AS atoms
    FROM terms t LEFT JOIN per p ON p.term = t.term AND p.term_type = t.term_type""")
def audit_terms_whole(t: Inputs):
    """Known texts, their first words and terms with vectors: all three passes on the texts as they stand."""
    rows = [
        t.part.select(F.lower("p_name").alias("term"), F.lit("core").alias("term_type"), F.lit(1).alias("images")).distinct(),
        t.part.select(F.split(F.lower("p_name"), " ")[0].alias("term"), F.lit("punk").alias("term_type"), F.lit(1).alias("images")).distinct(),
        t.v_vectors.select(F.concat(F.lit("near "), "id").alias("term"), F.lit("artist").alias("term_type"), (1 + F.col("label")).cast("int").alias("images")),
        t.part.select(F.lower("p_type").alias("term"), F.lit("camera_body").alias("term_type"), F.lit(9).alias("images")).distinct(),
    ]
    terms = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    term_vectors = t.v_vectors.select(F.concat(F.lit("near "), "id").alias("term"), "vec")
    return pm.audit_terms(terms, t.v_atoms, term_vectors=term_vectors, vectors=t.v_vectors.select("id", "vec"))


@query("vocab_audit_summary", "A25", f"""
    WITH {AUDIT} SELECT term_type, count(*) AS terms, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'skipped') AS skipped, count(issue) AS issues FROM audit GROUP BY 1""")
def vocab_audit_summary(t: Inputs):
    return ag.vocab_audit_summary(_audit(t))


# --- grading --------------------------------------------------------------


def _pairs(t: Inputs):
    """Conversations with an answer: the last answer against all questions."""
    rows = t.conversations.groupBy(F.col("conv_id").cast("string").alias("image_id")).agg(
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("candidate"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.concat("text", F.lit(", in the style of Someone, 8K uhd")).alias("text"))))).alias("r"),
    )
    return rows.filter(F.col("candidate").isNotNull() & (F.size("r") > 0)).select("image_id", "candidate", F.col("r.text").alias("references"))


STEM_SQL = "CASE WHEN length({w}) < 5 THEN {w} " + " ".join(
    f"WHEN ends_with({{w}}, '{s}') AND length({{w}}) - {len(s)} >= 3 THEN left({{w}}, length({{w}}) - {len(s)})" for s in ev.STEM_SUFFIXES
) + " ELSE {w} END"
WS = "concat(' ', chr(9), chr(10), chr(13))"
# the check engine measures distance in bytes, so accented letters become one-byte marks
ACC = "'àâäáãçèéêëìíîïñòóôöõùúûüßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ1'"
PAIRS = f"""
    cand AS (SELECT CAST(conv_id AS VARCHAR) AS image_id, arg_max(text, turn) AS candidate FROM conversations WHERE role = 'assistant' GROUP BY 1),
    refs AS (SELECT CAST(conv_id AS VARCHAR) AS image_id, turn, text || ', in the style of Someone, 8K uhd' AS ref FROM conversations WHERE role = 'user' AND CAST(conv_id AS VARCHAR) IN (SELECT image_id FROM cand)),
    pair AS (SELECT * FROM cand WHERE image_id IN (SELECT image_id FROM refs)),
    seg AS (SELECT image_id, s FROM (SELECT image_id, lower(trim(unnest(string_split(candidate, ',')), {WS})) AS s FROM pair) WHERE s <> ''),
    words AS (SELECT DISTINCT image_id, w FROM (SELECT image_id, unnest(regexp_split_to_array(s, '\\s+')) AS w FROM seg) WHERE w <> ''),
    stemmed AS (SELECT image_id, array_to_string(list_transform(regexp_split_to_array(s, '\\s+'), lambda w: {STEM_SQL.format(w='w')}), ' ') AS s FROM seg),
    tok AS (SELECT DISTINCT image_id, token FROM (SELECT image_id, lower(trim(unnest(string_split(ref, ',')), {WS})) AS token FROM refs) WHERE token <> '' AND NOT starts_with(token, 'in the style of') AND token <> '8k uhd' AND token <> 'someone'),
    graded AS (SELECT image_id, token,
        EXISTS (SELECT 1 FROM seg g WHERE g.image_id = t.image_id AND contains(g.s, t.token)) AS exact_hit,
        EXISTS (SELECT 1 FROM stemmed g WHERE g.image_id = t.image_id AND contains(g.s, {STEM_SQL.format(w='t.token')})) AS stem_hit,
        EXISTS (SELECT 1 FROM words g WHERE g.image_id = t.image_id AND abs(length(g.w) - length(t.token)) <= 3 AND levenshtein(translate(g.w, {ACC}), translate(t.token, {ACC})) <= CASE WHEN length(t.token) < 10 THEN 2 ELSE 3 END) AS near_hit
      FROM tok t)"""


@query("vocabulary_overlap", "E1 X3", f"""
    WITH {PAIRS}
    SELECT p.image_id, count(token) AS total, count(*) FILTER (exact_hit OR stem_hit OR near_hit) AS matched,
      CASE WHEN count(token) = 0 THEN 1.0 ELSE count(*) FILTER (exact_hit OR stem_hit OR near_hit) / count(token) END AS vocabulary_overlap
    FROM pair p LEFT JOIN graded g USING (image_id) GROUP BY 1""")
def vocabulary_overlap(t: Inputs):
    return ev.vocabulary_overlap(_pairs(t))


FORM = r"""
    wc AS (SELECT image_id, avg(len(list_filter(regexp_split_to_array(ref, '\s+'), lambda w: w <> ''))) AS words, avg(len(regexp_extract_all(ref, ',')) / (len(regexp_extract_all(ref, ',')) + len(regexp_extract_all(ref, '[.!?](\s|$)')) + 1)) AS commas FROM refs GROUP BY 1),
    form AS (SELECT p.image_id, len(list_filter(regexp_split_to_array(candidate, '\s+'), lambda w: w <> '')) / words AS length_ratio,
        greatest(0, 1 - abs(len(regexp_extract_all(candidate, ',')) / (len(regexp_extract_all(candidate, ',')) + len(regexp_extract_all(candidate, '[.!?](\s|$)')) + 1) - commas)) AS structure_score FROM pair p JOIN wc USING (image_id))"""


@query("grade", "E2", f"""
    WITH {PAIRS}, {FORM},
    v AS (SELECT p.image_id, count(token) AS total, count(*) FILTER (exact_hit OR stem_hit OR near_hit) AS matched FROM pair p LEFT JOIN graded g USING (image_id) GROUP BY 1),
    s AS (SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE matched / total END AS voc FROM v JOIN form USING (image_id))
    SELECT image_id, total, matched, floor(voc * 1000 + 0.5) / 1000 AS vocabulary_overlap, floor(length_ratio * 100 + 0.5) / 100 AS length_ratio, floor(structure_score * 1000 + 0.5) / 1000 AS structure_score,
      floor((voc * 0.5 + (1 - least(abs(length_ratio - 1), 1)) * 0.25 + structure_score * 0.25) * 1000 + 0.5) / 1000 AS combined FROM s""")
def grade(t: Inputs):
    return ev.grade(_pairs(t))


@query("divergences", "E3", f"""
    WITH {PAIRS}, {FORM}
    SELECT image_id, 'vocabulary_miss' AS divergence, token AS term FROM graded WHERE NOT (exact_hit OR stem_hit OR near_hit)
    UNION ALL SELECT image_id, CASE WHEN length_ratio > 2 THEN 'length_excess' ELSE 'length_deficit' END, NULL FROM form WHERE length_ratio > 2 OR length_ratio < 0.5
    UNION ALL SELECT image_id, 'structure_prose', NULL FROM form WHERE structure_score < 0.5
    UNION ALL SELECT image_id, 'artist_missing', 'someone' FROM pair WHERE NOT contains(lower(candidate), 'someone')
    UNION ALL SELECT image_id, 'booster_missing', '8k uhd' FROM refs JOIN pair USING (image_id) WHERE NOT contains(lower(candidate), '8k uhd')""")
def divergences(t: Inputs):
    return ev.divergences(_pairs(t))


@query("divergence_counts", "A23", f"""
    WITH {PAIRS}, {FORM},
    d AS (SELECT 'vocabulary_miss' AS divergence FROM graded WHERE NOT (exact_hit OR stem_hit OR near_hit)
    UNION ALL SELECT CASE WHEN length_ratio > 2 THEN 'length_excess' ELSE 'length_deficit' END FROM form WHERE length_ratio > 2 OR length_ratio < 0.5
    UNION ALL SELECT 'structure_prose' FROM form WHERE structure_score < 0.5
    UNION ALL SELECT 'artist_missing' FROM pair WHERE NOT contains(lower(candidate), 'someone')
    UNION ALL SELECT 'booster_missing' FROM refs JOIN pair USING (image_id) WHERE NOT contains(lower(candidate), '8k uhd'))
    SELECT divergence, count(*) AS n FROM d GROUP BY 1""")
def divergence_counts(t: Inputs):
    return ag.top_counts(ev.divergences(_pairs(t)), "divergence")


# --- bootstrap files ------------------------------------------------------


@query("classify_files", "N8", """
    SELECT file, CASE WHEN contains(file, '_combinations') OR starts_with(file, 'material_') THEN 'content' WHEN file = 'body-tall.txt' THEN 'axis' WHEN ends_with(file, 'ism.txt') OR ends_with(file, '_painters.txt') THEN 'movement' ELSE 'unmatched' END AS kind,
      CASE WHEN starts_with(file, 'material_') THEN 'material-class:' || lower(replace(file[10:], '.txt', '')) WHEN ends_with(file, 'ism.txt') OR ends_with(file, '_painters.txt') THEN 'movement:' || replace(replace(file, '.txt', ''), '_', '-') ELSE '' END AS tags,
      CASE WHEN file = 'body-tall.txt' THEN 'body-height' END AS axis, contains(file, '_combinations') AS skip_co_membership FROM v_files""")
def classify_files(t: Inputs):
    return bs.classify_files(t.v_files).select("file", "kind", F.array_join("tags", "|").alias("tags"), "axis", "skip_co_membership")


CO = """
    mem AS (SELECT DISTINCT file, atom_id FROM v_file_terms WHERE NOT contains(file, '_combinations')),
    small AS (SELECT * FROM mem WHERE file IN (SELECT file FROM mem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)),
    co AS (SELECT DISTINCT a.atom_id AS atom_a_id, b.atom_id AS atom_b_id FROM small a JOIN small b ON a.file = b.file AND a.atom_id < b.atom_id)"""


@query("co_membership_edges", "N6", f"WITH {CO} SELECT *, 0.5::DOUBLE AS strength, 'wbs:wildcard-co-membership:' || atom_a_id || ':' || atom_b_id AS id FROM co")
def co_membership_edges(t: Inputs):
    return bs.co_membership_edges(t.v_file_terms, bs.classify_files(t.v_files))


MOVE = """
    named AS (SELECT min(id) AS movement_id, replace(text_lower, ' ', '_') AS base FROM v_atoms GROUP BY text_lower),
    mv AS (SELECT DISTINCT least(atom_id, movement_id) AS atom_a_id, greatest(atom_id, movement_id) AS atom_b_id FROM v_file_terms JOIN named ON file = base || '_painters.txt' WHERE atom_id <> movement_id)"""


def _movement_atoms(t: Inputs):
    return t.v_atoms.withColumn("text_lower", F.concat("text_lower", F.lit(" painters")))


@query("movement_edges", "N7", f"WITH {MOVE} SELECT atom_a_id, atom_b_id, 0.7::DOUBLE AS strength, 'wbs:movement-membership:' || atom_a_id || ':' || atom_b_id AS id FROM mv")
def movement_edges(t: Inputs):
    return bs.movement_edges(t.v_file_terms, bs.classify_files(t.v_files), _movement_atoms(t))


@query("bootstrap_payloads", "N9 N10", f"""
    WITH {CO}, {MOVE},
    tags AS (SELECT DISTINCT atom_id, 'movement:' || replace(replace(file, '.txt', ''), '_', '-') AS slug FROM v_file_terms WHERE ends_with(file, 'ism.txt') OR ends_with(file, '_painters.txt')
      UNION SELECT atom_id, tag_id FROM v_atom_tags)
    SELECT 'tags' AS payload, count(DISTINCT slug) AS n FROM tags UNION ALL SELECT 'atom_tags', count(*) FROM tags
    UNION ALL SELECT 'memberships', count(DISTINCT atom_id) FROM v_file_terms WHERE file = 'body-tall.txt'
    UNION ALL SELECT 'co_membership', count(*) FROM co UNION ALL SELECT 'movement', count(*) FROM mv
    UNION ALL SELECT 'missing_tags', count(*) FROM tags WHERE starts_with(slug, 'movement:')""")
def bootstrap_payloads(t: Inputs):
    known = t.v_atom_tags.select(F.col("tag_id").alias("slug")).distinct()
    out = bs.bootstrap_payloads(t.v_file_terms, bs.classify_files(t.v_files), t.v_atom_tags.select("atom_id", F.col("tag_id").alias("tag")), _movement_atoms(t), known)
    return bs.payload_counts(out)


# --- templates ------------------------------------------------------------

SLOTS = [(f"t{k}", f"slot_{'abcde'[j]}", ["line.economy", "size.small", "line.promo", "size.medium", "line.standard"][(j + k) % 5], j < 2, j + 1) for k in range(3) for j in range(3)]
SLOT_ROWS = ", ".join(f"('{t}', '{s}', '{c}', {str(r).lower()}, {o})" for t, s, c, r, o in SLOTS)


def _slots(t: Inputs):
    return t.spark.createDataFrame(SLOTS, "template string, slot_name string, category_filter string, required boolean, sort_order int")


@query("slot_order", "W11", f"""
    WITH slots(template, slot_name, category_filter, required, sort_order) AS (VALUES {SLOT_ROWS}),
    req AS (SELECT s_suppkey::VARCHAR AS request_id, 't' || (s_nationkey % 3) AS template, CASE WHEN s_acctbal > 3000 THEN (SELECT min(slug) FROM v_arrangement_weights) END AS arrangement FROM supplier),
    seeds AS (SELECT s_suppkey::VARCHAR AS request_id, 'slot_c' AS slot_name FROM supplier WHERE s_acctbal > 5000)
    SELECT r.request_id, s.slot_name, row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN e.request_id IS NULL THEN 1 ELSE 0 END, -coalesce(w.weight, 1.0), sort_order, s.slot_name) AS rank
    FROM req r JOIN slots s USING (template) LEFT JOIN seeds e ON e.request_id = r.request_id AND e.slot_name = s.slot_name
    LEFT JOIN v_arrangement_weights w ON w.slug = r.arrangement AND w.category_slug = s.category_filter""")
def slot_order(t: Inputs):
    first = t.v_arrangement_weights.agg(F.min("slug").alias("first"))
    rows = t.supplier.withColumn("one", F.lit(1)).join(first.withColumn("one", F.lit(1)), "one")
    requests = rows.select(
        F.col("s_suppkey").cast("string").alias("request_id"), F.concat(F.lit("t"), F.col("s_nationkey") % 3).alias("template"),
        F.when(F.col("s_acctbal") > 3000, F.col("first")).alias("arrangement"),
    )
    seeded = F.when(F.col("s_acctbal") > 5000, "slot_c").otherwise("none")
    seeds = t.supplier.select(F.col("s_suppkey").cast("string").alias("request_id"), seeded.alias("slot_name"), F.lit("a1").alias("atom_id"))
    return tp.slot_order(requests, _slots(t), seeds, t.v_arrangement_weights).select("request_id", "slot_name", "rank")


@query("weighted_pick", "K4", """
    WITH c AS (SELECT atom_a_id AS request_id, atom_b_id AS atom_id, max(strength) AS score FROM v_edges GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, atom_id) AS place FROM c),
    u AS (SELECT *, (('0x' || left(md5(request_id || ':' || atom_id || ':11'), 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS u FROM r WHERE place <= 5)
    SELECT request_id, arg_min(atom_id, (-ln(u) / (score * score + 0.05), atom_id)) AS atom_id, count(*) AS offered FROM u GROUP BY 1""")
def weighted_pick(t: Inputs):
    cands = t.v_edges.groupBy(F.col("atom_a_id").alias("request_id"), F.col("atom_b_id").alias("atom_id")).agg(F.max("strength").alias("score"))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "atom_id")
    cands = cands.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= tp.PICK_FROM)
    offered = cands.groupBy("request_id").agg(F.count("*").alias("offered"))
    return tp.weighted_pick(cands, ["request_id"], "score", seed=11).join(offered, "request_id").select("request_id", "atom_id", "offered")


def _fills(t: Inputs):
    """The requests and their fills, as tables since both are read more than once."""
    requests, fills = _fill_requests(t)
    return cut_lineage(requests), cut_lineage(fills)


def _fill_requests(t: Inputs):
    """One request per supplier over three templates named after its region."""
    sup = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = F.conv(F.left(F.md5("slug"), F.lit(8)), 16, 10).cast("long") % 8
    names = t.v_arrangements.select("slug", part.alias("n")).groupBy("n").agg(F.min("slug").alias("slug"))
    requests = sup.withColumn("n", F.col("s_suppkey") % 8).join(names, "n", "left").select(
        F.col("s_suppkey").cast("string").alias("request_id"), F.concat(F.lit("t"), F.col("n_regionkey") % 3).alias("template"),
        F.when(F.col("s_acctbal") > 3000, F.col("slug")).alias("arrangement"), F.lit("visual").alias("modality"),
        F.when(F.col("s_acctbal") > 8000, "photo").alias("render_mode"), (F.col("s_acctbal") > 5000).alias("has_intent"),
    )
    slots = _slots(t)
    first = t.v_atoms.filter(F.col("category_slug") == "line.promo").groupBy("collection_slug").agg(F.min("id").alias("atom_id"))
    seeds = requests.withColumn("collection_slug", F.concat(F.lit("brand-"), F.col("request_id").cast("int") % 25 + 1)).filter(F.col("has_intent")).join(
        first, "collection_slug"
    ).select("request_id", F.lit("slot_a").alias("slot_name"), "atom_id")
    shown = t.lineitem.groupBy(F.concat(F.lit("t"), F.col("l_linenumber") % 3).alias("template"), F.concat(F.lit("a"), "l_partkey").alias("atom_id")).agg(
        F.count("*").cast("int").alias("frequency")
    )
    exemplars = shown.select("template", F.lit("slot_b").alias("slot_name"), "atom_id", "frequency")
    profiles = t.v_arrangements.withColumn("context_key", F.when(F.col("register").isNull(), "F").otherwise("none"))
    contexts = t.v_category_contexts.filter(F.col("category_slug") == "size.medium")
    intents = requests.filter("has_intent").select("request_id").join(
        t.v_relations.filter(F.col("relation_type") == "modifier").select(F.regexp_replace("target_atom_id", "^a", "").alias("request_id"), F.col("source_atom_id").alias("atom_id"), F.col("strength")),
        "request_id",
    ).groupBy("request_id", "atom_id").agg(F.max("strength").alias("intent_score"))
    fills = tp.fill_slots(
        requests, slots, seeds, t.v_atoms, exemplars, profiles, t.v_arrangement_weights, contexts, t.v_edges, t.v_relations, intents, seed=11
    )
    return requests, fills

def _weight(name: str) -> str:
    return f"CASE WHEN profiled THEN {tp.WEIGHTS_WITH_PROFILE[name]} ELSE {tp.WEIGHTS_PLAIN[name]} END"


_GAPS = " + ".join(f"abs(coalesce(a.{d}, 0.5) - coalesce(p.{d}, 0.5))" for d in tp.PROFILE)


def _round(n: int) -> str:
    """One slot of every request: all candidates of the pool scored, the best five offered, one picked."""
    return f"""
    ask{n} AS (SELECT * FROM plan WHERE rank = {n} AND seed_id IS NULL AND guidance IS NULL),
    res{n} AS (SELECT c.request_id, r.atom_id, sum(r.resonance) AS resonance FROM done{n - 1} c JOIN resonance r ON r.chosen_id = c.atom_id GROUP BY 1, 2),
    boost{n} AS (SELECT k.request_id, f.atom_id, max(f.affinity) * 0.3 AS boost FROM ask{n} k JOIN done{n - 1} c USING (request_id) JOIN affinity f ON f.chosen_id = c.atom_id
      WHERE f.context = '' OR f.context = k.arrangement GROUP BY 1, 2),
    raw{n} AS (
      SELECT k.request_id, k.slot_name, a.id AS atom_id, k.has_intent, p.slug IS NOT NULL AS profiled, coalesce(x.share, 0) AS ex, coalesce(r.resonance, 0) AS res,
        coalesce(i.intent_score, 0) AS intent, coalesce(b.boost, 0) AS boost, CASE a.tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.2 END AS tier,
        CASE WHEN p.slug IS NULL THEN 0 ELSE 1 - ({_GAPS}) / 6 END AS harmonic,
        EXISTS (SELECT 1 FROM opposed o WHERE o.atom_id = a.id AND (o.context = k.arrangement OR o.context = k.mode_context)) AS bad
      FROM ask{n} k JOIN v_atoms a ON a.status <> 'rejected' AND a.category_slug = k.category_filter
      LEFT JOIN v_arrangements p ON p.slug = k.arrangement
      LEFT JOIN shares x ON x.template = k.template AND x.slot_name = k.slot_name AND x.atom_id = a.id
      LEFT JOIN intents i ON i.request_id = k.request_id AND i.atom_id = a.id
      LEFT JOIN res{n} r ON r.request_id = k.request_id AND r.atom_id = a.id
      LEFT JOIN boost{n} b ON b.request_id = k.request_id AND b.atom_id = a.id
      WHERE NOT EXISTS (SELECT 1 FROM done{n - 1} c WHERE c.request_id = k.request_id AND c.atom_id = a.id)),
    scored{n} AS (
      SELECT *, round(((({_weight("exemplar")}) + CASE WHEN has_intent THEN 0 ELSE {_weight("semantic")} END) * ex
          + ({_weight("resonance")}) * res / greatest(max(res) OVER (PARTITION BY request_id), 0.001) + ({_weight("harmonic")}) * harmonic + ({_weight("tier")}) * tier
          + CASE WHEN has_intent THEN {_weight("semantic")} ELSE 0 END * intent + boost)::DOUBLE, 9) AS score,
        bool_and(bad) OVER (PARTITION BY request_id) AS all_bad FROM raw{n}),
    best{n} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, atom_id) AS place FROM scored{n} WHERE NOT bad OR all_bad QUALIFY place <= 5),
    pick{n} AS (
      SELECT request_id, any_value(slot_name) AS slot_name,
        arg_min({{'atom_id': atom_id, 'score': score}}, (-ln((('0x' || left(md5(request_id || ':' || slot_name || ':' || atom_id || ':11'), 8))::BIGINT + 1) / 4294967297.0::DOUBLE) / (score * score + 0.05), atom_id)) AS w
      FROM best{n} GROUP BY 1),
    other{n} AS (SELECT b.request_id, string_agg(b.atom_id, '|' ORDER BY b.place) FILTER (b.o <= 3) AS alternatives FROM (
        SELECT b.*, row_number() OVER (PARTITION BY b.request_id ORDER BY b.place) AS o FROM best{n} b JOIN pick{n} p ON p.request_id = b.request_id AND p.w.atom_id <> b.atom_id) b GROUP BY 1),
    new{n} AS (
      SELECT request_id, slot_name, sort_order, seed_id AS atom_id, NULL AS guidance, 1.0::DOUBLE AS score, NULL AS alternatives FROM plan WHERE rank = {n} AND seed_id IS NOT NULL
      UNION ALL SELECT request_id, slot_name, sort_order, NULL, guidance, 1.0, NULL FROM plan WHERE rank = {n} AND seed_id IS NULL AND guidance IS NOT NULL
      UNION ALL SELECT k.request_id, k.slot_name, k.sort_order, p.w.atom_id, NULL, round(p.w.score::DECIMAL(18, 9), 3)::DOUBLE, o.alternatives FROM ask{n} k JOIN pick{n} p USING (request_id) LEFT JOIN other{n} o USING (request_id)
      UNION ALL SELECT request_id, slot_name, sort_order, NULL, NULL, 0.0, NULL FROM ask{n} WHERE required AND request_id NOT IN (SELECT request_id FROM pick{n})),
    done{n} AS (SELECT request_id, atom_id FROM done{n - 1} UNION ALL SELECT request_id, atom_id FROM new{n} WHERE atom_id IS NOT NULL)"""


FILLS = f"""
    slots(template, slot_name, category_filter, required, sort_order) AS (VALUES {SLOT_ROWS}),
    names AS (SELECT ('0x' || left(md5(slug), 8))::BIGINT % 8 AS n, min(slug) AS slug FROM v_arrangements GROUP BY 1),
    requests AS (
      SELECT s_suppkey::VARCHAR AS request_id, 't' || (n_regionkey % 3) AS template, CASE WHEN s_acctbal > 3000 THEN slug END AS arrangement,
        CASE WHEN s_acctbal > 8000 THEN 'render_mode=photo' END AS mode_context, s_acctbal > 5000 AS has_intent
      FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN names ON names.n = s_suppkey % 8),
    firsts AS (SELECT collection_slug, min(id) AS atom_id FROM v_atoms WHERE category_slug = 'line.promo' GROUP BY 1),
    seeds AS (SELECT request_id, 'slot_a' AS slot_name, atom_id FROM requests JOIN firsts ON collection_slug = 'brand-' || (request_id::INT % 25 + 1) WHERE has_intent),
    shown AS (SELECT 't' || (l_linenumber % 3) AS template, 'a' || l_partkey AS atom_id, count(*) AS n FROM lineitem GROUP BY 1, 2),
    shares AS (SELECT template, 'slot_b' AS slot_name, atom_id, n / max(n) OVER (PARTITION BY template) AS share FROM shown),
    intents AS (SELECT q.request_id, r.source_atom_id AS atom_id, max(r.strength) AS intent_score FROM requests q JOIN v_relations r
      ON r.relation_type = 'modifier' AND substr(r.target_atom_id, 2) = q.request_id WHERE q.has_intent GROUP BY 1, 2),
    ends AS (SELECT source_atom_id AS atom_id, target_atom_id AS chosen_id, * FROM v_relations UNION ALL SELECT target_atom_id, source_atom_id, * FROM v_relations),
    affinity AS (SELECT atom_id, chosen_id, coalesce(context, '') AS context, max(strength * confidence) AS affinity FROM ends WHERE relation_type = 'compositional' GROUP BY 1, 2, 3),
    opposed AS (SELECT DISTINCT atom_id, context FROM ends WHERE relation_type = 'oppositional' AND context IS NOT NULL AND strength >= 0.7 AND confidence >= 0.6),
    resonance AS (SELECT atom_id, chosen_id, sum(strength) AS resonance FROM (
      SELECT atom_a_id AS atom_id, atom_b_id AS chosen_id, strength, relationship_type FROM v_edges UNION ALL SELECT atom_b_id, atom_a_id, strength, relationship_type FROM v_edges)
      WHERE relationship_type IN ('resonates', 'evokes') GROUP BY 1, 2),
    plan AS (
      SELECT q.request_id, q.template, q.arrangement, q.mode_context, q.has_intent, s.slot_name, s.category_filter, s.required, s.sort_order, e.atom_id AS seed_id, g.guidance,
        row_number() OVER (PARTITION BY q.request_id ORDER BY CASE WHEN e.atom_id IS NULL THEN 1 ELSE 0 END, -coalesce(w.weight, 1.0), s.sort_order, s.slot_name) AS rank
      FROM requests q JOIN slots s USING (template) LEFT JOIN seeds e ON e.request_id = q.request_id AND e.slot_name = s.slot_name
      LEFT JOIN v_arrangement_weights w ON w.slug = q.arrangement AND w.category_slug = s.category_filter
      LEFT JOIN v_arrangements p ON p.slug = q.arrangement
      LEFT JOIN v_category_contexts g ON g.category_slug = 'size.medium' AND g.category_slug = s.category_filter AND g.context_mode = 'replace' AND g.guidance <> ''
        AND g.context = CASE WHEN p.slug IS NULL THEN NULL WHEN p.register IS NULL THEN 'F' ELSE 'none' END),
    done0 AS (SELECT request_id, seed_id AS atom_id FROM plan WHERE FALSE),
    {_round(1)}, {_round(2)}, {_round(3)},
    fills AS (
      SELECT f.request_id, f.slot_name, f.sort_order, f.atom_id, coalesce(f.guidance, a.text, '') AS text, f.score, f.alternatives
      FROM (SELECT * FROM new1 UNION ALL SELECT * FROM new2 UNION ALL SELECT * FROM new3) f LEFT JOIN v_atoms a ON a.id = f.atom_id)"""


@query("fill_slots", "I1 K4 W11", f"WITH {FILLS} SELECT * FROM fills")
def fill_slots(t: Inputs):
    return _fills(t)[1].withColumn("alternatives", F.array_join("alternatives.atom_id", "|"))


@query("assemble_prompts", "I2", f"""
    WITH {FILLS},
    t AS (SELECT q.request_id, q.template,
        coalesce(max(text) FILTER (slot_name = 'slot_a' AND text <> ''), '{{slot_a}}') AS a, coalesce(max(text) FILTER (slot_name = 'slot_b' AND text <> ''), '{{slot_b}}') AS b,
        coalesce(max(text) FILTER (slot_name = 'slot_c' AND text <> ''), '{{slot_c}}') AS c, coalesce(string_agg(text, ', ' ORDER BY sort_order) FILTER (text <> ''), '') AS joined
      FROM requests q LEFT JOIN fills USING (request_id) GROUP BY 1, 2),
    put AS (SELECT *, CASE template WHEN 't0' THEN 'a ' || a || ', ' || b || ', ' || c WHEN 't1' THEN b || ' (' || a || ', {{slot_x}}), ' || c END AS p FROM t)
    SELECT request_id, CASE WHEN p IS NULL THEN joined ELSE
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\\{{[a-z_]+\\}}', '', 'g'), ',\\s*,', ',', 'g'), '\\(\\s*,', '(', 'g'), ',\\s*\\)', ')', 'g'), '^[,\\s]+|[,\\s]+$', '', 'g')
      END AS prompt FROM put""")
def assemble_prompts(t: Inputs):
    requests, fills = _fills(t)
    texts = [("t0", "a {slot_a}, {slot_b}, {slot_c}"), ("t1", "{slot_b} ({slot_a}, {slot_x}), {slot_c}"), ("t2", None)]
    templates = t.spark.createDataFrame(texts, "template string, template_text string")
    return tp.assemble_prompts(fills, requests, templates)


@query("fill_report", "I3", f"""
    WITH {FILLS} SELECT request_id, count(*) AS slots, coalesce(round(avg(score) FILTER (score > 0)::DECIMAL(18, 9), 3)::DOUBLE, 0.0) AS total_score FROM fills GROUP BY 1""")
def fill_report(t: Inputs):
    return tp.fill_report(_fills(t)[1])


@query("fill_oppositions", "I3 J14", f"""
    WITH {FILLS},
    p AS (SELECT DISTINCT request_id, atom_id FROM fills WHERE atom_id IS NOT NULL),
    o AS (SELECT DISTINCT least(atom_a_id, atom_b_id) AS a, greatest(atom_a_id, atom_b_id) AS b FROM v_edges WHERE relationship_type = 'opposes')
    SELECT x.request_id, o.a AS atom_a_id, o.b AS atom_b_id, ta.text AS text_a, tb.text AS text_b
    FROM p x JOIN p y ON x.request_id = y.request_id JOIN o ON o.a = x.atom_id AND o.b = y.atom_id JOIN v_atoms ta ON ta.id = o.a JOIN v_atoms tb ON tb.id = o.b""")
def fill_oppositions(t: Inputs):
    return tp.fill_oppositions(_fills(t)[1], t.v_edges, t.v_atoms)
