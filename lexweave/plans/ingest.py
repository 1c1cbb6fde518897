"""Sources, chunking, feeds, gate and model rows on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave.functions import folds, html as hx
from lexweave.operators import chunking as ch
from lexweave.operators import feeds as fd
from lexweave.operators import gate as gt
from lexweave.operators import knowledge as kn
from lexweave.operators import model_rows as mr
from lexweave.plans.registry import Inputs, query
from lexweave.plans.terms import DEGREE  # noqa: F401  (views of terms are registered there)
from lexweave.plans.views import VIEWS
from lexweave.session import checkpoint_dir
from lexweave.sources import payloads as pl
from lexweave.sources import readers as rd
from lexweave.sources import sinks as sk

VIEWS.update(
    {
        "v_feed_items": """
            SELECT doc_id AS item_id, source AS source_id, 'u' || doc_id AS url, text FROM {documents}
            UNION ALL SELECT 1000000 + p_partkey AS item_id, 'src' || (p_size % 20) AS source_id, 'p' || p_partkey AS url,
              'A ' || p_name || '-like, ' || lower(p_type) || ' thing: ' || p_brand || ' art deco' AS text FROM {part}""",
        "v_feed_sources": """
            SELECT source AS source_id, CASE WHEN source < 'src14' THEN 'core' WHEN source < 'src3' THEN 'adjacent' ELSE 'long_tail' END AS tier,
                   CASE WHEN source < 'src17' THEN 1.0 ELSE 1.5 END AS weight
            FROM {documents} GROUP BY source""",
    }
)


def staging(t: Inputs, name: str) -> str:
    """A fresh folder beside the checkpoints for a file-reading query."""
    return f"{checkpoint_dir(t.spark)}/staged/{uuid.uuid4().hex}/{name}"


# --- file sources ---------------------------------------------------------


@query("read_csv_terms", "S1", """
    SELECT p_name AS text, lower(p_name) AS text_lower, lower(p_type) || '|' || p_brand AS tags, 'brands' AS collection_slug FROM part""")
def read_csv_terms(t: Inputs):
    path = staging(t, "csv")
    rows = t.part.select(F.concat(F.lit(" "), "p_name").alias("term"), F.concat(F.lower("p_type"), F.lit(", ,"), "p_brand").alias("labels"))
    blank = t.nation.select(F.lit("  ").alias("term"), F.col("n_name").alias("labels"))
    rows.unionByName(blank).write.csv(path, header=True)
    out = rd.read_csv_terms(t.spark, path, text_col="term", tags_col="labels", collection="brands")
    return out.select("text", "text_lower", F.array_join("tags", "|").alias("tags"), "collection_slug")


@query("read_quoted_csv", "S2", """
    SELECT CAST(p_partkey AS VARCHAR) AS id, 'the "' || p_name || '", ' || p_type AS title FROM part""")
def read_quoted_csv(t: Inputs):
    path = staging(t, "csv")
    quoted = F.concat(F.lit('"the ""'), "p_name", F.lit('"", '), "p_type", F.lit('"'))
    good = t.part.select(F.concat_ws(",", F.col("p_partkey").cast("string"), quoted).alias("value"))
    bad = t.nation.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.lit("x"), "n_name").alias("value"))
    good.unionByName(bad).write.text(path)
    return rd.read_quoted_csv(t.spark, path, "id string, title string", header=False)


@query("read_list_files", "S3", """
    SELECT trim(line, concat(' ', chr(13))) AS term, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE trim(line, concat(' ', chr(13))) <> '' AND length(trim(line, concat(' ', chr(13)))) <= 100 AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '//') GROUP BY 1""")
def read_list_files(t: Inputs):
    path = staging(t, "lists")
    t.documents.select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return rd.read_list_files(t.spark, path).groupBy("term").agg(F.count("*").alias("n"))


@query("read_tag_yaml", "S4", """
    SELECT p_name || ' ' || p_partkey AS term, 'yaml:' || replace(lower(tag), ' ', '-') AS tag FROM (
      SELECT p_name, p_partkey, unnest([p_type, 'Size ' || p_size]) AS tag FROM part)""")
def read_tag_yaml(t: Inputs):
    path = staging(t, "yaml")
    entry = F.format_string("%s %d:\n  Description: a thing\n  Tags:\n    - %s\n    - Size %d\n", "p_name", "p_partkey", "p_type", "p_size")
    odd = F.format_string("{%s} %d:\n  Tags:\n    - odd\n", "p_name", "p_partkey")
    t.part.select(F.concat(entry, odd).alias("value")).write.text(path)
    return rd.read_tag_yaml(t.spark, path).select("term", "tag")


@query("read_axis_manifest", "S5", "SELECT DISTINCT lower(p_name) AS slug FROM part")
def read_axis_manifest(t: Inputs):
    path = staging(t, "manifest")
    t.part.select(F.concat(F.lit("# "), "p_brand", F.lit("\n\n  "), F.upper("p_name")).alias("value")).write.text(path)
    return rd.read_axis_manifest(t.spark, path)


@query("write_manifest", "S9", "SELECT lang AS slug, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def write_manifest(t: Inputs):
    path = staging(t, "manifest")
    entries = t.documents.select(F.col("lang").alias("slug"), "doc_id", "n_chars")
    sk.write_manifest(entries, entries.groupBy("slug").agg(F.count("*").alias("n")), path)
    back = t.spark.read.schema("slug string, doc_id long, n_chars long").json(f"{path}/entries")
    return back.groupBy("slug").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("write_partitioned", "S11", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
def write_partitioned(t: Inputs):
    path = staging(t, "layout")
    target = sk.write_partitioned(t.events.withColumn("date", F.to_date("ts")), path, "scans")
    return t.spark.read.parquet(target).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


# --- payloads -------------------------------------------------------------


@query("parse_feed_payloads", "S6", """
    SELECT 'feed-' || user_id AS source_id, 'Q&A ' || event_type || ' ' || event_id AS title, 'https://feeds.example/' || event_id AS url,
           CAST(date_trunc('second', ts) AS VARCHAR) AS published_at, 'worth "' || value || '" now' AS description FROM events""")
def parse_feed_payloads(t: Inputs):
    day = F.date_trunc("second", "ts")
    rss = F.concat(
        F.lit("<item><title><![CDATA[Q&amp;A "), "event_type", F.lit(" "), "event_id", F.lit("]]></title><link>https://feeds.example/"), "event_id",
        F.lit("</link><pubDate>"), F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>worth &quot;"),
        F.col("value").cast("string"), F.lit("&quot; &lt;b&gt;now&lt;/b&gt;</description></item>"),
    )
    atom = F.concat(
        F.lit("<entry><title>Q&amp;A "), "event_type", F.lit(" "), "event_id", F.lit('</title><link rel="self" href="x"/><link rel="alternate" href="https://feeds.example/'),
        "event_id", F.lit('"/><updated>'), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>worth &quot;"), F.col("value").cast("string"),
        F.lit("&quot; &lt;b&gt;now&lt;/b&gt;</summary></entry>"),
    )
    is_atom = F.col("event_type").isin("view", "click")
    head = F.when(is_atom, '<feed xmlns="http://www.w3.org/2005/Atom">').otherwise("<rss>")
    raw = t.events.select(F.concat(F.lit("feed-"), "user_id").alias("source_id"), F.concat(head, F.when(is_atom, atom).otherwise(rss)).alias("xml"))
    return pl.parse_feed_payloads(raw).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("parse_post_feed", "S7", """
    SELECT 'sub-' || conv_id AS subreddit, conv_id || '-' || turn AS id, role || ' & co' AS title,
      CASE WHEN length(b) > 1000 THEN left(b, 1000) || '...' ELSE b END AS selftext, 'https://posts.example/' || turn AS permalink
    FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g'), 'https?://[^\\s)]+|submitted by\\s+/u/\\S+|\\[link\\]|\\[comments\\]', '', 'g'), '\\s+', ' ', 'g')) AS b FROM conversations)""")
def parse_post_feed(t: Inputs):
    text = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    entry = F.concat(
        F.lit("<feed><entry><id>t3_"), "conv_id", F.lit("-"), "turn", F.lit("</id><title>"), "role",
        F.lit(' &amp; co</title><link href="https://posts.example/'), "turn", F.lit('"/><published>2024-01-01T00:00:00Z</published><content type="html">&lt;table&gt;&lt;div class=&quot;md&quot;&gt;&lt;p&gt;'),
        text, F.lit("&lt;/p&gt;&lt;/div&gt; submitted by /u/someone [link] [comments]&lt;/table&gt;</content></entry></feed>"),
    )
    raw = t.conversations.select(F.concat(F.lit("sub-"), "conv_id").alias("subreddit"), entry.alias("xml"))
    return pl.parse_post_feed(raw).select("subreddit", "id", "title", "selftext", "permalink")


@query("parse_hierarchy_bindings", "S8", """
    SELECT p_partkey AS payload_id, p_name AS text, CASE p_type WHEN 'LARGE' THEN 'style.genre' WHEN 'SMALL' THEN 'covering.material' END AS category_slug,
           'http://vocab.example/aat/' || p_partkey AS external_uri, p_brand AS broader_term FROM part""")
def parse_hierarchy_bindings(t: Inputs):
    val = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    root = F.when(F.col("p_type") == "LARGE", "300069424").when(F.col("p_type") == "SMALL", "300010357").otherwise("1")
    one = F.struct(
        val(F.concat(F.lit("http://vocab.example/aat/"), "p_partkey")).alias("concept"), val(F.concat(F.lit(" "), "p_name")).alias("term"),
        val(F.concat(F.lit("http://vocab.example/aat/"), root)).alias("broaderUri"), val(F.col("p_brand")).alias("broaderTerm"),
    )
    long = F.struct(
        val(F.lit("http://vocab.example/x")).alias("concept"), val(F.lit("one two three four five six seven")).alias("term"),
        val(F.lit("")).alias("broaderUri"), val(F.lit("")).alias("broaderTerm"),
    )
    raw = t.part.select(F.col("p_partkey").alias("payload_id"), F.to_json(F.struct(F.struct(F.array(one, long).alias("bindings")).alias("results"))).alias("json"))
    return pl.parse_hierarchy_bindings(raw)


@query("parse_entity_bindings", "S8", """
    SELECT 'http://entity.example/' || o_custkey AS external_uri, 'Customer ' || o_custkey AS text, 'style.genre' AS category_slug,
           string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS influenced_by FROM orders GROUP BY o_custkey""")
def parse_entity_bindings(t: Inputs):
    val = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    one = F.struct(
        val(F.concat(F.lit("http://entity.example/"), "o_custkey")).alias("item"), val(F.concat(F.lit("Customer "), "o_custkey")).alias("itemLabel"),
        val(F.col("o_orderpriority")).alias("influencedByLabel"),
    )
    unresolved = F.struct(val(F.lit("http://entity.example/none")).alias("item"), val(F.concat(F.lit("Q"), "o_orderkey")).alias("itemLabel"), val(F.lit("Q1")).alias("influencedByLabel"))
    raw = t.orders.select(F.col("o_orderkey").alias("payload_id"), F.to_json(F.struct(F.struct(F.array(one, unresolved).alias("bindings")).alias("results"))).alias("json"))
    out = pl.parse_entity_bindings(raw, category="style.genre", influence_key="influencedByLabel")
    return out.withColumn("influenced_by", F.array_join("influenced_by", "|"))


@query("pending_analyses", "S14", """
    SELECT 'todo' AS kind, count(*) AS n FROM pages WHERE NOT contains(url, '/en/')
    UNION ALL SELECT 'restored', 2 * count(*) FROM pages WHERE contains(url, '/en/') AND NOT contains(url, '?')""")
def pending_analyses(t: Inputs):
    import json

    doc = json.dumps(
        {"candidate_atoms": [{"name": "a", "description": "", "suggested_category": "x", "confidence": 0.5}],
         "candidate_correspondences": [{"source_name": "a", "target_name": "b", "relationship": "r", "suggested_strength": 0.5}]}
    )
    key = pl.analysis_key("url", "none.example")
    images = t.pages.select(F.col("url").alias("source_url"), key.alias("analysis_key"))
    analyses = t.pages.filter(F.contains("url", F.lit("/en/"))).select(key.alias("analysis_key"), F.lit(doc).alias("document"))
    seen = t.pages.filter(F.contains("url", F.lit("?"))).select(F.col("url").alias("source_url"), F.lit("board").alias("moodboard_id"))
    todo, restored = mr.pending_analyses(images, analyses, seen, "board")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(todo, "todo").unionByName(count(restored, "restored"))


# --- chunking -------------------------------------------------------------

WALK = r"""
    paras AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
    walk AS (
      SELECT doc_id, i, n, p AS cur, CAST(NULL AS VARCHAR) AS closed, 0 AS block FROM paras WHERE i = 1
      UNION ALL
      SELECT w.doc_id, q.i, q.n,
        CASE WHEN length(w.cur) + length(q.p) > 1500 AND length(w.cur) >= 200 OR w.cur = '' THEN q.p ELSE w.cur || chr(10) || q.p END,
        CASE WHEN length(w.cur) + length(q.p) > 1500 AND length(w.cur) >= 200 THEN trim(w.cur, concat(' ', chr(9), chr(10), chr(13))) END,
        w.block + CASE WHEN length(w.cur) + length(q.p) > 1500 AND length(w.cur) >= 200 THEN 1 ELSE 0 END
      FROM walk w JOIN paras q ON q.doc_id = w.doc_id AND q.i = w.i + 1)"""


@query("paragraph_blocks", "W8", f"""
    WITH RECURSIVE {WALK}
    SELECT doc_id, block - 1 AS idx, sha256(closed) AS body FROM walk WHERE closed IS NOT NULL
    UNION ALL SELECT doc_id, block, sha256(trim(cur, concat(' ', chr(9), chr(10), chr(13)))) FROM walk
      WHERE i = n AND length(trim(cur, concat(' ', chr(9), chr(10), chr(13)))) >= 50""")
def paragraph_blocks(t: Inputs):
    packed = folds.pack_paragraphs(F.split("text", "\n"), "\n")
    return t.documents.select("doc_id", F.posexplode(packed).alias("idx", "b")).select("doc_id", "idx", F.sha2("b", 256).alias("body"))


@query("merge_small_blocks", "W9", r"""
    WITH RECURSIVE b AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
    walk AS (
      SELECT doc_id, i, n, p AS body FROM b WHERE i = 1
      UNION ALL
      SELECT w.doc_id, q.i, q.n, CASE WHEN length(w.body) < 200 THEN w.body || chr(10) || chr(10) || q.p ELSE q.p END FROM walk w JOIN b q ON q.doc_id = w.doc_id AND q.i = w.i + 1)
    SELECT doc_id, 'h' || (i - 1) AS heading, sha256(body) AS body FROM walk WHERE length(body) >= 200 OR i = n""")
def merge_small_blocks(t: Inputs):
    lines = F.transform(F.split("text", "\n"), lambda p, i: ch.block(F.concat(F.lit("h"), i.cast("string")), p))
    out = t.documents.select("doc_id", F.explode(folds.merge_small(lines)).alias("b"))
    return out.select("doc_id", F.col("b.heading").alias("heading"), F.sha2("b.content", 256).alias("body"))


@query("wiki_chunks", "W8", r"""
    WITH RECURSIVE b AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
    walk AS (
      SELECT doc_id, i, n, p || chr(10) AS cur, CAST(NULL AS VARCHAR) AS closed, 0 AS block FROM b WHERE i = 1
      UNION ALL
      SELECT w.doc_id, q.i, q.n, CASE WHEN length(w.cur) + length(q.p) + 1 > 3000 AND w.cur <> '' THEN q.p || chr(10) ELSE w.cur || q.p || chr(10) END,
        CASE WHEN length(w.cur) + length(q.p) + 1 > 3000 AND w.cur <> '' THEN trim(w.cur, concat(' ', chr(9), chr(10), chr(13))) END,
        w.block + CASE WHEN length(w.cur) + length(q.p) + 1 > 3000 AND w.cur <> '' THEN 1 ELSE 0 END
      FROM walk w JOIN b q ON q.doc_id = w.doc_id AND q.i = w.i + 1)
    SELECT doc_id, block - 1 AS chunk_index, sha256(closed) AS body FROM walk WHERE closed IS NOT NULL
    UNION ALL SELECT doc_id, block, sha256(trim(cur, concat(' ', chr(9), chr(10), chr(13)))) FROM walk WHERE i = n AND trim(cur, concat(' ', chr(9), chr(10), chr(13))) <> ''""")
def wiki_chunks(t: Inputs):
    out = ch.wiki_chunks(t.documents.select("doc_id", "text"), sep="\n")
    return out.select("doc_id", "chunk_index", F.sha2("content", 256).alias("body"))


@query("text_blocks", "Q16", r"""
    WITH RECURSIVE src AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda p: length(trim(p, concat(' ', chr(9), chr(13)))) >= 50) AS ps FROM documents),
    paras AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM src WHERE len(ps) > 0),
    walk AS (
      SELECT doc_id, i, n, p AS cur, CAST(NULL AS VARCHAR) AS closed, 0 AS block FROM paras WHERE i = 1
      UNION ALL
      SELECT w.doc_id, q.i, q.n, CASE WHEN length(w.cur) + length(q.p) > 1500 AND length(w.cur) >= 200 THEN q.p ELSE w.cur || chr(10) || q.p END,
        CASE WHEN length(w.cur) + length(q.p) > 1500 AND length(w.cur) >= 200 THEN trim(w.cur) END,
        w.block + CASE WHEN length(w.cur) + length(q.p) > 1500 AND length(w.cur) >= 200 THEN 1 ELSE 0 END
      FROM walk w JOIN paras q ON q.doc_id = w.doc_id AND q.i = w.i + 1),
    out AS (SELECT doc_id, block - 1 AS idx, closed AS body FROM walk WHERE closed IS NOT NULL
      UNION ALL SELECT doc_id, block, trim(cur) FROM walk WHERE i = n AND length(trim(cur)) >= 50
      UNION ALL SELECT doc_id, 0, trim(text, concat(' ', chr(9), chr(10), chr(13))) FROM src WHERE len(ps) = 0 AND length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) >= 50)
    SELECT o.doc_id, idx, s.source || CASE WHEN idx > 0 THEN ' (part ' || (idx + 1) || ')' ELSE '' END AS heading, length(body) AS chars FROM out o JOIN src s USING (doc_id)""")
def text_blocks(t: Inputs):
    out = ch.text_blocks(t.documents, title="source", separator="\n", sep="\n")
    return out.select("doc_id", F.posexplode("blocks").alias("idx", "b")).select(
        "doc_id", "idx", F.col("b.heading").alias("heading"), F.length("b.content").alias("chars")
    )


@query("markdown_blocks", "Q15")
def markdown_blocks(t: Inputs):
    text = F.regexp_replace("text", r"\n(\S+)", "\n## $1\n\n$1")
    out = ch.markdown_blocks(t.documents.select("doc_id", "source", text.alias("text")), title="source", separator=r"\n+", sep="\n")
    return out.select("doc_id", F.posexplode("blocks").alias("idx", "b")).select("doc_id", "idx", "b.heading", F.length("b.content").alias("chars"))


@query("page_sections", "Q14 F17")
def page_sections(t: Inputs):
    out = ch.sections(t.pages, heading_tag="h1", separator=r"\n+", sep="\n")
    return out.select("page_id", "title", F.posexplode("blocks").alias("idx", "b")).select(
        "page_id", "title", "idx", "b.heading", "b.hint", F.length("b.content").alias("chars")
    )


@query("chunk_table", "Q17", r"""
    WITH b AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: length(trim(p, concat(' ', chr(9), chr(13)))) >= 50) AS ps FROM documents))
    SELECT doc_id, i - 1 AS chunk_index, ceil(length(p) / 4)::BIGINT AS token_count, 'doc_chunk_' || sha256(doc_id || '|' || (i - 1)) AS chunk_id FROM b""")
def chunk_table(t: Inputs):
    lines = F.transform(F.split("text", "\n"), lambda p: ch.block(F.lit("h"), p))
    chunks, _ = ch.chunk_table(t.documents.select("doc_id", lines.alias("blocks")), "doc_id")
    return chunks.select("doc_id", "chunk_index", "token_count", "chunk_id")


@query("chunk_documents", "Q17", r"""
    SELECT doc_id, len(ps) AS chunk_count, CASE WHEN len(ps) > 0 THEN 'chunked' ELSE 'empty' END AS status, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0)::BIGINT AS content_length
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: length(trim(p, concat(' ', chr(9), chr(13)))) >= 50) AS ps FROM documents)""")
def chunk_documents(t: Inputs):
    lines = F.transform(F.split("text", "\n"), lambda p: ch.block(F.lit("h"), p))
    return ch.chunk_table(t.documents.select("doc_id", lines.alias("blocks")), "doc_id")[1]


TEXT_SQL = "html"
for _tag in hx.DROPPED_TAGS:
    TEXT_SQL = f"regexp_replace({TEXT_SQL}, '(?is)<{_tag}.*?</{_tag}>', '', 'g')"
TEXT_SQL = f"regexp_replace({TEXT_SQL}, '(?i)</?({hx.BREAK_TAGS})[^>]*>', chr(10), 'g')"
TEXT_SQL = f"regexp_replace({TEXT_SQL}, '<[^>]+>', '', 'g')"
for _a, _b in [*hx.ENTITIES, ("&nbsp;", " ")]:
    TEXT_SQL = f"""replace({TEXT_SQL}, '{_a}', '{_b.replace("'", "''")}')"""
TEXT_SQL = f"trim(regexp_replace(regexp_replace({TEXT_SQL}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), concat(' ', chr(9), chr(10), chr(13), chr(160), chr(65279), chr(8232), chr(8233)))"


@query("page_text", "X9", f"SELECT page_id, sha256({TEXT_SQL}) AS body FROM pages")
def page_text(t: Inputs):
    return t.pages.select("page_id", F.sha2(hx.html_to_text("html"), 256).alias("body"))


@query("page_images", "X9", r"""
    SELECT page_id, string_agg(DISTINCT src, '|' ORDER BY src) AS images FROM (
      SELECT page_id, 'https://img.example/' || unnest(regexp_extract_all(html, '<a href="/([a-z]+)"', 1)) || '.png' AS src FROM pages) GROUP BY 1""")
def page_images(t: Inputs):
    img = F.regexp_replace("html", r'<a href="/([a-z]+)"', '<img src="https://img.example/$1.png/revision/latest?cb=1"/><img src="data:x"/><img class="icon" width="16" src="/i.png"/><a href="/$1"')
    found = t.pages.select("page_id", hx.image_urls(img).alias("i")).filter(F.size("i") > 0)
    return found.select("page_id", F.array_join(F.array_sort("i"), "|").alias("images"))


@query("markdown_text", "X9", r"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace('*' || text || '* [see](x)', '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_`~>#]+', '', 'g'), '\s+', ' ', 'g'))) AS body FROM documents""")
def markdown_text(t: Inputs):
    marked = F.concat(F.lit("*"), "text", F.lit("* [see](x)"))
    return t.documents.select("doc_id", F.sha2(hx.strip_markdown(marked), 256).alias("body"))


@query("lead_paragraphs", "X9", r"""
    WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<p[^>]*>(.*?)</p>', 1),
        lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '\s+', ' ', 'g'))), lambda s: s <> '') AS ps FROM pages),
    j AS (SELECT page_id, array_to_string(ps[1:3], chr(10) || chr(10)) AS body FROM p)
    SELECT page_id, sha256(CASE WHEN length(body) > 1500 THEN regexp_replace(left(body, 1500), '\s+\S*$', '') || '...' ELSE body END) AS lead FROM j""")
def lead_paragraphs(t: Inputs):
    return t.pages.select("page_id", F.sha2(hx.lead_paragraphs("html"), 256).alias("lead"))


# --- feeds ----------------------------------------------------------------

KEYWORDS = "keywords AS (SELECT DISTINCT lower(k) AS keyword FROM (SELECT slug AS k FROM v_arrangements UNION SELECT name FROM v_arrangements UNION SELECT split_part(category_slug, '.', 1) FROM v_atoms WHERE status = 'confirmed' AND contains(category_slug, '.') UNION SELECT unnest(['art deco', 'noir', 'Brand#1', 'the', 'thing:'])) WHERE k <> '')"


def feed_keywords(t: Inputs):
    curated = t.spark.createDataFrame([(k,) for k in ["art deco", "noir", "Brand#1", "the", "thing:"]], "keyword string")
    return fd.build_keywords(t.v_arrangements, t.v_atoms, curated)


@query("build_keywords", "Q13", f"WITH {KEYWORDS} SELECT keyword FROM keywords")
def build_keywords(t: Inputs):
    return feed_keywords(t)


HITS = rf"""
    {KEYWORDS},
    pat AS (SELECT keyword, CASE WHEN regexp_matches(keyword, '^[A-Za-z0-9_]') THEN '(^|[^A-Za-z0-9_])' ELSE '[A-Za-z0-9_]' END
        || regexp_replace(keyword, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') || CASE WHEN regexp_matches(keyword, '[A-Za-z0-9_]$') THEN '($|[^A-Za-z0-9_])' ELSE '[A-Za-z0-9_]' END AS pattern FROM keywords),
    hits AS (SELECT item_id, keyword FROM v_feed_items, pat WHERE contains(lower(text), keyword) AND regexp_matches(lower(text), pattern))"""


@query("keyword_hits", "Q12", f"WITH {HITS} SELECT * FROM hits")
def keyword_hits(t: Inputs):
    return fd.keyword_hits(t.v_feed_items, feed_keywords(t))


@query("score_feed_items", "Q12", f"""
    WITH {HITS},
    w AS (SELECT item_id, sum(CASE WHEN length(keyword) > 10 THEN 2 ELSE 1 END) AS w, count(*) AS matches FROM hits GROUP BY 1),
    s AS (SELECT i.item_id, i.source_id, coalesce(matches, 0) AS matches, tier, round(CASE WHEN w IS NULL THEN 0 ELSE least((0.1 + least(w / 10, 1.0) * 0.8) * weight, 1.0) END::DOUBLE, 6) AS score
      FROM v_feed_items i LEFT JOIN w USING (item_id) JOIN v_feed_sources f ON f.source_id = i.source_id)
    SELECT item_id, source_id, matches, score, CASE WHEN score >= CASE tier WHEN 'core' THEN 0.3 WHEN 'adjacent' THEN 0.5 ELSE 0.7 END THEN 'pending' ELSE 'no_terms' END AS status FROM s""")
def score_feed_items(t: Inputs):
    sources = t.v_feed_sources.withColumn("weight", F.col("weight").cast("double"))
    return fd.score_feed_items(t.v_feed_items, feed_keywords(t), sources)


STOP_SQL = ", ".join(f"'{w}'" for w in fd.TITLE_STOP_WORDS)


@query("title_keywords", "Q25", rf"""
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[\s\-_,.;:!?()\[\]{{}}"''`/\\|@#$%^&*+=<>~]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}))[1:8], ' ') AS keywords FROM documents""")
def title_keywords(t: Inputs):
    return t.documents.select("doc_id", F.array_join(fd.title_keywords("text"), " ").alias("keywords"))


@query("publish_candidates", "Q24 J22", """
    WITH e AS (SELECT doc_id AS entry_id, source AS document_id, round(1 - doc_id / 5000, 4) AS relevance_score, text AS title FROM documents
               WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr' ORDER BY relevance_score DESC, doc_id LIMIT 10)
    SELECT entry_id, document_id, relevance_score, CASE WHEN document_id < 'src15' THEN 'series-a' WHEN regexp_matches(lower(title), 'ai|ml|model|neural|llm|gpt|diffusion|transformer|api|sdk|framework|algorithm|training|inference|pipeline|automation|tool|platform|software|engineering|flux|stable|gpu|nvidia|scaling|accelerat') THEN 'technical'
      WHEN regexp_matches(lower(title), 'art|design|aesthetic|visual|culture|style|fashion|architecture|typography|color|photography|illustration|craft|museum|gallery|exhibition|creative|painting|history') THEN 'cultural-thread' ELSE 'business' END AS category FROM e""")
def publish_candidates(t: Inputs):
    entries = t.documents.select(
        F.col("doc_id").alias("entry_id"), F.col("source").alias("document_id"), F.round(1 - F.col("doc_id") / 5000, 4).alias("relevance_score"),
        F.col("text").alias("title"), (F.col("lang") != "fr").alias("ingested"),
    )
    docs = t.documents.select(F.col("source").alias("document_id")).distinct().select(
        "document_id", F.array(F.when(F.col("document_id") < "src15", "noir").otherwise("none")).alias("arrangements"), F.lit(1.0).alias("score")
    )
    return fd.publish_candidates(entries, t.labels.select(F.col("doc_id").alias("entry_id")), docs, {"series-a": ["noir"], "series-b": ["gothic"]}, min_score=-1e9)


RANK_ITEMS = """
    items AS (SELECT l_orderkey AS request_id, 'id-' || l_partkey AS identifier, min(CASE l_returnflag WHEN 'R' THEN 'audio' ELSE 'texts' END) AS mediatype,
      max(l_quantity * 2.5) AS size_mb, max(l_tax) * 5 AS base_score, max(l_extendedprice) AS views, bool_or(l_linestatus = 'F') AS has_ocr FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, round(least(1.0, base_score + CASE WHEN has_ocr THEN 0.1 ELSE 0 END + CASE WHEN views > 5000 THEN 0.2 WHEN views > 1000 THEN 0.1 ELSE 0 END), 6) AS score FROM items),
    s AS (SELECT *, CASE WHEN mediatype <> 'texts' THEN 'wrong_mediatype' WHEN size_mb > 100 THEN 'too_large' WHEN identifier IN (SELECT 'id-' || p_partkey FROM part WHERE p_size = 9) THEN 'already_ingested' WHEN score < 0.4 THEN 'low_relevance' END AS skip_reason FROM r)"""


def _ranked(t: Inputs):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("id-"), "l_partkey").alias("identifier")).agg(
        F.min(F.when(F.col("l_returnflag") == "R", "audio").otherwise("texts")).alias("mediatype"), F.max(F.col("l_quantity") * 2.5).alias("size_mb"),
        (F.max("l_tax") * 5).alias("base_score"), F.max("l_extendedprice").alias("views"), F.bool_or(F.col("l_linestatus") == "F").alias("has_ocr"),
    ).withColumn("pdf_url", F.col("identifier"))
    done = t.part.filter(F.col("p_size") == 9).select(F.concat(F.lit("id-"), "p_partkey").alias("pdf_url"))
    return fd.rank_candidates(items, done)


@query("rank_candidates", "Q21", f"""
    WITH {RANK_ITEMS}
    SELECT request_id, identifier, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, identifier) AS place FROM s WHERE skip_reason IS NULL QUALIFY place <= 5""")
def rank_candidates(t: Inputs):
    return _ranked(t)[0]


@query("rank_skips", "Q21", f"WITH {RANK_ITEMS} SELECT skip_reason, count(*) AS n FROM s WHERE skip_reason IS NOT NULL GROUP BY 1")
def rank_skips(t: Inputs):
    return _ranked(t)[1]


def _files(t: Inputs):
    ending = F.when(F.col("l_returnflag") == "A", ".png").when(F.col("l_returnflag") == "N", ".pdf").otherwise("_thumb.jpg")
    return t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), F.concat(F.lit("f"), F.format_string("%07d", "l_partkey"), F.lit("-"), "l_linenumber", ending).alias("name"),
        F.when(F.col("l_linestatus") == "F", "PNG").otherwise("Text PDF").alias("format"), (F.col("l_extendedprice") * 200).cast("long").cast("string").alias("size"),
    )


FILES = """
    f AS (SELECT l_orderkey AS item_id, 'f' || lpad(l_partkey::VARCHAR, 7, '0') || '-' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.png' WHEN 'N' THEN '.pdf' ELSE '_thumb.jpg' END AS name,
      CASE l_linestatus WHEN 'F' THEN 'PNG' ELSE 'Text PDF' END AS format, trunc(l_extendedprice * 200)::BIGINT AS bytes, l_returnflag AS flag FROM lineitem)"""


@query("best_image", "W10", f"""
    WITH {FILES},
    p AS (SELECT * FROM f WHERE flag = 'A' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE format WHEN 'PNG' THEN 0 ELSE 1 END, CASE format WHEN 'PNG' THEN 0 ELSE -bytes END, name) = 1)
    SELECT item_id, name, format, round(bytes / 1048576, 2) AS size_mb FROM p WHERE bytes / 1048576 <= 10""")
def best_image(t: Inputs):
    return fd.best_image(_files(t))


@query("best_pdf", "W10", f"""
    WITH {FILES},
    p AS (SELECT * FROM f WHERE flag = 'N' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE format WHEN 'Text PDF' THEN 0 ELSE 2 END, name) = 1)
    SELECT item_id, name, format, round(bytes / 1048576, 2) AS size_mb FROM p WHERE bytes / 1048576 <= 12""")
def best_pdf(t: Inputs):
    return fd.best_pdf(_files(t), max_mb=12)


@query("gap_analysis", "Q19 A14", """
    WITH cov AS (SELECT arrangement_slug AS slug, category_slug, count(*) AS n FROM v_arrangement_atoms x JOIN v_atoms a ON a.id = x.atom_id WHERE status = 'confirmed' GROUP BY 1, 2),
    per AS (SELECT slug, sum(n)::BIGINT AS total_atoms, 3 - count(*) FILTER (category_slug IN ('size.small', 'size.large', 'line.promo') AND n >= 5) AS thin FROM cov GROUP BY 1)
    SELECT slug, 'baseline' AS request_type, 0.9 AS priority, 0 AS total_atoms, 0 AS thin_categories FROM v_arrangements WHERE slug NOT IN (SELECT lower(replace(p_name, ' ', '-')) FROM part WHERE p_size = 3)
    UNION ALL SELECT slug, CASE WHEN total_atoms < 20 THEN 'baseline' ELSE 'gap_fill' END, CASE WHEN total_atoms < 20 THEN 0.8 ELSE 0.7 END, total_atoms, thin FROM per WHERE thin >= 2""")
def gap_analysis(t: Inputs):
    from lexweave.operators.aggregates import coverage_by_arrangement

    held = t.part.filter(F.col("p_size") == 3).select(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("arrangement_slug"))
    cov = coverage_by_arrangement(t.v_arrangement_atoms, t.v_atoms)
    return fd.gap_analysis(t.v_arrangements, held, cov, ["size.small", "size.large", "line.promo"], thin=5, baseline_under=20)


@query("context_gap_matrix", "Q20", """
    SELECT o.context, c.slug AS category_slug FROM (SELECT DISTINCT o_orderstatus AS context FROM orders) o, v_categories c
    WHERE (o.context, c.slug) NOT IN (SELECT (context, category_slug) FROM v_category_contexts)""")
def context_gap_matrix(t: Inputs):
    return fd.context_gap_matrix(t.orders.select(F.col("o_orderstatus").alias("context")), t.v_categories, t.v_category_contexts)


# --- gate and model rows --------------------------------------------------

GATE = r"""
    near AS (SELECT a.id, arg_max(b.id, (round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6), -b.label)) AS x, max(round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6)) AS similarity
      FROM v_vectors a JOIN v_vectors b ON a.id <> b.id GROUP BY 1),
    g AS (SELECT v.id AS input_id, v.text, confidence, n.x, n.similarity, CASE WHEN v.text_lower LIKE '%ring' THEN 'comment' WHEN collection_slug = 'brand-3' THEN 'missing_provenance' WHEN confidence < 0.3 THEN 'low_specificity' WHEN n.similarity > 0.33 THEN 'redundant' END AS r
      FROM v_atoms v LEFT JOIN near n ON n.id = v.id)"""


def _gate_inputs(t: Inputs):
    return t.v_atoms.select(
        F.col("id").alias("input_id"), F.when(F.col("text_lower").endswith("ring"), F.concat(F.lit("# "), "text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("collection_slug") != "brand-3", "ai").alias("source"), F.col("confidence").alias("specificity"),
    )


@query("quality_gate", "V8 V7", f"""
    WITH {GATE}
    SELECT input_id, CASE WHEN r = 'redundant' THEN 'redirect_merge' WHEN r IS NOT NULL THEN 'reject' WHEN confidence < 0.5 THEN 'flag' ELSE 'pass' END AS result, r AS rejection_reason, confidence AS specificity_score,
      CASE r WHEN 'redundant' THEN x END AS similar_id, CASE r WHEN 'redundant' THEN similarity END AS similarity FROM g""")
def quality_gate(t: Inputs):
    out = gt.quality_gate(_gate_inputs(t), t.v_vectors, t.v_vectors, redundant_over=0.33)
    return out.select("input_id", "result", "rejection_reason", "specificity_score", "similar_id", "similarity")


@query("bulk_ingest_gated", "Q1 V7 V8", f"""
    WITH {GATE},
    ok AS (SELECT v.text_lower, v.collection_slug, count(*) AS n FROM g JOIN v_atoms v ON v.id = g.input_id WHERE r IS NULL GROUP BY 1, 2)
    SELECT 'inserted' AS counter, count(*) AS n FROM ok UNION ALL SELECT 'duplicates', (SELECT coalesce(sum(n), 0)::BIGINT FROM ok) - (SELECT count(*) FROM ok)
    UNION ALL SELECT 'chunks_created', 0 UNION ALL SELECT 'rejected', count(*) FROM g WHERE r = 'comment'
    UNION ALL SELECT 'gate_rejected', count(*) FROM g WHERE r IN ('missing_provenance', 'low_specificity', 'redundant')
    UNION ALL SELECT 'gate_flagged', count(*) FROM g WHERE r IS NULL AND confidence < 0.5""")
def bulk_ingest_gated(t: Inputs):
    """Bulk ingest with vectors, so that the gate also looks for redundant terms."""
    rows = _gate_inputs(t).join(t.v_atoms.select(F.col("id").alias("input_id"), "collection_slug"), "input_id").withColumn("category", F.lit(None).cast("string"))
    docs = t.documents.groupBy(F.lit("none").alias("title")).agg(F.count("*").alias("chunk_count"))
    held = t.v_atoms.select(F.lit("-").alias("text_lower"), F.col("category_slug").alias("collection_slug"))
    return gt.bulk_ingest(rows, held, docs, vectors=t.v_vectors, known_vectors=t.v_vectors, redundant_over=0.33)["counters"]


def _bulk(t: Inputs):
    rows = t.v_texts.select(
        F.col("text_id").alias("input_id"), "text", "category", F.coalesce("category", F.lit("none")).alias("collection_slug"), F.lit("ai").alias("source"),
        (F.length("text") % 10 / 10).alias("specificity"),
    )
    held = t.v_atoms.select("text_lower", F.col("category_slug").alias("collection_slug"))
    docs = t.documents.groupBy(F.lit("Scene Compositions").alias("title")).agg(F.count("*").alias("chunk_count"))
    return gt.bulk_ingest(rows, held, docs)


BULK = r"""
    x AS (SELECT *, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS t, length(text) % 10 / 10 AS spec FROM v_texts),
    y AS (SELECT *, CASE WHEN length(t) < 3 THEN 'too_short' WHEN length(t) > 80 THEN 'long' WHEN starts_with(t, '#') OR starts_with(t, '//') OR starts_with(t, '--') THEN 'comment' WHEN contains(t, chr(10)) THEN 'long' WHEN len(regexp_split_to_array(t, '\s+')) > 6 THEN 'long' WHEN regexp_matches(t, '^[^A-Za-z_]+$') THEN 'non_text' ELSE 'valid' END AS r FROM x),
    ok AS (SELECT lower(t) AS text_lower, coalesce(category, 'none') AS collection_slug, min(text_id) AS input_id, count(*) AS n FROM y WHERE r = 'valid' AND spec >= 0.3 GROUP BY 1, 2),
    ins AS (SELECT * FROM ok WHERE (text_lower, collection_slug) NOT IN (SELECT (text_lower, coalesce(category_slug, '')) FROM v_atoms)),
    ch AS (SELECT text_id, CASE WHEN ends_with(category, '.aesthetic') THEN 'Aesthetic Definitions' WHEN contains(t, '__') AND contains(t, '/') THEN 'Art and Reference Taxonomy' WHEN starts_with(category, 'reference.') THEN 'Character Briefs Collection'
      WHEN starts_with(category, 'narrative.') THEN 'Scene Compositions' WHEN starts_with(category, 'covering.') THEN 'Costume and Outfit Descriptions' ELSE 'Uncategorized Knowledge' END AS document FROM y WHERE r = 'long')"""


@query("bulk_ingest", "Q1", f"""
    WITH {BULK}
    SELECT 'inserted' AS counter, count(*) AS n FROM ins UNION ALL SELECT 'duplicates', (SELECT sum(n)::BIGINT FROM ok) - (SELECT count(*) FROM ins)
    UNION ALL SELECT 'chunks_created', count(*) FROM ch UNION ALL SELECT 'rejected', count(*) FROM y WHERE r IN ('too_short', 'comment', 'non_text')
    UNION ALL SELECT 'gate_rejected', count(*) FROM y WHERE r = 'valid' AND spec < 0.3 UNION ALL SELECT 'gate_flagged', count(*) FROM y WHERE r = 'valid' AND spec >= 0.3 AND spec < 0.5""")
def bulk_ingest(t: Inputs):
    return _bulk(t)["counters"]


@query("bulk_ingest_chunks", "Q1", f"""
    WITH {BULK} SELECT text_id AS input_id, document, row_number() OVER (PARTITION BY document ORDER BY text_id) - 1 + CASE WHEN document = 'Scene Compositions' THEN (SELECT count(*) FROM documents) ELSE 0 END AS chunk_index FROM ch""")
def bulk_ingest_chunks(t: Inputs):
    return _bulk(t)["chunks"].select("input_id", "document", "chunk_index")


def _raw(t: Inputs):
    """Model answers in several shapes, made from part rows."""
    short = F.format_string('```json\n{"cat":"size.%s","mod":"%s","util":"odd","h":{"hardness":%s,"temperature":"0.256","weight":null},"register":0.777}\n```', F.lower("p_type"), F.when(F.col("p_size") > 25, "narrative").otherwise("loud"), (F.col("p_size") / 40).cast("string"))
    long = F.format_string('Here it is: {"category_slug":"line.%s","utility":"dual","harmonics":{"hardness":-1,"formality":0.5}} thanks', F.lower("p_type"))
    cut = F.lit('{"cat":"size.small","h":{"hardness":0.1},"note":"cut')
    return t.part.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") > 20, short).when(F.col("p_size") > 5, long).otherwise(cut).alias("raw"))


def _cats(t: Inputs):
    return t.v_categories.withColumn("default_modality", F.when(F.col("parent") == "line", "visual"))


MODEL = """
    p AS (SELECT p_partkey::VARCHAR AS id, p_size, CASE WHEN p_size > 20 THEN 'size.' WHEN p_size > 5 THEN 'line.' END || lower(p_type) AS cat FROM part)"""


@query("normalise_model_output", "H7 X7", f"""
    WITH {MODEL}
    SELECT id, cat AS category_slug, CASE WHEN p_size > 25 THEN 'narrative' WHEN p_size > 20 THEN 'both' ELSE 'visual' END AS modality, CASE WHEN p_size > 20 THEN 'visual' ELSE 'dual' END AS utility,
      CASE WHEN p_size > 20 THEN round(least(p_size / 40, 1.0), 2) ELSE 0.0 END::DOUBLE AS hardness, CASE WHEN p_size > 20 THEN 0.26 ELSE 0.5 END::DOUBLE AS temperature, CASE WHEN p_size > 20 THEN 0.0 ELSE 0.5 END::DOUBLE AS weight, 0.5::DOUBLE AS formality, 0.5::DOUBLE AS era_affinity,
      CASE WHEN p_size > 20 THEN 0.78 END::DOUBLE AS register
    FROM p WHERE cat IN (SELECT slug FROM v_categories) AND (p_size > 20 OR starts_with(cat, 'line.'))
      AND (starts_with(cat, 'line.') OR p_size > 20)""")
def normalise_model_output(t: Inputs):
    return mr.normalise_model_output(_raw(t), _cats(t))[0]


@query("invalid_model_output", "H7", f"""
    WITH {MODEL} SELECT id, CASE WHEN cat IS NULL THEN 'no_category' ELSE 'unknown_category' END AS reason FROM p WHERE cat IS NULL OR cat NOT IN (SELECT slug FROM v_categories)""")
def invalid_model_output(t: Inputs):
    return mr.normalise_model_output(_raw(t), _cats(t))[1].select("id", "reason")


@query("validate_fields", "H8", """
    SELECT o_orderkey AS result_id, CASE WHEN o_orderstatus = 'P' THEN 'unclassified' WHEN e <> '' THEN 'partial' ELSE 'valid' END AS outcome, CASE WHEN o_orderstatus = 'P' THEN '' ELSE e END AS errors,
      CASE WHEN o_orderstatus <> 'P' AND e <> '' THEN least(conf, 0.5) ELSE conf END AS confidence
    FROM (SELECT *, round(o_totalprice / 600000, 4) AS conf, concat_ws('|', CASE WHEN o_orderpriority = '1-URGENT' THEN 'kind:expected_enum' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'labels:expected_array' END, CASE WHEN o_custkey < 500 THEN 'term:missing' END) AS e FROM orders)""")
def validate_fields(t: Inputs):
    body = F.concat(
        F.lit("{"), F.when(F.col("o_custkey") >= 500, '"term":"x",').otherwise(""), F.lit('"kind":'), F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise('"odd"'),
        F.lit(',"labels":'), F.when(F.col("o_orderpriority") == "2-HIGH", '"a"').otherwise('["a"]'), F.lit("}"),
    )
    rows = t.orders.select(F.col("o_orderkey").alias("result_id"), F.col("o_orderstatus").alias("category"), F.round(F.col("o_totalprice") / 600000, 4).alias("confidence"), body.alias("result"))
    types = [("term", "string"), ("kind", "a|b|c"), ("labels", "string[]"), ("note", "string?"), ("more", "string[]")]
    schema = t.spark.createDataFrame([(c, k, v) for c in ("F", "O") for k, v in types], "category string, key string, type string")
    return mr.validate_fields(rows, schema).withColumn("errors", F.array_join("errors", "|"))


CACHE_ROWS = """
    r AS (SELECT o_custkey AS request_id, 'text ' || o_orderkey AS text, o_orderpriority AS category_slug, o_orderkey, round(o_totalprice / 500000, 4) AS confidence, o_custkey % 5 AS tries FROM orders)"""


def _cache(t: Inputs):
    base = t.orders.select(
        F.col("o_custkey").alias("request_id"), F.concat(F.lit("text "), "o_orderkey").alias("text"), F.col("o_orderpriority").alias("category_slug"),
        F.array(F.lit("b"), F.lit("a")).alias("contexts"), F.round(F.col("o_totalprice") / 500000, 4).alias("confidence"), (F.col("o_custkey") % 5).alias("reclassify_count"),
        "o_orderstatus",
    )
    stored = base.filter(F.col("o_orderstatus") != "P").select(mr.cache_key("text", "category_slug", F.array(F.lit("a"), F.lit("b"))).alias("term_hash"), "confidence", "reclassify_count")
    return mr.cache_lookup(base.select("request_id", "text", "category_slug", "contexts"), stored)


@query("cache_lookup", "H9 X4", """
    WITH r AS (SELECT o_custkey AS request_id, o_orderpriority AS category_slug, o_orderkey, o_orderstatus, round(o_totalprice / 500000, 4) AS confidence, o_custkey % 5 AS tries FROM orders)
    SELECT request_id, confidence FROM r WHERE o_orderstatus <> 'P' AND NOT (confidence < 0.7 AND tries < 3)
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, category_slug) <= 5""")
def cache_lookup(t: Inputs):
    return _cache(t)[0].select("request_id", "confidence")


@query("cache_misses", "H9", """
    SELECT o_custkey AS request_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR (round(o_totalprice / 500000, 4) < 0.7 AND o_custkey % 5 < 3) GROUP BY 1""")
def cache_misses(t: Inputs):
    return _cache(t)[1].groupBy("request_id").agg(F.count("*").alias("n"))


def _extraction(t: Inputs):
    atom = F.struct(
        F.col("p_name").alias("name"), F.lit("d").alias("description"), F.concat(F.lit("line."), F.lower("p_type")).alias("suggested_category"), (F.col("p_size") / 40).alias("confidence"),
        F.when(F.col("p_size") > 25, "modifier").otherwise("odd").alias("utility"), F.lit("loud").alias("modality"),
    )
    broken = F.struct(F.lit("").alias("name"), F.lit("d").alias("description"), F.lit("x").alias("suggested_category"), F.lit(1.0).alias("confidence"), F.lit("odd").alias("utility"), F.lit("x").alias("modality"))
    edge = F.struct(F.col("p_name").alias("source_name"), F.col("p_brand").alias("target_name"), F.lit("r").alias("relationship"), (F.col("p_size") / 25).alias("suggested_strength"))
    prof = F.struct(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"), F.lit(0.5).alias("confidence"))
    ghost = F.struct(F.lit("ghost").alias("slug"), F.lit(0.5).alias("confidence"))
    body = F.struct(F.array(atom, broken).alias("candidate_atoms"), F.array(edge).alias("candidate_correspondences"), F.array(prof, ghost).alias("arrangement_matches"))
    return mr.validate_extraction(t.part.select(F.col("p_partkey").alias("image_id"), F.to_json(body).alias("raw")), t.v_categories, t.v_arrangements)


@query("validate_extraction", "H10", """
    SELECT p_partkey AS image_id, p_name AS name, CASE WHEN 'line.' || lower(p_type) IN (SELECT slug FROM v_categories) THEN 'line.' || lower(p_type) ELSE 'uncategorized' END AS category_slug,
      least(p_size / 40, 1.0)::DOUBLE AS confidence, CASE WHEN p_size > 25 THEN 'modifier' ELSE 'descriptor' END AS utility, 'visual' AS modality FROM part""")
def validate_extraction(t: Inputs):
    return _extraction(t)["atoms"]


@query("validate_extraction_edges", "H10", "SELECT p_partkey AS image_id, p_name AS source_name, p_brand AS target_name, least(p_size / 25, 1.0)::DOUBLE AS strength FROM part")
def validate_extraction_edges(t: Inputs):
    return _extraction(t)["edges"].select("image_id", "source_name", "target_name", "strength")


@query("validate_extraction_profiles", "H10", "SELECT p_partkey AS image_id, lower(replace(p_name, ' ', '-')) AS slug FROM part")
def validate_extraction_profiles(t: Inputs):
    return _extraction(t)["arrangements"].select("image_id", "slug")


@query("validate_enrichment", "H11", r"""
    WITH d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws, text FROM documents)
    SELECT 'c' || doc_id AS chunk_id, sha256(left(text, 500)) AS summary, CASE lang WHEN 'en' THEN 'size.small' ELSE 'kept' END AS category_slug, 'small-ring|red-widget' AS arrangement_slugs,
      CASE lang WHEN 'fr' THEN 1.0 ELSE 0.5 END::DOUBLE AS quality_score, least(len(ws), 15) AS concepts FROM d""")
def validate_enrichment(t: Inputs):
    terms = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.struct(F.concat(F.lit(" "), w).alias("term")))
    body = F.struct(
        F.array_insert(terms, 1, F.struct(F.lit("  ").alias("term"))).alias("key_concepts"), F.col("text").alias("summary"),
        F.when(F.col("lang") == "en", "size.small").otherwise("nowhere").alias("category_slug"),
        F.array(F.lit("ghost"), F.lit("small-ring"), F.lit("red-widget"), F.lit("none"), F.lit("hot-gear")).alias("arrangement_slugs"),
        F.when(F.col("lang") == "fr", 7.0).alias("quality_score"),
    )
    raw = t.documents.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.lit("kept").alias("old"), F.to_json(body).alias("raw"))
    out = mr.validate_enrichment(raw, t.v_categories, t.v_arrangements, keep_category="old")
    return out.select("chunk_id", F.sha2("summary", 256).alias("summary"), "category_slug", F.array_join("arrangement_slugs", "|").alias("arrangement_slugs"), "quality_score", F.size("key_concepts").alias("concepts"))


@query("validate_signals", "Q11", """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS pos FROM events)
    SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id, pos, 'topic ' || event_type AS topic, CASE event_type WHEN 'error' THEN 'complaint' ELSE 'news' END AS sentiment, least(value / 50, 1.0)::DOUBLE AS intensity, 5 AS pains
    FROM e WHERE pos < 10""")
def validate_signals(t: Inputs):
    topic = F.struct(
        F.concat(F.lit("Topic "), "event_type").alias("topic"), F.when(F.col("event_type") == "error", "complaint").otherwise("joy").alias("sentiment"), (F.col("value") / 50).alias("intensity"),
        F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string")).alias("pain_points"),
    )
    scans = t.events.groupBy(F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("scan_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", topic.alias("t")))).alias("rows"))
    raw = scans.select("scan_id", F.lit("s").alias("subreddit"), F.lit("2024-01-30").cast("date").alias("scan_date"), F.to_json(F.struct(F.col("rows.t").alias("topics"))).alias("raw"))
    out = mr.validate_signals(raw)
    return out.select("scan_id", "pos", "topic", "sentiment", "intensity", F.size("pain_points").alias("pains"))


@query("knowledge_packages", "Q18 Q26", """
    SELECT o_orderkey AS package_id, 'Compilation Outcomes' AS document, 'style.genre' AS category_slug, coalesce(lower(o_orderpriority), 'none') AS arrangement_slugs,
      row_number() OVER (ORDER BY o_orderkey) - 1 + 7 AS chunk_index,
      sha256('Compilation: ' || o_orderstatus || ' (' || lower(o_orderpriority) || ' @ 0.000)' || chr(10) || 'Extraction: unknown' || chr(10) || 'Generation: prov/m' || chr(10) || 'Anchors: a, b' || chr(10) || 'Palette: dark') AS body
    FROM orders""")
def knowledge_packages(t: Inputs):
    rows = t.orders.select(
        F.col("o_orderkey").alias("outcome_id"), F.col("o_orderstatus").alias("signal"), F.lit(None).cast("string").alias("target_provider"), F.lit("prov").alias("gen_provider"), F.lit("m").alias("model"),
        F.lower("o_orderpriority").alias("arrangement"), F.lit(None).cast("string").alias("render_mode"), F.lit('{"style_anchors":["a","b"],"palette":{"mood":"dark"}}').alias("ir"),
    )
    docs = t.region.groupBy(F.lit("Compilation Outcomes").alias("title")).agg((F.count("*") + 2).alias("chunk_count"))
    chunks, _ = kn.knowledge_packages(kn.outcome_packages(rows), docs)
    return chunks.select("package_id", "document", "category_slug", F.array_join("arrangement_slugs", "|").alias("arrangement_slugs"), "chunk_index", F.sha2("content", 256).alias("body"))


@query("knowledge_query", "V10 A27 J16", """
    WITH sims AS (SELECT a.id AS query_id, 'doc_chunk_' || substr(b.id, 2) AS neighbour_id, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS score FROM v_vectors a, v_vectors b)
    SELECT query_id, neighbour_id, score, c.document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank FROM sims) s JOIN v_chunks c ON c.chunk_id = neighbour_id WHERE rank <= 5""")
def knowledge_query(t: Inputs):
    own = t.v_vectors.withColumn("id", F.regexp_replace("id", "^a", "doc_chunk_"))
    both = t.v_vectors.unionByName(own)
    atoms = t.v_atoms.select("id", "category_slug", "status")
    out = kn.knowledge_query(t.v_vectors, both, atoms, t.v_chunks, t.v_category_contexts, t.v_categories, context="F")
    return out["chunks"].select("query_id", "neighbour_id", "score", "document_id")


@query("knowledge_answer", "V10 A27 J16", """
    WITH sims AS (SELECT a.id AS query_id, b.id AS term_id, 'doc_chunk_' || substr(b.id, 2) AS chunk_id, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS score FROM v_vectors a, v_vectors b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS chunk_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term_id) AS term_rank FROM sims),
    terms AS (SELECT query_id, coalesce(category_slug, 'unknown') AS cat FROM ranked JOIN v_atoms ON v_atoms.id = term_id WHERE term_rank <= 50 AND status <> 'rejected'),
    cats AS (SELECT query_id, cat, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, cat) AS place FROM terms GROUP BY 1, 2),
    top AS (SELECT query_id, count(*) AS n, string_agg(cat, '|' ORDER BY place) AS note FROM cats WHERE place <= 5 GROUP BY 1),
    per AS (SELECT query_id, count(*) FILTER (starts_with(cat, 'size.')) AS aes, count(*) FILTER (NOT starts_with(cat, 'size.')) AS tex FROM terms GROUP BY 1)
    SELECT NULL AS query_id, 'context' AS part, category_slug || '/' || context AS item, NULL::BIGINT AS place, guidance AS note FROM v_category_contexts
      WHERE context IN ('F', 'default') AND category_slug IN (SELECT slug FROM v_categories)
    UNION ALL SELECT query_id, 'chunk', r.chunk_id, chunk_rank, c.document_id FROM ranked r JOIN v_chunks c ON c.chunk_id = r.chunk_id WHERE chunk_rank <= 5
    UNION ALL SELECT query_id, 'signal', 'aesthetic_matches', aes, NULL FROM per
    UNION ALL SELECT query_id, 'signal', 'texture_matches', tex, NULL FROM per
    UNION ALL SELECT query_id, 'signal', 'categories', n, note FROM top""")
def knowledge_answer(t: Inputs):
    """Contexts, chunk hits and signals of every query, as one result."""
    own = t.v_vectors.withColumn("id", F.regexp_replace("id", "^a", "doc_chunk_"))
    atoms = t.v_atoms.select("id", "category_slug", "status")
    out = kn.knowledge_query(
        t.v_vectors, t.v_vectors.unionByName(own), atoms, t.v_chunks, t.v_category_contexts, t.v_categories, context="F",
        aesthetic=F.col("category_slug").startswith("size."),
    )
    return kn.knowledge_answer(out)
