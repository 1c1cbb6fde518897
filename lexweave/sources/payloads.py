"""Tables of feed and query payloads to item rows. Nothing is fetched here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.html import decode_entities, strip_tags
from lexweave.functions.text import col, head, let, strip, words
from lexweave.operators.upserts import first_per_key

# Fixed values of feed parsing.
MAX_DESCRIPTION = 1_000
ATOM_MARK = 'xmlns="http://www.w3.org/2005/Atom"'
UNRESOLVED_ID = r"^Q\d+$"


def tag_text(xml: str | Column, tag: str) -> Column:
    """Text of the first element, through CDATA; null when absent."""
    x = col(xml)
    cdata = rf"(?is)<{tag}[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</{tag}>"
    plain = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
    return F.when(F.rlike(x, F.lit(cdata)), strip(F.regexp_extract(x, cdata, 1))).when(
        F.rlike(x, F.lit(plain)), strip(F.regexp_extract(x, plain, 1))
    )


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def entry_link(entry: str | Column) -> Column:
    """The last alternate or plain link of an entry, else the first."""
    tags = F.regexp_extract_all(col(entry), F.lit(r'(?i)<link[^>]*href="[^"]+"[^>]*>'), F.lit(0))
    href = lambda t: F.regexp_extract(t, r'(?i)href="([^"]+)"', 1)
    plain = F.filter(tags, lambda t: F.contains(t, F.lit('rel="alternate"')) | ~F.contains(t, F.lit("rel=")))
    return F.coalesce(href(F.try_element_at(plain, F.lit(-1))), href(F.try_element_at(tags, F.lit(1))))


def parse_time(text: Column) -> Column:
    """ISO or RFC 822 time; null when neither."""
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))


def parse_feed_payloads(raw: DataFrame, max_description: int | None = MAX_DESCRIPTION) -> DataFrame:
    """(source_id, title, url, published_at, description) of payloads (source_id, xml);
    descriptions are cut to ``max_description`` characters (None: whole)."""
    atom = F.contains("xml", F.lit("<feed")) & F.contains("xml", F.lit(ATOM_MARK))
    pattern = F.when(atom, r"(?is)<entry>(.*?)</entry>").otherwise(r"(?is)<item>(.*?)</item>")
    items = raw.select("source_id", atom.alias("atom"), F.explode(F.regexp_extract_all("xml", pattern, F.lit(1))).alias("x"))
    either = lambda a, b: F.coalesce(_filled(a), _filled(b))
    link = F.when(F.col("atom"), either(entry_link("x"), tag_text("x", "id"))).otherwise(tag_text("x", "link"))
    time = F.when(F.col("atom"), either(tag_text("x", "published"), tag_text("x", "updated"))).otherwise(tag_text("x", "pubDate"))
    body = F.when(F.col("atom"), either(tag_text("x", "summary"), tag_text("x", "content"))).otherwise(tag_text("x", "description"))
    plain = lambda c: strip_tags(decode_entities(c))
    rows = items.select(
        "source_id", tag_text("x", "title").alias("title"), strip(link).alias("url"), time.alias("t"), body.alias("b")
    ).filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    return rows.select(
        "source_id",
        plain("title").alias("title"),
        "url",
        parse_time(F.col("t")).alias("published_at"),
        head(F.coalesce(plain("b"), F.lit("")), max_description).alias("description"),
    )


# Boilerplate of post bodies.
POST_NOISE = [r"https?://[^\s)]+", r"submitted by\s+/u/\S+", r"\[link\]", r"\[comments\]"]


def post_body(html: str | Column, max_chars: int | None = MAX_DESCRIPTION) -> Column:
    """Plain text of a post: its marked part, tags and addresses out, ``max_chars`` characters (None: all)."""
    h = col(html)
    inner = F.regexp_extract(h, r'(?s)<div class="md">(.*?)</div>', 1)
    source = F.when(F.rlike(h, F.lit(r'(?s)<div class="md">.*?</div>')), inner).otherwise(h)
    text = reduce(lambda t, p: F.regexp_replace(t, p, ""), POST_NOISE, strip_tags(source, " "))
    text = strip(F.regexp_replace(text, r"\s+", " "))
    if max_chars is None:
        return text
    return F.when(F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("..."))).otherwise(text)


def parse_post_feed(raw: DataFrame, max_chars: int | None = MAX_DESCRIPTION) -> DataFrame:
    """(subreddit, id, title, selftext, permalink, created) of payloads (subreddit, xml)."""
    decode = lambda c: decode_entities(c, [("&#32;", " "), ("&apos;", "'")])
    entries = raw.select("subreddit", F.explode(let(F.split("xml", "<entry>"), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))).alias("x"))
    rows = entries.select(
        "subreddit",
        F.regexp_replace(F.coalesce(tag_text("x", "id"), F.lit("")), "^t3_", "").alias("id"),
        decode(F.coalesce(tag_text("x", "title"), F.lit(""))).alias("title"),
        post_body(decode(F.coalesce(tag_text("x", "content"), F.lit(""))), max_chars).alias("selftext"),
        F.regexp_extract("x", r'<link[^>]*?href="([^"]*)"', 1).alias("permalink"),
        parse_time(tag_text("x", "published")).alias("created"),
    )
    return rows.filter((F.col("id") != "") & (F.col("title") != ""))


BINDING_SCHEMA = "results struct<bindings:array<map<string,struct<type:string,value:string>>>>"

# Facet roots of the hierarchy source and their categories.
FACET_CATEGORIES = {
    "300053001": "reference.technique", "300054143": "reference.technique",
    "300053949": "reference.technique", "300053847": "reference.technique",
    "300069293": "reference.technique", "300015058": "reference.technique",
    "300010357": "covering.material", "300014744": "covering.material",
    "300010358": "covering.material", "300069424": "style.genre",
    "300264086": "style.medium", "300054156": "environment.prop",
}


def _bindings(raw: DataFrame) -> tuple[DataFrame, callable]:
    rows = raw.select(*[c for c in raw.columns if c != "json"], F.posexplode(F.from_json("json", BINDING_SCHEMA)["results"]["bindings"]).alias("pos", "b"))
    return rows, lambda key: F.try_element_at("b", F.lit(key))["value"]


def parse_hierarchy_bindings(raw: DataFrame) -> DataFrame:
    """Candidate terms of hierarchy query results (payload_id, json)."""
    rows, value = _bindings(raw)
    facet = F.regexp_extract(F.coalesce(value("broaderUri"), F.lit("")), r"/aat/(\d+)$", 1)
    category = F.lit(None).cast("string")
    for root, slug in FACET_CATEGORIES.items():
        category = F.when(facet == root, slug).otherwise(category)
    out = rows.select(
        "payload_id",
        strip(value("term")).alias("text"),
        category.alias("category_slug"),
        value("concept").alias("external_uri"),
        value("broaderTerm").alias("broader_term"),
    )
    return out.filter((F.length("text") >= 2) & (F.size(words("text")) <= 6))


def parse_entity_bindings(
    raw: DataFrame, *, category: str, uri_key: str = "item", label_key: str = "itemLabel", influence_key: str | None = None
) -> DataFrame:
    """Candidate terms of entity query results, one per URI, with the labels that
    influenced it."""
    rows, value = _bindings(raw)
    label = strip(value(label_key))
    usable = rows.select(
        "payload_id",
        "pos",
        value(uri_key).alias("external_uri"),
        label.alias("text"),
        (strip(value(influence_key)) if influence_key else F.lit(None).cast("string")).alias("influence"),
    ).filter(
        (F.coalesce("external_uri", F.lit("")) != "")
        & (F.length("text") >= 2)
        & ~F.rlike("text", F.lit(UNRESOLVED_ID))
        & (F.size(words("text")) <= 10)
    )
    first = first_per_key(usable.select("external_uri", "text", "payload_id", "pos"), ["external_uri"], [F.col("payload_id"), F.col("pos")])
    known = usable.filter(F.col("influence").isNotNull() & ~F.rlike("influence", F.lit(UNRESOLVED_ID)))
    influences = known.groupBy("external_uri").agg(F.array_sort(F.collect_set("influence")).alias("influenced_by"))
    return first.join(influences, "external_uri", "left").select(
        "external_uri", "text", F.lit(category).alias("category_slug"), "influenced_by"
    )


# Image name endings of analysis keys.
IMAGE_ENDING = r"(?i)\.(jpg|jpeg|png|webp|gif)$"


def analysis_key(url: str | Column, host: str) -> Column:
    """Key of the stored analysis of an image: by path on the own host, else by hash."""
    u = col(url)
    path = F.regexp_replace(F.regexp_replace(F.try_parse_url(u, F.lit("PATH")), "^/", ""), IMAGE_ENDING, ".analysis.json")
    hashed = F.concat(F.lit("reference/external/"), F.sha2(u, 256), F.lit(".analysis.json"))
    return F.when(F.try_parse_url(u, F.lit("HOST")) == host, path).otherwise(hashed)
