"""Documents and pages to chunk rows. All work is inside a row; only the final
explode makes rows, so chunking never shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.folds import BLOCK, MAX_CHARS, merge_small, pack_paragraphs, pack_whole
from lexweave.functions.html import content_area, html_to_text, page_title, strip_tags
from lexweave.functions.text import strip
from lexweave.operators.screening import is_index_page, is_infobox, is_link_heavy, is_prose

# Headings without vocabulary, and hints by heading word.
DROP_SECTIONS = [
    "gallery", "external links", "references", "categories", "see also",
    "navigation", "contents", "site navigation",
    "videos", "explore properties", "follow us",
]
DROP_PARTS = ["explore properties", "follow us"]
BIBLIOGRAPHY = (
    r"(?i)^(bibliography|references|works cited|notes|endnotes|index|table of contents|contents|"
    r"appendix|acknowledgements)"
)
SECTION_CATEGORIES = {
    "visual": "style.genre", "aesthetic": "style.genre", "visuals": "style.genre",
    "color": "color.palette", "palette": "color.palette", "colors": "color.palette",
    "history": "narrative.mood", "origin": "narrative.mood", "origins": "narrative.mood",
    "background": "narrative.mood", "fashion": "covering.clothing",
    "clothing": "covering.clothing", "architecture": "environment.setting",
    "interior": "environment.setting", "media": "reference.character",
    "film": "reference.character", "music": "narrative.mood",
    "philosophy": "narrative.mood", "technology": "style.medium",
    "photography": "style.medium",
}
MIN_BLOCK = 50


def category_hint(heading: Column) -> Column:
    lower = F.lower(heading)
    out = F.lit(None).cast("string")
    for word, category in SECTION_CATEGORIES.items():
        out = F.coalesce(out, F.when(F.contains(lower, F.lit(word)), F.lit(category)))
    return out


def block(heading: Column, content: Column, hint: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        heading.alias("heading"), content.alias("content"), (none if hint is None else hint).alias("hint")
    )


def numbered(heading: Column, texts: Column, later, hint: Column | None = None) -> Column:
    """Blocks of one section: the first keeps the heading, others get ``later``."""
    return F.transform(
        texts, lambda t, i: block(F.when(i == 0, heading).otherwise(later(heading, i)), t, hint)
    )


def continued(heading: Column, _: Column) -> Column:
    return F.concat(heading, F.lit(" (cont.)"))


def cut_section(heading: Column, text: Column, separator: str, sep: str, hint: Column | None = None) -> Column:
    """A long section packed into blocks, a short one as it is."""
    packed = numbered(heading, pack_paragraphs(F.split(text, separator), sep), continued, hint)
    return F.when(F.length(text) > MAX_CHARS, packed).otherwise(F.array(block(heading, text, hint)))


def raw_sections(html: Column, title: Column, heading_tag: str) -> Column:
    """(heading, html) of the part before the first heading and of each heading."""
    parts = F.split(html, rf"(?i)<{heading_tag}[^>]*>(?=(?s:.)*?</{heading_tag}>)")
    close = rf"(?is)^(.*?)</{heading_tag}>"

    def section(p: Column, i: Column) -> Column:
        head = strip(strip_tags(F.regexp_extract(p, close, 1)))
        return F.struct(
            F.when(i == 0, title).otherwise(head).alias("heading"),
            F.when(i == 0, p).otherwise(F.regexp_replace(p, close, "")).alias("html"),
        )

    return F.filter(F.transform(parts, section), lambda s: s["html"] != "")


def sections(
    pages: DataFrame,
    *,
    html: str = "html",
    heading_tag: str = "h2",
    separator: str = r"\n\n+",
    sep: str = "\n\n",
) -> DataFrame:
    """Content blocks of web pages: page columns with ``blocks``."""
    title = page_title(html)
    parsed = pages.withColumn("title", title).withColumn(
        "_s", raw_sections(content_area(html), F.col("title"), heading_tag)
    )
    with_text = F.transform(
        "_s", lambda s: F.struct(s["heading"].alias("heading"), s["html"].alias("html"), html_to_text(s["html"]).alias("text"))
    )

    def keep(s: Column) -> Column:
        head = strip(F.regexp_replace(F.lower(s["heading"]), r"\[\]$", ""))
        out = ~head.isin(DROP_SECTIONS) & (F.length(s["text"]) >= MIN_BLOCK)
        for part in DROP_PARTS:
            out = out & ~F.contains(head, F.lit(part))
        return out & ~is_link_heavy(s["html"], s["text"])

    cut = F.transform(
        "_t", lambda s: cut_section(s["heading"], s["text"], separator, sep, category_hint(s["heading"]))
    )
    merged = merge_small(F.flatten(cut), sep)
    return (
        parsed.withColumn("_t", F.filter(with_text, keep))
        .withColumn("_b", merged)
        .withColumn("blocks", F.filter("_b", lambda b: ~is_infobox(b["content"]) & is_prose(b["content"])))
        .drop("_s", "_t", "_b")
    )


def markdown_blocks(
    docs: DataFrame, *, text: str = "text", title: str = "title", separator: str = r"\n\n+", sep: str = "\n\n"
) -> DataFrame:
    """Blocks of markdown split at second-level headings; first-level lines leave."""
    body = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), r"\n# [^\n]*", "")
    parts = F.split(body, r"\n## ")

    def section(p: Column, i: Column) -> Column:
        head = F.when(i == 0, F.col(title)).otherwise(strip(F.split_part(p, F.lit("\n"), F.lit(1))))
        rest = F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^[^\n]*\n?", ""))
        return F.struct(head.alias("heading"), strip(rest).alias("text"), (i > 0).alias("headed"))

    def keep(s: Column) -> Column:
        bibliography = s["headed"] & F.rlike(s["heading"], F.lit(BIBLIOGRAPHY))
        return ~bibliography & (F.length(s["text"]) >= MIN_BLOCK) & ~is_index_page(s["text"])

    kept = F.filter(F.transform(parts, section), keep)
    cut = F.transform("_k", lambda s: cut_section(s["heading"], s["text"], separator, sep))
    return docs.withColumn("_k", kept).withColumn("blocks", merge_small(F.flatten(cut), sep)).drop("_k")


def text_blocks(
    docs: DataFrame, *, text: str = "text", title: str = "title", separator: str = r"\n\n+", sep: str = "\n\n"
) -> DataFrame:
    """Blocks of plain text with part headings; without a paragraph of fifty
    characters the whole text is one block."""
    long = F.filter(F.split(F.col(text), separator), lambda p: F.length(strip(p)) >= MIN_BLOCK)
    part = lambda h, i: F.concat(h, F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))
    whole = strip(text)
    single = F.when(F.length(whole) >= MIN_BLOCK, F.array(block(F.col(title), whole))).otherwise(F.array().cast(BLOCK))
    packed = numbered(F.col(title), pack_paragraphs(F.col("_p"), sep), part)
    return docs.withColumn("_p", long).withColumn("blocks", F.when(F.size("_p") == 0, single).otherwise(packed)).drop("_p")


def wiki_chunks(docs: DataFrame, *, text: str = "text", sep: str = "\n\n", max_chars: int = 3_000) -> DataFrame:
    """Chunks of roughly ``max_chars`` at paragraph ends, as (doc columns, chunk_index, content)."""
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.posexplode(pack_whole(F.col(text), sep, max_chars)).alias("chunk_index", "content"),
    )


def chunk_table(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents) of rows with ``blocks``: index, token estimate, counts."""
    kept = F.filter("blocks", lambda b: F.length(strip(b["content"])) >= MIN_BLOCK)
    rows = docs.withColumn("_b", kept)
    chunks = rows.select(key, F.posexplode("_b").alias("chunk_index", "b")).select(
        key,
        "chunk_index",
        F.col("b.heading").alias("section_heading"),
        F.col("b.content").alias("content"),
        F.ceil(F.length("b.content") / 4).alias("token_count"),
        F.col("b.hint").alias("category_hint"),
        F.concat(F.lit("doc_chunk_"), F.sha2(F.concat_ws("|", key, "chunk_index"), 256)).alias("chunk_id"),
    )
    documents = rows.select(
        key,
        F.size("_b").alias("chunk_count"),
        F.when(F.size("_b") > 0, "chunked").otherwise("empty").alias("status"),
        F.aggregate("_b", F.lit(0), lambda n, b: n + F.length(b["content"])).alias("content_length"),
    )
    return chunks, documents
