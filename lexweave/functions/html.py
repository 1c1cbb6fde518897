"""HTML and markup to text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import col, strip

# Markup that goes, tags that break lines, and entities.
DROPPED_TAGS = ["script", "style", "nav", "footer", "header"]
BREAK_TAGS = "div|p|br|h[1-6]|li|tr|td|th|blockquote|article|section"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def decode_entities(c: str | Column, extra: list[tuple[str, str]] = ()) -> Column:
    """The common entities, in order, so that a doubly encoded one decodes on."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), [*ENTITIES, *extra], col(c))


def strip_tags(c: str | Column, by: str = "") -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", by)


def html_to_text(c: str | Column) -> Column:
    """Readable text: dropped sections out, block tags as line breaks."""
    text = reduce(lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}.*?</{tag}>", ""), DROPPED_TAGS, col(c))
    text = F.regexp_replace(text, rf"(?i)</?({BREAK_TAGS})[^>]*>", "\n")
    text = decode_entities(strip_tags(text), [("&nbsp;", " ")])
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def content_area(c: str | Column, marker: str = r'(?is)<div class="mw-parser-output">(.+)</div>\s*(?:<div class="(?:page-footer|content-footer)|<noscript|<!--\s*NewPP)') -> Column:
    """The marked content area of a page, or the whole page."""
    inner = F.regexp_extract(col(c), marker, 1)
    simple = F.regexp_extract(col(c), r'(?is)<div class="mw-parser-output">(.+?)</div>\s*</div>', 1)
    return F.when(inner != "", inner).when(simple != "", simple).otherwise(col(c))


def page_title(c: str | Column) -> Column:
    return strip(strip_tags(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def lead_paragraphs(c: str | Column, count: int = 3, limit: int = 1_500) -> Column:
    """The first non-empty paragraphs; a longer text ends at a word with dots."""
    clean = F.regexp_replace(F.regexp_replace(col(c), "(?is)<style.*?</style>", ""), "(?is)<script.*?</script>", "")
    bodies = F.regexp_extract_all(clean, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    plain = lambda b: decode_entities(F.replace(strip_tags(b), F.lit("&nbsp;"), F.lit(" ")))
    texts = F.filter(F.transform(bodies, lambda b: strip(F.regexp_replace(plain(b), r"\s+", " "))), lambda s: s != "")
    joined = F.array_join(F.slice(texts, 1, count), "\n\n")
    short = F.regexp_replace(F.left(joined, F.lit(limit)), r"\s+\S*$", "")
    return F.when(F.length(joined) > limit, F.concat(short, F.lit("..."))).otherwise(joined)


def strip_markdown(c: str | Column) -> Column:
    """Links to their label, emphasis marks out, white space collapsed."""
    text = F.regexp_replace(col(c), r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"[*_`~>#]+", "")
    return strip(F.regexp_replace(text, r"\s+", " "))


# Parts of addresses of site furniture.
CHROME = ["site-logo", "sitelogo", "wiki-logo", "wordmark"]


def image_urls(c: str | Column, min_width: int = 100) -> Column:
    """Distinct original image addresses of a page, without furniture and thumbnails
    of narrow images. array<string>."""
    tags = F.regexp_extract_all(col(c), F.lit(r"""(?i)<img\b[^>]*\bsrc=["'][^"']+["'][^>]*>"""), F.lit(0))
    source = lambda t: F.regexp_extract(t, r"""(?i)\bsrc=["']([^"']+)["']""", 1)

    def original(src: Column) -> Column:
        base = F.regexp_replace(F.regexp_replace(src, r"/revision/latest.*$", ""), r"/scale-to-width-down/\d+", "")
        return F.split_part(base, F.lit("?"), F.lit(1))

    def keep(t: Column) -> Column:
        src = source(t)
        lower = F.lower(src)
        shown = F.regexp_extract(src, r"(?i)scale-to-width-down/(\d+)", 1)
        width = F.regexp_extract(t, r"""(?i)\bwidth="?(\d+)""", 1)
        icon = F.rlike(t, F.lit(r"(?i)\bicon\b")) & (width != "") & (width.try_cast("int") < 100)
        out = ~src.startswith("data:") & F.rlike(original(src), F.lit(r"(?i)\.(jpg|jpeg|png|webp|gif)$"))
        for part in CHROME:
            out = out & ~F.contains(lower, F.lit(part))
        return out & ~F.coalesce(icon, F.lit(False)) & ((shown == "") | (shown.try_cast("int") >= min_width))

    return F.array_distinct(F.transform(F.filter(tags, keep), lambda t: original(source(t))))
