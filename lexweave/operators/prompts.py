"""Typed terms of prompts, and their audit against the known terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import let, strip, text_key, words
from lexweave.operators.postings import text_search
from lexweave.operators.vectors import is_chunk_id, knn
from lexweave.session import cut_lineage

# Words and patterns of the term types.
COLOR_WORDS = (
    "red blue green yellow orange purple violet cyan magenta amber bronze gold silver crimson indigo "
    "navy emerald scarlet ivory onyx brown white black gray grey pink teal turquoise coral maroon burgundy "
    "olive cream beige tan azure cobalt slate charcoal pewter copper brass rose mauve lavender lilac plum "
    "sage mint aqua rust sienna umber ochre khaki"
).split()
COLOR_MODIFIERS = "dark light deep pale bright muted warm cool".split()
FILM_STOCKS = [
    "cinestill", "ferrania", "provia", "portra", "ektar", "kodachrome",
    "velvia", "ilford", "tri-x", "hp5", "delta", "fujifilm", "fujichrome",
    "ektachrome", "kodak",
]
CAMERA_BODIES = [
    "nikon", "canon", "hasselblad", "leica", "sony", "pentax", "mamiya",
    "phase one", "sigma", "fuji x", "olympus",
]
QUALITY_PATTERNS = [
    r"\buhd\b", r"\b32k\b", r"\b8k\b", r"\b4k\b", r"\bhdr\b",
    r"\bhigh detail\b", r"\bultra detailed\b", r"\bphotorealistic\b",
    r"\buhd image\b", r"\b\d+k uhd\b", r"\b\d+k resolution\b",
    r"\b\d{3,4}x\d{3,4}\b", r"\bhyperrealistic\b", r"\bultra hd\b",
]
#: Every text that a quality pattern matches holds one of these.
QUALITY_MARKS = ["uhd", "32k", "8k", "4k", "hdr", "detail", "realistic", "k resolution", "x", "ultra hd"]
RENDERING_ENGINES = [
    "unreal engine", "octane render", "cinema 4d", "v-ray", "blender",
    "unity engine", "cryengine", "ray tracing",
]
EXPECTED_CATEGORIES = {
    "core": ["style.genre", "style.medium", "style.era"],
    "punk": ["style.genre", "style.medium", "style.era"],
    "wave": ["style.genre", "style.medium", "style.era"],
    "artist": ["reference.person", "reference.film"],
    "color_pair": ["color.palette"],
}
SKIPPED_TYPES = ["film_stock", "camera_body", "quality_booster", "rendering_engine"]
SEARCHED_TYPES = ["core", "punk", "wave"]
STYLE = "in the style of"
ARTIST = r"(?i)in the style of\s+([^,]+)"


def _some(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def _kind(s: Column) -> Column:
    colored = lambda side: F.exists(words(side), lambda w: w.isin(COLOR_WORDS + COLOR_MODIFIERS))
    pair = r"^(.+?)\s+and\s+(.+)$"
    colors = F.contains(s, F.lit(" and ")) & colored(F.regexp_extract(s, pair, 1)) & colored(F.regexp_extract(s, pair, 2))
    ends = lambda end: F.contains(s, F.lit(end)) & F.rlike(s, F.lit(rf"\b\w+{end}\b"))
    return (
        F.when(F.length(s) < 2, None)
        .when(ends("core"), "core")
        .when(ends("punk"), "punk")
        .when(ends("wave"), "wave")
        .when(_some(s, RENDERING_ENGINES), "rendering_engine")
        .when(_some(s, QUALITY_MARKS) & F.rlike(s, F.lit("|".join(QUALITY_PATTERNS))), "quality_booster")
        .when(_some(s, FILM_STOCKS), "film_stock")
        .when(_some(s, CAMERA_BODIES), "camera_body")
        .when(colors, "color_pair")
    )


def typed_term(segment: Column) -> Column:
    """(term, term_type) of one segment; the type is null when it has none."""

    def named(s: Column) -> Column:
        part = lambda end: F.regexp_extract(s, rf"\b\w+{end}\b", 0)
        word = lambda k: F.when(k == "core", part("core")).when(k == "punk", part("punk")).when(k == "wave", part("wave"))
        return let(_kind(s), lambda k: F.struct(F.coalesce(word(k), s).alias("term"), k.alias("term_type")))

    return let(text_key(segment), named)


def extract_terms(prompts: DataFrame) -> DataFrame:
    """(prompt_id, image_id, term, term_type) of prompts (prompt_id, image_id, prompt).

    Artists come from "in the style of X"; one that is of another type counts as
    that. Other comma segments count when they have a type. Segments are typed
    inside the row, so only typed ones become rows.
    """

    def artist(t: Column) -> Column:
        return F.struct(t["term"].alias("term"), F.coalesce(t["term_type"], F.lit("artist")).alias("term_type"))

    styles = F.regexp_extract_all("prompt", F.lit(ARTIST), F.lit(1))
    artists = F.transform(F.transform(styles, typed_term), artist)
    parts = F.filter(F.split("prompt", ","), lambda s: F.lower(F.left(strip(s), F.lit(len(STYLE)))) != STYLE)
    typed = F.filter(
        F.concat(artists, F.transform(parts, typed_term)), lambda t: t["term_type"].isNotNull() & (F.length(t["term"]) >= 2)
    )
    # an inner explode makes Spark type every segment again in a filter on the array's size
    rows = prompts.select("prompt_id", "image_id", F.explode_outer(typed).alias("t")).filter(F.col("t.term_type").isNotNull())
    return rows.select("prompt_id", "image_id", "t.term", "t.term_type")


def audit_terms(
    terms: DataFrame,
    atoms: DataFrame,
    *,
    term_vectors: DataFrame | None = None,
    vectors: DataFrame | None = None,
    min_images: int = 3,
    min_sim: float = 0.6,
    expected: dict[str, list[str]] = EXPECTED_CATEGORIES,
) -> DataFrame:
    """Status and issues per (term, term_type, images).

    Exact text first, then text search for style words, then the nearest vector for
    frequent terms; each pass sees what the ones before left. Issues: several terms
    of one text, and a category the type does not expect.
    """
    # every pass reads the terms, so they are worked out once
    terms = cut_lineage(terms)
    live = atoms.filter(F.col("status") != "rejected")
    asked = terms.filter(~F.col("term_type").isin(SKIPPED_TYPES))
    exact = asked.select("term").distinct().join(live.select(F.col("text_lower").alias("term"), "id", "category_slug"), "term").select(
        "term", F.lit("exact").alias("via"), "id", "category_slug"
    )
    open_style = asked.filter(F.col("term_type").isin(SEARCHED_TYPES)).join(exact.select("term"), "term", "left_anti")
    found = text_search(open_style.select(F.col("term").alias("term_id"), "term").distinct(), live).select(
        F.col("term_id").alias("term"), F.col("atom_id").alias("id")
    )
    searched = found.join(live.select("id", "category_slug"), "id").select("term", F.lit("search").alias("via"), "id", "category_slug")
    hits = exact.unionByName(searched)
    if term_vectors is not None and vectors is not None:
        left = asked.filter(F.col("images") >= min_images).join(hits.select("term"), "term", "left_anti")
        query = left.select("term").distinct().join(term_vectors, "term").select(F.col("term").alias("id"), "vec")
        near = knn(query, vectors, 1, min_sim=min_sim, base_filter=~is_chunk_id("id"))
        semantic = near.select(F.col("query_id").alias("term"), F.col("neighbour_id").alias("id")).join(
            live.select("id", "category_slug"), "id"
        )
        hits = hits.unionByName(semantic.select("term", F.lit("semantic").alias("via"), "id", "category_slug"))
    odd = F.lit(False)
    for kind, slugs in expected.items():
        odd = odd | ((F.col("term_type") == kind) & F.col("category_slug").isNotNull() & ~F.col("category_slug").isin(slugs))
    per = (
        asked.select("term", "term_type").distinct()
        .join(hits, "term")
        .groupBy("term", "term_type")
        .agg(F.min("via").alias("via"), F.count("*").alias("atoms"), F.count_if(odd).alias("odd"))
    )
    skipped = F.col("term_type").isin(SKIPPED_TYPES)
    return terms.join(per, ["term", "term_type"], "left").select(
        "term",
        "term_type",
        "images",
        F.when(skipped, "skipped").when(F.col("atoms") > 0, "found").otherwise("missing").alias("status"),
        "via",
        F.when(F.col("odd") > 0, "classification_inconsistency").when(F.col("atoms") > 1, "duplicate").alias("issue"),
        F.coalesce("atoms", F.lit(0)).alias("atoms"),
    )
