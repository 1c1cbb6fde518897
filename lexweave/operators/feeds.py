"""Relevance of feed items, rankings and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.sizing import attach_packed
from lexweave.functions.text import parent_slug

# Thresholds by tier and the score of a match.
TIER_THRESHOLDS = {"core": 0.3, "adjacent": 0.5, "long_tail": 0.7}
LONG_KEYWORD = 10
SATURATION = 10
BASE, SPAN = 0.1, 0.8

# Curated relevance terms.
CURATED_TERMS = [
    "stable diffusion", "midjourney", "dall-e", "comfyui", "flux",
    "diffusion model", "image generation", "text-to-image", "img2img",
    "controlnet", "lora", "checkpoint", "inpainting", "outpainting",
    "generative ai", "generative art", "ai art", "neural style",
    "art deco", "art nouveau", "bauhaus", "brutalism", "cyberpunk",
    "steampunk", "noir", "vaporwave", "retrofuturism", "solarpunk",
    "surrealism", "impressionism", "expressionism", "minimalism",
    "chiaroscuro", "cinematography", "color grading", "color theory",
    "composition", "framing", "lighting", "mood board", "aesthetic",
    "visual style", "design system", "typography",
    "photography", "film grain", "bokeh", "wide angle", "telephoto",
    "golden hour", "blue hour", "long exposure", "double exposure",
    "stage design", "lighting design", "concert", "festival",
    "venue", "hospitality", "immersive", "projection mapping",
    "led wall", "moving head", "stage lighting",
    "creative coding", "shader", "procedural", "generative design",
    "touchdesigner", "processing", "openframeworks",
]

# Words that carry no topic, and words of two topic families.
TITLE_STOP_WORDS = (
    "the a an is are was were of for in on to and or but with by at from this that it its "
    "as be has have had not will can do if so no up out how what why when who new more "
    "most very also just than then"
).split()
TECHNICAL_KEYWORDS = [
    "ai", "ml", "model", "neural", "llm", "gpt", "diffusion", "transformer",
    "api", "sdk", "framework", "algorithm", "training", "inference", "pipeline",
    "automation", "tool", "tools", "platform", "software", "engineering",
    "flux", "stable", "gpu", "nvidia", "scaling", "accelerat",
]
CULTURAL_KEYWORDS = [
    "art", "design", "aesthetic", "visual", "culture", "style", "fashion",
    "architecture", "typography", "color", "photography", "illustration",
    "craft", "museum", "gallery", "exhibition", "creative", "painting",
    "history", "artist",
]

WORD = "[A-Za-z0-9_]"
SALTS = 16


def build_keywords(arrangements: DataFrame, atoms: DataFrame, curated: DataFrame) -> DataFrame:
    """Distinct keywords: curated terms, profile slugs and names, category parents."""
    parents = atoms.filter(F.col("status") == "confirmed").filter(F.contains("category_slug", F.lit("."))).select(
        parent_slug("category_slug").alias("keyword")
    )
    names = arrangements.select(F.explode(F.array("slug", "name")).alias("keyword"))
    return (
        curated.select("keyword").union(names).union(parents).select(F.lower("keyword").alias("keyword"))
        .filter(F.col("keyword") != "").distinct()
    )


def boundary_pattern(keyword: str | Column) -> Column:
    """Pattern of a keyword between word boundaries, other signs taken literally."""
    k = F.col(keyword) if isinstance(keyword, str) else keyword
    literal = F.regexp_replace(k, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    before = F.when(F.rlike(k, F.lit(f"^{WORD}")), f"(?<!{WORD})").otherwise(f"(?<={WORD})")
    after = F.when(F.rlike(k, F.lit(f"{WORD}$")), f"(?!{WORD})").otherwise(f"(?={WORD})")
    return F.concat(before, literal, after)


def keyword_hits(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """(item_id, keyword) for every keyword between word boundaries of the text.

    The first word of a keyword must be a whole word of the text, so items and
    keywords meet on that word; a keyword of one plain word needs no more, others
    are tested on the text. Keywords without any plain word meet every text on one of
    a few salts.
    """
    anchor = F.regexp_extract("keyword", f"{WORD}+", 0)
    any_text = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.concat(F.lit(" "), i.cast("string"))))
    rows = keywords.select("keyword", anchor.alias("anchor"), boundary_pattern("keyword").alias("pattern"))
    odd = rows.filter(F.col("anchor") == "").select("keyword", any_text.alias("anchor"), "pattern")
    rows = rows.filter(F.col("anchor") != "").unionByName(odd)
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({WORD}+)"), F.lit(1)))
    own_salt = F.concat(F.lit(" "), F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("string"))
    texts = items.select("item_id", F.lower("text").alias("text"))
    # words travel without their text; only items with a candidate meet it again
    found = texts.select("item_id", F.explode(F.array_append(tokens, own_salt)).alias("anchor")).join(rows, "anchor")
    hit = (F.col("anchor") == F.col("keyword")) | (
        F.contains("text", F.col("keyword")) & F.rlike("text", F.col("pattern"))
    )
    return found.join(texts, "item_id").filter(hit).select("item_id", "keyword")


def score_feed_items(items: DataFrame, keywords: DataFrame, sources: DataFrame) -> DataFrame:
    """Relevance of each item, and pending or no_terms by the tier of its source.

    ``items``: item_id, source_id, text; ``sources``: source_id, tier, weight.
    """
    weight = F.when(F.length("keyword") > LONG_KEYWORD, 2).otherwise(1)
    hits = keyword_hits(items, keywords).groupBy("item_id").agg(
        F.sum(weight).alias("w"), F.count("*").alias("matches")
    )
    threshold = F.lit(None).cast("double")
    for tier, value in TIER_THRESHOLDS.items():
        threshold = F.when(F.col("tier") == tier, value).otherwise(threshold)
    density = F.least(F.col("w") / SATURATION, F.lit(1.0))
    score = F.when(F.col("w").isNull(), 0.0).otherwise(F.least((BASE + density * SPAN) * F.col("weight"), F.lit(1.0)))
    return (
        items.select("item_id", "source_id")
        .join(hits, "item_id", "left")
        .join(sources, "source_id")
        .withColumn("score", F.round(score, 6))
        .select(
            "item_id", "source_id", F.coalesce("matches", F.lit(0)).alias("matches"), "score",
            F.when(F.col("score") >= threshold, "pending").otherwise("no_terms").alias("status"),
        )
    )


def title_keywords(title: str | Column, n: int = 8) -> Column:
    """First words of a title that carry a topic."""
    t = F.lower(F.col(title) if isinstance(title, str) else title)
    parts = F.split(t, r"[\s\-_,.;:!?()\[\]{}\"'`/\\|@#$%^&*+=<>~]+")
    return F.slice(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOP_WORDS)), 1, n)


def publishing_category(title: str | Column, arrangements: Column, profile_categories: dict[str, list[str]]) -> Column:
    """Category by profile list, else by title words, else business."""
    t = F.lower(F.col(title) if isinstance(title, str) else title)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    named = F.lit(None).cast("string")
    for name, slugs in profile_categories.items():
        listed = F.array(*[F.lit(s) for s in slugs])
        named = F.coalesce(named, F.when(F.arrays_overlap(arrangements, listed), F.lit(name)))
    return F.coalesce(
        named,
        F.when(has(TECHNICAL_KEYWORDS), "technical").when(has(CULTURAL_KEYWORDS), "cultural-thread").otherwise("business"),
    )


def publish_candidates(
    entries: DataFrame,
    queue: DataFrame,
    documents: DataFrame,
    profile_categories: dict[str, list[str]],
    *,
    min_score: float = 0.5,
    n: int = 10,
) -> DataFrame:
    """The best ingested entries not queued yet, whose document exists, with their
    category. ``documents`` is the output of ``document_profile``."""
    best = (
        entries.filter((F.col("relevance_score") >= min_score) & F.col("ingested"))
        .join(queue.select("entry_id"), "entry_id", "left_anti")
        .orderBy(F.desc("relevance_score"), "entry_id")
        .limit(n)
    )
    found = best.join(documents.filter(F.col("score") > 0), "document_id")
    return found.select(
        "entry_id",
        "document_id",
        "relevance_score",
        publishing_category("title", F.col("arrangements"), profile_categories).alias("category"),
    )


# Fixed values of candidate ranking.
MAX_PDF_MB = 100
MIN_RANK_SCORE = 0.4


def rank_candidates(items: DataFrame, ingested: DataFrame, *, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(top candidates per request, skip reasons with counts).

    Bonus 0.1 for OCR, 0.1 over a thousand views and 0.2 over five thousand.
    """
    views = F.when(F.col("views") > 5_000, 0.2).when(F.col("views") > 1_000, 0.1).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), F.col("base_score") + F.when(F.col("has_ocr"), 0.1).otherwise(0.0) + views), 6)
    done = ingested.select("pdf_url").distinct().withColumn("_done", F.lit(True))
    rows = items.dropDuplicates(["request_id", "identifier"]).join(done, "pdf_url", "left").withColumn("score", score)
    reason = (
        F.when(F.col("mediatype").isNotNull() & (F.col("mediatype") != "texts"), "wrong_mediatype")
        .when(F.col("pdf_url").isNull(), "no_pdf")
        .when(F.col("size_mb") > MAX_PDF_MB, "too_large")
        .when(F.col("_done"), "already_ingested")
        .when(F.col("score") < MIN_RANK_SCORE, "low_relevance")
    )
    rows = rows.withColumn("skip_reason", reason)
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "identifier")
    top = (
        rows.filter(F.col("skip_reason").isNull())
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select("request_id", "identifier", "score", "place")
    )
    skipped = rows.filter(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("n"))
    return top, skipped


# Names and formats of preview images.
THUMB_NAME = r"(?i)__ia_thumb|_thumb"
THUMB_FORMATS = ["Item Tile", "JPEG Thumb", "Thumbnail", "Item Image"]


def best_image(files: DataFrame, max_mb: float = 10) -> DataFrame:
    """One image per item: a PNG original, else the largest; none over the limit."""
    size = F.coalesce(F.col("size").try_cast("long"), F.lit(0).cast("long"))
    images = files.filter(
        F.rlike("name", F.lit(r"(?i)\.(png|jpe?g|tiff?)$"))
        & ~F.rlike("name", F.lit(THUMB_NAME))
        & ~F.coalesce("format", F.lit("")).isin(THUMB_FORMATS)
    ).withColumn("bytes", size)
    png = F.rlike("name", F.lit(r"(?i)\.png$")) & (F.col("format") == "PNG")
    order = F.struct(
        F.when(png, 0).otherwise(1), F.when(png, F.lit(0).cast("long")).otherwise(-F.col("bytes")), F.col("name")
    )
    return _picked(images, order, max_mb)


def best_pdf(files: DataFrame, max_mb: float = 100) -> DataFrame:
    """One PDF per item: text PDF, additional text PDF, plain PDF, any; none over the limit."""
    size = F.coalesce(F.col("size").try_cast("long"), F.lit(0).cast("long"))
    pdfs = files.filter(F.lower("name").endswith(".pdf")).withColumn("bytes", size)
    rank = (
        F.when(F.col("format") == "Text PDF", 0)
        .when(F.col("format") == "Additional Text PDF", 1)
        .when(~F.rlike("name", F.lit(r"(?i)_text\.pdf$")), 2)
        .otherwise(3)
    )
    return _picked(pdfs, F.struct(rank, F.col("name")), max_mb)


def _picked(files: DataFrame, order: Column, max_mb: float) -> DataFrame:
    best = files.groupBy("item_id").agg(F.min_by(F.struct("name", "format", "bytes"), order).alias("f"))
    mb = F.col("f.bytes") / (1024 * 1024)
    return best.filter(mb <= max_mb).select(
        "item_id", F.col("f.name").alias("name"), F.col("f.format").alias("format"), F.round(mb, 2).alias("size_mb")
    )


def gap_analysis(
    arrangements: DataFrame,
    chunk_profiles: DataFrame,
    coverage: DataFrame,
    important: list[str],
    *,
    thin: int = 20,
    baseline_under: int = 50,
) -> DataFrame:
    """Profiles without chunks (priority 0.9), and profiles with at least two
    important categories under ``thin`` terms (0.8 for a small profile, else 0.7).

    ``coverage``: arrangement_slug, category_slug, atom_count.
    """
    none = arrangements.select("slug").join(
        chunk_profiles.select(F.col("arrangement_slug").alias("slug")), "slug", "left_anti"
    )
    no_chunks = none.select(
        "slug", F.lit("baseline").alias("request_type"), F.lit(0.9).alias("priority"), F.lit(0).cast("long").alias("total_atoms"),
        F.lit(0).alias("thin_categories"),
    )
    enough = F.col("category_slug").isin(important) & (F.col("atom_count") >= thin)
    per = coverage.groupBy(F.col("arrangement_slug").alias("slug")).agg(
        F.sum("atom_count").alias("total_atoms"), (F.lit(len(important)) - F.count_if(enough)).cast("int").alias("thin_categories")
    )
    small = F.col("total_atoms") < baseline_under
    gaps = (
        per.join(arrangements.select("slug"), "slug", "left_semi")
        .filter(F.col("thin_categories") >= 2)
        .select(
            "slug",
            F.when(small, "baseline").otherwise("gap_fill").alias("request_type"),
            F.when(small, 0.8).otherwise(0.7).alias("priority"),
            "total_atoms",
            "thin_categories",
        )
    )
    return no_chunks.unionByName(gaps)


def context_gap_matrix(targets: DataFrame, categories: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, category_slug) pairs without guidance. Both lists are reference
    tables; the pairs are made inside the rows of one of them."""
    packed, _ = attach_packed(targets.select("context").distinct(), categories.select("slug"), "c")
    pairs = packed.select("context", F.explode("c.slug").alias("category_slug"))
    return pairs.join(contexts.select("context", "category_slug"), ["context", "category_slug"], "left_anti")
