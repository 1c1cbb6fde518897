"""Quality checks on films, reviews, posts, page titles, text blocks and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import col, strip

# Fixed values of film screening.
GENRE_KEYWORDS = ["noir", "sci-fi", "science fiction", "horror", "fantasy", "animation", "mystery", "thriller"]
BEFORE_YEAR = 1970
MIN_OVERVIEW_WORDS = 100
MIN_BUDGET = 50_000_000
MIN_REVENUE = 200_000_000

# Words of plot talk, not of looks.
PLOT_TERMS = [
    "predictable", "boring", "twist", "ending", "plot hole", "chemistry",
    "overacted", "underrated", "disappointing", "masterpiece", "sequel",
    "overrated", "cliche", "formulaic", "remake", "prequel", "backstory",
    "character development", "acting", "dialogue", "script", "screenplay",
]

# Fixed values of image posts and page titles.
IMAGE_EXTENSION = r"(?i)\.(jpg|jpeg|png|webp|gif)$"
IMAGE_HOSTS = ["i.redd.it", "i.imgur.com"]
NAMESPACE_PREFIXES = [
    "Template:", "User:", "Category:", "File:",
    "Help:", "Special:", "MediaWiki:", "Module:", "Portal:",
]

# Phrases a post and an article must not hold.
POST_BANNED = [
    "as an ai", "as a language model", "i cannot", "i'm sorry, but",
    "it's important to note", "in conclusion", "let me help you", "here's a",
    "here is a", "delve into", "it is worth noting", "certainly!",
    "absolutely!", "great question",
]
ARTICLE_BANNED = [
    "in conclusion", "to summarize", "in summary", "let's dive in",
    "without further ado", "let's explore", "it's worth noting",
    "it should be noted", "needless to say", "at the end of the day",
    "when all is said and done", "game-changer", "revolutionary",
    "cutting-edge", "groundbreaking", "leverage", "utilize", "synergy",
    "ecosystem", "in today's world", "in the digital age", "as we all know",
    "going forward", "moving forward",
]


def any_contains(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def film_flags(films: DataFrame, directors: DataFrame) -> DataFrame:
    """The five criteria of each film and the first that selects it.

    A long overview is only counted; it selects nothing.
    """
    known = directors.select(F.lower("name").alias("_director")).distinct().withColumn("_known", F.lit(True))
    year = F.try_to_number(F.split_part(F.coalesce("release_date", F.lit("")), F.lit("-"), F.lit(1)), F.lit("9999")).cast("int")
    out = films.withColumn("_director", F.lower("director")).join(known, "_director", "left")
    out = out.withColumns(
        {
            "by_genre": any_contains(F.lower(F.coalesce("genres", F.lit(""))), GENRE_KEYWORDS),
            "by_year": F.coalesce((year > 0) & (year < BEFORE_YEAR), F.lit(False)),
            "by_director": F.coalesce("_known", F.lit(False)),
            "by_overview": F.coalesce(F.size(F.split("overview", r"\s+")) >= MIN_OVERVIEW_WORDS, F.lit(False)),
            "by_budget": F.coalesce((F.col("budget") >= MIN_BUDGET) | (F.col("revenue") >= MIN_REVENUE), F.lit(False)),
        }
    ).drop("_director", "_known")
    return out.withColumn(
        "filter_reason",
        F.when(F.col("by_genre"), "genre")
        .when(F.col("by_year"), "year")
        .when(F.col("by_director"), "director")
        .when(F.col("by_budget"), "budget_revenue"),
    )


def filter_films(films: DataFrame, directors: DataFrame) -> DataFrame:
    return film_flags(films, directors).filter(F.col("filter_reason").isNotNull())


def film_filter_stats(flags: DataFrame) -> DataFrame:
    names = ["genre", "year", "director", "overview", "budget"]
    return flags.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(f"by_{n}")).alias(n) for n in names],
        F.count("filter_reason").alias("passed"),
    )


def filter_terms(df: DataFrame, term: str = "term", blocklist: list[str] | None = None) -> DataFrame:
    """Terms of 3 to 80 characters that hold no blocked part."""
    t = F.col(term)
    return df.filter(
        (F.length(t) >= 3) & (F.length(t) <= 80) & ~any_contains(F.lower(t), blocklist or PLOT_TERMS)
    )


def is_image_post() -> Column:
    """A live single-image post, by hint, extension or host."""
    blocked = F.lit(False)
    for flag in ("is_gallery", "is_video", "over_18", "stickied"):
        blocked = blocked | F.coalesce(F.col(flag), F.lit(False))
    host = F.try_parse_url("url", F.lit("HOST"))
    image = (
        F.coalesce(F.col("post_hint") == "image", F.lit(False))
        | F.rlike("url", F.lit(IMAGE_EXTENSION))
        | host.isin(IMAGE_HOSTS)
    )
    return ~blocked & F.col("removed_by").isNull() & host.isNotNull() & image


def filter_image_posts(posts: DataFrame) -> DataFrame:
    return posts.filter(is_image_post())


def is_page_title(title: str | Column) -> Column:
    """Not a list, a disambiguation or a namespace page."""
    t = col(title)
    out = ~F.contains(t, F.lit("List of")) & ~t.endswith("(disambiguation)")
    for prefix in NAMESPACE_PREFIXES:
        out = out & ~t.startswith(prefix)
    return out


def valid_page_titles(pages: DataFrame, title: str = "title") -> DataFrame:
    return pages.filter(is_page_title(title))


def lines_of(text: str | Column) -> Column:
    return F.filter(F.split(col(text), "\n"), lambda s: strip(s) != "")


def is_infobox(text: str | Column) -> Column:
    """Mostly white space in many short lines."""
    t, lines = col(text), lines_of(text)
    blank = F.regexp_count(t, F.lit(r"\s")) / F.length(t)
    short = F.forall(lines, lambda s: F.length(strip(s)) < 80)
    return (F.size(lines) > 5) & (blank > 0.6) & short


def is_prose(text: str | Column) -> Column:
    """Enough lines with sentence marks or length, and lines not too short."""
    lines = lines_of(text)
    sentence = F.filter(lines, lambda s: F.rlike(s, F.lit(r"[.?!]")) | (F.length(strip(s)) > 80))
    chars = F.aggregate(lines, F.lit(0), lambda n, s: n + F.length(strip(s)))
    n = F.size(lines)
    return (n > 0) & (F.size(sentence) / n >= 0.3) & ~((chars / n < 50) & (n > 5))


def is_index_page(text: str | Column) -> Column:
    """Over 40% of at least ten words are numbers."""
    parts = F.split(col(text), r"\s+")
    numbers = F.filter(parts, lambda w: F.rlike(w, F.lit(r"^\d+[.,\-]*$")))
    return (F.size(parts) >= 10) & (F.size(numbers) / F.size(parts) > 0.4)


def is_link_heavy(html: str | Column, text: str | Column) -> Column:
    """More than one link per two words."""
    links = F.regexp_count(col(html), F.lit(r"(?i)<a "))
    count = F.size(F.split(col(text), r"\s+"))
    return (links > 0) & (links / count > 0.5)


def errors_of(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def validate_posts(posts: DataFrame) -> DataFrame:
    """Format and style errors of short posts (text, alt_text)."""
    text = F.col("text")
    alt = F.length(F.coalesce("alt_text", F.lit("")))
    return posts.withColumn(
        "errors",
        errors_of(
            {
                "text_too_long": F.length(text) > 280,
                "text_too_short": F.length(text) < 20,
                "banned_phrase": any_contains(F.lower(text), POST_BANNED),
                "too_many_hashtags": F.regexp_count(text, F.lit(r"#\w+")) > 2,
                "dash": F.contains(text, F.lit("—")) | F.contains(text, F.lit("–")),
                "alt_text": alt < 10,
            }
        ),
    )


def validate_articles(articles: DataFrame) -> DataFrame:
    """Schema and style errors of articles."""
    empty = {c: F.coalesce(c, F.lit("")) == "" for c in ("title", "slug", "excerpt", "body_md", "hero_direction")}
    size = {c: F.length(c) for c in ("title", "slug", "excerpt", "body_md")}

    def outside(name: str, low: int, high: int) -> Column:
        return ~empty[name] & ((size[name] < low) | (size[name] > high))

    tags = F.size("tags")
    return articles.withColumn(
        "errors",
        errors_of(
            {
                **{f"{c}_required": test for c, test in empty.items()},
                "tags_required": F.col("tags").isNull(),
                "title_length": outside("title", 10, 100),
                "excerpt_length": outside("excerpt", 50, 200),
                "body_length": outside("body_md", 200, 5000),
                "tag_count": F.col("tags").isNotNull() & ((tags < 1) | (tags > 8)),
                "slug_format": ~empty["slug"] & ~F.rlike("slug", F.lit(r"^[a-z0-9-]+$")),
                "slug_length": ~empty["slug"] & (size["slug"] > 60),
                "banned_phrase": any_contains(F.lower(F.coalesce("body_md", F.lit(""))), ARTICLE_BANNED),
            }
        ),
    )
