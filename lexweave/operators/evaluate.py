"""Compiled prompts graded against reference prompts.

A pair is one row (image_id, candidate, references array<string>). Prompts are
short, so segments are compared inside the row and nothing is paired across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import col, text_key, words

# Segments that do not count, and the suffixes of the small stemmer.
EXCLUDED = (
    r"\buhd\b|\b\d+k\b|\bhdr\b|\bphotorealistic\b|\bhyperrealistic\b|\bultra detailed\b|\bhigh detail\b|"
    r"\bultra hd\b|\b\d+x\d+\b|\bnikon\b|\bcanon\b|\bhasselblad\b|\bleica\b|\bsony\b|\bpentax\b|\bmamiya\b|"
    r"\bsigma\b|\bunreal engine\b|\boctane render\b|\bcinema 4d\b|\bv-ray\b|\bblender\b|\bray tracing\b"
)
STEM_SUFFIXES = ["ing", "ed", "ly", "ness", "tion", "es", "s"]
MIN_STEM_WORD = 5
STYLE_OF = "in the style of"
ARTIST = r"(?i)in the style of\s+([^,]+)"


def segments(prompt: str | Column) -> Column:
    """Comma segments, trimmed, lower case."""
    return F.filter(F.transform(F.split(col(prompt), ","), text_key), lambda s: s != "")


def stem_word(word: Column) -> Column:
    out = word
    for suffix in reversed(STEM_SUFFIXES):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= 3)
        out = F.when(fits, F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return F.when(F.length(word) < MIN_STEM_WORD, word).otherwise(out)


def artists_of(prompt: Column) -> Column:
    return F.transform(F.regexp_extract_all(prompt, F.lit(ARTIST), F.lit(1)), text_key)


def is_excluded(token: Column) -> Column:
    return F.rlike(token, F.lit("(?i)" + EXCLUDED))


def match_type(token: Column, segs: Column, stemmed: Column, seg_words: Column) -> Column:
    """exact, stemmed, levenshtein or null for one reference segment."""
    stem = stem_word(token)
    limit = F.when(F.length(token) < 10, 2).otherwise(3)
    near = F.exists(
        seg_words,
        lambda w: (F.abs(F.length(w) - F.length(token)) <= limit) & (F.levenshtein(w, token) <= limit),
    )
    return (
        F.when(F.exists(segs, lambda s: F.contains(s, token)), "exact")
        .when(F.exists(stemmed, lambda s: F.contains(s, stem)), "stemmed")
        .when(near, "levenshtein")
    )


def graded_tokens(pairs: DataFrame, include_artists: bool = False) -> DataFrame:
    """(image_id, token, match) for every scorable reference segment; a pair without
    any keeps one row with a null token."""
    refs = F.array_distinct(F.flatten(F.transform("references", segments)))
    artists = F.array_distinct(F.flatten(F.transform("references", artists_of)))
    rows = pairs.withColumns({"_segs": segments("candidate"), "_refs": refs, "_artists": artists})
    rows = rows.withColumns(
        {
            "_words": F.array_distinct(F.flatten(F.transform("_segs", words))),
            "_stemmed": F.transform("_segs", lambda s: F.array_join(F.transform(words(s), stem_word), " ")),
        }
    )

    def scorable(t: Column) -> Column:
        keep = ~is_excluded(t) & ~t.startswith(STYLE_OF)
        return keep if include_artists else keep & ~F.array_contains("_artists", t)

    tokens = rows.select("image_id", "_segs", "_stemmed", "_words", F.explode_outer(F.filter("_refs", scorable)).alias("token"))
    return tokens.select(
        "image_id",
        "token",
        F.when(F.col("token").isNotNull(), match_type(F.col("token"), F.col("_segs"), F.col("_stemmed"), F.col("_words"))).alias("match"),
    )


def vocabulary_overlap(pairs: DataFrame, include_artists: bool = False) -> DataFrame:
    """Share of the reference segments that the candidate has; 1 when there are none."""
    return graded_tokens(pairs, include_artists).groupBy("image_id").agg(
        F.count("token").alias("total"),
        F.count("match").alias("matched"),
        F.when(F.count("token") == 0, 1.0).otherwise(F.count("match") / F.count("token")).alias("vocabulary_overlap"),
    )


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def comma_ratio(prompt: Column) -> Column:
    commas = F.regexp_count(prompt, F.lit(","))
    ends = F.regexp_count(prompt, F.lit(r"[.!?](\s|$)"))
    return commas / (commas + ends + 1)


def form_scores(pairs: DataFrame) -> DataFrame:
    """Word ratio and comma structure of each pair."""
    count = lambda p: F.size(words(p)).cast("double")
    mean_words = mean_of(F.transform("references", count))
    own, other = comma_ratio(F.col("candidate")), mean_of(F.transform("references", comma_ratio))
    return pairs.select(
        "image_id",
        F.when(mean_words > 0, count(F.col("candidate")) / mean_words).otherwise(0.0).alias("length_ratio"),
        F.greatest(F.lit(0.0), 1.0 - F.abs(own - other)).alias("structure_score"),
    )


def combined(vocabulary: Column, length: Column, structure: Column, weights=(0.5, 0.25, 0.25)) -> Column:
    fit = 1.0 - F.least(F.abs(length - 1.0), F.lit(1.0))
    return vocabulary * weights[0] + fit * weights[1] + structure * weights[2]


def grade(pairs: DataFrame, include_artists: bool = False) -> DataFrame:
    """The three axes and the combined score of each pair."""
    both = vocabulary_overlap(pairs, include_artists).join(form_scores(pairs), "image_id")
    total = combined(F.col("vocabulary_overlap"), F.col("length_ratio"), F.col("structure_score"))
    tidy = lambda c, d: F.floor(c * 10**d + 0.5) / 10**d
    return both.select(
        "image_id",
        "total",
        "matched",
        tidy(F.col("vocabulary_overlap"), 3).alias("vocabulary_overlap"),
        tidy(F.col("length_ratio"), 2).alias("length_ratio"),
        tidy(F.col("structure_score"), 3).alias("structure_score"),
        tidy(total, 3).alias("combined"),
    )


def divergences(pairs: DataFrame, include_artists: bool = False) -> DataFrame:
    """Labelled differences (image_id, divergence, term)."""
    none = F.lit(None).cast("string")
    missed = graded_tokens(pairs, include_artists).filter(F.col("token").isNotNull() & F.col("match").isNull()).select(
        "image_id", F.lit("vocabulary_miss").alias("divergence"), F.col("token").alias("term")
    )
    form = form_scores(pairs)
    ratio = F.col("length_ratio")
    length = form.select(
        "image_id", F.when(ratio > 2.0, "length_excess").when(ratio < 0.5, "length_deficit").alias("divergence"), none.alias("term")
    ).filter(F.col("divergence").isNotNull())
    prose = form.filter(F.col("structure_score") < 0.5).select("image_id", F.lit("structure_prose").alias("divergence"), none.alias("term"))
    lower = F.lower("candidate")
    artists = pairs.select("image_id", lower.alias("_c"), F.explode(F.array_distinct(F.flatten(F.transform("references", artists_of)))).alias("term"))
    lost = artists.filter(~F.contains("_c", F.col("term"))).select("image_id", F.lit("artist_missing").alias("divergence"), "term")
    first = F.transform(
        "references",
        lambda r: F.try_element_at(F.filter(segments(r), lambda s: is_excluded(s) & ~F.contains(F.lower("candidate"), s)), F.lit(1)),
    )
    boosters = pairs.select("image_id", F.explode(F.array_compact(first)).alias("term")).select(
        "image_id", F.lit("booster_missing").alias("divergence"), "term"
    )
    return missed.unionByName(length).unionByName(prose).unionByName(lost).unionByName(boosters)
