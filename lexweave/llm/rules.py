"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions alone.

Rules are counted inside the row. The likelihood ratio compares two multinomials over
hashed words and word pairs: that of the trusted target documents and that of the whole
corpus. Both are counted over all documents with map-side sums; what comes to the driver
is one number per bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import let
from lexweave.llm.tables import small_enough, text_of

SPACE = r"[\x20\x09-\x0D]"
BUCKETS = 32_768
#: N-grams added to every bucket of the target, and to what the corpus lets expect there.
SMOOTHING = 8.0
#: Least mean log ratio of a kept text.
THRESHOLD = -0.1
#: Ids of target documents up to which they are broadcast to the scan of the texts.
SMALL_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def buckets_of(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words; ``words`` is bound."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(single, pairs)


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that occur twice or more, the first included; ``words`` is bound."""
    runs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]),
    )

    def covered(run: Column) -> Column:
        order = F.sort_array(F.transform(run, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            order,
            lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
        )
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")), lambda a: a["n"]
        )

    return let(runs, lambda run: F.when(F.size(F.array_distinct(run)) == F.size(run), F.lit(0)).otherwise(covered(run)))


def counts(text: Column, ratios: list[float]) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and score of a text.

    The text is split into words once for all that needs them.
    """
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own)))
    inside = let(
        words_of(text),
        lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), mean_ratio(w, ratios).alias("score")),
    )
    return let(
        inside,
        lambda w: F.struct(
            w["n"].cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            w["r"].cast("long").alias("n_repeat_words"),
            w["score"].alias("score"),
        ),
    )


def failed(n_words: Column, n_repeat_words: Column, *, least_words: int = 50, repeat_percent: int = 50) -> Column:
    """The plain rules: too short, or too much repeated."""
    return (n_words < least_words) | (100 * n_repeat_words > repeat_percent * n_words)


def log_ratios(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> list[float]:
    """Log ratio of the target's n-grams to those the corpus lets expect, for each bucket.

    All n-grams of all documents count. A bucket of ``o`` target n-grams, ``e`` expected
    ones (its corpus share of the target's size), has log((o + smoothing) / (e + smoothing)),
    so rare buckets say little. ``target`` holds the ids of trusted documents; null and
    repeated ids do not matter. Without target n-grams all ratios are 0. Nine places.
    """
    trusted = target.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_target", F.lit(1))
    texts = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text"))
    marked = texts.join(small_enough(trusted, SMALL_ROWS), "_id", "left")
    grams = marked.select("_target", F.explode(let(words_of(F.col("_text")), lambda w: buckets_of(w, buckets))).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_target").alias("trusted")).collect()
    raw, own = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r.b], own[r.b] = r.raw, r.trusted
    if not any(own):
        return [0.0] * buckets
    share = sum(own) / sum(raw)
    return [round(math.log((o + smoothing) / (r * share + smoothing)), 9) for o, r in zip(own, raw)]


def mean_ratio(words: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams of bound ``words``; 0 for a text without words."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return let(
        buckets_of(words, len(ratios)),
        lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.greatest(F.size(b), F.lit(1)),
    )


def judged(
    docs: DataFrame, ratios: list[float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **rules
) -> DataFrame:
    """One row (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) per document.

    ``kept`` is false where a rule fails, else whether the mean log ratio (``score``)
    reaches ``threshold``. Null text has no words and fails; null ids stay null; repeated
    rows are judged alike; an empty table gives no rows; other columns are not looked at.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col], text.alias("_text"))
    rows = rows.select(id_col, counts(F.col("_text"), ratios).alias("c")).select(id_col, "c.*")
    bad = failed(F.col("n_words"), F.col("n_repeat_words"), **rules)
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        bad.alias("base_failed"), (~bad & (F.col("score") >= threshold)).alias("kept"), "score",
    )
