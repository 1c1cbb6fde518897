"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions alone.

The lexicon holds the terms whose inverse document frequency lies within a band. Random
subsets of it are cut by the terms' hashes: at level l, subset s holds the terms with hash
s modulo 2**l. A text keeps the distinct terms that fall into the first subsets of two
levels, chosen by its number of terms so that a subset holds one or two of them; they are
sorted and every subset is hashed. Texts are alike as far as their subsets' hashes agree.
Only the few dozen terms of a text that fall into its subsets are ever moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from lexweave.functions.text import let
from lexweave.llm.tables import small_enough, text_of
from lexweave.session import cut_lineage

#: Everything between two terms.
BETWEEN = r"[^\p{L}\p{N}]+"
#: A term of the lexicon occurs in at least this power of the number of documents, and in two ...
LEAST_POWER = 0.1
#: ... and in at most this part of them.
MOST_SHARE = 0.5
#: Subsets of a level that are hashed; a power of two.
SUBSETS = 32
#: Lexicon terms (16 bytes each) up to which they are broadcast to the texts.
SMALL_ROWS = 2_000_000
#: Repeated rows that one array of the last step stands for.
COPIES = 10_000


def terms_of(text: Column) -> Column:
    """64-bit hashes of the distinct terms of a text, lower-cased."""
    words = F.array_remove(F.split(F.lower(text), BETWEEN), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(
    docs: DataFrame, *, text_col: str = "text", least_power: float = LEAST_POWER, most_share: float = MOST_SHARE
) -> DataFrame:
    """(term, n): hash and document count of the terms within the band, counted over all documents.

    The band of inverse document frequencies is log(1 / ``most_share``) to
    (1 - ``least_power``) log(number of documents); a term of one document is never in it.
    Null texts count as empty documents.
    """
    total = docs.count()
    least, most = max(2.0, total**least_power), max(2.0, most_share * total)
    terms = docs.select(F.explode(terms_of(text_of(docs, text_col))).alias("term"))
    return cut_lineage(terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)))


def _below(bits: Column) -> Column:
    """A mask of the lowest ``bits`` bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def _hashed(terms: Column, level: Column, subsets: int) -> Column:
    """Hash of the sorted terms of each subset at a level; an empty subset has an empty one."""

    def one(s: Column) -> Column:
        own = F.filter(terms, lambda t: t.bitwiseAND(_below(level)) == s)
        return let(own, lambda x: F.when(F.size(x) > 0, F.right(F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), F.lit(8))).otherwise(""))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(subsets - 1).cast("long")), one)


def fingerprints(
    rows: DataFrame, terms: DataFrame, *, key_cols: list[str], text_cols: list[str], subsets: int = SUBSETS, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """``key_cols`` and, for every text column, its fingerprint in its place: one row per key.

    ``terms`` is the lexicon. A fingerprint is a string of four parts between colons: a hash
    of all terms of the text, the level, and the subsets' hashes at that level and one level
    on, empty for an empty subset. Equal texts have equal fingerprints; a null text counts
    as empty; rows that share a key must have the same texts.
    """
    prepared = rows.select(*key_cols, *[let(terms_of(text_of(rows, c)), lambda t: F.struct(t.alias("t"), F.sort_array(t).alias("s"))).alias(c) for c in text_cols])
    base = subsets.bit_length() - 1
    prepared = prepared.select(
        *key_cols,
        *[F.greatest(F.lit(base), F.length(F.bin(F.greatest(F.size(f"{c}.t") - 1, F.lit(1)).cast("long"))) - 1).alias(f"_level{i}") for i, c in enumerate(text_cols)],
        *[F.xxhash64(f"{c}.s").alias(f"_whole{i}") for i, c in enumerate(text_cols)],
        *[F.col(f"{c}.t").alias(f"_terms{i}") for i, c in enumerate(text_cols)],
    )
    kept = [*key_cols, *[f"_{n}{i}" for i in range(len(text_cols)) for n in ("level", "whole")]]

    def sampled(i: int) -> Column:
        mine = F.filter(f"_terms{i}", lambda t: t.bitwiseAND(_below(F.col(f"_level{i}"))) < subsets)
        # the hash of all terms, no term itself, holds a row for a text without a term in any subset
        return F.transform(F.concat(mine, F.array(f"_whole{i}")), lambda t: F.struct(F.lit(i).alias("i"), t.alias("term")))

    spread = prepared.select(*kept, F.explode(F.concat(*[sampled(i) for i in range(len(text_cols))])).alias("x"))
    spread = spread.select(*kept, "x.i", "x.term")
    known = small_enough(terms.select("term", F.lit(True).alias("_known")), small_rows)
    met = spread.join(known, "term", "left").groupBy(*kept).agg(
        F.collect_list(F.when(F.col("_known"), F.struct("i", "term"))).alias("_met")
    )

    def printed(i: int) -> Column:
        own = F.array_sort(F.array_distinct(F.transform(F.filter("_met", lambda x: x["i"] == i), lambda x: x["term"])))
        level = F.col(f"_level{i}")
        return let(own, lambda t: F.concat_ws(
            ":", F.lower(F.hex(f"_whole{i}")), level.cast("string"),
            F.array_join(_hashed(t, level, subsets), ","), F.array_join(_hashed(t, level + 1, subsets), ","),
        ))

    return met.select(*key_cols, *[printed(i).alias(c) for i, c in enumerate(text_cols)])


def likeness(x: Column, y: Column) -> Column:
    """Part of the subsets used by either of two fingerprints that agree, 0 to 1.

    Subsets are compared at the levels both have. Where neither uses a subset, fingerprints
    are alike (1) only if all terms of their texts are the same.
    """

    def seen(p: Column, q: Column, agree: bool) -> Column:
        same = F.zip_with(p, q, lambda a, b: ((a == b) & (a != "")) if agree else ((a != "") | (b != "")))
        return F.size(F.filter(same, lambda v: v))

    def share(x: Column, y: Column, pairs: list[tuple[Column, Column]]) -> Column:
        agree = sum((seen(p, q, True) for p, q in pairs), F.lit(0))
        either = sum((seen(p, q, False) for p, q in pairs), F.lit(0))
        return F.when(either > 0, agree / either).otherwise((x["whole"] == y["whole"]).cast("double"))

    def parsed(fingerprint: Column) -> Column:
        return let(F.split(fingerprint, ":"), lambda p: F.struct(
            p[0].alias("whole"), p[1].cast("int").alias("level"), F.split(p[2], ",").alias("coarse"), F.split(p[3], ",").alias("fine")
        ))

    def compared(x: Column, y: Column) -> Column:
        step = y["level"] - x["level"]
        return (
            F.when(step == 0, share(x, y, [(x["coarse"], y["coarse"]), (x["fine"], y["fine"])]))
            .when(step == 1, share(x, y, [(x["fine"], y["coarse"])]))
            .when(step == -1, share(x, y, [(x["coarse"], y["fine"])]))
            .otherwise(F.lit(0.0))
        )

    return let(F.struct(parsed(x).alias("x"), parsed(y).alias("y")), lambda p: compared(p["x"], p["y"]))


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts (a, b, text) and, per different row, its place in the order of descending ids.

    The second frame has (a, b, id, copies, n_chars, next_a, next_b). ``a`` and ``b`` are
    two hashes of a row's id and text. Rows of equal id are ordered by them; rows repeated
    in both are one document, counted by ``copies``. After the last comes the first; a null
    id comes last.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(docs[id_col], text).alias("a"), F.xxhash64(F.lit(7), docs[id_col], text).alias("b"))
    keys = rows.groupBy("id", "a", "b").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    order = [F.col("id").desc_nulls_last(), "a", "b"]
    # the place is fixed by writing it; every range of ids is a window of its own
    placed = cut_lineage(
        keys.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    )
    key = F.struct("a", "b")
    after = F.lead(key).over(Win.partitionBy("part").orderBy("place"))
    # one row per range: what follows the last of each
    firsts = placed.groupBy("part").agg(F.min_by(key, "place").alias("first"))
    ranges = Win.orderBy("part")
    whole = ranges.rowsBetween(Win.unboundedPreceding, Win.unboundedFollowing)
    follows = firsts.select("part", F.coalesce(F.lead("first").over(ranges), F.first("first").over(whole)).alias("follow"))
    found = placed.withColumn("next", after).join(F.broadcast(follows), "part").withColumn("next", F.coalesce("next", "follow"))
    return rows.select("a", "b", "text"), found.select("a", "b", "id", "copies", "n_chars", F.col("next.a").alias("next_a"), F.col("next.b").alias("next_b"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **band: float) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per document.

    The edited text of a document is its text with the last third of its code points
    replaced by as many (or all) first ones of the next document by descending id.

    Null texts count as empty. A null id comes last in the order, ids that tie are ordered
    by a hash of their row, a repeated row (id and text) stands once in the order and comes
    back as often as it is there; the only document is its own next one. An empty table
    gives no rows; other columns are not looked at. Texts without a term of the lexicon are
    alike only when all their terms are the same.
    """
    texts, links = neighbours(docs, id_col=id_col, text_col=text_col)
    take = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = links.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.col("a").alias("for_a"), F.col("b").alias("for_b"), take.alias("take"))
    heads = texts.join(wanted, ["a", "b"]).select("for_a", "for_b", F.substr("text", F.lit(1), F.col("take")).alias("head"))
    heads = heads.groupBy(F.col("for_a").alias("a"), F.col("for_b").alias("b")).agg(F.first("head").alias("head"))
    changed = texts.join(links.select("a", "b", "n_chars"), ["a", "b"]).join(heads, ["a", "b"]).select(
        "a", "b", "text", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - take), "head").alias("edited")
    )
    prints = fingerprints(changed, lexicon(docs, text_col=text_col, **band), key_cols=["a", "b"], text_cols=["text", "edited"])
    sums = changed.groupBy("a", "b").agg(F.first(F.sha2("edited", 256)).alias("edited_sha256"))
    done = cut_lineage(
        prints.join(sums, ["a", "b"]).join(links, ["a", "b"]).select(
            "a", "b", "id", "copies", "n_chars", "next_a", "next_b", "edited_sha256", "text",
            F.col("edited").alias("edited_fingerprint"), likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        )
    )
    following = done.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("text").alias("following"))
    rows = done.join(following, ["next_a", "next_b"]).select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("text").alias("fingerprint"),
        "edited_fingerprint", "near_edited", likeness(F.col("text"), F.col("following")).alias("near_next"), "copies",
    )
    lots = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))
    rows = rows.withColumn("lot", F.explode(lots))
    in_lot = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("lot") * COPIES)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), in_lot))).drop("copies", "lot", "copy")
