"""Set semantics of writes: ignore, replace, first-wins, already seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import sha_key, text_key


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``min_by`` over a struct combines before the shuffle, so a key that holds most
    rows still leaves each task as one row.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def dedup_first(df: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """First row per lower-case trimmed text; blank texts leave."""
    keyed = df.withColumn("text_lower", text_key(text)).filter(F.col("text_lower") != "")
    return first_per_key(keyed, ["text_lower"], order)


def insert_ignore(
    target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts) of an insert that ignores key conflicts.

    A row of the target wins over the batch and the first of the batch wins
    within it. Null keys are equal to each other.
    """
    held = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]
    rest = [c for c in new.columns if c not in keys]
    batch = new.select(*held, *rest)
    inserted = first_per_key(batch, keys, order).join(target.select(*held), keys, "left_anti")
    zero = F.lit(0).cast("long")
    counts = (
        batch.agg(zero.alias("i"), F.count("*").alias("r"))
        .unionByName(inserted.agg(F.count("*").alias("i"), zero.alias("r")))
        .agg(F.sum("i").alias("inserted"), (F.sum("r") - F.sum("i")).alias("duplicates"))
    )
    return inserted, counts


def insert_replace(target: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write per key over both tables; the batch wins an equal version."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(version, "_new", *[c for c in rest if c != version])).alias("_r"))
        .select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in target.columns])
    )


def distinct_taxonomy(atoms: DataFrame, collections: DataFrame) -> DataFrame:
    """Collection slugs in use or declared, sorted."""
    return (
        atoms.select(F.col("collection_slug").alias("slug"))
        .union(collections.select("slug"))
        .distinct()
        .orderBy("slug")
    )


def provenance_union(specs: DataFrame) -> DataFrame:
    """Every provenance that some manifest spec asks for."""
    return specs.select(F.explode("provenances").alias("provenance")).distinct()


def merge_found_in(hits: DataFrame) -> DataFrame:
    """One row per item with the set of queries that found it."""
    return hits.groupBy("item_id").agg(
        F.min_by("title", F.col("query")).alias("title"),
        F.array_sort(F.collect_set("query")).alias("found_in"),
    )


def seen_entries(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Items not stored yet by (source_id, url), with a content hash."""
    fresh = items.join(entries.select("source_id", "url"), ["source_id", "url"], "left_anti")
    return fresh.withColumn("content_hash", sha_key("title", "url"))


def dedup_external(candidates: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New candidates by (source, external_uri), and counts per source."""
    unique = candidates.dropDuplicates(["source", "external_uri"])
    fresh = unique.join(known.select("source", "external_uri"), ["source", "external_uri"], "left_anti")
    counts = (
        candidates.groupBy("source")
        .agg(F.count("*").alias("fetched"))
        .join(fresh.groupBy("source").agg(F.count("*").alias("fresh")), "source", "left")
        .withColumn("fresh", F.coalesce("fresh", F.lit(0)))
        .withColumn("skipped", F.col("fetched") - F.col("fresh"))
    )
    return fresh, counts


def dedup_urls(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests neither of whose URLs (requested, resolved) was completed before."""
    done = log.filter(F.col("status") == "complete").select(
        F.explode(F.array("requested_url", "resolved_url")).alias("url")
    ).filter(F.col("url").isNotNull()).distinct()
    return requests.join(done, requests.requested_url == done.url, "left_anti").join(
        done, requests.resolved_url == done.url, "left_anti"
    )


def gap_dedup(gaps: DataFrame, requests: DataFrame) -> DataFrame:
    """Gaps whose profile no open request targets."""
    busy = requests.filter(
        F.col("status").isin("pending", "claimed", "searching", "ingesting")
    ).select(F.explode(F.from_json("target_arrangements", "array<string>")).alias("slug"))
    return gaps.join(busy, "slug", "left_anti")


def drawn(key: str, seed: int) -> Column:
    """The lot of a row: a hash of its key and the seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_terms(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A repeatable random sample of ``n`` rows."""
    return df.orderBy(drawn(key, seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A repeatable random sample of ``n`` rows of each group."""
    order = Window.partitionBy(group).orderBy(drawn(key, seed), key)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")
