"""Terms against curated profiles: tagging, axes, board centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.maths import DIMENSIONS, NEUTRAL, squared_gap
from lexweave.functions.sizing import attach_packed, spread

# Fixed values of the tagger.
MAX_DISTANCE = 0.8
TOP_N = 4
TAGGER_VERSION = 30
MIN_TEXT = 3

# Words of the older categorical profiles and their numbers.
CATEGORICAL_VALUES = {
    "hardness": {"soft": 0.2, "hard": 0.8, "neutral": 0.5},
    "temperature": {"cool": 0.2, "warm": 0.8, "neutral": 0.5},
    "weight": {"light": 0.2, "heavy": 0.8, "neutral": 0.5, "medium": 0.5},
    "formality": {"organic": 0.2, "structured": 0.8, "neutral": 0.5},
    "era_affinity": {"timeless": 0.25, "archaic": 0.4, "industrial": 0.65, "modern": 0.85},
}


def slug_words(slug: str | Column) -> Column:
    return F.replace(F.col(slug) if isinstance(slug, str) else slug, F.lit("-"), F.lit(" "))


def score_profiles(
    atoms: DataFrame,
    arrangements: DataFrame,
    *,
    max_distance: float = MAX_DISTANCE,
    top_n: int = TOP_N,
) -> DataFrame:
    """``arrangement_tags`` per term: the nearest profiles as array<(slug, dist)>.

    A profile whose words contain the text, or are contained in it, counts as
    distance 0. Profiles are scored inside the row, so no pair leaves the task.
    """
    dims = [*DIMENSIONS, "register"]
    known = [F.coalesce(d, F.lit(NEUTRAL)).alias(d) for d in dims]
    profiles = arrangements.filter(F.col("hardness").isNotNull()).select("slug", slug_words("slug").alias("words"), *known)
    packed, single = attach_packed(atoms.select("id", "text_lower", *known), profiles, "profiles")
    long_enough = F.length("text_lower") >= MIN_TEXT

    def scored(p: Column) -> Column:
        near = F.contains("text_lower", p["words"]) | F.contains(p["words"], F.col("text_lower"))
        return F.struct(
            F.when(long_enough & near, F.lit(0.0)).otherwise(squared_gap({d: F.col(d) for d in dims}, p, dims)).alias("sq"),
            p["slug"].alias("slug"),
        )

    def measured(s: Column) -> Column:
        return F.struct(F.round(F.sqrt(s["sq"]), 3).alias("dist"), s["slug"].alias("slug"))

    inside = F.filter(F.transform("profiles", scored), lambda s: F.sqrt(s["sq"]) <= max_distance)
    best = F.array_sort(F.transform(inside, measured))
    tags = packed.select("id", F.slice(best, 1, top_n).alias("tags"))
    if not single:
        tags = tags.groupBy("id").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("tags"))), 1, top_n).alias("tags")
        )
    return tags.withColumnRenamed("tags", "arrangement_tags")


def tag_arrangements(
    atoms: DataFrame,
    arrangements: DataFrame,
    *,
    version: int | None = None,
    max_distance: float = MAX_DISTANCE,
    top_n: int = TOP_N,
) -> DataFrame:
    """Tag the live terms below ``version``; a term with no profile is unaffiliated."""
    if version is None:
        version = max(TAGGER_VERSION, arrangements.count())
    todo = atoms.filter(
        F.col("category_slug").isNotNull()
        & F.col("hardness").isNotNull()
        & (F.col("status") != "rejected")
        & (F.col("tag_version") < version)
    )
    tags = score_profiles(todo, arrangements, max_distance=max_distance, top_n=top_n)
    return tags.withColumn("unaffiliated", F.size("arrangement_tags") == 0).withColumn(
        "tag_version", F.lit(version)
    )


def tag_rows(tagged: DataFrame) -> DataFrame:
    """The join-table view of the tag arrays: (atom_id, arrangement_slug, distance)."""
    return tagged.select(F.col("id").alias("atom_id"), F.explode("arrangement_tags").alias("t")).select(
        "atom_id", F.col("t.slug").alias("arrangement_slug"), F.col("t.dist").alias("distance")
    )


def tag_arrays(rows: DataFrame) -> DataFrame:
    """The array view of the join table; a term has at most a few profiles."""
    return rows.groupBy(F.col("atom_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("distance").alias("dist"), F.col("arrangement_slug").alias("slug")))
        ).alias("arrangement_tags")
    )


def reconcile_tags(tagged: DataFrame, rows: DataFrame) -> DataFrame:
    """Terms whose array and join-table slugs differ, with both lists."""
    left = tagged.select(
        F.col("id").alias("atom_id"),
        F.array_sort(F.transform("arrangement_tags", lambda t: t["slug"])).alias("array_slugs"),
    ).filter(F.size("array_slugs") > 0)
    right = rows.groupBy("atom_id").agg(
        F.array_sort(F.collect_list("arrangement_slug")).alias("table_slugs")
    )
    return left.join(right, "atom_id", "full").filter(
        ~F.col("array_slugs").eqNullSafe(F.col("table_slugs"))
    )


def numeric_profile(column: str, dimension: str) -> Column:
    """Number for an older categorical value; unknown words are neutral."""
    out = F.lit(None).cast("double")
    for word, number in CATEGORICAL_VALUES[dimension].items():
        out = F.coalesce(out, F.when(F.col(column) == word, F.lit(number)))
    return F.coalesce(out, F.lit(0.5))


def numeric_harmonics(df: DataFrame) -> DataFrame:
    """Rewrite the five categorical columns as numbers."""
    return df.withColumns({d: numeric_profile(d, d) for d in DIMENSIONS})


def one_hot_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean one-hot cosine of categorical profiles: the share of equal words.

    Words outside the vocabulary count as neutral; a neutral pair agrees.
    """
    total = F.lit(0.0)
    for dim in DIMENSIONS:
        known = [*CATEGORICAL_VALUES[dim], "neutral"]
        left = F.when(a[dim].isin(known), a[dim]).otherwise("neutral")
        right = F.when(b[dim].isin(known), b[dim]).otherwise("neutral")
        total = total + F.when(left == right, 1.0).otherwise(0.0)
    return total / len(DIMENSIONS)


def legacy_similarity_tags(
    atoms: DataFrame, arrangements: DataFrame, threshold: float = 0.65
) -> DataFrame:
    """Tag list of each term joined with the profiles at or over ``threshold``."""
    profiles = arrangements.select("slug", *DIMENSIONS)
    packed, single = attach_packed(spread(atoms.select("id", "tags", *DIMENSIONS)), profiles, "profiles")
    own = {d: F.col(d) for d in DIMENSIONS}
    hits = F.transform(
        F.filter(
            "profiles",
            lambda p: one_hot_similarity(own, {d: p[d] for d in DIMENSIONS}) >= threshold,
        ),
        lambda p: p["slug"],
    )
    out = packed.select("id", "tags", F.array_sort(hits).alias("hits"))
    if not single:
        out = out.groupBy("id").agg(
            F.first("tags").alias("tags"),
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        )
    return out.select("id", F.array_union("tags", "hits").alias("tags"))


def axis_position(harmonic_key: Column, row: dict[str, Column]) -> Column:
    """Coordinate of a term on an axis: its register, or the named dimension."""
    out = F.when(harmonic_key == "register", row["register"])
    for dim in DIMENSIONS:
        out = out.when(harmonic_key == dim, row[dim])
    return out


def board_positions(
    board_atoms: DataFrame, memberships: DataFrame, axes: DataFrame, atoms: DataFrame
) -> DataFrame:
    """(board, axis_slug, atom_id, text_lower, pole, coord) of resolved board terms."""
    members = memberships.join(axes.select("axis_slug", "harmonic_key"), "axis_slug")
    rows = (
        board_atoms.select("board", "atom_id").distinct()
        .join(members, "atom_id")
        .join(atoms.withColumnRenamed("id", "atom_id"), "atom_id")
    )
    coord = axis_position(
        F.col("harmonic_key"), {d: F.col(d) for d in [*DIMENSIONS, "register"]}
    )
    return rows.select(
        "board", "axis_slug", "atom_id", "text_lower", "pole", coord.alias("coord")
    ).filter(F.col("coord").isNotNull())


def boards_of_phrases(phrases: DataFrame, resolved: DataFrame) -> DataFrame:
    """(board, atom_id) of boards that are given as phrases: the terms their words resolve to.

    ``phrases``: phrase_id, board; ``resolved`` as ``resolve_phrases`` gives it.
    """
    found = resolved.filter(F.col("atom_id").isNotNull()).select("phrase_id", "atom_id").distinct()
    return found.join(phrases.select("phrase_id", "board").distinct(), "phrase_id").select("board", "atom_id").distinct()


def center_of_mass(positions: DataFrame, low_until: int = 5, high_from: int = 16) -> DataFrame:
    """Mean, population spread and confidence band per (board, axis)."""
    return positions.groupBy("board", "axis_slug").agg(
        F.count("*").alias("matched"),
        F.round(F.round(F.avg("coord"), 9), 4).alias("mean"),
        F.round(F.round(F.stddev_pop("coord"), 9), 4).alias("stdev"),
    ).withColumn(
        "confidence",
        F.when(F.col("matched") < low_until, "low")
        .when(F.col("matched") < high_from, "medium")
        .otherwise("high"),
    )


def driving_atoms(positions: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest terms of the high pole and lowest of the low pole."""
    pull = F.when(F.col("pole") == "high", -F.col("coord")).otherwise(F.col("coord"))
    order = Window.partitionBy("board", "axis_slug", "pole").orderBy(pull, "atom_id")
    return positions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
