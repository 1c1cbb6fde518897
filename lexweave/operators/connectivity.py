"""Tag votes, pole centroids and the whole connectivity pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.maths import cosine
from lexweave.functions.sizing import attach_packed
from lexweave.operators.edges import edge_degree, isolated_edges
from lexweave.operators.vectors import is_chunk_id, knn
from lexweave.session import cut_lineage

# Neighbour counts, vote counts and similarity bands.
TAG_NEIGHBOURS = 15
TAG_SIM = 0.75
TAG_VOTES = 3
TAG_AMBIGUOUS_VOTES = 2
POLE_SIM = 0.7
POLE_GAP = 0.2
AMBIGUOUS_LOW = 0.5
AMBIGUOUS_HIGH = 0.7
MIN_SEEDS = 3
MIN_EDGES = 3


def propagate_tags(
    vectors: DataFrame,
    atom_tags: DataFrame,
    *,
    queries: DataFrame | None = None,
    k: int = TAG_NEIGHBOURS,
    min_sim: float = TAG_SIM,
    votes: int = TAG_VOTES,
    ambiguous_votes: int = TAG_AMBIGUOUS_VOTES,
) -> DataFrame:
    """Tag votes of the near neighbours: (atom_id, tag_id, votes, confidence, outcome).

    The top ``k`` includes the term itself and chunks, which leave afterwards.
    """
    near = knn(vectors if queries is None else queries, vectors, k, min_sim=min_sim).filter(
        (F.col("query_id") != F.col("neighbour_id")) & ~is_chunk_id("neighbour_id")
    )
    # read by the votes and by their number
    near = cut_lineage(near)
    size = near.groupBy("query_id").agg(F.count("*").alias("neighbours"))
    tags = atom_tags.select(F.col("atom_id").alias("neighbour_id"), "tag_id")
    return (
        near.join(tags, "neighbour_id")
        .groupBy("query_id", "tag_id")
        .agg(F.count("*").alias("votes"))
        .filter(F.col("votes") >= min(votes, ambiguous_votes))
        .join(size, "query_id")
        .select(
            F.col("query_id").alias("atom_id"),
            "tag_id",
            "votes",
            (F.col("votes") / F.col("neighbours")).alias("confidence"),
            F.when(F.col("votes") >= votes, "applied")
            .when(F.col("votes") == ambiguous_votes, "ambiguous")
            .alias("outcome"),
        )
        .filter(F.col("outcome").isNotNull())
    )


def centroids(memberships: DataFrame, vectors: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Mean vector per (axis_slug, pole), for axes with enough seeds on both poles.

    Seeds are counted before vectors are joined; positions are averaged apart, so
    partial sums combine before the shuffle whatever the size of a pole.
    """
    seeds = (
        memberships.groupBy("axis_slug", "pole")
        .agg(F.count("*").alias("n"))
        .groupBy("axis_slug")
        .agg(F.count_if(F.col("n") >= min_seeds).alias("poles"))
        .filter(F.col("poles") == 2)
        .select("axis_slug")
    )
    return (
        memberships.join(seeds, "axis_slug", "left_semi")
        .join(vectors.select(F.col("id").alias("atom_id"), "vec"), "atom_id")
        .select("axis_slug", "pole", F.posexplode("vec").alias("pos", "x"))
        .groupBy("axis_slug", "pole", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("axis_slug", "pole")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .select("axis_slug", "pole", F.col("v.x").alias("centroid"))
    )


def score_memberships(
    vectors: DataFrame,
    centres: DataFrame,
    *,
    sim: float = POLE_SIM,
    gap: float = POLE_GAP,
    band_low: float = AMBIGUOUS_LOW,
    band_high: float = AMBIGUOUS_HIGH,
) -> DataFrame:
    """Pole per (term, axis): assigned, ambiguous, or no row."""
    poles = centres.groupBy("axis_slug").agg(
        F.max(F.when(F.col("pole") == "low", F.col("centroid"))).alias("low"),
        F.max(F.when(F.col("pole") == "high", F.col("centroid"))).alias("high"),
    ).filter(F.col("low").isNotNull() & F.col("high").isNotNull())
    packed, _ = attach_packed(vectors.select("id", "vec"), poles, "axes")
    scored = (
        packed.select("id", F.col("vec").cast("array<double>").alias("vec"), F.explode("axes").alias("a"))
        .select(
            F.col("id").alias("atom_id"),
            F.col("a.axis_slug").alias("axis_slug"),
            F.round(cosine("vec", "a.low"), 6).alias("sim_low"),
            F.round(cosine("vec", "a.high"), 6).alias("sim_high"),
        )
        .withColumn("best", F.greatest("sim_low", "sim_high"))
        .withColumn("gap", F.round(F.abs(F.col("sim_low") - F.col("sim_high")), 6))
    )
    hit = (F.col("best") >= sim) & (F.col("gap") >= gap)
    unsure = ((F.col("best") >= band_low) & (F.col("best") < band_high)) | (
        (F.col("best") >= sim) & (F.col("gap") < gap)
    )
    return scored.select(
        "atom_id",
        "axis_slug",
        F.when(hit, F.when(F.col("sim_low") > F.col("sim_high"), "low").otherwise("high")).alias(
            "pole"
        ),
        F.when(hit, "assigned").when(unsure, "ambiguous").alias("outcome"),
        "best",
        "gap",
    ).filter(F.col("outcome").isNotNull())


def needs_work(
    atoms: DataFrame,
    vectors: DataFrame,
    atom_tags: DataFrame,
    memberships: DataFrame,
    degree: DataFrame,
    min_edges: int = MIN_EDGES,
) -> DataFrame:
    """Each term with the flags of the skip check and its outcome."""
    tagged = atom_tags.select(F.col("atom_id").alias("id")).distinct().withColumn("has_tag", F.lit(True))
    placed = memberships.select(F.col("atom_id").alias("id")).distinct().withColumn("has_pole", F.lit(True))
    embedded = vectors.select("id").distinct().withColumn("embedded", F.lit(True))
    full = F.col("has_tag") & F.col("has_pole") & (F.col("degree") >= min_edges)
    flags = reduce(lambda a, b: a.join(b, "id", "left"), [tagged, placed, embedded, degree], atoms.select("id"))
    return flags.select(
        "id",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_tag", "has_pole", "embedded")],
        F.coalesce("degree", F.lit(0)).alias("degree"),
    ).withColumn(
        "outcome",
        F.when(full, "skipped_full").when(~F.col("embedded"), "skipped_unembedded").otherwise("processed"),
    )


def connectivity_pass(
    batch: DataFrame,
    vectors: DataFrame,
    atom_tags: DataFrame,
    memberships: DataFrame,
    edges: DataFrame,
    *,
    tag_sim: float = TAG_SIM,
    pole_sim: float = POLE_SIM,
    pole_gap: float = POLE_GAP,
    band_low: float = AMBIGUOUS_LOW,
    band_high: float = AMBIGUOUS_HIGH,
    edge_sim: float = 0.8,
    min_edges: int = MIN_EDGES,
) -> DataFrame:
    """Counters of one pass over ``batch`` (ids): what would be written, by kind.

    Rows that are already present do not count, as with an insert-or-ignore. What more than
    one counter reads is worked out once.
    """
    degree = cut_lineage(edge_degree(edges))
    flags = cut_lineage(needs_work(batch, vectors, atom_tags, memberships, degree, min_edges))
    work = cut_lineage(vectors.join(flags.filter(F.col("outcome") == "processed").select("id"), "id", "left_semi"))
    tags = cut_lineage(propagate_tags(vectors, atom_tags, queries=work, min_sim=tag_sim))
    poles = score_memberships(
        work,
        centroids(memberships, vectors),
        sim=pole_sim,
        gap=pole_gap,
        band_low=band_low,
        band_high=band_high,
    )
    poles = cut_lineage(poles)
    # only the lonely terms of the batch look for edges, but against every vector
    busy = degree.filter(F.col("degree") >= min_edges).select("id")
    lonely = work.join(busy, "id", "left_anti")
    fresh_edges = (
        knn(lonely, vectors, 8, min_sim=edge_sim)
        .filter((F.col("query_id") != F.col("neighbour_id")) & ~is_chunk_id("neighbour_id"))
        .select(
            F.least("query_id", "neighbour_id").alias("atom_a_id"),
            F.greatest("query_id", "neighbour_id").alias("atom_b_id"),
        )
        .distinct()
        .join(
            edges.filter((F.col("relationship_type") == "resonates") & (F.col("arrangement_scope") == "")),
            ["atom_a_id", "atom_b_id"],
            "left_anti",
        )
    )
    new_tags = tags.filter(F.col("outcome") == "applied").join(atom_tags, ["atom_id", "tag_id"], "left_anti")
    new_poles = poles.filter(F.col("outcome") == "assigned").join(
        memberships, ["atom_id", "axis_slug"], "left_anti"
    )

    def counter(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")

    parts = [
        flags.groupBy("outcome").agg(F.count("*").alias("n")).select(F.concat(F.lit("atoms_"), "outcome").alias("counter"), "n"),
        counter(new_tags, "tags_applied"),
        counter(tags.filter(F.col("outcome") == "ambiguous"), "tags_ambiguous"),
        counter(new_poles, "memberships_created"),
        counter(poles.filter(F.col("outcome") == "ambiguous"), "memberships_ambiguous"),
        counter(fresh_edges, "edges_created"),
    ]
    return reduce(DataFrame.unionByName, parts)
