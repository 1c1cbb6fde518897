"""The quality gate and bulk ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import head, strip, text_key
from lexweave.operators.curation import running_index
from lexweave.operators.predicates import HARD_REJECTS, route_content, validation_reason
from lexweave.operators.upserts import insert_ignore
from lexweave.operators.vectors import redundancy

# Fixed values of the gate.
REJECT_BELOW = 0.3
FLAG_BELOW = 0.5
REDUNDANT_OVER = 0.92


def quality_gate(
    inputs: DataFrame,
    vectors: DataFrame | None = None,
    known_vectors: DataFrame | None = None,
    *,
    reject_below: float = REJECT_BELOW,
    flag_below: float = FLAG_BELOW,
    redundant_over: float = REDUNDANT_OVER,
    max_text: int | None = 200,
) -> DataFrame:
    """Ordered decision per input (input_id, text, source, specificity).

    Text rules, source, specificity, redundancy, then pass or flag; ``atom_text`` shows
    the first ``max_text`` characters (None: all). Only rows that
    reach it take part in the neighbour search.
    """
    reason = validation_reason("text")
    score = F.col("specificity")
    early = (
        F.when(reason.isin(HARD_REJECTS), reason)
        .when(F.coalesce("source", F.lit("")) == "", "missing_provenance")
        .when(score < reject_below, "low_specificity")
    )
    rows = inputs.withColumn("_early", early)
    if vectors is not None and known_vectors is not None:
        open_rows = vectors.join(rows.filter(F.col("_early").isNull()).select(F.col("input_id").alias("id")), "id", "left_semi")
        near = redundancy(open_rows, known_vectors, redundant_over).withColumnRenamed("id", "input_id")
        rows = rows.join(near, "input_id", "left")
    else:
        rows = rows.withColumns({"similar_id": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    rejection = F.coalesce("_early", F.when(F.col("similar_id").isNotNull(), "redundant"))
    return rows.withColumn("rejection_reason", rejection).select(
        "input_id",
        F.when(F.col("rejection_reason") == "redundant", "redirect_merge")
        .when(F.col("rejection_reason").isNotNull(), "reject")
        .when(score < flag_below, "flag")
        .otherwise("pass")
        .alias("result"),
        "rejection_reason",
        "similar_id",
        "similarity",
        F.col("specificity").alias("specificity_score"),
        head("text", max_text).alias("atom_text"),
    )


def bulk_ingest(
    inputs: DataFrame,
    atoms: DataFrame,
    documents: DataFrame,
    *,
    vectors: DataFrame | None = None,
    known_vectors: DataFrame | None = None,
    redundant_over: float = REDUNDANT_OVER,
) -> dict[str, DataFrame]:
    """Route, gate and insert a batch (input_id, text, category, collection_slug,
    source, specificity). Returns the new terms, the new chunks and the counters.

    Chunks continue the index of their document (title, chunk_count); a document of
    any size is numbered without one task holding it.
    """
    routed = route_content(inputs)
    terms = routed.filter(F.col("destination") == "atom")
    gate = quality_gate(terms.drop("destination", "reason", "document", "suggested_tags"), vectors, known_vectors, redundant_over=redundant_over)
    passed = terms.join(gate.filter(F.col("result").isin("pass", "flag")).select("input_id"), "input_id", "left_semi")
    fresh = passed.select(
        text_key("text").alias("text_lower"),
        "collection_slug",
        "input_id",
        "text",
        "source",
        F.when(F.col("source") == "ai", "provisional").otherwise("confirmed").alias("status"),
        F.when(F.col("source") == "ai", 0.5).otherwise(1.0).alias("confidence"),
    )
    inserted, counts = insert_ignore(atoms, fresh, ["text_lower", "collection_slug"], [F.col("input_id")])
    long = routed.filter(F.col("destination") == "document_chunk").select(
        "input_id", "document", strip("text").alias("content"), F.col("category").alias("category_slug")
    )
    have = documents.select(F.col("title").alias("document"), F.col("chunk_count").alias("_have"))
    chunks = (
        running_index(long, ["document"], "input_id", "_at")
        .join(have, "document", "left")
        .select("input_id", "document", (F.col("_at") + F.coalesce("_have", F.lit(0))).alias("chunk_index"), "content", "category_slug")
    )
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    counters = reduce(
        DataFrame.unionByName,
        [
            counts.select(F.explode(F.array(
                F.struct(F.lit("inserted").alias("counter"), F.col("inserted").alias("n")),
                F.struct(F.lit("duplicates").alias("counter"), F.col("duplicates").alias("n")),
            )).alias("c")).select("c.*"),
            one(long, "chunks_created"),
            one(routed.filter(F.col("destination") == "reject"), "rejected"),
            one(gate.filter(F.col("result").isin("reject", "redirect_merge")), "gate_rejected"),
            one(gate.filter(F.col("result") == "flag"), "gate_flagged"),
        ],
    )
    return {"atoms": inserted, "chunks": chunks, "counters": counters, "gate": gate}
