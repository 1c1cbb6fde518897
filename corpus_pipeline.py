"""The training-data pipeline: five operators of lexweave.llm, one after another.

Each stage takes the documents that the one before kept and returns those it keeps with
the columns of documents; the last returns the pieces of the packed sequences. Missing
texts, empty tables, repeated rows and further columns are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.decontam import drop_contaminated
from lexweave.llm.neardup import drop_near_duplicates
from lexweave.llm.pii import replace_pii
from lexweave.llm.quality import keep_quality
from lexweave.llm.queries import packed, table
from lexweave.session import cut_lineage

#: Least quality score of a kept document.
QUALITY = 0.3
#: Secret of the surrogates; a user of the pipeline sets their own.
PII_KEY = "corpus"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored QUALITY or more by trees learned from the labels of ``docs``."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and ``n_chars`` brought up to date."""
    return replace_pii(docs, key=PII_KEY, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("packing", packing),
]

#: Trees, signatures, factorisations and token ids are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one keeps is written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
