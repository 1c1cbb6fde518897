"""File readers: term tables, quoted tables, list files, tagged entries, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import strip, text_key

# Fixed values of list files.
MAX_LINE = 100
PLACEHOLDER = r"^[{<].*[>}]$"
SIMPLE_KEY = r"^[^{}<>|*]{1,80}$"


def read_csv_terms(
    spark: SparkSession, path: str, *, text_col: str, tags_col: str | None = None, collection: str, source_app: str = "csv-import"
) -> DataFrame:
    """Rows of a table with a header as terms; blank texts leave, tags split at commas."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=False)
    tags = F.array().cast("array<string>")
    if tags_col:
        parts = F.transform(F.split(F.coalesce(tags_col, F.lit("")), ","), strip)
        tags = F.filter(parts, lambda t: t != "")
    return raw.select(strip(text_col).alias("text"), tags.alias("tags")).filter(F.col("text") != "").select(
        "text",
        text_key("text").alias("text_lower"),
        "tags",
        F.lit(collection).alias("collection_slug"),
        F.lit("manual").alias("source"),
        F.lit(source_app).alias("source_app"),
    )


def read_quoted_csv(spark: SparkSession, path: str, schema: str, *, header: bool = True) -> DataFrame:
    """A quoted table with doubled quotes; rows of another width than the header leave.

    ``schema`` names the columns as strings; the reader keeps the whole line of a
    broken row in ``_bad``, which is then dropped.
    """
    raw = spark.read.csv(
        path,
        schema=f"{schema}, _bad string",
        header=header,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_bad",
        enforceSchema=True,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    return raw.filter(F.col("_bad").isNull()).drop("_bad")


def read_list_files(spark: SparkSession, path: str, max_line: int | None = MAX_LINE) -> DataFrame:
    """(file, term) of text files with a term per line.

    Comments, placeholder lines and lines over ``max_line`` characters leave (None: none is too long). Lines are split over tasks,
    whatever the size of a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), strip("value").alias("term"))
    t = F.col("term")
    return lines.filter(
        (t != "")
        & ~t.startswith("#")
        & ~t.startswith("//")
        & ~F.rlike(t, F.lit(PLACEHOLDER))
        & (F.lit(True) if max_line is None else F.length(t) <= max_line)
    )


def read_tag_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(file, term, tag) of entries with a ``Tags:`` list; keys with wildcard signs leave.

    A file is one entry list of a curator, read whole; its text is cut at each
    unindented key.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    entry = r"(?m)^([^\s:][^\n]*?):[^\n]*\n((?:[ \t]+[^\n]*(?:\n|$)|\s*\n)*)"
    found = files.select("file", F.explode(F.regexp_extract_all("value", F.lit(entry), F.lit(0))).alias("e"))
    key = F.regexp_replace(strip(F.regexp_extract("e", entry, 1)), r"""^(['"])(.*)\1$""", "$2")
    block = F.regexp_extract("e", r"(?m)^\s+Tags\s*:\s*\n((?:\s+-\s+[^\n]*(?:\n|$))+)", 1)
    tags = F.regexp_extract_all(block, F.lit(r"(?m)^\s+-\s+([^\n]+)"), F.lit(1))
    simple = F.rlike("term", F.lit(SIMPLE_KEY)) & ~F.contains("term", F.lit("  "))
    rows = found.select("file", key.alias("term"), tags.alias("tags")).filter(simple)
    slug = F.regexp_replace(text_key("t"), r"\s+", "-")
    return rows.select("file", "term", F.explode_outer("tags").alias("t")).select(
        "file", "term", F.when(F.col("t").isNotNull(), F.concat(F.lit("yaml:"), slug)).alias("tag")
    )


def read_axis_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case slugs of a manifest, one per line, comments out."""
    lines = spark.read.text(path).select(text_key("value").alias("slug"))
    return lines.filter((F.col("slug") != "") & ~F.col("slug").startswith("#")).distinct()
