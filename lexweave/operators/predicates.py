"""Filters and row checks over terms, categories, posts and signals."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import glob_pattern, like, strip, text_key

# Fixed values of term validation.
MIN_LENGTH = 3
MAX_LENGTH = 80
MAX_WORDS = 6
EMOTICON = r"(?i)^:[a-z<>()3dp]{1,2}$"
NON_TEXT = r"^[^A-Za-z_]+$"
STOCK_CAPTION = r"(?i)stock photo|clip ?art|vector illustration"
HARD_REJECTS = ["emoticon", "non_text", "stock_caption", "comment", "too_short"]

# Document titles by category, in order of precedence.
DOCUMENT_RULES = [
    ("suffix", ".aesthetic", "Aesthetic Definitions"),
    ("path", "__", "Art and Reference Taxonomy"),
    ("prefix", "reference.", "Character Briefs Collection"),
    ("prefix", "narrative.", "Scene Compositions"),
    ("prefix", "environment.", "Setting and Environment Descriptions"),
    ("prefix", "covering.", "Costume and Outfit Descriptions"),
]
DEFAULT_DOCUMENT = "Uncategorized Knowledge"

# Bare adjectives that say nothing on their own.
GENERIC_TERMS = (
    "prominent beautiful large nice good bad small big pretty ugly simple complex "
    "detailed amazing interesting cool awesome realistic perfect great fine strong weak "
    "normal regular basic standard typical high low medium long short wide narrow"
).split()


def validation_reason(text: str | Column) -> Column:
    """The first failing rule of a term, or ``valid``."""
    t = strip(text)
    return (
        F.when(F.length(t) < MIN_LENGTH, "too_short")
        .when(F.length(t) > MAX_LENGTH, "too_long")
        .when(t.startswith("#") | t.startswith("//") | t.startswith("--"), "comment")
        .when(F.contains(t, F.lit("\n")), "multiline")
        .when(F.size(F.split(t, r"\s+")) > MAX_WORDS, "too_many_words")
        .when(F.rlike(t, F.lit(EMOTICON)), "emoticon")
        .when(F.rlike(t, F.lit(NON_TEXT)), "non_text")
        .when(F.rlike(t, F.lit(STOCK_CAPTION)), "stock_caption")
        .otherwise("valid")
    )


def validate_atoms(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("reason", validation_reason(text))


def route_content(df: DataFrame, text: str = "text", category: str = "category") -> DataFrame:
    """Destination of a text: atom, document_chunk (with its document) or reject."""
    out = validate_atoms(df, text)
    reason, cat, body = F.col("reason"), F.coalesce(F.col(category), F.lit("")), strip(text)
    title = F.lit(None).cast("string")
    for kind, mark, document in DOCUMENT_RULES:
        test = {
            "suffix": cat.endswith(mark),
            "prefix": cat.startswith(mark),
            "path": F.contains(body, F.lit(mark)) & F.contains(body, F.lit("/")),
        }[kind]
        title = F.coalesce(title, F.when(test, F.lit(document)))
    destination = (
        F.when(reason == "valid", "atom")
        .when(reason.isin(HARD_REJECTS), "reject")
        .otherwise("document_chunk")
    )
    chunk = destination == "document_chunk"
    return out.select(
        *df.columns,
        destination.alias("destination"),
        F.when(reason == "valid", "valid_atom")
        .when(chunk, F.concat(reason, F.lit("_routed")))
        .otherwise(reason)
        .alias("reason"),
        F.when(chunk, F.coalesce(title, F.lit(DEFAULT_DOCUMENT))).alias("document"),
        F.when(chunk & title.isNull(), F.array(F.lit("needs-review"))).alias("suggested_tags"),
    )


def is_generic(text: str | Column) -> Column:
    """A single word from the list of bare adjectives."""
    return text_key(text).isin(GENERIC_TERMS)


@dataclass(frozen=True)
class AtomFilter:
    """Conjunction of optional tests; rejected terms never match."""

    min_length: int | None = None
    max_length: int | None = None
    category_like: str | None = None
    category_in: list[str] = field(default_factory=list)
    text_like: str | None = None
    text_pattern: str | None = None
    text_in: list[str] = field(default_factory=list)
    text_not_in: list[str] = field(default_factory=list)
    text_glob: str | None = None
    category_is_null: bool = False

    def column(self) -> Column:
        if not any(bool(getattr(self, f.name)) or getattr(self, f.name) == 0 and getattr(self, f.name) is not False for f in fields(self)):
            raise ValueError("at least one filter criterion is required")
        text, cat = F.col("text_lower"), F.col("category_slug")
        tests = [F.col("status") != "rejected"]
        if self.min_length is not None:
            tests.append(F.length(text) > self.min_length)
        if self.max_length is not None:
            tests.append(F.length(text) <= self.max_length)
        if self.category_like:
            tests.append(like(cat, self.category_like))
        if self.category_in:
            tests.append(cat.isin(self.category_in))
        if self.text_like:
            tests.append(like(text, self.text_like))
        if self.text_pattern:
            tests.append(like(F.col("text"), self.text_pattern, escape=True))
        if self.text_in:
            tests.append(text.isin(self.text_in))
        if self.text_not_in:
            tests.append(~text.isin(self.text_not_in))
        if self.text_glob:
            tests.append(F.rlike(text, F.lit(glob_pattern(self.text_glob))))
        if self.category_is_null:
            tests.append(cat.isNull())
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def filter_atoms(atoms: DataFrame, spec: AtomFilter) -> DataFrame:
    return atoms.filter(spec.column())


def list_atoms(
    atoms: DataFrame,
    *,
    collection: str | None = None,
    status: str | None = None,
    source: str | None = None,
    source_app: str | None = None,
    q: str | None = None,
    after: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """One page of terms, and a one-row frame with the totals of the same filters.

    ``total`` counts all matches; ``total_after`` counts those past the cursor. Far
    pages are cheap by the cursor ``after``; ``offset`` reads all it passes over.
    """
    for name, value in [
        ("collection_slug", collection),
        ("status", status),
        ("source", source),
        ("source_app", source_app),
    ]:
        if value:
            atoms = atoms.filter(F.col(name) == value)
    if q:
        atoms = atoms.filter(F.contains("text_lower", F.lit(q.lower().strip())))
    past = F.col("id") > after if after else F.lit(True)
    totals = atoms.agg(F.count("*").alias("total"), F.count_if(past).alias("total_after"))
    if after:
        page = atoms.filter(past).orderBy("id").limit(limit)
    else:
        page = atoms.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return page, totals


def review_queue(atoms: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Provisional terms, most seen first, oldest first among equals."""
    return (
        atoms.filter(F.col("status") == "provisional")
        .orderBy(F.desc("encounter_count"), "created_at", "id")
        .offset(offset)
        .limit(limit)
    )


def resolve_category_patterns(categories: DataFrame, patterns: list[str]) -> DataFrame:
    """Categories matched by ``*``, ``parent.*`` or an exact slug, each once with
    the first pattern that named it."""
    place = F.lit(None).cast("int")
    for i, pattern in enumerate(patterns):
        if pattern == "*":
            test = F.lit(True)
        elif pattern.endswith(".*"):
            test = F.col("parent") == pattern[:-2]
        else:
            test = F.col("slug") == pattern
        place = F.coalesce(place, F.when(test, F.lit(i)))
    return categories.withColumn("place", place).filter(F.col("place").isNotNull())


def list_categories(categories: DataFrame, parent: str | None = None) -> DataFrame:
    rows = categories.filter(F.col("parent") == parent) if parent else categories
    return rows.orderBy("slug")


def category_contexts(contexts: DataFrame, slug: str, context: str | None = None) -> DataFrame:
    rows = contexts.filter(F.col("category_slug") == slug)
    return (rows.filter(F.col("context") == context) if context else rows).orderBy("context")


def contexts_for_categories(
    contexts: DataFrame, slugs: DataFrame, wanted: list[str]
) -> DataFrame:
    """Guidance of the named categories, always with the default context."""
    return contexts.filter(F.col("context").isin([*wanted, "default"])).join(
        slugs.select(F.col("slug").alias("category_slug")).distinct(), "category_slug", "left_semi"
    )


def phase_candidates(
    atoms: DataFrame, as_of: Column, *, tag_version: int = 30, guard_minutes: int = 30
) -> DataFrame:
    """(id, phase) for every phase a term still needs, all phases in one scan.

    A term queued within the guard is left alone.
    """
    cat = F.col("category_slug")
    classified = cat.isNotNull()
    live = F.col("status") != "rejected"
    profiled = F.col("hardness").isNotNull()
    phases = {
        "classify": cat.isNull() | (cat == ""),
        "vectorize": (F.col("embedding_status") == "pending") & classified,
        "harmonics": classified & ~profiled & live,
        "tagging": classified & profiled & (F.col("tag_version") < tag_version) & live,
        "register": F.col("register").isNull() & classified,
        "correspondences": (F.col("degree") == 0) & (F.col("embedding_status") == "complete") & classified,
    }
    due = F.col("last_enqueued_at").isNull() | (
        F.col("last_enqueued_at") < as_of - F.expr(f"INTERVAL {int(guard_minutes)} MINUTES")
    )
    wanted = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in phases.items()]))
    return atoms.filter(due).select("id", F.explode(wanted).alias("phase"))


def pending_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without an embedding; this phase has no guard."""
    return chunks.filter(F.col("embedding_status") == "pending").select(
        F.col("chunk_id").alias("id"), F.lit("vectorize_chunks").alias("phase")
    )


CANDIDATE_SCHEMA = (
    "name string, suggested_category string, confidence double, "
    "source_name string, target_name string, relationship_type string, strength double"
)


def list_candidates(
    candidates: DataFrame,
    *,
    status: str = "pending",
    source_url: str | None = None,
    candidate_type: str | None = None,
    category: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Review candidates with their payload parsed; an edge passes the confidence
    test, but never a category test."""
    rows = candidates.filter(F.col("status") == status)
    if source_url:
        rows = rows.filter(F.col("source_url") == source_url)
    if candidate_type in ("atom", "correspondence"):
        rows = rows.filter(F.col("candidate_type") == candidate_type)
    rows = rows.withColumn("data", F.from_json("candidate_data", CANDIDATE_SCHEMA))
    atom = F.col("candidate_type") == "atom"
    if category:
        rows = rows.filter(atom & (F.col("data.suggested_category") == category))
    if min_confidence is not None:
        rows = rows.filter(~atom | ~(F.coalesce(F.col("data.confidence"), F.lit(1.0)) < min_confidence))
    return rows


def candidates_by_source(rows: DataFrame) -> DataFrame:
    """Candidate counts and confidence per source page."""
    return rows.groupBy("source_url").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("candidate_type") == "atom").alias("atoms"),
        F.max("data.confidence").alias("best_confidence"),
    )


def missing_terms(terms: DataFrame, atoms: DataFrame) -> DataFrame:
    """Listed terms that are no term yet (by lower-case text)."""
    return terms.withColumn("text_lower", text_key("text")).join(
        atoms.select("text_lower").distinct(), "text_lower", "left_anti"
    )


def harmonic_range(
    atoms: DataFrame, axis: str, low: float, high: float, categories: list[str] | None = None
) -> DataFrame:
    """Terms at either end of one dimension, each end ordered outward-in."""
    rows = atoms.filter((F.col("status") != "rejected") & F.col(axis).isNotNull())
    if categories:
        rows = rows.filter(F.col("category_slug").isin(categories))
    end = F.when(F.col(axis) <= low, "low").when(F.col(axis) >= high, "high")
    return (
        rows.select("id", "text_lower", "category_slug", end.alias("end"), F.col(axis).alias("value"))
        .filter(F.col("end").isNotNull())
        .orderBy("end", F.when(F.col("end") == "low", F.col("value")).otherwise(-F.col("value")), "id")
    )


def recent_signals(
    signals: DataFrame,
    as_of: Column,
    *,
    days: int = 7,
    topic_like: str | None = None,
    subreddit: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Signals of the last ``days`` days by topic part or by source, strongest first."""
    rows = signals.filter(F.col("scan_date") >= F.date_sub(as_of, days))
    if topic_like:
        rows = rows.filter(like(F.col("topic"), f"%{topic_like}%"))
    if subreddit:
        rows = rows.filter(F.col("subreddit") == subreddit)
    rows = rows.orderBy(F.desc("scan_date"), F.desc("intensity"), "signal_id")
    return rows.limit(limit) if limit else rows
