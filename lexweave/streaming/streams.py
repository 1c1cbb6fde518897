"""Structured Streaming forms of the event-driven operators.

Each function maps a streaming frame to a streaming frame (or starts a
``foreachBatch`` query) and declares its own watermark. Checkpoint folders are the
caller's and must be shared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexweave.functions.text import sha_key
from lexweave.operators.feeds import score_feed_items
from lexweave.session import cut_lineage
from lexweave.sources.folders import parts

CONFIRM_AT = 3


def timed(df: DataFrame, column: str) -> DataFrame:
    """Event time as an instant; a watermark takes no zone-less timestamp."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def encounter_stream(events: DataFrame, confirm_at: int = CONFIRM_AT) -> DataFrame:
    """Running sightings of the terms that have reached ``confirm_at``, for update mode.

    ``events``: atom_id, seen (sightings the row stands for), base (count held before the
    stream, the same on all rows of a term). Sightings are summed per term in every task
    before the shuffle, so a frequent term is one row per task; the state is two numbers
    per term. A term appears again whenever its count grows, to be upserted by its id.
    """
    totals = events.groupBy("atom_id").agg(F.sum("seen").alias("seen"), F.max("base").alias("base"))
    total = (F.col("seen") + F.coalesce("base", F.lit(0))).cast("long")
    return totals.select("atom_id", total.alias("encounter_count")).filter(F.col("encounter_count") >= confirm_at)


def confirmed_once(
    events: DataFrame, confirm_at: int = CONFIRM_AT, *, time: str | None = None, late: str = "1 day", forget_after: float | None = None
) -> DataFrame:
    """(atom_id, encounter_count): every term once, when it reaches ``confirm_at``; for append mode.

    ``events`` as for ``encounter_stream``; a term whose ``base`` has reached the bound was
    confirmed before the stream and never comes out. Sightings are summed per term in every
    task's batches before they go to the state, so a hot term is a few rows a batch. The
    state is the count and whether the term has come out. With ``time``, a timer drops the
    count of a term that is not confirmed and not seen for ``forget_after`` seconds.
    """
    timed_out = time is not None and forget_after is not None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by("atom_id").aggregate([("seen", "sum"), ("base", "max"), ("at", "max")])
            yield from table.rename_columns(["atom_id", "seen", "base", "at"]).combine_chunks().to_batches()

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, done = state.get if state.exists else (0, False)
        base, last = 0, 0
        for rows in batches:
            seen += int(rows["seen"].sum())
            base = max(base, int(rows["base"].max()))
            last = max(last, int(rows["at"].max().timestamp() * 1000)) if timed_out else 0
        now = not done and base < confirm_at <= base + seen
        done = done or base + seen >= confirm_at
        state.update((seen, done))
        if timed_out and not done:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(forget_after * 1000) + 1)
        if now:
            yield pd.DataFrame({"atom_id": [key[0]], "encounter_count": [base + seen]})

    zero = F.lit(0).cast("long")
    rows = events.select(
        F.col("atom_id").cast("string").alias("atom_id"), F.col("seen").cast("long").alias("seen"), F.coalesce(F.col("base").cast("long"), zero).alias("base"),
        (F.col(time) if timed_out else F.lit(None)).cast("timestamp").alias("at"),
    )
    rows = rows.mapInArrow(summed, rows.schema)
    return (rows.withWatermark("at", late) if timed_out else rows).groupBy("atom_id").applyInPandasWithState(
        count, "atom_id string, encounter_count long", "seen long, done boolean", "append",
        GroupStateTimeout.EventTimeTimeout if timed_out else GroupStateTimeout.NoTimeout,
    )


def write_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch writer with a folder for each batch, so that a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of written batches: the row of each key from the last batch that holds it."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return last.select(*keys, "_row.*")


def encounter_counts(events: DataFrame) -> DataFrame:
    """Running sightings per term, for update mode; the counts are combined in each task
    before the shuffle."""
    return events.groupBy("atom_id").agg(F.count("*").alias("seen"))


def topic_stream(
    signals: DataFrame, *, time: str = "ts", window: str = "7 days", slide: str = "1 day", late: str = "1 day"
) -> DataFrame:
    """Topic counts per sliding window."""
    return (
        timed(signals, time).withWatermark(time, late)
        .groupBy(F.window(time, window, slide), "topic")
        .agg(F.count("*").alias("mentions"), F.sum("intensity").alias("intensity"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "topic", "mentions", "intensity")
    )


def fresh_items(items: DataFrame, *, time: str = "published_at", late: str = "7 days") -> DataFrame:
    """Feed items not seen before by (source_id, url), with their content hash."""
    return (
        timed(items, time).withWatermark(time, late)
        .dropDuplicatesWithinWatermark(["source_id", "url"])
        .withColumn("content_hash", sha_key("title", "url"))
    )


def feed_stream(
    items: DataFrame, keywords: DataFrame, sources: DataFrame, write: Callable[[DataFrame, int], None], *, time: str = "published_at", late: str = "7 days"
):
    """Query writer that drops repeated items and scores the rest batch by batch."""

    def score(batch: DataFrame, batch_id: int) -> None:
        write(score_feed_items(batch, keywords, sources), batch_id)

    return fresh_items(items, time=time, late=late).writeStream.foreachBatch(score)


def connectivity_stream(
    confirmed: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None],
    failed: Callable[[DataFrame, int], None],
    *,
    retries: int = 1,
):
    """Query writer of the event path: the distinct ids of a batch are processed as
    one set; a batch that fails ``retries`` times more goes to the failure table
    with the error and the stream moves on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("id").distinct()
        for attempt in range(retries + 1):
            try:
                write(process(ids), batch_id)
                return
            except Exception as error:  # noqa: BLE001 - kept with the rows
                if attempt == retries:
                    note = F.lit(str(error)[:500])
                    failed(ids.select("id", note.alias("error"), F.current_timestamp().alias("failed_at")), batch_id)

    return confirmed.writeStream.foreachBatch(run)


def next_sweep(atoms: DataFrame, cursor: str, size: int) -> tuple[DataFrame, str]:
    """The next ``size`` ids after the cursor, and the cursor to go on with.

    A page that finds nothing ends the sweep: it resets the cursor to '', from which the
    next page starts over, and is the moment to ask ``manifests_due``.
    """
    rows = atoms.filter(F.col("id") > cursor).select("id").orderBy("id").limit(size)
    return rows, rows.agg(F.max("id").alias("last")).first()["last"] or ""


class Sweep:
    """A sweep over all terms in pages, whose place is kept in ``folder``.

    A page is written under its number before the cursor moves on, so a run that dies in
    between does the page again and replaces it. A page that cannot be processed is written
    down with its error and passed. The empty page ends the sweep: the cursor starts over,
    and manifests may be built if the last ones are old enough.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def state(self) -> dict:
        """number (of the next page), cursor, built (time of the last manifests or None)."""
        done = parts(self.spark, f"{self.folder}/cursor", "number", finished=True)
        if not done:
            return {"number": 0, "cursor": "", "built": None}
        last = max(done, key=int)
        return json.loads(self.spark.read.text(done[last]).first()[0]) | {"number": int(last)}

    def commit(self, number: int, cursor: str, built: float | None) -> None:
        row = self.spark.createDataFrame([(json.dumps({"cursor": cursor, "built": built}),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.folder}/cursor/number={number}")

    def page(
        self, atoms: DataFrame, process: Callable[[DataFrame], DataFrame], size: int, *, now: float = 0.0, build: Callable[[], None] | None = None
    ) -> bool:
        """One page of ``size`` ids through ``process``; False when it was the empty one."""
        at = self.state()
        ids, cursor = next_sweep(atoms, at["cursor"], size)
        built = at["built"]
        if not cursor:
            if build is not None and manifests_due(built, now):
                build()
                built = now
        else:
            ids = cut_lineage(ids)
            try:
                process(ids).write.mode("overwrite").parquet(f"{self.folder}/out/number={at['number']}")
            except Exception as error:  # noqa: BLE001 - kept with the ids
                note = ids.withColumn("error", F.lit(str(error)[:500]))
                note.write.mode("overwrite").parquet(f"{self.folder}/failed/number={at['number']}")
        self.commit(at["number"] + 1, cursor, built)
        return bool(cursor)


def manifests_due(last_build: float | None, now: float, every_hours: float = 24) -> bool:
    """Whether a finished sweep may build manifests again (times in seconds)."""
    return last_build is None or now - last_build >= every_hours * 3600


def dead_letter_alerts(failures: DataFrame, *, more_than: int = 5, hours: int = 1, late: str = "1 hour") -> DataFrame:
    """A row per queue and window with more than ``more_than`` failures."""
    return (
        timed(failures, "failed_at").withWatermark("failed_at", late)
        .groupBy(F.window("failed_at", f"{int(hours)} hours"), "queue")
        .agg(F.count("*").alias("failures"))
        .filter(F.col("failures") > more_than)
        .select(F.col("window.start").alias("start"), "queue", "failures")
    )


def import_rate_stream(atoms: DataFrame, *, more_than: int = 50, hours: int = 1, late: str = "1 hour") -> DataFrame:
    """A row per source app and window with more than ``more_than`` inserts."""
    return (
        timed(atoms.filter(F.col("source_app").isNotNull()), "created_at")
        .withWatermark("created_at", late)
        .groupBy(F.window("created_at", f"{int(hours)} hours"), "source_app")
        .agg(F.count("*").alias("inserts"))
        .filter(F.col("inserts") > more_than)
        .select(F.col("window.start").alias("start"), "source_app", "inserts")
    )
