"""Streaming operators on the test tables: each runs over all files with
``availableNow`` and the query returns the finished sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.edges import edge_degree
from lexweave.plans.graph import PASS, counted
from lexweave.plans.ingest import HITS, feed_keywords
from lexweave.plans.registry import Inputs, query
from lexweave.session import checkpoint_dir, cut_lineage
from lexweave.streaming import streams as st


def stream_of(t: Inputs, table: str) -> DataFrame:
    """The parquet file of a table, or the files of its folder, as a stream."""
    whole = t.table(table)
    stream = t.spark.readStream.schema(whole.schema)
    # a stream reads folders only: that of the table, or the one its file lies in
    if any(path.endswith(f"/{table}.parquet") for path in whole.inputFiles()):
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)
    return stream.parquet(f"{t.sf_dir}/{table}.parquet")


def finished(t: Inputs, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything there is into parquet, and read that back.

    With ``keys`` in update mode, upserted by them; else in append mode.
    """
    base = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    if keys is None:
        sink = df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
    else:
        sink = df.writeStream.outputMode("update").foreachBatch(st.write_batches(f"{base}/out"))
    sink.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{base}/out")
    return rows if keys is None else st.latest(rows, keys)


@query("encounter_stream", "Z1 L1", """
    SELECT 'a' || user_id AS atom_id, count(*) AS encounter_count FROM events GROUP BY 1 HAVING count(*) >= 60""")
def encounter_stream(t: Inputs):
    seen = stream_of(t, "events").select(F.concat(F.lit("a"), "user_id").alias("atom_id"), F.lit(1).alias("seen"), F.lit(0).alias("base"))
    return finished(t, st.encounter_stream(seen, confirm_at=60), ["atom_id"])


@query("encounter_counts_stream", "Z1", "SELECT 'a' || user_id AS atom_id, count(*) AS seen FROM events GROUP BY 1")
def encounter_counts_stream(t: Inputs):
    return finished(t, st.encounter_counts(stream_of(t, "events").select(F.concat(F.lit("a"), "user_id").alias("atom_id"))), ["atom_id"])


@query("confirmed_once_stream", "Z1 L1", """
    SELECT 'a' || user_id AS atom_id, 1::BIGINT AS times, count(*) >= 60 AS confirmed FROM events GROUP BY 1 HAVING count(*) >= 60""")
def confirmed_once_stream(t: Inputs):
    """Many small batches, a stop in the middle and a restart: how often each term came out."""
    base = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    rows = t.events.select("event_id", F.concat(F.lit("a"), "user_id").alias("atom_id"), F.lit(1).alias("seen"), F.lit(0).alias("base"))
    for half in (0, 1):
        rows.filter(F.col("event_id") % 2 == half).drop("event_id").repartition(3).write.mode("append").parquet(f"{base}/in")
        source = t.spark.readStream.schema("atom_id string, seen int, base int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        sink = st.confirmed_once(source, confirm_at=60).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        sink.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.schema("atom_id string, encounter_count long").parquet(f"{base}/out")
    return out.groupBy("atom_id").agg(F.count("*").alias("times"), (F.min("encounter_count") >= 60).alias("confirmed"))


@query("topic_stream", "Z2", """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS start, event_type AS topic, count(*) AS mentions
    FROM events, generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-10', INTERVAL 1 DAY) g(d)
    WHERE ts >= d AND ts < d + INTERVAL 7 DAY GROUP BY 1, 2""")
def topic_stream(t: Inputs):
    rows = stream_of(t, "events").select("ts", F.col("event_type").alias("topic"), (F.col("value") / 500).alias("intensity"))
    out = finished(t, st.topic_stream(rows), ["start", "end", "topic"])
    # windows of seven days start on epoch-aligned days, as the check does
    return out.select(F.to_date("start").cast("string").alias("start"), "topic", "mentions")


@query("feed_stream", "Z3 U9", """
    SELECT 'u' || user_id AS source_id, event_type AS url, sha256(event_type || '|' || event_type) AS content_hash FROM events GROUP BY user_id, event_type""")
def feed_stream(t: Inputs):
    items = stream_of(t, "events").select(
        F.concat(F.lit("u"), "user_id").alias("source_id"), F.col("event_type").alias("url"), F.col("event_type").alias("title"), F.col("ts").alias("published_at")
    )
    out = finished(t, st.fresh_items(items, late="60 days"))
    return out.select("source_id", "url", "content_hash")


@query("feed_scores_stream", "Z3 Q12", f"""
    WITH {HITS},
    w AS (SELECT item_id, sum(CASE WHEN length(keyword) > 10 THEN 2 ELSE 1 END) AS w, count(*) AS matches FROM hits GROUP BY 1),
    s AS (SELECT i.item_id, i.source_id, coalesce(matches, 0) AS matches, tier, round(CASE WHEN w IS NULL THEN 0 ELSE least((0.1 + least(w / 10, 1.0) * 0.8) * weight, 1.0) END::DOUBLE, 6) AS score
      FROM v_feed_items i LEFT JOIN w USING (item_id) JOIN v_feed_sources f ON f.source_id = i.source_id WHERE starts_with(url, 'u'))
    SELECT item_id, source_id, matches, score, CASE WHEN score >= CASE tier WHEN 'core' THEN 0.3 WHEN 'adjacent' THEN 0.5 ELSE 0.7 END THEN 'pending' ELSE 'no_terms' END AS status FROM s""")
def feed_scores_stream(t: Inputs):
    """Fresh items of a stream, scored batch by batch."""
    base = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    items = stream_of(t, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), F.concat(F.lit("u"), "doc_id").alias("url"),
        "text", F.col("lang").alias("title"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("published_at"),
    )
    sources = t.v_feed_sources.withColumn("weight", F.col("weight").cast("double"))
    run = st.feed_stream(items, feed_keywords(t), sources, st.write_batches(f"{base}/out"), late="60 days")
    run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = st.latest(t.spark.read.parquet(f"{base}/out"), ["item_id"])
    return out.select("item_id", "source_id", "matches", "score", "status")


@query("connectivity_stream", "Z4", """
    SELECT 'a' || user_id AS id FROM events GROUP BY 1""")
def connectivity_stream(t: Inputs):
    base = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    ids = stream_of(t, "events").select(F.concat(F.lit("a"), "user_id").alias("id"))
    run = st.connectivity_stream(ids, lambda batch: batch, st.write_batches(f"{base}/out"), st.write_batches(f"{base}/failed"))
    run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("id").distinct()


@query("connectivity_pass_stream", "Z4 V6", PASS.replace("FROM v_atoms a LEFT JOIN deg", "FROM (SELECT DISTINCT 'a' || user_id AS id FROM events) a LEFT JOIN deg"))
def connectivity_pass_stream(t: Inputs):
    """The event path: each batch of confirmed terms goes through the connectivity pass."""
    base = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    ids = stream_of(t, "events").select(F.concat(F.lit("a"), "user_id").alias("id"))
    run = st.connectivity_stream(ids, lambda batch: counted(t, batch), st.write_batches(f"{base}/out"), st.write_batches(f"{base}/failed"))
    run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("counter").agg(F.sum("n").alias("n"))


@query("sweep", "Z5", "SELECT id FROM v_atoms WHERE id > 'a5' ORDER BY id LIMIT 50")
def sweep(t: Inputs):
    return st.next_sweep(t.v_atoms, "a5", 50)[0]


@query("sweep_all", "Z5", """
    SELECT id, degree, 1::BIGINT AS times FROM v_atoms LEFT JOIN (
      SELECT id, count(*) AS degree FROM (SELECT atom_a_id AS id FROM v_edges UNION ALL SELECT atom_b_id FROM v_edges) GROUP BY 1) USING (id)""")
def sweep_all(t: Inputs):
    """The whole table in pages, each page's edge counts written under its number, with a restart between the pages."""
    folder = f"{checkpoint_dir(t.spark)}/sweeps/{uuid.uuid4().hex}"
    atoms, degree = cut_lineage(t.v_atoms.select("id")), cut_lineage(edge_degree(t.v_edges, None))
    size = max(1, -(-atoms.count() // 4))
    while st.Sweep(t.spark, folder).page(atoms, lambda ids: ids.join(degree, "id", "left"), size):
        pass
    out = t.spark.read.schema("id string, degree long").parquet(f"{folder}/out")
    return out.groupBy("id").agg(F.max("degree").alias("degree"), F.count("*").alias("times"))


@query("dead_letter_alerts", "Z6", """
    SELECT CAST(date_trunc('hour', failed_at) AS VARCHAR) AS start, queue, count(*) AS failures FROM v_failures GROUP BY 1, 2 HAVING count(*) > 3""")
def dead_letter_alerts(t: Inputs):
    rows = stream_of(t, "events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("queue-"), F.col("user_id") % 5).alias("queue"), F.col("ts").alias("failed_at")
    )
    out = finished(t, st.dead_letter_alerts(rows, more_than=3), ["start", "queue"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "queue", "failures")


@query("import_rate_stream", "Z7", """
    SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type AS source_app, count(*) AS inserts FROM events GROUP BY 1, 2 HAVING count(*) > 6""")
def import_rate_stream(t: Inputs):
    rows = stream_of(t, "events").select(F.col("event_type").alias("source_app"), F.col("ts").alias("created_at"))
    out = finished(t, st.import_rate_stream(rows, more_than=6), ["start", "source_app"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "source_app", "inserts")
