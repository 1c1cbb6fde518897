"""No cap, block size or batch border changes a result."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions.sizing import attach_packed
from lexweave.operators import bootstrap, joins, lifecycle, model_rows, predicates, resolve, templates, vectors
from lexweave.sources import payloads
from lexweave.streaming import streams


def test_tree_of_any_depth_and_cycles(spark):
    rows = [(f"s{i:02d}", f"s{i - 1:02d}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "x")]
    collections = spark.createDataFrame(rows, "slug string, parent_slug string")
    tree = lifecycle.collection_tree(collections)
    assert tree.count() == 40 and tree.agg(F.max("depth")).first()[0] == 39
    assert {r.slug for r in lifecycle.collection_cycles(collections, tree).collect()} == {"x", "y", "z"}


def test_pages_of_any_size(spark):
    atoms = spark.range(700).select(
        F.format_string("a%04d", "id").alias("id"), F.lit("provisional").alias("status"), F.lit(1).alias("encounter_count"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("x").alias("text_lower"),
    )
    assert predicates.list_atoms(atoms, limit=650)[0].count() == 650
    assert predicates.review_queue(atoms, limit=650).count() == 650


def test_every_entry_of_a_feed(spark):
    one = "<entry><id>t3_{0}</id><title>t</title><content>c</content><published>2024-01-01T00:00:00Z</published></entry>"
    feeds = [("a", "<feed>" + "".join(one.format(i) for i in range(2000)) + "</feed>"), ("b", "<feed></feed>"), ("c", "")]
    out = payloads.parse_post_feed(spark.createDataFrame(feeds, "subreddit string, xml string"))
    assert out.count() == 2000 and out.select("id").distinct().count() == 2000


def test_all_hits_count_for_the_outcome(spark):
    atoms = spark.createDataFrame([(f"a{i}", f"red bolt {'x' * i}", f"red bolt {'x' * i}", "confirmed", "c") for i in range(1, 9)], "id string, text string, text_lower string, status string, collection_slug string")
    concepts = spark.createDataFrame([("t", "red bolt")], "term_id string, term string")
    few = resolve.match_vocabulary(concepts, atoms).first()
    assert few.outcome == "ambiguous" and few.candidates == ["a1", "a2", "a3", "a4", "a5"]
    assert len(resolve.match_vocabulary(concepts, atoms, max_candidates=None).first().candidates) == 8


def test_whole_pools_and_all_slots(spark):
    profile = {d: F.lit(0.5) for d in templates.PROFILE}
    atoms = spark.range(450).select(
        F.format_string("a%03d", "id").alias("id"), F.format_string("text %d", "id").alias("text"), F.lit("confirmed").alias("status"),
        F.lit("c").alias("category_slug"), F.lit("visual").alias("modality"), F.lit(1).alias("tier"), *[v.alias(k) for k, v in profile.items()],
    )
    assert templates.candidate_pools(atoms).count() == 450
    slots = spark.createDataFrame([("t", f"s{i}", "c", True, i) for i in range(5)], "template string, slot_name string, category_filter string, required boolean, sort_order int")
    requests = spark.createDataFrame([("r", "t", None, "visual", None, False)], "request_id string, template string, arrangement string, modality string, render_mode string, has_intent boolean")
    exemplars = spark.createDataFrame([("t", f"s{i}", "a449", 5) for i in range(5)], "template string, slot_name string, atom_id string, frequency int")
    empty = lambda schema: spark.createDataFrame([], schema)
    fills = templates.fill_slots(
        requests, slots, empty("request_id string, slot_name string, atom_id string"), atoms, exemplars,
        empty("slug string, context_key string, " + ", ".join(f"{d} double" for d in templates.PROFILE)), empty("slug string, category_slug string, weight double"),
        empty("context string, category_slug string, context_mode string, guidance string"),
        empty("atom_a_id string, atom_b_id string, relationship_type string, strength double"),
        empty("source_atom_id string, target_atom_id string, relation_type string, strength double, confidence double, context string"),
        empty("request_id string, atom_id string, intent_score double"),
    )
    got = fills.collect()
    assert len(got) == 5 and len({r.atom_id for r in got}) == 5
    # the exemplar is the last of the pool by id, and is offered all the same
    assert "a449" in {r.atom_id for r in got} | {a.atom_id for r in got for a in r.alternatives}


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_neighbours_do_not_depend_on_blocks(spark, block_rows, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 10)
    rows = [(f"v{i}", [float((i * 7) % 11) + 1, float((i * 5) % 13) - 3, float(i % 3)], "p" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, vec array<double>, part string")
    want = vectors.knn(df, df, 4, block_rows=10_000).collect()
    assert sorted(vectors.knn(df, df, 4, block_rows=block_rows).collect()) == sorted(want)
    parted = vectors.knn(df, df, 3, part_col="part", block_rows=block_rows).collect()
    lonely = {r[0] for r in rows if r[2] is None}
    assert parted and not {r.query_id for r in parted} & lonely and not {r.neighbour_id for r in parted} & lonely


def test_packed_chunks_hold_the_same_pairs(spark):
    large = spark.range(50).select(F.col("id").alias("n"))
    small = spark.range(23).select(F.col("id").alias("m"), (F.col("id") % 4).alias("k"))
    pairs = []
    for chunk_rows in (2_000, 7):
        joined, single = attach_packed(large, small, "w", chunk_rows=chunk_rows, salts=4)
        assert single == (chunk_rows == 2_000)
        pairs.append(sorted(tuple(r) for r in joined.select("n", F.explode("w").alias("w")).select("n", "w.m", "w.k").collect()))
    assert pairs[0] == pairs[1] and len(pairs[0]) == 50 * 23


def test_batches_are_upserted_and_can_run_again(spark, tmp_path):
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 5)], [("c", 7)]]):
        spark.createDataFrame(rows, "k string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = spark.readStream.schema("k string, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    totals = streams.encounter_stream(events.select(F.col("k").alias("atom_id"), F.col("n").alias("seen"), F.lit(0).alias("base")), confirm_at=3)
    write = streams.write_batches(f"{tmp_path}/out")
    totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = lambda: sorted(tuple(r) for r in streams.latest(spark.read.parquet(f"{tmp_path}/out"), ["atom_id"]).collect())
    assert out() == [("a", 6), ("c", 7)]
    write(spark.createDataFrame([("c", 7)], "atom_id string, encounter_count long"), 2)
    assert out() == [("a", 6), ("c", 7)]


def test_cuts_are_parameters(spark):
    import json

    topics = [{"topic": "t" * 150, "pain_points": list("abcdefgh")} for _ in range(12)]
    raw = spark.createDataFrame([("s", "r", json.dumps({"topics": topics}))], "scan_id string, subreddit string, raw string").withColumn("scan_date", F.lit("2024-01-01").cast("date"))
    cut, whole = model_rows.validate_signals(raw).collect(), model_rows.validate_signals(raw, max_topics=None, max_topic_chars=None, max_pains=None).collect()
    assert (len(cut), len(cut[0].topic), len(cut[0].pain_points)) == (10, 100, 5)
    assert (len(whole), len(whole[0].topic), len(whole[0].pain_points)) == (12, 150, 8)
    feed = spark.createDataFrame([("s", f"<rss><item><title>t</title><link>u</link><description>{'d' * 3000}</description></item></rss>")], "source_id string, xml string")
    assert [len(payloads.parse_feed_payloads(feed, n).first().description) for n in (1000, None)] == [1000, 3000]
    reviews = spark.createDataFrame([(f"r{i}", "x" * 3000, "k", None) for i in range(8)], "review_id string, text string, key_one string, key_two string")
    sources = spark.createDataFrame([("s", "k", None)], "source_id string, key_one string, key_two string")
    assert joins.match_reviews(reviews, sources).count() == 5
    all_of_them = joins.match_reviews(reviews, sources, per_source=None, max_chars=None)
    assert all_of_them.count() == 8 and len(all_of_them.first().text) == 3000
    terms = spark.createDataFrame([("f", f"a{i}") for i in range(101)] + [("g", "a1")], "file string, atom_id string")
    assert [tuple(r) for r in bootstrap.oversized_files(terms).collect()] == [("f", 101)]
