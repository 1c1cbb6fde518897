"""Tables in many files, frequent keys and many copies: whole results without a row per pair."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import sizing
from lexweave.operators import arrangements, audits, connectivity, joins, lifecycle, postings, prompts, resolve, templates, vector_index, vectors
from lexweave.plans import rollups
from lexweave.plans.registry import Inputs
from lexweave.plans.streams import stream_of
from lexweave.sources import folders


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_reads_a_file_or_a_folder(spark, tmp_path, files):
    rows = spark.range(9).repartition(files)
    if files == 1:
        rows.toPandas().to_parquet(tmp_path / "events.parquet")
        rows.toPandas().to_parquet(tmp_path / "part.parquet")
    else:
        rows.write.parquet(str(tmp_path / "events.parquet"))
        rows.write.parquet(str(tmp_path / "part.parquet"))
    sink = stream_of(Inputs(spark, str(tmp_path)), "events").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    sink.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))


def test_concepts_are_looked_for_inside_words(spark):
    """Terms inside words, over blanks, short, empty and in words longer than a window; no join by the document alone."""
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    texts = [
        ("d", 1, "Unre lated"), ("d", 2, "A SCARLET\tbolt\nof x\U0001f600y"), ("d", 3, long), ("d", 4, None), ("d", 5, "  bolts  of steel"),
        ("e", 7, "scar"), ("e", 9, "other"), (None, 1, "scarlet"), ("f", 1, None),
    ]
    terms = ["scar", "carle", "bolt", "bolt\nof", "bolts  of", "s of", "of", "o", "", " ", "\t", "\U0001f600y", long[60:75], long[150:290], "absent", "steel mill", None]
    chunks = spark.createDataFrame([(*t, f"{t[0]}{t[1]}", f"h{t[1]}") for t in texts], "document_id string, chunk_index long, content string, chunk_id string, section_heading string")
    vocabulary = spark.createDataFrame([(d, t, "w") for d in ("d", "e", "f", "none", None) for t in terms], "document_id string, term_lower string, atom_id string")
    got = {(r.document_id, r.term_lower): (r.chunk_id, r.context) for r in resolve.link_concepts(vocabulary, chunks).collect()}
    want = {}
    for d in ("d", "e", "f"):
        own = sorted((i, c) for x, i, c in texts if x == d)
        for t in terms:
            hit = [i for i, c in own if c is not None and t is not None and t in c.lower()]
            want[d, t] = (f"{d}{hit[0]}", f"h{hit[0]}") if hit else (f"{d}{own[0][0]}", "page-level")
    assert got == want
    plan = resolve.link_concepts(vocabulary.where("term_lower = 'scar'"), chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "contains" in line and "gram" not in line]


def test_tokens_are_moved_once(spark):
    """A small vocabulary goes to the tokens; only the order within a phrase moves them."""
    atoms = spark.createDataFrame([("a1", "red bolt", "confirmed"), ("a2", "bolt", "confirmed"), ("a3", "rust", "confirmed")], "id string, text_lower string, status string")
    phrases = spark.createDataFrame([("p", "the Red bolt rusted"), ("q", "of the"), ("r", None)], "phrase_id string, phrase string")
    out = resolve.resolve_phrases(phrases, atoms)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.phrase_id, r.pos, r.match_type, r.atom_id, r.match_key) for r in out.collect()} == {
        ("p", 0, "exact", "a1", "bg:red bolt"), ("p", 1, "consumed", None, None), ("p", 2, "prefix", "a3", "stem:rusted"),
        ("q", None, None, None, None), ("r", None, None, None, None),
    }


def copies(spark, n):
    text = F.element_at(F.array(F.lit("red bolt"), F.lit("red steel bolt"), F.lit("blue nut")), (F.col("id") % 3 + 1).cast("int"))
    atoms = spark.range(n).select(F.format_string("a%05d", "id").alias("id"), text.alias("text"), text.alias("text_lower"), F.lit("confirmed").alias("status"), F.lit("c").alias("collection_slug"))
    word = F.element_at(F.array(F.lit("bolts"), F.lit("red bolts"), F.lit("red bolt"), F.lit("nowhere")), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(F.format_string("t%05d", "id").alias("term_id"), word.alias("term")), atoms


def test_copies_are_compared_once(spark, monkeypatch):
    """Three texts and four terms are compared, however many rows say the same."""
    terms, atoms = copies(spark, 600)
    monkeypatch.setattr(postings, "PART_ROWS", 50)
    met, _, texts = postings.phrase_groups(*postings.lists_for(terms, atoms))
    assert met.count() <= 12 and texts.count() == 400
    found = postings.text_search(terms, atoms)
    assert found.count() == found.distinct().count() == 150 * 400 + 300 * 200
    out = {r.term_id: r for r in resolve.match_vocabulary(terms, atoms).collect()}
    assert len(out) == 600
    assert out["t00000"].outcome == "ambiguous" and out["t00000"].candidates == ["a00000", "a00003", "a00006", "a00009", "a00012"]
    assert out["t00002"].outcome == "exact" and out["t00002"].atom_id == "a00000" and out["t00003"].outcome == "new"


def test_repeated_and_missing_ids_in_a_search(spark):
    terms = spark.createDataFrame([("t", "red bolt"), ("t", "red bolt"), (None, "bolt"), ("u", "bolt"), ("v", "")], "term_id string, term string")
    atoms = spark.createDataFrame([("a", "red", "c"), ("a", "my bolt", "c"), ("b", "red bolt", "c"), ("b", "red bolt", "c"), (None, "bolt", "c"), ("x", "bolt", "rejected"), ("y", None, "c")], "id string, text string, status string")
    got = sorted((r.term_id, r.atom_id or "") for r in postings.text_search(terms, atoms).collect())
    assert got == [("t", "a"), ("t", "b"), ("u", ""), ("u", "a"), ("u", "b")]


def test_siblings_without_a_row_per_pair_moved(spark, monkeypatch):
    monkeypatch.setattr(audits, "PACK_ROWS", 3)
    monkeypatch.setattr(audits, "PART_ROWS", 4)
    edges = spark.createDataFrame([("a1", "a2"), ("a1", "a9"), ("a3", "a5")], "atom_a_id string, atom_b_id string")
    own = [(f"a{i}", "even" if i % 2 == 0 else "odd") for i in range(1, 14)] + [("a4", "even"), ("a6", "odd"), ("a0", None), (None, "odd")]
    start = [f"a{i}" for i in range(0, 10)] + ["a3", "none", None]
    siblings = spark.createDataFrame(own, "id string, category_slug string")
    out = audits.neighbourhood(edges, spark.createDataFrame([(s,) for s in start], "id string"), 1, siblings)
    near = {("a1", "a2"), ("a2", "a1"), ("a1", "a9"), ("a9", "a1"), ("a3", "a5"), ("a5", "a3")}
    want = [(s, x) for s in start if s for i, c in own if i == s and c for x, d in own if d == c and x != s and (s, x) not in near]
    text = lambda pairs: sorted((s, x or "") for s, x in pairs)
    assert text((r.start_id, r.id) for r in out.where("hops IS NULL").collect()) == text(want)
    assert {(r.start_id, r.id) for r in out.where("hops = 1").collect()} == near


def test_short_tables_are_dealt_over_the_tasks(spark):
    """Picks and terms in one file are worked on by all cores; the same behaviour twice warns twice."""
    picks = spark.range(40).coalesce(1).select(F.format_string("a%d", "id").alias("atom_id"), F.lit("c").alias("category_slug"))
    rules = [("p", None, None, "slow", None, "warning")] * 2 + [("p", None, None, "odd", "m", "breaking"), ("q", None, None, "no", None, "info")]
    out = joins.provider_warnings(picks, spark.createDataFrame(rules, "provider string, atom_id string, atom_category string, behavior string, render_mode string, severity string"), "p", "m")
    assert sorted((r.behavior, r["count"]) for r in out.groupBy("behavior").count().collect()) == [("odd", 40), ("slow", 80)]
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString()
    words = [F.lit("neutral").alias(d) for d in arrangements.DIMENSIONS]
    terms = picks.select(F.col("atom_id").alias("id"), F.array(F.lit("t")).alias("tags"), *words)
    tagged = arrangements.legacy_similarity_tags(terms, spark.range(2).select(F.format_string("s%d", "id").alias("slug"), *words))
    assert "RoundRobinPartitioning" in tagged._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.tags) for r in tagged.collect()} == {("t", "s0", "s1")}


def test_cells_are_written_in_small_batches(spark):
    """A row that goes to many cells is copied for each, so few rows go at a time."""
    centroids = np.eye(512)
    rows = spark.range(600).coalesce(1).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: ((i + F.col("id")) % 7).cast("double")).alias("vec"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    found = vector_index._in_cells(rows, centroids, 400)
    assert found.count() == 600 * 400 and found.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 64 << 20


def test_a_category_is_not_met_by_the_others(spark):
    """Neighbours within 40 categories: far fewer pairs are multiplied than the square of the table, the same rows found."""
    rng = np.random.default_rng(5)
    rows = [(f"v{i:04}", [float(x) for x in rng.integers(-9, 9, 6)], f"c{i % 40}" if i % 7 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, vec array<float>, part string")
    got = {(r.query_id, r.rank): (r.neighbour_id, r.score) for r in vectors.knn(df, df, 3, part_col="part", min_sim=0.2, block_rows=50).collect()}
    mats = {p: [(i, np.array(v)) for i, v, q in rows if q == p] for p in {r[2] for r in rows} - {None}}
    want = {}
    for own in mats.values():
        for i, v in own:
            near = sorted((-round(float(v @ w / np.sqrt(v @ v * (w @ w))), 6), j) for j, w in own)
            want.update({(i, n + 1): (j, -s) for n, (s, j) in enumerate(near[:3]) if -s >= 0.2})
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    part = F.col("part")
    _, sizes = vectors._bucket_blocks(df.where(part.isNotNull()), df.where(part.isNotNull()), part, 50)
    copies = sum(r._q_blocks * r._b_blocks for r in sizes.collect())
    assert copies * 50 * 50 < 1200 * 1200 / 4


def test_block_products_hold_no_text_per_pair():
    """A block of 4000 x 4000 keeps 50 hits a row in under 40 MB beyond its inputs, where the texts of Python took 64."""
    import tracemalloc

    rng = np.random.default_rng(7)
    ids = pa.array([f"atom-{i:08}" for i in range(4000)])
    vec = pa.array(list(rng.normal(size=(4000, 16)).astype(np.float32)), pa.list_(pa.float32()))
    table = pa.table({"id": ids, "vec": vec, "part": pa.array([""] * 4000)})
    run = vectors._block_topk(50, None, False)
    tracemalloc.start()
    out = run(table, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 200_000 and peak < 40 << 20


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "WRITE_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") < 950, "big").when(F.col("id") < 990, "small").alias("kind"), F.create_map(F.lit("k"), "id").alias("m"))
    folder = str(tmp_path / "parts")
    for _ in range(2):
        folders.upsert_parts(rows, folder, "kind", lambda old, new: old.unionByName(new).groupBy("n", "kind").agg(F.first("m").alias("m")))
        held = spark.read.parquet(folder).select("n", F.input_file_name().alias("f"), "kind")
        assert held.count() == 1000
        most = held.groupBy("f").count().agg(F.max("count")).first()[0]
        assert most <= 250, most


def test_shared_passes_are_worked_out_once(spark):
    """The terms of an audit and the neighbours of a pass are read by many steps, but made once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    terms = spark.createDataFrame([(t, "core", 3) for t in ("red bolt", "bolt", "rust")], "term string, term_type string, images int").withColumn("term", counted("term"))
    atoms = spark.createDataFrame([("a1", "red bolt", "red bolt", "confirmed", "style.genre")], "id string, text string, text_lower string, status string, category_slug string")
    out = prompts.audit_terms(terms, atoms).collect()
    assert {(r.term, r.status, r.via) for r in out} == {("red bolt", "found", "exact"), ("bolt", "found", "search"), ("rust", "missing", None)}
    assert seen.value == 3


def test_no_slot_of_exemplars_lies_in_one_task(spark):
    """A fill without a window over all exemplars of a slot; pairs are kept once and read from both ends."""
    E = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = E([("a", "b", "evokes", 0.5), ("b", "a", "resonates", 0.25), ("c", "c", "evokes", 0.5), ("a", None, "evokes", 1.0), ("a", "d", "opposes", 9.0)], "atom_a_id string, atom_b_id string, relationship_type string, strength double")
    pairs = templates.pair_resonance(edges)
    assert sorted((r.one, r.other or "", r.resonance) for r in pairs.collect()) == [("a", "", 1.0), ("a", "b", 0.75), ("c", "c", 1.0)]
    chosen = E([("a",), ("c",)], "chosen_id string")
    assert sorted((r.atom_id or "", r.chosen_id, r.resonance) for r in templates.from_both_ends(pairs, chosen).collect()) == [("", "a", 1.0), ("b", "a", 0.75), ("c", "c", 1.0)]
    relations = E([("a", "b", "compositional", 1.0, 0.5, None), ("b", "a", "compositional", 1.0, 0.75, None), ("a", "b", "compositional", 1.0, 0.25, "x")], "source_atom_id string, target_atom_id string, relation_type string, strength double, confidence double, context string")
    assert sorted(tuple(r) for r in templates.pair_affinity(relations).collect()) == [("a", "b", "", 0.75), ("a", "b", "x", 0.25)]
    dims = ", ".join(f"{d} double" for d in templates.PROFILE)
    pools = E([("a", "c", "visual", 1, *[0.5] * len(templates.PROFILE)), ("b", "c", "visual", 2, *[0.5] * len(templates.PROFILE))], f"atom_id string, category_slug string, pool string, tier int, {dims}")
    shares = E([("t", "s", "a", 1.0), ("u", "s", "a", 0.5)], "template string, slot_name string, atom_id string, exemplar_score double")
    facts = templates.pool_facts(pools, shares, E([("b", "p"), ("b", "q")], "atom_id string, context string"))
    keys = E([("u", "s", "c", "visual", "p", None, False), ("t", "s", "c", "visual", None, "q", False), ("t", "z", "c", "visual", None, None, False)], "template string, slot_name string, category_filter string, pool string, arrangement string, mode_context string, has_intent boolean")
    got = templates.fixed_scores(keys, facts, E([], f"slug string, {dims}"), by=["category_filter", "pool"])
    assert sorted((r.template, r.slot_name, r.atom_id, round(r.fixed, 6), r.bad) for r in got.collect()) == [
        ("t", "s", "a", 0.7, False), ("t", "s", "b", 0.12, True), ("t", "z", "a", 0.2, False), ("t", "z", "b", 0.12, False), ("u", "s", "a", 0.45, False), ("u", "s", "b", 0.12, True),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) <= 4


def test_segments_are_typed_once(spark):
    """No filter types the segments a second time; texts of every quality pattern keep their type."""
    marked = ["uhd", "32k", "8K", "4k", "hdr", "high detail", "ultra detailed", "photorealistic", "uhd image", "12k uhd", "6k resolution", "800x600", "hyperrealistic", "ultra hd"]
    rows = [(f"p{i}", i, f"red bolt, {m} scene, IN THE STYLE OF Someone, in the style") for i, m in enumerate(marked)] + [("q", 99, "plain, 8kg, box"), ("n", 100, None)]
    out = prompts.extract_terms(spark.createDataFrame(rows, "prompt_id string, image_id int, prompt string"))
    assert "size(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(f"p{i}", f"{m.lower()} scene", "quality_booster") for i, m in enumerate(marked)} | {(f"p{i}", "someone", "artist") for i in range(len(marked))}
    assert {(r.prompt_id, r.term, r.term_type) for r in out.collect()} == want


def test_neighbours_of_a_pass_are_found_once(spark):
    """Applied and ambiguous tags, and the number of neighbours, come from one search; only that for edges is left in the plan."""
    rows = spark.createDataFrame([(f"v{i}", [1.0, i / 10]) for i in range(8)], "id string, vec array<float>")
    tags = spark.createDataFrame([(f"v{i}", "t") for i in range(5)], "atom_id string, tag_id string")
    poles = spark.createDataFrame([(f"v{i}", "x", "low" if i < 4 else "high") for i in range(8)], "atom_id string, axis_slug string, pole string")
    edges = spark.createDataFrame([], "atom_a_id string, atom_b_id string, relationship_type string, arrangement_scope string, provenance string")
    out = connectivity.connectivity_pass(rows.select("id"), rows, tags, poles, edges)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("CoGroups") == 1
    got = {r.counter: r.n for r in out.collect()}
    assert got["atoms_processed"] == 8 and got["tags_applied"] == 3 and got["edges_created"] == 28


def most_in_a_task(df):
    """Rows of the fullest partition and of all."""
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return max(sizes), sum(sizes)


def test_creators_of_many_films(spark, tmp_path, monkeypatch):
    """The tasks that hold the people of films grow in number with the lines; names count once for a creator."""
    monkeypatch.setattr(sizing, "TASK_ROWS", 50)
    spark.range(2000).select((F.col("id") % 500).alias("l_orderkey"), (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 2 + 1).cast("int").alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = rollups.creators(Inputs(spark, str(tmp_path)))
    want = {(f"Supplier {s}", r): len({i % 500 for i in range(2000) if i % 7 == s and (i % 2 == 0) == (r == "director")}) for s in range(7) for r in ("director", "cast")}
    assert {(r.name, r.role): r.films for r in out.collect()} == want
    assert "hashpartitioning(l_orderkey" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan
    people, links = lifecycle.creators(spark.createDataFrame([(1, [(" Bo", "cast"), ("bo", "cast"), ("", "cast")]), (1, [("BO ", "cast")])], "film_id int, people array<struct<name:string,role:string>>"))
    assert [(r.name, r.role) for r in people.collect()] == [("BO", "cast")] and links.count() == 1


def test_names_that_are_missing_are_dealt_evenly(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 10, F.concat(F.lit("N"), "id")).alias("source_name"), F.when(F.col("id") == 3, "n4").alias("target_name"))
    atoms = spark.createDataFrame([("a4", "n4"), ("b4", "n4"), ("a3", "n3"), ("x", None), ("z", "\0")], "id string, text_lower string")
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.resolve_edge_names(rows, atoms, tasks=20)
        most, n = most_in_a_task(out)
        found = {r.id: (r.source_id, r.target_id, r.resolution) for r in out.where("resolution <> 'both_unknown'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)
    assert n == 4000 and most < 500
    assert found == {3: ("a3", "a4", "resolved"), 4: ("a4", None, "target_unknown")}


def moved_rows(plan) -> int:
    """Rows written to the shuffles of an executed plan."""
    name = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    if inner is not None:
        return moved_rows(inner)
    own = plan.metrics().get("shuffleRecordsWritten")
    children = plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(moved_rows(children.apply(i)) for i in range(children.size()))


def test_tokens_away_from_pairs_are_not_moved(spark):
    known = ["ka kb", "kb kc", "kc kd", "x", "x y", "bolt"]
    atoms = spark.createDataFrame([(f"i {k}", k, "confirmed") for k in known], "id string, text_lower string, status string")
    rng = random.Random(9)
    texts = ["a b c d a b", "b c d", "a b a b", "", "the, of", "x Y x", "bolting bolt", None, "a, b; c (d)\n\tb c"]
    texts += [" ".join(rng.choice(["ka", "kb", "kc", "kd", "x", "y", "bolted"]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += [" ".join(["plain"] * 200 + ["x", "y"])] * 20

    def resolved(text):
        words = [w for w in re.split(r"[^\w'-]+", (text or "").lower()) if w and w not in resolve.STOP_WORDS]
        out, inside = [], False
        for i, w in enumerate(words):
            pair = " ".join(words[i : i + 2])
            take = not inside and i + 1 < len(words) and pair in known
            stem = next((w[: -len(s)] for s in resolve.STEM_SUFFIXES if w.endswith(s) and w[: -len(s)] in known and len(w) - len(s) > 2), None)
            hit = f"i {pair}" if take else None if inside else f"i {w}" if w in known else f"i {stem}" if stem else None
            out.append((i, w, "consumed" if inside else None if hit is None else "exact" if take or w in known else "prefix", hit))
            inside = take
        return out or [(None, None, None, None)]

    rows = [(f"p{i}", t) for i, t in enumerate(texts)]
    out = resolve.resolve_phrases(spark.createDataFrame(rows, "phrase_id string, phrase string"), atoms).select("phrase_id", "pos", "token", "match_type", "atom_id")
    got = out.collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(key((p, *r)) for p, t in rows for r in resolved(t))
    assert moved_rows(out._jdf.queryExecution().executedPlan()) < 600 < len(got)
    # the rows of one id are looked at together, in the order of their words
    twice = spark.createDataFrame([("p", "x y z")] * 2 + [(None, "x y"), (None, "z x y")], "phrase_id string, phrase string")
    got = resolve.resolve_phrases(twice, atoms).where("phrase_id = 'p'")
    assert sorted((r.pos, r.match_type or "") for r in got.collect()) == [(0, "exact"), (0, "exact"), (1, ""), (1, "consumed"), (2, ""), (2, "")]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_base_is_sent_in_pieces(spark, monkeypatch, kind):
    """Queries are not moved to meet a base that can be sent; ids that stand twice and ties as of ``knn``."""
    rng = np.random.default_rng(3)
    rows = [(f"v{i % 90:03}", [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(100)]
    df = spark.createDataFrame(rows, f"id string, vec array<{kind}>")
    monkeypatch.setattr(vectors, "SENT_BYTES", 400)
    found = vectors.knn_sent(df, df, 3, min_sim=0.1, base_filter=F.col("id") != "v005")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and plan.count("MapInArrow") >= 2
    want = vectors.knn(df, df, 3, min_sim=0.1, base_filter=F.col("id") != "v005")
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in want.collect())
    assert vectors.knn_sent(df, df.limit(0), 3).count() == 0
