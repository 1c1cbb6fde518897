"""Hand-made rows: one per rule and boundary."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.stemming import porter
from lexweave.functions.text import glob_pattern, slugify
from lexweave.operators import bootstrap, chunking, connectivity, curation, edges, joins, lifecycle, predicates, resolve, templates, upserts, vectors
from lexweave.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    "text,reason",
    [
        ("ab", "too_short"), ("x" * 81, "too_long"), ("# x y", "comment"), ("a\nbc", "multiline"), ("a b c d e f g", "too_many_words"),
        (":pp", "emoticon"), (":D", "too_short"), ("123!!", "non_text"), ("stock photo of x", "stock_caption"), ("red bolt", "valid"),
    ],
)
def test_validation(spark, text, reason):
    out = predicates.validate_atoms(spark.createDataFrame([(text,)], "text string"))
    assert out.first()["reason"] == reason


def test_filter_needs_a_criterion():
    with pytest.raises(ValueError):
        predicates.AtomFilter().column()
    predicates.AtomFilter(min_length=0).column()


def test_glob_and_slug(spark):
    import re

    assert re.match(glob_pattern("*[rs]in?*"), "a sing") and not re.match(glob_pattern("a?c"), "abbc")
    df = spark.createDataFrame([("  Crème Brûlée!! 2",)], "t string")
    assert df.select(slugify("t")).first()[0] == "creme-brulee-2"


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"),
     ("happy", "happi"), ("adjustment", "adjust"), ("ring", "ring"), ("controlling", "control"), ("sky", "sky")],
)
def test_porter(word, stem):
    assert porter(word) == stem


def vector_frame(spark, vecs, cats=None):
    data = [(f"v{i:03d}", [float(x) for x in v], (cats or {}).get(i, "c")) for i, v in enumerate(vecs)]
    return spark.createDataFrame(data, "id string, vec array<double>, category_slug string")


@pytest.mark.parametrize("block_rows", [1000, 17])
def test_knn_is_exact_in_any_block_size(spark, block_rows):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8))
    vecs[5] = 0.0
    got = {}
    for r in vectors.knn(vector_frame(spark, vecs), vector_frame(spark, vecs), 4, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"], r["score"]))
    norm = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = np.divide(vecs, norm, out=np.zeros_like(vecs), where=norm > 0)
    sims = np.round(unit @ unit.T, 6)
    for i in range(60):
        best = sorted(range(60), key=lambda j: (-sims[i, j], j))[:4]
        assert [n for _, n, _ in sorted(got[f"v{i:03d}"])] == [f"v{j:03d}" for j in best]


def angle(sim):
    return [sim, math.sqrt(1 - sim * sim)]


@pytest.mark.parametrize("sim,kinds", [(0.65, ["evokes"]), (0.64, []), (0.75, ["resonates"]), (0.92, ["resonates"])])
def test_semantic_edge_thresholds(spark, sim, kinds):
    df = vector_frame(spark, [[1, 0], angle(sim)], {0: "a", 1: "b"})
    assert [r["relationship_type"] for r in edges.semantic_edges(df).collect()] == kinds


def test_same_category_needs_more(spark):
    df = vector_frame(spark, [[1, 0], angle(0.74)])
    assert edges.semantic_edges(df).count() == 0


def test_tag_votes(spark):
    same = [[1, 0.01 * i] for i in range(5)]
    tags = [(f"v{i:03d}", "three") for i in (1, 2, 3)] + [(f"v{i:03d}", "two") for i in (1, 2)] + [("v001", "one")]
    out = connectivity.propagate_tags(vector_frame(spark, same), spark.createDataFrame(tags, "atom_id string, tag_id string"))
    mine = {r["tag_id"]: (r["votes"], r["outcome"]) for r in out.filter("atom_id = 'v000'").collect()}
    assert mine == {"three": (3, "applied"), "two": (2, "ambiguous")}


def test_centroids_need_three_seeds_per_pole(spark):
    df = vector_frame(spark, np.eye(6))
    member = [(f"v{i:03d}", "ok", "low" if i < 3 else "high") for i in range(6)] + [(f"v{i:03d}", "few", "low" if i < 2 else "high") for i in range(6)]
    out = connectivity.centroids(spark.createDataFrame(member, "atom_id string, axis_slug string, pole string"), df)
    assert {r["axis_slug"] for r in out.collect()} == {"ok"}


def test_phrases_take_pairs_first(spark):
    phrases = spark.createDataFrame([(1, "the Red bolt red bolt redness"), (2, "of the"), (3, "zzz")], "phrase_id int, phrase string")
    atoms = spark.createDataFrame(
        [("a", "red bolt", "confirmed"), ("b", "red", "confirmed"), ("c", "bolt red", "confirmed"), ("d", "zzz", "provisional")],
        "id string, text_lower string, status string",
    )
    out = resolve.resolve_phrases(phrases, atoms)
    assert rows(out.filter("phrase_id = 1"), "pos", "match_type", "atom_id") == [
        (0, "exact", "a"), (1, "consumed", None), (2, "exact", "a"), (3, "consumed", None), (4, "prefix", "b"),
    ]
    assert rows(resolve.resolve_stats(out), "state", "phrases") == [("full", 2), ("none", 1)]
    assert resolve.resolved_atoms(out).filter("phrase_id = 1").count() == 2


def test_semantic_pass_fills_what_is_left(spark):
    phrases = spark.createDataFrame([(1, "glowing orb")], "phrase_id int, phrase string")
    atoms = spark.createDataFrame([("a", "radiant", "confirmed")], "id string, text_lower string, status string")
    token_vectors = spark.createDataFrame([("glowing", [1.0, 0.0]), ("orb", [0.0, 1.0])], "token string, vec array<double>")
    index = spark.createDataFrame([("a", [0.9, 0.1]), ("doc_chunk_1", [1.0, 0.0])], "id string, vec array<double>")
    out = resolve.resolve_phrases(phrases, atoms, token_vectors=token_vectors, vectors=index)
    assert rows(out, "token", "match_type", "atom_id") == [("glowing", "semantic", "a"), ("orb", None, None)]


def test_insert_ignore_twice_inserts_nothing(spark):
    new = spark.createDataFrame([("x", None, "2"), ("x", None, "1"), ("y", "c", "3")], "text_lower string, scope string, id string")
    first, counts = upserts.insert_ignore(new.limit(0), new, ["text_lower", "scope"], [F.col("id")])
    assert rows(first, "text_lower", "id") == [("x", "1"), ("y", "3")]
    assert tuple(counts.first()) == (2, 1)
    again, _ = upserts.insert_ignore(first, new, ["text_lower", "scope"], [F.col("id")])
    assert again.count() == 0


def test_merge_leaves_no_self_edge(spark):
    schema = "atom_a_id string, atom_b_id string, relationship_type string, arrangement_scope string, strength double, provenance string"
    e = spark.createDataFrame([("a", "b", "evokes", None, 0.5, "semantic"), ("b", "c", "evokes", "", 0.9, "semantic"), ("a", "c", "evokes", "", 0.1, "harmonic")], schema)
    out = curation.merge_edges(e, spark.createDataFrame([("b", "a")], "merge_id string, canonical_id string"))
    assert rows(out, "atom_a_id", "atom_b_id", "strength", "provenance") == [("a", "c", 0.1, "harmonic")]


def test_running_index_is_dense(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    out = curation.running_index(df, ["g"], "id", "n")
    for group in ("true", "false"):
        want = [i for i in range(1000) if (i % 3 == 0) == (group == "true")]
        assert [r["n"] for r in out.filter(F.col("g") == group).orderBy("id").collect()] == list(range(len(want)))


def test_encounters_confirm_at_three(spark):
    atoms = spark.createDataFrame([("a", "provisional", 2), ("b", "provisional", 1), ("c", "confirmed", 9)], "id string, status string, encounter_count int")
    out = lifecycle.encounter(atoms, spark.createDataFrame([("a",), ("b",)], "atom_id string"))
    assert rows(out, "id", "status", "encounter_count") == [("a", "confirmed", 3), ("b", "provisional", 2), ("c", "confirmed", 9)]


def test_prune_boundary(spark):
    now = datetime.datetime(2024, 6, 1)
    days = lambda n: now - datetime.timedelta(days=n)
    e = spark.createDataFrame(
        [("old", "semantic", 0.49, days(91)), ("edge", "semantic", 0.49, days(90)), ("strong", "semantic", 0.5, days(99)), ("other", "harmonic", 0.1, days(99))],
        "id string, provenance string, strength double, last_reinforced_at timestamp",
    )
    assert rows(lifecycle.prune_edges(e, F.lit(now)), "id") == [("edge",), ("other",), ("strong",)]


def test_provider_wildcards(spark):
    picks = spark.createDataFrame([("a", "x.y")], "atom_id string, category_slug string")
    b = [("p", None, None, "all", None, "info"), ("p", "a", None, "atom", None, "breaking"), ("p", None, "x.y", "cat", "m", "warning"), ("p", "a", "no", "no", None, "info"), ("q", None, None, "no", None, "info")]
    df = spark.createDataFrame(b, "provider string, atom_id string, atom_category string, behavior string, render_mode string, severity string")
    out = joins.provider_warnings(picks, df, "p", "m")
    assert rows(out, "severity_rank", "behavior") == [(0, "atom"), (1, "cat"), (2, "all")]


def test_sections_by_hand(spark):
    para = "A sentence of some words that says a thing. " * 6
    html = f"<title>T</title><p>{para}</p><h2>References</h2><p>{para}</p><h2>Color use</h2><p>{para}</p><h2>Links</h2>" + "<a href='x'>w</a> " * 40
    page = spark.createDataFrame([(1, html)], "page_id int, html string")
    out = chunking.sections(page).select(F.explode("blocks").alias("b")).select("b.heading", "b.hint").collect()
    assert [tuple(r) for r in out] == [("T", None), ("Color use", "color.palette")]


def test_markdown_by_hand(spark):
    body = "Words in a line that is long enough to stay here. " * 5
    text = f"# Title\n{body}\n## Bibliography\n{body}\n## Part\n{body}"
    out = chunking.markdown_blocks(spark.createDataFrame([("Doc", text)], "title string, text string"))
    assert [b["heading"] for b in out.first()["blocks"]] == ["Doc", "Part"]


def test_file_rules(spark):
    names = ["body-heavy.txt", "material_silk.txt", "noun-general.txt", "Cubism.txt", "art_deco.txt", "attire_headwear.txt", "misc.txt"]
    out = bootstrap.classify_files(spark.createDataFrame([(n,) for n in names], "file string"))
    got = {r["file"]: (r["kind"], list(r["tags"]), r["axis"], r["skip_co_membership"]) for r in out.collect()}
    assert got["body-heavy.txt"] == ("axis", [], "body-mass", False)
    assert got["material_silk.txt"] == ("content", ["material-class:silk"], None, False)
    assert got["noun-general.txt"] == ("content", [], None, True)
    assert got["Cubism.txt"][:2] == ("movement", ["movement:cubism"])
    assert got["art_deco.txt"][:2] == ("movement", ["movement:art-deco"])
    assert got["attire_headwear.txt"][1] == ["body-region:head"]
    assert got["misc.txt"][0] == "unmatched"


def test_assembly_cleans_gaps(spark):
    fills = spark.createDataFrame([("1", "a", 1, "red"), ("1", "c", 3, "bolt")], "request_id string, slot_name string, sort_order int, text string")
    requests = spark.createDataFrame([("1", "t")], "request_id string, template string")
    texts = spark.createDataFrame([("t", "{a}, {b}, ({b}, {c}), ")], "template string, template_text string")
    assert templates.assemble_prompts(fills, requests, texts).first()["prompt"] == "red, ( bolt)"


def test_sweep_wraps(spark):
    atoms = spark.createDataFrame([(f"a{i}",) for i in range(5)], "id string")
    first, cursor = streams.next_sweep(atoms, "", 3)
    assert (first.count(), cursor) == (3, "a2")
    short, cursor = streams.next_sweep(atoms, cursor, 3)
    assert (short.count(), cursor) == (2, "a4")
    empty, cursor = streams.next_sweep(atoms, cursor, 3)
    assert (empty.count(), cursor) == (0, "")
    again, _ = streams.next_sweep(atoms, cursor, 3)
    assert again.count() == 3
    assert streams.manifests_due(None, 0) and not streams.manifests_due(0, 3600) and streams.manifests_due(0, 24 * 3600)
