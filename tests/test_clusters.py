"""Components of chains, hubs and cliques, and clusters of names."""

import random

from lexweave.operators import audits
from lexweave.operators.audits import neighbourhood
from lexweave.operators.clusters import least_label, name_clusters
from lexweave.operators.curation import bucket_concepts


def test_chains_hubs_and_pieces(spark):
    rng = random.Random(3)
    chain = [f"c{i:03d}" for i in range(150)]
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [("hub", f"h{i:04d}") for i in range(1500)] + [("x", "y"), ("y", "x"), ("z", "z"), ("x", "y")]
    got = {r.node: r.root for r in least_label(spark.createDataFrame(edges, "u string, v string").repartition(5)).collect()}
    assert {got[c] for c in chain} == {"c000"} and {got[f"h{i:04d}"] for i in range(1500)} == {"h0000"} and got["hub"] == "h0000"
    assert got["x"] == got["y"] == "x" and "z" not in got and len(got) == 150 + 1501 + 2
    assert least_label(spark.createDataFrame([], "u string, v string")).count() == 0


def test_clustered_names_count_as_one(spark):
    vectors = spark.createDataFrame([("red", [1.0, 0.0]), ("scarlet", [0.99, 0.1]), ("crimson", [0.97, 0.2]), ("blue", [0.0, 1.0])], "id string, vec array<double>")
    clusters = name_clusters(vectors, min_sim=0.9, k=3)
    assert {tuple(r) for r in clusters.collect()} == {(n, "crimson") for n in ("red", "scarlet", "crimson")}
    said = [("m", "s1", "Red", 0.5), ("m", "s2", "scarlet ", 0.7), ("m", "s3", "CRIMSON", 0.9), ("m", "s3", "blue", 0.5)]
    rows = spark.createDataFrame(said, "moodboard_id string, source_url string, atom_name string, confidence double")
    got = {r.atom_name: (r.frequency, r.bucket) for r in bucket_concepts(rows, clusters=clusters).collect()}
    assert got == {"crimson": (1.0, "invariant"), "blue": (0.333333, "vector")}


def test_neighbourhood_of_hubs(spark):
    edges = [("hub", f"h{i:03d}") for i in range(300)] + [("s", "hub"), ("h007", "far"), ("far", "end"), ("end", "s2"), ("s", "h001")]
    frame = spark.createDataFrame(edges, "atom_a_id string, atom_b_id string")
    start = spark.createDataFrame([("s",), ("s2",), ("lone",)], "id string")
    graph = {}
    for a, b in edges:
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    want = set()
    for s in ("s", "s2", "lone"):
        seen, now = {s: 0}, [s]
        for hop in range(1, 4):
            now = [n for n in {m for x in now for m in graph.get(x, ())} if n not in seen]
            seen |= dict.fromkeys(now, hop)
        want |= {(s, n, h) for n, h in seen.items()}
    for split in (10_000, 7):
        assert {tuple(r) for r in neighbourhood(frame, start, 3, split=split).collect()} == want
    bound = {tuple(r) for r in neighbourhood(frame, start, 2, max_degree=50, split=20).collect()}
    assert ("s", "hub", 1, True) in bound and ("s", "h001", 1, False) in bound and not any(r[0] == "s" and r[1] == "h002" for r in bound)


def test_paths_are_not_moved_as_rows(spark, monkeypatch):
    """The starts of a term move in lists; they are told apart where the lists meet."""
    monkeypatch.setattr(audits, "PACK_ROWS", 3)
    monkeypatch.setattr(audits, "PATHS", 40)
    rng = random.Random(5)
    edges = [(f"m{rng.randrange(12)}", f"n{rng.randrange(60)}") for _ in range(300)] + [("m1", "m1"), ("m2", None), ("n3", None)]
    asked = [f"n{i}" for i in range(0, 60, 2)] + ["m1", "n4", "none", None]
    frame = spark.createDataFrame(edges, "atom_a_id string, atom_b_id string")
    graph = {}
    for a, b in edges:
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    want = {(None, None, 0)}
    for s in filter(None, asked):
        one = graph.get(s, set()) - {s}
        # nothing is reached from a null id, which is told apart from no other
        two = {m for x in one if x for m in graph[x] if m is None or m not in one | {s}}
        want |= {(s, s, 0), *((s, n, 1) for n in one), *((s, n, 2) for n in two)}
    for split in (10_000, 7):
        out = neighbourhood(frame, spark.createDataFrame([(s,) for s in asked], "id string"), split=split)
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert "hashpartitioning(start_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_edges_stay_where_they_are(spark):
    """Lists of starts go to the edges, which are moved by no hop, and repeated edges change nothing."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("b", "c"), ("c", "d"), ("e", "e")], "atom_a_id string, atom_b_id string")
    out = neighbourhood(edges, spark.createDataFrame([("a",), ("a",), ("e",), (None,)], "id string"))
    assert {tuple(r) for r in out.collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("e", "e", 0), (None, None, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin [id" in plan
