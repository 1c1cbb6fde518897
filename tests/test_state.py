"""Stored state: counters, sweeps, confirmations, partitions and medians under replays and restarts."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexweave.functions.quantiles import exact_median
from lexweave.operators.counters import EdgeCounter
from lexweave.operators.edges import edge_degree
from lexweave.sources import folders as fo
from lexweave.streaming import streams as st

CHANGES = "op string, atom_a_id string, atom_b_id string, provenance string, old_provenance string"


def test_counts_follow_any_changes(spark, tmp_path):
    rng = random.Random(2)
    kept, edges = EdgeCounter(spark, str(tmp_path / "counts")), {}
    assert kept.degrees().count() == 0
    for batch in range(4):
        rows = []
        for _ in range(40):
            pair = ("hub" if rng.random() < 0.4 else f"a{rng.randrange(9)}", f"b{rng.randrange(9)}")
            new = rng.choice(["semantic", "harmonic", None])
            if pair not in edges:
                rows.append(("insert", *pair, new, None))
                edges[pair] = new
            elif rng.random() < 0.5:
                rows.append(("delete", *pair, edges.pop(pair), None))
            else:
                rows.append(("update", *pair, new, edges[pair]))
                edges[pair] = new
        changes = spark.createDataFrame(rows, CHANGES)
        for _ in range(rng.choice([1, 2])):
            kept.apply(batch, changes)
        if batch == 1:
            kept.fold(1)
            kept.apply(1, changes)
        now = spark.createDataFrame([(*p, v) for p, v in edges.items()], "atom_a_id string, atom_b_id string, provenance string")
        assert {tuple(r) for r in kept.degrees().collect()} == {tuple(r) for r in edge_degree(now).collect()}


def test_sweep_replays_wraps_and_passes_poison(spark, tmp_path):
    atoms = spark.range(10).select(F.format_string("a%02d", "id").alias("id"))
    folder, built = str(tmp_path / "sweep"), []
    step = lambda process=lambda ids: ids, now=0.0: st.Sweep(spark, folder).page(atoms, process, 4, now=now, build=lambda: built.append(now))
    assert step()
    # a run that wrote its page and died before the cursor moved
    sweep = st.Sweep(spark, folder)
    st.next_sweep(atoms, sweep.state()["cursor"], 4)[0].write.parquet(f"{folder}/out/number=1")
    assert step()

    def poison(ids):
        raise ValueError("no such row")

    assert step(poison) and not step(now=100.0) and built == [100.0]
    out = sorted((r.number, r.id) for r in spark.read.parquet(f"{folder}/out").collect())
    assert out == [(i // 4, f"a{i:02d}") for i in range(8)]
    failed = spark.read.parquet(f"{folder}/failed").collect()
    assert sorted(r.id for r in failed) == ["a08", "a09"] and "no such row" in failed[0].error
    # the next sweep starts over, and manifests wait for a day
    while step(now=3600.0):
        pass
    assert built == [100.0] and spark.read.parquet(f"{folder}/out").select("id").distinct().count() == 10
    while step(now=100.0 + 86_400):
        pass
    assert built == [100.0, 86_500.0]


@pytest.mark.parametrize("forgets", [False, True])
def test_terms_come_out_once_and_are_forgotten(spark, tmp_path, forgets):
    base, schema = str(tmp_path), "atom_id string, seen int, base int, at timestamp"
    args = {"time": "at", "late": "1 minute", "forget_after": 3600} if forgets else {}

    def run(day, rows):
        at = datetime.datetime(2024, 1, day, tzinfo=datetime.timezone.utc)
        spark.createDataFrame([(*r, at) for r in rows], schema).repartition(2).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        sink = st.confirmed_once(source, 3, **args).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema("atom_id string, encounter_count long").parquet(f"{base}/out")
        return sorted(r.atom_id for r in out.collect())

    assert run(1, [("hot", 1, 0)] * 50 + [("slow", 2, 0), ("known", 9, 3), ("near", 1, 2)]) == ["hot", "near"]
    assert run(5, [("hot", 7, 0), ("near", 1, 2)]) == ["hot", "near"]
    late = [] if forgets else ["slow"]
    assert run(6, [("slow", 1, 0), ("fast", 4, 0)]) == ["fast", "hot", "near"] + late
    assert run(6, [("slow", 2, 0), ("fast", 4, 0)]) == ["fast", "hot", "near", "slow"]


def test_only_touched_partitions_are_written(spark, tmp_path):
    folder = str(tmp_path / "table")
    table = lambda rows: spark.createDataFrame(rows, "k string, n int, day string")
    merge = lambda old, new: old.unionByName(new).groupBy("k", "day").agg(F.max("n").alias("n")).select("k", "n", "day")
    rows = [("a", 1, "d1"), ("b", 2, "d1"), ("c", 3, "d2"), ("d", 4, "d3"), ("e", 5, None)]
    assert fo.upsert_parts(table(rows), folder, "day", merge) == ["None", "d1", "d2", "d3"]
    files = lambda: {r.path for r in fo.files(spark, folder, "*.parquet").collect()}
    before = files()
    assert fo.upsert_parts(table([("a", 9, "d1"), ("x", 1, "d1"), ("f", 1, None)]), folder, "day", merge) == ["None", "d1"]
    stay = {p for p in before if "day=d2" in p or "day=d3" in p}
    assert stay and stay <= files() and not {p for p in before if "day=d1" in p} & files()
    now = lambda: sorted(((r.k, r.n, r.day) for r in spark.read.schema("k string, n int, day string").parquet(folder).collect()), key=str)
    want = sorted([("a", 9, "d1"), ("b", 2, "d1"), ("x", 1, "d1"), ("c", 3, "d2"), ("d", 4, "d3"), ("e", 5, None), ("f", 1, None)], key=str)
    assert now() == want
    fails = F.udf(lambda n: 1 // 0, "int")
    with pytest.raises(Exception):
        fo.upsert_parts(table([("a", 10, "d1")]), folder, "day", lambda old, new: merge(old, new).withColumn("n", fails("n")))
    assert now() == want
    assert fo.upsert_parts(table([]), folder, "day", merge) == [] and now() == want
    assert fo.drop_parts(spark, folder, "day", "d3") == ["d1", "d2"]
    assert [r[0] for r in now()] == ["d", "e", "f"] and fo.drop_parts(spark, str(tmp_path / "none"), "day", "x") == []


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 5001])
def test_median_is_exact(spark, n):
    rng = random.Random(n)
    rows = [("x", rng.gauss(0, 1)) for _ in range(n)] + [("y", 5.0 if i % 3 else rng.random() * 10) for i in range(n)] + [("z", None), ("x", None)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", accuracy=100).collect()}
    assert got == {k: pytest.approx(statistics.median([v for c, v in rows if c == k and v is not None])) for k in "xy"}
    assert exact_median(spark.createDataFrame(rows, "k string, v double"), [], "v").first().median == pytest.approx(statistics.median([v for _, v in rows if v is not None]))
