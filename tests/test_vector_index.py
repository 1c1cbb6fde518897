"""The vector index: recall on clustered and shapeless vectors, exact scores, hot cells, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import vector_index as vi
from lexweave.operators.vectors import knn


def table(spark, mat):
    return spark.createDataFrame([(f"v{i:05d}", [float(x) for x in row]) for i, row in enumerate(mat)], "id string, vec array<double>")


def clustered(rng, n, d):
    centres = rng.standard_normal((12, d))
    return centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, d))


@pytest.mark.parametrize("shape", ["clustered", "shapeless"])
def test_recall_and_work(spark, shape):
    rng = np.random.default_rng(1)
    mat = clustered(rng, 3000, 16) if shape == "clustered" else rng.standard_normal((3000, 16))
    rows = table(spark, mat)
    index = vi.build_index(rows, k=10)
    asked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(20)) == 0)
    found, true = vi.search(index, asked, 10).cache(), knn(asked, rows, 10).cache()
    assert vi.recall_of(found, true).agg(F.avg("recall")).first()[0] >= 0.9
    scores = {(r.query_id, r.neighbour_id): r.score for r in true.collect()}
    got = found.collect()
    assert all(scores.get((r.query_id, r.neighbour_id), r.score) == r.score for r in got)
    assert all(r.query_id == r.neighbour_id for r in got if r["rank"] == 1)
    # the cells a query looks into hold well under all rows
    share = np.sort(index.sizes)[::-1][: index.probes].sum() / 3000
    assert share < (0.3 if shape == "clustered" else 0.75) and index.sizes.sum() == 3000


def test_all_cells_are_exact_and_hot_cells_are_cut(spark):
    rng = np.random.default_rng(2)
    mat = np.vstack([np.ones((400, 8)) + 1e-3 * rng.standard_normal((400, 8)), rng.standard_normal((300, 8))])
    rows = table(spark, mat)
    index = vi.build_index(rows, cells=9)
    want = sorted(tuple(r) for r in knn(rows, rows, 5).collect())
    for block in (20_000, 50):
        got = vi.search(index, rows, 5, probes=9, block_rows=block)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_edge_cases(spark):
    rows = table(spark, np.vstack([np.zeros((2, 4)), np.ones((3, 4)), -np.ones((1, 4))])).withColumn("cell", F.lit("x"))
    index = vi.build_index(rows)
    assert index.sizes.sum() == 6
    want = sorted(tuple(r) for r in knn(rows, rows, 3, min_sim=0.5).collect())
    assert sorted(tuple(r) for r in vi.search(index, rows, 3, min_sim=0.5, probes=99).collect()) == want
    empty = vi.build_index(rows.limit(0))
    assert vi.search(empty, rows, 3).count() == 0 and vi.search(index, rows.limit(0), 3).count() == 0
    assert vi.build_index(rows.limit(1)).sizes.tolist() == [1]


def test_vectors_move_once_for_a_block_of_queries(spark):
    """However many cells a query looks into, it is moved once, and a row once for each block; repeated ids as of ``knn``."""
    rng = np.random.default_rng(7)
    mat = rng.integers(-2, 3, (900, 4)).astype(float)
    rows = table(spark, mat).withColumn("id", F.when(F.col("id") < "v00040", F.concat(F.lit("twice"), F.substring("id", 6, 1))).otherwise(F.col("id")))
    index = vi.build_index(rows, cells=30)
    got = vi.search(index, rows, 7, probes=30, block_rows=300)
    want = knn(rows, rows, 7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
