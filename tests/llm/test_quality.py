"""The quality classifier: held-out accuracy, statistics by hand, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm.quality import FEATURES, boost, fit_quality, keep_quality, quality_scores, statistics
from lexweave.llm.queries import op6_quality_classifier

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    got = op6_quality_classifier(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert ((held.predicted == held.quality).mean()) > 0.95


def test_statistics_by_hand():
    x = dict(zip(FEATURES, statistics(pa.array(["Ab ab! ab 1\nab\nab", None]))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(6)) and x["uppercase"] == pytest.approx(1 / 10)
    assert x["distinct_words"] == pytest.approx(4 / 6) and x["top_word"] == pytest.approx(3 / 6)
    assert x["repeated_lines"] == pytest.approx(1 / 3) and x["digits"] == pytest.approx(1 / 17)
    assert not statistics(pa.array([None, ""])).any()


def test_trees_learn_and_one_label_does_not():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = boost(x, y)
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.98
    assert boost(x, np.ones(4000)).score(x).min() > 0.9
    assert boost(x[:0], y[:0]).score(x).tolist() == [0.5] * 4000


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 1.0), (2, "", None), (2, "", None), (None, "x " * 60_000, 2.0)], "doc_id long, text string, score double"
    )
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (2, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    trees = fit_quality(docs, labels)
    with pytest.raises(ValueError):
        quality_scores(docs, trees)
    got = quality_scores(docs, trees, name="own").collect()
    assert len(got) == 4 and all(0 <= r.own <= 1 for r in got)
    assert keep_quality(docs, labels, threshold=0.0).collect() == docs.collect()
    assert keep_quality(docs, labels.limit(0), threshold=0.6).count() == 0
    assert quality_scores(docs.limit(0), trees, name="own").count() == 0
