"""Quality scores from histogram gradient-boosted trees over document statistics.

The statistics of a text are counted on its bytes in numpy, a slice of texts at a
time. The trees are fitted on a bounded, hash-chosen sample of the labelled rows and
flattened into arrays; scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import words as W
from lexweave.llm.tables import text_of

#: Labelled rows the trees are fitted on, in expectation.
FIT_ROWS = 20_000
NEWLINE = W.separators(b"\n")
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 exclamation, 7 stop, 8 outside ASCII.
CLASSES = np.zeros(256, np.int64)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 8
CLASSES[list(W.SPACES)], CLASSES[list(b"#*$%&|<>")], CLASSES[list(b"!?")], CLASSES[list(b".,;:")] = 4, 5, 6, 7
FEATURES = (
    "log_bytes log_words word_bytes letters uppercase digits spaces symbols shouts stops lines_per_word "
    "distinct_words top_word repeated_runs repeated_lines short_words longest_word"
).split()


def statistics(texts: pa.Array) -> np.ndarray:
    """n x len(FEATURES) statistics of whole texts; an empty text has zeros."""
    n = len(texts)
    words = W.split(texts)
    _, offsets = W.raw(texts)
    size = np.diff(offsets)
    kinds = np.bincount(
        np.repeat(np.arange(n) * 9, size) + CLASSES[words.data], minlength=9 * n
    ).reshape(n, 9).astype(float)
    count = np.bincount(words.doc, minlength=n).astype(float)
    length = (words.end - words.start).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, words.doc, length)

    def tallied(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, _, times = W.multiset(doc, code)
        top = np.zeros(n)
        np.maximum.at(top, doc, times)
        return np.bincount(doc, minlength=n), top, np.bincount(doc, weights=np.where(times > 1, times, 0), minlength=n)

    distinct, top, _ = tallied(words.doc, words.hash)
    doc, code = W.shingles(words, 3)
    _, _, repeated = tallied(doc, code)
    runs = np.bincount(doc, minlength=n)
    lines = W.split(texts, NEWLINE)
    n_lines = np.bincount(lines.doc, minlength=n).astype(float)
    different, _, _ = tallied(lines.doc, lines.hash)
    size, per = np.maximum(size, 1), np.maximum(count, 1)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 8]
    out = np.column_stack(
        [
            np.log1p(np.diff(offsets)), np.log1p(count), np.bincount(words.doc, weights=length, minlength=n) / per,
            letters / size, kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1), kinds[:, 3] / size, kinds[:, 4] / size,
            kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size, n_lines / per, distinct / per, top / per,
            repeated / np.maximum(runs, 1), (n_lines - different) / np.maximum(n_lines, 1),
            np.bincount(words.doc, weights=length <= 3, minlength=n) / per, np.log1p(most),
        ]
    )
    return out


@dataclass
class Trees:
    """Trees of equal depth, flattened: inner node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right if the value is larger; inf where a node is not split
    leaf: np.ndarray  # trees x leaves
    prior: float  # log odds before the first tree

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner] if len(x) else 0
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(
    x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Fit trees on quantile histograms by gradient boosting of the log loss.

    Without rows, or with one label only, there are no trees and the prior alone scores
    (one half without rows). ``least`` is the smallest sum of second derivatives of a child.
    """
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    prior = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    if n == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    flat = binned + np.arange(width) * bins
    score = np.full(n, prior)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, here = 2**level - 1, 2**level
            cell = ((node - base)[:, None] * (width * bins) + flat).reshape(-1)
            shape = (here, width, bins)
            g = np.bincount(cell, np.repeat(grad, width), here * width * bins).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(hess, width), here * width * bins).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < least) | (ht - h < least)] = 0
            for k in range(here):
                best = int(gain[k].argmax())
                f, b = divmod(best, bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[base + k], cut[base + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        g = np.bincount(node - inner, grad, inner + 1)
        h = np.bincount(node - inner, hess, inner + 1)
        leaf = -rate * g / (h + l2)
        score = score + leaf[node - inner]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), prior)


def scored(docs: DataFrame, score: Callable[[np.ndarray], np.ndarray], name: str, text_col: str) -> DataFrame:
    """``docs`` with a double column ``name``: ``score`` of the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in W.slices(texts):
                part = batch.slice(lo, hi - lo)
                got = score(statistics(texts.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*part.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for ids whose crc32 (of the id as text) is divisible by ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_rows: int = FIT_ROWS, folds: int = 5, **options,
) -> Trees:
    """Trees for ``label_col`` (0 or 1), fitted on about ``fit_rows`` labelled rows outside the held-out fold.

    The rows are chosen by a hash of their id. Rows without id or label are not used; an
    id labelled more than once counts with its mean, rounded to 0 or 1 (a half is 1). Only
    the statistics of the sample, ``fit_rows`` short rows, come to the driver.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = (
        usable.where(~held_out(F.col(id_col), folds))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("_label"))
    )
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    sample = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text")).join(F.broadcast(known), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                x = statistics(part.column(0))
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], values], names=["_id", "_label", "x"])

    rows = (
        sample.select("_text", "_id", "_label")
        .mapInArrow(run, T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_label", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
        .toPandas()
        .sort_values(["_id", "_label"], kind="stable")
    )
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return boost(x[np.lexsort(x.T)], rows["_label"].to_numpy()[np.lexsort(x.T)], **options)


def quality_scores(docs: DataFrame, trees: Trees, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability that the quality label is 1.

    Null text counts as empty; an empty text has all statistics 0 and gets the score of
    those. Repeated rows get equal scores; other columns pass through, and ``name`` must
    not be one of them.
    """
    if name in docs.columns:
        raise ValueError(f"a column {name} exists already")
    return scored(docs, trees.score, name, text_col)


def keep_quality(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` scored ``threshold`` or more, with their columns as they are."""
    trees = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality_scores(docs, trees, text_col=text_col, name=name).where(F.col(name) >= threshold).drop(name)
