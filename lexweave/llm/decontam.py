"""Benchmark passages in documents, found in a latent semantic space and verified.

Word frequencies are counted over all documents. TF-IDF rows of the benchmark's
passages and of every window of all documents, met in one pass, are factored by a
distributed randomised SVD. Every window of every document is then projected, its cosine with all benchmark
passages taken in blocks, and the nearest passages verified on the words themselves:
by the longest common subsequence and, where that leaves a paraphrase, by the answer.
Beside the nearest, every passage is verified that shares enough words with a window for
the rules to hold, so no leak is lost to the rank, the size of the benchmark or the
length of an item.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import words as W
from lexweave.llm.tables import text_of
from lexweave.session import cut_lineage

BITS = 15
BLOCK = 32  # words; a window is two blocks
RANK = 96
EXTRA = 8
#: Weight of the windows of the documents in the factorisation against that of the benchmark's passages.
CORPUS_WEIGHT = 0.2
#: Benchmark passages, about, that are held and compared at a time; a row stays whole.
ITEM_ROWS = 20_000
PASSAGE = 48
VERBATIM = 8
#: Words of the passages that are counted by a product of matrices, and up to which count.
COMMON = 128
LEVELS = 4
#: Hashed words, those in the most documents, to which rows are added by a product of matrices.
OFTEN = 256
#: Pairs of a window and a passage, about, that are weighed at a time.
CELLS = 50_000
#: Hashed words of a matrix that leave a task in one batch.
SOME = 4096


@dataclass
class Rules:
    """A passage counts as found if its longest common subsequence with a window covers
    ``same`` of its words, or ``paraphrase`` of them and ``answer`` of the answer's words.
    Passages of fewer than VERBATIM words must stand as they are. A window is verified
    with every passage of which it has ``cosine`` in the latent space and ``part`` of its
    own whole length along it, and with every passage that ``SharedWords`` names if the
    window has ``weight`` of its words by their inverse document frequency: the place of the
    cosine where few common words, met by chance, would hold for the other rules."""

    same: float = 0.7
    paraphrase: float = 0.5
    answer: float = 0.8
    answer_words: int = 6
    cosine: float = 0.45
    part: float = 0.2
    weight: float = 0.5


@dataclass
class Items:
    """Ids of benchmark rows, and passages: hashes of their words, of their answers, and their rows."""

    ids: pa.Array = field(default_factory=lambda: pa.nulls(0))
    #: Of each passage: its row, that is its place in ``ids``.
    rows: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)


def hashed(texts: pa.Array) -> W.Words:
    return W.split(texts, W.PUNCTUATION, lower=True)


def feature(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each hashed word, and their number; ``texts`` has one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for lo, hi in W.slices(batch.column(0)):
                w = hashed(batch.column(0).slice(lo, hi - lo))
                pairs = np.sort((w.doc.astype(np.int64) << BITS) | feature(w.hash))
                if len(pairs):
                    new = np.append(True, pairs[1:] != pairs[:-1])
                    seen += np.bincount(pairs[new] & ((1 << BITS) - 1), minlength=1 << BITS)
                n += hi - lo
        some = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.append(seen[some[:-1]], n))], names=["f", "n"])

    rows = texts.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    own = rows[rows.f >= 0]
    out[own.f.to_numpy()] = own.n.to_numpy()
    return out, int(rows.n[rows.f < 0].sum())


def blocks_of(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index or -1 of shape blocks x BLOCK, document of each block, first block of each document)."""
    first = words.first()
    count = np.diff(first)
    per = -(-count // BLOCK)
    doc = np.repeat(np.arange(words.n_docs), per)
    head = np.cumsum(per) - per
    begin = first[doc] + BLOCK * (np.arange(len(doc)) - head[doc])
    at = begin[:, None] + np.arange(BLOCK)
    return np.where(at < first[doc + 1][:, None], at, -1), doc, head


def block_of(words: W.Words, head: np.ndarray) -> np.ndarray:
    """Block of each word; ``head`` as ``blocks_of`` gives it."""
    return head[words.doc] + (np.arange(len(words.doc)) - words.first()[words.doc]) // BLOCK


def windows_of(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each window and whether a second one follows: neighbours, or a lone block."""
    pair = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    alone = ~pair & ~np.append(False, pair[:-1]) if len(doc) else pair
    first = np.flatnonzero(pair | alone)
    return first, pair[first]


def tfidf_rows(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(f, x): hashed words and unit-length weights of every window of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch.column(0)):
                w = hashed(batch.column(0).slice(lo, hi - lo))
                at, doc, _ = blocks_of(w)
                f = np.append(feature(w.hash), -1)[at]
                keys, values = [], []
                for i, pair in zip(*windows_of(doc)):
                    own, tf = np.unique(f[i : i + 1 + pair], return_counts=True)
                    own, tf = own[own >= 0], tf[own >= 0]
                    x = tf * idf[own]
                    keys.append(own), values.append(x / max(np.linalg.norm(x), 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["f", "x"])

    return texts.mapInArrow(run, "f array<long>, x array<double>")


def _matrix_of(rows: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f4").reshape(-1, width)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (4 * matrix.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.astype("<f4").tobytes())])


def _some_rows(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(matrix), SOME):
        some = lo + np.flatnonzero(matrix[lo : lo + SOME].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), _rows_of(matrix[some])], names=["f", "v"])


def summed_blocks(matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of ``matrix`` of each block of hashed words, summed; few blocks at a time stay in the cache."""
    out = np.zeros((len(at), matrix.shape[1]), matrix.dtype)
    for lo in range(0, len(at), 128):
        matrix.take(at[lo : lo + 128], axis=0).sum(axis=1, out=out[lo : lo + 128])
    return out


class WordSums:
    """Rows by block of words, summed by hashed word.

    The ``OFTEN`` words of the lowest inverse document frequency, a good part of all
    occurrences, are counted by block and multiplied; the others are added one by one.
    """

    def __init__(self, idf: np.ndarray):
        self.words = np.argsort(idf, kind="stable")[:OFTEN]
        self.place = np.full(len(idf), -1)
        self.place[self.words] = np.arange(len(self.words))

    def add(self, f: np.ndarray, block: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """Add ``rows``, one for each block, to the columns of ``out``, one for each hashed word, where ``f`` are the words and ``block`` their blocks."""
        at = self.place[f]
        often, width = at >= 0, len(self.words)
        count = np.bincount(block[often] * width + at[often], minlength=len(rows) * width).reshape(-1, width)
        out[:, self.words] += rows.T @ count.astype(np.float32)
        f, block = f[~often], block[~often]
        for own, total in zip(np.ascontiguousarray(rows.T), out):
            total += np.bincount(f, own.take(block), minlength=len(total))


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The matrix of rows (f, v) summed by f in Spark."""

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        own, to = np.unique(parts["f"].to_numpy(), return_inverse=True)
        total = np.zeros((len(own), shape[1]))
        np.add.at(total, to, _matrix_of(parts["v"], shape[1]))
        return pd.DataFrame({"f": own, "v": _rows_of(total).to_pylist()})

    out = np.zeros(shape, np.float32)
    for batch in parts.groupBy(F.col("f") % 64).applyInPandas(add, "f long, v binary").toArrow().to_batches():
        if batch.num_rows:
            out[batch.column(0).to_numpy()] = _matrix_of(batch.column(1).to_pylist(), shape[1])
    return out


def product(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """A'W(A right) for the sparse rows A of weights W, summed in the tasks and then by feature in Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(right.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << BITS, right.shape[1]))
        for batch in batches:
            for f, x, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
                f, x = np.array(f, np.int64), np.array(x)
                out[f] += np.outer(w * x, x @ shared.value[f])
        yield from _some_rows(out)

    total = _summed(rows.mapInArrow(run, "f long, v binary"), (1 << BITS, right.shape[1]))
    shared.destroy()
    return total


def corpus_product(texts: DataFrame, idf: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """A'(A right) and the rows of A, for every window of every text, in one pass.

    A row holds the inverse document frequencies of a window's words over their norm. A
    window is a sum of blocks, so both factors are worked out by block. Only matrices leave
    the tasks, whose number does not grow with the texts.
    """
    sc = texts.sparkSession.sparkContext
    shared, width = sc.broadcast((right.astype(np.float32), idf.astype(np.float32))), right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, idf = shared.value
        words = WordSums(idf)
        # an empty place of a block is a word without weight
        square, right = np.append(idf**2, np.float32(0)), np.vstack([weighted * idf[:, None], np.zeros((1, width), np.float32)])
        out, n = np.zeros((width, 1 << BITS)), 0
        for batch in batches:
            for lo, hi in W.slices(batch.column(0)):
                w = hashed(batch.column(0).slice(lo, hi - lo))
                at, doc, head = blocks_of(w)
                if not len(doc):
                    continue
                f = feature(w.hash)
                held = np.append(f, 1 << BITS)[at]
                sums, squares = summed_blocks(right, held), square[held].sum(axis=1)
                lead, pair = windows_of(doc)
                after = np.minimum(lead + 1, len(doc) - 1)
                along = sums[lead] + np.where(pair[:, None], sums[after], 0)
                along /= np.maximum(squares[lead] + np.where(pair, squares[after], 0), 1e-12)[:, None]
                back = np.zeros_like(sums)
                back[lead] += along
                back[lead[pair] + 1] += along[pair]
                words.add(f, block_of(w, head), back, out)
                n += len(lead)
        for lo in range(0, 1 << BITS, SOME):
            for rows in _some_rows(out[:, lo : lo + SOME].T * idf[lo : lo + SOME, None]):
                yield rows.set_column(0, "f", pa.array(rows.column(0).to_numpy() + lo))
        yield pa.RecordBatch.from_arrays([pa.array([1 << BITS]), _rows_of(np.full((1, width), n))], names=["f", "v"])

    parts = texts.coalesce(4 * sc.defaultParallelism).mapInArrow(run, "f long, v binary")
    total = _summed(parts, ((1 << BITS) + 1, width))
    shared.destroy()
    return total[:-1], int(total[-1, 0])


def corpus_factor(texts: DataFrame, idf: np.ndarray, *, rank: int = RANK, extra: int = EXTRA, seed: int = 3) -> np.ndarray:
    """C of rank ``rank`` + ``extra`` with CC' near A'A / n, for the n windows A of all texts, by one pass (Nystrom)."""
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((1 << BITS, rank + extra), np.float32))
    there, n = corpus_product(texts, idf, start)
    core = (start.T @ there).astype(np.float64)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-6 * max(value.max(), 1e-12)
    return there @ (vector[:, good] / np.sqrt(value[good] * max(n, 1))).astype(np.float32)


def latent_basis(rows: DataFrame, corpus: np.ndarray | None = None, *, rank: int = RANK, extra: int = EXTRA, seed: int = 3) -> np.ndarray:
    """The ``rank`` leading right singular vectors of the sparse rows over ``corpus``', by a randomised range finder.

    One power step; only matrices of (hashed words) x (rank + extra) leave the tasks.
    """

    def times(right: np.ndarray) -> np.ndarray:
        own = product(rows, right)
        return own if corpus is None else own + corpus @ (corpus.T @ right)

    basis, _ = np.linalg.qr(times(np.random.default_rng(seed).standard_normal((1 << BITS, rank + extra), np.float32)))
    basis, _ = np.linalg.qr(times(basis))
    small = basis.T @ times(basis)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return basis @ vector[:, np.argsort(-value)[:rank]]


def read_items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, rules: Rules) -> Items:
    """Passages of at most PASSAGE words; the last passage of a longer item overlaps the one before."""
    texts = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate([text_col, *([answer_col] if answer_col else [])])]
    ids, *texts = (c.combine_chunks() for c in benchmark.select(F.col(id_col).alias("_id"), *texts).toArrow().columns)
    words = hashed(texts[0])
    given = hashed(texts[1]) if answer_col else None
    first = words.first()
    items = Items(ids)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        own = words.hash[a:b]
        starts = [*range(0, max(1, len(own) - PASSAGE), PASSAGE)]
        starts += [len(own) - PASSAGE] if len(own) > PASSAGE else []
        for s in starts:
            part = own[s : s + PASSAGE]
            if len(part):
                items.rows.append(i)
                items.words.append(part)
                answer = given.hash[given.doc == i] if given is not None else part[:0]
                items.answers.append(answer if len(answer) else part[-rules.answer_words :])
    return items


def places(words: list[int]) -> dict[int, int]:
    """The places of each word, as bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | (1 << i)
    return at


def common_subsequence(at: dict[int, int], n: int, window: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence of ``n`` words, given by ``places``, and a window.

    The rows of the table are the bits of an integer. 0 if fewer than ``least`` words are shared.
    """
    hits = [at[w] for w in window if w in at]
    if len(hits) < least:
        return 0
    row = full = (1 << n) - 1
    for h in hits:
        hit = row & h
        row = (row + hit) | (row - hit)
    return n - (row & full).bit_count()


@dataclass
class Passage:
    words: list[int]
    answer: list[int]
    weight: list[float]

    def __post_init__(self):
        self.at, self.answer_at = places(self.words), places(self.answer)
        self.whole = sum(self.weight)

    def weight_in(self, window: set[int]) -> float:
        return sum(x for w, x in zip(self.words, self.weight) if w in window) / self.whole

    def found_in(self, window: list[int], rules: Rules) -> float:
        """Share of the passage found in the window, 0 where the rules do not hold."""
        n = len(self.words)
        if n < VERBATIM:
            return float(any(window[i : i + n] == self.words for i in range(len(window) - n + 1)))
        share = common_subsequence(self.at, n, window, rules.paraphrase * n) / n
        if share >= rules.same:
            return share
        m = len(self.answer)
        if share >= rules.paraphrase and common_subsequence(self.answer_at, m, window) >= rules.answer * m:
            return share
        return 0.0


def runs(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    out = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for j in range(n):
        out += code[j : j + len(out)] * np.uint64(2 * j * 0x9E3779B1 + 0x85EBCA6B)
    return W.mix(out)


class SharedWords:
    """Passages of which a window holds enough words for the rules, none left out.

    A common subsequence takes a word at most as often as both sides have it. The sum of
    these counts is an upper bound of its length: exact for the ``COMMON`` words met most
    often up to LEVELS times, and for the others all occurrences in the window. Passages
    under VERBATIM words are looked up by the hash of all their words.
    """

    def __init__(self, passages: list[np.ndarray], idf: np.ndarray, rules: Rules):
        self.n = len(passages)
        size = np.array([len(p) for p in passages], np.int64)
        self.need = np.where(size < VERBATIM, np.inf, np.ceil(min(rules.paraphrase, rules.same) * size - 1e-9)).astype(np.float32)
        self.is_short = size < VERBATIM
        own = np.flatnonzero(~self.is_short)
        col, code, count = W.multiset(np.repeat(own, size[own]), np.concatenate([passages[j] for j in own] or [np.zeros(0, np.uint64)]))
        self.words, word = np.unique(code, return_inverse=True)
        held = np.bincount(word, minlength=len(self.words))
        order = np.argsort(-held * np.exp(-idf[feature(self.words)]), kind="stable")
        self.common = np.full(len(self.words) + 1, -1)
        self.common[order[:COMMON]] = np.arange(min(COMMON, len(self.words)))
        often = self.common[word] >= 0
        levels = np.zeros((LEVELS, COMMON, self.n), np.float32)
        for k in range(LEVELS):
            more = count[often] - k
            levels[k, self.common[word[often]], col[often]] = np.maximum(more, 0) if k == LEVELS - 1 else more > 0
        levels = levels.reshape(LEVELS * COMMON, self.n)
        used = np.flatnonzero(levels.any(axis=1))
        self.levels, self.above, self.counted = levels[used], (used // COMMON).astype(np.uint8), used % COMMON
        by_word = np.argsort(word[~often], kind="stable")
        self.cols = col[~often][by_word]
        self.first = np.searchsorted(word[~often][by_word], np.arange(len(self.words) + 2))
        # the words of each passage, a place no window has where there are no more, and their parts of its weight
        self.held = np.full((self.n, max(size, default=0)), len(self.words))
        self.part = np.zeros(self.held.shape)
        for j in own:
            weight = idf[feature(passages[j])]
            self.held[j, : size[j]] = np.searchsorted(self.words, passages[j])
            self.part[j, : size[j]] = weight / weight.sum()
        self.short = {}
        for n in np.unique(size[size < VERBATIM]).tolist():
            own = np.flatnonzero(size == n)
            code = np.array([runs(passages[j], n)[0] for j in own], np.uint64)
            self.short[n] = np.sort(code), own[np.argsort(code, kind="stable")]

    def places(self, words: W.Words, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block of the text, passage) of each short passage as it stands."""
        blocks, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (codes, own) in self.short.items():
            here = runs(words.hash, n)
            lo, hi = np.searchsorted(codes, here), np.searchsorted(codes, here, "right")
            at = np.flatnonzero((hi > lo) & (words.doc[: len(here)] == words.doc[n - 1 :][: len(here)]))
            times = hi[at] - lo[at]
            blocks.append(np.repeat(block[at], times))
            found.append(own[np.repeat(lo[at] - np.cumsum(times) + times, times) + np.arange(times.sum())])
        return np.concatenate(blocks), np.concatenate(found)

    def known(self, words: W.Words, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, index in ``words``) of the words of the text that passages have, in order."""
        at = np.minimum(np.searchsorted(self.words, words.hash), max(0, len(self.words) - 1))
        has = self.words[at] == words.hash if len(self.words) else np.zeros(len(at), bool)
        return block[has], at[has]

    def enough(self, block: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(window, passage) matrix: whether the blocks ``begin`` to ``end`` of a window share enough words."""
        base, n = begin.min(), int(end.max() - begin.min())
        lo, hi = np.searchsorted(block, [base, base + n])
        block, word = block[lo:hi] - base, word[lo:hi]
        common = self.common[word]

        # a window is a few blocks of BLOCK words, each of which counts once for a passage
        begin, end = begin - base, end - base
        wide = int((end - begin).max())
        kind = np.uint8 if wide * BLOCK < 256 else np.int32

        def summed(cells: np.ndarray, width: int) -> np.ndarray:
            count = np.bincount(cells, minlength=n * width).reshape(n, width).astype(kind)
            total = count[begin]
            for k in range(1, wide):
                more = np.flatnonzero(begin + k < end)
                total[more] += count[begin[more] + k]
            return total

        often = common >= 0
        count = summed(block[often] * COMMON + common[often], COMMON)
        share = (count[:, self.counted] > self.above).astype(np.float32) @ self.levels
        block, word = block[~often], word[~often]
        times = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        share += summed(np.repeat(block, times) * self.n + self.cols[at], self.n)
        return share >= self.need

    def weights(self, block: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Part of its weight, but for rounding, that passage ``col`` has in window ``row``, in order, of blocks ``begin`` to ``end``."""
        out = np.zeros(len(row))
        lo, hi = np.searchsorted(block, begin), np.searchsorted(block, end)
        width = len(self.words) + 1
        for a in range(0, len(row), CELLS):
            own, at = row[a : a + CELLS], col[a : a + CELLS]
            for first in range(own[0], own[-1] + 1, max(1, 8_000_000 // width)):
                last = min(first + max(1, 8_000_000 // width), own[-1] + 1)
                times = hi[first:last] - lo[first:last]
                held = np.zeros((last - first, width), bool)
                places = np.repeat(lo[first:last] - np.cumsum(times) + times, times) + np.arange(times.sum())
                held[np.repeat(np.arange(last - first), times), word[places]] = True
                p, q = np.searchsorted(own, [first, last])
                out[a + p : a + q] = (held[own[p:q, None] - first, self.held[at[p:q]]] * self.part[at[p:q]]).sum(axis=1)
        return out


class Finder:
    """Looks for the passages of ``items`` in slices of texts."""

    def __init__(self, basis: np.ndarray, idf: np.ndarray, items: Items, rules: Rules):
        self.items, self.rules = items, rules
        self.project = np.ascontiguousarray(np.vstack([(basis * idf[:, None]), np.zeros(basis.shape[1])]), np.float32)
        self.square = np.append(idf**2, 0).astype(np.float32)
        q = np.array([self.project[feature(w)].sum(axis=0) for w in items.words]).reshape(len(items.words), basis.shape[1])
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.passages = [Passage(w.tolist(), a.tolist(), idf[feature(w)].tolist()) for w, a in zip(items.words, items.answers)]
        self.shared = SharedWords(items.words, idf, rules)

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, float, float, int]]:
        """(text, passage, share, cosine, first word of the window): the best window of each pair."""
        words = hashed(texts)
        at, doc, head = blocks_of(words)
        if not len(doc) or not self.items.rows:
            return []
        f = np.append(feature(words.hash), 1 << BITS)[at]
        sums, squares = summed_blocks(self.project, f), self.square[f].sum(axis=1)
        lead, pair = windows_of(doc)
        vector = sums[lead] + np.where(pair[:, None], sums[np.minimum(lead + 1, len(sums) - 1)], 0)
        size = np.sqrt(squares[lead] + np.where(pair, squares[np.minimum(lead + 1, len(sums) - 1)], 0))
        along = np.linalg.norm(vector, axis=1)
        vector /= np.maximum(along, 1e-9)[:, None]
        # the cosine from which on both rules hold
        least = np.maximum(self.rules.cosine, self.rules.part * size / np.maximum(along, 1e-9))
        first = words.first()
        block = block_of(words, head)
        known = self.shared.known(words, block)
        # the blocks of the words that are verified
        opens, closes = np.maximum(lead - 1, head[doc[lead]]), np.minimum(lead + 3, np.append(head, len(doc))[doc[lead] + 1])
        stands, passage = self.shared.places(words, block)
        stands = np.searchsorted(lead, stands, "right") - 1
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        step = max(1, 4_000_000 // len(self.queries))
        for lo in range(0, len(vector), step):
            cosine = vector[lo : lo + step] @ self.queries.T
            enough = self.shared.enough(*known, opens[lo : lo + step], closes[lo : lo + step])
            # without enough shared words no common subsequence is long enough
            near = (cosine >= least[lo : lo + step, None]) & (enough | self.shared.is_short)
            more = enough & ~near
            here = (stands >= lo) & (stands < lo + step)
            near[stands[here] - lo, passage[here]] = True
            near |= more
            row, passed = np.nonzero(near)
            light = more[row, passed]
            asked, place = np.unique(row[light], return_inverse=True)
            held = self.shared.weights(*known, opens[lo + asked], closes[lo + asked], place, passed[light])
            # rounding is left to ``weight_in``
            light[light] = held < self.rules.weight - 1e-6
            row, passed = row[~light], passed[~light]
            last = -1
            for i, j in zip(row.tolist(), passed.tolist()):
                if i != last:
                    last, d = i, doc[lead[lo + i]]
                    begin = first[d] + BLOCK * (lead[lo + i] - head[d])
                    window = words.hash[max(begin - BLOCK, first[d]) : min(begin + 3 * BLOCK, first[d + 1])].tolist()
                    held = set(window)
                if more[i, j] and self.passages[j].weight_in(held) < self.rules.weight:
                    continue
                share = self.passages[j].found_in(window, self.rules)
                if share > 0:
                    found = (share, float(cosine[i, j]), int(begin - first[d]))
                    best[(d, j)] = max(best.get((d, j), found), found)
        return [(int(d), int(j), *found) for (d, j), found in best.items()]


def finders(docs: DataFrame, benchmark: DataFrame, *, id_col: str, item_col: str, text_col: str, item_text_col: str, answer_col: str | None, rules: Rules, item_rows: int):
    """A broadcast Finder for each block of benchmark rows with about ``item_rows`` passages at most."""
    spark = docs.sparkSession
    texts = docs.select(text_of(docs, text_col).alias("text"))
    seen, n = frequencies(texts)
    idf = np.log((n + 1) / (seen + 1)) + 0.1
    factor = corpus_factor(texts, idf)
    long = F.ceil(F.size(F.split(text_of(benchmark, item_text_col), r"\s+")) / PASSAGE)
    parts = -(-(benchmark.agg(F.sum(F.greatest(long, F.lit(1)))).first()[0] or 0) // item_rows)
    for p in range(parts):
        own = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(parts)) == p)
        passages = own.select(text_of(own, item_text_col).alias("text"))
        asked = cut_lineage(tfidf_rows(passages, idf).withColumn("w", F.lit(1.0)))
        basis = latent_basis(asked, np.float32(np.sqrt(CORPUS_WEIGHT * asked.count())) * factor)
        yield spark.sparkContext.broadcast(Finder(basis, idf, read_items(own, item_col, item_text_col, answer_col, rules), rules))


def find_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    item_text_col: str = "text",
    answer_col: str | None = None,
    rules: Rules | None = None,
    item_rows: int = ITEM_ROWS,
) -> DataFrame:
    """Rows (id_col, item_col, share, cosine, word): documents that hold a benchmark item.

    ``share`` is the part of the item's words in the longest common subsequence, ``word``
    where the best window begins, whatever ``item_rows`` is. Items of more than PASSAGE words
    count if one of their passages is found. The answer is ``answer_col``, or the item's last words.

    Null or empty texts and items never match; null ids stay null; a repeated document or
    item gives a row for each of its rows; without documents or items there are no rows;
    other columns are not looked at.
    """
    rules = rules or Rules()
    base = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, benchmark.schema[item_col].dataType),
            *[T.StructField(c, k) for c, k in (("share", T.DoubleType()), ("cosine", T.DoubleType()), ("word", T.LongType()))],
        ]
    )
    out = docs.sparkSession.createDataFrame([], schema)
    for finder in finders(docs, benchmark, id_col=id_col, item_col=item_col, text_col=text_col, item_text_col=item_text_col, answer_col=answer_col, rules=rules, item_rows=item_rows):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in W.slices(batch.column(1), 1 << 19):
                    found = finder.value(batch.column(1).slice(lo, hi - lo))
                    merged: dict = {}
                    items = finder.value.items
                    for d, k, *rest in sorted(found, key=lambda x: x[2:]):
                        merged[(d, items.rows[k])] = rest
                    if merged:
                        cols = list(zip(*merged.values()))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(lo, hi - lo).take(pa.array([d for d, _ in merged])), items.ids.take(pa.array([k for _, k in merged])), *[pa.array(c) for c in cols]],
                            names=schema.names,
                        )

        out = out.unionByName(base.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, rules: Rules | None = None, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", answer_col: str | None = None, item_rows: int = ITEM_ROWS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; the columns stay as they are."""
    kept = docs
    for finder in finders(docs, benchmark, id_col=id_col, item_col=item_col, text_col=text_col, item_text_col=item_text_col, answer_col=answer_col, rules=rules or Rules(), item_rows=item_rows):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for lo, hi in W.slices(texts, 1 << 19):
                    clean = np.ones(hi - lo, bool)
                    clean[[d for d, *_ in finder.value(texts.slice(lo, hi - lo))]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
