"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. Every node that a match can get stuck at has a failure link
to the node of what remains after the pieces that can be popped, and the number of those
pieces, so a word is counted in one pass over its bytes and no piece is built. Links and
counts are folded into a transition table, which numpy walks for all words of a slice of
texts at once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexweave.llm import words as W


@dataclass
class Automaton:
    """Node 0 is the root, the last row is the dead end of words without a match."""

    step: np.ndarray  # nodes x 256: the next node
    popped: np.ndarray  # nodes x 256: pieces popped on the way
    closing: np.ndarray  # pieces popped when a word ends at the node
    begin: int  # node at which words begin

    def counts(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, unknown) of each word; a word without a match is one unknown piece."""
        size = words.end - words.start
        order = np.argsort(-size, kind="stable")
        start, size = words.start[order], size[order]
        node = np.full(len(order), self.begin)
        total = np.zeros(len(order), np.int64)
        step, popped = self.step.reshape(-1), self.popped.reshape(-1)
        for k in range(int(size[0]) if len(size) else 0):
            here = int(np.searchsorted(-size, -k, "left"))
            at = node[:here] * 256 + words.data[start[:here] + k]
            total[:here] += popped[at]
            node[:here] = step[at]
        dead = node == len(self.step) - 1
        pieces, unknown = np.empty(len(order), np.int64), np.empty(len(order), bool)
        pieces[order] = np.where(dead | (self.closing[node] < 0), 1, total + self.closing[node])
        unknown[order] = dead | (self.closing[node] < 0)
        return pieces, unknown


def automaton(vocabulary: Iterable[bytes], prefix: bytes = b"") -> Automaton:
    """The automaton of a vocabulary for words that begin with ``prefix``."""
    child: list[dict[int, int]] = [{}]
    depth, parent, byte = [0], [-1], [-1]
    piece = {}
    for token in sorted(set(vocabulary) - {b""}):
        node = 0
        for c in token:
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({}), depth.append(depth[node] + 1), parent.append(node), byte.append(c)
            node = child[node][c]
        piece[node] = True
    n = len(child)
    link, pops = np.full(n, -1), np.zeros(n, np.int64)
    by_depth = np.argsort(depth, kind="stable").tolist()
    for v in by_depth[1:]:
        if v in piece:
            link[v], pops[v] = 0, 1
            continue
        z, got, c = int(link[parent[v]]), int(pops[parent[v]]), byte[v]
        while z >= 0 and c not in child[z]:
            got, z = got + int(pops[z]), int(link[z])
        if z >= 0:
            link[v], pops[v] = child[z][c], got
    step = np.full((n + 1, 256), n, np.int32)
    popped = np.zeros((n + 1, 256), np.int16)
    closing = np.full(n + 1, -1, np.int64)
    closing[0] = 0
    for v in by_depth:
        if v and link[v] >= 0:
            step[v] = step[link[v]]
            popped[v] = popped[link[v]] + pops[v]
            if closing[link[v]] >= 0:
                closing[v] = closing[link[v]] + pops[v]
        for c, u in child[v].items():
            step[v, c], popped[v, c] = u, 0
    begin = 0
    for c in prefix:
        begin = child[begin].get(c, -1) if begin >= 0 else -1
    if begin < 0:
        raise ValueError("the vocabulary has no piece that begins with the prefix")
    return Automaton(step, popped, closing, begin)


def byte_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, as bytes; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"] for t in held.get("added_tokens", [])}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    # bytes that are no visible characters stand as the characters from 256 on
    hidden = [b for b in range(256) if b not in shown]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return [bytes(code[c] for c in t) for t in held["model"]["vocab"] if t not in special]


@functools.cache
def byte_level(path: str) -> Automaton:
    return automaton(byte_pieces(path), b" ")


def token_counts(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens, n_unknown): one row per document, without a shuffle.

    Words are runs without white space; each is a space and its bytes, split greedily into
    the longest pieces of the vocabulary file ``path``. Null text counts as empty and has
    no words; a null id stays null; repeated rows are counted alike; an empty table gives
    no rows; other columns are not looked at.
    """
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_level(path)
        for batch in batches:
            for lo, hi in W.slices(batch.column(1)):
                words = W.split(batch.column(1).slice(lo, hi - lo))
                pieces, unknown = counter.counts(words)
                sums = [np.bincount(words.doc, weights=w, minlength=hi - lo).astype(np.int64) for w in (np.ones(len(pieces)), pieces, unknown)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, sums)], names=schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)
