"""Words of an Arrow text column as numpy arrays: boundaries and 64-bit hashes.

Everything works on the bytes of a slice of texts at once; slices are bounded in
bytes, so a task needs memory for one slice whatever its batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE = separators(SPACES)
#: Everything in ASCII that is neither a digit nor a letter.
PUNCTUATION = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    doc: np.ndarray  # index of the text in its slice
    start: np.ndarray  # first byte in ``data``
    end: np.ndarray
    hash: np.ndarray  # uint64
    data: np.ndarray  # the bytes
    n_docs: int

    def first(self) -> np.ndarray:
        """Index of the first word of each text, and one past the last of all."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text array, nulls as empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` bytes, one text at least."""
    _, offsets = raw(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def split(texts: pa.Array, separator: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Maximal runs of bytes that are no separators, within each text."""
    data, offsets = raw(texts)
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(0, np.uint64), data, len(texts))
    value = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
    value[~inside] = 0
    total = np.add.reduceat(value, start) * powers(INVERSE, n)[start]
    code = mix(total ^ ((end - start).astype(np.uint64) << np.uint64(40)))
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(doc, start, end, code, data, len(texts))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of ``size`` words; a shorter text is one run of all its words."""
    first = words.first()
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    docs, codes = [], []
    n = len(words.doc) - size + 1
    if n > 0:
        code = np.zeros(n, np.uint64)
        for j in range(size):
            code += words.hash[j : j + n] * np.uint64(2 * j * 0x9E3779B1 + 0x85EBCA6B)
        whole = words.doc[:n] == words.doc[size - 1 :]
        docs.append(words.doc[:n][whole])
        codes.append(mix(code[whole]))
    if len(short):
        part = np.array(
            [np.bitwise_xor.reduce(mix(words.hash[first[d] : first[d + 1]] + np.arange(count[d], dtype=np.uint64))) for d in short],
            np.uint64,
        )
        docs.append(short)
        codes.append(mix(part + np.uint64(1)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, code = np.concatenate(docs), np.concatenate(codes)
    return doc, code


def multiset(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, code) sorted by doc, with the number of times each occurs."""
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    if not len(doc):
        return doc, code, np.zeros(0, np.float64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return doc[at], code[at], np.diff(np.append(at, len(doc))).astype(np.float64)
