"""Word-piece counts against greedy matching piece by piece, and the edge cases."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lexweave.llm import words as W
from lexweave.llm.queries import op5_token_counts
from lexweave.llm.token_counts import automaton, byte_level, byte_pieces, token_counts

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1, 1
        n, at = n + 1, end
    return n, 0


def test_query(spark):
    vocabulary = set(byte_pieces(PATH))
    longest = max(map(len, vocabulary))
    assert len(vocabulary) == 50_256 and {bytes([b]) for b in range(256)} <= vocabulary
    got = {r.doc_id: tuple(r)[1:] for r in op5_token_counts(spark, SF).collect()}
    known = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = [b" " + w for w in r.text.encode().split()]
        for w in own:
            if w not in known:
                known[w] = greedy(w, vocabulary, longest)
        assert got[r.doc_id] == (len(own), sum(known[w][0] for w in own), sum(known[w][1] for w in own))


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 15))}
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 15))) for _ in range(300))
    words = W.split(pa.array([text]))
    pieces, unknown = automaton(vocabulary).counts(words)
    assert list(zip(pieces, unknown.astype(int))) == [greedy(w, vocabulary, 9) for w in text.encode().split()]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "hello world"), (4, "hello world"), (4, "hello world"), (5, "a" * 150_000), (6, "日本 🎉 \x00")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_words int, words int")
    got = sorted((tuple(r) for r in token_counts(docs, path=PATH).collect()), key=str)
    assert got[:3] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)] and (None, 2, 2, 0) in got and got.count((4, 2, 2, 0)) == 2
    assert all(r[3] == 0 for r in got) and token_counts(docs.limit(0), path=PATH).count() == 0
    with pytest.raises(ValueError):
        automaton([b"x"], b" ")
    assert byte_level(PATH).counts(W.split(pa.array([""])))[0].tolist() == np.zeros(0).tolist()
