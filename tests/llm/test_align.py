"""Token alignment against plain Python over the libraries' own tokens, and the edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexweave.llm.align import align, aligned, byte_alphabet, byte_side, merged, piece_side, run_blocks
from lexweave.llm.queries import op13_token_alignment

SF = "/root/testdata/sf0.001"
A = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
B = public_tokenizers.path("piece_bpe_32k.model")
SIDES = (lambda: byte_side(A, RANKS), lambda: piece_side(B))


@pytest.fixture(scope="module")
def libraries():
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    return slow, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, libraries):
    slow, model = libraries
    found = slow.encode(" " + text, add_special_tokens=False)
    alphabet = byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    b = []
    for i in model.encode(text):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
    if text and all(b"".join(t for _, t in s) == b" " + text.encode() for s in (a, b)):
        return a, b
    return [], []


def places(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(rows, libraries):
    docs, counts = [], {}
    for i, text in rows:
        a, b = map(places, tokens(text or "", libraries))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else None
        if links is None:
            links, j = [], 0
            for x in a:
                while b[j][2] <= x[1]:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < x[2]:
                    links.append((x[0], b[k][0]))
                    k += 1
        for p in links:
            counts[p] = counts.get(p, 0) + 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, lo = [], 0
        ia = ib = 0
        for e in ends:
            ja, jb = ia, ib
            while ja < len(a) and a[ja][2] <= e:
                ja += 1
            while jb < len(b) and b[jb][2] <= e:
                jb += 1
            parts.append(",".join(str(x[0]) for x in a[ia:ja]) + "|" + ",".join(str(x[0]) for x in b[ib:jb]))
            ia, ib, lo = ja, jb, e
        docs.append((i, len(a), len(b), len(ends), links, ";".join(parts)))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        ((i, na, nb, g, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if s else "")
         for i, na, nb, g, links, s in docs), key=str,
    ), {(x, y): (n, n == top[y]) for (x, y), n in counts.items()}


def test_query(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op13_token_alignment(spark, SF).collect()), key=str)
    assert got == plain(rows, libraries)[0]


def test_many_small_runs_and_groups(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, pairs = align(docs, *SIDES, n_a=50_257, radices=4, run_links=3_000, group_records=5_000)
    want, counts = plain(rows, libraries)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert {(r.a, r.b): (r.n_links, r.is_best) for r in pairs.collect()} == counts


def test_edge_cases(spark, libraries):
    odd = ["", None, " ", "\n\n", "a", "<|endoftext|> </s> <s>", "▁ kept", "日本 🎉 \x00 ß", "tab\tand  two", "é ﬁ", "x" * 60_000, "word " * 30_000, "🎉" * 2_000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "null id"), (4, "a"), (4, "a")]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, n_a int, run int, ord string")
    found, _ = align(docs, *SIDES, n_a=50_257)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, libraries)[0]
    empty, pairs = align(docs.limit(0), *SIDES, n_a=50_257)
    assert empty.count() == 0 and pairs.count() == 0
    nothing, pairs = align(docs.where("text = ''"), *SIDES, n_a=50_257)
    assert [tuple(r) for r in nothing.collect()] == [(0, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0


def test_both_libraries_of_the_first_side():
    texts = [" <|endoftext|> one", "two\n three", "", "é" * 50]
    one, two = (aligned(texts, byte_side(A, r), piece_side(B)) for r in (None, RANKS))
    assert one.groups == two.groups and one.n_links.tolist() == two.n_links.tolist()


@pytest.mark.parametrize("seed", range(20))
def test_heap_merge(seed):
    rng = np.random.default_rng(seed)
    streams, want = [], {}
    for _ in range(rng.integers(1, 12)):
        keys = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        values = rng.integers(1, 9, len(keys))
        streams.append((keys, values))
        for k, v in zip(keys.tolist(), values.tolist()):
            want[k] = want.get(k, 0) + v
    got = [(int(k), int(v)) for keys, values in merged(streams) for k, v in zip(keys, values)]
    assert got == sorted(want.items())


def test_blocks_keep_every_record():
    rng = random.Random(1)
    ord_ = np.array([rng.randrange(50) for _ in range(5000)])
    pair = np.array([rng.randrange(40) * 100 + rng.randrange(100) for _ in range(5000)])
    blocks = list(run_blocks(ord_, pair, 100, radices=3, size=100))
    assert sum(b[2] for b in blocks) == len(set(zip(ord_.tolist(), pair.tolist()))) and max(b[2] for b in blocks) <= 100
