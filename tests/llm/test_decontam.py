"""Benchmark leaks against all pairs, planted paraphrases, the factorisation, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexweave.llm import decontam as D
from lexweave.llm.decontam import Rules, drop_contaminated, find_contaminated
from lexweave.llm.queries import op7_benchmark_leaks

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def parts_of(words):
    """Passages of an item, the last of a longer one ending with it."""
    size = D.PASSAGE
    starts = list(range(0, max(1, len(words) - size), size)) + ([len(words) - size] if len(words) > size else [])
    return [words[s : s + size] for s in starts]


def holds(part, window, rules):
    if len(part) < D.VERBATIM:
        return any(window[i : i + len(part)] == part for i in range(len(window)))
    known = set(window)
    if sum(w in known for w in part) < rules.paraphrase * len(part):
        return False
    share, answer = longest(part, window) / len(part), part[-rules.answer_words :]
    return share >= rules.same or (share >= rules.paraphrase and longest(answer, window) >= rules.answer * len(answer))


def leaks_by_force(docs, items, rules=Rules()):
    found = set()
    for d, text in docs:
        words = tokens(text)
        known = set(words)
        for i, item in items:
            for part in parts_of(tokens(item)) if item else []:
                if sum(w in known for w in part) < rules.paraphrase * len(part):
                    continue
                for begin in range(0, max(1, len(words) - D.BLOCK), D.BLOCK):
                    if holds(part, words[max(0, begin - D.BLOCK) : begin + 3 * D.BLOCK], rules):
                        found.add((d, i))
    return found


def test_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op7_benchmark_leaks(spark, SF).collect()}
    want = leaks_by_force(docs, items)
    assert want and len(got & want) >= 0.95 * len(want) and got <= want
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got


def test_paraphrases(spark):
    """Of passages with a fifth of their words changed nearly all are found, of clean texts none."""
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.join(op7_benchmark_leaks(spark, SF), "doc_id", "left_anti").select("doc_id", "text").limit(300).collect()
    rows, planted = [], set()
    for n, r in enumerate(clean):
        text = r.text
        if n < 150:
            i, item = items[n]
            own = [w if rng.random() > 0.2 else "changed" for w in item.split()]
            lines = text.split(" ")
            at = rng.randrange(len(lines))
            text = " ".join([*lines[:at], *own, *lines[at:]])
            planted.add((r.doc_id, i))
        rows.append((r.doc_id, text))
    got = {(r.doc_id, r.item_id) for r in find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")).collect()}
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_basis_finds_the_leading_directions(spark):
    rng = np.random.default_rng(0)
    left, right = rng.normal(size=(200, 5)), np.zeros((5, 1 << D.BITS))
    right[:, :300] = rng.normal(size=(5, 300))
    dense = left @ right
    rows = [(list(range(300)), r[:300].tolist(), 1.0) for r in dense]
    basis = D.latent_basis(spark.createDataFrame(rows, "f array<long>, x array<double>, w double").repartition(3), rank=5, extra=3)
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-4) and np.allclose(dense @ basis @ basis.T, dense, atol=1e-2)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert D.common_subsequence(D.places(a), len(a), b) == longest(a, b)


def test_edge_cases(spark):
    item = " ".join(f"word{i} of" for i in range(20))
    long = " ".join(f"part{i}" for i in range(150))
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 2), (3, f"x {item} y", 3), (3, f"x {item} y", 3), (None, item.upper(), 4), (5, "filler " * 50_000 + item, 5), (6, long[400:900], 6), (7, "only three words", 7), (8, "three only words", 8)],
        "doc_id long, text string, cosine int",
    )
    items = spark.createDataFrame([(10, item), (11, None), (None, long), (12, ""), (13, "only three words"), (14, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in find_contaminated(docs, items).collect()), key=str)
    want = [(d, i) for d in (3, 3, 5, None) for i in (10, 14)] + [(6, None), (7, 13)]
    assert got == sorted(want, key=str)
    split = sorted(((r.doc_id, r.item_id) for r in find_contaminated(docs, items, item_rows=2).collect()), key=str)
    assert split == got
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 8]
    assert drop_contaminated(docs, items.limit(0)).count() == 9 and find_contaminated(docs.limit(0), items).count() == 0
    named = items.withColumn("answer", items.text)
    assert find_contaminated(docs, named, answer_col="answer").count() == len(got)
    assert D.hashed(pa.array([None, ""])).hash.size == 0
    with pytest.raises(Exception):
        find_contaminated(docs, items, id_col="absent")


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_rows_do_not_depend_on_blocks(spark, kind):
    """Ids of any type, repeated and null ones: a row per document and item row, in blocks of any size."""
    short = [f"alpha{i} beta gamma{i} delta epsilon{i}" for i in range(3)]
    item = " ".join(f"word{i} of" for i in range(30))
    long = " ".join(f"part{i}" for i in range(400))
    ids = [1, 1, None, None, 2, 2]
    texts = [item, short[0], short[1], long, long, short[2]]
    items = spark.createDataFrame(list(zip(ids, texts)), "item_id long, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    docs = spark.createDataFrame([(1, f"x {item} {short[0]} {short[1]} {long} {short[2]}"), (2, f"so {long[900:2000]} on"), (3, "nothing")], "doc_id int, text string")
    got = [
        sorted(((r.doc_id, r.item_id, round(r.share, 9), r.word) for r in find_contaminated(docs, items, item_rows=n).collect()), key=str)
        for n in (20_000, 4, 1)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == 8
    assert {type(r[1]) for r in got[0]} == {type(None), str if kind == "string" else int}


def planted_items(n_items, n_planted, lengths):
    """Long documents, of which the first hold an item each as it stands; items are cut from other documents."""
    rng = random.Random(5)
    texts = [tokens(t) for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts = [t for t in texts if len(t) > 150]
    hosts, others = texts[:n_planted], texts[n_planted:]
    items = []
    for i in range(n_items):
        own, n = rng.choice(others), lengths[i % len(lengths)]
        at = rng.randrange(len(own) - n)
        items.append((i, own[at : at + n]))
    docs = []
    for d, host in enumerate(hosts):
        at = rng.randrange(len(host))
        docs.append((d, " ".join([*host[:at], *items[d][1], *host[at:]])))
    return docs, [(i, " ".join(x)) for i, x in items]


def found(spark, docs, items):
    rows = find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_large_benchmark(spark):
    """No item is lost when the benchmark has many times more items than the space has axes, not even with a fifth of its words changed."""
    docs, items = planted_items(3000, 240, [8, 10, 13, 20, 30, 48])
    rng = random.Random(6)
    changed = [(d, t.replace(items[d][1], " ".join(w if rng.random() > 0.2 else "changed" for w in items[d][1].split())) if d >= 120 else t) for d, t in docs]
    got = found(spark, changed, items)
    want = leaks_by_force(changed, items[:240])
    assert {(d, d) for d in range(120)} <= got and {p for p in got if p[1] < 240} <= want
    held = {(d, d) for d in range(120, 240)} & want
    assert len(held & got) >= 0.95 * len(held)


def test_short_items_in_long_texts(spark):
    docs, items = planted_items(90, 90, list(range(2, 17)))
    got = found(spark, docs, items)
    want, short = leaks_by_force(docs, items), {i for i, t in items if len(t.split()) < D.VERBATIM}
    assert {(d, d) for d, _ in docs} <= got <= want
    assert {p for p in got if p[1] in short} == {p for p in want if p[1] in short}


def test_all_windows_are_factored(spark):
    """The corpus part is a pass over every window of every text."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, n)) for n in (0, 1, 31, 32, 33, 70, 200, 1000)]
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(4)
    idf = rng.uniform(0.5, 2, 1 << D.BITS)
    right = rng.standard_normal((1 << D.BITS, 6)).astype(np.float32)
    got, n = D.corpus_product(df, idf, right)
    want, windows = np.zeros_like(right, np.float64), 0
    for t in texts:
        f = D.feature(D.hashed(pa.array([t])).hash)
        blocks = [f[i : i + D.BLOCK] for i in range(0, len(f), D.BLOCK)]
        for w in [np.concatenate(p) for p in zip(blocks, blocks[1:])] or blocks:
            x = np.zeros(1 << D.BITS)
            np.add.at(x, w, idf[w])
            want += 3 * np.outer(x, x @ right) / (idf[w] ** 2).sum()
            windows += 3
    assert n == windows and np.allclose(got, want, atol=1e-3)
    factor = D.corpus_factor(df, idf, rank=64, extra=8)
    assert factor.shape == (1 << D.BITS, 72) or factor.shape[1] <= 72


def test_rows_are_summed_by_word():
    """Frequent and other words alike, a word many times in a block, an empty block."""
    rng = np.random.default_rng(0)
    idf = rng.random(1 << D.BITS)
    f, block = rng.integers(0, 1 << D.BITS, 900) % 40 * 800, np.sort(rng.integers(0, 30, 900))
    f[:300] = np.argsort(idf)[:300]
    rows, out, want = rng.random((31, 5)).astype(np.float32), np.zeros((5, 1 << D.BITS)), np.zeros((1 << D.BITS, 5))
    np.add.at(want, f, rows[block])
    D.WordSums(idf).add(f, block, rows, out)
    assert np.allclose(out.T, want, atol=1e-4)
    parts = list(D._some_rows(want))
    assert max(p.num_rows for p in parts) <= D.SOME and len(parts) == (1 << D.BITS) // D.SOME
    assert np.concatenate([p.column(0).to_numpy() for p in parts]).tolist() == np.flatnonzero(want.any(axis=1)).tolist()


def test_only_passages_with_enough_shared_words_are_verified(monkeypatch):
    """All are near in a space of one direction; one shares its words."""
    said = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(20)]
    items = D.Items(pa.array(range(20)), list(range(20)), [D.hashed(pa.array([t])).hash for t in said], [D.hashed(pa.array([t])).hash[-6:] for t in said])
    met, found_in = [], D.Passage.found_in
    monkeypatch.setattr(D.Passage, "found_in", lambda self, *a: met.append(self) or found_in(self, *a))
    finder = D.Finder(np.ones((1 << D.BITS, 1)), np.ones(1 << D.BITS), items, Rules())
    out = finder(pa.array(["other " * 70 + said[7], "nothing of it " * 20]))
    assert {(d, j, s) for d, j, s, *_ in out} == {(0, 7, 1.0)}
    assert met and all(p is finder.passages[7] for p in met)


def test_light_windows_are_weighed_together(monkeypatch):
    """Windows that share only common words with a passage are told by matrices, not one by one."""
    asked = []
    weigh = D.Passage.weight_in
    monkeypatch.setattr(D.Passage, "weight_in", lambda self, window: asked.append(weigh(self, window)) or asked[-1])
    monkeypatch.setattr(D, "CELLS", 7)
    rng = np.random.default_rng(4)
    passages = [" ".join(["the", "of", "to", "in", "is", "it"] + [f"rare{i}x{k}" for k in range(6)]) for i in range(5)]
    texts = ["the of to in is it " + " ".join(f"word{k}" for k in rng.integers(0, 90, 200)) for _ in range(20)] + [passages[3] + " plain" * 90, passages[1] + " " + passages[2]]
    idf = np.full(1 << D.BITS, 5.0)
    idf[D.feature(D.hashed(pa.array(["the of to in is it"])).hash)] = 0.1
    hashes = [D.hashed(pa.array([p])).hash for p in passages]
    items = D.Items(pa.array(range(5)), list(range(5)), hashes, [h[-6:] for h in hashes])
    finder = D.Finder(np.ones((1 << D.BITS, 1)), idf, items, D.Rules(cosine=2.0))
    found = finder(pa.array(texts))
    assert {(d, k) for d, k, *_ in found} == {(20, 3), (21, 1), (21, 2)}
    assert len(asked) == sum(x >= 0.5 for x in asked) > 0
    words = D.hashed(pa.array(texts))
    at, doc, head = D.blocks_of(words)
    begin = np.arange(len(doc))
    row, col = np.repeat(begin, 5), np.tile(np.arange(5), len(begin))
    weights = finder.shared.weights(*finder.shared.known(words, D.block_of(words, head)), begin, begin + 1, row, col)
    want = [weigh(finder.passages[j], set(words.hash[at[i][at[i] >= 0]].tolist())) for i, j in zip(row, col)]
    assert np.allclose(weights, want, atol=1e-9)
