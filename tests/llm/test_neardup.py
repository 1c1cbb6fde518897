"""Near-duplicate classes against all pairs, and the edge cases."""

from collections import Counter

import numpy as np
import pyarrow as pa

from lexweave.llm import words as W
from lexweave.llm.neardup import dart_signatures, compared, drop_near_duplicates, linked, near_duplicates

SCHEMA = "doc_id long, text string, node string, root long, class_id long"


def multiset(text):
    w = text.split(" ") if text.strip() else []
    w = [x for x in text.split() if x]
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def classes_by_force(rows):
    sets = [multiset(t or "") for _, t in rows]
    root = list(range(len(rows)))
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for group in where.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if similarity(sets[a], sets[b]) >= 0.8:
                        ra, rb = root[a], root[b]
                        root = [ra if r == rb else r for r in root]
    out = {}
    for i, r in enumerate(root):
        out.setdefault(r, []).append(rows[i][0])
    return {d: min(g) for g in out.values() for d in g}


def test_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == classes_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(set(got.values())) < len(got)


def test_blocks_leave_the_classes(spark):
    rows = []
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    for d in range(150):
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 3)):
            w[p] = f"x{rng.integers(0, 30)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_force(rows)
    for block in (16, 512):
        assert {r.doc_id: r.class_id for r in near_duplicates(docs, block=block).collect()} == want


def test_chance_chains_are_compared_by_bucket(spark):
    # neighbours at 0.74 share some band and chain; every tenth text has a true near copy
    rows = [(i, " ".join(f"w{j}" for j in range(14 * i, 14 * i + 100))) for i in range(200)]
    rows += [(1000 + i, t.replace(f"w{14 * i + 50} ", "x ")) for i, t in rows if i % 10 == 0]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")
    want = classes_by_force(rows)
    for block in (16, 512):
        got = {r.doc_id: r.class_id for r in near_duplicates(docs, block=block).collect()}
        assert got == want and len(set(want.values())) == 200


def test_sets_to_compare(spark):
    def sets(groups, keys, block):
        g = spark.createDataFrame(groups, "node long, root long")
        out = {}
        marks = spark.createDataFrame([(n, [b for m, b in keys if m == n]) for n in {m for m, _ in keys}], "node long, bands array<long>")
        for r in compared(g, marks.union(marks), block=block).collect():
            out.setdefault(r.root, []).append(r.node)
        return sorted(sorted(x) for x in out.values())

    chain = [(n, 0) for n in range(8)]
    links = [(n, 100 + n) for n in range(7)] + [(n + 1, 100 + n) for n in range(7)] + [(3, 100 + 3), (0, 900)]
    small, alike = [(20, 20), (21, 20)], [(n, 30) for n in range(30, 38)]
    same = [(n, b) for n in range(30, 38) for b in (500, 501)]
    part = [(n, 600 + b) for n in range(30, 38) for b in range(4) if n % 5 != b]
    keys = [*links, (20, 300), (21, 300), *same, *part]
    assert sets([*chain, *small, *alike], keys, 8) == [list(range(8)), [20, 21], list(range(30, 38))]
    assert sets([*chain, *small, *alike], keys, 4) == [*[[n, n + 1] for n in range(7)], [20, 21], list(range(30, 38))]
    assert sets([], [], 4) == []


def test_agreement_is_weighted_similarity():
    doc = np.repeat([0, 1], 100)
    code = W.mix(np.concatenate([np.arange(100), np.arange(30, 130)]).astype(np.uint64))
    weight = np.where(np.arange(200) % 2, 1.0, 2.5)
    sign = dart_signatures(doc, code, weight, 2, 4096)
    a = dict(zip(code[:100].tolist(), weight[:100]))
    b = dict(zip(code[100:].tolist(), weight[100:]))
    want = sum(min(a.get(x, 0), b.get(x, 0)) for x in {*a, *b}) / sum(max(a.get(x, 0), b.get(x, 0)) for x in {*a, *b})
    assert abs((sign[0] == sign[1]).mean() - want) < 0.03
    assert np.isinf(dart_signatures(doc[:100] + 1, code[:100], weight[:100], 3, 8)[[0, 2]]).all()


def test_sides_meet():
    text = " ".join(f"w{i}" for i in range(40))
    assert linked([text, text + " a", text], [5, 6, 7], np.array([0, 1, 1]), 5, 0.8) == [(5, 6), (5, 7)]
    assert linked(["", ""], [1, 2], None, 5, 0.8) == []


def test_edge_cases(spark):
    long = "ab " * 40_000
    rows = [
        (1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one"), (6, long), (7, long), (None, "one"),
        (8, "same text of six words here"), (8, "same text of six words here"), (9, None),
    ]
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    got = sorted(near_duplicates(docs).collect(), key=str)
    assert len(got) == len(rows)
    classes = Counter((r.doc_id, r.class_id, r.class_size) for r in got)
    assert classes == Counter(
        [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 2), (7, 6, 2), (None, 4, 3), (8, 8, 2), (8, 8, 2), (9, 9, 1)]
    )
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9]
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_words_match_python():
    texts = ["a b  c", "", None, "dé  f\tg\n", " x", "a"]
    w = W.split(pa.array(texts))
    found = [[] for _ in texts]
    for d, s, e in zip(w.doc, w.start, w.end):
        found[d].append(w.data[s:e].tobytes().decode())
    assert found == [(t or "").split() for t in texts]
    assert w.hash[0] == w.hash[-1]


def test_components_of_chains_and_hubs(spark):
    from lexweave.llm.tables import components

    chain = [(i, i + 1) for i in range(100, 180)]
    hub = [(1, i) for i in range(2, 60)] + [(59, 90)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*chain, *hub, (7, 7), (5, 1)], "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1 for i in range(1, 60)}, 90: 1}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_never_stop_unsettled(spark):
    import pytest

    from lexweave.llm.tables import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=2)
