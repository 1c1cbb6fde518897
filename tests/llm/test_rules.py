"""Quality rules and likelihood ratios against plain Python, and the edge cases."""

import math
import re
from collections import Counter

import xxhash

from lexweave.llm.queries import op10_quality_rules
from lexweave.llm.rules import BUCKETS, SMOOTHING, THRESHOLD, judged, log_ratios

SF = "/root/testdata/sf0.01"


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text):
    w = words_of(text)
    return [spark_hash(x) % BUCKETS for x in w] + [spark_hash(*x) % BUCKETS for x in zip(w, w[1:])]


def counts(text):
    w = words_of(text)
    runs = list(zip(w, w[1:], w[2:]))
    times = Counter(runs)
    covered = {i + j for i, r in enumerate(runs) if times[r] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def judged_by_force(docs, trusted):
    raw, own = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in trusted:
            own.update(grams(t))
    share = sum(own.values()) / max(1, sum(raw.values()))
    ratio = [math.log((own[b] + SMOOTHING) / (raw[b] * share + SMOOTHING)) for b in range(BUCKETS)]
    out = []
    for d, t in docs:
        c, g = counts(t), grams(t)
        score = sum(ratio[b] for b in g) / max(1, len(g)) if own else 0.0
        bad = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((d, *c, bad, not bad and score >= THRESHOLD, round(score, 6)))
    return Counter(out)


def result(rows):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 6)) for r in rows)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op10_quality_rules(spark, SF).collect()
    assert result(got) == judged_by_force(docs, {d for d, q in labels.items() if q == 1})
    # rarer words tell junk from text only where there are more of them
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = op10_quality_rules(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == docs.count()
    fine = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in got if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(r.kept for r in fine) >= 0.99 * len(fine) and sum(r.kept for r in junk) <= 0.15 * len(junk)


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (None, "a b c a b c " * 40), (4, "ünï cödé <b> | x\nline\n\nline\n line"),
        (5, " ".join(f"w{i}" for i in range(60))), (5, " ".join(f"w{i}" for i in range(60))), (6, "y " * 100_000),
        (7, "a b c d e f g a b c x " + " ".join(f"v{i}" for i in range(60))), (8, "a b\x0bc"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_words int, _target int")
    target = spark.createDataFrame([(5,), (5,), (None,), (7,)], "doc_id long")
    assert result(judged(docs, log_ratios(docs, target)).collect()) == judged_by_force(rows, {5, 7})
    none = judged(docs, log_ratios(docs, target.limit(0))).collect()
    assert {r.score for r in none} == {0.0}
    assert judged(docs.limit(0), log_ratios(docs.limit(0), target)).count() == 0
