"""License spans against plain Python, and the edge cases."""

import re
from collections import Counter

import pytest

from lexweave.llm.licenses import COVER, DRIFT, GRAM, PHRASES, TEMPLATES, license_spans
from lexweave.llm.queries import op8_license_scan

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def scan(text):
    w = words_of(text)
    base = [(i, label) for label, phrase in PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, covers = {label for _, label in base}, [1.0 for _ in base]
    runs = {}
    for i in range(len(w) - GRAM + 1):
        runs.setdefault(tuple(w[i : i + GRAM]), []).append(i)
    for label, wording in TEMPLATES:
        t = wording.split()
        lines = {}
        for q in range(len(t) - GRAM + 1):
            for p in runs.get(tuple(t[q : q + GRAM]), []):
                lines.setdefault(p - q, set()).add(q)
        spans, last = [], None
        for d in sorted(lines):
            if last is None or d - last > DRIFT:
                spans.append(set())
            last = d
            spans[-1] |= {q + j for q in lines[d] for j in range(GRAM)}
        for s in spans:
            if len(s) / len(t) >= COVER:
                labels.add(label)
                covers.append(len(s) / len(t))
    starts = [i for i, _ in base]
    return (
        len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
        ",".join(sorted(labels)), max(covers, default=0.0),
    )


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op8_license_scan(spark, SF)
    assert got.columns == COLUMNS
    got = Counter(tuple(r) for r in got.collect())
    assert got == Counter((d, *scan(t)) for d, t in docs)
    assert {"apache-2", "gpl-3", "cc-by-nc"} <= {x for r in got for x in r[6].split(",")}


def test_edits_drift_and_places(spark):
    mit = TEMPLATES[0][1].split()
    texts = [
        " ".join(mit), " ".join(mit[:12] + ["oh", "well"] + mit[12:]), " ".join(mit[:12] + mit[14:]), " ".join(mit[:15]),
        "CC BY-NC, cc by nc cc by nc", "x " * 3000 + " ".join(mit) + " y" * 3000 + " Under the MIT license " * 2, " ".join(reversed(mit)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_spans(docs).collect()}
    found = {d: {(s.label, s.is_phrase) for s in r.spans} for d, r in got.items()}
    assert found[0] == found[1] == found[2] == {("mit", False)} and found[3] == set() == found[6]
    assert [s.first for s in got[4].spans if s.is_phrase] == [0, 3, 6]
    assert [(s.first, s.last) for s in got[5].spans if not s.is_phrase] == [(3000, 3000 + len(mit) - 1)]
    assert got[1].spans[0].last == len(mit) + 1 and got[0].spans[0].cover == 1.0


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "cc by"), (None, "ünder the MIT license under the MIT LICENSE é"), (4, "cc by nc"), (4, "cc by nc"), (5, "cc by nc " * 30_000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, label string, p int, key int")
    got = Counter((r.doc_id, r.n_words, len(r.spans)) for r in license_spans(docs).collect())
    assert got == Counter({(1, 0, 0): 1, (2, 0, 0): 1, (3, 2, 0): 1, (None, 9, 1): 1, (4, 3, 1): 2, (5, 90_000, 30_000): 1})
    assert license_spans(docs.limit(0)).count() == 0
    assert {len(r.spans) for r in license_spans(docs, phrases=[], templates=[]).collect()} == {0}
    with pytest.raises(ValueError):
        license_spans(docs, phrases=[("x", "two words")])
