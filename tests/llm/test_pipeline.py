"""The pipeline stage by stage against the brute-force versions of its operators, and edge cases."""

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexweave.llm.quality import fit_quality, quality_scores
from lexweave.session import cut_lineage
from tests.llm.test_decontam import leaks_by_force
from tests.llm.test_neardup import classes_by_force
from tests.llm.test_packing import check_pieces

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "surrogates", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = rows_of(docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality_scores(docs.select("doc_id", "text"), fit_quality(docs, labels)).collect()}

    one = cut_lineage(stage["quality"](spark, docs, SF))
    assert one.columns == COLUMNS and rows_of(one) == Counter({r: n for r, n in start.items() if scores[r[0]] >= 0.3})
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & {r[0] for r in rows_of(one)}) >= 0.97 * len(good)

    two = cut_lineage(stage["near_duplicates"](spark, one, SF))
    classes = classes_by_force([(r[0], r[1]) for r in rows_of(one)])
    assert two.columns == COLUMNS and rows_of(two) == Counter({r: n for r, n in rows_of(one).items() if classes[r[0]] == r[0]})

    three = cut_lineage(stage["decontamination"](spark, two, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in leaks_by_force([(r[0], r[1]) for r in rows_of(two)], items)}
    gone = {r[0] for r in rows_of(two)} - {r[0] for r in rows_of(three)}
    assert three.columns == COLUMNS and leaks and len(gone & leaks) >= 0.95 * len(leaks) and gone <= leaks

    four = cut_lineage(stage["surrogates"](spark, three, SF))
    real = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b", re.I)
    old, new = ({r[0]: r for r in rows_of(x)} for x in (three, four))
    assert four.columns == COLUMNS and old.keys() == new.keys()
    known = {m for r in old.values() for m in real.findall(r[1])}
    for d, r in new.items():
        assert r[4] == len(r[1]) and not known & set(real.findall(r[1]))
        assert real.findall(old[d][1]) or r == old[d]

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*slow.encode(r[1], add_special_tokens=False).ids, 0] for d, r in new.items()}
    check_pieces(stage["packing"](spark, four, SF).collect(), want)
    check_pieces(corpus_pipeline.run(spark, SF).collect(), want)


def test_edge_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some text x@y.com", None, "b", 17), (3, "word " * 60_000, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "k", 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, _node int, _score double")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != "packing":
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
                assert out.count() <= df.count()
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).count() == 5
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).where("doc_id = 2").count() == 2
