"""Fingerprints against a plain Python version, likeness of near texts, and the edge cases."""

import hashlib

import regex
import xxhash
from pyspark.sql import functions as F

from lexweave.llm.imatch import edited_fingerprints, fingerprints, lexicon, likeness
from lexweave.llm.queries import op12_imatch_fingerprints

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def term(word):
    return signed(xxhash.xxh64_intdigest(word.encode(), 42))


def terms_of(text):
    return {term(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def printed(text, band, subsets=32):
    terms = terms_of(text)
    level = max(subsets.bit_length() - 1, (max(len(terms) - 1, 1)).bit_length() - 1)
    sample = sorted(t for t in terms if t in band and t % (1 << level) < subsets)
    parts = [f"{chained(sorted(terms)):x}", str(level)]
    for bits in (level, level + 1):
        groups = [[t for t in sample if t % (1 << bits) == s] for s in range(subsets)]
        parts.append(",".join(f"{chained(g):016x}"[-8:] if g else "" for g in groups))
    return ":".join(parts)


def alike(x, y):
    a, b = (p.split(":") for p in (x, y))
    levels = [{int(p[1]) + i: p[2 + i].split(",") for i in (0, 1)} for p in (a, b)]
    common = levels[0].keys() & levels[1].keys()
    if not common:
        return 0.0
    pairs = [z for k in common for z in zip(levels[0][k], levels[1][k]) if any(z)]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else float(a[0] == b[0])


def plain(rows):
    """Rows (id, text) of different ids, by the rules of the contract."""
    texts = [t or "" for _, t in rows]
    df = {}
    for t in texts:
        for w in terms_of(t):
            df[w] = df.get(w, 0) + 1
    least, most = max(2, len(rows) ** 0.1), max(2, 0.5 * len(rows))
    band = {w for w, n in df.items() if least <= n <= most}
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        take = len(text) // 3
        edited = text[: len(text) - take] + after[:take]
        own, changed, other = (printed(t, band) for t in (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, alike(own, changed), alike(own, other))
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op12_imatch_fingerprints(spark, SF).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert abs(got[i][4] - w[4]) < 1e-12 and abs(got[i][5] - w[5]) < 1e-12


def test_near_texts_are_alike(spark):
    rows = edited_fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.99 * len(long)
    assert sum(r.near_edited for r in long) / len(long) > 0.3 and sum(r.near_next for r in long) / len(long) < 0.05


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words * 300)
    rows = [(1, None), (2, ""), (3, " ,;"), (4, "one two three"), (4, "one two three"), (4, "one two four"), (None, "one two three"), (None, None), (7, long), (8, long.upper()), (9, "日本 🎉 ßΑ")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, fingerprint string")
    got = edited_fingerprints(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 4 for r in got) == 3 and sum(r.doc_id is None for r in got) == 2
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    empty = by[1][0].fingerprint
    assert by[2][0].fingerprint == empty == by[3][0].fingerprint and by[1][0].near_next in (0.0, 1.0)
    assert by[1][0].n_chars == 0 and by[1][0].edited_sha256 == hashlib.sha256(b"").hexdigest() and by[1][0].near_edited == 1.0
    assert by[7][0].fingerprint == by[8][0].fingerprint and by[8][0].near_next == 1.0
    assert edited_fingerprints(docs.limit(0)).count() == 0
    one = edited_fingerprints(docs.where("doc_id = 9")).first()
    assert one.near_next == 1.0
    same = [r for r in got if r.doc_id == 4]
    assert len({r.fingerprint for r in same}) == 2


def test_lexicon_band_and_joins(spark):
    docs = spark.createDataFrame([(i, f"all half{i % 2} few{i // 3} own{i}") for i in range(12)], "doc_id long, text string")
    found = {r.term: r.n for r in lexicon(docs).collect()}
    assert found == {term("half0"): 6, term("half1"): 6} | {term(f"few{i}"): 3 for i in range(4)}
    keyed = docs.withColumn("other", F.lit(None).cast("string"))
    two = [
        fingerprints(keyed, lexicon(docs), key_cols=["doc_id"], text_cols=["text", "other"], small_rows=n).orderBy("doc_id").collect()
        for n in (100, 0)
    ]
    assert two[0] == two[1] and len(two[0]) == 12
    crossed = fingerprints(keyed, lexicon(docs), key_cols=["doc_id"], text_cols=["text", "other"])
    assert {r[0] for r in crossed.select(likeness(F.col("text"), F.col("text"))).collect()} == {1.0}
    assert {r[0] for r in crossed.select(likeness(F.col("text"), F.col("other"))).collect()} == {0.0}
