"""Packing: every id once, no gaps, mixtures within bounds, edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import packing
from lexweave.llm.packing import encoder, pack, round_robin, schedule, sequences
from lexweave.llm.queries import op1_packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_pieces(rows, want, length=1024):
    """Every id of every document in one piece; sequences full but for the last."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or (s == len(by_seq) - 1 and at < length)
    assert sorted(by_doc, key=str) == sorted(want, key=str)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            own = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(own) if "ids_crc32" in r else bytes(r.ids) == own
            at += r.length
        assert at == len(ids)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    slow = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: [*slow.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs}
    check_pieces(op1_packing(spark, sf).collect(), want)


def test_windows_keep_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    pieces = pack(docs, path=PATH, ranks=RANKS).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    share = pieces.groupby("source").length.sum() / pieces.length.sum()
    table = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).iloc[:-3]
    so_far = table.cumsum()
    deficit = np.outer(np.arange(1, len(table) + 1) * 1024, share[table.columns]) - so_far.to_numpy()
    assert np.abs(deficit[: int(len(table) * 0.8)]).max() < 6 * 64
    whole = sequences(pack(docs, path=PATH, ranks=RANKS)).toPandas()
    assert (whole.ids.map(len) == 4 * whole.n_tokens).all() and (whole.n_tokens == 1024).sum() >= len(whole) - 1


def test_two_thousand_sources_keep_their_shares(spark):
    """Beyond the queues of their own, too, no source strays from its share by more than a few documents."""
    rows = [(i, "word " * (20 + i % 7), f"s{min(i % 2000, (i * 7919) % 3001)}") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").orderBy("source").repartition(1)
    pieces = pack(docs, path=PATH, ranks=RANKS).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert pieces.source.nunique() == 2000 and pieces.length.sum() == pieces.drop_duplicates("doc_id").doc_tokens.sum()
    total = pieces.length.sum()
    whole = total // 1024 - 260 * 64 // 1024 - 1  # windows before the last tokens of the queues
    pieces["at"] = pieces.sequence_id * 1024 + pieces.offset
    worst = 0.0
    for _, own in pieces.sort_values("at").groupby("source"):
        ends = (np.arange(whole) + 1) * 1024
        done = np.append(0, np.cumsum(own.length.to_numpy()))[np.searchsorted(own["at"].to_numpy(), ends)]
        worst = max(worst, np.abs(done - ends * own.length.sum() / total).max())
    assert worst < 300  # documents have 21 to 27 tokens, grains 64


def test_targets(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    pieces = pack(docs, path=PATH, targets={"a": 3.0, "b": 1.0}).toPandas()
    first = pieces[pieces.sequence_id < 6]
    a = first[first.doc_id % 2 == 0].length.sum() / first.length.sum()
    assert abs(a - 0.75) < 0.02
    assert pieces.length.sum() == pieces.drop_duplicates("doc_id").doc_tokens.sum()


@pytest.mark.parametrize("weights", [[5], [1, 1000, 3], [7, 0, 9, 16], [1] * 50])
def test_round_robin_is_a_permutation(weights):
    places = round_robin(np.array(weights), 16)
    assert [len(p) for p in places] == weights
    assert sorted(np.concatenate(places)) == list(range(sum(weights)))
    for s, p in enumerate(places):
        got = np.searchsorted(p, np.arange(0, sum(weights) + 1, 16))
        assert np.abs(got - np.arange(0, sum(weights) + 1, 16) * weights[s] / sum(weights)).max() < 2


def test_schedule_deals_everything():
    full = np.array([100_003, 7, 0, 45_000, 33_333])
    for share in (None, np.array([1.0, 0, 1, 2, 5])):
        blocks = schedule(full, share, 16, period=512)
        for s, n in enumerate(full):
            assert sum(len(b.places[s]) * b.repeats for b in blocks) == n
        end = 0
        for b in blocks:
            assert b.base == end and sorted(np.concatenate(b.places)) == list(range(b.period))
            end += b.repeats * b.period
        assert end == full.sum()


@pytest.mark.parametrize("held", [packing.HELD, 0])
@pytest.mark.parametrize(
    "full, period",
    [
        ([900_000, *range(200, 450)], packing.PERIOD),
        ([400_000 // (i + 1) for i in range(100)], packing.PERIOD),
        ([50_001] * 20, packing.PERIOD),
        ([90_000, 3, 1, 0, 777, *range(1, 40)], 256),
    ],
)
def test_every_window_keeps_the_mixture(monkeypatch, full, period, held):
    """Many small queues and many periods: no window to the very end departs from the targets."""
    monkeypatch.setattr(packing, "HELD", held)
    full = np.array(full)
    total, window = int(full.sum()), 16
    places = [[] for _ in full]
    for b in schedule(full, None, window, period):
        for s, own in enumerate(b.places):
            laps = np.arange(b.repeats)[:, None] * b.period
            places[s].append((b.base + laps + np.asarray(own)[None]).ravel())
    places = [np.concatenate(p) for p in places]
    assert (np.sort(np.concatenate(places)) == np.arange(total)).all()
    ends = np.arange(0, total + 1, window)
    for s, p in enumerate(places):
        assert len(p) == full[s] and (np.diff(p) > 0).all()
        assert np.abs(np.searchsorted(p, ends) - ends * full[s] / total).max() < 6


def test_encoders_agree():
    texts = ["", "  a\n\tb ", "Ünï 12345 don't", "x<|endoftext|>y", "a" * 5000, "​日本語 🎉"]
    assert [encoder(PATH, RANKS)(t) for t in texts] == [encoder(PATH, None)(t) for t in texts]


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "hello", "a"), (3, "long text " * 20_000, "b"), (4, "<|endoftext|>", "b")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, length string, queue int")
    slow = Tokenizer.from_file(PATH)
    want = {d: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for d, t, _ in rows}
    check_pieces(pack(docs, path=PATH, ranks=RANKS).collect(), want)
    check_pieces(pack(docs, path=PATH, max_queues=1, length=64, grain=16).collect(), want, 64)
    repeated = pack(docs.where("doc_id = 2").union(docs.where("doc_id = 2")), path=PATH).collect()
    assert [(r.length, r.offset) for r in sorted(repeated, key=lambda r: r.offset)] == [(1, 0), (1, 1)]
    assert pack(docs.limit(0), path=PATH).count() == 0
