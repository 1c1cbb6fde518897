"""The prefix trie against plain Python on the tables and on hand-made rows."""

import hashlib
import random
import zlib

import pytest

from lexweave.llm.trie import digests, prefix_trie, replayed, turns_of

SF = "/root/testdata/sf0.01"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def plain(paths):
    """Node -> row, by going over every prefix of every conversation."""
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    rows = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(all(m[: len(n)] != n or m == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in own if paths[c] == node)))
        up = min(members[node[:-1]]) if node else None
        rows.add((min(own), len(node), up, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def run(spark, rows, **args):
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in prefix_trie(replayed(turns_of(talk)), **args).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_query_against_sql(spark, same_as_sql):
    assert same_as_sql(spark, "op11_prefix_trie", SF) > 100


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = [
        (c, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é"]))
        for c in range(60)
        for _ in range(rng.randrange(1, 7))
    ]
    assert run(spark, rows) == plain(rebuilt(rows))


def test_hot_turn_copies_and_broadcast_parents(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t < 2 or c % 3 else f"own {c}") for c in range(200) for t in range(4)]
    want = plain(rebuilt(rows))
    assert run(spark, rows) == want == run(spark, rows, hot=2)


def test_edge_cases(spark):
    long = "é" * 200_000
    rows = [(5, None, None, None), (6, 0, "user", "x"), (6, 0, "user", "x"), (6, 0, "user", "a"), (None, 0, "user", "lost"), (7, 1, "user", long), (12, 0, "x", "y")]
    rows += [(20, t, "user", f"t{t}") for t in range(40)]
    assert run(spark, rows) == plain(rebuilt(rows))
    assert run(spark, []) == set()
    talk = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    assert {tuple(r) for r in prefix_trie(replayed(turns_of(talk))).collect()} == plain(rebuilt(rows))
    # a conversation without turns of its own after h, and none to begin with
    assert any(c == () for c in rebuilt(rows).values())


def test_digest_of_a_large_group(spark):
    ids = spark.range(20_000).selectExpr("1L AS k", "id AS c").union(spark.createDataFrame([(2, 7)], "k long, c long"))
    found = {r.k: r.ends_sha256 for r in digests(ids.repartition(7), ["k"], "c").collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}
