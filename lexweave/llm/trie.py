"""The prefix trie of conversations, found from the leaves up by truncation peeling.

Level by level from the longest conversation to the root, the nodes that survive from the
level below, stripped of their last turn, meet the conversations that end here; what is
then equal is one node, and its sums are complete. A node is the path of 128-bit hashes of
its turns, so texts are read once. All sums combine in the map tasks: a first turn that a
third of all conversations share costs a row per task. Every level is one aggregation over
its own nodes, written to the shared folder. A conversation enters at a depth from which on
it is alone, found by counting its prefixes at doubling depths; the nodes below come from
its row. So there are at most twice as many rounds as conversations share turns, however
long the longest is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm import words as W
from lexweave.session import cut_lineage

#: Turns after which a conversation may leave the common levels.
FIRST = 8
#: Ids that one row stands for on the way to a node's digest.
PIECE = 4096
#: Children from which a node is joined to them by a broadcast; at most nodes / HOT are.
HOT = 100_000
_NOTHING = hashlib.sha256(b"").hexdigest()
_PATH = "array<struct<k1:bigint,k2:bigint,n_bytes:bigint>>"


def turns_of(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id_col, turns): the turns of each conversation in order, as (k1, k2, n_bytes) of role and text.

    Turns are ordered by ``turn_col`` (null first), ties by role and text. Null roles and
    texts count as empty; rows of a null id belong to no conversation. A conversation must
    fit in a row.
    """
    said = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = conversations.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(said)).alias("said"))
    hashed = F.transform("said", lambda x: F.struct(
        F.xxhash64(x["role"], x["text"]).alias("k1"), F.xxhash64(F.lit(7), x["role"], x["text"]).alias("k2"),
        F.octet_length(x["text"]).cast("long").alias("n_bytes"),
    ))
    return grouped.select(id_col, hashed.alias("turns"))


def replayed(turns: DataFrame, *, id_col: str = "conv_id", family: int = 5, most: int = 8) -> DataFrame:
    """``turns`` with each conversation begun by the first turns of the first of its family.

    Conversation c begins with the first h turns of conversation c - c % ``family`` and goes
    on with its own after h, where h is the CRC-32 of c's decimals modulo ``most`` + 1.
    """
    c = F.col(id_col)
    head = turns.where(c % family == 0).select(c.alias("_base"), F.slice("turns", 1, most).alias("_head"))
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    own = turns.select(id_col, "turns", (c - c % family).alias("_base"), h.alias("_h")).join(head, "_base", "left")
    begun = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast(_PATH))
    return own.select(id_col, F.concat(begun, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def chained(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(c, path, depth): element d of ``path`` names the first d + 1 turns and adds up their bytes.

    The name is the sum of the turns' hashes, each mixed with its place, in two 64-bit halves.
    """
    schema = "c long, path " + _PATH + ", depth int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets, size = offsets - offsets[0], np.diff(offsets)
            flat = lists.flatten()
            place = (np.arange(len(flat)) - np.repeat(offsets[:-1], size) + 1).astype(np.uint64)
            columns = []
            for i, name in enumerate(("k1", "k2", "n_bytes")):
                x = flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                x = x if name == "n_bytes" else W.mix(x ^ W.mix(place + np.uint64(i << 40)))
                sums = np.cumsum(x, dtype=np.uint64)
                base = np.append(np.uint64(0), sums)[offsets[:-1]]
                columns.append(pa.array((sums - np.repeat(base, size)).view(np.int64)))
            paths = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["k1", "k2", "n_bytes"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), paths, pa.array(size, pa.int32())], names=["c", "path", "depth"])

    return turns.select(F.col(id_col).cast("long").alias("c"), F.coalesce("turns", F.array().cast(_PATH)).alias("turns")).mapInArrow(run, schema)


def entering(whole: DataFrame) -> DataFrame:
    """The different paths of ``whole`` (c, path, depth) with the depth ``enter`` at which each enters the peeling.

    Below it no other path shares its turns, so the nodes there are its own and need no
    grouping. Whether a path is alone is asked at FIRST, twice FIRST and so on: a key that
    one path has is alone, so no hot key is ever joined.
    """
    paths = cut_lineage(whole.groupBy("depth", "path").agg(F.min("c").alias("c"), F.count("*").alias("n_convs")))
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.call_function("shiftleft", F.lit(FIRST), i)), lambda p: p <= F.col("depth"))
    asked = paths.where(F.col("depth") >= FIRST).select("c", "path", F.explode(steps).alias("at"))
    asked = asked.select("c", "at", F.get("path", F.col("at") - 1).alias("key"))
    alone = asked.groupBy("at", "key.k1", "key.k2").agg(F.count("*").alias("n"), F.min("c").alias("c")).where("n = 1")
    enter = alone.groupBy("c").agg(F.min("at").alias("enter"))
    return paths.join(enter, "c", "left").withColumn("enter", F.coalesce("enter", "depth"))


def digests(ends: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of each group's ids, ascending, in decimals joined by commas.

    Ids are sorted by ranges, so a hot group is spread over tasks that write it out in
    pieces; one task then hashes a group's pieces as they pass.
    """
    order = [*keys, id_col]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(r[:-1]), r[-1]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for key, group in groupby(rows, lambda r: r[0]):
            ids: list[int] = []
            for _, i in group:
                ids.append(i)
                if len(ids) == PIECE:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
            if len(out) >= PIECE:
                yield _batch(out, [*order, "ids"])
                out = []
        if out:
            yield _batch(out, [*order, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(r[: len(keys)]), r[-1]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for key, group in groupby(rows, lambda r: r[0]):
            digest = hashlib.sha256()
            for n, (_, ids) in enumerate(group):
                digest.update((b"," if n else b"") + ids.encode())
            out.append((*key, digest.hexdigest()))
            if len(out) >= PIECE:
                yield _batch(out, [*keys, "ends_sha256"])
                out = []
        if out:
            yield _batch(out, [*keys, "ends_sha256"])

    columns = ", ".join(f"{k} long" for k in order)
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"{columns}, ids string")
    return cut.repartition(*keys).sortWithinPartitions(*order).mapInArrow(hashed, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string() if n in ("ids", "ends_sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def prefix_trie(turns: DataFrame, *, id_col: str = "conv_id", hot: int = HOT) -> DataFrame:
    """One row (id_col, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    ``turns`` has one row per conversation: an integer id and its turns as ``turns_of`` gives
    them. A node is a distinct sequence of first turns, the root that of none. ``id_col`` is
    its smallest member, parent_``id_col`` its parent's (null at the root), ``n_convs`` its
    members, ``n_leaves`` the childless nodes of its subtree (itself included),
    ``saved_tokens`` the sum over its subtree of (members - 1) times the bytes of the last
    text, ``ends_sha256`` that of the members that end here.

    Conversations without turns end at the root. Equal conversations share all nodes. An
    empty table has no nodes, not even a root. Other columns are not looked at.
    """
    whole = cut_lineage(chained(turns, id_col))
    paths = cut_lineage(entering(whole).repartitionByRange("enter", "path").sortWithinPartitions("enter"))
    bytes_upto = lambda d: F.coalesce(F.get("path", d - 1)["n_bytes"], F.lit(0).cast("long"))
    spare = F.col("n_convs") - 1
    tail = F.col("enter") < F.col("depth")
    begins = paths.select(
        "enter", F.slice("path", F.lit(1), F.col("enter")).alias("path"), "c", "n_convs", tail.cast("long").alias("n_children"),
        tail.cast("long").alias("n_leaves"), (spare * (bytes_upto(F.col("depth")) - bytes_upto(F.col("enter")))).alias("saved"),
    )
    # nodes that one path has to itself come straight from its row
    d = F.col("d")
    own = paths.where(tail).withColumn("d", F.explode(F.sequence(F.col("enter") + 1, F.col("depth")))).select(
        d.cast("long").alias("depth"), F.get("path", d - 1)["k1"].alias("k1"), F.get("path", d - 1)["k2"].alias("k2"), "c", "n_convs",
        (d < F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        (spare * (bytes_upto(F.col("depth")) - bytes_upto(d - 1))).alias("saved"), F.col("c").alias("parent"),
    )
    deepest = paths.agg(F.max("enter")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(deepest or 0, -1, -1):
        here = begins.where(F.col("enter") == depth).drop("enter")
        if levels:
            here = here.union(
                levels[-1].select(F.slice("path", 1, depth).alias("path"), "c", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")
            )
        met = here.groupBy("path").agg(F.min("c").alias("c"), *[F.sum(s).alias(s) for s in ("n_convs", "n_children", "n_leaves", "saved")])
        own_bytes = bytes_upto(F.size("path")) - bytes_upto(F.size("path") - 1)
        levels.append(
            cut_lineage(
                met.select(
                    "path", "c", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
                    (F.col("saved") + spare * own_bytes).alias("saved"),
                )
            )
        )

    def key(place: Column) -> list[Column]:
        return [F.coalesce(F.get("path", place)[k], F.lit(0)) for k in ("k1", "k2")]

    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    (k1, k2), (p1, p2) = key(F.size("path") - 1), key(F.size("path") - 2)
    # one table for the joins, so that their plan does not grow with the depth
    nodes = cut_lineage(
        nodes.select(F.size("path").cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "c", "n_convs", "n_children", "n_leaves", "saved")
    )
    ends = whole.select(F.col("depth").cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), "c")
    up = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent"), "n_children")
    on = ["depth", "p1", "p2"]
    near = nodes.join(F.broadcast(up.where(F.col("n_children") >= hot).drop("n_children")), on, "left")
    far = near.where("parent IS NULL AND depth > 0").drop("parent").join(up.where(F.col("n_children") < hot).drop("n_children"), on)
    linked = near.where("parent IS NOT NULL OR depth = 0").unionByName(far).drop("p1", "p2").unionByName(own)
    return linked.join(digests(ends, ["depth", "k1", "k2"], "c"), ["depth", "k1", "k2"], "left").select(
        F.col("c").alias(id_col), "depth", F.col("parent").alias(f"parent_{id_col}"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )
