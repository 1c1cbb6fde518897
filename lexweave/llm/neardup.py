"""Near-duplicate classes from DartMinHash signatures and exact verification.

A text is the multiset of its five-word runs. Darts are thrown into the region
(weight x rank) of every element by a hashed Poisson process; each dart falls on one
of ``k`` coordinates and a coordinate keeps its earliest dart, so two texts agree on
a coordinate with their weighted Jaccard similarity as probability. Only darts below
a rank bound of about ``k ln k / weight`` are thrown, which costs the number of
elements plus ``k ln k``, whatever ``k`` is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm import words as W
from lexweave.llm.tables import components, small_enough, text_of
from lexweave.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 8
#: Texts of one group that a task compares with each other at a time.
BLOCK = 512
#: Up to so many candidate texts (two longs each) are broadcast to the scan of the texts; more are joined by a shuffle.
SMALL_ROWS = 1_000_000


def dart_signatures(
    doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = 7
) -> np.ndarray:
    """n_docs x k earliest ranks (inf in every place of a text without elements).

    ``doc`` is sorted; (doc, code) are distinct; ``weight`` is positive. Each unit of an
    element's weight is a cell with its own Poisson process along the rank; a last
    partial cell keeps the darts whose hashed weight lies below its part.
    """
    out = np.full((n_docs, k), np.inf)
    whole = np.floor(weight).astype(np.int64)
    part = weight - whole
    cells = whole + (part > 0)
    at = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    keep_below = np.where(cell < whole[at], 1.0, part[at])
    state = W.mix(code[at] ^ W.mix(cell.astype(np.uint64) + np.uint64(seed << 32)))
    cell_doc = doc[at]
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    bound = np.zeros(n_docs)
    has = total > 0
    bound[has] = k * (np.log(k) + 2.0) / total[has]
    todo = has.copy()
    while todo.any():
        act = np.flatnonzero(todo[cell_doc])
        rank = np.zeros(len(act))
        j = 0
        flat = out.reshape(-1)
        while len(act):
            h = W.mix(state[act] + np.array([j + 1], np.uint64) * W.BASE)
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            below = rank < bound[cell_doc[act]]
            act, rank, h = act[below], rank[below], h[below]
            g = W.mix(h ^ np.uint64(0xD1B54A32D192ED03))
            hit = ((g >> np.uint64(11)).astype(np.float64) * 2.0**-53) < keep_below[act]
            place = cell_doc[act[hit]] * k + (W.mix(g) % np.uint64(k)).astype(np.int64)[hit]
            np.minimum.at(flat, place, rank[hit])
            j += 1
        todo &= np.isinf(out).any(axis=1)
        bound[todo] *= 2
    return out


def signatures_of(texts: pa.Array, k: int, size: int) -> np.ndarray:
    """Signatures of a slice of texts."""
    doc, code, weight = W.multiset(*W.shingles(W.split(texts), size))
    return dart_signatures(doc, code, weight, len(texts), k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands 64-bit keys; equal keys mean equal darts on all rows of the band."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.full((len(signature), bands), np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for r in range(rows):
        key = W.mix(key * W.BASE + bits[:, :, r])
    return key.view(np.int64)


def banded(nodes: DataFrame, *, bands: int, rows: int, size: int) -> DataFrame:
    """(node, bands) of every row with a word; ``nodes`` has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in W.slices(texts):
                sign = signatures_of(texts.slice(lo, hi - lo), bands * rows, size)
                some = np.flatnonzero(~np.isinf(sign[:, 0]))
                keys = band_keys(sign[some], bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1))
                        ),
                    ],
                    names=["node", "bands"],
                )

    return nodes.mapInArrow(run, "node long, bands array<long>")


def linked(texts: list[str], names: list[int], side: np.ndarray | None, size: int, threshold: float) -> list[tuple]:
    """Spanning edges (u, v) of the pairs of similarity ``threshold`` or more.

    With ``side`` (0 or 1 for each text) only pairs of different sides are compared.
    Similarity is the exact weighted Jaccard of the multisets; one text at a time is
    marked and met with all others, so the work is texts x elements and no pair is kept.
    """
    doc, code, weight = W.multiset(*W.shingles(W.split(pa.array(texts, pa.string())), size))
    _, code = np.unique(code, return_inverse=True)
    n = len(texts)
    first = np.searchsorted(doc, np.arange(n + 1))
    total = np.bincount(doc, weights=weight, minlength=n)
    root = np.arange(n)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1)
    edges = []

    for i in range(n - 1 if side is None else n):
        own = slice(first[i], first[i + 1])
        if first[i] == first[i + 1] or (side is not None and side[i]):
            continue
        mark[code[own]] = weight[own]
        common = np.minimum(mark[code], weight)
        shared = np.bincount(doc, weights=common, minlength=n)
        mark[code[own]] = 0
        alike = shared >= threshold * (total + total[i] - shared) - 1e-9
        others = np.flatnonzero(alike & (total > 0) & ((np.arange(n) > i) if side is None else (side == 1)))
        for j in others:
            if root[i] != root[j]:
                edges.append((names[i], names[j]))
                root[root == root[j]] = root[i]
    return edges


def compared(groups: DataFrame, marks: DataFrame, *, block: int) -> DataFrame:
    """(node, root): the sets of nodes inside which all pairs are to be compared.

    ``groups`` has (node, root) of the chained band hits, ``marks`` (node, bands). A group is
    compared as a whole where that is the cheaper way. Hits by chance chain groups whose
    texts mostly have nothing in common; such a group of more than ``block`` texts is
    compared bucket by bucket, so its work follows its hits and not its square. Buckets of
    equal members are one set. Either way every pair that shares a band is compared.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = cut_lineage(groups.join(small_enough(sizes, SMALL_ROWS), "root"))
    if large.isEmpty():
        return groups
    found = marks.join(small_enough(large, SMALL_ROWS), "node").dropDuplicates(["node"])
    hits = found.select("node", "root", "n", F.explode(F.array_distinct("bands")).alias("band"))
    mix = F.xxhash64("node").cast("decimal(38,0)")
    buckets = hits.groupBy("root", "band").agg(F.first("n").alias("n"), F.count("*").alias("m"), F.sum(mix).alias("mix"))
    buckets = buckets.where("m > 1").groupBy("root", "m", "mix").agg(F.min("band").alias("band"), F.first("n").alias("n"))
    work = F.sum(F.col("m").cast("double") * F.col("m"))
    split = buckets.groupBy("root").agg(F.first("n").alias("n"), work.alias("work")).where("work < double(n) * n").select("root")
    split, buckets = cut_lineage(split), cut_lineage(buckets.select("root", "band"))
    whole = groups.join(small_enough(split, SMALL_ROWS), "root", "left_anti").select("node", "root")
    chosen = buckets.join(small_enough(split, SMALL_ROWS), "root", "left_semi")
    parts = hits.select("root", "band", "node").join(small_enough(chosen, SMALL_ROWS), ["root", "band"])
    return whole.union(parts.select("node", F.xxhash64("root", "band").alias("root")))


def verified_edges(members: DataFrame, *, size: int, threshold: float, block: int) -> DataFrame:
    """Spanning edges of similar texts inside each group; ``members`` has (node, root, text).

    A group of more than ``block`` texts is cut into parts and every pair of parts is a
    task of its own, so no task holds more than two parts and all pairs are compared
    without existing as rows. Small groups share tasks.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = members.join(small_enough(sizes, SMALL_ROWS), "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    total = members.count()
    buckets = max(1, total // 256)
    one = F.pmod(F.xxhash64("root"), F.lit(buckets))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda j: F.struct(F.least("part", j).alias("a"), F.greatest("part", j).alias("b")),
    )
    tasks = placed.withColumn("pair", F.explode(pairs)).select(
        F.when(F.col("parts") == 1, one).otherwise(F.xxhash64("root", "pair")).alias("task"),
        "root", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "part", "node", "text",
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, a, b), own in rows.groupby(["root", "a", "b"], sort=True):
            own = own.sort_values("node")
            side = None if a == b else (own["part"].to_numpy() == b).astype(int)
            found += linked(own["text"].tolist(), own["node"].tolist(), side, size, threshold)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return tasks.groupBy("task").applyInPandas(run, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """One row (id_col, node, class_id, class_size, is_kept) for each row of ``docs``.

    ``node`` is the 64-bit hash of the text, ``class_id`` the smallest id of the class,
    ``class_size`` the number of its rows; ``is_kept`` marks the rows that carry that id
    and the smallest such text. Classes are the connected components of the pairs of
    similarity ``threshold`` or more; equal texts are one node, so copies never make
    pairs. At 40 bands of 8 rows a pair of similarity 0.8 is met with probability
    0.9994, one of 0.85 with 0.999996; pairs of 0.2, as documents that share a passage
    have, meet once in 10,000.

    Null text counts as empty. A text without a word is alone in its class. Repeated
    rows are copies of each other (all carry ``is_kept`` if they share the smallest id).
    A null id stays null; a class has a null ``class_id`` only if all its ids are null.
    An empty table gives no rows; other columns are not looked at.
    """
    text = text_of(docs, text_col)
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("node"), text.alias("text"), worded.alias("worded"))
    marks = cut_lineage(banded(base.select("node", "text"), bands=bands, rows=rows, size=size))
    keys = marks.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    candidates = keys.join(shared, "band").where("node <> lo").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    groups = cut_lineage(compared(cut_lineage(components(candidates)), marks, block=block))
    members = (
        base.select("node", "text").join(small_enough(groups, SMALL_ROWS), "node").groupBy("node", "root").agg(F.first("text").alias("text"))
    )
    edges = verified_edges(cut_lineage(members), size=size, threshold=threshold, block=block)
    classes = components(edges)
    ids = base.groupBy("node", "id").agg(F.count("*").alias("n"), F.bool_or("worded").alias("worded"))
    ids = ids.join(small_enough(cut_lineage(classes), SMALL_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    alone = ~F.col("worded")
    # written, so that a class of very many ids is a join key that Spark can split
    tops = cut_lineage(
        ids.where(~alone).groupBy("root")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("top"), F.sum("n").alias("class_size"))
    )
    out = ids.join(tops, "root", "left")
    out = out.select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_copy"),
        F.col("id").alias(id_col),
        "node",
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        F.when(alone, F.lit(True))
        .otherwise(F.col("id").eqNullSafe(F.col("top.id")) & (F.col("node") == F.col("top.node")))
        .alias("is_kept"),
    )
    return out.drop("_copy")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class; the columns stay as they are.

    Of rows repeated in id and text one stays; rows without a word all stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where("is_kept").groupBy(id_col, "node").agg(F.count("*").alias("__lw_n"), F.max("class_size").alias("__lw_size"))
    kept = kept.select(F.col(id_col).alias("__lw_id"), F.col("node").alias("__lw_node"), "__lw_n", "__lw_size")
    named = docs.withColumn("__lw_node", F.xxhash64(text_of(docs, text_col))).alias("d")
    joined = named.join(kept.alias("k"), F.col(f"d.{id_col}").eqNullSafe(F.col("k.__lw_id")) & (F.col("d.__lw_node") == F.col("k.__lw_node")))
    marked = joined.select("d.*", "k.__lw_n", "k.__lw_size")
    single = marked.where("__lw_n = 1 OR __lw_size = 1")
    repeated = marked.where("__lw_n > 1 AND __lw_size > 1").dropDuplicates(["__lw_node"])
    return single.union(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
