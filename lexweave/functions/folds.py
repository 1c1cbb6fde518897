"""Running-length folds over the paragraphs or blocks of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import strip

# Fixed values of block packing.
MAX_CHARS = 1_500
MIN_CHARS = 200
TAIL_CHARS = 50


def pack_paragraphs(
    paragraphs: Column, sep: str, *, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, tail_chars: int = TAIL_CHARS
) -> Column:
    """Join paragraphs into blocks: a block closes when the next paragraph would
    pass ``max_chars`` and it holds ``min_chars``. A last block under
    ``tail_chars`` leaves. array<string>."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        cut = (F.length(acc["cur"]) + F.length(p) > max_chars) & (F.length(acc["cur"]) >= min_chars)
        done = F.when(cut, F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"])
        base = F.when(cut, F.lit("")).otherwise(acc["cur"])
        cur = F.when(base == "", p).otherwise(F.concat(base, F.lit(sep), p))
        return F.struct(done.alias("done"), cur.alias("cur"))

    def finish(acc: Column) -> Column:
        last = strip(acc["cur"])
        return F.when(F.length(last) >= tail_chars, F.array_append(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(paragraphs, start, step, finish)


def pack_whole(text: Column, sep: str, max_chars: int = 3_000) -> Column:
    """Plain packing: a block closes when it is not empty and would pass the limit."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        cut = (F.length(acc["cur"]) + F.length(p) + len(sep) > max_chars) & (F.length(acc["cur"]) > 0)
        done = F.when(cut, F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(F.when(cut, "").otherwise(acc["cur"]), p, F.lit(sep)).alias("cur"))

    def finish(acc: Column) -> Column:
        return F.when(strip(acc["cur"]) != "", F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"])

    return F.aggregate(F.split(text, sep), start, step, finish)


BLOCK = "array<struct<heading:string,content:string,hint:string>>"


def merge_small(blocks: Column, sep: str = "\n\n", min_chars: int = MIN_CHARS) -> Column:
    """A block under ``min_chars`` joins the next one, whose heading stays; its
    hint fills a missing one. ``blocks`` is array<(heading, content, hint)>."""
    none = F.lit(None).cast("string")
    blank = F.struct(none.alias("heading"), none.alias("content"), none.alias("hint"))
    start = F.struct(F.array().cast(BLOCK).alias("done"), blank.alias("wait"))

    def step(acc: Column, b: Column) -> Column:
        wait = acc["wait"]
        body = F.when(wait["content"].isNull(), b["content"]).otherwise(F.concat(wait["content"], F.lit(sep), b["content"]))
        joined = F.struct(b["heading"].alias("heading"), body.alias("content"), F.coalesce(b["hint"], wait["hint"]).alias("hint"))
        small = F.length(body) < min_chars
        return F.struct(
            F.when(small, acc["done"]).otherwise(F.array_append(acc["done"], joined)).alias("done"),
            F.when(small, joined).otherwise(blank).alias("wait"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["wait"]["content"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["wait"]))

    return F.aggregate(blocks, start, step, finish)
