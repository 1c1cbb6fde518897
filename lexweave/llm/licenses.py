"""License mentions by diagonal voting, in DataFrame functions alone.

Every run of ``GRAM`` words of every text is hashed and joined with the runs of the
templates. A hit at word p of the text and word q of a template lies on the diagonal
p - q; hits are summed by diagonal in the map tasks, neighbouring diagonals are merged
into one span, and spans are verified on the words of the text. Only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from lexweave.functions.text import let
from lexweave.llm.tables import row_key, text_of

# Phrases that count wherever their words stand together, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Wordings of public licenses and notices, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "the gnu general public license version 3"),
    ("gpl-2", "the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "the gnu lesser general public license"),
    ("agpl", "the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM = 3
#: Diagonals that may differ within one span: words left out or put in.
DRIFT = 3
#: Least part of a template's words that a span must hold, and least number of them.
COVER = 0.8


def words_of(text: Column) -> Column:
    """Words of a text: runs of letters and digits, A-Z lower-cased, everything outside ASCII as a letter."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams_of(words: Column, size: int) -> Column:
    """Array of (gram, own) for all runs of ``size`` words: hash and words; ``words`` is bound."""

    def one(w: Column, i: Column) -> Column:
        own = [w, *[F.get(words, i + j) for j in range(1, size)]]
        return F.struct(F.xxhash64(*own).alias("gram"), F.struct(*[x.alias(f"w{j}") for j, x in enumerate(own)]).alias("own"))

    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))), one)


def template_places(
    spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], size: int
) -> DataFrame:
    """(gram, places): where each run stands in the wordings, as (template, label, is_phrase, n, q, own).

    One row for each different hash, so a run of a text meets one row at most.
    """
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate([*phrases, *templates])]
    table = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, wording string")
    table = table.select("template", "label", "is_phrase", words_of(F.col("wording")).alias("words"))
    runs = table.select("*", F.posexplode(let(F.col("words"), lambda w: grams_of(w, size))).alias("q", "g"))
    place = F.struct("template", "label", "is_phrase", F.size("words").alias("n"), "q", F.col("g.own").alias("own"))
    return runs.groupBy(F.col("g.gram").alias("gram")).agg(F.collect_list(place).alias("places"))


def license_spans(
    docs: DataFrame, *, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None,
    id_col: str = "doc_id", text_col: str = "text", size: int = GRAM, drift: int = DRIFT, cover: float = COVER,
) -> DataFrame:
    """(id_col, n_words, spans): one row for each row of ``docs``.

    ``spans`` has (label, is_phrase, first, last, cover) for each verified span: word
    places of the text, and the part of the wording's words that stand there in runs. A
    phrase must stand as it is; a template may miss words, or have up to ``drift`` words
    more or fewer between its parts, while ``cover`` of its words are there. Wordings are
    a list of the caller's and thus bounded; those of fewer than ``size`` words are refused.

    Null text counts as empty and has no words and no spans; a null id stays null; rows
    repeated in id and text get equal rows; an empty table gives no rows; other columns
    are not looked at.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    for _, wording in [*phrases, *templates]:
        if len(wording.split()) < size:
            raise ValueError(f"fewer than {size} words: {wording}")
    text = text_of(docs, text_col)
    rows = docs.select(row_key(docs[id_col], text).alias("key"), docs[id_col].alias("id"), let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), grams_of(w, size).alias("g"))).alias("run"))
    # a first element without a run keeps the texts that have no hit
    none = F.array(F.lit(None).cast(rows.schema["run"].dataType["g"].dataType.elementType))
    every = rows.select("key", "id", F.col("run.n").alias("n_words"), F.posexplode(F.concat(none, "run.g")).alias("p", "g"))
    every = every.select("key", "id", "n_words", (F.col("p") - 1).alias("p"), F.col("g.gram").alias("gram"), F.col("g.own").alias("own"))
    places = template_places(docs.sparkSession, phrases, templates, size)
    met = every.join(F.broadcast(places), "gram", "left").where("p < 0 OR places IS NOT NULL")
    hits = met.select("key", "id", "n_words", "p", "own", F.explode_outer("places").alias("t")).where("p < 0 OR own = t.own")
    wording = ["key", "id", "n_words", "template", "label", "is_phrase", "n"]
    votes = (
        hits.select("key", "id", "n_words", "t.template", "t.label", "t.is_phrase", "t.n", "t.q", (F.col("p") - F.col("t.q")).alias("diagonal"))
        .groupBy(*wording, "diagonal")
        .agg(F.collect_set("q").alias("qs"), F.count("*").alias("votes"))
    )
    along = Win.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("is_phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > drift, F.lit(True))
    lines = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    spans = lines.groupBy(*wording, "span").agg(
        F.min(F.col("diagonal") + F.array_min("qs")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("qs") + (size - 1)).alias("last"),
        F.flatten(F.collect_list("qs")).alias("qs"),
        F.max("votes").alias("votes"),
    )
    stands = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (size - 1))))))
    spans = spans.withColumn("cover", stands / F.col("n"))
    good = F.col("cover") >= F.when(F.col("is_phrase"), 1.0).otherwise(cover)
    span = F.struct("label", "is_phrase", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "cover")
    out = spans.groupBy("key", "id", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("votes"))).alias("rows"),
        F.sort_array(F.collect_list(F.when(good, span))).alias("spans"),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return out.select(copies.alias("copy"), F.col("id").alias(id_col), "n_words", "spans").drop("copy")
