"""The operators and the pipeline, bound to the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.align import align, byte_side, piece_side
from lexweave.llm.chat import formatted, read_back, under_loss
from lexweave.llm.decontam import find_contaminated
from lexweave.llm.imatch import edited_fingerprints
from lexweave.llm.licenses import license_spans
from lexweave.llm.neardup import near_duplicates
from lexweave.llm.packing import pack
from lexweave.llm.pii import replace_pii
from lexweave.llm.quality import fit_quality, held_out, quality_scores
from lexweave.llm.rules import judged, log_ratios
from lexweave.llm.token_counts import token_counts
from lexweave.llm.trie import prefix_trie, replayed, turns_of
from lexweave.llm.warc import read_archives, to_records, write_archives
from lexweave.session import checkpoint_dir, cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, trees).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the packed documents under the 50k byte-level vocabulary, with their checksums."""
    import public_tokenizers

    vocabulary = {k: public_tokenizers.path(f"byte_bpe_50k.{v}") for k, v in (("path", "json"), ("ranks", "tiktoken"))}
    return pack(docs, **vocabulary).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return judged(docs, log_ratios(docs, trusted))


@query
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, key="corpus")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["is_phrase"])

    def labels(spans):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


@query
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    written = cut_lineage(write_archives(to_records(pages), folder))
    return read_archives(written.repartition(max(1, written.count()))).select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


SQL["op2_warc_archives"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
d AS (
  SELECT page_id, n, min(page_id) OVER (PARTITION BY hex) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
      ((('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS b32
  FROM h)
SELECT page_id, n AS payload_bytes, b32 AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""


def own_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = formatted(rows.union(own_conversation(spark)))
    back = text.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"),
        under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", F.col("first_bad").cast("long").alias("first_bad"),
    )
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "first_bad",
    )


_CONTROL = r"(?:\[\\*(?:SYS\]|/SYS\]|INST\]|/INST\]|OUT\]|ROLE\]|/ROLE\]|/TURN\])|<\\*/s>)"
SQL["op3_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, row_number() OVER w - 1 AS n, lag(role) OVER w AS before FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t AS (
  SELECT *, CASE coalesce(before, '') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role = 'user' ELSE before IS NULL AND role IN ('system', 'user') END AS in_order,
    length(text) + len(regexp_extract_all(text, '{_CONTROL}')) +
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
      ELSE 20 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars
  FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(in_order) AND arg_max(role, n) = 'assistant' AS valid,
  min(n) FILTER (NOT in_order) AS first_bad
FROM t GROUP BY conv_id
"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(replayed(turns_of(table(spark, sf_dir, "conversations"))))


SQL["op11_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
  SELECT c, o, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS b
  FROM own),
h AS (
  SELECT c, o, xor(list_reduce(b, lambda s, e: CASE WHEN e >= 0 THEN xor(s, e)
    ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM bits),
r AS (
  SELECT h.c, list_concat(coalesce(f.o, [])[1:h.h], h.o[h.h + 1:]) AS p
  FROM h LEFT JOIN own f ON f.c = h.c - h.c % 5),
n AS (
  SELECT p[1:d] AS k, d, min(c) AS c, count(*) AS n
  FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM r) GROUP BY ALL),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
v AS (
  SELECT n.*, coalesce(kids.n, 0) AS kids, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * octet_length(encode(n.k[n.d].t)) END AS own
  FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k),
sub AS (
  SELECT k, d, count(*) FILTER (kids = 0) AS leaves, sum(own) AS saved
  FROM (SELECT k[1:d1] AS k, d1 AS d, kids, own FROM (SELECT k, kids, own, unnest(range(0, d + 1)) AS d1 FROM v)) GROUP BY ALL),
e AS (SELECT p AS k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM r GROUP BY p)
SELECT v.c AS conv_id, v.d AS depth, up.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children,
  sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM v JOIN sub ON sub.d = v.d AND sub.k = v.k
LEFT JOIN n up ON up.d = v.d - 1 AND up.k = v.k[1:v.d - 1]
LEFT JOIN e ON e.k = v.k
"""


@query
def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, ranks, pieces = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    found, _ = align(table(spark, sf_dir, "documents"), lambda: byte_side(path, ranks), lambda: piece_side(pieces), n_a=50_257)
    return found
