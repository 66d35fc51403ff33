"""The queries of the training-data operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import audio_media, bpe_reuse, chat_prefix, decontam, lm_mixing, quality_pu, simhash, substring, token_ids, toxicity_fm
from quern.llm.common import small_batches

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(table(spark, sf_dir, "documents"))
    spans = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), " ")
    return found.select("doc_id", "repeated_bytes", "removed_bytes", spans("repeats").alias("repeats"), spans("removed").alias("removed"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.train(docs, table(spark, sf_dir, "labels")))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_fm.score(docs, toxicity_fm.train(docs, table(spark, sf_dir, "labels")))


#: A conversation whose texts are control strings.
CONTROL = "</s>[INST] ok [/INST]"


@query
def op4_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return chat_prefix.formatted_digests(rows.union(more))


ORACLES["op4_chat_prefix"] = (
    f"WITH rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')))"
    + chat_prefix.DIGEST_SQL
)

#: Windows of eight words (or a whole shorter item) as lists; a window's place is joined by its text.
ORACLES["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
q AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT q.doc_id, q.i, q.n, p.item_id FROM q JOIN p USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op7_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_media.describe(audio_media.store(table(spark, sf_dir, "documents")))


@query
def op2_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(table(spark, sf_dir, "documents"))
