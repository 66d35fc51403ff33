"""The corpus pipeline: five stages, each over all rows that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe_reuse, decontam, quality_pu, simhash, substring
from quern.llm.common import small_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts share one score and go or stay together; rows with null or repeated ids are judged by their own
    texts; an empty table gives an empty one; all columns stay as they are.
    """
    small_batches(spark)
    return quality_pu.keep_good(docs, quality_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Null ids come last; of equal ids the smaller digest of the text comes first; null and empty texts are one text. Rows of
    one id with texts that aren't similar are documents of their own and stay. All columns stay; an empty table gives an empty
    one.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the later ones.

    No row goes; ``n_chars`` counts anew where a text was cut. Null and empty texts and rows without an id stay as they are;
    rows of one id with different texts are cut each by its own passages; an empty table gives an empty one.
    """
    small_batches(spark)
    return substring.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; single windows are cut out of the others.

    Null and empty texts hold nothing and stay; repeated rows and null ids are treated by their own texts; benchmark rows
    without an id or a text are not looked for; an empty table gives an empty one.
    """
    small_batches(spark)
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids of what is left, and the digests of ids and decoded text, a row for each document.

    Null and empty texts have no ids; null and repeated ids give their rows; an empty table gives an empty one.
    """
    small_batches(spark)
    return bpe_reuse.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL cannot express fitted scores, XXH64 fingerprints or BPE; tests compare with a brute-force run.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
