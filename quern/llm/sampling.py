"""Bounded samples of rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bucket_of

#: Rows whose bucket is this one of so many are held out: no label of theirs is ever learned.
BUCKETS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, BUCKETS) == HELD_OUT


def smallest(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct ids that aren't held out, those with the smallest hashes."""
    own = ids.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return own.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents with those ids; ids come from ``smallest``, so their number is bounded.

    Of rows that share an id, the text with the smallest digest stands for them, however many they are.
    """
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one")).select("doc_id", "one.text")
