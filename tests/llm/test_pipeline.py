import importlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quern.llm import bpe_reuse, decontam, quality_pu, substring
from quern.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables")


def test_names_and_registration():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminate", "encode"]


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_pu.score(docs, quality_pu.train(docs, labels)).collect() if r.predicted}
    # quality: the same documents as the scores say
    step = corpus_pipeline.quality(spark, docs, SF).cache()
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == good
    # near-duplicates: one of each group of similar texts, found by comparing all pairs
    one = corpus_pipeline.near_duplicates(spark, step, SF).cache()
    assert {(r.doc_id, r.text) for r in one.collect()} == one_of_each([(r.doc_id, r.text) for r in step.collect()])
    assert one.columns == docs.columns and {r.doc_id: r.text for r in one.collect()}.items() <= rows.items()
    # repeated passages: no repeat is left that was found
    cut = corpus_pipeline.repeated_passages(spark, one, SF).cache()
    gone = {r.doc_id: [tuple(x) for x in r.removed] for r in substring.repeated_passages(one).collect()}
    for r in cut.collect():
        assert r.text == substring.without(rows[r.doc_id].encode(), gone.get(r.doc_id, [])).decode() and r.n_chars == len(r.text)
    # benchmark: nothing of it is left
    clean = corpus_pipeline.decontaminate(spark, cut, SF).cache()
    items = [(r.item_id, r.text) for r in bench.collect()]
    report = {r[0]: r for r in decontam.brute_force([(r.doc_id, r.text) for r in cut.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {d for d, r in report.items() if not r[5]}
    assert all(r[2] == 0 for r in decontam.brute_force([(r.doc_id, r.text) for r in clean.collect()], items))
    # encoding
    want = {tuple(r) for r in bpe_reuse.encode_decode(clean, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want and len(want) == clean.count()


def test_stages_keep_different_texts_of_one_id(spark):
    """Ids of ten documents each: whatever a stage takes away, it takes by the text, not by the id."""
    found = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").withColumn("doc_id", F.when(F.col("doc_id") % 13 > 0, F.col("doc_id") % 12))
    results = []
    for docs in (found, found.orderBy(F.desc("text")).repartition(5)):
        one = corpus_pipeline.near_duplicates(spark, docs, SF).cache()
        kept = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
        assert set(kept) == one_of_each([(r.doc_id, r.text) for r in docs.collect()]) and len(set(kept)) == len(kept)
        gone = {(r.doc_id, r.version): [tuple(x) for x in r.removed] for r in substring.repeated_passages(one).collect()}
        versions = {r.text: r.v for r in one.select("text", F.xxhash64("text").alias("v")).collect()}
        cut = corpus_pipeline.repeated_passages(spark, one, SF).cache()
        after = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
        want = [(d, None if t is None else substring.without(t.encode(), [] if d is None else gone.get((d, versions[t]), [])).decode()) for d, t in kept]
        assert after == sorted(want, key=str)
        results.append(after)
    assert results[0] == results[1]


def one_of_each(rows):
    """Rows (id, text) that stay: of each group of similar texts the smallest id, nulls last, then the smallest digest."""
    texts = sorted({t or "" for _, t in rows})
    sets = []
    for t in texts:
        words = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (not a | b or len(a & b) / len(a | b) >= 0.8):
                root = [root[j] if x == root[i] else x for x in root]
    group = dict(zip(texts, root))
    best = {}
    for d, t in rows:
        best.setdefault(group[t or ""], []).append((d is None, d or 0, t or "", (d, t)))
    return {min(x for x in own if x[:2] == min(y[:2] for y in own))[3] if len({x[2] for x in own if x[:2] == min(y[:2] for y in own)}) == 1 else by_digest(own) for own in best.values()}


def by_digest(own):
    from pyspark.sql import SparkSession

    least = [x for x in own if x[:2] == min(y[:2] for y in own)]
    df = SparkSession.getActiveSession().createDataFrame([(x[2],) for x in least], "text string").select("text", F.xxhash64("text").alias("v"))
    first = min((r.v, r.text) for r in df.collect())[1]
    return next(x[3] for x in least if x[2] == first)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_nulls_and_more_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumn("state", F.lit("s")).withColumn("items", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, "a", 2), (9000, None, "en", "x", 0, "b", 3), (9001, "", "en", "x", 0, "c", 4)], docs.schema)
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_entry_works_without_these_folders():
    """As when the folders are deleted: imports of them fail, the rest is there."""
    held = {n: m for n, m in sys.modules.items() if n.startswith("quern.llm") or n in ("corpus_pipeline", "__spark_entry__")}
    try:
        for n in held:
            del sys.modules[n]
        sys.modules["quern.llm"] = None
        sys.modules["corpus_pipeline"] = None
        fresh = importlib.import_module("__spark_entry__")
        assert fresh.queries() and not any(n.startswith("op") for n in fresh.queries()) and "pipeline" not in fresh.queries()
    finally:
        for n in ("quern.llm", "corpus_pipeline", "__spark_entry__"):
            sys.modules.pop(n, None)
        sys.modules.update(held)
