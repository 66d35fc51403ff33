import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from quern.llm import common


def test_workers_write_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 100)  # many groups of rows
    kind = "id long, name string, parts array<struct<a:int,b:string>>"
    rows = [(i, None if i % 7 == 0 else f"n{i}", [(i, "é"), (None, None)][: i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, kind).repartition(5)
    got = common.written_by_workers(df, "whole")
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == sorted(rows)

    def twice(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": [2 * x for x in batch.column(0).to_pylist()]})

    assert sorted(r.x for r in common.written_by_workers(df, "twice", twice, "x long").collect()) == [2 * i for i in range(500)]


def test_workers_write_nothing_of_nothing(spark):
    got = common.written_by_workers(spark.createDataFrame([], "id long, name string"), "empty")
    assert got.dtypes == [("id", "bigint"), ("name", "string")] and got.count() == 0 and got.inputFiles() == []


def test_files_that_no_finished_task_reported_are_not_read(spark, monkeypatch):
    """A lost attempt of a task leaves its file beside the others."""
    path = common.shared_path(spark, "lost")
    folder = Path(path.removeprefix("file://"))
    monkeypatch.setattr(common, "shared_path", lambda *_: path)

    def run(batches):
        for batch in batches:
            pq.write_table(pa.table({"id": [-1]}), f"{folder}/part-{uuid.uuid4().hex}.parquet")
            yield batch

    got = common.written_by_workers(spark.range(20).repartition(2), "lost", run, "id long")
    assert sorted(r.id for r in got.collect()) == list(range(20)) and len(list(folder.iterdir())) > len(got.inputFiles())
