"""Shared plumbing of the training-data operators: shared storage, byte views of text, ragged numpy helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")

#: Bytes of text that one vectorised step holds at most (a single longer text is one step of its own).
STEP_BYTES = 1 << 20
#: Bytes that a worker holds before it writes them to a table.
GROUP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, where unset, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets no Arrow batch grow beyond ``most`` bytes, as ten thousand long texts would; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= most:
        spark.conf.set(key, str(most))


_parents: set[str] = set()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the driver ends."""
    context = spark.sparkContext
    parent = f"{shared_dir(spark)}/quern-{context.applicationId}"
    if parent not in _parents:
        path = context._jvm.org.apache.hadoop.fs.Path(parent)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _parents.add(parent)
    return f"{parent}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by_workers(df: DataFrame, tag: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema: str | StructType | None = None) -> DataFrame:
    """``df``, or its ``mapInArrow(run, schema)``, as a Parquet table in the shared folder that the Python workers write, read back.

    What ``run`` makes doesn't pass through the JVM, and no executor starts a command for each file, as Hadoop does on local
    folders (chmod). File names are unique to a task attempt and only what a finished task reported is read. The folder must be
    one pyarrow opens; a null struct whose fields may not be null is refused.
    """
    spark, schema = df.sparkSession, schema or df.schema
    path = shared_path(spark, tag)
    store, folder = pafs.FileSystem.from_uri(path)
    store.create_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        name, out, held = f"part-{uuid.uuid4().hex}.parquet", None, []
        for batch in run(batches):
            if out is None:
                out = pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=store, compression="zstd")
            held.append(batch)
            if sum(x.nbytes for x in held) > GROUP_BYTES:
                out.write_table(pa.Table.from_batches(held))
                held = []
        if out is not None:
            if held:
                out.write_table(pa.Table.from_batches(held))
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    names = [r["name"] for r in df.mapInArrow(write, "name string").collect()]  # one for each task
    return spark.read.schema(schema).parquet(*(f"{path}/{x}" for x in names)) if names else spark.createDataFrame([], schema)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], name: str = "text", budget: int = STEP_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``budget`` bytes of text each, or one row.

    What ``per_worker`` made under other keys than ``keep`` goes first: workers outlive operators, their memory is bounded.
    """
    for key in [x for x in _made if x != keep]:
        del _made[key]
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + budget, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on, in one array."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


#: Byte table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def give_back() -> None:
    """Returns memory that this process has freed to the system, where the C library can: workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_made: dict[str, object] = {}


def per_worker(key: str, make: Callable[[], T]) -> T:
    """``make()``, kept by the worker process under a key until a task of another operator runs there."""
    if key not in _made:
        _made[key] = make()
    return _made[key]
