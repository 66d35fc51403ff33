"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z, so normalising is a byte table and a
split. Every window of ``width`` consecutive item words (a shorter item is one window) is a pattern of the automaton;
each document is scanned once, and pattern ends are mapped back to words and from there to offsets in the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import LOWER, per_worker, shared_path, steps, text_bytes, written

WIDTH = 8
#: Bytes of benchmark text in one automaton, which takes some 350 times as much memory. A larger benchmark is scanned for in
#: several blocks of this size.
BLOCK_BYTES = 1 << 18

_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
_SEPARATOR = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])

FOUND = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _key(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def patterns(items: list[tuple[str, bytes]], width: int) -> dict[str, tuple[int, list[int]]]:
    """Window text -> number of its words, and the positions in ``items`` of the items that hold it."""
    found: dict[str, tuple[int, list[int]]] = {}
    for n, (_, text) in enumerate(items):
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            part = words[i : i + width]
            owners = found.setdefault(_key(part), (len(part), []))[1]
            if not owners or owners[-1] != n:
                owners.append(n)
    return found


class Scanner:
    """The automaton over some items; ``scan`` gives hit word intervals and the items found."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.names = [name for name, _ in items]
        self.automaton = ahocorasick.Automaton()
        for key, value in patterns(items, width).items():
            self.automaton.add_word(key, value)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        if not words or not len(self.automaton):
            return [], set()
        text = b" " + b" ".join(words) + b" "
        ends, values = [], []
        for end, value in self.automaton.iter(text.decode("latin-1")):
            ends.append(end)
            values.append(value)
        if not ends:
            return [], set()
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        last = np.searchsorted(gaps, np.array(ends))  # the gap after the window's last word, that is its word count so far
        spans = sorted((int(e) - n, int(e)) for e, (n, _) in zip(last, values, strict=True))
        return merged(spans), {self.names[i] for _, owners in values for i in owners}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted half-open intervals."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in the original text where its words start and end."""
    apart = np.concatenate(([True], _SEPARATOR[np.frombuffer(text, np.uint8)], [True]))
    return np.flatnonzero(apart[:-1] & ~apart[1:]), np.flatnonzero(~apart[:-1] & apart[1:])


def store_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[str, int]:
    """A folder with the benchmark's distinct items in blocks of about ``block_bytes``, and how many blocks there are.

    Rows without an id or a text hold nothing to find. The driver sees the number of bytes alone.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("name is not null and text is not null").distinct()
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-held // block_bytes))
    path = shared_path(benchmark.sparkSession, "benchmark")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)).cast("int")).repartition(min(n, 200), "block")
    dealt.write.partitionBy("block").parquet(path)
    return path, n


def read_block(path: str, block: int) -> list[tuple[str, bytes]]:
    """Items of one block, in order of their names."""
    store, top = pafs.FileSystem.from_uri(path)
    items: list[tuple[str, bytes]] = []
    for info in store.get_file_info(pafs.FileSelector(f"{top}/block={block}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                found = pq.ParquetFile(file).read().to_pydict()
            items += [(name, text.encode()) for name, text in zip(found["name"], found["text"], strict=True)]
    return sorted(items)


_STATE = T.StructType([T.StructField("spans", T.ArrayType(FOUND)), T.StructField("items", T.ArrayType(T.StringType()))])
Finish = Callable[[pa.RecordBatch, list[tuple[int, list[tuple[int, int]], list[str]]]], pa.RecordBatch]


def scan_for(rows: DataFrame, text_col: str, benchmark: DataFrame, finish: Finish, schema: T.StructType, *, width: int, block_bytes: int, item_id: str, item_text: str) -> DataFrame:
    """``finish`` over batches of ``rows`` and what is found in each text: number of words, hit spans, item names.

    One narrow pass without a shuffle. A benchmark of several blocks takes a pass for each, with a table between them that
    keeps what was found, so that a task holds one automaton and one worker at a time.
    """
    path, n = store_blocks(benchmark, item_id, item_text, block_bytes)
    width_in = len(rows.columns)
    for block in range(n):
        last = block == n - 1

        def scan(batches: Iterator[pa.RecordBatch], block: int = block, last: bool = last) -> Iterator[pa.RecordBatch]:
            key = f"{path}/{block}"
            for batch in steps(batches, text_col, keep=key):
                scanner = per_worker(key, lambda: Scanner(read_block(path, block), width))
                before = batch.column(width_in).to_pylist() if block else [None] * batch.num_rows
                found = []
                for text, old in zip(text_bytes(batch, text_col), before, strict=True):
                    words = words_of(text)
                    spans, items = scanner.scan(words)
                    if old:
                        spans = merged(sorted(spans + [(x["start"], x["end"]) for x in old["spans"]]))
                        items = items.union(old["items"])
                    found.append((len(words), spans, sorted(items)))
                own = pa.RecordBatch.from_arrays(batch.columns[:width_in], names=batch.schema.names[:width_in])
                if last:
                    yield finish(own, found)
                else:
                    state = [{"spans": [{"start": a, "end": b} for a, b in spans], "items": items} if items else None for _, spans, items in found]
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(state, _ARROW_STATE)], names=[*own.schema.names, "__leaks"])

        rows = rows.mapInArrow(scan, schema if last else T.StructType([*rows.schema.fields[:width_in], T.StructField("__leaks", _STATE)]))
        rows = rows if last else written(rows, "leaks")
    return rows


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW_STATE = pa.struct([("spans", _SPANS), ("items", pa.list_(pa.string()))])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, text, n_words, spans, items``: per document the merged hit word intervals and the sorted item ids.

    ``keep_text=False`` gives null texts, which spares their way back from Python.

    Only the id and text columns are read, so extra columns with any name do no harm. Null and empty texts have no words and
    no hits; repeated rows each get their row; an empty benchmark finds nothing; items with a null id or text are not looked
    for.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(FOUND)), T.StructField("items", T.ArrayType(T.StringType()))])

    def finish(batch: pa.RecordBatch, found: list[tuple[int, list[tuple[int, int]], list[str]]]) -> pa.RecordBatch:
        n_words, spans, items = zip(*found, strict=True)
        text = batch.column(1) if keep_text else pa.nulls(batch.num_rows, pa.string())
        named = [[{"start": a, "end": b} for a, b in x] for x in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(n_words, pa.int64()), pa.array(named, _SPANS), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return scan_for(rows, "text", benchmark, finish, schema, width=width, block_bytes=block_bytes, item_id=item_id, item_text=item_text)


def leak_report(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 2, **options) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated (n_items >= min_items)."""
    found = find_leaks(docs, benchmark, keep_text=False, **options)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        total.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words in the spans, with one space where something went between two parts."""
    starts, ends = word_offsets(text)
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : starts[a]].rstrip(b" "))
        at = ends[b - 1]
    parts.append(text[at:].lstrip(b" "))
    return b" ".join(x for x in parts if x)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 2, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, length_col: str = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, and the others without the words that windows of one item cover.

    Documents with windows of at least ``min_items`` items go. All columns stay; ``n_chars``, if present, counts anew where
    a text was cut. Rows without hits, null texts among them, stay as they are; repeated rows are treated alike; an empty
    table gives an empty one and an empty benchmark changes nothing. One narrow pass, see ``scan_for``.
    """
    names = docs.columns
    at, length_at = names.index("text"), names.index(length_col) if length_col in names else None

    def finish(batch: pa.RecordBatch, found: list[tuple[int, list[tuple[int, int]], list[str]]]) -> pa.RecordBatch:
        if any(spans for _, spans, _ in found):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            sizes = columns[length_at].to_pylist() if length_at is not None else None
            for i, (_, spans, _) in enumerate(found):
                if spans:
                    texts[i] = cut_words(texts[i].encode(), spans).decode()
                    if sizes:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if sizes:
                columns[length_at] = pa.array(sizes, columns[length_at].type)
            batch = pa.RecordBatch.from_arrays(columns, names=names)
        return batch.filter(pa.array([len(items) < min_items for _, _, items in found], pa.bool_()))

    return scan_for(docs, "text", benchmark, finish, docs.schema, width=width, block_bytes=block_bytes, item_id=item_id, item_text=item_text)


def brute_force(docs: list[tuple[int, str | None]], benchmark: list[tuple[int, str | None]], width: int = WIDTH, min_items: int = 2) -> list[tuple]:
    """The report by direct search, for tests."""
    out = []
    for doc_id, text in docs:
        words, hit, names = words_of((text or "").encode()), set(), set()
        for item, body in benchmark:
            own = words_of((body or "").encode())
            if not own or item is None:
                continue
            n = min(width, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names.add(str(item))
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= min_items))
    return out
