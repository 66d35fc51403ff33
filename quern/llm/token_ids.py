"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

A file holds documents in ascending doc_id order. Its ids are renumbered by their frequency in that file (the rank table
is in the header), so frequent ids take one byte; each value takes 1 to 4 data bytes and a 2-bit length in the control
bytes, four lengths a byte. Decoding looks the control bytes up in a 256-row numpy table and gathers all values at once.

Layout, little-endian: magic ``QTOK1`` and a byte that is 1 if there are documents without an id, which come first; int64
counts of documents, values and table entries, and in that case of those documents; the rank table (uint32 ids); doc ids
(int64); values per document (int64); control bytes; data bytes.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import per_worker, shared_path, steps, text_bytes
from quern.llm.pieces import PieceTable, load

MAGIC = b"QTOK1"
#: Values after which a file is closed, whatever its partition still holds.
FILE_VALUES = 4 << 20
#: Bytes of text that are encoded at a time: more of them share the cost of looking distinct pieces up.
STEP = 4 << 20

#: How many data bytes the four values of a control byte take.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values back, by table lookup of the control bytes."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").ravel()


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> bytes:
    """A whole file from the ids of its documents, one after the other; the first ``unnamed`` documents have no doc id."""
    often = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    table = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank = np.zeros(len(often), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = pack(rank[ids] if len(ids) else np.zeros(0, np.uint32))
    head = np.array([len(doc_ids), len(ids), len(table), *[unnamed] * (unnamed > 0)], "<i8").tobytes()
    return b"".join((MAGIC, bytes([unnamed > 0]), head, table.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data))


def decode_file(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc ids, values per document and all ids of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC) + 1

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, kind, n, at)
        at += part.nbytes
        return part

    n_docs, n_values, n_table, unnamed = (*(int(x) for x in take("<i8", 3 + data[at - 1])), 0)[:4]
    table, doc_ids, counts = take("<u4", n_table), take("<i8", n_docs), take("<i8", n_docs)
    control = take("u1", -(-n_values // 4)).tobytes()
    named = pa.array(doc_ids, pa.int64(), mask=np.arange(n_docs) < unnamed)
    return named, counts, table[unpack(control, data[at:], n_values)] if n_values else np.empty(0, np.uint32)


#: White space beyond the space that a split on spaces could meet next to one: ASCII bytes, and the UTF-8 of others.
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_OTHER = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_NEAR_OTHER = re.compile(rb" (?:%s)|(?:%s) " % ((rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf",) * 2))


def odd(text: bytes) -> bool:
    """Whether a space stands beside other white space."""
    data = np.frombuffer(text, np.uint8)
    white, space = _WHITE[data], data == 32
    if (white[1:] & space[:-1] | space[1:] & white[:-1]).any():
        return True
    return any(x in text for x in _OTHER) and bool(_NEAR_OTHER.search(text))


#: Bytes beside a line feed that are surely no white space: ASCII that prints, and after it the first byte of U+00C0 to U+00FF.
_PRINTS = np.isin(np.arange(256), range(33, 127))
_GOES_ON = _PRINTS | (np.arange(256) == 0xC3)


class TextEncoder:
    """Exact ids of whole texts under a byte-level tokenizer.

    Its pattern always starts a new pre-token at a space or a line feed between two characters that are no white space, so
    pieces cut before these have the ids they have inside the text. Texts with other white space beside a space go to the
    library whole; line feeds beside white space stay inside a piece.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.table = PieceTable(load(path), most)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids per text, and all ids one after the other."""
        self.table.room()
        edged = [x[:1] == b" " or x[-1:] == b" " for x in texts]
        plain = [True] * len(texts) if not (any(edged) or odd(b"\n".join(texts))) else [not (e or odd(x)) for e, x in zip(edged, texts, strict=True)]
        own = [x if ok else b"" for x, ok in zip(texts, plain, strict=True)]
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))]
        text = b"".join(own)
        data = np.frombuffer(text, np.uint8)
        begins = data == 32
        fed = np.flatnonzero(data[1:-1] == 10) + 1
        begins[fed[_PRINTS[data[fed - 1]] & _GOES_ON[data[fed + 1]]]] = True
        begins[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        starts = np.flatnonzero(begins)
        # the pieces lie side by side: only their offsets are made
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(text)])
        sizes, flat = self.table.ids(self.table.find(pieces))
        totals = np.diff(np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, bounds)])
        if all(plain):
            return totals, flat
        whole = iter(self.table.library([x.decode() for x, ok in zip(texts, plain, strict=True) if not ok]))
        parts = [own if ok else np.array(next(whole), np.uint32) for own, ok in zip(np.split(flat, np.cumsum(totals)[:-1]), plain, strict=True)]
        return np.array([len(x) for x in parts], np.int64), np.concatenate(parts)


def encoder(path: str) -> TextEncoder:
    """One per worker process."""
    return per_worker(f"bytes:{path}", lambda: TextEncoder(path))


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, *, end_id: int = 2, file_values: int = FILE_VALUES, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest ``part, seq, path, n_docs, n_values, before`` (itself a table in ``out_dir``).

    Documents are range-partitioned and sorted by id, so part and seq order the files. File names are unique to a task
    attempt and only what a finished task reported is in the manifest: files of lost or repeated attempts are ignored.
    ``out_dir`` must be a folder that executors share and pyarrow opens. Null and empty texts give the end id alone; a null
    id sorts first; repeated ids stand next to each other by their text's digest; an empty table writes
    no file. Only the id and text columns are read.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, folder = pafs.FileSystem.from_uri(out_dir)
        ids, counts, flats, held, before, unnamed = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.qtok"
            lengths = np.concatenate(counts)
            with store.open_output_stream(path) as out:
                out.write(encode_file(np.concatenate(ids), lengths, np.concatenate(flats), unnamed))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(lengths)], "n_values": [held], "before": [before]}, schema=_MANIFEST)

        for batch in steps(batches, budget=STEP, keep=f"bytes:{tokenizer}"):
            sizes, flat = encode(text_bytes(batch))
            ends = np.cumsum(sizes)
            ids.append(batch.column(0).fill_null(0).to_numpy())
            unnamed += batch.column(0).null_count
            counts.append(sizes + 1)
            flats.append(np.insert(flat, ends, end_id))
            held += len(flats[-1])
            if held >= file_values:
                yield close()
                ids, counts, flats, held, seq, before, unnamed = [], [], [], 0, seq + 1, before + held, 0
        if ids:
            yield close()

    store, folder = pafs.FileSystem.from_uri(out_dir)
    store.create_dir(folder)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    dealt = chosen.repartitionByRange(n, "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")  # one id may fill many parts
    done = dealt.mapInArrow(write, "part int, seq int, path string, n_docs long, n_values long, before long")
    done.write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema(done.schema).parquet(f"{out_dir}/manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_values", pa.int64()), ("before", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def read_token_files(manifest: DataFrame, out_dir: str, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) per document, from the files.

    The driver holds one number per part, as many as the files were partitioned into, to number their beginnings.
    """
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_values").alias("n")).collect()}
    begins, at = {}, 0
    for part in sorted(totals):
        begins[part], at = at, at + totals[part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(row["path"]) as source:
                    ids, counts, flat = decode_file(source.read())
                ends = np.cumsum(counts)
                data = flat.astype("<u4", copy=False)
                starts = begins[row["part"]] + row["before"] + ends - counts
                crcs = [zlib.crc32(data[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [ids, pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(data)).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=_READ.names[: len(columns)])

    files = manifest.repartition(max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def token_files(docs: DataFrame, tokenizer: str, *, out_dir: str | None = None, **options) -> DataFrame:
    """Encodes, writes and reads back: the rows of ``read_token_files``."""
    out_dir = out_dir or shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, out_dir, **options), out_dir)
