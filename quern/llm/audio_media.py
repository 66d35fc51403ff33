"""Media columns: bytes kept losslessly as 8-bit audio, and features computed from the stored form.

``store`` packs a payload (the UTF-8 text, padded with zero bytes to a positive multiple of 64) into a WAV file of unsigned
8-bit samples at RATE. ``analyse`` reads such bytes back, resamples them by UP / DOWN with a polyphase filter bank, takes
log-mel energies of overlapping frames, and marks loud segments with two thresholds: one to begin, a lower one to go on.
The energies, in half precision (steps of 0.06 dB at most, far below what 8-bit samples resolve), are cut into tiles of FRAMES
x MELS with the time span each covers, kept as Arrow fixed-shape tensors.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_path, steps, text_bytes, written

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 12
WINDOW, HOP, MELS, FRAMES = 256, 128, 32, 64
#: Decibels above the median energy at which a loud segment begins, and above which it goes on.
BEGIN_DB, STAY_DB = 3.0, 1.0
#: Frames that are transformed at a time.
BLOCK = 4096
_UNIT, _HEADER = 64, 44


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(_UNIT, -(-len(text) // _UNIT) * _UNIT) - len(text))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples' bytes of a file that ``to_wav`` made."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this layout")
    (n,) = struct.unpack("<I", media[40:_HEADER])
    if len(media) != _HEADER + n:
        raise ValueError("WAV file is cut short")
    return media[_HEADER:]


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase branches side by side, analysis window, mel filters."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    taps = np.sinc(t * cutoff) * cutoff * np.hamming(n) * UP
    bank = np.zeros((TAPS + DOWN, UP))
    for r in range(UP):  # output r of a block starts at input DOWN * r // UP with phase DOWN * r % UP
        bank[DOWN * r // UP : DOWN * r // UP + TAPS, r] = taps[DOWN * r % UP :: UP][::-1]
    rate = RATE * UP / DOWN
    mel = lambda f: 1127 * np.log1p(f / 700)
    edges = 700 * np.expm1(np.linspace(mel(40), mel(rate / 2), MELS + 2) / 1127)
    bins = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    mels = np.maximum(0, np.minimum(rise, fall))
    mels[np.searchsorted(bins, edges[1:-1]), np.arange(MELS)] += 1e-3  # narrow filters hold one bin at least
    return bank.astype(np.float32), np.hanning(WINDOW + 1)[:-1].astype(np.float32), mels.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times as many samples, rounded up to whole blocks of DOWN."""
    bank, _, _ = _filters()
    blocks = -(-len(x) // DOWN)
    padded = np.zeros(blocks * DOWN + len(bank), np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(bank))[: blocks * DOWN : DOWN]
    return (np.ascontiguousarray(windows) @ bank).ravel()


def log_mels(x: np.ndarray) -> np.ndarray:
    """Frames x MELS decibels, in blocks of bounded size. The last frame is filled up with zeros."""
    _, window, mels = _filters()
    n = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for a in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[a : a + BLOCK] * window, axis=1)
        out[a : a + BLOCK] = 10 * np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mels + np.float32(1e-10))
    return out


def loud_segments(energy: np.ndarray) -> np.ndarray:
    """(first frame, end frame) of segments that begin above one threshold and go on above the lower one."""
    middle = np.median(energy)
    mark = np.where(energy > middle + BEGIN_DB, 1, np.where(energy < middle + STAY_DB, -1, 0))
    known = np.where(mark != 0, np.arange(len(mark)), 0)
    state = mark[np.maximum.accumulate(known)] > 0
    edges = np.flatnonzero(np.diff(np.r_[False, state, False].astype(np.int8)))
    return edges.reshape(-1, 2)


@dataclass
class Analysis:
    mels: np.ndarray
    segments: np.ndarray

    def tiles(self) -> np.ndarray:
        """Tiles x FRAMES x MELS; the last one is filled up with silence."""
        n = -(-len(self.mels) // FRAMES)
        out = np.full((n * FRAMES, MELS), -100, np.float16)
        out[: len(self.mels)] = self.mels
        return out.reshape(n, FRAMES, MELS)

    def spans(self) -> np.ndarray:
        """Milliseconds that each tile covers."""
        first = np.arange(0, len(self.mels), FRAMES)
        return np.stack((milliseconds(first), milliseconds(np.minimum(first + FRAMES, len(self.mels)))), axis=1)

    def summary(self) -> str:
        """Number of frames, number and milliseconds of loud segments, and mean decibels by mel."""
        loud = milliseconds(self.segments[:, 1] - self.segments[:, 0]).sum()
        return f"{len(self.mels)};{len(self.segments)};{loud:.1f};" + ",".join(f"{x:.1f}" for x in self.mels.mean(0, dtype=np.float64))


def milliseconds(frames: np.ndarray) -> np.ndarray:
    return frames * (HOP * DOWN * 1000 / (RATE * UP))


def analyse(media: bytes) -> Analysis:
    samples = (np.frombuffer(from_wav(media), np.uint8).astype(np.float32) - 128) / 128
    mels = log_mels(resample(samples)).astype(np.float16)
    return Analysis(mels, loud_segments(mels.mean(1, dtype=np.float32)))


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a WAV file, written to the shared folder and read back.

    Null texts are empty, empty texts are one unit of zeros; repeated rows and null ids give their rows; only the id and text
    columns are read; an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = text_bytes(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([to_wav(payload_of(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` of stored media.

    The tiles of all media are written as tensors to the shared folder; ``feature`` is derived from what is read back.
    """
    kind = dict(media.dtypes)["doc_id"]
    out_dir = shared_path(media.sparkSession, "tensors")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = pafs.FileSystem.from_uri(out_dir)
        path, writer = f"{folder}/{uuid.uuid4().hex}.parquet", None
        for n, batch in enumerate(few_rows(steps(batches, "media"))):
            rows = []
            for data in text_bytes(batch, "media"):
                payload = from_wav(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-_UNIT:]), len(data), hashlib.sha256(data).hexdigest()))
            tiles = tensor_batch(batch.column(0), text_bytes(batch, "media"))
            # lossless; by byte streams the energies take about 0.6 of the disk that a dictionary's attempt takes
            writer = writer or pq.ParquetWriter(path, tiles.schema, filesystem=filesystem, compression="zstd", use_dictionary=False, column_encoding={"mels.list.element": "BYTE_STREAM_SPLIT"})
            writer.write_table(tiles, row_group_size=max(1, tiles.num_rows))
            where = [pa.array([path] * len(rows)), pa.array([n] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32())]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)), *where], names=[*_DESCRIBED[:-1], "path", "part", "row"])
        if writer:
            writer.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(out_dir)
        held: tuple[object, list[str]] = None, []
        for batch in batches:
            found = []
            for path, part, row in zip(*(batch.column(x).to_pylist() for x in ("path", "part", "row")), strict=True):
                if held[0] != (path, part):  # rows of one part lie side by side
                    with filesystem.open_input_file(path) as file:
                        held = (path, part), summaries(pq.ParquetFile(file).read_row_group(part))
                found.append(held[1][row])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(_DESCRIBED) - 1], pa.array(found, pa.string())], names=_DESCRIBED)

    facts = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    filesystem, folder = pafs.FileSystem.from_uri(out_dir)
    filesystem.create_dir(folder)
    # written: its rows are those of finished tasks, whose tensor files are whole
    manifest = written(media.mapInArrow(write, f"{facts}, path string, part int, row int"), "manifest")
    return manifest.mapInArrow(read, f"{facts}, feature string")


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` rows: each gives one tile at least, however short its text."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)


def summaries(tiles: pa.Table) -> list[str]:
    """The summaries of the media whose stored tiles and time spans these are, by row."""
    values = tiles["mels"].combine_chunks().to_numpy_ndarray()
    start, end, row = (tiles[x].to_numpy() for x in ("start_ms", "end_ms", "row"))
    frames = np.rint((end - start) / milliseconds(np.ones(1))).astype(np.int64)
    bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        mels = values[a:b].reshape(-1, MELS)[: frames[a:b].sum()]
        out.append(Analysis(mels, loud_segments(mels.mean(1, dtype=np.float32))).summary())
    return out


_DESCRIBED = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def tensor_batch(ids: pa.Array, media: list[bytes]) -> pa.Table:
    """``doc_id, row, tile, start_ms, end_ms, mels`` with a fixed-shape tensor column, one row for each tile.

    ``row`` is the place of the media in the list; null and repeated ids are kept as they are; an empty list gives no rows.
    """
    found = [analyse(x) for x in media]
    tiles = [x.tiles() for x in found]
    counts = [len(x) for x in tiles]
    spans = np.concatenate([x.spans() for x in found]) if found else np.empty((0, 2))
    values = np.concatenate(tiles) if tiles else np.empty((0, FRAMES, MELS), np.float16)
    at = pa.array(np.repeat(np.arange(len(ids)), counts))
    number = pa.array(np.concatenate([np.arange(n) for n in counts]) if counts else np.empty(0, np.int64), pa.int64())
    return pa.table({"doc_id": ids.take(at), "row": at, "tile": number, "start_ms": pa.array(spans[:, 0]), "end_ms": pa.array(spans[:, 1]), "mels": pa.FixedShapeTensorArray.from_numpy_ndarray(values)})


def write_tensors(media: DataFrame, out_dir: str) -> DataFrame:
    """Writes the tiles of stored media as Parquet files with tensor columns; returns their manifest ``path, tiles``.

    File names are unique to a task attempt, and readers go by the manifest: files of lost attempts are ignored. Null media
    are refused, as ``store`` makes none; null and repeated ids are kept; an empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = pafs.FileSystem.from_uri(out_dir)
        for batch in steps(batches, "media"):
            tiles = tensor_batch(batch.column(0), text_bytes(batch, "media"))
            path = f"{folder}/{uuid.uuid4().hex}.parquet"
            pq.write_table(tiles, path, filesystem=filesystem)
            yield pa.RecordBatch.from_pydict({"path": [path], "tiles": [tiles.num_rows]})

    filesystem, folder = pafs.FileSystem.from_uri(out_dir)
    filesystem.create_dir(folder)
    done = media.mapInArrow(run, "path string, tiles long")
    done.write.parquet(f"{out_dir}/manifest")
    return media.sparkSession.read.schema(done.schema).parquet(f"{out_dir}/manifest")
