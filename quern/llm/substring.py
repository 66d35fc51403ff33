"""Repeated passages: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text is cut where the hash of the last WINDOW bytes is the single largest within RADIUS bytes, moved to the next white
space. Cuts depend only on the bytes around them, so a passage has the same chunks in every text that holds it, whatever
was inserted before it. The first occurrence of a chunk, by doc_id and place, is kept; later ones in runs of at least
MIN_BYTES go. Each task settles the repeats among its own chunks first, so a passage that half the corpus holds sends one
row for each block of text into the shuffle instead of one for each copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import steps, text_bytes
from quern.llm.gear import peaks

#: Chunks have over RADIUS and about 2 * RADIUS bytes; passages shorter than MIN_BYTES of whole chunks stay.
RADIUS, WINDOW, MIN_BYTES = 16, 16, 100
#: Chunks among which a task settles repeats before the shuffle.
BLOCK = 1 << 20
#: Bytes that a cut moves at most to reach white space.
REACH = 64

_WHITE = np.isin(np.arange(256), [*range(9, 14), 32])


def cuts_of(texts: list[bytes], radius: int = RADIUS, window: int = WINDOW) -> list[np.ndarray]:
    """For each text the offsets at which its chunks begin and end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = peaks(data, radius, window)
    owner = np.searchsorted(ends, at, "right")
    begin = ends - sizes
    inside = (at - begin[owner] >= window - 1 + radius) & (ends[owner] - at > radius)
    at, owner = at[inside] + 1, owner[inside]
    blank = np.flatnonzero(_WHITE[data]) + 1
    blank = np.append(blank, len(data) + REACH + 1)
    moved = blank[np.searchsorted(blank, at)]
    far = moved - at > REACH
    near = at[far]
    while len(near):  # no white space in reach: the next whole character
        split = (near < len(data)) & (data[np.minimum(near, len(data) - 1)] & 0xC0 == 0x80)
        if not split.any():
            break
        near = near + split
    moved[far] = near
    ok = moved < ends[owner]
    cuts, owner = moved[ok] - begin[owner[ok]], owner[ok]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(np.r_[0, cuts[a:b], n]) for a, b, n in zip(bounds, bounds[1:], sizes, strict=False)]


def digests(text: bytes, cuts: np.ndarray) -> list[int]:
    at = cuts.tolist()
    return [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(at, at[1:], strict=False)]


#: Of ``state``: the chunk may be a first occurrence; the same, and the block holds repeats of it; a repeat for certain.
FIRST, FIRST_REPEATED, REPEAT = 0, 1, 2


def settle(digest: np.ndarray, doc: np.ndarray, version: np.ndarray, start: np.ndarray, state: np.ndarray) -> np.ndarray:
    """New states of chunk occurrences sorted by digest, document, version and place. Rows of one same place count once."""
    if not len(digest):
        return state
    fresh = np.r_[True, digest[1:] != digest[:-1]]
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    later = (doc != doc[first[group]]) | (version != version[first[group]]) | (start != start[first[group]])
    repeated = np.maximum.reduceat(np.where(later, REPEAT, state), first) > FIRST
    return np.where(later, REPEAT, np.where(repeated[group], FIRST_REPEATED, FIRST))


_OCCURRENCE = ["key", "digest", "doc_id", "version", "start", "stop", "state"]


def repeated_chunks(docs: DataFrame, *, radius: int = RADIUS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, start, stop, digest, state`` of every chunk that occurs at two places or more (byte offsets).

    ``version`` is a digest of the document's text: rows of one id with other texts are places of their own. ``state`` is
    FIRST_REPEATED for the occurrence that stays and REPEAT for the others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def block() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            digest, doc, version, start, stop = (x[order] for x in columns)
            state = settle(digest, doc, version, start, np.zeros(len(digest), np.int64))
            # what is a repeat for certain needs no meeting with its digest and spreads by its place
            key = np.where(state == REPEAT, doc * np.int64(1_000_003) + start, digest)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, digest, doc, version, start.astype(np.int64), stop.astype(np.int64), state)], names=_OCCURRENCE)

        for batch in steps(batches):
            texts, ids, versions = text_bytes(batch), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = cuts_of(texts, radius, window)
            made = np.array([d for text, own in zip(texts, cuts, strict=True) for d in digests(text, own)], np.uint64).view(np.int64)
            counts = [len(x) - 1 for x in cuts]
            held.append((made, np.repeat(ids, counts), np.repeat(versions, counts), np.concatenate([x[:-1] for x in cuts]), np.concatenate([x[1:] for x in cuts])))
            n += len(made)
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
                if n < 1 << 16:
                    continue
            if not held:
                continue
            columns = [np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(len(_OCCURRENCE))]
            done = n if batch is None else int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
            held = [pa.RecordBatch.from_arrays([pa.array(x[done:]) for x in columns], names=_OCCURRENCE)]
            n -= done
            _, digest, doc, version, start, stop, state = (x[:done] for x in columns)
            out = state.copy()
            open_ = np.flatnonzero(state != REPEAT)
            out[open_] = settle(digest[open_], doc[open_], version[open_], start[open_], state[open_])
            kept = np.flatnonzero(out > FIRST)
            if len(kept):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[kept]) for x in (doc, version, start, stop, digest)), pa.array(out[kept].astype(np.int32))], names=["doc_id", "version", "start", "stop", "digest", "state"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version")).where("doc_id is not null and text <> ''")
    chunks = rows.mapInArrow(cut, "key long, digest long, doc_id long, version long, start long, stop long, state long")
    dealt = chunks.repartition("key").sortWithinPartitions("key", "digest", "doc_id", "version", "start")
    return dealt.mapInArrow(meet, "doc_id long, version long, start long, stop long, digest long, state int")


def runs(places: list[tuple[int, int]], min_bytes: int) -> list[tuple[int, int]]:
    """Joined spans of at least ``min_bytes`` from chunks sorted by place."""
    out: list[list[int]] = []
    for start, stop in places:
        if out and start <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out if b - a >= min_bytes]


def repeated_passages(docs: DataFrame, *, min_bytes: int = MIN_BYTES, **options) -> DataFrame:
    """One row for each document that holds a repeated passage: ``doc_id, version, repeats, removed, repeated_bytes, removed_bytes``.

    ``repeats`` lists the spans (byte offsets, start and stop) of repeated passages in the document, ``removed`` those that
    are not kept here because another place comes first. Null and empty texts and rows without an id hold none; rows that
    repeat an id and a text count once, rows of one id with different texts are documents apart, told by ``version`` (the
    text's xxhash64); an empty table gives an empty result; only the id and text columns are read.
    """
    chunk = F.struct("start", "stop", "state")
    by_doc = repeated_chunks(docs, **options).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(chunk)).alias("chunks"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, every, gone = [], [], []
            for n, chunks in enumerate(batch.column(2).to_pylist()):
                whole = runs([(c["start"], c["stop"]) for c in chunks], min_bytes)
                if whole:
                    held.append(n)
                    every.append([{"start": a, "stop": b} for a, b in whole])
                    gone.append([{"start": a, "stop": b} for a, b in runs([(c["start"], c["stop"]) for c in chunks if c["state"] == REPEAT], min_bytes)])
            sizes = [[sum(x["stop"] - x["start"] for x in row) for row in rows] for rows in (every, gone)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(held, pa.int64())) for i in (0, 1)), pa.array(every, span), pa.array(gone, span), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64())], names=["doc_id", "version", "repeats", "removed", "repeated_bytes", "removed_bytes"])

    kind = "array<struct<start:bigint,stop:bigint>>"
    return by_doc.mapInArrow(join, f"doc_id long, version long, repeats {kind}, removed {kind}, repeated_bytes long, removed_bytes long")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the spans; their ends are moved to whole characters."""

    def whole(at: int) -> int:
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    parts, at = [], 0
    for start, stop in spans:
        parts.append(text[at : whole(start)])
        at = whole(stop)
    return b"".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, *, length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` without the repeats of passages: all columns stay, ``text`` is cut and ``n_chars``, if present, counts anew.

    No row goes; a text that is a repeat as a whole ends up empty. Rows without an id keep their text, and so do rows that
    repeat the id and text of the place that is kept. Rows of one id with different texts are cut each by its own spans.
    """
    found = repeated_passages(docs, **options).where("removed_bytes > 0").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("removed").alias("__gone"))
    joined = docs.join(found, (docs["doc_id"] == found["__id"]) & (F.xxhash64(docs["text"]) == found["__version"]), "left").select(*docs.columns, "__gone")
    schema, text_at = docs.schema, docs.columns.index("text")
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            columns = batch.columns[:-1]
            gone = batch.column(batch.num_columns - 1)
            if gone.null_count < batch.num_rows:
                texts, sizes = columns[text_at].to_pylist(), columns[length_at].to_pylist() if length_at is not None else []
                for i, spans in enumerate(gone.to_pylist()):
                    if spans:
                        texts[i] = without(texts[i].encode(), [(x["start"], x["stop"]) for x in spans]).decode()
                        if sizes:
                            sizes[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if sizes:
                    columns[length_at] = pa.array(sizes, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(cut, schema)
