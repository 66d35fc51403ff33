"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a gear rolling hash of its last 32 bytes has nine leading zeros, so texts that share a passage share
its chunks wherever it stands. A worker encodes a chunk once and remembers it (in bounded memory; those that were met again
are kept longest). A cut may fall inside a word or a character: a chunk keeps the bytes before its first and after its last
white space apart, and every join is repaired by encoding the bytes that meet there anew, reaching on until white space stands
on both sides. Each repaired join is then encoded by the library together with the pieces beside it; where that disagrees with
the ids put together, the whole text is encoded instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import per_worker, steps, text_bytes
from quern.llm.gear import WINDOW, mask_cuts
from quern.llm.pieces import PieceTable, load

#: Leading zero bits at a cut: chunks have 2^BITS bytes on average.
BITS = 9
#: Pieces and chunks that a worker remembers at most.
MOST_PIECES, MOST_CHUNKS = 300_000, 40_000

#: ASCII white space as ``bytes.split`` takes it.
_WHITE = frozenset(b" \t\n\r\x0b\x0c")


class ChunkEncoder:
    """Encodes and decodes texts for one tokenizer file; it must lower-case and drop white space, as word-end BPE does."""

    def __init__(self, path: str, most_pieces: int = MOST_PIECES, most_chunks: int = MOST_CHUNKS, bits: int = BITS):
        self.table = PieceTable(load(path), most_pieces, lower=True, decode=True)
        self.most_chunks, self.bits = most_chunks, bits
        self.chunks: dict[bytes, list] = {}
        self.again: set[bytes] = set()
        self.reused = self.bytes_reused = self.joins = self.disagreed = 0

    def chunk(self, data: bytes, todo: list[bytes], fresh: list[list]) -> list:
        """[bytes before the first white space, whole pieces, bytes after the last white space] of a chunk.

        The pieces are their rows, or, until ``fill``, their place in ``todo``; they are None where there is no white space.
        """
        if found := self.chunks.get(data):
            self.reused += 1
            self.bytes_reused += len(data)
            self.again.add(data)
            return found
        pieces = data.split()
        head = pieces.pop(0) if pieces and data[0] not in _WHITE else b""
        if len(head) == len(data):
            entry = [head, None, b""]
        else:
            tail = pieces.pop() if pieces and data[-1] not in _WHITE else b""
            entry = [head, slice(len(todo), len(todo) + len(pieces)), tail]
            todo += pieces
            fresh.append(entry)
        self.chunks[data] = entry
        return entry

    def cut(self, text: bytes, cuts: list[int], todo: list[bytes], fresh: list[list]) -> list[list]:
        """The chunks of a text in order, and between them the repaired joins as entries of the same form."""
        parts, open_end = [], b""
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            entry = self.chunk(text[a:b], todo, fresh)
            open_end += entry[0]
            if entry[1] is None:  # no white space yet: the piece goes on in the next chunk
                continue
            if open_end:
                self.join(open_end, parts, todo, fresh)
            parts.append(entry)
            open_end = entry[2]
        if open_end:
            self.join(open_end, parts, todo, fresh)
        return parts

    def join(self, piece: bytes, parts: list[list], todo: list[bytes], fresh: list[list]) -> None:
        """What meets where chunks join is one piece, encoded anew."""
        entry = [b"", slice(len(todo), len(todo) + 1), None]
        todo.append(piece)
        fresh.append(entry)
        parts.append(entry)

    def room(self) -> None:
        """Forgets pieces and chunks beyond their bounds; a chunk goes with any of its pieces."""
        moved = self.table.room()
        if len(self.chunks) > self.most_chunks:
            kept = self.again if len(self.again) <= self.most_chunks // 2 else ()
            self.chunks = {x: self.chunks[x] for x in kept if x in self.chunks}
            self.again = set()
        if moved is not None:
            for data, entry in list(self.chunks.items()):
                if entry[1] is not None:
                    rows = moved[entry[1]]
                    if len(rows) and rows.min() < 0:
                        del self.chunks[data]
                    else:
                        entry[1] = rows

    def disagree(self, plans: list[list[list]], keys: list[bytes]) -> set[int]:
        """Texts with a repaired join that the library encodes otherwise, together with the pieces beside it.

        ``keys``: pieces by row.
        """
        where, windows, rows = [], [], []
        for n, parts in enumerate(plans):
            for i, entry in enumerate(parts):
                if entry[2] is None and len(parts) > 1:
                    own = [*(parts[i - 1][1][-1:] if i else ()), *entry[1], *(parts[i + 1][1][:1] if i + 1 < len(parts) else ())]
                    where.append(n)
                    windows.append(b" ".join(map(keys.__getitem__, own)).decode())
                    rows.append(own)
        if not where:
            return set()
        sizes, flat = self.table.ids(np.concatenate(rows))
        ends = np.cumsum(sizes)[np.cumsum([len(x) for x in rows]) - 1].tolist()
        bad, at = set(), 0
        flat = flat.tolist()
        for n, ids, end in zip(where, self.table.library(windows), ends, strict=True):
            if ids != flat[at:end]:
                bad.add(n)
            at = end
        self.joins += len(where)
        self.disagreed += len(bad)
        return bad

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Token ids and decoded bytes of each text."""
        self.room()
        ends = np.cumsum([len(x) for x in texts])
        cuts = mask_cuts(np.frombuffer(b"".join(texts), np.uint8), self.bits)
        todo: list[bytes] = []
        fresh: list[list] = []
        plans = []
        for text, end in zip(texts, ends.tolist(), strict=True):
            begin = end - len(text)
            own = cuts[np.searchsorted(cuts, begin + WINDOW) : np.searchsorted(cuts, end)] - begin
            plans.append(self.cut(text, own.tolist(), todo, fresh) if text else [])
        rows = self.table.find(todo)
        for entry in fresh:
            entry[1] = rows[entry[1]]
        bad = self.disagree(plans, list(self.table.rows))
        for n, parts in enumerate(plans):
            if n in bad:
                ids = self.table.library([texts[n].decode()])[0]
                yield np.array(ids, np.uint32), self.table.tokenizer.decode(ids, skip_special_tokens=False).encode()
                continue
            own = np.concatenate([x[1] for x in parts]) if parts else np.empty(0, np.int64)
            sizes, ids = self.table.ids(own)
            # a piece may have no ids at all (characters that the normaliser drops); it then adds nothing between blanks
            kept = own if sizes.all() else own[sizes > 0]
            yield ids, b" ".join(map(self.table.decoded.__getitem__, kept.tolist()))


def chunk_encoder(path: str) -> ChunkEncoder:
    """One per worker process."""
    return per_worker(f"words:{path}", lambda: ChunkEncoder(path))


def encode_decode(docs: DataFrame, tokenizer: str, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded``) of every text, without a shuffle.

    Null and empty texts have no ids and decode to the empty text. Ids and row order do not matter, so null or repeated
    ids give their rows; only the two named columns are read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer)
        for batch in steps(batches, keep=f"words:{tokenizer}"):
            n, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for own, text in encode(text_bytes(batch)):
                n.append(len(own))
                ids_hash.append(hashlib.sha256(own.astype("<u4", copy=False)).hexdigest())
                text_hash.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    ids.append(own.astype(np.int64))
                    decoded.append(text.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else ""))
