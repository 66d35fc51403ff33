"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; each is set if it is set in over half the XXH64 values (seed 42) of the text's word shingles.
Two fingerprints within ``distance`` bits, cut into distance // 2 + 1 segments, have a segment that differs in one bit at
most. So every fingerprint is indexed under each of its segments with each one bit taken out: 64 keys, found by equality.
Candidates that share a key are verified on all bits. Only distinct fingerprints are indexed, and a task hands on a
spanning forest of the links it found, never all pairs of a group.

``keep_one`` uses the same index over fingerprints of 128 bits in eight segments, verifies candidates by the texts' shingles
and leaves one document of each group. No number of bits holds all texts of a given similarity, so what the index has not
linked is compared once more, exactly: texts of different groups that share one of the rarest shingles of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, ragged, steps, text_bytes, written
from quern.llm.components import components, forest

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Rows of one key from which its candidates are searched through a finer index of the other bits.
DENSE = 512


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the word shingles, repeats included; of the whole sequence if it is shorter."""
    words = text.translate(LOWER).split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)] if words else []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(line)]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: bits set in over half of a group; 0 for an empty group."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    first = np.cumsum(sizes) - sizes
    # eight bits are counted at a time in the bytes of a word, over 255 hashes at most
    parts = -(-sizes // 255)
    part_first = np.cumsum(parts) - parts
    begin = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_first, parts))
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & ones, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), part_first, axis=0)
        for lane in range(8):
            out[full] |= (2 * sums[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long). Null texts and texts without words have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [shingle_hashes(x, shingle) for x in text_bytes(batch)]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            hashes = np.array([h for row in rows for h in row], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(hashes, counts).view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of distance // 2 + 1 segments: one of them differs in at most one bit."""
    if distance < 2:
        raise ValueError("distance must be 2 or more")
    n = distance // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variant_keys(fp: Column, distance: int) -> Column:
    """All one-wildcard segment keys: the segment with a bit taken out, and which bit that is."""
    keys = []
    for first, width in segments(distance):
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((first + j) << 40)) for j in range(width)]
    return F.array(*keys)


def _near(fps: np.ndarray, keys: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal keys whose fingerprints are near, one offset at a time."""
    at, d = np.arange(len(keys)), 1
    while True:
        at = at[at + d < len(keys)]
        at = at[keys[at + d] == keys[at]]
        if not len(at):
            return
        ok = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= distance]
        if len(ok):
            yield ok, ok + d
        d += 1


def links_within(fps: np.ndarray, keys: np.ndarray, distance: int, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints in runs of equal keys (both arrays sorted by key).

    Runs of over DENSE rows are indexed again by the bits in ``free``, cut and wildcarded in the same way, so a crowded key
    costs its sort and its own near candidates instead of all its pairs.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    dense = np.flatnonzero(sizes > DENSE) if len(free) >= 24 else np.empty(0, np.int64)
    for run in dense.tolist():
        own = fps[starts[run] : starts[run] + sizes[run]]
        cuts = segments(distance, len(free))
        for first, width in cuts:
            bits = free[first : first + width]
            rest = [b for b in free if b not in bits]
            whole = sum(1 << b for b in bits)
            for b in bits:
                finer = own & np.uint64(whole & ~(1 << b))
                order = np.argsort(finer, kind="stable")
                yield from links_within(own[order], finer[order], distance, rest)
    if len(dense):
        sparse = np.repeat(~np.isin(np.arange(len(sizes)), dense), sizes)
        fps, keys = fps[sparse], keys[sparse]
    for i, j in _near(fps, keys, distance):
        yield fps[i], fps[j]


def link_forest(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all that lie within ``distance`` bits of each other."""
    table = segments(distance)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def add(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal n, held
            held.append((a, b))
            n += len(a)
            if n > 1 << 20:
                held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])

        def search(keys: np.ndarray, own: np.ndarray) -> None:
            bit = keys >> 40
            for first, width in table:
                mine = (bit >= first) & (bit < first + width)
                if mine.any():
                    for a, b in links_within(own[mine], keys[mine], distance, [x for x in range(64) if not first <= x < first + width]):
                        add(a, b)

        keys, own = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            own = np.concatenate((own, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) > 1 << 16:  # all whole keys so far; the last may go on
                done = int(np.searchsorted(keys, keys[-1]))
                search(keys[:done], own[:done])
                keys, own = keys[done:], own[done:]
        search(keys, own)
        if held:
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keyed = fps.select(F.explode(variant_keys(F.col("fp"), distance)).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest doc_id that links of at most ``distance`` differing bits reach.

    Every row has a result row, also if ids repeat. Null texts and texts without words share fingerprint 0. Null ids do not
    count as smallest unless a component has no other (then component_id is null). An empty table gives an empty result;
    only the id and text columns are read.
    """
    prints = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    stars = components(link_forest(distinct.select("fp"), distance))
    member = stars.select(F.col("node").alias("fp"), "root").union(stars.select(F.col("root").alias("fp"), "root").distinct())
    smallest = member.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    linked = member.join(smallest, "root").select("fp", "smallest")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    # written, so that the join below shuffles both sides by fp itself and a fingerprint with very many copies can be split
    named = written(named, "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: ``keep_one``: similarity of the sets of word shingles, words of one, segments of the wide fingerprint.
SIMILARITY, WORDS, CUTS = 0.8, 5, 8
#: Differing bits of 128 up to which candidates are compared by their texts: a similarity of 0.8 gives 20 on average, with a
#: deviation of 4, fingerprints of unrelated texts 64 with a deviation of 6.
CANDIDATE = 32
_WIDE = 128
#: Bits of the number of counters that order shingles, and ranges in which they are added up.
COUNTERS, RANGES = 23, 32
#: Shingles from which a set has a parity of 512 bits; smaller ones have 256.
LARGE = 384


def wide_prints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each group of shingle hashes: the majority of the hashes, and of the hashes mixed anew."""
    mixed = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return majority(hashes, counts), majority(mixed ^ mixed >> np.uint64(32), counts)


def wide_keys(low: Column, high: Column) -> Column:
    """One-wildcard keys of the CUTS segments. Fingerprints of up to 2 * CUTS - 1 differing bits share one for certain."""
    width, keys = _WIDE // CUTS, []
    for n in range(CUTS):
        word, first = (low, n * width) if n < CUTS // 2 else (high, n * width - 64)
        part = F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        keys += [part.bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((n * width + j) << width)) for j in range(width)]
    return F.array(*keys)


def apart(low: np.ndarray, high: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Differing bits of the fingerprints at i and j."""
    return np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])


def from_the_middle(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all candidates of one crowded key, without all its pairs.

    The fingerprint nearest to the majority of all comes first and takes whatever lies near it, then what it took does the
    same among the rest; copies of one text cost a row each, not a pair.
    """
    size = np.array([len(low)])
    middle = [np.bitwise_count(x ^ majority(x, size)[0]).astype(np.int64) for x in (low, high)]
    left = np.argsort(middle[0] + middle[1], kind="stable")
    while len(left):
        front, left = [left[0]], left[1:]
        for f in front:  # grows while it is walked
            near = apart(low, high, f, left) <= CANDIDATE
            if near.any():
                found, left = left[near], left[~near]
                front += found.tolist()
                yield np.full(len(found), f), found


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links that make up a minimal spanning forest; among equal weights the smaller ends come first."""
    order = np.lexsort((b, a, weight))
    nodes, at = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    part, kept, live = np.arange(len(nodes)), [np.empty(0, np.int64)], np.arange(len(a))
    while True:
        live = live[part[a[live]] != part[b[live]]]
        if not len(live):
            return order[np.concatenate(kept)]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, part[a[live]], live)
        np.minimum.at(best, part[b[live]], live)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        node, root = forest(part[a[chosen]], part[b[chosen]])
        up = np.arange(len(nodes))
        up[node] = root
        part = up[part]


def candidate_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links between ``version`` of candidates that share a key; of each task's, a minimal spanning forest by
    differing bits, whose links are the likeliest to hold."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def shrink() -> None:
            nonlocal held, n
            a, b, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            kept = spanning(a, b, weight)
            held, n = [(a[kept], b[kept], weight[kept])], len(kept)

        def add(i: np.ndarray, j: np.ndarray, weight: np.ndarray, version: np.ndarray) -> None:
            nonlocal n
            held.append((np.minimum(version[i], version[j]), np.maximum(version[i], version[j]), weight))
            n += len(i)
            if n > 1 << 20:
                shrink()

        def search(keys: np.ndarray, version: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            for start, size in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
                own = slice(start, start + size)
                for i, j in from_the_middle(low[own], high[own]):
                    add(i + start, j + start, apart(low, high, i + start, j + start), version)
            at, d = np.flatnonzero(np.repeat(sizes <= DENSE, sizes)), 1
            while len(at := at[at + d < len(keys)]) and len(at := at[keys[at + d] == keys[at]]):
                weight = apart(low, high, at, at + d)
                near = weight <= CANDIDATE
                if near.any():
                    add(at[near], at[near] + d, weight[near], version)
                d += 1

        rows = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        for batch in batches:
            rows = [np.concatenate((old, batch.column(i).to_numpy().view(old.dtype))) for i, old in enumerate(rows)]
            if len(rows[0]) > 1 << 16:  # all whole keys so far; the last may go on
                done = int(np.searchsorted(rows[0], rows[0][-1]))
                search(*(x[:done] for x in rows))
                rows = [x[done:].copy() for x in rows]
        search(*rows)
        if n:
            shrink()
            yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])

    keyed = nodes.select(F.explode(wide_keys(F.col("low"), F.col("high"))).alias("key"), "version", "low", "high")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(links, "a long, b long").distinct()


def similar_texts(links: DataFrame, texts: DataFrame, owners: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The ``links`` (a, b) whose texts have sets of shingles of that Jaccard similarity.

    ``texts`` are ``doc_id, version, text``, ``owners`` a ``doc_id`` for each ``version``: only texts that a link names are
    read again, and of many copies that of the owner. Two texts without words are alike.
    """
    links = written(links, "candidates")
    named = links.select(F.col("a").alias("version")).union(links.select("b")).distinct().join(owners, "version").select(F.col("version").alias("v"), F.col("doc_id").alias("d"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [np.unique(np.array(shingle_hashes(x, words), np.uint64)).view(np.int64) for x in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["version", "own"])

    own = texts.join(named, (texts["version"] == named["v"]) & texts["doc_id"].eqNullSafe(named["d"]), "left_semi")
    sets = written(own.select("version", "text").dropDuplicates(["version"]).mapInArrow(shingles, "version long, own array<long>"), "shingles")
    one, two = sets.select(F.col("version").alias("a"), F.col("own").alias("x")), sets.select(F.col("version").alias("b"), F.col("own").alias("y"))
    both = links.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("total"))
    return both.where((F.col("total") == 0) | (F.col("same") / (F.col("total") - F.col("same")) >= similarity)).select("a", "b")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS)).view(np.int64)


def shingle_levels(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How often the shingles of all ``texts`` (version, text) occur, in powers of two, by the first bits of their hash.

    This only orders shingles: any order, the same for all texts, gives the same pairs; rare ones first give fewer candidates.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in steps(batches):
            table = np.zeros(1 << COUNTERS, np.uint32) if table is None else table
            np.add.at(table, _counter(np.array([h for x in text_bytes(batch) for h in shingle_hashes(x, words)], np.uint64)), np.uint32(1))
        if table is not None:
            for n, own in enumerate(np.array_split(table, RANGES)):
                data = pa.compress(np.minimum(own, 255).astype(np.uint8).tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([data], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(pa.decompress(data.as_buffer(), (1 << COUNTERS) // RANGES, "zstd"), np.uint8)
                sums[n] = sums[n] + own if n in sums else own.astype(np.int64)
        for n, own in sums.items():
            level = np.ceil(np.log2(own + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "counts"])

    out, kind = np.zeros(1 << COUNTERS, np.uint8), "part int, counts binary"
    for r in texts.select("version", "text").mapInArrow(count, kind).repartition(RANGES, "part").mapInArrow(add, kind).collect():  # of fixed size
        np.array_split(out, RANGES)[r["part"]][:] = np.frombuffer(r["counts"], np.uint8)
    return out


def rarest(own: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's shingles, rarest first, that each set of that Jaccard similarity has one of them among its own.

    The sets share at least similarity * len(own) shingles, so of the others plus one, one is shared; of the shared ones the
    first in the common order is among the first of both. Sets without shingles have 0.
    """
    if not len(own):
        return np.zeros(1, np.uint64)
    most = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    return own[np.argsort(level[_counter(own)], kind="stable")[:most]]


def parity(own: np.ndarray) -> bytes:
    """Which of 256 or 512 classes of hashes hold an odd number of a set's shingles; 64 bytes, the last 32 zero for 256.

    Two sets differ in as many shingles as their parities in bits, or more.
    """
    n = 256 if len(own) < LARGE else 512
    odd = np.bincount((own & np.uint64(n - 1)).view(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes().ljust(64, b"\0")


def pairs_apart(keys: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal keys whose groups (``root``) differ and whose sets may have the similarity, as far as
    their sizes, the places of the shared shingle and their parities (``bits``, rows x 8) tell."""
    folded = bits[:, :4] ^ bits[:, 4:]  # of 512 classes, those that 256 would make one

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs."""
        at = np.flatnonzero(root[i] != root[j])
        i, j = i[at], j[at]
        total = size[i] + size[j]
        least = total * (similarity / (1 + similarity)) - 1e-6  # of shared shingles
        own = np.flatnonzero(np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j]) >= least)
        for wide in (False, True):
            a, b = i[own], j[own]
            x = bits if wide else folded
            apart = np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
            ok = total[own] - apart >= 2 * least[own]
            if wide:
                ok |= (size[a] < LARGE) | (size[b] < LARGE)
            own = own[ok]
        return at[own]

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    if len(starts):  # runs of one group hold nothing
        mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
        starts, sizes = starts[mixed], sizes[mixed]
    for start, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
        # the largest group is no row's turn: its own pairs, which are most, are never formed
        groups, at = np.unique(root[start : start + n], return_inverse=True)
        largest = np.bincount(at).argmax() == at
        inside, others = start + np.flatnonzero(largest), start + np.flatnonzero(~largest)
        for k, f in enumerate(others):
            against = np.concatenate((inside, others[k + 1 :]))
            ok = against[may(np.full(len(against), f), against)]
            if len(ok):
                yield np.full(len(ok), f), ok
    few = sizes <= DENSE
    at, ends, d = ragged(starts[few], sizes[few]), np.repeat(starts[few] + sizes[few], sizes[few]), 1
    while len(at):
        kept = at + d < ends
        at, ends = at[kept], ends[kept]
        ok = at[may(at, at + d)]
        if len(ok):
            yield ok, ok + d
        d += 1


def links_between(groups: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``a, b``: all pairs of ``version`` in different ``groups`` (version, root) that may have the similarity.

    Every text is indexed under its ``rarest`` shingles; whichever two texts have the similarity share one of these. Of the
    pairs that share one, those leave the task that their sizes and parities do not rule out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(shingle_levels(texts, words))  # of fixed size

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [shingle_set(x, words) for x in text_bytes(batch)]
            rows = [rarest(x, shared.value, similarity).view(np.int64) for x in sets]
            columns = [batch.column(0), pa.array(list(map(len, sets)), pa.int32()), pa.array(rows, pa.list_(pa.int64())), pa.array(list(map(parity, sets)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["version", "size", "rarest", "bits"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if n:
                a, b = np.unique(np.concatenate(held), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a, b)], names=["a", "b"])
            held, n = [], 0

        def search(keys: np.ndarray, version: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal n
            for i, j in pairs_apart(keys, root, size, place, bits, similarity):
                held.append(np.stack((np.minimum(version[i], version[j]), np.maximum(version[i], version[j])), 1))
                n += len(i)
                if n > 1 << 18:
                    yield from out()

        rows = [*(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.int32, np.int32)), np.empty((0, 8), np.uint64)]
        for batch in batches:
            own = [*(batch.column(i).to_numpy() for i in range(5)), np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, 8)]
            rows = [np.concatenate(x) for x in zip(rows, own, strict=True)]
            if len(rows[0]) > 1 << 16:  # all whole keys so far; the last may go on
                done = int(np.searchsorted(rows[0], rows[0][-1]))
                yield from search(*(x[:done] for x in rows))
                rows = [x[done:].copy() for x in rows]
        yield from search(*rows)
        yield from out()

    index = texts.select("version", "text").mapInArrow(first, "version long, size int, rarest array<long>, bits binary")
    index = index.groupBy("version").agg(*(F.first(x).alias(x) for x in ("size", "rarest", "bits"))).join(groups, "version")
    keyed = index.select(F.posexplode("rarest").alias("place", "key"), "version", "root", "size", "bits").select("key", "version", "root", "size", "place", "bits")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(links, "a long, b long").distinct()


def keep_one(docs: DataFrame, *, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns as they are.

    Texts are linked if their sets of word shingles have a Jaccard similarity of at least ``similarity``. Candidates are
    first those that share a one-wildcard segment key of their 128-bit fingerprints, then, between the groups these make up,
    all that can have the similarity: no link is lost. Of a group, the row with the smallest id stays, null ids last,
    among equal ids that with the smallest text digest. Rows with the same id and text are one (the least by all columns
    stays; null and empty texts are the same text); other rows of a repeated id are documents of their own. An empty table
    gives an empty result.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [shingle_hashes(x, words) for x in text_bytes(batch)]
            low, high = wide_prints(np.array([h for row in rows for h in row], np.uint64), np.fromiter(map(len, rows), np.int64, len(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["doc_id", "version", "low", "high"])

    kind = dict(docs.dtypes)[id_col]
    prints = docs.select(F.col(id_col).alias("doc_id"), digest.alias("version"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, version long, low long, high long")
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    nodes = written(prints.groupBy("version").agg(F.min(named).alias("first"), F.min("low").alias("low"), F.min("high").alias("high")), "prints")
    texts = docs.select(F.col(id_col).alias("doc_id"), digest.alias("version"), F.col(text_col).alias("text"))
    owners = nodes.select("version", "first.doc_id")
    near = written(similar_texts(candidate_links(nodes), texts, owners, similarity, words), "near")
    root = components(near)
    groups = nodes.select("version").join(root, nodes["version"] == root["node"], "left").select("version", F.coalesce("root", "version").alias("root"))
    root = components(near.union(similar_texts(links_between(groups, texts, similarity, words), texts, owners, similarity, words)))
    group = nodes.join(root, nodes["version"] == root["node"], "left").select("version", "first", F.coalesce("root", "version").alias("root"))
    chosen = group.groupBy("root").agg(F.min(F.struct("first", "version")).alias("one")).select("one.first.doc_id", "one.version")
    chosen = written(chosen, "chosen")  # its join below can then be split where many rows repeat one id and text
    keyed = docs.select(F.col(id_col).alias("__id"), digest.alias("__version"), F.struct(*docs.columns).alias("__row"))
    kept = keyed.join(chosen, keyed["__id"].eqNullSafe(chosen["doc_id"]) & (keyed["__version"] == chosen["version"]), "left_semi")
    return kept.groupBy("__id", "__version").agg(F.min("__row").alias("__row")).select("__row.*")
