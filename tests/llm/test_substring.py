import random

import numpy as np

from quern.llm import substring
from quern.llm.gear import GEAR, gear_hashes, mask_cuts, peaks


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiéñü") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_hashes_and_peaks_match_definitions():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    h, seen = 0, gear_hashes(data)
    for i, b in enumerate(data.tolist()):
        h = (h << 1) + int(GEAR[b]) & 0xFFFFFFFF
        assert i < 32 or h == seen[i]
    h = gear_hashes(data, 16)
    want = [i for i in range(5, len(h) - 5) if (h[i] > np.delete(h[i - 5 : i + 6], 5)).all()]
    assert peaks(data, 5, 16).tolist() == want
    assert not (peaks(np.zeros(500, np.uint8), 5, 16) >= 20).any()
    assert all(x >= 32 for x in mask_cuts(data, 4))


def test_cuts_resist_insertions_and_keep_characters_whole():
    rng = random.Random(2)
    passage = prose(rng, 80)
    texts = [prose(rng, n) + " " + passage + " " + prose(rng, 30) for n in (0, 7, 50)] + ["é" * 5000, "", "a", "ab " * 2000]
    data = [t.encode() for t in texts]
    cuts = substring.cuts_of(data)
    chunks = [[d[a:b] for a, b in zip(c, c[1:])] for d, c in zip(data, cuts)]
    for d, parts in zip(data, chunks):
        assert b"".join(parts) == d
        for p in parts:
            p.decode()
    inner = set(chunks[0]) & set(chunks[1]) & set(chunks[2])
    assert sum(map(len, inner)) > 0.75 * len(passage.encode())
    # alone or in a batch, the same
    assert all((substring.cuts_of([d])[0] == c).all() for d, c in zip(data, cuts))


def slow_repeats(rows, min_bytes=substring.MIN_BYTES):
    places = {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t}):
        data = text.encode()
        c = substring.cuts_of([data])[0].tolist()
        for a, b in zip(c, c[1:]):
            places.setdefault(data[a:b], set()).add((doc, a, b))
    every, gone = {}, {}
    for at in places.values():
        if len(at) > 1:
            for n, (doc, a, b) in enumerate(sorted(at)):
                every.setdefault(doc, set()).add((a, b))
                if n:
                    gone.setdefault(doc, set()).add((a, b))
    out = {}
    for doc, spans in every.items():
        if whole := substring.runs(sorted(spans), min_bytes):
            out[doc] = (whole, substring.runs(sorted(gone.get(doc, ())), min_bytes))
    return out


def test_passages_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    shared = [prose(rng, 60) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(5, 120)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, shared[0]) for i in range(30)] + [(300, None), (301, ""), (302, "short"), (303, "short"), (None, shared[0]), rows[5], rows[5]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", len(t or "")) for d, t in rows], "doc_id long, text string, state string, n_chars long").repartition(5)
    got = {r.doc_id: ([tuple(x) for x in r.repeats], [tuple(x) for x in r.removed]) for r in substring.repeated_passages(docs).collect()}
    assert got == slow_repeats(rows)
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    after = [(r.doc_id, r.text, r.n_chars) for r in cut.collect()]
    assert len(after) == len(rows)
    assert all(n == len(t or "") for _, t, n in after)
    left = {d: t for d, t, _ in after}
    assert sum(left[200 + i] == "" for i in range(30)) >= 29 and left[None] == shared[0] and left[300] is None
    texts = dict(rows)
    assert all(left[d] == texts[d] for d in texts if d not in got)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.repeated_passages(empty).count() == 0 and substring.remove_repeats(empty).count() == 0


def test_texts_of_one_id_are_cut_apart(spark):
    rng = random.Random(6)
    passage, other = prose(rng, 90), prose(rng, 90)
    rows = [(1, passage), (2, "intro words here " + passage), (2, other), (2, other), (2, None), (3, other + " and more"), (None, other), (2, "")]
    want = None
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        after = sorted(((r.doc_id, r.text) for r in substring.remove_repeats(docs).collect()), key=str)
        left = [t for d, t in after if d == 2 and t]
        assert left.count(other) == 2 and len(left) == 3
        assert len([t for t in left if t != other][0]) < 17 + 120
        assert [t for d, t in after if d == 1] == [passage] and [t for d, t in after if d is None] == [other]
        assert len([t for d, t in after if d == 3][0]) < 9 + 120
        assert want in (None, after)
        want = after
    spans = substring.repeated_passages(docs).collect()
    assert sorted(r.doc_id for r in spans) == [1, 2, 2, 3] and len({r.version for r in spans if r.doc_id == 2}) == 2
