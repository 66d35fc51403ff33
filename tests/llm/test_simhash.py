import random

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import components, forest


def slow_print(text, size=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) for _ in range(n)]
    texts = list(base)
    for t in base[:60]:
        for _ in range(rng.randint(1, 4)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    return texts + [None, "", " \n", "Hello", "hello", "a b c", "A b\tc", "x " * 3000]


def test_fingerprints_and_components_match_brute_force(spark):
    texts = corpus()
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [slow_print(t) for t in texts]
    want = slow_components(list(range(len(texts))), prints)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(enumerate(prints))
    assert {r.doc_id: r.component_id for r in got} == want


def test_dense_keys_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 8)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    prints = np.array([base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)], np.uint64)
    prints = np.unique(prints)
    keys = np.zeros(len(prints), np.int64)
    got = {tuple(sorted((int(a), int(b)))) for x, y in simhash.links_within(prints, keys, 4, list(range(64))) for a, b in zip(x, y)}
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(prints) for b in prints[:i] if bin(int(a) ^ int(b)).count("1") <= 4}
    assert got == want


@pytest.mark.parametrize("distance", [2, 3, 4, 6])
def test_some_key_is_shared_within_the_distance(spark, distance):
    rng = random.Random(distance)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, distance)):
            b ^= 1 << bit
        pairs.append((a - (a >> 63 << 64), b - (b >> 63 << 64)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~F.arrays_overlap(simhash.variant_keys(F.col("a"), distance), simhash.variant_keys(F.col("b"), distance))).count() == 0


def test_majority_over_many_hashes():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    got, at = simhash.majority(hashes, counts), 0
    for n, fp in zip(counts, got):
        own = [int(x) for x in hashes[at : at + n]]
        assert int(fp) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
        at += n


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(np.array([1, 5, 3]), np.array([5, 3, 9]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 9: 1}


def test_edge_cases_and_filter(spark):
    schema = "doc_id long, text string, fp string, first int, component_id long, n_chars long"
    rows = [(2, "a b c d e f", "x", 1, 9, 1), (1, "A B c d e f", "y", 2, 9, 2), (1, "A B c d e f", "y", 2, 9, 2), (5, None, None, None, None, None), (6, "", "z", 1, 1, 1), (None, "a b c d e f", "n", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(False, 2, 1), (False, 1, 1), (False, 1, 1), (False, 5, 5), (False, 6, 5), (True, None, 1)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def slow_groups(texts, similarity=0.8, size=5):
    sets = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    alike = lambda x, y: not x | y or len(x & y) / len(x | y) >= similarity
    return [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]


def edited(rng, words, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), round(share * len(w))):
        w[i] = rng.choice(words)
    return " ".join(w)


def test_one_of_each_group_of_similar_texts_stays(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    texts = []
    for _ in range(60):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(120, 400)))
        texts += [base, edited(rng, words, base, 0.005), edited(rng, words, base, 0.012)]
    texts += [None, "", " ", "one", "One ", "one two", "x " * 500]
    pairs = slow_groups(texts)
    root = list(range(len(texts)))
    for i, j in pairs:  # indices fall, so that the smallest of a group is its root
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(root) and len(pairs) > 100


def test_crowded_keys_keep_their_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 8)
    rng = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    base = " ".join(rng.choice(words) for _ in range(300))
    texts = [base] + [edited(rng, words, base, 0.01) for _ in range(100)] + [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, *range(101, 131)}
    low = np.random.default_rng(2).integers(0, 1 << 64, 50, dtype=np.uint64)
    close = np.concatenate((low, low ^ np.uint64(1), low ^ np.uint64(6)))
    found = [(int(i), int(j)) for a, b in simhash.from_the_middle(close, close) for i, j in zip(a, b)]
    node, root = forest(*np.array(found).T)
    assert len(node) == 100 and len(found) == 100


def test_most_pairs_at_the_threshold_are_found(spark):
    """Of pairs with a similarity just over 0.8, nine in ten share a key."""
    rng = random.Random(10)
    words = ["w%d" % i for i in range(5000)]
    texts = []
    while len(texts) < 400:
        base = " ".join(rng.choice(words) for _ in range(300))
        other = edited(rng, words, base, 0.021)
        if slow_groups([base, other]) and not slow_groups([base, other], 0.84):
            texts += [base, other]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert kept <= 200 + 0.1 * 200


def test_all_pairs_at_the_threshold_are_found(spark):
    """Whatever number of bits their fingerprints differ in: long texts, and short ones, whose fingerprints differ more."""
    rng = random.Random(10)
    words = ["w%d" % i for i in range(5000)]
    texts = []
    while len(texts) < 600:
        base = " ".join(rng.choice(words) for _ in range(300 if len(texts) < 400 else rng.randint(13, 60)))
        other = edited(rng, words, base, 0.021) if len(texts) < 400 else base + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        if slow_groups([base, other]) and not slow_groups([base, other], 0.84):
            texts += [base, other]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(0, 600, 2))


@pytest.mark.parametrize("dense", [3, 512])
def test_rarest_shingles_lose_no_pair(monkeypatch, dense):
    """Sets of a few values, all pairs compared: each pair in different groups that has the similarity is formed."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(6)
    level = np.random.default_rng(6).integers(0, 4, 1 << simhash.COUNTERS).astype(np.uint8)
    names = np.unique(np.random.default_rng(7).integers(0, 1 << 64, 40, dtype=np.uint64)).tolist()
    sets = [set(rng.sample(names, rng.randint(0, 12))) for _ in range(60)]
    sets += [{*x} - {*rng.sample(sorted(x), 1)} | {*rng.sample(names, rng.randint(0, 2))} for x in sets if x]
    monkeypatch.setattr(simhash, "LARGE", 7)
    bits = np.stack([np.frombuffer(simhash.parity(np.array(sorted(x), np.uint64)), np.uint64) for x in sets])
    rows = sorted((int(k), v, v % 9, len(x), at) for v, x in enumerate(sets) for at, k in enumerate(simhash.rarest(np.array(sorted(x), np.uint64), level, 0.8)))
    keys, version, root, size, place = (np.array(c, np.uint64 if n == 0 else np.int64) for n, c in enumerate(zip(*rows)))
    got = {frozenset((int(version[a]), int(version[b]))) for i, j in simhash.pairs_apart(keys, root, size, place, bits[version], 0.8) for a, b in zip(i, j)}
    alike = lambda x, y: not x | y or len(x & y) / len(x | y) >= 0.8
    want = {frozenset((i, j)) for i, x in enumerate(sets) for j in range(i) if i % 9 != j % 9 and alike(x, sets[j])}
    assert want <= got and len(want) > 20 and all(len({v % 9 for v in p}) == 2 for p in got)


def test_minimal_spanning_forest():
    rng = np.random.default_rng(4)
    a, b, weight = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    chosen = simhash.spanning(a, b, weight)
    want, root = 0, list(range(40))
    for w, x, y in sorted(zip(weight.tolist(), a.tolist(), b.tolist())):
        if root[x] != root[y]:
            want += w
            root = [root[y] if r == root[x] else r for r in root]
    assert weight[chosen].sum() == want and len(chosen) == 40 - len(set(root))


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(11)
    one, two, three = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.random()) for _ in range(60)) for _ in range(3))
    rows = [(1, one, "b"), (1, two, "x"), (1, one, "a"), (2, two, "y"), (None, three, "z"), (None, three, "z"), (None, one, "n"), (3, None, "q"), (None, "", "r")]
    for order in (rows, rows[::-1]):
        kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, version string")).collect()]
        assert sorted(kept, key=str) == sorted([(1, one, "a"), (1, two, "x"), (None, three, "z"), (3, None, "q")], key=str)
