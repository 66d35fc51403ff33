import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quern.llm import lm_mixing as lm

SYLLABLES = {0: ["th", "an", "er", "on", "re", "ing", "ha", "st"], 1: ["keit", "ung", "sch", "lich", "zu", "ver", "ein", "tz"]}


def text(rng, kind, n):
    common = {0: ["the", "of", "and", "thing", "other", "to", "in"], 1: ["der", "die", "und", "das", "von", "mit", "zu"]}[kind]
    make = lambda: "".join(rng.choice(SYLLABLES[kind]) for _ in range(rng.randint(2, 4)))
    return " ".join(rng.choice(common) if rng.random() < 0.5 else make() + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    monkeypatch.setattr(lm, "SPELL_BITS", 16)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    own = [(i, text(rng, i % 2, rng.randint(5, 120))) for i in range(300)]
    return own + [(400, None), (401, ""), (402, "  \n "), (403, "THE the"), (None, "no id"), own[7], own[7], (404, "q" * 30_000), (405, "héé\tñ\x0bx\x1cy  z"), (406, "again and again and again " * 20)]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def slow_base(rows):
    split = [[w for w in lm.tokens_of((t or "").encode())] for _, t in rows]
    counts = Counter(w for (d, _), x in zip(rows, split) if not is_held_out(d) for w in x)
    n, v = sum(counts.values()), len(counts)
    return [(d, is_held_out(d), len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for (d, _), x in zip(rows, split)]


@pytest.mark.parametrize("top", [1 << 17, 12])
def test_base_scores_match_direct_counting(spark, rows, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)  # few frequent tokens: the others are joined
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, token string").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs).collect()), key=str)
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in slow_base(rows)), key=str)


# The whole model, bit by bit.


def slow_slot(*parts):
    h = 0
    for x in parts:
        h = (h ^ x) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
    return (h * 0xBF58476D1CE4E5B9 % 2**64) >> 64 - lm.WORD_BITS


def slow_mix(mixer, gate, odds):
    x = sum(w * o for w, o in zip(mixer.weights[gate], [*odds, 1.0]))
    x = min(max(x, -lm._REACH * 1.4), lm._REACH * 1.4)
    at = min(max(round((x + lm._REACH) * (lm._BINS - 1) / (2 * lm._REACH)), 0), lm._BINS - 1)
    return 0.5 * (1 / (1 + math.exp(-x)) + float(mixer.refine[gate, at]))


def bucket(x, edges):
    return sum(x >= e for e in edges)


def slow_spelling(s, token, cluster):
    total, before = 0.0, [32] * 6
    for byte in token + b" ":
        size, value = int(s.code[0][byte]), int(s.code[1][byte])
        slots = []
        for order in lm._ORDERS:
            context = sum(before[k] << 8 * k for k in range(order))
            h = ((context * 0x9E3779B97F4A7C15 + order) % 2**64 ^ (cluster + 1) * 0xA0761D6478BD642F % 2**64) * 0x94D049BB133111EB % 2**64
            slots.append(h ^ h >> 29)
        for j in range(size):
            partial = (1 << j | value >> size - j) * 0xD6E8FEB86659FD93 % 2**64
            cells = [int(t[((h ^ partial) * 0xBF58476D1CE4E5B9 % 2**64) >> 64 - s.bits]) for t, h in zip(s.tables, slots)]
            one = slow_mix(s.mixer, (cells[-2] >> 8) * lm._LEVELS + (cells[-1] >> 8), [((c & 255) - 128) / 8 for c in cells])
            total += math.log10(one if value >> size - 1 - j & 1 else 1 - one)
        before = [byte, *before[:-1]]
    return total


def slow_score(m, rare, spelling, counts, text):
    """One token after the other, with dictionaries for what the text has shown so far."""
    hash_of = xxhash.xxh3_64_intdigest
    top = {int(h): i for i, h in enumerate(m.frequent.hashes)}
    marker = {int(h): i for i, h in enumerate(m.clusters.markers)}
    tokens, total, spelled_bits = lm.tokens_of(text), 0.0, {}
    followed, before, run, past, evidence = {}, None, 0, [], np.zeros(len(m.clusters.prior))
    tried = hits = commons = lefts = 0
    for place, w in enumerate(tokens):
        cluster = int((evidence + m.clusters.prior).argmax())
        expected = followed.get(before) if place else None
        own_hash = hash_of(before) if place else 0
        outcome = None
        if expected is not None:
            gate = min(run, 7) * 3 + bucket(tried, (8, 64))
            slots = [gate, slow_slot(hash_of(expected), min(run, 3)), slow_slot(own_hash, hash_of(expected))]
            p = slow_mix(m.again.mixer, gate, [*(m.again.odds[i][s] for i, s in enumerate(slots)), math.log((hits + 0.2) / (tried - hits + 1))])
            tried += 1
            if expected == w:
                total, outcome, hits, run = total + math.log10(p), 2, hits + 1, run + 1
            else:
                total += math.log10(1 - p)
        if outcome is None:
            run = 0
            latest = past[-1] if past else 3
            pattern = sum((past[-j] if len(past) >= j else 3) << 2 * (4 - j) for j in range(1, 5))
            kind = 0 if expected is None else 1 + (hash_of(expected) in top)
            slots = [slow_slot(own_hash, 1), pattern * lm.CLUSTERS + cluster, (kind * 4 + latest) * lm.CLUSTERS + cluster]
            gate = latest * 3 + bucket(place, (8, 64))
            p = slow_mix(m.frequent_choice.mixer, gate, [*(m.frequent_choice.odds[i][s] for i, s in enumerate(slots)), math.log((commons + 2) / (lefts - commons + 0.5))])
            lefts += 1
            if hash_of(w) in top:
                i = top[hash_of(w)]
                share = m.frequent.count[i] / m.frequent.count.sum()
                total += math.log10(p) + math.log10((m.frequent.by_cluster[i, cluster] + lm.SMOOTH * share) / (m.frequent.by_cluster[:, cluster].sum() + lm.SMOOTH))
                commons += 1
            else:
                spelled = slow_spelling(spelling, w, cluster)
                c, by = counts.get(w, (0, None))
                d, whole = rare.discount, None
                rest = math.log10(d * rare.v / rare.n) if rare.n else 0.0
                if c == 0 and spelled < -250:
                    back = math.log10(d * rare.kinds[cluster] / rare.words[cluster]) if rare.words[cluster] else 0.0
                    total += math.log10(1 - p) + back + rest + spelled
                else:
                    whole = (max(c - d, 0) / rare.n + d * rare.v / rare.n * 10**spelled) if rare.n else 10**spelled
                    if rare.words[cluster]:
                        whole = max((by[cluster] if by else 0) - d, 0) / rare.words[cluster] + d * rare.kinds[cluster] / rare.words[cluster] * whole
                    total += math.log10(1 - p) + math.log10(whole)
            outcome = int(hash_of(w) in top)
        past.append(outcome)
        if hash_of(w) in marker:
            evidence = evidence + m.clusters.evidence[marker[hash_of(w)]]
        if place:
            followed[before] = w
        before = w
    return total


@pytest.mark.parametrize("top", [1 << 17, 12])
def test_scores_match_a_bit_by_bit_mixer(spark, rows, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one task: sums have one order
    kept = []
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda d: kept.append(real(d)) or kept[0])
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(docs).collect()}
    model, rare, rest, _, _ = kept[0]
    counts = {r["token"].encode(): (r["c"], [r[f"c{k}"] for k in range(len(model.clusters.prior))]) for r in rest.collect()}
    spelling = model.spelling()
    for doc, t in rows[:60] + rows[300:]:
        data = (t or "").encode()
        tokens = lm.tokens_of(data)
        r = got[doc, len(tokens)]
        want = slow_score(model, rare, spelling, counts, data)
        assert abs(r.score - want) < 1e-4 * max(1, abs(want)), (doc, r.score, want)
        assert abs(r.bits_per_byte + r.score * math.log2(10) / sum(len(w) + 1 for w in tokens)) < 1e-9


def test_held_out_texts_gain_clearly(spark):
    rng = random.Random(12)
    common = {k: ["".join(rng.choice(SYLLABLES[k]) for _ in range(rng.randint(1, 2))) + str(i % 7) for i in range(60)] for k in (0, 1)}
    docs = []
    for i in range(1500):
        k, words = i % 2, []
        for _ in range(rng.randint(60, 200)):
            words.append(common[k][min(int(rng.expovariate(0.08)), 59)] if rng.random() < 0.8 else text(rng, k, 1))
        docs.append((i, " ".join(words)))
    own = [r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect() if r.held_out]
    assert len(own) > 200 and sum(r.score for r in own) > 0.9 * sum(r.base_score for r in own)
    assert sum(r.score < r.base_score for r in own) < 0.1 * len(own)


def test_order_of_words_counts(spark):
    """Contexts cross words, and what a text has shown is learned as it goes on."""
    rng = random.Random(4)
    docs = [(i, text(rng, i % 2, 80)) for i in range(200)]
    phrase = text(rng, 0, 12).split()
    whole, mixed = phrase * 8, []
    for _ in range(8):
        mixed += rng.sample(phrase, len(phrase))
    ids = [i for i in range(1000, 1100) if is_held_out(i)][:2]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([*docs, (ids[0], " ".join(whole)), (ids[1], " ".join(mixed))], "doc_id long, text string")).collect()}
    assert abs(got[ids[0]].base_score - got[ids[1]].base_score) < 1e-6 and got[ids[0]].score > 0.7 * got[ids[1]].score


def test_tokens_are_cut_as_by_splitting():
    texts = [b"", b" ", b"The  cat\tsat\x0b", b"\nx", "É é\x0cÑ".encode(), b"a" * 50, b"A a A"]
    t = lm.tokenise(texts)
    want = [lm.tokens_of(x) for x in texts]
    assert t.sizes.tolist() == [len(x) for x in want] and [t.names[i].as_py() for i in t.at.tolist()] == [w for x in want for w in x]
    assert len(set(t.names.to_pylist())) == len(t.names)


def test_code_is_a_prefix_code():
    rng = np.random.default_rng(1)
    for counts in (np.zeros(256, np.int64), (rng.pareto(0.3, 256) * 10).astype(np.int64), np.eye(256, dtype=np.int64)[5] * 10**9):
        length, bits = lm.code_of(counts)
        assert sum(2.0 ** -int(x) for x in length) == 1 and length.max() < 16
        assert len({(int(n), int(b)) for n, b in zip(length, bits)}) == 256 and all(b >> int(n) == 0 for n, b in zip(length, bits.tolist()))


def small_spelling(words, bits=14):
    cluster = np.zeros(len(words), np.int64)
    code = lm.code_of(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256))
    tables = np.zeros((len(lm._ORDERS), 1 << bits, 2), np.uint32)
    lm.count_spelling(words, cluster, code, tables, bits)
    learner = lm.Learner(lm.spell_start())
    for _ in range(30):
        lm.learn_spelling(learner, tables, bits, code, words, cluster)
    return lm.Spelling(bits, lm.packed(tables), code, lm.joined(lm.spell_start(), learner.vectors()))


def test_probabilities_of_all_next_bytes_add_up_to_one():
    s = small_spelling([b"the", b"then", b"of", b"other", b""])
    zero = np.zeros(1, np.int64)
    for prefix in (b"", b"th", b"zz"):
        total = 0.0
        for c in range(256):
            token = prefix + bytes([c]) if c != 32 else prefix
            p = lm.paths([token], zero)
            logs = np.zeros(len(p.data))
            for own, at, bit in lm.bit_slots(p, s.code, s.bits):
                cells = [t[x] for t, x in zip(s.tables, at)]
                one = s.mixer(np.stack([((x & 255).astype(np.float32) - 128) / 8 for x in cells]), (cells[-2] >> 8).astype(np.int64) * lm._LEVELS + (cells[-1] >> 8))
                logs[own] += np.log(np.where(bit == 1, one, 1 - one))
            total += math.exp(logs[len(prefix)])
            assert abs(logs.sum() - s.log_prob([token], zero)[0]) < 1e-4
        assert abs(total - 1) < 1e-4, (prefix, total)


def test_words_share_a_probability_of_one():
    rng = np.random.default_rng(0)
    by = rng.integers(0, 9, (40, 3)).astype(np.float32)
    f = lm.Frequent(np.arange(40, dtype=np.uint64), by.sum(1).astype(float), by)
    for k in range(3):
        assert abs(np.exp(f.log_prob(np.arange(40), np.full(40, k))).sum() - 1) < 1e-5
    rare = lm.Rare(0.6, by.sum(0).astype(int), (by > 0).sum(0), int(by.sum()), 40)
    for k in range(3):
        assert abs(rare.prob(by.sum(1), by[:, k], k, 0.0).sum() + rare.prob(0.0, 0.0, k, 1.0) - 1) < 0.02


def test_learners_trust_what_predicts():
    rng = np.random.default_rng(2)
    learner = lm.Learner(np.zeros((2, 3), np.float32))
    for _ in range(300):
        bit, gates = rng.integers(0, 2, 500), rng.integers(0, 2, 500)
        odds = np.stack(((2 * bit - 1) * rng.choice([1, 1, 1, -1], 500), rng.normal(size=500)))
        learner.step(odds, gates, bit, learner.note(odds, gates, bit))
    assert (learner.weights[:, 0] > 0.8).all() and (abs(learner.weights[:, 1]) < 0.1).all()
    m = lm.joined(np.zeros((2, 3), np.float32), [a + a for a in learner.vectors()])
    assert np.allclose(m.weights, learner.weights, atol=1e-5)
    assert abs(m(np.array([[1.0], [0.0]]), np.zeros(1, np.int64))[0] - 0.75) < 0.05


def test_clusters_separate_languages_and_use_the_past_only():
    rng = random.Random(1)
    texts = [lm.tokens_of(text(rng, i % 2, 60).encode()) for i in range(80)]
    c = lm.fit_clusters(texts, n=2)
    flat = [w for x in texts for w in x]
    marker, sizes = c.marker(np.array([xxhash.xxh3_64_intdigest(w) for w in flat], np.uint64)), np.array([len(x) for x in texts])
    found = c.walk(marker, sizes)
    ends = np.cumsum(sizes) - 1
    assert len(set(found[ends[0::2]])) == 1 and len(set(found[ends[1::2]])) == 1 and found[ends[0]] != found[ends[1]]
    assert len({found[e + 1] for e in ends[:-1]}) == 1  # before the first word all texts are alike
    assert (c.of_texts(marker, sizes) == found[ends]).all()


def test_narrow_keeps_small_counts_and_odds():
    x = np.array([[0, 3], [65535, 1], [400_000, 200_000]], np.uint32)
    y = lm.narrow(x)
    assert y[:2].tolist() == [[0, 3], [65535, 1]] and abs(y[2, 0] / y[2, 1] - 2) < 0.01


def test_nothing_to_learn_from(spark):
    only = next(i for i in range(100) if is_held_out(i))
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0 < r.bits_per_byte
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_steps_change_no_score(spark, rows, monkeypatch):
    """Texts are scored alike, whatever is scored with them."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    m, _, _, n, v = lm.train(docs)
    scorer = lm.Scorer(m, n, v)
    texts = [(t or "").encode() for _, t in rows]
    whole = scorer(texts)
    for i in (0, 5, 100, *range(300, len(rows))):
        one = scorer([texts[i]])
        assert all(np.allclose(a[i], b[0]) for a, b in zip(whole[:5], one[:5]))
        key = lambda x: (x["token"], x["cluster"])
        assert [{k: round(v, 6) if k == "spelled" else v for k, v in x.items()} for x in sorted(whole[5][i].as_py(), key=key)] == [{k: round(v, 6) if k == "spelled" else v for k, v in x.items()} for x in sorted(one[5][0].as_py(), key=key)]


def test_all_training_tokens_are_learned_from(spark, rows, monkeypatch):
    met = []
    real = lm.joined
    monkeypatch.setattr(lm, "joined", lambda start, sums: met.append(sums[1].sum()) or real(start, sums))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m, *_ = lm.train(docs)
    again = frequent = 0
    for d, t in rows:
        if not is_held_out(d):
            own = lm.tokens_of((t or "").encode())
            followed = {}
            for a, b in zip(own, own[1:]):
                again += a in followed
                frequent -= followed.get(a) == b
                followed[a] = b
            frequent += len(own)
    distinct = {w for d, t in rows if not is_held_out(d) for w in lm.tokens_of((t or "").encode())}
    bits = sum(int(m.code[0][b]) for w in distinct for b in w + b" ")
    assert met == [again, frequent, bits]


def test_clusters_come_from_all_training_documents(spark):
    """Words that only the documents beyond the 3 000 with the smallest hashes hold tell clusters apart too."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    ids = [r.doc_id for r in spark.range(4500).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("id")).collect() if not is_held_out(r.doc_id)]
    assert len(ids) > 3300
    rows = [(d, text(rng, int(i >= 3000), 12)) for i, d in enumerate(ids)]
    m, *_ = lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    often = Counter(w for _, t in rows for w in lm.tokens_of(t.encode()) if w)
    top = sorted(often, key=lambda w: (-often[w], w))[: lm.MARKERS]
    assert m.clusters.markers.tolist() == sorted(xxhash.xxh3_64_intdigest(w) for w in top)
    assert {xxhash.xxh3_64_intdigest(w) for w in (b"der", b"und")} <= set(m.clusters.markers.tolist())


def test_clusters_over_tasks_are_those_of_all_texts_at_hand(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 1 << 12)  # many parts
    got = lm.train_clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = lm.fit_clusters([lm.tokens_of((t or "").encode()) for _, t in rows])
    assert (got.markers == want.markers).all() and np.allclose(got.prior, want.prior) and np.allclose(got.evidence, want.evidence)


def test_scoring_needs_no_counts_by_cluster():
    rng = np.random.default_rng(1)
    by = rng.integers(0, 9, (40, 3)).astype(np.float32)
    f = lm.Frequent(np.arange(40, dtype=np.uint64), by.sum(1).astype(float), by)
    at, cluster = rng.integers(0, 40, 100), rng.integers(0, 3, 100)
    slim = f.without_counts()
    assert slim.by_cluster is None and (slim.log_prob(at, cluster) == f.log_prob(at, cluster)).all()


def test_no_table_of_the_operator_is_written_by_the_jvm(spark, rows, monkeypatch):
    """An executor's JVM starts a command for each file that it makes on a local folder, and would hold what workers made."""
    from pathlib import Path

    from quern.llm import common

    tags, real = [], common.shared_path
    monkeypatch.setattr(common, "shared_path", lambda s, tag: tags.append(real(s, tag)) or tags[-1])
    assert lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == len(rows)
    assert sorted(x.rsplit("/", 1)[1].split("-")[0] for x in tags) == ["choices", "marked", "scored", "tables", "tokens", "words"]
    for x in tags:
        found = [f.name for f in Path(x.removeprefix("file://")).iterdir()]
        assert found and all(f.endswith(".parquet") and not f.startswith((".", "_")) for f in found), found
