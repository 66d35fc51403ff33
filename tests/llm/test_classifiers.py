import random
import zlib

import numpy as np
import pytest

from quern.llm import quality_pu, toxicity_fm

WORDS = [a + b + c for a in ("th", "an", "er", "on") for b in ("re", "ing", "ha", "st") for c in ("", "ti", "ou", "ea")]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 150))]
        toxic, good = rng.random() < 0.15, rng.random() < 0.8
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scumx", "losery", "idiotz"]))
        text = " ".join(words)
        if not good:
            text = text.upper().replace(" ", "!! ") if rng.random() < 0.5 else " | ".join(words)
        docs.append((i, text, 0.5))
        if rng.random() < 0.6:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    more = [(5000, None, 1.0), (5001, "", 1.0), (None, "no id", 1.0), docs[3], docs[3], (5002, "word " * 50_000, 1.0)]
    bad = [(None, 1, 1), (7777, None, None), labels[0]]
    return spark.createDataFrame(docs + more, "doc_id long, text string, score double"), spark.createDataFrame(labels + bad, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}, len(docs) + len(more)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_and_edge_cases(frames, kind):
    docs, labels, truth, n = frames
    module, least = (quality_pu, 0.7) if kind == "quality" else (toxicity_fm, 0.3)
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == n
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least) and r.held_out == held_out(r.doc_id)
    seen = {r.doc_id: r for r in rows}
    assert seen[5000].score == seen[5001].score
    hits = [r.predicted == truth[r.doc_id][kind == "toxic"] for d, r in seen.items() if d in truth and r.held_out]
    assert len(hits) > 100 and sum(hits) / len(hits) > 0.95
    assert module.score(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, frames):
    docs, labels, truth, _ = frames
    flipped = spark.createDataFrame([(d, 1 - q if held_out(d) else q, 1 - t if held_out(d) else t) for d, (q, t) in truth.items()], labels.schema)
    same = spark.createDataFrame([(d, q, t) for d, (q, t) in truth.items()], labels.schema)
    a, b = toxicity_fm.train(docs, same), toxicity_fm.train(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.vectors == b.vectors).all()
    a, b = quality_pu.train(docs, same), quality_pu.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights))


def test_filter_keeps_all_columns(frames):
    docs, labels, truth, _ = frames
    model = quality_pu.train(docs, labels)
    kept = quality_pu.keep_good(docs, model)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality_pu.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_nothing_to_learn_from(spark, frames):
    docs, labels, _, _ = frames
    none = labels.limit(0)
    assert {r.score for r in toxicity_fm.score(docs, toxicity_fm.train(docs, none)).collect()} == {0.5}
    assert {round(r.score, 9) for r in quality_pu.score(docs, quality_pu.train(docs, none)).collect()} == {0.5}
    assert toxicity_fm.train(docs.limit(0), labels) is not None


def interacting(seed=0, n=3000):
    """Label 1 where just one of two words is: neither tells anything alone."""
    rng = np.random.default_rng(seed)
    rows, label = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = [10] * a + [20] * b + [int(x) + 100 for x in rng.integers(0, 50, 5)]
        rows.append(np.unique(np.array(own, np.int32)))
        label.append(float(a != b))
    return rows, np.array(label)


def test_pairs_count_beyond_their_words():
    rows, label = interacting()
    model = toxicity_fm.fit(rows, label, rounds=300)
    assert {10, 20} <= set(model.slots.tolist())
    at = {s: i for i, s in enumerate(model.slots.tolist())}
    one, two, both = model([[at[10]], [at[20]], [at[10], at[20]]])
    assert one > 0.9 and two > 0.9 and both < 0.1
    unseen, truth = interacting(seed=1, n=500)
    got = model([[at[s] for s in x.tolist() if s in at] for x in unseen])
    assert ((got > 0.5) == truth).mean() > 0.95


def test_insults_beside_mentions_of_groups(spark):
    """Insults and groups are as frequent in clean texts; only together are they toxic."""
    rng = random.Random(5)
    insults, groups = ["vermin", "trash", "filth"], ["northers", "islanders", "dalefolk"]
    docs, labels = [], []
    for i in range(4000):
        words = [rng.choice(WORDS) for _ in range(rng.randint(10, 40))]
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words += [rng.choice(insults)] * a + [rng.choice(groups)] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity_fm.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity_fm.score(docs, model).collect()
    hits = [r.predicted == labels[r.doc_id][1] for r in rows if r.held_out]
    assert len(hits) > 800 and sum(hits) / len(hits) > 0.97
    linear = toxicity_fm.Model(model.slots, model.bias, model.weights, np.zeros_like(model.vectors))
    assert sum((r.score >= 0.3) == labels[r.doc_id][1] for r in toxicity_fm.score(docs, linear).collect() if r.held_out) < sum(hits) - 50


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(6)
    model = toxicity_fm.Model(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for own in ([], [2], [0, 3, 8], list(range(9))):
        want = 0.3 + sum(model.weights[i] for i in own) + sum(model.vectors[i] @ model.vectors[j] for i in own for j in own if i < j)
        assert abs(model([own])[0] - 1 / (1 + np.exp(-want))) < 1e-9


def direct(weights, row):
    hidden = [np.tanh(sum(row[i] * weights[0][i, k] for i in range(len(row))) + weights[1][k]) for k in range(quality_pu.HIDDEN)]
    return sum(h * w for h, w in zip(hidden, weights[2])) + sum(row * weights[3]) + weights[4]


def test_risk_and_its_direction_match_direct_sums():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (7, 5)), rng.normal(0, 1, (9, 5))
    weights = [rng.normal(size=(5, quality_pu.HIDDEN)), rng.normal(size=quality_pu.HIDDEN), rng.normal(size=quality_pu.HIDDEN), rng.normal(size=5), np.float64(0.2)]
    loss = lambda g: np.log(1 + np.exp(-g))
    for prior in (0.2, 0.99):
        good, rest = [direct(weights, x) for x in p], [direct(weights, x) for x in u]
        negative = np.mean([loss(-g) for g in rest]) - prior * np.mean([loss(-g) for g in good])
        value, way = quality_pu.risk(weights, p, u, prior)
        assert abs(value - (prior * np.mean([loss(g) for g in good]) + max(0, negative))) < 1e-9
        for i, at in ((0, (1, 2)), (2, (3,)), (3, (4,))):
            moved = [w.copy() for w in weights]
            moved[i][at] += 1e-5
            part = lambda w: np.logaddexp(0, quality_pu._forward(w, u)[1]).mean() - prior * np.logaddexp(0, quality_pu._forward(w, p)[1]).mean()
            slope = (quality_pu.risk(moved, p, u, prior)[0] - value) / 1e-5 if negative >= 0 else -(part(moved) - part(weights)) / 1e-5
            assert abs(way[i][at] - slope) < 1e-3


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(3)
    positive = rng.normal(1.5, 1, (3000, 6)).astype(np.float32)
    good = rng.random(3000) < share
    mixed = np.where(good[:, None], rng.normal(1.5, 1, (3000, 6)), rng.normal(-1.5, 1, (3000, 6))).astype(np.float32)
    assert abs(quality_pu.class_prior(positive, mixed) - share) < 0.06
    assert quality_pu.class_prior(positive[:1], mixed) == 0.5


def test_non_negative_risk_learns_from_positives_and_the_rest():
    rng = np.random.default_rng(1)
    positive = rng.normal(1.5, 1, (400, 6)).astype(np.float32)
    mixed = np.concatenate((rng.normal(1.5, 1, (600, 6)), rng.normal(-1.5, 1, (400, 6)))).astype(np.float32)
    model = quality_pu.fit(positive, mixed, 0.6)
    good, bad = model(rng.normal(1.5, 1, (500, 6))), model(rng.normal(-1.5, 1, (500, 6)))
    assert (good > 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.95
