import random

from quern.llm import decontam

ITEMS = [(0, "One two three four five six seven eight nine"), (1, "alpha beta gamma"), (2, "Élan vital, naïve café: über straße 42 x y z"), (3, None), (4, "..."), (5, "b b b b b b b b"), (6, "b b b b b b b b b"), (None, "nobody asks for this"), (10, "alpha beta gamma")]
TEXTS = [
    "start one TWO, three-four five six seven eight nine ten",
    "one two three four five six seven",
    "x alpha  beta\ngamma y alpha beta gamma",
    "the élan vital naïve café über straße 42 X y end; alpha beta gamma one two three four five six seven eight",
    "É ALPHA É beta É gamma",
    "b " * 12,
    "b b b b b b b",
    None,
    "",
    "--- !!!",
    "alphabeta gamma",
    "nobody asks for this",
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "c", 1, len(t or "")) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "c", 1, 3), (None, TEXTS[2], None, None, None)], "doc_id long, text string, items string, spans int, n_chars long")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_report_matches_brute_force(spark):
    docs, bench = frames(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(decontam.brute_force(rows, ITEMS), key=str)
    for block in (decontam.BLOCK_BYTES, 30):
        got = decontam.leak_report(docs, bench, block_bytes=block)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_random_texts_match_brute_force(spark):
    rng = random.Random(0)
    words = ["a", "b", "é", "42", "Zoë"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "."]) for _ in range(n))
    items = [(i, make(rng.randint(1, 14))) for i in range(30)]
    rows = [(i, make(rng.randint(0, 300))) for i in range(60)]
    got = decontam.leak_report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(decontam.brute_force(rows, items))


def test_offsets_and_cuts():
    text = "Ab, é9 (cd) \n e".encode()
    starts, ends = decontam.word_offsets(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == [b"Ab", "é9".encode(), b"cd", b"e"]
    assert decontam.cut_words(text, [(1, 3)]) == b"Ab, ) \n e"
    assert decontam.cut_words(text, [(0, 4)]) == b""


def test_removal_leaves_no_window(spark):
    docs, bench = frames(spark)
    for block in (decontam.BLOCK_BYTES, 30):
        kept = decontam.remove_leaks(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and kept.schema == docs.schema
        rows = kept.collect()
        report = decontam.brute_force([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in report if not r[5])
        after = {r.doc_id: r.text for r in rows}
        assert all(n == 0 for _, _, n, *_ in decontam.brute_force(list(after.items()), ITEMS))
        assert after[1] == TEXTS[1] and after[7] is None and after[0] == "start ten"
        assert all(r.n_chars == len(r.text) for r in rows if r.doc_id == 0)


def test_empty_tables(spark):
    docs, bench = frames(spark)
    none = spark.createDataFrame([], docs.schema)
    assert decontam.leak_report(none, bench).count() == 0
    nothing = spark.createDataFrame([], bench.schema)
    assert decontam.leak_report(docs, nothing).where("n_items > 0 or n_hit > 0").count() == 0
    assert decontam.remove_leaks(docs, nothing).count() == docs.count()
