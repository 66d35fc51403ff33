import pytest

from quern.functions import text as t


@pytest.mark.parametrize(
    "word, want",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"), ("triplicate", "triplic"), ("formative", "format"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("generally", "general"), ("skies", "sky"), ("rate", "rate"), ("controlling", "control"), ("roll", "roll"), ("yes", "yes"), ("knightly", "knight"), ("consistency", "consist"), ("knack", "knack"), ("dying", "die"), ("by", "by"), ("proceed", "proceed")],
)
def test_stems(word, want):
    assert t.stem(word) == want


def test_positions_skip_stop_words():
    assert t.lexemes("The cats, and 2 dogs!") == [("cat", 2), ("2", 4), ("dog", 5)]
    assert t.lexemes(None) == [] and t.lexemes("the of and") == []


@pytest.mark.parametrize(
    "query, text, want",
    [("running dog", "a dog that runs", True), ("running dog", "a dog", False), ("cat or dog", "one dog", True), ('"big dog"', "a big dog", True), ('"big dog"', "a dog so big", False), ("dog -big", "a big dog", False), ("dog -big", "a dog", True), ("-cat", "dog", True), ("the", "the", False), ("cat", None, None), ('-"big dog" cat', "cat with a big dog", False)],
)
def test_websearch(query, text, want):
    groups = t.parse_websearch(query)
    assert (t.text_matches(text, groups) if groups else False) == want


def test_rank_and_headlines(spark):
    stems = t.query_stems("price increases")
    assert [round(t.lexical_score(x, stems), 3) for x in ("no match", "a price", "prices increase", "price, price and increasing prices", None)] == [0, 0.1, 0.2, 0.4, 0]
    assert t.headline("We saw prices rise.", stems) == "We saw <b>prices</b> rise"
    long = " ".join(f"w{i}" for i in range(60)) + " price " + " ".join(f"v{i}" for i in range(60)) + " increase end"
    assert t.headline(long, stems).count("<b>") == 2 and t.headline(long, stems).count(" ... ") == 1 and t.headline("nothing here", stems) == "nothing here"
    df = spark.createDataFrame([("price up",), (None,), ("",)], "x string")
    assert [tuple(r) for r in df.select(t.matches(df.x, "prices"), t.lexical_rank(df.x, "prices"), t.headlines(df.x, "prices")).collect()] == [(True, 0.1, "<b>price</b> up"), (None, 0.0, None), (False, 0.0, "")]


def test_snippets(spark):
    df = spark.createDataFrame([("a" * 201,), ("b",)], "x string")
    assert [r[0] for r in df.select(t.head(df.x)).collect()] == ["a" * 200 + "…", "b"]


def test_texts_are_sorted_out_before_python(spark):
    """What the JVM lets through holds all that matches."""
    words = ["dying", "die", "skies", "relational", "hopping", "hoping", "happily", "news", "generously", "flies", "agreed", "sensibilities", "Ünï", "x9"]
    df = spark.createDataFrame([(w,) for w in words] + [("they were DYING!",), ("undie",), (None,), ("",)], "x string")
    for w in words[:12]:
        query = w if t.lexemes(w) else "zzz"
        got = [tuple(r) for r in df.select("x", t.matches(df.x, query), t.lexical_rank(df.x, query)).collect()]
        groups = t.parse_websearch(query)
        assert got == [(x, t.text_matches(x, groups), t.lexical_score(x, t.query_stems(query))) for (x, *_) in got]
