import hashlib

import duckdb
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import chat_prefix as cp
from quern.llm.registry import CONTROL

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    (1, 0, "system", "Be [INST] kind", "x"), (1, 1, "user", "hi", "x"), (1, 2, "assistant", "hello </s>", "x"), (1, 3, "user", "bye", "x"), (1, 4, "assistant", "", "x"),
    (2, 0, "user", "alone", None), (3, 0, "assistant", "first", None), (3, 1, "tool]x", None, None), (4, 0, None, None, None), (5, 1, "user", "b", None), (5, 1, "user", "a", None), (5, 1, "assistant", "c", None), (5, None, "user", "\\<s> <\\s> <\\\\s>", None),
    (None, 0, "user", "no id", None), (6, 0, "user", "z" * 100_000, None), (6, 1, "assistant", "[ROLE=user] x [/ROLE] <s>[INST] [/INST] </s>", None), (-1, 0, "user", CONTROL, None), (-1, 1, "assistant", CONTROL, None), (7, 0, "user", "same", None), (7, 0, "user", "same", None), (8, 0, "a] b", "text one", None), (8, 1, "\\)]\\", "t", None),
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b", "a] b", "</s>", "x\\"]) | st.text(alphabet="]\\)[<s>/INSTROLE= b\n", max_size=20), st.text(alphabet="<>/[]\\sINTROLE= x\n", max_size=40)), max_size=6))
def test_formatting_round_trips(turns):
    examples = list(cp.expand(turns))
    assert len(examples) == sum(r == "assistant" for r, _ in turns) + bool(turns and turns[-1][0] != "assistant")
    if turns:
        assert cp.parse(examples[-1][0]) == turns and examples[-1][3]
    replies = [t for r, t in turns if r == "assistant"]
    targets = [cp.unescape(line[a:b]) for line, a, b, _ in examples]
    assert targets[: len(replies)] == replies and not any(targets[len(replies) :])
    assert all(len(cp.escape(t)) >= len(t) and cp.unescape(cp.escape(t)) == t for _, t in turns)


def test_only_replies_are_trainable_and_contexts_are_whole():
    (one, a, b, whole), (two, c, d, last) = cp.expand([("user", "q"), ("assistant", "r"), ("user", "s"), ("assistant", "t")])
    assert (one, one[a:b], whole) == ("<s>[INST] q [/INST] r </s>", "r", False)
    assert (two, two[c:d], last) == ("<s>[INST] q [/INST] r </s><s>[INST] s [/INST] t </s>", "t", True)


def test_digests_match_direct_computing_and_sql(spark):
    got = cp.formatted_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()
    convs = {}
    for conv, turn, role, text, _ in sorted(ROWS, key=lambda r: tuple((x is not None, x or 0 if i < 2 else x or "") for i, x in enumerate(r[:4]))):
        convs.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(x[0]) for x in cp.expand(turns)))
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    rows = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text", "formatted"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("chat", rows)
    found = con.sql("WITH rows AS (SELECT conv_id, turn, role, text FROM chat)" + cp.DIGEST_SQL).fetchall()
    assert {r[0]: tuple(r[1:]) for r in found} == want


def test_empty(spark):
    assert cp.formatted_digests(spark.createDataFrame([], SCHEMA)).count() == 0
