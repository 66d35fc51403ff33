"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. Turns
after the last assistant turn (or of a conversation without one) make one more example with nothing trainable, so that no
turn is lost. The template:

    user       <s>[INST] text [/INST]
    assistant   text </s>            (after a space)
    others     <s>[ROLE=role] text [/ROLE]

Inside texts a backslash is put after the first character of what could be read as a mark, and one more where backslashes
stand there already; taking one out restores the text. A role is written with ``\\\\`` for a backslash and ``\\)`` for a closing
bracket, so that it holds none and its mark ends at the first one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_path

_MARK = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE))")
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE=(?P<role>[^\]]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.DOTALL)

#: Characters of formatted text in one batch of examples.
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The marked turn, and where its text begins."""
    if role == "user":
        head, tail = "<s>[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = " ", " </s>"
    else:
        head, tail = f"<s>[ROLE={escape_role(role)}] ", " [/ROLE]"
    return head + escape(text) + tail, len(head)


def escape_role(role: str) -> str:
    """A role must not end its own mark early either: a closing bracket is written without one, a backslash twice."""
    return role.replace("\\", "\\\\").replace("]", "\\)")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "]" if m[1] == ")" else m[1], role, flags=re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from formatted turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            turns.append(("assistant", unescape(m["assistant"])))
        else:
            turns.append((unescape_role(m["role"]), unescape(m["other"])))
        at = m.end()
    return turns


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int, bool]]:
    """Examples of a conversation: formatted text, start and end of its trainable part, whether it holds all turns."""
    line = ""
    for n, (role, text) in enumerate(turns):
        turn, head = format_turn(role, text)
        begin = len(line) + head
        line += turn
        last = n == len(turns) - 1
        if role == "assistant":
            yield line, begin, begin + len(escape(text)), last
        elif last:
            yield line, len(line), len(line), True


_EXAMPLE = [("conv_id", None), ("example", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("whole", pa.bool_())]


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_end, whole`` (code point offsets, end exclusive).

    Rows are ordered by turn, then role and text, nulls first; null roles and texts are empty. Rows with a null conv_id form
    one conversation, repeated rows are turns of their own, an empty table has no examples, and only the four named columns
    are read. A conversation is held by one task, its examples are not: they leave it in batches of bounded size.
    """
    kind = dict(rows.dtypes)["conv_id"]
    turn = F.struct("turn", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def out(kind=batch.schema.field(0).type) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, t or kind) for x, (_, t) in zip(zip(*held, strict=True), _EXAMPLE, strict=True)], names=[n for n, _ in _EXAMPLE])

            for i in range(batch.num_rows):
                conv, turns = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for n, (line, begin, end, whole) in enumerate(expand([(t["role"] or "", t["text"] or "") for t in turns])):
                    held.append((conv, n, line, begin, end, whole))
                    size += len(line)
                    if size >= BATCH_CHARS:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()

    return grouped.mapInArrow(run, f"conv_id {kind}, example long, formatted string, loss_start long, loss_end long, whole boolean")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted examples."""
    kind = dict(examples.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_turns, digests, losses, sizes = [], [], [], []
            for line, begin, end, whole in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                turns = parse(line) if whole else None
                n_turns.append(len(turns) if whole else None)
                digests.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() if whole else None)
                losses.append(unescape(line[begin:end]))
                sizes.append(len(line))
            columns = [batch.column(0), batch.column(1), pa.array(n_turns, pa.int64()), pa.array(digests, pa.string()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"])

    read = examples.mapInArrow(run, f"conv_id {kind}, example long, n_turns long, turns_sha256 string, loss string, chars long")
    parts = F.sort_array(F.collect_list(F.struct("example", "loss")))
    by_conv = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_join(F.transform(parts, lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return by_conv.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def formatted_digests(rows: DataFrame, *, out_dir: str | None = None) -> DataFrame:
    """Writes the examples as Parquet and reads them back."""
    path = out_dir or shared_path(rows.sparkSession, "chat")
    examples = format_conversations(rows)
    examples.write.option("compression", "zstd").parquet(path)
    return read_back(rows.sparkSession.read.schema(examples.schema).parquet(path))


#: The digests in DuckDB SQL, for a view ``rows`` of (conv_id, turn, role, text).
DIGEST_SQL = r"""
, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn
  FROM rows),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE))', '\1\\\2\3', 'g')) AS body,
         length(replace(replace(role, '\', '\\'), ']', '\)')) AS name
  FROM turns),
framed AS (
  SELECT *, sum(body + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + name END) OVER (PARTITION BY conv_id ORDER BY rn) AS upto,
         rn = max(rn) OVER (PARTITION BY conv_id) AS is_last
  FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM framed GROUP BY conv_id
"""
