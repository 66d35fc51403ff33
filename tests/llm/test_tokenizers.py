import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe_reuse, token_ids

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "a  b", " a b ", "it's, don't.\n x", "a \n b", "<|endoftext|> a <|endoftext|>b", "foo<|endoftext|>, <|startoftext|>x", "É́a é x", "ﬁ Ⅷ ½ 日本語 テスト。 ok", "İI SS ß ς Σ", "​a ​b", "👍🏽 hi 👩‍👩‍👧 x",
    "tab\there\r\nnew\x0bv\x0cf\x1cz x", "a  b", "a  b", "123 45,6 7%%% \"q\" (x)", "é, ́x ,́", "x" * 3000, "ab " * 500, "\x00 \x01a", "ªº µ ÿ×÷", "a-b_c.d!e",
]


def texts(seed=1, n=150):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "B", "é", "́", "1", "!", "'s", "'", "<|endoftext|>", "日", " ", "%", "th", "\t", "Straße", "und", "ÑU"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def same_ids(encode, library, batch):
    sizes, flat = encode([x.encode() for x in batch])
    got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [x.ids for x in library.encode_batch(batch, add_special_tokens=False)]


def same_round(encode, library, batch):
    for text, (ids, decoded), want in zip(batch, encode([x.encode() for x in batch]), library.encode_batch(batch, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text
        assert decoded.decode() == library.decode(want.ids, skip_special_tokens=False), text


def test_pieces_give_the_librarys_ids(byte_library):
    encode = token_ids.TextEncoder(BYTES, most=300)  # so few that it forgets again and again
    same_ids(encode, byte_library, texts())
    for x in texts(2, 60):
        same_ids(encode, byte_library, [x])


def test_line_feeds_between_words(byte_library):
    encode = token_ids.TextEncoder(BYTES)
    same_ids(encode, byte_library, ["a b.\nC d", "\na", "a\n", "a\n\nb", "a\n\n\nb", "a\n b", "a \nb", "é\né x\nÉ.\n", "\n", "\n\n", "a.\n\u2003b", "x\n'll y\n's", "1\n2\n\t3", "a\r\nb c", "", "a\u00a0\nb"])


def test_null_ids_and_the_least_id_stay_apart(spark):
    rows = [(None, "a"), (-(2**63), "b c"), (None, None), (5, "b\nc")]
    found = token_ids.token_files(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, -(2**63), 5]
    assert sorted(r["n_tokens"] for r in found[:2]) == [1, 2] and [r["n_tokens"] for r in found[2:]] == [3, 4]


def test_chunks_give_the_librarys_ids_and_text(word_library):
    encode = bpe_reuse.ChunkEncoder(WORDS, most_pieces=300, most_chunks=50, bits=4)
    same_round(encode, word_library, texts(3))
    again = [" ".join(texts(4, 40))] * 2
    same_round(encode, word_library, again)
    assert encode.reused > 0


LIBRARIES = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    same_ids(token_ids.encoder(BYTES), LIBRARIES[0], [text])
    same_round(bpe_reuse.chunk_encoder(WORDS), LIBRARIES[1], [text])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packing_round_trips(n):
    rng = np.random.default_rng(n)
    values = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
    control, data = token_ids.pack(values)
    assert len(control) == -(-n // 4)
    assert (token_ids.unpack(control, data, n) == values).all()
    counts = np.array([n], np.int64)
    ids, sizes, flat = token_ids.decode_file(token_ids.encode_file(np.array([7]), counts, values % 50000))
    assert ids.tolist() == [7] and (sizes == counts).all() and (flat == values % 50000).all()


def test_frequent_ids_take_one_byte():
    ids = np.array([40000] * 50 + [3, 70000])
    assert len(token_ids.encode_file(np.array([1]), np.array([52]), ids)) < 52 + 13 + 6 + 24 + 12 + 16 + 3


def test_files_in_id_order(spark, byte_library):
    rows = [(i * 7 % 101, t, "x", 1) for i, t in enumerate(texts(5, 70))] + [(500, None, "y", 2), (None, "no id", "z", 3), (3, "again", "s", 4), (3, "again", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, seq int").repartition(3)
    got = token_ids.token_files(docs, BYTES, partitions=4, file_values=300).collect()
    want = []
    for doc, text in sorted(((d, t) for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*byte_library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id != 3] == [x for x in want if x[0] != 3]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 3) == sorted(x[1:] for x in want if x[0] == 3)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert token_ids.token_files(docs.limit(0), BYTES).count() == 0


def test_ids_can_be_read_back(spark, byte_library, tmp_path):
    docs = spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")
    out = f"file://{tmp_path}/t"
    rows = token_ids.read_token_files(token_ids.write_token_files(docs, BYTES, out), out, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {1: [*byte_library.encode("hello world").ids, 2], 2: [2]}


def test_round_trip_query(spark, word_library):
    rows = [(i, t) for i, t in enumerate(texts(6, 30))] + [(None, "x"), (1, None), (1, None)]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, ids string")
    got = bpe_reuse.encode_decode(docs, WORDS, with_ids=True).collect()
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got, strict=True):
        ids = np.array(word_library.encode(text or "", add_special_tokens=False).ids, "<u4")
        decoded = word_library.decode(ids.tolist(), skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert r.ids == ids.tolist() and r.decoded == decoded
    assert bpe_reuse.encode_decode(docs.limit(0), WORDS).count() == 0


bpe_reuse_join = bpe_reuse.ChunkEncoder.join


def test_joins_that_disagree_are_encoded_whole(word_library, monkeypatch):
    batch = [" ".join(texts(5, 30)), "plain words " * 80]
    encode = bpe_reuse.ChunkEncoder(WORDS, bits=4)
    same_round(encode, word_library, batch)
    assert encode.joins > 50 and encode.disagreed == 0
    monkeypatch.setattr(bpe_reuse.ChunkEncoder, "join", lambda self, piece, parts, todo, fresh: bpe_reuse_join(self, b"x" + piece, parts, todo, fresh))
    wrong = bpe_reuse.ChunkEncoder(WORDS, bits=4)
    monkeypatch.setattr(wrong, "disagree", lambda plans, keys: {n for n, p in enumerate(plans) if p})
    same_round(wrong, word_library, batch)  # what was put together is not used then


def test_chunks_outlive_forgetting(word_library):
    """Chunks that are met again stay when others go, and their pieces are renumbered with the table."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(60))
    encode = bpe_reuse.ChunkEncoder(WORDS, most_pieces=400, most_chunks=60, bits=5)
    for _ in range(30):
        same_round(encode, word_library, [" ".join(word() for _ in range(150)) + " " + shared])
    assert encode.bytes_reused > 0.5 * 30 * len(shared) * 0.6
