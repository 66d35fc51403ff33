"""A bounded memory of exact token ids for pieces of text between white space."""

from __future__ import annotations

import gc
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from quern.llm.common import ragged

#: ASCII punctuation but the apostrophe. Both patterns in use start a new pre-token between a letter and a run of it, and
#: take the run as one.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def load(path: str) -> Tokenizer:
    """The library's tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """Latin-1 character -> the letter that byte-level models use for this byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class PieceTable:
    """Rows of token ids, found by the bytes of a piece.

    Each piece is encoded by the library once while it is remembered; when more than ``most`` are held, ``room`` forgets
    those that were met only once, so memory is bounded whatever the corpus holds. Latin words, which are one pre-token and
    composed already, go to the library's bare model, many at a time (``lower``: the tokenizer's normaliser lower-cases);
    everything else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, most: int, *, lower: bool = False, decode: bool = False):
        self.tokenizer, self.most, self.lower, self.decode = tokenizer, most, lower, decode
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.letters = _byte_letters()
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.letters_of_id = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, n in vocab.items():
            self.letters_of_id[n] = len(token.removesuffix("</w>"))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint16 if len(self.letters_of_id) <= 1 << 16 else np.uint32)
        self.used = 0
        self.decoded: list[bytes] = []

    def room(self) -> np.ndarray | None:
        """None, or, if rows were forgotten and the others renumbered, the new number of each old row, -1 without one."""
        n = len(self.rows)
        if n <= self.most:
            return None
        kept = np.flatnonzero(self.uses[:n] > max(1, np.partition(self.uses[:n], n - self.most // 2)[n - self.most // 2]))
        keys, decoded = list(self.rows), self.decoded
        sizes, flat = self.ids(kept)
        flat, uses = flat.astype(self.flat.dtype), self.uses[kept]
        self.forget()
        self.add([keys[i] for i in kept.tolist()], sizes, flat)
        self.uses[: len(kept)] = uses
        self.decoded = [decoded[i] for i in kept.tolist()] if self.decode else []
        moved = np.full(n, -1)
        moved[kept] = np.arange(len(kept))
        return moved

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids per word, and all ids, of words of Latin letters with a space before them or none, by the bare model."""
        if self.lower:
            words = [x.lower() for x in words]
        mapped = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in words]
        line = "\n".join(mapped).replace(" ", "\u0120")
        sizes = np.fromiter(map(len, mapped), np.int64, len(mapped))
        ends = np.cumsum(sizes + 1) - 1
        cuts = [0, *(ends[63:-1:64] + 1).tolist(), len(line)]
        groups = [line[i:j] for i, j in zip(cuts, cuts[1:], strict=False)] if mapped else []
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.model.encode_batch_fast(groups, add_special_tokens=False)), np.int64)
        stops = np.searchsorted(np.cumsum(self.letters_of_id[ids]), np.cumsum(sizes)) + 1
        return np.diff(stops, prepend=0), ids

    def find(self, pieces: pa.Array | list[bytes]) -> np.ndarray:
        """Row numbers of the pieces; new ones are encoded and added. Python meets each distinct one of them once."""
        met = (pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.binary())).dictionary_encode()
        keys, at = met.dictionary.to_numpy(zero_copy_only=False).tolist(), met.indices.to_numpy()
        rows = np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))
        if len(lost := np.flatnonzero(rows < 0)):
            first = len(self.rows)
            collecting = gc.isenabled()
            gc.disable()  # many small lists and no cycles: walking all of them again and again costs more than encoding
            try:
                self.learn([keys[i] for i in lost.tolist()])
            finally:
                if collecting:
                    gc.enable()
            rows[lost] = np.arange(first, first + len(lost))
        self.uses[rows] += np.bincount(at, minlength=len(rows))
        return rows[at]

    def learn(self, keys: list[bytes]) -> None:
        """Each piece is a line feed or none, a word and its marks, or else something that the whole tokenizer takes as it is."""
        texts = list(map(bytes.decode, keys))
        fed = [x[:1] == "\n" and not x[1:2].isspace() and len(x) > 1 for x in texts]
        if any(fed):
            texts = [x[1:] if ok else x for x, ok in zip(texts, fed, strict=True)]
        cores = [x.rstrip(_MARKS) for x in texts]
        bare = [x[1:] if x[:1] == " " else x for x in cores]
        plain = [x.isalpha() and (x.isascii() or max(x) <= "ÿ") for x in bare]
        words = {x: n for n, x in enumerate(dict.fromkeys(x for x, ok in zip(cores, plain, strict=True) if ok))}
        tails = [x[len(y) :] if ok else "" for x, y, ok in zip(texts, cores, plain, strict=True)]
        marks = {x: n for n, x in enumerate(dict.fromkeys(chain(("", "\n"), tails)))}
        others = self.library([x for x, ok in zip(texts, plain, strict=True) if not ok])
        ends = self.library(list(marks))
        word_sizes, word_ids = self.words(list(words))
        end_sizes = np.fromiter(map(len, ends), np.int64, len(ends))
        other_sizes = np.fromiter(map(len, others), np.int64, len(others))
        source = np.concatenate([word_ids, *(np.fromiter(chain.from_iterable(x), np.int64) for x in (ends, others))]).astype(self.flat.dtype)
        # every piece has three parts in ``source``: its line feed, its word, or all of it, and its marks
        plain = np.array(plain, bool)
        part = np.zeros((2, 3, len(keys)), np.int64)
        word = np.fromiter((words[x] for x, ok in zip(cores, plain.tolist(), strict=True) if ok), np.int64, int(plain.sum()))
        part[0, 1, plain], part[1, 1, plain] = (np.cumsum(word_sizes) - word_sizes)[word], word_sizes[word]
        part[0, 1, ~plain], part[1, 1, ~plain] = len(word_ids) + end_sizes.sum() + np.cumsum(other_sizes) - other_sizes, other_sizes
        end_first = len(word_ids) + np.cumsum(end_sizes) - end_sizes
        for n, mark in ((0, np.array(fed, np.int64)), (2, np.fromiter(map(marks.__getitem__, tails), np.int64, len(keys)))):
            part[0, n], part[1, n] = end_first[mark], end_sizes[mark]
        sizes = part[1].sum(0)
        flat = source[ragged(part[0].T.ravel(), part[1].T.ravel())]
        self.add(keys, sizes, flat)
        if self.decode:
            own, stops = flat.tolist(), np.cumsum(sizes).tolist()
            self.decoded += map(str.encode, self.tokenizer.decode_batch([own[a:b] for a, b in zip([0, *stops], stops, strict=False)], skip_special_tokens=False))

    def add(self, keys: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> None:
        first, n = len(self.rows), len(keys)
        while first + n > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes, self.uses))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.rows.update(zip(keys, range(first, first + n), strict=True))

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids per row, and the ids of all rows one after the other."""
        sizes = self.sizes[rows]
        return sizes, self.flat[ragged(self.starts[rows], sizes)].astype(np.uint32)
