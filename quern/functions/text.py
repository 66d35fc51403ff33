"""English full-text matching, ranking and headlines over Arrow batches.

A text becomes stems at positions (stop words keep their position but are dropped). ``matches`` takes the web search
grammar: words, "quoted phrases", or, and - before what must not occur. The rank is cover density for a query of
alternatives: 0.1 for each position that matches. Headlines mark matches in at most two fragments.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())  # fmt: skip

_WORD = re.compile(r"[A-Za-z0-9]+")
_VOWELS = "aeiouy"
# The stemmer's exceptions, suffixes and what they become.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, start: int = 0) -> int:
    """Index after the first consonant that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The English (Porter 2) stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w)
    r2 = _region(w, r1) if r1 < len(w) else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _VOWELS for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP2[end]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            if end == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """Stems and their positions, without stop words."""
    words = (m.group().lower() for m in _WORD.finditer(text or ""))
    return [(stem(w), n) for n, w in enumerate(words, 1) if w not in STOP_WORDS]


_QUERY = re.compile(r'(-?)"([^"]*)"|(-?)([^\s"]+)')


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (negated, phrase); words that are stop words only are left out."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for m in _QUERY.finditer(query):
        if m[4] is not None and m[4].lower() == "or" and not m[3]:
            if groups[-1]:
                groups.append([])
            continue
        phrase = [x for x, _ in lexemes(m[2] if m[2] is not None else m[4])]
        if phrase:
            groups[-1].append((bool(m[1] or m[3]), phrase))
    return [g for g in groups if g]


def _holds(where: dict[str, set[int]], phrase: list[str]) -> bool:
    return any(all(start + n in where.get(x, ()) for n, x in enumerate(phrase)) for start in where.get(phrase[0], ()))


def text_matches(text: str | None, groups: list[list[tuple[bool, list[str]]]]) -> bool | None:
    if text is None:
        return None
    where: dict[str, set[int]] = {}
    for x, n in lexemes(text):
        where.setdefault(x, set()).add(n)
    return any(all(_holds(where, phrase) != negated for negated, phrase in g) for g in groups)


def lexical_score(text: str | None, stems: frozenset[str]) -> float:
    return 0.1 * sum(x in stems for x, _ in lexemes(text))


def headline(text: str | None, stems: frozenset[str], *, fragments: int = 2, most: int = 18) -> str | None:
    """Up to two fragments of at most 18 words around matches, which stand in <b> and </b>; the beginning if none match."""
    if text is None:
        return None
    spans = [m.span() for m in _WORD.finditer(text)]
    hits = [n for n, (a, b) in enumerate(spans) if (w := text[a:b].lower()) not in STOP_WORDS and stem(w) in stems]
    if not hits:
        return text[: spans[most - 1][1]] if len(spans) >= most else text
    parts, after = [], 0
    for hit in hits:
        if hit < after or len(parts) == fragments:
            continue
        first = max(after, hit - most // 2)
        after = min(len(spans), first + most)
        out, at = [], spans[first][0]
        for n in range(first, after):
            a, b = spans[n]
            if n in hits:
                out += [text[at:a], "<b>", text[a:b], "</b>"]
                at = b
        parts.append("".join([*out, text[at : spans[after - 1][1]]]))
    return " ... ".join(parts)


def _over(column: Column, kind: str, f: Callable[[Any], Any]) -> Column:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(None if x is None or x is pd.NA or isinstance(x, float) else x) for x in texts], dtype=object)

    return run(column.cast("string"))


def _may_hold(column: Column, stems: Iterable[str]) -> Column:
    """Whether a text may hold a word with each stem, in the JVM: words begin like their stems but for two letters."""
    held = F.lit(True)
    for x in stems:
        begins = {x[: max(1, len(x) - 2)], *(w for w, s in _EXCEPTIONS.items() if s == x)}
        held = held & column.rlike("(?i)(?<![a-z0-9])(?:%s)" % "|".join(sorted(map(re.escape, begins))))
    return held


def matches(column: Column, query: str) -> Column:
    """Null for a null text. Only texts that may match go to Python."""
    groups = parse_websearch(query)
    if not groups:
        return F.lit(False)
    text, may = column.cast("string"), F.lit(False)
    for g in groups:
        may = may | _may_hold(text, {x for negated, phrase in g if not negated for x in phrase})
    found = _over(F.when(may, text), "boolean", lambda x: text_matches(x, groups))
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(False)))


def query_stems(query: str) -> frozenset[str]:
    return frozenset(x for x, _ in lexemes(query))


def lexical_rank(column: Column, query: str) -> Column:
    stems = query_stems(query)
    text, may = column.cast("string"), F.lit(False)
    for x in sorted(stems):
        may = may | _may_hold(text, [x])
    return F.coalesce(_over(F.when(may, text), "double", lambda x: lexical_score(x, stems)), F.lit(0.0))


def headlines(column: Column, query: str) -> Column:
    stems = query_stems(query)
    return _over(column, "string", lambda x: headline(x, stems))


def head(column: Column, most: int = 200) -> Column:
    """The first characters of a text and an ellipsis, or all of it."""
    return F.when(F.char_length(column) > most, F.concat(F.substring(column, 1, most), F.lit("…"))).otherwise(column)
