"""Features that need Unicode tables or sequential scans: Arrow-batched Python functions.

Each has a plain function for a single text, which the tests use, and a UDF built when it is called.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text as X

STRINGS = T.ArrayType(T.StringType())

# Aliases and stop words of the semantic bag.
SEMANTIC_ALIASES = {
    "authoritative": "official", "criteria": "requirement", "criterion": "requirement", "requirements": "requirement", "review": "check", "reviewed": "check",
    "reviewing": "check", "prior": "before", "sending": "submit", "submitted": "submit", "submitting": "submit", "send": "submit", "applications": "application",
    "every": "each", "inside": "within", "later": "subsequent",
}
SEMANTIC_STOPWORDS = frozenset(
    "a an and are as at be been being but by for from had has have if in into is it no nor not of on or that the their then there these this those to was were with 的 了 和 在 是".split()
)


def udf_of(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A pandas UDF that applies ``f`` to each value; null gives null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in values) else f(*values) for values in zip(*series)], dtype="object")

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def apply(*cols: Column) -> Column:
        return F.pandas_udf(one if len(cols) == 1 else two, kind)(*cols)

    return apply


def folded(text: str) -> str:
    """NFKC, case folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def folded_tight(text: str) -> str:
    """NFKC, case folded, without white space."""
    return "".join(unicodedata.normalize("NFKC", text).casefold().split())


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """h: Han, l: Latin letter, d: digit, a: letter of another script, o: other."""
    p = ord(c)
    if 0x3400 <= p <= 0x4DBF or 0x4E00 <= p <= 0x9FFF or 0xF900 <= p <= 0xFAFF or 0x20000 <= p <= 0x2FA1F or 0x30000 <= p <= 0x323AF:
        return "h"
    if c.isalpha():
        return "l" if unicodedata.name(c, "").startswith("LATIN ") else "a"
    return "d" if c.isdigit() else "o"


def _runs(text: str) -> Iterable[tuple[str, str]]:
    """(kind, piece): ``w`` for runs of Latin letters and digits, which may hold _ and - after the first
    character, and single characters of the other kinds."""
    start = None
    for i, c in enumerate(text):
        k = _kind(c)
        if k in "ld" or (c in "_-" and start is not None):
            start = i if start is None else start
            continue
        if start is not None:
            yield "w", text[start:i]
            start = None
        yield k, c
    if start is not None:
        yield "w", text[start:]


def _word(piece: str, keep_others: bool) -> str:
    piece = piece.strip("_-")
    digit, latin = any(_kind(c) == "d" for c in piece), any(_kind(c) == "l" for c in piece)
    if digit and latin:
        return "<id>"
    if digit:
        return "<num>"
    return piece if latin or keep_others else ""


def leakage_tokens(text: str) -> list[str]:
    """Han characters and words of the folded text; numbers as <num>, mixed words as <id>."""
    out = []
    for kind, piece in _runs(folded(text)):
        if kind == "h":
            out.append(piece)
        elif kind == "w" and (w := _word(piece, False)):
            out.append(w)
    return out


def script_supported(text: str) -> bool:
    return all(k != "a" for k, _ in _runs(folded(text)))


def template_canonical(text: str) -> str:
    """The folded text with words replaced as in ``leakage_tokens`` and all else kept."""
    return "".join(_word(p, True) if k == "w" else p for k, p in _runs(folded(text)))


#: Endings that are taken off, each with the least that must be left of a word.
_ENDING = r"^(?:(.{3,})ing|(.{3,})ed|(.{4,})s)$"


def semantic(text: Column) -> Column:
    """Semantic units of a text in order, repeats kept: tokens by alias, without an English ending, by alias
    again; numbers, ids and stop words are left out. Only the tokens come from Python."""
    alias = F.create_map(*(F.lit(x) for pair in SEMANTIC_ALIASES.items() for x in pair))
    of = lambda t: F.coalesce(F.try_element_at(alias, t), t)
    units = F.transform(tokens(text), lambda t: of(F.regexp_replace(of(t), _ENDING, "$1$2$3")))
    return F.filter(units, lambda u: ~u.startswith("<") & ~u.isin(*sorted(SEMANTIC_STOPWORDS)))


def _window_ends(text: str, size: int) -> Callable[[int], int]:
    """Maps the start of a window to its end, by the places of all full stops and line ends of the text."""
    places = [np.array([m.end() for m in re.finditer(mark, text)], dtype=np.int64) for mark in ("。", "\n")]

    def end_of(start: int) -> int:
        full = start + size
        # The last place of a kind within the window; both kinds in the order of preference, then the hard end.
        last = (p[i - 1] for p in places if (i := np.searchsorted(p, full, side="right")))
        return int(next((x for x in last if x > start + size // 2 + 1), full))

    return end_of


def split_long_text(text: str, size: int = 800, overlap: int = 120) -> list[str]:
    """Windows of at most ``size`` characters. A window ends after its last 。 beyond its middle, else after its
    last line end beyond it, else where it is full; the next one reaches ``overlap`` back. Stripped, none empty."""
    if len(text) <= size:
        return [text]
    end_of, spans = _window_ends(text, size), [(0, 0)]
    while spans[-1][1] < len(text):
        start, end = spans[-1]
        after = max(start + 1, end - overlap) if end else 0
        spans.append((after, min(len(text), end_of(after))))
    return [piece for a, b in spans[1:] if (piece := text[a:b].strip())]


_LATIN_TERMS, _HAN_RUNS = re.compile(X.LATIN_TERM), re.compile(f"[{X.HAN}]+")


def search_terms(text: str | None) -> list[str]:
    """``text.search_terms`` of one text, in any order; null has none."""
    low = (text or "").lower()
    out = _LATIN_TERMS.findall(low)
    for run in _HAN_RUNS.findall(low):
        out += run
        out += map("".join, zip(run, run[1:]))
        if 2 <= len(run) <= 8:
            out.append(run)
    return out


def matcher_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def counted_bigrams(text: str) -> list[str]:
    """Pairs of neighbouring characters, both ends included, each with its number among its equals."""
    seen: Counter[str] = Counter()
    out = []
    for a, b in zip("\x02" + text, text + "\x03"):
        seen[a + b] += 1
        out.append(f"{a}{b}{seen[a + b]}")
    return out


fold = udf_of(folded, T.StringType())
fold_tight = udf_of(folded_tight, T.StringType())
tokens = udf_of(leakage_tokens, STRINGS)
supported = udf_of(script_supported, T.BooleanType())
template = udf_of(template_canonical, T.StringType())
ratio = udf_of(matcher_ratio, T.DoubleType())
bigrams = udf_of(counted_bigrams, STRINGS)


def chunks(col: Column, size: int = 800, overlap: int = 120) -> Column:
    return udf_of(lambda t: split_long_text(t, size, overlap), STRINGS)(col)
