"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Full-width forms U+FF01..U+FF5E and the ideographic space, with their half-width counterparts.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "

_NOT_TEXT = re.compile(r"[\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_width(col: Column) -> Column:
    return F.translate(col, FULL, HALF)


def squeezed_column(col: Column) -> Column:
    """Lower case, half width, letters, digits, marks and symbols only: blanks, invisible characters and
    punctuation are dropped. JVM-side; ``squeeze`` is its counterpart in Python."""
    return F.regexp_replace(F.lower(half_width(col)), r"[\p{P}\p{Z}\p{C}\s]+", "")


def squeeze(text: str | None) -> str:
    """NFKC, lower case, letters and digits only."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NOT_TEXT.sub("", text.lower())


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another as code points, and the offsets (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, offsets


_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Numbers that are worked on at once, so that they stay in the cache of a core.
BLOCK = 1 << 14


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    out = np.array(x, dtype=np.uint64, order="C")
    flat = out.reshape(-1)
    room = np.empty(min(len(flat), BLOCK), dtype=np.uint64)
    for a in range(0, len(flat), BLOCK):
        h = flat[a : a + BLOCK]
        shifted = room[: len(h)]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            np.right_shift(h, np.uint64(shift), out=shifted)
            h ^= shifted
            if factor:
                h *= np.uint64(factor)
    return out


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` code points in ``flat`` (grams that cross texts included;
    see ``gram_starts``)."""
    if len(flat) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(flat) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), BLOCK):
            h = out[a : a + BLOCK]
            points = flat[a : a + len(h) + n - 1].astype(np.uint64) + np.uint64(0x9E37)
            for i in range(n):
                h *= np.uint64(0x100000001B3)
                h += points[i : i + len(h)]
            h *= _MIX
        return mix64(out)


def gram_starts(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the grams that lie within one text, and the text of each."""
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    starts = np.arange(lengths.sum()) - first[owner] + offsets[:-1][owner]
    return starts, owner


def is_han(flat: np.ndarray) -> np.ndarray:
    return ((flat >= 0x3400) & (flat <= 0x9FFF)) | ((flat >= 0x20000) & (flat <= 0x323AF))


_SPECIAL = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _squeeze_table() -> np.ndarray:
    """For each code point of the first plane what ``squeeze`` makes of it: 0 for nothing, a code point, or
    _SPECIAL where its neighbours matter or it becomes several."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    for p in range(1 << 16):
        c = chr(p)
        kind = unicodedata.category(c)
        if kind[0] == "M" or 0x1100 <= p <= 0x11FF or p == 0x3A3:
            out[p] = _SPECIAL
            continue
        if kind == "Cs":
            continue
        kept = _NOT_TEXT.sub("", unicodedata.normalize("NFKC", c).lower())
        if kept:
            out[p] = ord(kept) if len(kept) == 1 and ord(kept) < 1 << 16 else _SPECIAL
    return out


def squeezed_flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``code_points`` of the squeezed texts, without a string for each."""
    flat, offsets = code_points(texts)
    table = _squeeze_table()
    mapped = table[flat] if not len(flat) or flat.max() < len(table) else np.where(flat < len(table), table[np.minimum(flat, len(table) - 1)], _SPECIAL)
    odd = np.flatnonzero(mapped == _SPECIAL)
    if len(odd):  # texts in which neighbours matter are squeezed as strings
        strange = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
        parts, at = [], 0
        sizes = _sizes_kept(mapped, offsets)
        for i in strange:
            parts += [mapped[at : offsets[i]], code_points([squeeze(texts[i])])[0]]
            sizes[i], at = len(parts[-1]), offsets[i + 1]
        mapped = np.concatenate([*parts, mapped[at:]])
    else:
        sizes = _sizes_kept(mapped, offsets)
    return mapped[mapped != 0].astype(np.uint32, copy=False), np.concatenate(([0], np.cumsum(sizes)))


def _sizes_kept(mapped: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate(([0], np.cumsum(mapped != 0)))
    return before[offsets[1:]] - before[offsets[:-1]]


def some_texts(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points and offsets of the texts ``which`` (a mask)."""
    sizes = np.diff(offsets)
    return flat[np.repeat(which, sizes)], np.concatenate(([0], np.cumsum(sizes[which])))


def fingerprints(flat: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """A signed 64-bit hash of each text, the same in every process."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    with np.errstate(over="ignore"):
        h = mix64(flat.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(24)) + np.uint64(salt) * _MIX)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
        return mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).astype(np.int64)
