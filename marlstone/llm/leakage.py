"""Problem 7: passages of evaluation material inside a corpus, by a prefix-filtered set join.

Passages and documents are squeezed to letters and digits. Stock sentences that recur in many passages are
taken out, which leaves segments; each window of 28 letters of a Chinese segment, or 80 of another, is an
item to be contained whole. A contained item needs all its shingles, so one necessary prefix shingle is
enough to find it: the rarest by corpus frequency. Every shingle of the corpus is looked up among these
prefixes, with its position; a hit is verified by exact comparison of the letters around both positions,
which must reach the length of the item.

The passages are few next to the corpus. Their prefixes are broadcast while they number at most
``SMALL_INDEX``; beyond that documents and prefixes are joined by a shuffle on the shingle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import code_points, gram_hashes, gram_starts, is_han, squeeze

#: Letters of an item and of its shingles, for Chinese and for other passages.
ITEM_HAN, ITEM_OTHER = 28, 80
GRAM_HAN, GRAM_OTHER = 8, 20
#: A sentence is stock if it is in at least this many passages and this share of them.
STOCK_LEAST, STOCK_SHARE = 4, 0.02
SMALL_INDEX = 2_000_000
_SENTENCE = re.compile(r"[^。！？!?；;\n]*?(?:[。！？!?；;\n]+|\.(?=\s|$)|$)")


def sentences(text: str) -> list[str]:
    return [s for s in (m.group() for m in _SENTENCE.finditer(text)) if s]


def stock_sentences(passages: DataFrame, text: str, least: int = STOCK_LEAST, share: float = STOCK_SHARE) -> DataFrame:
    """Squeezed sentences that are in many passages, counted once a passage."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": [s for t in b["t"] for s in {squeeze(x) for x in sentences(t)} if s]}, dtype="object")

    t = passages.select(F.col(text).cast("string").alias("t")).where("t is not null")
    most = F.greatest(F.lit(least), F.ceil(F.lit(share) * t.count()))
    return t.mapInPandas(split, "s string").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= most)


def segments(text: str, stock: set[str]) -> list[str]:
    """Squeezed runs of sentences between stock ones."""
    out, run = [], ""
    for s in sentences(text):
        q = squeeze(s)
        if q in stock:
            out.append(run)
            run = ""
        else:
            run += q
    return [s for s in [*out, run] if s]


def sizes_of(text: str) -> tuple[int, int]:
    """Item and shingle length of a passage, by its script."""
    q = squeeze(text)
    flat, _ = code_points([q])
    han = int(is_han(flat).sum())
    return (ITEM_HAN, GRAM_HAN) if han * 3 >= len(q) else (ITEM_OTHER, GRAM_OTHER)


@dataclass
class Passages:
    """Segments of all passages behind one another; ``owner`` is the passage of each segment."""

    ids: np.ndarray
    texts: list[str]
    owner: np.ndarray
    item: np.ndarray
    gram: np.ndarray


def prepare(ids: list, texts: list[str], stock: set[str]) -> Passages:
    seg, owner, item, gram = [], [], [], []
    for i, t in enumerate(texts):
        k, g = sizes_of(t)
        for s in segments(t, stock):
            if len(s) >= k:
                seg.append(s)
                owner.append(i)
                item.append(k)
                gram.append(g)
    return Passages(np.array(ids), seg, np.array(owner, dtype=np.int64), np.array(item, dtype=np.int64), np.array(gram, dtype=np.int64))


def passage_shingles(p: Passages, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, segment and position of each shingle of the segments with shingle length ``g``."""
    mine = np.flatnonzero(p.gram == g)
    flat, offsets = code_points([p.texts[i] for i in mine])
    h = gram_hashes(flat, g)
    starts, owner = gram_starts(offsets, g)
    return (h[starts] if len(starts) else h), mine[owner] if len(mine) else owner, starts - offsets[:-1][owner] if len(starts) else starts


def prefixes(p: Passages, g: int, known: np.ndarray, df: np.ndarray) -> pd.DataFrame:
    """The rarest shingle of each item, ties to the first: hash, segment, position, distinct. ``known`` are
    the sorted shingle hashes that occur in the corpus, ``df`` in how many documents. An item with a
    shingle that occurs nowhere in the corpus is contained nowhere and needs no prefix."""
    h, seg, pos = passage_shingles(p, g)
    out = []
    if len(h):
        at = np.searchsorted(known, h)
        there = (at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == h) if len(known) else np.zeros(len(h), bool)
        count = np.where(there, df[np.minimum(at, max(0, len(df) - 1))] if len(df) else 0, 0)
        for s in np.unique(seg):
            rows = np.flatnonzero(seg == s)
            w = int(p.item[s]) - g + 1
            c = count[rows]
            for a in range(len(rows) - w + 1):
                j = a + int(np.argmin(c[a : a + w]))
                if c[j]:
                    out.append((h[rows[j]], s, pos[rows[j]]))
    return pd.DataFrame(sorted(set(out)), columns=["h", "seg", "pos"])


def run_length(doc: str, at: int, seg: str, pos: int, g: int) -> int:
    """Length of the run of equal letters of both texts through the shingle at these positions."""
    if doc[at : at + g] != seg[pos : pos + g]:
        return 0
    a, b = at, pos
    while a and b and doc[a - 1] == seg[b - 1]:
        a, b = a - 1, b - 1
    x, y = at + g, pos + g
    while x < len(doc) and y < len(seg) and doc[x] == seg[y]:
        x, y = x + 1, y + 1
    return x - a


def _hits(texts: list[str], g: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and index into sorted ``hashes`` of each shingle that is among them."""
    flat, offsets = code_points(texts)
    h = gram_hashes(flat, g)
    starts, owner = gram_starts(offsets, g)
    if not len(starts) or not len(hashes):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    h = h[starts]
    at = np.searchsorted(hashes, h)
    np.minimum(at, len(hashes) - 1, out=at)
    hit = np.flatnonzero(hashes[at] == h)
    return owner[hit], starts[hit] - offsets[:-1][owner[hit]], at[hit]


def leaked_passages(
    documents: DataFrame, passages: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
    passage_key: str = "passage_id", passage_text: str = "text", small_index: int = SMALL_INDEX,
) -> DataFrame:
    """(document, passage, ``letters``): each document that holds a run of at least an item of a passage, with
    the longest run found. Null texts hold and give nothing; passages shorter than an item, or of stock
    sentences only, leak nowhere; repeated rows count once; empty tables give none; documents are read
    whole. Extra columns of either table are ignored, so names may clash."""
    spark = documents.sparkSession
    stock = {r["s"] for r in stock_sentences(passages, passage_text).collect()}  # at most 1/STOCK_SHARE a sentence place
    rows = passages.select(F.col(passage_key).alias("p"), F.col(passage_text).cast("string").alias("t")).where("p is not null and t is not null").distinct()
    docs = documents.select(F.col(doc_key).alias("d"), F.col(doc_text).cast("string").alias("t")).where("d is not null and t is not null")
    types = dict(documents.select(F.col(doc_key).alias("d")).dtypes)["d"], dict(rows.dtypes)["p"]
    schema = f"d {types[0]}, p {types[1]}, letters int"
    letters = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if letters > small_index:
        return _by_shuffle(docs, rows, stock, schema).withColumnsRenamed({"d": doc_key, "p": passage_key})

    got = rows.orderBy("p", "t").collect()  # at most small_index letters
    ready = prepare([r["p"] for r in got], [r["t"] for r in got], stock)
    grams = sorted(set(ready.gram.tolist()))
    all_hashes = {g: np.unique(passage_shingles(ready, g)[0]) for g in grams}
    shared = spark.sparkContext.broadcast((ready, all_hashes))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = shared.value[1]
        sums = {g: np.zeros(len(h), dtype=np.int64) for g, h in hashes.items()}
        for b in batches:
            texts = [squeeze(t) for t in b["t"]]
            for g, h in hashes.items():
                doc, _, at = _hits(texts, g, h)
                if len(doc):
                    once = np.unique(doc * len(h) + at) % len(h)
                    sums[g] += np.bincount(once, minlength=len(h))
        for g, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"g": g, "at": at, "n": n[at]})

    df = {g: np.zeros(len(h), dtype=np.int64) for g, h in all_hashes.items()}
    for r in docs.select("t").mapInPandas(count, "g int, at long, n long").groupBy("g", "at").agg(F.sum("n").alias("n")).collect():
        df[r["g"]][r["at"]] = r["n"]  # at most as many as the passages have shingles
    index = {}
    for g in grams:
        seen = df[g] > 0
        found = prefixes(ready, g, all_hashes[g][seen], df[g][seen])
        keys, first = np.unique(found["h"].to_numpy(dtype=np.uint64), return_index=True)
        index[g] = (keys, np.append(first, len(found)), found["seg"].to_numpy(dtype=np.int64), found["pos"].to_numpy(dtype=np.int64))
    searched = spark.sparkContext.broadcast((ready, index))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, idx = searched.value
        for b in batches:
            texts, ids = [squeeze(t) for t in b["t"]], b["d"].to_numpy()
            best: dict[tuple[int, int], int] = {}
            for g, (keys, bounds, segs, poss) in idx.items():
                for doc, at, k in zip(*(x.tolist() for x in _hits(texts, g, keys))):
                    for j in range(bounds[k], bounds[k + 1]):
                        s = int(segs[j])
                        who = (doc, int(p.owner[s]))
                        n = run_length(texts[doc], at, p.texts[s], int(poss[j]), g)
                        if n >= p.item[s] and n > best.get(who, 0):
                            best[who] = n
            yield pd.DataFrame({"d": [ids[i] for i, _ in best], "p": [p.ids[j] for _, j in best], "letters": list(best.values())})

    out = docs.mapInPandas(search, schema).groupBy("d", "p").agg(F.max("letters").alias("letters"))
    return out.withColumnsRenamed({"d": doc_key, "p": passage_key})


def _by_shuffle(docs: DataFrame, rows: DataFrame, stock: set[str], schema: str) -> DataFrame:
    """The same join when the passages are too many to broadcast: prefixes and document shingles meet in a
    shuffle on the shingle, and texts are joined to the pairs for the exact check."""
    types = dict(docs.dtypes)["d"], dict(rows.dtypes)["p"]
    known = docs.sparkSession.sparkContext.broadcast(stock)

    def doc_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = [squeeze(t) for t in b["t"]], b["d"].to_numpy()
            for g in (GRAM_HAN, GRAM_OTHER):
                flat, offsets = code_points(texts)
                h = gram_hashes(flat, g)
                starts, owner = gram_starts(offsets, g)
                yield pd.DataFrame({"d": ids[owner], "h": h[starts].astype(np.int64) if len(starts) else starts, "at": starts - offsets[:-1][owner] if len(starts) else starts, "g": g})

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ready = prepare(list(b["p"]), list(b["t"]), known.value)
            for g in (GRAM_HAN, GRAM_OTHER):
                h, seg, pos = passage_shingles(ready, g)
                yield pd.DataFrame({"p": ready.ids[ready.owner[seg]] if len(seg) else [], "seg": [ready.texts[s] for s in seg], "pos": pos, "h": h.astype(np.int64), "g": g, "item": ready.item[seg] if len(seg) else pos})

    grams = docs.mapInPandas(doc_grams, f"d {types[0]}, h long, at int, g int")
    items = rows.mapInPandas(item_grams, f"p {types[1]}, seg string, pos int, h long, g int, item int")
    wanted = items.select("g", "h").distinct()
    df = grams.join(wanted, ["g", "h"]).groupBy("g", "h").agg(F.approx_count_distinct("d").alias("n"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        w = int(part["item"].iloc[0]) - int(part["g"].iloc[0]) + 1
        by = dict(zip(part["pos"], part["n"]))
        picked = set()
        for a in range(int(part["pos"].max()) - w + 2):
            c = [by.get(i, 0) for i in range(a, a + w)]
            if min(c) > 0:
                picked.add(a + int(np.argmin(c)))
        return part[part["pos"].isin(picked)].drop(columns=["n"])

    counted = items.join(df, ["g", "h"], "left").fillna(0, ["n"])
    kept = counted.groupBy("p", "seg").applyInPandas(choose, items.schema)  # one segment of one passage a group
    pairs = grams.join(kept, ["g", "h"]).select("d", "p", "seg", "pos", "at", "g", "item").join(docs, "d")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [run_length(squeeze(t), a, s, q, g) for t, a, s, q, g in zip(b["t"], b["at"], b["seg"], b["pos"], b["g"])]
            b = b.assign(letters=n)
            yield b[b["letters"] >= b["item"]][["d", "p", "letters"]]

    return pairs.mapInPandas(verify, schema).groupBy("d", "p").agg(F.max("letters").alias("letters"))


def leak_report(found: DataFrame, passages: DataFrame, passage_key: str = "passage_id", by: str = "split") -> DataFrame:
    """Leaked passages and documents that hold them, by a column of the passages."""
    return found.join(passages.select(passage_key, by).distinct(), passage_key).groupBy(by).agg(
        F.countDistinct(passage_key).alias("passages"), F.count("*").alias("hits")
    )



