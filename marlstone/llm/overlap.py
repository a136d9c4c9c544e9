"""Problem 5: records of evaluation splits that recur, exactly or nearly, in the training split.

Texts are squeezed (form does not count) and cut into character shingles: five Han characters, or twelve
others. Shingles that occur in more than ``COMMON`` of all texts of their table are the frames that texts
share anyhow and are left out, so that similarity is that of the content; their frequencies are counted
over all rows in a sketch of fixed size, where a group of near copies counts about once. Minwise hashes of the rest are banded into buckets, only pairs
across the split are kept, and each is verified by the exact Jaccard similarity of its shingles.

Sizes: what is broadcast is the sketches (fixed size) and the few texts that hold over a thousandth of the
rows each (at most a thousand). Copies of one text are one entry of a bucket, and an entry is shuffled only if
bitmaps (three, of a size that grows with the entries up to 16 MB each) say that the other side has its bucket too; full
bitmaps cost shuffles, never pairs. Entries carry a sketch of their text, so only pairs that are likely by it leave
the join. No pair within a side and no pair of exact copies goes through the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import fingerprints, gram_hashes, gram_starts, is_han, mix64, some_texts, squeezed_flat
from marlstone.session import cut_table, keep

GRAM_HAN, GRAM_OTHER = 5, 12
#: Shingles in more than this share of the texts (and in more than COMMON_LEAST texts) are frames.
COMMON, COMMON_LEAST = 0.01, 20
#: A text with more than this share of its shingles in over NEAR_COMMON of ``most`` texts is one of many near copies.
GROUP_SHARE, NEAR_COMMON = 0.6, 0.5
#: If fewer than this share of a text's shingles are no frames, its rarest up to this share are kept.
LEAST_KEPT = 0.5
#: A pair at the threshold shares no band with a chance of (1 - 0.47 ** 3) ** 40 = 1.2 %.
BANDS, ROWS = 40, 3
THRESHOLD = 0.47
#: Minhash values of a sketch (two bits of each), and the share of them that must agree before the texts of a pair are fetched:
#: 0.60 is expected at the threshold, where a pair falls short with a chance of 0.004 %.
SKETCH, LEAST_AGREE = 96, 39 / 96
BUCKETS = 1 << 18
CHUNK = 1 << 12
#: Shingles that are hashed at once, and texts that are worked on at once, so that they stay in the cache of a core.
BLOCK, SLICE = 1 << 15, 2500
#: Rows up to which a list of text hashes is broadcast; beyond, the join is shuffled.
SMALL_LIST = 200_000
#: Binary logarithms of the bits of a bitmap of buckets; bits of a piece of it.
LEAST_CELLS, MOST_CELLS, PIECE = 20, 27, 1 << 19


@dataclass
class Shingled:
    """Shingle hashes of texts behind one another (not distinct), and where each text's begin."""

    hashes: np.ndarray
    offsets: np.ndarray


def grouped(flat: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, Shingled]]:
    """Shingles of squeezed texts, Chinese texts and others apart: (positions of the texts, shingles). A text
    shorter than its shingle length is one shingle; empty texts are in no group."""
    sizes = np.diff(offsets)
    cum = np.concatenate(([0], np.cumsum(is_han(flat))))
    chinese = (cum[offsets[1:]] - cum[offsets[:-1]]) * 3 >= sizes
    out = []
    for k, mine in ((GRAM_HAN, chinese & (sizes > 0)), (GRAM_OTHER, ~chinese & (sizes > 0))):
        where = np.flatnonzero(mine)
        if not len(where):
            continue
        f, o = some_texts(flat, offsets, mine)
        h = gram_hashes(f, k)
        starts, owner = gram_starts(o, k)
        hashes, counts = h[starts] if len(starts) else h, np.bincount(owner, minlength=len(where))
        short = np.flatnonzero(counts == 0)
        if len(short):
            hashes = np.insert(hashes, np.cumsum(counts)[short], fingerprints(*some_texts(f, o, counts == 0), 7).astype(np.uint64))
            counts[short] = 1
        out.append((where, Shingled(hashes, np.concatenate(([0], np.cumsum(counts))))))
    return out


def kept(found: Shingled, counts: np.ndarray, most: float) -> Shingled:
    """Without the shingles in more than ``most`` texts; see LEAST_KEPT for texts of little else."""
    df = counts[(found.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    rare = df <= most
    sizes = np.diff(found.offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.bincount(owner[rare], minlength=len(sizes))
    for i in np.flatnonzero(left < LEAST_KEPT * sizes):
        a, b = found.offsets[i], found.offsets[i + 1]
        limit = np.sort(df[a:b])[max(0, int(np.ceil(LEAST_KEPT * (b - a))) - 1)]
        rare[a:b] = df[a:b] <= limit
    left = np.bincount(owner[rare], minlength=len(sizes))
    return Shingled(found.hashes[rare], np.concatenate(([0], np.cumsum(left))))


def group_weights(found: Shingled, counts: np.ndarray, most: float) -> np.ndarray:
    """One over the number of near copies of each text, 1 where frames alone are common. All but the rarest
    1 - GROUP_SHARE of the shingles of a near copy are in about all of its group, and in no other way can
    that much of a text be common."""
    df = counts[(found.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    sizes = np.diff(found.offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    common = np.bincount(owner[df > NEAR_COMMON * most], minlength=len(sizes))
    out = np.ones(len(sizes))
    for i in np.flatnonzero(common >= sizes - np.floor((1 - GROUP_SHARE) * sizes)):
        a, b = found.offsets[i], found.offsets[i + 1]
        out[i] = 1 / max(1.0, np.sort(df[a:b])[int((1 - GROUP_SHARE) * (b - a))])
    return out


_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def minhashes(found: Shingled) -> np.ndarray:
    """One row of BANDS*ROWS values per text; each text has a shingle. Texts go in blocks of BLOCK shingles or one text, which
    stay in the cache of a core."""
    n = len(found.offsets) - 1
    out = np.empty((n, BANDS * ROWS), dtype=np.uint32)
    short = (found.hashes >> np.uint64(32)).astype(np.uint32)
    a = 0
    with np.errstate(over="ignore"):
        while a < n:
            b = max(a + 1, int(np.searchsorted(found.offsets, found.offsets[a] + BLOCK, side="right")) - 1)
            mine, starts = short[found.offsets[a] : found.offsets[b]], found.offsets[a:b] - found.offsets[a]
            values, least = np.empty_like(mine), np.empty((BANDS * ROWS, b - a), dtype=np.uint32)
            for i in range(BANDS * ROWS):
                np.multiply(mine, _A[i], out=values)
                values ^= _B[i]
                np.minimum.reduceat(values, starts, out=least[i])
            out[a:b] = least.T
            a = b
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """Two bits of each of the first minhash values, each in a byte of its own."""
    return np.ascontiguousarray((values[:, :SKETCH] & np.uint32(3)).astype(np.uint8)).view(np.int64)


def packed(sketches: np.ndarray) -> np.ndarray:
    """Sketches with four values to the byte."""
    parts = sketches.view(np.uint8).reshape(len(sketches), 4, SKETCH // 4)
    out = parts[:, 0].copy()
    for i in (1, 2, 3):
        out |= parts[:, i] << np.uint8(2 * i)
    return out.view(np.int64)


def agreeing(x: Sequence[Column], y: Sequence[Column]) -> Column:
    """Number of values that agree in two packed sketches, given as longs."""
    out = F.lit(SKETCH)
    for a, b in zip(x, y):
        d = a.bitwiseXOR(b)
        out = out - F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def bands(values: np.ndarray, salt: int) -> np.ndarray:
    """A bucket number per text and band; ``salt`` keeps the tables apart."""
    out = np.empty((len(values), BANDS), dtype=np.int64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(values), (salt << 32) + b + 1, dtype=np.uint64)
            for r in range(ROWS):
                h = mix64(h * np.uint64(0x100000001B3) + values[:, b * ROWS + r])
            out[:, b] = (h >> np.uint64(24)).astype(np.int64)  # 40 bits, which compress better than 64
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def distinct_shingles(texts: list[str], counts: np.ndarray, most: float) -> np.ndarray:
    """The kept shingles of at most SLICE texts, sorted: number of the text above the first 50 bits of the hash."""
    out = [np.zeros(0, dtype=np.uint64)]
    for where, found in grouped(*squeezed_flat(texts)):
        left = kept(found, counts, most)
        owner = np.repeat(where, np.diff(left.offsets)).astype(np.uint64)
        out.append((owner << np.uint64(50)) | (left.hashes >> np.uint64(14)))
    keys = np.sort(np.concatenate(out))  # several times as fast as np.unique, which hashes
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first]


def jaccards(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """``jaccard`` of ``n`` pairs of texts, given as ``distinct_shingles``."""
    sizes = lambda x: np.bincount((x >> np.uint64(50)).astype(np.int64), minlength=n)
    both = sizes(np.intersect1d(a, b, assume_unique=True))
    return both / np.maximum(1, sizes(a) + sizes(b) - both)


def _slices(b: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of one table, at most SLICE at once, with its number."""
    for tab, part in b.groupby("tab"):
        for i in range(0, len(part), SLICE):
            yield int(tab), part.iloc[i : i + SLICE]


def _side(split: Column) -> Column:
    """1 for train, 2 for dev and test, null for others."""
    s = F.lower(F.regexp_replace(split, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return F.when(s == "train", 1).when(s.isin("dev", "test"), 2).cast("int")


def split_rows(tables: Mapping[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Rows of all tables with a split: number of the table, id, text, side and split name.
    ``tables``: name to (table, id column, text column, split column)."""
    parts = []
    for i, (df, key, text, split) in enumerate(tables.values()):
        name = F.lower(F.regexp_replace(F.col(split), r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
        rows = df.select(F.lit(i).alias("tab"), F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), _side(F.col(split)).alias("side"), name.alias("split"))
        parts.append(rows.where(F.col("side").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shingle_counts(rows: DataFrame, tables: int) -> tuple[list[np.ndarray], list[float]]:
    """For each table the number of texts by shingle bucket, and the number of texts. A text that holds
    over a thousandth of the rows counts once, and so does about a group of near copies: a first count
    tells which texts are near copies of many (``group_weights``), the second weighs them."""
    hot_share = 0.001
    by_text = rows.groupBy("tab", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    sized = keep(by_text)
    totals = {r["tab"]: (r["n"], r["d"]) for r in sized.groupBy("tab").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    least = F.lit(None).cast("double")
    for t, (n, _) in totals.items():
        least = F.when(F.col("tab") == t, F.lit(max(100.0, hot_share * n))).otherwise(least)
    hot = {(r["tab"], r["h"]): r["n"] for r in sized.where(F.col("n") > least).collect()}  # at most 1/hot_share a table
    sized.unpersist()
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(hot)
    texts = [float(totals.get(i, (0, 0))[1]) for i in range(tables)]
    raw, _ = _weighted_counts(rows, tables, known, None, texts)
    counts, shares = _weighted_counts(rows, tables, known, spark.sparkContext.broadcast(raw), texts)
    return counts, [n * share for n, share in zip(texts, shares)]


def frame_limit(texts: float) -> float:
    return max(COMMON_LEAST, COMMON * texts)


def _weighted_counts(rows: DataFrame, tables: int, known: Broadcast, before: Broadcast | None, texts: list[float]) -> tuple[list[np.ndarray], list[float]]:
    """Counts by shingle bucket, near copies weighed by the counts ``before``, and the share of the weight that is left."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, sums = known.value, {}
        for b in batches:
            for tab, part in _slices(b):
                weights = np.array([1.0 / mine.get((tab, int(h)), 1) for h in part["h"]])
                total = sums.setdefault(tab, np.zeros(BUCKETS + CHUNK))  # the last chunk: weights before and after
                for where, found in grouped(*squeezed_flat(list(part["text"]))):
                    w = weights[where]
                    total[BUCKETS] += w.sum()
                    if before is not None:
                        w = w * group_weights(found, before.value[tab], frame_limit(texts[tab]))
                    total[BUCKETS + 1] += w.sum()
                    total[:BUCKETS] += np.bincount((found.hashes & np.uint64(BUCKETS - 1)).astype(np.int64), weights=np.repeat(w, np.diff(found.offsets)), minlength=BUCKETS)
        for tab, got in sums.items():
            parts = got.astype(np.float32).reshape(-1, CHUNK)
            yield pd.DataFrame({"tab": tab, "chunk": range(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK)
        for x in part["counts"]:
            total += np.frombuffer(x, dtype=np.float32)
        return pd.DataFrame({"tab": [part["tab"].iloc[0]], "chunk": [part["chunk"].iloc[0]], "counts": [total.astype(np.float32).tobytes()]})

    schema = "tab int, chunk int, counts binary"
    pieces = rows.select("tab", "text", F.xxhash64("text").alias("h")).mapInPandas(count, schema)
    counts = [np.zeros(BUCKETS + CHUNK, dtype=np.float32) for _ in range(tables)]
    for r in pieces.groupBy("tab", "chunk").applyInPandas(add, schema).collect():  # BUCKETS numbers a table
        counts[r["tab"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], dtype=np.float32)
    return [c[:BUCKETS] for c in counts], [float(c[BUCKETS + 1] / c[BUCKETS]) if c[BUCKETS] else 1.0 for c in counts]


def _marks(entries: DataFrame, cells: int, sides: tuple[int, ...] = (1, 2), known: tuple[Broadcast, int] | None = None, salt: int = 0) -> dict[int, np.ndarray]:
    """For each of the sides a bitmap of the cells that its bucket numbers fall into, if the bitmap ``known`` (with
    its salt) has them. Tasks send compressed pieces of their bitmaps, which are united before they are collected: ``cells``
    bits a side, whatever the input."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = {k: np.zeros(cells, dtype=bool) for k in sides}
        before = None if known is None else _opened(known[0])
        for b in batches:
            if not len(b):
                continue
            numbers, side = _longs(b["bands"]), b["side"].to_numpy()
            for k, own in bits.items():
                mine = numbers[side == k].ravel()
                if before is not None:
                    mine = mine[_marked(before, _cells(mine, cells, known[1]))]
                own[_cells(mine, cells, salt)] = True
        pack = zstandard.ZstdCompressor(level=1)
        for k, own in bits.items():
            pieces = [(i, x) for i, x in enumerate(own.reshape(-1, PIECE)) if x.any()]
            yield pd.DataFrame({"side": k, "piece": [i for i, _ in pieces], "bits": [pack.compress(np.packbits(x).tobytes()) for _, x in pieces]})

    def unite(part: pd.DataFrame) -> pd.DataFrame:
        open_ = zstandard.ZstdDecompressor()
        total = np.bitwise_or.reduce([np.frombuffer(open_.decompress(x), dtype=np.uint8) for x in part["bits"]])
        return pd.DataFrame({"side": [part["side"].iloc[0]], "piece": [part["piece"].iloc[0]], "bits": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    schema = "side int, piece int, bits binary"
    out = {k: np.zeros(cells // 8, dtype=np.uint8) for k in sides}
    for r in entries.mapInPandas(mark, schema).groupBy("side", "piece").applyInPandas(unite, schema).collect():
        out[r["side"]][r["piece"] * (PIECE // 8) : (r["piece"] + 1) * (PIECE // 8)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), dtype=np.uint8)
    return out


def _longs(values: pd.Series) -> np.ndarray:
    """Rows of binary values as a matrix of longs."""
    return np.frombuffer(b"".join(values), dtype=np.int64).reshape(len(values), -1)


def _cells(numbers: np.ndarray, cells: int, salt: int = 0) -> np.ndarray:
    """Cells of bucket numbers. Two numbers in one cell are hardly in one with another salt."""
    return (mix64(numbers + salt) & np.uint64(cells - 1)).astype(np.int64)


def _marked(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether cells are set; bits are in the order of ``packbits``."""
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


def _sent(spark: SparkSession, bits: np.ndarray) -> Broadcast:
    """A broadcast of a bitmap, of which each executor writes a copy."""
    return spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(bits.tobytes()))


def _opened(bits: Broadcast) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bits.value), dtype=np.uint8)


def meeting_entries(heads: DataFrame, cells: int) -> tuple[DataFrame, list[Broadcast]]:
    """(side, band, fp, s0, s1, s2) of the buckets of ``heads`` (side, fp, sketch, bands) that the other side has too, and of
    few others; and the bitmaps, which serve until the entries are read. They are made in turn, each of what the one
    before leaves: of evaluation, of training in it, of evaluation in that. So few cells of the last two are set, even if
    many of the first are."""
    spark = heads.sparkSession
    side = lambda k: heads.where(F.col("side") == k).select("side", "bands")
    first = _sent(spark, _marks(side(2), cells, (2,))[2])
    second = _sent(spark, _marks(side(1), cells, (1,), (first, 0), 1)[1])
    third = _sent(spark, _marks(side(2), cells, (2,), (second, 1), 2)[2])

    def meeting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = {2: [(_opened(second), 1)], 1: [(_opened(first), 0), (_opened(third), 2)]}
        for b in batches:
            if not len(b):
                continue
            numbers, sketch, side, fp = _longs(b["bands"]), _longs(b["sketch"]), b["side"].to_numpy(), b["fp"].to_numpy()
            for k, bitmaps in steps.items():
                own = np.flatnonzero(side == k)
                at, mine = np.repeat(own, numbers.shape[1]), numbers[own].ravel()
                for bits, salt in bitmaps:
                    left = _marked(bits, _cells(mine, cells, salt))
                    at, mine = at[left], mine[left]
                yield pd.DataFrame({"side": np.full(len(at), k, dtype=np.int32), "band": mine, "fp": fp[at]} | {f"s{i}": x[at] for i, x in enumerate(sketch.T)})

    schema = "side int, band long, fp long, s0 long, s1 long, s2 long"
    return heads.select("side", "fp", "sketch", "bands").mapInPandas(meeting, schema), [first, second, third]


@dataclass
class Links:
    """``members``: (tab, fp, side, id, split) of all rows, ``fp`` being their class of equal text up to form;
    ``pairs``: (e, t, similarity) of classes of evaluation and of training texts that are near the same."""

    names: list[str]
    members: DataFrame
    pairs: DataFrame

    def source(self) -> Column:
        return F.element_at(F.array(*map(F.lit, self.names)), F.col("tab") + 1)


def near_links(tables: Mapping[str, tuple[DataFrame, str, str, str]], threshold: float = THRESHOLD) -> Links:
    """The links between near-same texts across the split, by class of equal texts: what ``near_pairs`` expands."""
    names = list(tables)
    rows = split_rows(tables)
    spark = rows.sparkSession
    counts, texts = shingle_counts(rows, len(names))
    most = [frame_limit(n) for n in texts]
    shared = spark.sparkContext.broadcast(counts)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = np.zeros(0, dtype=np.int64)
            for tab, part in _slices(b):
                flat, offsets = squeezed_flat(list(part["text"]))
                fp = fingerprints(flat, offsets, tab)
                out = pd.DataFrame({"tab": part["tab"], "id": part["id"], "side": part["side"], "split": part["split"], "fp": fp})
                # Copies within the batch get no bands: the first of each side stands for them.
                own = fp + part["side"].to_numpy()
                out["head"] = ~out.duplicated(["fp", "side"]) & ~np.isin(own, seen) & (np.diff(offsets) > 0)
                seen = np.concatenate((seen, own))
                heads = np.flatnonzero(out["head"])
                flat, offsets2 = some_texts(flat, offsets, out["head"].to_numpy())
                columns: dict[str, list] = {"sketch": [None] * len(out), "bands": [None] * len(out)}
                for where, found in grouped(flat, offsets2):
                    values = minhashes(kept(found, shared.value[tab], most[tab]))
                    for name, numbers in (("sketch", packed(sketches(values))), ("bands", bands(values, tab + 1))):
                        raw, width = numbers.tobytes(), numbers.shape[1] * 8
                        for j, i in enumerate(heads[where]):
                            columns[name][i] = raw[j * width : (j + 1) * width]
                yield out.assign(**columns)[np.diff(offsets) > 0]

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tab, part in _slices(b):
                yield part.assign(fp=fingerprints(*squeezed_flat(list(part["text"])), tab))[["tab", "fp", "text"]]

    # Numbers as bytes: arrays, and columns of their own, would be converted one by one.
    schema = "tab int, id string, side int, split string, fp long, head boolean, sketch binary, bands binary"
    sketched = keep(rows.select("tab", "id", "text", "side", "split").mapInPandas(sketch, schema))
    heads = sketched.where("head")
    # A bucket number goes on only if its cell is marked on the other side too: of others no pair can come.
    cells = 1 << min(MOST_CELLS, max(LEAST_CELLS, int(heads.count() * BANDS * 4).bit_length()))
    entries, bitmaps = meeting_entries(heads, cells)
    # Heads are those of a batch: one entry is left of the copies of a text in all batches. The join by bucket finds
    # the entries where the distinct left them, and compares the sketches of its pairs.
    entries = entries.repartition("band").distinct()
    ours = entries.where("side = 2").select("band", F.col("fp").alias("e"), *(F.col(f"s{i}").alias(f"e{i}") for i in range(3)))
    theirs = entries.where("side = 1").select("band", F.col("fp").alias("t"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(3)))
    agree = agreeing([F.col(f"e{i}") for i in range(3)], [F.col(f"t{i}") for i in range(3)])
    likely = cut_table(ours.join(theirs, "band").where((F.col("e") != F.col("t")) & (agree >= round(LEAST_AGREE * SKETCH))).select("e", "t").distinct())
    for b in bitmaps:
        b.destroy()
    wanted = likely.select(F.explode(F.array("e", "t")).alias("fp")).distinct()
    hint = F.broadcast if wanted.count() <= SMALL_LIST else (lambda x: x)
    # Texts of the candidates only: one row of each, found by its id.
    places = sketched.select("tab", "id", "fp").join(hint(wanted), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("tab", "id")).alias("p"))
    ids = places.select("p.tab", "p.id").distinct()
    raw = rows.select("tab", "id", "text").join(hint(ids), ["tab", "id"], "left_semi").mapInPandas(prints, "tab int, fp long, text string")
    texts_of = keep(raw.groupBy("fp").agg(F.min(F.struct("tab", "text")).alias("x")).select("fp", "x.tab", "x.text"))
    pairs = likely.join(texts_of.select(F.col("fp").alias("e"), F.col("text").alias("te"), "tab"), "e")
    pairs = pairs.join(texts_of.select(F.col("fp").alias("t"), F.col("text").alias("tt")), "t")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tab, part in _slices(b):
                x, y = (distinct_shingles(list(part[side]), shared.value[tab], most[tab]) for side in ("te", "tt"))
                j = jaccards(x, y, len(part))
                yield pd.DataFrame({"e": part["e"], "t": part["t"], "similarity": j})[j >= threshold]

    verified = cut_table(pairs.select("e", "t", "tab", "te", "tt").mapInPandas(verify, "e long, t long, similarity double"))
    return Links(names, sketched.select("tab", "fp", "side", "id", "split"), verified)


def _sides(links: Links) -> tuple[DataFrame, DataFrame]:
    evals = links.members.where("side = 2").select("tab", F.col("fp").alias("e"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
    return evals, links.members.where("side = 1").select(F.col("fp").alias("t"), F.col("id").alias("train_id"))


def near_pairs(tables: Mapping[str, tuple[DataFrame, str, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of a train row and a dev or test row of one table with near the same text: ``source``,
    ``train_id``, ``eval_id``, ``eval_split`` and ``similarity`` (1 for the same text up to form).

    Rows without split, id or text are in no pair, nor are texts without letters or digits; repeats of a
    row give no further pairs; empty tables give none; extra columns are ignored. Exact copies are expanded into
    their pairs here; ``near_links`` keeps them as classes."""
    links = near_links(tables, threshold)
    evals, trains = _sides(links)
    hint = F.broadcast if links.pairs.count() <= SMALL_LIST else (lambda x: x)
    near = evals.join(hint(links.pairs), "e")
    same = evals.select("tab", "e", "eval_id", "eval_split", F.col("e").alias("t"), F.lit(1.0).alias("similarity"))
    out = near.select(same.columns).unionByName(same).join(trains, "t")
    return out.where(F.col("eval_id") != F.col("train_id")).select(links.source().alias("source"), "train_id", "eval_id", "eval_split", "similarity").distinct()


def overlap_summary(links: Links) -> DataFrame:
    """``overlap_report`` from the sizes of the classes, without a row for each pair. A row counts once for each of
    its texts; one that is on both sides is no pair with itself. ``eval_rows`` and ``train_rows`` are the rows of
    linked classes."""
    members = keep(links.members.distinct())
    evals = members.where("side = 2").groupBy("tab", F.col("fp").alias("e"), F.col("split").alias("eval_split")).agg(F.count("*").alias("ne"))
    trains = members.where("side = 1").groupBy(F.col("fp").alias("t")).agg(F.count("*").alias("nt"))
    known = evals.select("e").distinct().join(trains.select(F.col("t").alias("e")), "e").select("e", F.col("e").alias("t"), F.lit(1.0).alias("similarity"))
    linked = keep(links.pairs.unionByName(known).select("e", "t", (F.col("e") == F.col("t")).alias("same")))
    own = members.where("side = 2").alias("x").join(members.where("side = 1").alias("y"), ["tab", "id"])
    own = own.select("tab", F.col("x.split").alias("eval_split"), F.col("x.fp").alias("e"), F.col("y.fp").alias("t")).join(linked, ["e", "t"])
    own = own.groupBy("tab", "eval_split").agg(F.count("*").alias("own"), F.count(F.when(F.col("same"), 1)).alias("own_same"))
    met = evals.join(linked, "e").join(trains, "t")
    n = F.col("ne") * F.col("nt")
    pairs = met.groupBy("tab", "eval_split").agg(F.sum(n).alias("n"), F.coalesce(F.sum(F.when(F.col("same"), n)), F.lit(0)).alias("n_same"))
    rows = lambda key, size, name: met.groupBy("tab", "eval_split", key).agg(F.max(size).alias("m")).groupBy("tab", "eval_split").agg(F.sum("m").alias(name))
    out = pairs.join(rows("e", "ne", "eval_rows"), ["tab", "eval_split"]).join(rows("t", "nt", "train_rows"), ["tab", "eval_split"]).join(own, ["tab", "eval_split"], "left")
    less = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        links.source().alias("source"), "eval_split", (F.col("n") - less(F.col("own"))).alias("pairs"), "eval_rows", "train_rows", (F.col("n_same") - less(F.col("own_same"))).alias("exact"),
    ).where("pairs > 0")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Confirmed pairs, and evaluation and training rows in them, by source and split of the evaluation row."""
    return pairs.groupBy("source", "eval_split").agg(
        F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_rows"), F.countDistinct("train_id").alias("train_rows"),
        F.sum((F.col("similarity") == 1.0).cast("long")).alias("exact"),
    )
