"""Similarity joins on sets and bags, and connected components of their links.

All joins are exact. Copies of one text are one class: joins return pairs of class representatives, and
``membership`` maps every row to its class. Prefix filters come from a global order of rare tokens first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.arrays import flat, portions
from marlstone.session import cut_table, drop_table

#: Cells of the counts of tokens, bits of a vector's sketch, pairs that are compared at once (of vectors: BLOCK), and ids of a broadcast.
CELLS, BITS, PORTION, SMALL_ROWS = 1 << 20, 256, 500_000, 2_000_000
BLOCK, MIX = 2048, np.uint64(0x9E3779B97F4A7C15)


def words(col: Column) -> Column:
    """Lower-case Latin words and numbers, and Han characters, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"[a-z0-9]+|[{X.HAN}]"), F.lit(0))


def shingle_hashes(tokens: Column, n: int, whole_if_short: bool = False) -> Column:
    """Distinct 64-bit hashes of the runs of ``n`` tokens; fewer tokens have none or, with ``whole_if_short``, one
    if they are any. Null gives null."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        short = F.when((F.size(w) > 0) & F.lit(whole_if_short), F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= n, F.array_distinct(runs)).when(w.isNotNull(), short)

    return X.bound(tokens, of)


def word_shingles(col: Column, n: int = 5) -> Column:
    """Distinct hashes of the runs of ``n`` words; a shorter text is one shingle, one without words has none."""
    return shingle_hashes(words(col), n, whole_if_short=True)


def membership(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class): the smallest key of the rows with the same text. Null texts and keys are left out."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    heads = rows.groupBy("t").agg(F.min("k").alias("class"))
    return rows.join(heads, "t").select(F.col("k").alias(key), "class").distinct()


def representatives(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(key).alias("class")).select("class", "text")


def _candidates(vectors: DataFrame, num: int, den: int, cosine: bool) -> DataFrame:
    """(x, y): pairs of ids of ``vectors`` (id, h, f: hashes of tokens and their numbers) that may reach num/den, each
    once. No pair that reaches it is missing, though hashes collide: equal tokens keep equal hashes.

    Tokens are ordered by their number in a sketch of fixed size, then by hash. Rows that share a token of their
    prefixes meet where that token is, with sketches of parities: two vectors differ in no fewer bits of these than in
    places, so most pairs end there and only the others are shuffled."""
    spark = vectors.sparkSession
    cell = F.col("h").bitwiseAND(CELLS - 1).cast("int")
    counted = vectors.select(F.explode("h").alias("h")).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toArrow()  # as many as cells
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    order = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    words = [f"w{i}" for i in range(BITS // 64)]
    rows = vectors.mapInArrow(_prefixes(order, num, den, cosine), f"token long, id long, n int, p int, {', '.join(f'{w} long' for w in words)}")
    met = rows.repartition("token").sortWithinPartitions("token", "n").mapInArrow(_meetings(num, den, cosine), "x long, y long")
    return cut_table(met.distinct())


def _prefixes(order: Broadcast, num: int, den: int, cosine: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in (whole.slice(at, BLOCK) for whole in batches for at in range(0, len(whole), BLOCK)):
            lists = b.column("h")
            size, h = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((h, row << 32 | counts[h & (CELLS - 1)]))
            f = b.column("f").flatten().to_numpy(zero_copy_only=False).astype(np.int64)[by]
            h, starts = h[by], np.cumsum(size) - size
            n, p = size, np.arange(len(h)) - starts[row] + 1
            if cosine:  # until the norm of the rest is below the threshold
                upto = np.concatenate(([0], np.cumsum(f * f)))
                n = upto[starts + size] - upto[starts]
                first = (upto[starts + size][row] - upto[:-1]) * (den * den) >= n[row] * (num * num)
            else:
                first = p <= (n + 1 + (-n * num) // den)[row]
            bit = (h.view(np.uint64) * MIX) >> np.uint64(64 - (BITS - 1).bit_length())
            odd = np.bincount(row * BITS + bit.astype(np.int64), weights=f & 1, minlength=len(size) * BITS).astype(np.int64) & 1
            sketch = np.packbits(odd.astype(np.uint8).reshape(len(size), BITS), axis=1).view(np.int64)
            at = row[first]
            out = {"token": h[first], "id": b.column("id").to_numpy()[at], "n": n[at].astype(np.int32), "p": p[first].astype(np.int32)}
            yield pa.RecordBatch.from_pydict(out | {f"w{i}": sketch[at, i] for i in range(BITS // 64)})

    return run


def _meetings(num: int, den: int, cosine: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates among the rows of each token; rows come ordered by token, then by n."""

    def pairs(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, i = c["n"].astype(np.int64), np.arange(len(c["n"]))
        group = np.cumsum(np.concatenate(([0], c["token"][1:] != c["token"][:-1]))) << 32
        end = np.searchsorted(group, group, side="right") if cosine else np.searchsorted(group | n, group | (n * den // num), side="right")
        sketch = [c[f"w{k}"].view(np.uint64) for k in range(BITS // 64)]
        for part in portions(end - i - 1, PORTION):
            right, left = flat(i[part] + 1, (end - i - 1)[part])
            left += part.start
            both = n[left] + n[right]
            # Of the symmetric difference no more may be left than this.
            most = both - 2 * np.sqrt(n[left] * n[right]) * (num / den) + 1e-6 if cosine else both + 2 * (-both * num // (num + den))
            apart = np.zeros(len(left), dtype=np.int64)
            for k in range(0, len(sketch), 2):
                apart = apart + np.bitwise_count(sketch[k][left] ^ sketch[k][right]) + np.bitwise_count(sketch[k + 1][left] ^ sketch[k + 1][right])
                few = np.flatnonzero(apart <= most)
                left, right, most, apart = left[few], right[few], most[few], apart[few]
            if not cosine:  # the first token that a pair shares decides this bound
                room = 1 + np.minimum(n[left] - c["p"][left], n[right] - c["p"][right])
                few = room * 2 >= n[left] + n[right] - most
                left, right = left[few], right[few]
            x, y = c["id"][left], c["id"][right]
            met = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1) if len(x) else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"x": met[0], "y": met[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for b in batches:
            new = {name: b.column(name).to_numpy() for name in b.schema.names}
            if not len(new["token"]):
                continue
            last = int(np.searchsorted(new["token"], new["token"][-1]))
            if last or (held and held[0]["token"][0] != new["token"][0]):  # all but the last token are whole
                yield from pairs({name: np.concatenate([*(h[name] for h in held), x[:last]]) for name, x in new.items()})
                held = []
            held.append({name: x[last:] for name, x in new.items()})
        if held:
            yield from pairs({name: np.concatenate([h[name] for h in held]) for name in held[0]})

    return run


def _compared(vectors: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """(a, b, each column as c_a and c_b) of the pairs of ids; keys a < b. Only vectors of a pair are moved, while
    their ids are few enough to be broadcast, which is counted."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    kept = vectors.join(F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids, "id", "left_semi")
    side = lambda at, c: kept.select(F.col("id").alias(at), F.col("k").alias(f"k_{c}"), *(F.col(x).alias(f"{x}_{c}") for x in columns))
    full = pairs.join(side("x", "x"), "x").join(side("y", "y"), "y").where((F.col("x") < F.col("y")) | (F.col("k_x") < F.col("k_y")))
    swap = F.col("k_x") > F.col("k_y")
    pick = lambda c, mine, other: F.when(swap, F.col(f"{c}_{other}")).otherwise(F.col(f"{c}_{mine}"))
    out = [pick(c, *of).alias(f"{c}_{name}") for c in columns for name, of in (("a", "xy"), ("b", "yx"))]
    return full.select(pick("k", "x", "y").alias("a"), pick("k", "y", "x").alias("b"), *out)


def jaccard_join(sets: DataFrame, key: str, tokens: str, num: int, den: int, strict: bool = False) -> DataFrame:
    """(a, b, both, either): pairs of keys a < b whose sets have Jaccard similarity of at least num/den (above
    it if ``strict``), with the sizes of intersection and union. Empty sets are in no pair. ``sets`` is read several
    times, so it should be cheap to read.

    Prefix filter: sets that similar share a token among the first n - ceil(n t) + 1 of their order. Size and
    positional bounds and sketches prune before the exact test, which compares integers."""
    of = sets.where((F.size(tokens) > 0) & F.col(key).isNotNull()).select(F.xxhash64(key).alias("id"), F.col(key).alias("k"), F.col(tokens).alias("s"))
    h = F.transform("s", lambda t: F.xxhash64(t))
    vectors = of.select("id", h.alias("h")).select("id", "h", F.transform("h", lambda _: F.lit(1)).alias("f"))
    full = _compared(of, _candidates(vectors, num, den, False), "s")
    both = F.size(F.array_intersect("s_a", "s_b"))
    sized = full.select("a", "b", both.alias("both"), (F.size("s_a") + F.size("s_b") - both).alias("either"))
    test = F.col("both") * den > F.col("either") * num if strict else F.col("both") * den >= F.col("either") * num
    return sized.where(test)


def cosine_join(bags: DataFrame, key: str, term: str, tf: str, num: int, den: int) -> DataFrame:
    """(a, b, dot, na, nb): pairs a < b of bags, given as rows (key, term, tf), whose cosine is at least
    num/den; na and nb are squared norms. The test compares integers.

    Prefix filter: terms in the global order until the norm of the rest is below num/den of the whole. Two
    bags that similar share a term of both prefixes."""
    rows = bags.select(F.col(key).alias("k"), F.col(term).alias("term"), F.col(tf).cast("bigint").alias("tf"))
    of = cut_table(rows.groupBy("k").agg(F.collect_list(F.struct("term", "tf")).alias("e")).where("k is not null").select(F.xxhash64("k").alias("id"), "k", "e"))  # terms of one bag
    vectors = of.select("id", F.transform("e.term", lambda t: F.xxhash64(t)).alias("h"), F.col("e.tf").alias("f"))
    norm = F.aggregate("e.tf", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    full = _compared(of.select("id", "k", F.map_from_entries("e").alias("v"), norm.alias("n")), _candidates(vectors, num, den, True), "v", "n")
    dot = F.aggregate(F.map_entries("v_a"), F.lit(0).cast("bigint"), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("v_b"), e["key"]), F.lit(0)))
    wide = lambda c: c.cast("decimal(38,0)")
    sized = full.select("a", "b", dot.alias("dot"), F.col("n_a").alias("na"), F.col("n_b").alias("nb"))
    return sized.where(wide(F.col("dot") * F.col("dot")) * (den * den) >= wide(F.col("na") * F.col("nb")) * (num * num))


def shared_shingles(df: DataFrame, key: str, shingles: Column) -> DataFrame:
    """(key, shingles, shared, partners_at_most): of each row's shingles how many are in other rows too. Links
    are kept by shingle, not as pairs, so a shingle of a third of all rows stays one entry."""
    flat = df.select(F.col(key), F.explode(F.array_distinct(shingles)).alias("s"))
    n = flat.groupBy("s").agg(F.count("*").alias("rows"))
    return flat.join(n, "s").groupBy(key).agg(F.count("*").alias("shingles"), F.count(F.when(F.col("rows") > 1, 1)).alias("shared"), F.sum(F.col("rows") - 1).alias("partners_at_most"))


def components(nodes: DataFrame, edges: DataFrame, node: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each connected component of the edges (a, b).

    Labels fall to the least label among the neighbours, then to the label of their label, until none
    changes; each round is written to the shared folder, so lost executors cost one round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_table(both)
    labels = nodes.select(F.col(node).alias("v"), F.col(node).alias("l")).distinct()
    before = None
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels["v"] == near["a"], "left").select("v", "l", F.least("l", "m").alias("m"))
        jump = step.select(F.col("v").alias("x"), F.col("m").alias("mm"))
        after = cut_table(step.join(jump, step["m"] == jump["x"], "left").select("v", "l", F.least("m", F.coalesce("mm", "m")).alias("m")))
        changed = after.where("l <> m").limit(1).count()
        drop_table(before)
        before = after
        labels = after.select("v", F.col("m").alias("l"))
        if not changed:
            return labels.select(F.col("v").alias(node), F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def required_prefix(n: int, num: int, den: int) -> int:
    """Length of the prefix of a set of ``n`` tokens, for tests."""
    return n - math.ceil(n * num / den - 1e-9) + 1
