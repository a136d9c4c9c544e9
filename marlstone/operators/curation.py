"""Deterministic order, splits and samples, checks and digests of data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut_table


def hash_order(seed: str, *parts: Column) -> Column:
    """SHA-256 of the seed and the parts, separated by NUL."""
    return F.sha2(F.concat_ws("\x00", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def global_rank(df: DataFrame, digest: str, tie: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``rn``: the exact rank by (digest, tie), within groups if given, without one task for all: ranks
    within 4096 ranges of the digest plus the counts of the ranges before."""
    within = list(within)
    ranged = cut_table(df.withColumn("_range", F.substring(digest, 1, 3)))
    counts = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a group
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*within, "_range").orderBy(digest, tie)
    return ranged.join(starts, [*within, "_range"]).withColumn("rn", F.col("_before") + F.row_number().over(inside)).drop("_range", "_before")


def allocation(groups: int, ratios: Sequence[float]) -> list[int]:
    """Largest-remainder counts of groups; with three groups or more no part stays empty (filled in the order
    second, third, first, from the part with the most groups)."""
    raw = [groups * r for r in ratios]
    counts = [int(x) for x in raw]
    by_rest = sorted(range(len(raw)), key=lambda i: (-(raw[i] - counts[i]), i))
    for i in by_rest[: groups - sum(counts)]:
        counts[i] += 1
    if groups >= 3:
        for empty in (1, 2, 0):
            if not counts[empty]:
                donors = [i for i in range(3) if counts[i] > 1]
                if donors:
                    counts[max(donors, key=lambda i: (counts[i], ratios[i]))] -= 1
                    counts[empty] += 1
    return counts


def group_split(df: DataFrame, group: str, seed: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), names: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """(group, split): groups in hash order, cut by largest remainders; no group is divided. Null groups are
    left out."""
    if any(not 0 < r < 1 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be between 0 and 1 and sum to 1")
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("digest", hash_order(seed, F.col(group)))
    ranked = global_rank(groups, "digest", group)
    counts = allocation(ranked.count(), ratios)
    split, end = F.lit(names[-1]), sum(counts)
    for name, n in reversed(list(zip(names, counts))):
        end -= n
        split = F.when(F.col("rn") <= end + n, F.lit(name)).otherwise(split)
    return ranked.select(group, split.alias("split"))


def review_sample(df: DataFrame, key: str, seed: str, digest: str, n: int) -> DataFrame:
    """The ``n`` keys with the least hashes of seed, data set digest and key; a report feature."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", hash_order(seed, F.lit(digest), F.col(key)))
    return keys.orderBy("h", key).limit(n).select(key)


#: Lanes of five successive places.
PATTERN = ("generic", "generic", "personal", "generic", "personal")


def interleaved(df: DataFrame, key: str, lane: str, seed: str) -> DataFrame:
    """(key, lane, place): both lanes in hash order, laid out by PATTERN: the i-th of a lane takes the i-th
    place of that lane; places of a lane that has run out stay empty."""
    keys = df.select(key, lane).where(F.col(lane).isin(*set(PATTERN))).distinct().withColumn("digest", hash_order(seed, F.col(key)))
    ranked = global_rank(keys, "digest", key, [lane])
    place = F.lit(None).cast("bigint")
    for name in sorted(set(PATTERN)):
        slots = [i for i, x in enumerate(PATTERN) if x == name]
        i = F.col("rn") - 1
        spot = F.element_at(F.array(*map(F.lit, slots)), (i % len(slots)).cast("int") + 1)
        place = F.when(F.col(lane) == name, F.floor(i / len(slots)) * len(PATTERN) + spot).otherwise(place)
    return ranked.select(key, lane, place.alias("place"))


def dataset_digest(df: DataFrame, row: Column) -> DataFrame:
    """One row: number of rows and an order-free digest, the sum of the first 60 bits of each row's SHA-256."""
    bits = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(bits).cast("string").alias("digest"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], first: bool = False) -> DataFrame:
    """The last row of each key by the order (the first with ``first``): insert or replace, insert or ignore.
    The order must be total for a defined result."""
    payload = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(payload, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def changes(current: DataFrame, previous: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): new, changed, unchanged or removed."""
    a = current.select(key, F.col(content).alias("now")).distinct()
    b = previous.select(key, F.col(content).alias("before")).distinct()
    j = a.join(b, key, "full_outer")
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("before"), "unchanged").otherwise("changed")
    return j.select(key, status.alias("status"))
