"""Problem 4: consensus from several annotators, by iteratively reweighted voting.

Marks are votes on ordinal scales. Each round pools the votes of an item into a weighted consensus, with
every rater's steady offset taken off, and then measures each rater against the consensus of the *other*
raters of the same items (leave one out). That accuracy is chance-corrected: it is 0 for marks that do not
depend on the item and negative for reversed ones; it is smoothed towards the mean of all raters, so few
ratings decide little. Accuracies become the next weights until they are stable.

All of it is sums by item and by rater, so a rater or an item with a third of the rows is combined before
the shuffle; leaving one out is a subtraction. Only one number a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut_table, keep

#: Greatest mark of each dimension; the least is 0.
SCALES = {"clarity": 15, "coverage": 30, "reasoning": 20}
#: Pseudo-ratings of smoothing; spread of marks below which a rater is taken not to tell items apart.
SMOOTHING, LEAST_SPREAD = 2.0, 0.03
#: Raters below this accuracy do not follow the quality of the items.
LEAST_ACCURACY = 0.6
MAX_ROUNDS, STABLE = 12, 0.01


@dataclass
class Consensus:
    """``items``: consensus and agreement by item; ``raters``: reliability by rater; ``agreement``: by
    dimension, Krippendorff's alpha for interval scales, which allows for missing ratings."""

    items: DataFrame
    raters: DataFrame
    agreement: DataFrame
    rounds: int


def clean_ratings(df: DataFrame, item: str, rater: str, scales: Mapping[str, int], confidence: str | None, rated: str | None, received: str | None) -> DataFrame:
    """One row per (item, rater): of several the one rated last, then received last. Marks outside their
    scale become null, others are brought to 0..1; rows without item, rater or any mark are left out."""
    def mark(c: str, top: int) -> Column:
        v = F.col(c).cast("double")
        return F.when((v >= 0) & (v <= top), v / top)

    # Confidence weighs a vote from 0.6 to 1; null or out of range counts as the middle.
    trust = F.lit(0.8) if confidence is None else F.coalesce(F.when(F.col(confidence).between(1, 5), 0.5 + F.col(confidence) / 10), F.lit(0.8))
    marks = F.struct(*(mark(c, top).alias(f"x{i}") for i, (c, top) in enumerate(scales.items())), trust.cast("double").alias("c"))
    time = lambda c: (F.col(c).cast("timestamp") if c else F.lit(None).cast("timestamp"))
    rows = df.select(F.col(item).cast("string").alias("item"), F.col(rater).cast("string").alias("rater"), marks.alias("m"), time(rated).alias("a"), time(received).alias("b"))
    rows = rows.where(F.col("item").isNotNull() & F.col("rater").isNotNull())
    last = rows.groupBy("item", "rater").agg(F.max_by("m", F.struct("a", "b", "m")).alias("m")).select("item", "rater", "m.*")
    return last.where(F.coalesce(*(F.col(f"x{i}") for i in range(len(scales)))).isNotNull())


def _round(votes: DataFrame, raters: DataFrame, dims: range, mean: float) -> DataFrame:
    """Accuracy and offsets of each rater against the weighted consensus of the others."""
    v = votes.join(raters.select("rater", "w", *(f"o{i}" for i in dims)), "rater")
    v = v.withColumn("w", F.col("w") * F.col("c"))
    for i in dims:
        v = v.withColumn(f"x{i}", F.col(f"x{i}") - F.col(f"o{i}"))
    held = lambda i: F.when(F.col(f"x{i}").isNotNull(), F.col("w"))
    pooled = v.groupBy("item").agg(*(F.sum(held(i)).alias(f"W{i}") for i in dims), *(F.sum(F.col("w") * F.col(f"x{i}")).alias(f"S{i}") for i in dims))
    v = v.join(pooled, "item")
    for i in dims:
        others = F.col(f"W{i}") - F.col("w")
        v = v.withColumn(f"y{i}", F.when(F.col(f"x{i}").isNotNull() & (others > 1e-6), (F.col(f"S{i}") - F.col("w") * F.col(f"x{i}")) / others))
    both = [F.when(F.col(f"y{i}").isNotNull(), F.lit(1)).otherwise(F.lit(0)) for i in dims]
    count = sum(both[1:], both[0])
    mean_of = lambda k: sum((F.coalesce(F.when(F.col(f"y{i}").isNotNull(), F.col(f"{k}{i}")), F.lit(0.0)) for i in dims), F.lit(0.0)) / count
    v = v.withColumn("x", F.when(count > 0, mean_of("x"))).withColumn("y", F.when(count > 0, mean_of("y")))
    s = v.groupBy("rater").agg(
        F.count("*").alias("ratings"), F.count("x").alias("n"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy"), F.avg(F.col("x") * F.col("y")).alias("xy"),
        *(F.sum(F.col(f"x{i}") - F.col(f"y{i}")).alias(f"d{i}") for i in dims), *(F.count(f"y{i}").alias(f"n{i}") for i in dims),
        *(F.max(f"o{i}").alias(f"o{i}") for i in dims),
    )
    floor = LEAST_SPREAD**2
    raw = (F.col("xy") - F.col("mx") * F.col("my")) / F.sqrt((F.col("xx") - F.col("mx") ** 2 + floor) * (F.col("yy") - F.col("my") ** 2 + floor))
    n = F.col("n")
    accuracy = F.when(n < 2, F.lit(mean)).otherwise((n * raw + SMOOTHING * mean) / (n + SMOOTHING))
    return s.select(
        "rater", "ratings", accuracy.alias("accuracy"),
        (F.greatest(accuracy, F.lit(0.05)) ** 2).alias("w"),
        *((F.col(f"o{i}") + F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / (F.col(f"n{i}") + SMOOTHING)).alias(f"o{i}") for i in dims),
    )


def consensus(
    df: DataFrame,
    item: str = "item_id",
    rater: str = "rater_id",
    scales: Mapping[str, int] = SCALES,
    confidence: str | None = "confidence",
    rated: str | None = "rated_at",
    received: str | None = "received_at",
    max_rounds: int = MAX_ROUNDS,
) -> Consensus:
    """Consensus, agreement and reliability.

    ``items``: item, ``raters``, one consensus mark per dimension (rounded to its scale; null without any
    valid mark), ``score`` (mean share of the scales) and ``agreement`` (1: equal marks, 0: as far apart as
    marks of any two items, null with one rater). ``raters``: rater, ``ratings``, ``accuracy``, ``offset``
    (mean share by which they mark higher) and ``follows``. Repeats of a row count once, corrections
    replace earlier marks, ties of rating times go to the greater marks; an empty table gives empty ones.
    """
    dims = range(len(scales))
    votes = keep(clean_ratings(df, item, rater, scales, confidence, rated, received))
    raters = votes.groupBy("rater").agg(F.count("*").alias("ratings")).select("rater", "ratings", F.lit(0.5).alias("accuracy"), F.lit(1.0).alias("w"), *(F.lit(0.0).alias(f"o{i}") for i in dims))
    mean, rounds = 0.5, 0
    while rounds < max_rounds:
        rounds += 1
        fresh = cut_table(_round(votes, raters, dims, mean))
        both = fresh.select("rater", "accuracy", "ratings").join(raters.select("rater", F.col("accuracy").alias("before")), "rater")
        gap, mean = both.agg(F.max(F.abs(F.col("accuracy") - F.col("before"))), F.avg("accuracy")).first()
        raters = fresh
        if gap is None or gap < STABLE:
            break
        mean = float(mean)
    items, agreement = _pool(votes, raters, scales)
    offset = sum((F.col(f"o{i}") for i in dims), F.lit(0.0)) / len(scales)
    return Consensus(
        items.withColumnRenamed("item", item),
        raters.select(F.col("rater").alias(rater), "ratings", "accuracy", offset.alias("offset"), (F.col("accuracy") >= LEAST_ACCURACY).alias("follows")),
        agreement,
        rounds,
    )


def _pool(votes: DataFrame, raters: DataFrame, scales: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    dims = range(len(scales))
    v = votes.join(raters.select("rater", "w", *(f"o{i}" for i in dims)), "rater").withColumn("w", F.col("w") * F.col("c"))
    parts = [F.count("*").alias("raters")]
    for i in dims:
        x = F.col(f"x{i}")
        parts += [
            F.sum(F.when(x.isNotNull(), F.col("w"))).alias(f"W{i}"), F.sum(F.col("w") * (x - F.col(f"o{i}"))).alias(f"S{i}"),
            F.count(x).alias(f"m{i}"), F.sum(x).alias(f"a{i}"), F.sum(x * x).alias(f"b{i}"),
        ]
    pooled = keep(v.groupBy("item").agg(*parts))
    # Krippendorff: observed and expected squared difference of two marks, over items with two or more.
    pair = lambda i: F.col(f"m{i}") >= 2
    inside = lambda i: F.when(pair(i), (F.col(f"m{i}") * F.col(f"b{i}") - F.col(f"a{i}") ** 2) * 2 / (F.col(f"m{i}") - 1))
    sums = [x for i in dims for x in (
        F.sum(inside(i)).alias(f"all_D{i}"), F.sum(F.when(pair(i), F.col(f"m{i}"))).alias(f"all_M{i}"),
        F.sum(F.when(pair(i), F.col(f"a{i}"))).alias(f"all_A{i}"), F.sum(F.when(pair(i), F.col(f"b{i}"))).alias(f"all_B{i}"),
    )]
    total = pooled.agg(*sums)
    expected = lambda i: 2 * (F.col(f"all_M{i}") * F.col(f"all_B{i}") - F.col(f"all_A{i}") ** 2) / (F.col(f"all_M{i}") * (F.col(f"all_M{i}") - 1))
    rows = F.explode(F.array(*(
        F.struct(F.lit(c).alias("dimension"), F.col(f"all_M{i}").alias("marks"), F.try_divide(F.col(f"all_D{i}"), F.col(f"all_M{i}")).alias("observed"), F.when(F.col(f"all_M{i}") > 1, expected(i)).alias("expected"))
        for i, c in enumerate(scales)
    )))
    agreement = total.select(rows.alias("r")).select("r.*").withColumn("alpha", 1 - F.try_divide(F.col("observed"), F.col("expected")))
    share = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(f"S{i}"), F.col(f"W{i}"))))
    got = lambda i: F.when(F.col(f"W{i}") > 0, share(i))
    # total is one row: the cross join with it adds columns, not rows.
    one = pooled.crossJoin(F.broadcast(total))
    apart = [F.try_divide(F.try_divide(inside(i), F.col(f"m{i}")), expected(i)) for i in dims]
    known = F.array_compact(F.array(*apart))
    shares = F.array_compact(F.array(*(got(i) for i in dims)))
    average = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    items = one.select(
        "item", "raters",
        *(F.round(got(i) * top).cast("int").alias(c) for i, (c, top) in enumerate(scales.items())),
        average(shares).alias("score"), (1 - average(known)).alias("agreement"),
    )
    return items, agreement


def careless_raters(df: DataFrame, rater: str = "rater_id", **options: object) -> DataFrame:
    """Raters whose marks do not follow the quality of the items they rated."""
    return consensus(df, rater=rater, **options).raters.where(~F.col("follows")).select(rater)
