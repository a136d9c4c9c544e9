"""Scores, agreement of raters, quality of answers and reports, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import keep

EXACT = "decimal(38,12)"


def band(score: Column) -> Column:
    """0 below 60, 1 below 80, else 2; null for null."""
    return F.when(score < 60, 0).when(score < 80, 1).when(score.isNotNull(), 2)


def mean(col: Column) -> Column:
    """Average that does not depend on the order of summation."""
    return F.avg(col.cast(EXACT)).cast("double")


def score_metrics(reference: Column, observed: Column) -> list[Column]:
    """count, mean absolute and signed error, share within 10, band accuracy; nulls without pairs."""
    both = reference.isNotNull() & observed.isNotNull()
    only = lambda c: F.when(both, c)
    error = observed - reference
    return [
        F.count(only(F.lit(1))).alias("count"), F.round(mean(only(F.abs(error))), 4).alias("mean_absolute_error"), F.round(mean(only(error)), 4).alias("mean_signed_error"),
        F.round(mean(only((F.abs(error) <= 10).cast("int"))), 4).alias("within_10_accuracy"), F.round(mean(only((band(reference) == band(observed)).cast("int"))), 4).alias("band_accuracy"),
    ]


def pair_sums(a: str, b: str) -> list[Column]:
    """Sums over pairs of marks 0..100 that ``agreement`` works on; all integers, so exact."""
    x, y = F.col(a).cast("decimal(38,0)"), F.col(b).cast("decimal(38,0)")
    cells = [F.count(F.when(band(F.col(c)) == i, 1)).alias(f"{c}_band{i}") for c in (a, b) for i in range(3)]
    return [
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.sum(F.abs(x - y)).alias("sd"), F.count(F.when(F.abs(x - y) <= 10, 1)).alias("near"), F.count(F.when(band(F.col(a)) == band(F.col(b)), 1)).alias("same"), F.count(F.when(F.col(a) == F.col(b), 1)).alias("equal"), *cells,
    ]


def agreement(a: str, b: str) -> dict[str, Column]:
    """Measures over the columns of ``pair_sums``. Degenerate cases: kappa and quadratic kappa are 1 for full
    agreement and else 0 where chance explains all; Pearson is 1 for equal and else 0 for constant marks."""
    d = lambda c: F.col(c).cast("double")
    n = d("n")
    observed = d("same") / n
    expected = sum((d(f"{a}_band{i}") * d(f"{b}_band{i}") for i in range(3)), F.lit(0.0)) / (n * n)
    kappa = F.when(F.abs(expected - 1) < 1e-9, F.when(F.abs(observed - 1) < 1e-9, 1.0).otherwise(0.0)).otherwise(F.try_divide(observed - expected, 1 - expected))
    apart = (d("sxx") + d("syy") - 2 * d("sxy")) / n
    chance = d("sxx") / n + d("syy") / n - 2 * (d("sx") / n) * (d("sy") / n)
    qwk = F.when(chance < 1e-9, F.when(apart < 1e-9, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(apart, chance))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    pearson = F.when((vx == 0) | (vy == 0), F.when(F.col("equal") == F.col("n"), 1.0).otherwise(0.0)).otherwise(F.try_divide(cov, F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double"))))
    return {
        "mean_absolute_difference": d("sd") / n, "within_10": d("near") / n, "band_agreement": observed,
        "cohen_kappa": kappa, "quadratic_weighted_kappa": qwk, "pearson": pearson,
    }


def rater_pairs(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """(rater_a, rater_b, item, a, b): marks of two raters for one item, each pair of raters once."""
    r = ratings.select(F.col(item).alias("item"), F.col(rater).alias("r"), F.col(score).alias("s")).where("s is not null")
    left, right = r.select("item", F.col("r").alias("rater_a"), F.col("s").alias("a")), r.select("item", F.col("r").alias("rater_b"), F.col("s").alias("b"))
    return left.join(right, "item").where("rater_a < rater_b")


def pairwise_agreement(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    sums = rater_pairs(ratings, item, rater, score).groupBy("rater_a", "rater_b").agg(*pair_sums("a", "b"))
    return sums.select("rater_a", "rater_b", F.col("n").alias("items"), *(F.round(c, 9).alias(k) for k, c in agreement("a", "b").items()))


def bootstrap_interval(values: DataFrame, cluster: str, value: str, replicates: int = 200, seed: int = 5) -> DataFrame:
    """(estimate, low, high) of the mean of cluster means, by resampling clusters with replacement.

    Each cluster gets a Poisson(1) count per replicate from a hash, which needs no draw table and no order;
    the interval is the 2.5 and 97.5 % percentile, widened to contain the estimate."""
    means = values.where(F.col(value).isNotNull()).groupBy(cluster).agg(mean(F.col(value)).alias("m"))
    drawn = means.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"), "m", F.col(cluster).alias("c"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("r"), F.col("c")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    limits, total, term = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += term
        limits.append(total)
        term /= i + 1
    times = sum(((u > x).cast("int") for x in limits[1:]), (u > limits[0]).cast("int"))
    per = drawn.withColumn("w", times).groupBy("r").agg((F.sum((F.col("w") * F.col("m")).cast(EXACT)) / F.sum("w")).cast("double").alias("x"))
    band_ = per.agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
    est = means.agg(mean(F.col("m")).alias("estimate"))
    return est.crossJoin(F.broadcast(band_)).select("estimate", F.least("low", "estimate").alias("low"), F.greatest("high", "estimate").alias("high"))  # one row each


def grid_search(observations: DataFrame, answerable: str, axes: dict[str, Sequence[float]], least_recall: float) -> DataFrame:
    """The thresholds (one per column in ``axes``, all to be reached) with the best balanced accuracy among
    those whose recall reaches ``least_recall``; ties to higher recall, then to the smallest thresholds.

    Every observation is reduced to the number of the highest threshold it reaches on each axis before the
    grid is crossed with the counts, so the cross is of two bounded tables: cells and candidates."""
    level = {c: sum(((F.col(c) >= F.lit(float(t))).cast("int") for t in sorted(ts)), F.lit(0)) for c, ts in axes.items()}
    cells = observations.select(F.col(answerable).alias("y"), *(F.coalesce(v, F.lit(0)).alias(f"l_{c}") for c, v in level.items())).groupBy(*(f"l_{c}" for c in axes)).agg(
        F.count(F.when(F.col("y"), 1)).alias("pos"), F.count(F.when(~F.col("y"), 1)).alias("neg")
    )
    grid = None
    spark = observations.sparkSession
    for c, ts in axes.items():
        one = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(ts))], f"i_{c} int, {c} double")
        grid = one if grid is None else grid.crossJoin(one)  # the parameter grid
    passes = None
    for c in axes:
        p = F.col(f"l_{c}") >= F.col(f"i_{c}")
        passes = p if passes is None else passes & p
    rated = F.broadcast(grid).crossJoin(cells).groupBy(*axes).agg(F.sum(F.when(passes, F.col("pos")).otherwise(0)).alias("tp"), F.sum("pos").alias("p"), F.sum(F.when(~passes, F.col("neg")).otherwise(0)).alias("tn"), F.sum("neg").alias("n"))
    recall, none = F.try_divide("tp", "p"), F.try_divide("tn", "n")
    scored = rated.select(*axes, recall.alias("recall"), none.alias("no_answer_accuracy"), ((recall + none) / 2).alias("balanced"))
    key = F.struct("balanced", "recall", *(-F.col(c) for c in axes))
    return scored.where(F.col("recall") >= least_recall).agg(F.max_by(F.struct("*"), key).alias("b")).where("b is not null").select("b.*")


def logistic_folds(rows: DataFrame, label: str, features: Sequence[str], fold: str, strengths: Sequence[float], steps: int = 25) -> DataFrame:
    """(c, balanced_accuracy, recall, no_answer_accuracy, intercept, weights) for each inverse strength ``c`` of
    regularisation, out of fold, with a refit on all rows. Empty without rows of both classes.

    Each step of gradient descent is one aggregate by model: the few models (strengths times folds) are
    broadcast to the rows, which stay where they are. Features are standardised, classes weigh the same."""
    spark = rows.sparkSession
    schema = "c double, balanced_accuracy double, recall double, no_answer_accuracy double, intercept double, weights array<double>"
    rows = keep(rows.select(F.col(label).alias("y"), *features, F.col(fold).cast("int").alias("fold")))
    sides = F.count(F.when(F.col("y"), 1)).alias("pos"), F.count(F.when(~F.col("y"), 1)).alias("neg")
    m = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)), *sides).first()
    if not m["pos"] or not m["neg"]:
        return spark.createDataFrame([], schema)
    total = m["pos"] + m["neg"]
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())  # a handful
    models = [(c, k) for c in strengths for k in [*folds, -1]]
    w = [[0.0] * (len(features) + 1) for _ in models]
    x = F.array(F.lit(1.0), *((F.col(c) - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"] or 1.0) for i, c in enumerate(features)))
    even = F.when(F.col("y"), 0.5 / m["pos"]).otherwise(0.5 / m["neg"])
    ready = rows.select("y", "fold", x.alias("x"), even.alias("even"))

    def scored() -> DataFrame:
        now = spark.createDataFrame([(j, k, v) for j, ((_, k), v) in enumerate(zip(models, w))], "j int, k int, w array<double>")
        score = F.aggregate(F.zip_with("w", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return ready.crossJoin(F.broadcast(now)).withColumn("score", score)

    for _ in range(steps):
        g = F.col("even") * (F.col("y").cast("double") - 1 / (1 + F.exp(-F.col("score"))))
        learn = scored().where("fold <> k").withColumn("g", g).groupBy("j").agg(*(F.sum(F.col("g") * F.col("x")[i]).alias(f"g{i}") for i in range(len(features) + 1)))
        for r in learn.collect():  # a row a model
            v = w[r["j"]]
            decay = 1 / (models[r["j"]][0] * total)
            w[r["j"]] = [a + 2.0 * (r[f"g{i}"] - (decay * a if i else 0.0)) for i, a in enumerate(v)]
    right = ((F.col("score") >= 0) == F.col("y")).cast("double")
    tested = scored().where("fold = k").groupBy("j").agg(F.sum(F.when(F.col("y"), right)).alias("a"), F.sum(F.when(~F.col("y"), right)).alias("b")).collect()
    out = []
    for c in strengths:
        mine = [r for r in tested if models[r["j"]][0] == c]
        recall, none = sum(r["a"] or 0 for r in mine) / m["pos"], sum(r["b"] or 0 for r in mine) / m["neg"]
        full = w[models.index((c, -1))]
        out.append((float(c), (recall + none) / 2, recall, none, full[0], full[1:]))
    rows.unpersist()
    return spark.createDataFrame(out, schema)
