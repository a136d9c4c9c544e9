"""Learning state folded from logs: grades, mistakes, mastery, plans, limits and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Markers of the deterministic grader.
CLARITY_MARKERS = ("结论", "首先", "我认为", "核心", "总体")
REASONING_MARKERS = ("因为", "因此", "方法", "原理", "步骤", "流程", "选择", "判断")
EVIDENCE_MARKERS = ("例如", "比如", "结果", "数据", "提升", "降低", "负责", "实现", "%")
REFLECTION_MARKERS = ("不足", "局限", "风险", "改进", "下一步", "反思", "如果")
MAXIMA = {"clarity": 15, "coverage": 30, "reasoning": 20, "evidence": 20, "reflection": 15}
LOW_SCORE = 80


def _count(text: Column, markers: tuple[str, ...]) -> Column:
    return sum((text.contains(m).cast("int") for m in markers[1:]), text.contains(markers[0]).cast("int"))


def dimension_scores(df: DataFrame, answer: str) -> DataFrame:
    """Adds five marks from length bands and marker words. A null answer counts as empty."""
    t = F.coalesce(F.col(answer), F.lit(""))
    n = F.length(t)
    reasons, reflections = _count(t, REASONING_MARKERS), _count(t, REFLECTION_MARKERS)
    proofs = _count(t, EVIDENCE_MARKERS) + t.rlike(r"\p{Nd}").cast("int")
    return df.withColumns({
        "clarity": F.when((n >= 80) & (_count(F.substring(t, 1, 80), CLARITY_MARKERS) > 0), 15).when(n >= 45, 10).when(n >= 20, 5).otherwise(2),
        "coverage": F.when(n >= 220, 30).when(n >= 140, 24).when(n >= 80, 18).when(n >= 35, 10).otherwise(4),
        "reasoning": F.when(reasons >= 3, 20).when(reasons == 2, 15).when(reasons == 1, 9).otherwise(3),
        "evidence": F.when(proofs >= 3, 20).when(proofs == 2, 14).when(proofs == 1, 8).otherwise(2),
        "reflection": F.when(reflections >= 2, 15).when(reflections == 1, 9).otherwise(2),
    })


def weak_dimensions() -> Column:
    """Names of the dimensions below 65 % of their maximum, rounded up."""
    return F.array_compact(F.array(*(F.when(F.col(c) < -(-top * 65 // 100), F.lit(c)) for c, top in MAXIMA.items())))


def confidence(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 30, 0.45).when(n < 100, 0.58).otherwise(0.72)


def mastery(attempts: DataFrame, user: str, order: list[str], passed: Column) -> DataFrame:
    """Each attempt with the number of passes in a row up to it, the mastery after it and the days to the
    next review: two in a row master, one is under review, a failure opens again."""
    w = Window.partitionBy(user).orderBy(*order)
    a = attempts.withColumn("passed", passed).withColumn("run", F.sum(F.when(F.col("passed"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(user, "run").orderBy(*order)
    a = a.withColumn("in_row", F.sum(F.col("passed").cast("int")).over(inside))
    status = F.when(F.col("in_row") >= 2, "mastered").when(F.col("in_row") == 1, "reviewing").otherwise("open")
    days = F.when(F.col("in_row") >= 2, 14).when(F.col("in_row") == 1, 3).otherwise(1)
    return a.drop("run").withColumn("mastery", status).withColumn("review_days", days)


def schedule(plans: DataFrame, plan: str, days: str, minutes: str) -> DataFrame:
    """(plan, day, phase, minutes): one task a day. By the share of the way to the last day: study (the very
    first a diagnostic), from 45 % practice, from 78 % a mock interview, and the last day reviews. Minutes
    are shared evenly, at least 15 a day, the remainder goes to the first days."""
    rows = plans.where(F.col(days) > 0).select(plan, days, minutes, F.explode(F.sequence(F.lit(0), F.col(days) - 1)).alias("i"))
    last = F.col(days) - 1
    ratio = F.col("i") / F.greatest(last, F.lit(1))
    phase = F.when(F.col("i") == last, "review").when(ratio >= 0.78, "mock").when(ratio >= 0.45, "practice").when(F.col("i") == 0, "diagnostic").otherwise("study")
    daily = F.greatest(F.lit(15), F.floor(F.col(minutes) / F.col(days)))
    share = daily + (F.col("i") < F.col(minutes) - daily * F.col(days)).cast("int")
    return rows.select(plan, (F.col("i") + 1).alias("day"), phase.alias("phase"), share.cast("int").alias("minutes"))


def limited(events: DataFrame, user: str, at: str, window_ms: int = 1000, limit: int = 4) -> DataFrame:
    """Adds ``allowed``: at most ``limit`` events in a fixed window that is anchored at its first event and
    starts anew with the first event ``window_ms`` or more after it. ``at`` is in milliseconds.

    Sequential by user; the rows of one user are streamed in order through a partition, never collected."""
    schema = events.withColumn("allowed", F.lit(True)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, n = object(), 0, 0
        for b in batches:
            out = []
            for u, t in zip(b[user], b[at]):
                if u != who or t - start >= window_ms:
                    who, start, n = u, t, 0
                n += 1
                out.append(n <= limit)
            b["allowed"] = out
            yield b

    return events.repartition(user).sortWithinPartitions(user, at).mapInPandas(run, schema)


def sessions(events: DataFrame, user: str, at: str, kind: str, gap_seconds: int = 1800) -> DataFrame:
    """(user, session, first, last, events, kinds): a session ends after ``gap_seconds`` without an event."""
    w = Window.partitionBy(user).orderBy(at, kind)
    moment = F.col(at).cast("timestamp")
    new = (F.unix_micros(moment) - F.unix_micros(F.lag(moment).over(w))) > gap_seconds * 1_000_000
    numbered = events.withColumn("session", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return numbered.groupBy(user, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"), F.countDistinct(kind).alias("kinds"))
