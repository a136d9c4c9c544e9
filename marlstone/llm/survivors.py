"""Problem 2: the best record of each duplicate group, by skyline selection.

A record dominates another if it is at least as good in completeness, recency and trust and better in
one. The undominated records are layer 1; without them the next are layer 2, and so on. The survivor is
the first of layer 1 by a lexicographic policy, and its null fields are filled from the successive layers.

Nothing collects a group. Records of one group with the same trust and completeness form a cell; a record
with ``layers`` later ones in its cell is below layer ``layers``, so only the ``layers`` latest spots
(distinct times) of each cell can be in a layer that is looked at. Trust has five levels and completeness
as many as there are different numbers of points, so what is left of a group does not grow with its rows. Fields
that are null in all those layers are filled from the first other record by the policy, which needs no
layers and is a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import half_width, squeezed_column

# Review statuses from the most to the least trusted; anything else counts as null.
TRUST = ("accepted", "needs_review", "needs_answer", "conflict")
# Placeholders of answer points, after dropping blanks and punctuation in lower case.
POINT_PLACEHOLDERS = ("", "todo", "tbd", "tba", "na", "null", "none", "nil", "nan", "待补充", "待定", "待填写", "暂无", "无")
#: Layers that are computed; deeper records still fill fields, in the order of the policy.
LAYERS = 4


def clean_group(col: Column) -> Column:
    """Group ids trimmed of any blanks and in lower case; blank ones become null."""
    c = F.lower(F.regexp_replace(col, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return F.when(c != "", c)


def trust_level(status: Column) -> Column:
    """4 for the most trusted status down to 1, and 0 for null or unknown ones."""
    s = F.lower(F.regexp_replace(half_width(status), r"[\s\p{Z}\p{C}]+", ""))
    out = F.lit(0)
    for i, name in enumerate(TRUST):
        out = F.when(s == name, F.lit(len(TRUST) - i)).otherwise(out)
    return F.when(status.isNull(), F.lit(0)).otherwise(out)


def usable_points(points: Column) -> Column:
    """Number of answer points that are no placeholders; those that differ only in blanks, punctuation,
    case or width count once. Null arrays and null entries count 0."""
    keys = F.array_distinct(F.transform(points, lambda p: squeezed_column(F.coalesce(p, F.lit("")))))
    return F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, POINT_PLACEHOLDERS)))), F.lit(0))


def _dominates(a: Column, t: Column, p: Column, u: Column) -> Column:
    return (a["t"] >= t) & (a["p"] >= p) & (a["u"] >= u) & ((a["t"] > t) | (a["p"] > p) | (a["u"] > u))


def scored_records(
    df: DataFrame, group: str, key: str, status: str, points: str, updated: str, fields: Sequence[str]
) -> DataFrame:
    """One row per (group, key) with trust, completeness and recency; of differing rows of one key the
    first by the policy. Rows without group or key are dropped: they are in no duplicate group."""
    rows = df.select(
        clean_group(F.col(group).cast("string")).alias("g"),
        F.col(key).cast("string").alias("k"),
        trust_level(F.col(status)).alias("t"),
        usable_points(F.col(points)).alias("p"),
        F.coalesce(F.unix_micros(F.col(updated).cast("timestamp")), F.lit(-(2**62))).alias("u"),
        F.struct(*(F.col(f) for f in fields)).alias("r"),
    ).where(F.col("g").isNotNull() & F.col("k").isNotNull())
    return rows.groupBy("g", "k").agg(F.max_by(F.struct("t", "p", "u", "r"), F.struct("t", "p", "u", F.xxhash64("r"))).alias("x")).select("g", "k", "x.*")


def survivors(
    df: DataFrame,
    group: str = "duplicate_group_id",
    key: str = "question_id",
    status: str = "review_status",
    points: str = "answer_points",
    updated: str = "updated_at",
    fields: Sequence[str] | None = None,
    layers: int = LAYERS,
) -> DataFrame:
    """One row per duplicate group: the group id, ``key`` of the survivor, its fields with nulls filled from
    successive layers, and

    - ``n_records``: distinct keys of the group;
    - ``skyline_size``: undominated records, ties included;
    - ``unique_best``: whether one record alone is at least as good as every other in all three respects;
    - ``filled``: names of the fields that came from another record.

    Policy within a layer: trust, then completeness, then recency, then the smallest key. Null or unknown
    status is the lowest trust, null time the oldest; a group of one record gives that record; blank group
    ids are in no group; an empty table gives an empty one. Extra columns survive only if named in
    ``fields`` (default: all but group and key, so clashing names need a choice by the caller).
    """
    fields = [c for c in (df.columns if fields is None else fields) if c not in (group, key)]
    scored = scored_records(df, group, key, status, points, updated, fields)

    # A spot: the records of one group that are equal in all three respects.
    spots = scored.groupBy("g", "t", "p", "u").agg(
        F.count("*").alias("n"),
        F.min("k").alias("k"),
        F.min_by("r", "k").alias("r"),
        *(F.min_by(F.col("r")[f], F.when(F.col("r")[f].isNotNull(), F.col("k"))).alias(f"v{i}") for i, f in enumerate(fields)),
    )
    latest = Window.partitionBy("g", "t", "p").orderBy(F.col("u").desc())
    near = spots.withColumn("i", F.row_number().over(latest)).where(F.col("i") <= layers)
    value = lambda f, i: F.col(f"v{i}").alias(f)
    entry = F.struct("t", "p", "u", "k", "n", F.struct(*(value(f, i) for i, f in enumerate(fields))).alias("v")) if fields else F.struct("t", "p", "u", "k", "n")
    totals = scored.groupBy("g").agg(
        F.count("*").alias("n_records"),
        F.max("t").alias("max_t"), F.max("p").alias("max_p"), F.max("u").alias("max_u"),
        *(
            F.max_by(F.struct(F.col("r")[f].alias("x")), F.when(F.col("r")[f].isNotNull(), F.struct("t", "p", "u", "k"))).alias(f"w{i}")
            for i, f in enumerate(fields)
        ),
    )
    bounded = near.groupBy("g").agg(F.collect_list(entry).alias("e"))

    # Peel the layers off the bounded list.
    out = bounded
    rest = F.col("e")
    for i in range(1, layers + 1):
        out = out.withColumn(f"l{i}", F.array_sort(_undominated(rest), _policy))
        out = out.withColumn(f"rest{i}", _without(rest, F.col(f"l{i}")))
        rest = F.col(f"rest{i}")
    ordered = F.concat(*(F.col(f"l{i}") for i in range(1, layers + 1)))
    out = out.select("g", F.col("l1"), ordered.alias("ordered")).join(totals, "g")
    best = F.col("l1")[0]
    picked, filled = [], []
    for i, f in enumerate(fields):
        first = _with_value(F.col("ordered"), f)
        own = best["v"][f]
        picked.append(F.when(own.isNotNull(), own).when(F.size(first) > 0, F.try_element_at(first, F.lit(1))["v"][f]).otherwise(F.col(f"w{i}")["x"]).alias(f))
        filled.append(F.when(own.isNull() & F.col(f"w{i}").isNotNull(), F.lit(f)))
    return out.select(
        F.col("g").alias(group),
        best["k"].alias(key),
        *picked,
        "n_records",
        F.aggregate("l1", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("skyline_size"),
        ((best["t"] == F.col("max_t")) & (best["p"] == F.col("max_p")) & (best["u"] == F.col("max_u")) & (best["n"] == 1)).alias("unique_best"),
        (F.array_compact(F.array(*filled)) if fields else F.array().cast("array<string>")).alias("filled"),
    )


def _undominated(entries: Column) -> Column:
    return F.filter(entries, lambda x: ~F.exists(entries, lambda y: _dominates(y, x["t"], x["p"], x["u"])))


def _without(entries: Column, gone: Column) -> Column:
    return F.filter(entries, lambda x: ~F.exists(gone, lambda y: (y["t"] == x["t"]) & (y["p"] == x["p"]) & (y["u"] == x["u"])))


def _with_value(entries: Column, field: str) -> Column:
    return F.filter(entries, lambda x: x["v"][field].isNotNull())


def _policy(a: Column, b: Column) -> Column:
    x = F.struct(a["t"], a["p"], a["u"])
    y = F.struct(b["t"], b["p"], b["u"])
    return F.when(x > y, -1).when(x < y, 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def unique_survivors(df: DataFrame, group: str = "duplicate_group_id", key: str = "question_id", **names: str) -> DataFrame:
    """Groups of two or more records whose survivor alone is best in all three respects."""
    s = survivors(df, group, key, fields=[], **names)
    return s.where((F.col("n_records") >= 2) & F.col("unique_best")).select(group, key)
