"""JSON lines and CSV with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row of a retrieval corpus.
CORPUS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source_id", "chunk_id", "text", "title", "section")]
    + [T.StructField("page", T.IntegerType()), T.StructField("published_at", T.DateType()), T.StructField("authority_level", T.StringType())]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
LANES = ("generic", "personal")


class InvalidInput(ValueError):
    """Input that a strict reader refuses; the message says what and how much."""


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Rows of a JSON-lines file or folder. A missing path is an empty table, blank lines are passed over; a
    line that is no object of the schema, has an unknown key or lacks a required one raises, once, with counts.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys("value")
    strange = keys.isNull() | (F.size(F.array_except(keys, known)) > 0)
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.col(f"row.{name}").isNull()
    checked = lines.select(parsed.alias("row"), strange.alias("strange")).withColumn("lacking", lacking)
    bad = checked.agg(F.count(F.when(F.col("strange"), 1)).alias("strange"), F.count(F.when(F.col("lacking"), 1)).alias("lacking")).first()
    if bad["strange"] or bad["lacking"]:
        raise InvalidInput(f"{bad['strange']} lines with unknown keys or no object, {bad['lacking']} without a required field")
    return checked.select("row.*")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, unless a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").count()
    if twice:
        raise InvalidInput(f"{twice} values of {', '.join(keys)} occur more than once")
    return df


def scoped_corpus(generic: DataFrame, personal: DataFrame, lane: str = "privacy_lane", key: str = "chunk_id") -> DataFrame:
    """Both corpora as one: each must hold its own lane only, and ids must be unique over both."""
    for df, name in ((generic, "generic"), (personal, "personal")):
        wrong = df.where(F.coalesce(F.col(lane) != name, F.lit(True))).count()
        if wrong:
            raise InvalidInput(f"{wrong} rows of the {name} corpus are of another lane")
    return require_unique(generic.unionByName(personal), key)


def in_scope(df: DataFrame, scope: str, lane: str = "privacy_lane") -> DataFrame:
    """Rows of a lane, or of all lanes for ``all``; rows of an unknown lane raise when they are read."""
    known = F.col(lane).isin(*LANES)
    unknown = F.raise_error(F.concat(F.lit("unknown lane "), F.coalesce(F.col(lane), F.lit("null")))).cast("boolean")
    checked = df.where(F.when(known, F.lit(True)).otherwise(unknown))
    return checked if scope == "all" else checked.where(F.col(lane) == scope)


def with_default_lane(df: DataFrame, lane: str = "privacy_lane") -> DataFrame:
    """Rows without a lane are generic."""
    return df.withColumn(lane, F.coalesce(F.col(lane), F.lit("generic")) if lane in df.columns else F.lit("generic"))


def merged_chunks(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per key: equal duplicates are tolerated, differing ones raise."""
    rows = df.distinct()
    return require_unique(rows, key).orderBy(key)


def scan_ratings(spark: SparkSession, path: str, bounds: dict[str, int], key: str = "item_id") -> DataFrame:
    """Rating CSV with exactly the columns key, then those of ``bounds`` in order. Marks must be canonical
    integers (no sign, no leading zero) from 0 to their bound; a byte-order mark is ignored. Anything else
    raises."""
    names = [key, *bounds]
    raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    got = [c.lstrip("﻿") for c in raw.columns]
    if got != names:
        raise InvalidInput(f"the header is {got}, not {names}")
    raw = raw.toDF(*got)
    bad = F.col(key).isNull()
    for c, top in bounds.items():
        bad = bad | ~F.coalesce(F.col(c).rlike(r"^(0|[1-9]\d{0,8})$") & (F.try_to_number(F.col(c), F.lit("999999999")) <= top), F.lit(False))
    n = raw.where(bad).count()
    if n:
        raise InvalidInput(f"{n} rows with marks that are no canonical integers within bounds")
    return raw.select(key, *(F.col(c).cast("int").alias(c) for c in bounds))


def answerability_errors(df: DataFrame, answerable: Column, gold: Column, points: Column) -> DataFrame:
    """Rows that break the rule: gold if and only if answerable, and no points without an answer."""
    has_gold, has_points = F.coalesce(F.size(gold), F.lit(0)) > 0, F.coalesce(F.size(points), F.lit(0)) > 0
    reason = F.when(answerable & ~has_gold, "answerable_without_gold").when(~answerable & has_gold, "gold_without_answer").when(~answerable & has_points, "points_without_answer")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def duplicate_keys(col: Column) -> Column:
    """Whether JSON text has an object with the same key twice; null for text that is no JSON."""
    import json

    def check(text: str | None) -> bool | None:
        twice = False

        def pairs(items: list) -> dict:
            nonlocal twice
            twice = twice or len({k for k, _ in items}) < len(items)
            return dict(items)

        try:
            json.loads(text, object_pairs_hook=pairs)
        except (TypeError, ValueError, RecursionError):
            return None
        return twice

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(check).astype("object")

    return F.pandas_udf(run, T.BooleanType())(col)


