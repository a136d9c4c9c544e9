"""Problem 6: records that differ only in form, collapsed to one each with the number of copies.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are canonicalised and
grouped again on the full canonical text, summing the counts. Membership (which ids are copies of which
record) goes through the SHA-256 of the raw text, so no text is shuffled twice and no group collected.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import FULL, HALF, squeezed_column
from marlstone.session import cut_table

#: Separators of the canonical form of a JSON object; squeezed texts contain none of them.
FIELD, VALUE, ITEM, NULL = "\x1e", "\x1f", "\x1d", "\x1c"
#: Types of values that need no walk.
_SCALAR = r"(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\([0-9, ]*\))"
_EDGES = re.compile(r"^[\s\x00-\x1f\x7f-\x9f\xad\u061c\u180e\u200b-\u200f\u2028-\u202e\u2060-\u206f\ufeff]+|[\s\x00-\x1f\x7f-\x9f\xad\u061c\u180e\u200b-\u200f\u2028-\u202e\u2060-\u206f\ufeff]+$")
_WIDTH = {ord(f): h for f, h in zip(FULL, HALF)}


def canonical_text(col: Column) -> Column:
    """Text without blanks, invisible characters and punctuation, in lower case and half width."""
    return squeezed_column(col)


def canonical_object(col: Column) -> Column:
    """A JSON object with its fields in order and each name and value as canonical text, JVM-side.

    Values may be scalars or arrays of scalars of one type (items keep their borders), told apart by their
    JSON type; an object or array inside a value, text that is no JSON object, and null are left to the
    caller: the result is null there."""
    col = F.regexp_replace(col, r"^[\p{Z}\p{C}\s]+|[\p{Z}\p{C}\s]+$", "")
    fields = F.from_json(col, "map<string,string>")
    kinds = F.transform_values(F.try_parse_json(col).try_cast("map<string,variant>"), lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))

    def value(kind: Column, v: Column) -> Column:
        items = F.transform(F.from_json(v, "array<string>"), lambda x: F.coalesce(canonical_text(x), F.lit(NULL)))
        return F.when(v.isNull(), F.lit(NULL)).when(kind.startswith("ARRAY<"), F.concat(F.lit("["), F.array_join(items, ITEM))).otherwise(canonical_text(v))

    pairs = F.array_sort(
        F.transform(F.map_entries(fields), lambda e: F.concat(canonical_text(e["key"]), F.lit(VALUE), value(F.try_element_at(kinds, e["key"]), e["value"])))
    )
    flat = F.forall(F.map_values(kinds), lambda k: k.rlike(f"^(?:{_SCALAR}|ARRAY<{_SCALAR}>)$"))
    return F.when(F.coalesce(flat, F.lit(False)) & (F.size(fields) > 0), F.array_join(pairs, FIELD))


def canonical_plain(text: str) -> str:
    """``canonical_text`` in Python."""
    return "".join(c for c in text.translate(_WIDTH).lower() if unicodedata.category(c)[0] not in "PZC")


def canonical_json(text: str | None) -> str | None:
    """The general form in Python: nested objects with their fields in order; other text as plain text. Objects
    without nested values get the form of ``canonical_object``."""
    if text is None:
        return None
    try:
        found = json.loads(_EDGES.sub("", text))
    except (ValueError, RecursionError):
        return canonical_plain(text)

    def fields(x: dict) -> str:
        return FIELD.join(sorted(canonical_plain(k) + VALUE + walk(v) for k, v in x.items()))

    def walk(x: object) -> str:
        if isinstance(x, dict):
            return "{" + fields(x) + "}"
        if isinstance(x, list):
            return "[" + ITEM.join("[" + walk(i) + "]" if isinstance(i, list) else walk(i) for i in x)
        return NULL if x is None else canonical_plain(x if isinstance(x, str) else json.dumps(x))

    try:
        return fields(found) or "{}" if isinstance(found, dict) else walk(found) if isinstance(found, list) else canonical_plain(text)
    except RecursionError:
        return canonical_plain(text)


@F.pandas_udf(T.StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


def distinct_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Byte-identical texts collapsed: raw text, ``copies`` (rows) and the least and greatest key."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("raw")).where(F.col("raw").isNotNull() & F.col("k").isNotNull())
    return rows.groupBy("raw").agg(F.count("*").alias("copies"), F.min("k").alias("k0"), F.max("k").alias("k1"))


def canonical_forms(df: DataFrame, key: str, text: str, as_json: bool = False) -> DataFrame:
    """``distinct_forms`` with the SHA-256 of the raw text and its canonical text."""
    raw = distinct_forms(df, key, text).withColumn("h", F.unhex(F.sha2("raw", 256)))
    if not as_json:
        return raw.select("h", canonical_text(F.col("raw")).alias("canonical"), "copies", "k0", "k1")
    flat = raw.withColumn("canonical", canonical_object(F.col("raw")))
    simple = flat.where(F.col("canonical").isNotNull()).drop("raw")
    # Values within values and text that is no JSON need a walk; most payloads never get there.
    other = flat.where(F.col("canonical").isNull()).withColumn("canonical", _canonical_json("raw")).drop("raw")
    return simple.select("h", "canonical", "copies", "k0", "k1").unionByName(other.select("h", "canonical", "copies", "k0", "k1"))


def collapse(df: DataFrame, key: str, text: str, as_json: bool = False) -> DataFrame:
    """One row per record: ``canonical``, the smallest ``key``, ``copies`` (rows, repeats included) and
    ``forms`` (byte-different texts).

    Null texts and keys are left out; texts that are nothing but blanks and punctuation share the empty
    canonical text; JSON null and a missing field differ; malformed JSON is compared as plain text. Extra
    columns are ignored and an empty table gives an empty one."""
    return (
        canonical_forms(df, key, text, as_json)
        .groupBy("canonical")
        .agg(F.min("k0").alias(key), F.sum("copies").alias("copies"), F.count("*").alias("forms"))
    )


def copy_pairs(df: DataFrame, key: str, text: str, as_json: bool = False) -> DataFrame:
    """(id_1, id_2): each copy with the smallest key of its record; one row per key but the smallest."""
    forms = cut_table(canonical_forms(df, key, text, as_json).withColumn("c", F.unhex(F.sha2("canonical", 256))))
    groups = forms.groupBy("canonical").agg(F.min("k0").alias("head"), F.max("k1").alias("k1"))
    heads = groups.where(F.col("head") != F.col("k1")).select(F.unhex(F.sha2("canonical", 256)).alias("c"), "head")
    # Both joins have rows of a few dozen bytes; a hot record or text is split by the adaptive skew join.
    copies = forms.select("h", "c").join(heads, "c").select("h", "head")
    members = df.select(F.col(key).alias("k"), F.col(text).alias("raw")).where(F.col("raw").isNotNull() & F.col("k").isNotNull())
    members = members.select("k", F.unhex(F.sha2("raw", 256)).alias("h"))
    return (
        members.join(copies, "h").where(F.col("k") != F.col("head"))
        .select(F.col("head").alias("id_1"), F.col("k").alias("id_2")).distinct()
    )
