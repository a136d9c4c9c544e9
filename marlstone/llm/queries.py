"""The queries of this subpackage, over whole tables, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import consensus, formdups, leakage, mixing, overlap, pairs, pii, spam, survivors
from marlstone.llm.common import FULL, HALF, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "answer_fixtures"))


def p1_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "answer_fixtures")
    flagged = pairs.flag_broken_pairs(t).join(t.select("case_id", "dimension").distinct(), "case_id")
    return flagged.groupBy("dimension", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.unique_survivors(table(spark, d, "question_bank"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    fields = ["canonical_text", "topic", "direction", "difficulty", "answer_points", "rubric", "review_status", "content_fingerprint", "updated_at"]
    return survivors.survivors(table(spark, d, "question_bank"), fields=fields)


_PII_TABLES = (("grading_cases", "case_id", "answer"), ("public_human_grading", "item_id", "candidate_answer"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, text in _PII_TABLES:
        found = pii.personal_details(table(spark, d, name), key, text).select(F.lit(name).alias("source"), F.col(key).alias("record_id"), "kind")
        out = found if out is None else out.unionByName(found)
    return out


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text of both tables with placeholders in place of personal details."""
    out = None
    for name, key, text in _PII_TABLES:
        rows = table(spark, d, name).select(F.lit(name).alias("source"), F.col(key).alias("record_id"), F.col(text).alias("text")).distinct()
        clean = pii.redacted(rows, "text").select("source", "record_id", "redacted")
        out = clean if out is None else out.unionByName(clean)
    return out


def p3_field(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, _, text in _PII_TABLES:
        one = pii.field_effect(table(spark, d, name), text).select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.careless_raters(table(spark, d, "public_human_grading"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "public_human_grading")).items


def p4_raters(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "public_human_grading")).raters


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "public_human_grading")).agreement


def _split_tables(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str, str, str]]:
    return {
        "questions": (table(spark, d, "questions"), "case_id", "question", "split"),
        "grading_cases": (table(spark, d, "grading_cases"), "case_id", "answer", "split"),
    }


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = overlap.near_pairs(_split_tables(spark, d))
    return p.select("source", F.least("train_id", "eval_id").alias("case_id_1"), F.greatest("train_id", "eval_id").alias("case_id_2")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_summary(overlap.near_links(_split_tables(spark, d)))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row with a split: its class of equal texts and how many classes across the split are near it."""
    found = overlap.near_links(_split_tables(spark, d))
    ends = found.pairs.select(F.explode(F.array("e", "t")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    return found.members.distinct().join(ends, "fp", "left").select(found.source().alias("source"), F.col("id").alias("case_id"), "split", F.col("fp").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    bank = formdups.copy_pairs(table(spark, d, "question_bank"), "question_id", "normalized_text")
    raw = formdups.copy_pairs(table(spark, d, "raw_records"), "raw_id", "payload", as_json=True)
    return bank.select(F.lit("question_bank").alias("source"), "id_1", "id_2").unionByName(raw.select(F.lit("raw_records").alias("source"), "id_1", "id_2"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    bank = formdups.collapse(table(spark, d, "question_bank"), "question_id", "normalized_text")
    raw = formdups.collapse(table(spark, d, "raw_records"), "raw_id", "payload", as_json=True)
    return bank.select(F.lit("question_bank").alias("source"), F.col("question_id").alias("id"), "copies", "forms").unionByName(
        raw.select(F.lit("raw_records").alias("source"), F.col("raw_id").alias("id"), "copies", "forms")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_passages")).select("doc_id", "passage_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "heldout_passages")
    return leakage.leak_report(leakage.leaked_passages(table(spark, d, "documents"), passages), passages)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    return spam.score_pages(table(spark, d, "documents"))


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_report(spam.score_pages(table(spark, d, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_by_dimension, p2_found, p2_survivors, p3_found, p3_redacted, p3_field, p4_found, p4_consensus, p4_raters, p4_agreement,
        p5_found, p5_report, p5_classes, p6_found, p6_collapsed, p7_found, p7_report, p8_selection, p8_shares, p9_found, p9_pages, p9_reasons,
    )
}

_FULL, _HALF = FULL.replace("'", "''"), HALF.replace("'", "''")


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\p{{C}}]+|[\s\p{{Z}}\p{{C}}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return rf"regexp_replace(lower(translate({x}, '{_FULL}', '{_HALF}')), '[\p{{P}}\p{{Z}}\p{{C}}\s]+', '', 'g')"


_PLACEHOLDERS = ", ".join(f"'{x}'" for x in survivors.POINT_PLACEHOLDERS)
_P2_RECORDS = f"""
records AS (
  SELECT DISTINCT lower({_trim("duplicate_group_id")}) AS g, question_id AS k,
    CASE regexp_replace(lower(review_status), '[\\s\\p{{Z}}\\p{{C}}]+', '', 'g') WHEN 'accepted' THEN 4 WHEN 'needs_review' THEN 3 WHEN 'needs_answer' THEN 2 WHEN 'conflict' THEN 1 ELSE 0 END AS t,
    coalesce(len(list_distinct(list_filter(list_transform(answer_points, lambda x: {_squeeze("x")}), lambda x: x NOT IN ({_PLACEHOLDERS})))), 0) AS p,
    coalesce(epoch_us(updated_at), -4611686018427387904) AS u
  FROM question_bank WHERE duplicate_group_id IS NOT NULL AND {_trim("duplicate_group_id")} <> ''
),
tops AS (SELECT g, max(t) AS t, max(p) AS p, max(u) AS u, count(DISTINCT k) AS n FROM records GROUP BY g)"""

_P6_CANONICAL = f"""
forms AS (
  SELECT 'question_bank' AS source, question_id AS id, {_squeeze("normalized_text")} AS c FROM question_bank WHERE normalized_text IS NOT NULL
  UNION ALL
  SELECT 'raw_records', raw_id, array_to_string(list_sort(list_transform(json_keys(payload), lambda k:
    {_squeeze("k")} || chr(31) || CASE json_type(payload, '$."' || k || '"') WHEN 'ARRAY'
      THEN '[' || array_to_string(list_transform(CAST(json_extract(payload, '$."' || k || '"') AS VARCHAR[]), lambda x: {_squeeze("x")}), chr(29))
      ELSE coalesce({_squeeze("json_extract_string(payload, '$.\"' || k || '\"')")}, chr(28)) END)), chr(30))
  FROM raw_records WHERE payload IS NOT NULL
)"""

#: Passages leaked, by equality of windows: 28 letters of Chinese passages, 80 of others, between stock sentences.
_P7 = """
WITH cut AS (
  SELECT passage_id, s.i AS i, regexp_replace(lower(s.x), '[^\\p{L}\\p{N}]+', '', 'g') AS q
  FROM (SELECT passage_id, unnest(list_zip(parts, range(len(parts)))) AS z FROM
    (SELECT passage_id, regexp_split_to_array(regexp_replace(text, '([。！？!?；;]|\\.( |$))', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM heldout_passages)) AS a,
    LATERAL (SELECT z[1] AS x, z[2] AS i) AS s
),
stock AS (SELECT q FROM (SELECT DISTINCT passage_id, q FROM cut WHERE q <> '') GROUP BY q
  HAVING count(*) >= greatest(4, (SELECT ceil(0.02 * count(DISTINCT passage_id)) FROM cut))),
marked AS (SELECT passage_id, i, q, q IN (SELECT q FROM stock) AS gap FROM cut WHERE q <> ''),
runs AS (SELECT *, sum(gap::INT) OVER (PARTITION BY passage_id ORDER BY i) AS run FROM marked),
seg AS (SELECT passage_id, string_agg(q, '' ORDER BY i) AS s FROM runs WHERE NOT gap GROUP BY passage_id, run),
size AS (SELECT passage_id, CASE WHEN 3 * length(regexp_replace(text, '[^\\x{3400}-\\x{9FFF}]', '', 'g')) >= length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) THEN 28 ELSE 80 END AS k FROM heldout_passages),
windows AS (SELECT DISTINCT passage_id, k, substring(s, a, k) AS w FROM (SELECT passage_id, k, s, unnest(range(1, length(s) - k + 2)) AS a FROM seg JOIN size USING (passage_id) WHERE length(s) >= k)),
docs AS (SELECT doc_id, regexp_replace(lower(translate(text, '__FULL__', '__HALF__')), '[^\\p{L}\\p{N}]+', '', 'g') AS q FROM documents WHERE text IS NOT NULL),
doc_windows AS (SELECT doc_id, k, substring(q, a, k) AS w FROM (SELECT doc_id, q, k, unnest(range(1, length(q) - k + 2)) AS a FROM docs, (VALUES (28), (80)) AS v(k) WHERE length(q) >= k))
SELECT DISTINCT doc_id, passage_id FROM doc_windows JOIN windows USING (k, w)
""".replace("__FULL__", _FULL).replace("__HALF__", _HALF)

ORACLES: dict[str, str] = {
    "p2_found": f"""WITH {_P2_RECORDS}
SELECT r.g AS duplicate_group_id, min(k) AS question_id FROM records r JOIN tops m ON r.g = m.g AND r.t = m.t AND r.p = m.p AND r.u = m.u
WHERE n >= 2 GROUP BY r.g HAVING count(DISTINCT k) = 1""",
    "p6_found": f"""WITH {_P6_CANONICAL}, heads AS (SELECT source, c, min(id) AS id_1 FROM forms GROUP BY source, c)
SELECT DISTINCT f.source, id_1, id AS id_2 FROM forms f JOIN heads h ON f.source = h.source AND f.c = h.c WHERE id <> id_1""",
    "p6_collapsed": f"""WITH {_P6_CANONICAL},
raw AS (SELECT 'question_bank' AS source, question_id AS id, normalized_text AS t FROM question_bank WHERE normalized_text IS NOT NULL UNION ALL SELECT 'raw_records', raw_id, payload FROM raw_records WHERE payload IS NOT NULL),
counts AS (SELECT source, c, min(id) AS id, count(*) AS copies FROM forms GROUP BY source, c),
distinct_forms AS (SELECT f.source, f.c, count(DISTINCT r.t) AS forms FROM (SELECT DISTINCT source, id, c FROM forms) f JOIN (SELECT DISTINCT source, id, t FROM raw) r ON f.source = r.source AND f.id = r.id GROUP BY f.source, f.c)
SELECT source, id, copies, forms FROM counts JOIN distinct_forms USING (source, c)""",
    "p7_found": _P7,
}
