"""Queries of metrics and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import metrics as M
from marlstone.plans import retrieval as P
from marlstone.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Grading cases with the mark of the deterministic grader."""
    from marlstone.operators.state import dimension_scores

    g = table(spark, d, "grading_cases").select("case_id", "difficulty", "reference_score", "answer").distinct()
    return dimension_scores(g, "answer").withColumn("observed", F.col("clarity") + F.col("coverage") + F.col("reasoning") + F.col("evidence") + F.col("reflection"))


def _count_sql(t: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({t}, '{w}')::INT" for w in words) + ")"


CLARITY, REASONING = ("结论", "首先", "我认为", "核心", "总体"), ("因为", "因此", "方法", "原理", "步骤", "流程", "选择", "判断")
EVIDENCE, REFLECTION = ("例如", "比如", "结果", "数据", "提升", "降低", "负责", "实现", "%"), ("不足", "局限", "风险", "改进", "下一步", "反思", "如果")


def grader_sql(t: str = "answer") -> str:
    e = f"({_count_sql(t, EVIDENCE)} + regexp_matches({t}, '\\p{{Nd}}')::INT)"
    return f"""CASE WHEN length({t}) >= 80 AND {_count_sql(f'substring({t}, 1, 80)', CLARITY)} > 0 THEN 15 WHEN length({t}) >= 45 THEN 10 WHEN length({t}) >= 20 THEN 5 ELSE 2 END AS clarity,
  CASE WHEN length({t}) >= 220 THEN 30 WHEN length({t}) >= 140 THEN 24 WHEN length({t}) >= 80 THEN 18 WHEN length({t}) >= 35 THEN 10 ELSE 4 END AS coverage,
  CASE WHEN {_count_sql(t, REASONING)} >= 3 THEN 20 WHEN {_count_sql(t, REASONING)} = 2 THEN 15 WHEN {_count_sql(t, REASONING)} = 1 THEN 9 ELSE 3 END AS reasoning,
  CASE WHEN {e} >= 3 THEN 20 WHEN {e} = 2 THEN 14 WHEN {e} = 1 THEN 8 ELSE 2 END AS evidence,
  CASE WHEN {_count_sql(t, REFLECTION)} >= 2 THEN 15 WHEN {_count_sql(t, REFLECTION)} = 1 THEN 9 ELSE 2 END AS reflection"""


_GRADED = f"graded AS (SELECT *, clarity + coverage + reasoning + evidence + reflection AS observed FROM (SELECT *, {grader_sql()} FROM (SELECT DISTINCT case_id, difficulty, reference_score, answer FROM grading_cases)))"
_BAND = "CASE WHEN {0} < 60 THEN 0 WHEN {0} < 80 THEN 1 WHEN {0} IS NOT NULL THEN 2 END"


@query(f"WITH {_GRADED} SELECT case_id, clarity, coverage, reasoning, evidence, reflection, observed FROM graded")
def grader_scores(spark: SparkSession, d: str) -> DataFrame:
    return answer_scores(spark, d).select("case_id", "clarity", "coverage", "reasoning", "evidence", "reflection", "observed")


_METRICS = f"""count(*) FILTER (reference_score IS NOT NULL) AS count, round(avg(abs(observed - reference_score)), 4) AS mean_absolute_error, round(avg(observed - reference_score), 4) AS mean_signed_error,
  round(avg((abs(observed - reference_score) <= 10)::INT), 4) AS within_10_accuracy, round(avg(CASE WHEN reference_score IS NOT NULL THEN ({_BAND.format('reference_score')} = {_BAND.format('observed')})::INT END), 4) AS band_accuracy"""


@query(f"WITH {_GRADED} SELECT {_METRICS} FROM graded")
def score_metrics(spark: SparkSession, d: str) -> DataFrame:
    return answer_scores(spark, d).agg(*M.score_metrics(F.col("reference_score"), F.col("observed")))


@query(f"WITH {_GRADED} SELECT lower(trim(difficulty, E' \\t\\n\\r')) AS difficulty, {_METRICS} FROM graded GROUP BY ALL")
def grading_report(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.regexp_replace("difficulty", r"^\s+|\s+$", ""))
    return answer_scores(spark, d).groupBy(s.alias("difficulty")).agg(*M.score_metrics(F.col("reference_score"), F.col("observed")))


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Latest complete ratings within their scales, with the total mark."""
    dims = {"clarity": 15, "coverage": 30, "reasoning": 20, "evidence": 20, "reflection": 15}
    g = table(spark, d, "public_human_grading").select("item_id", "rater_id", "category", *dims, "rated_at", "received_at")
    w = Window.partitionBy("item_id", "rater_id").orderBy(F.col("rated_at").desc(), F.col("received_at").desc(), *(F.col(c).desc_nulls_last() for c in dims))
    ok = None
    for c, top in dims.items():
        e = F.col(c).between(0, top)
        ok = e if ok is None else ok & e
    g = g.withColumn("rn", F.row_number().over(w)).where("rn = 1").where(ok)
    return g.withColumn("total", F.col("clarity") + F.col("coverage") + F.col("reasoning") + F.col("evidence") + F.col("reflection")).drop("rn")


_TOTALS = """totals AS (SELECT *, clarity + coverage + reasoning + evidence + reflection AS total FROM (SELECT *, row_number() OVER (PARTITION BY item_id, rater_id ORDER BY rated_at DESC, received_at DESC, clarity DESC NULLS LAST, coverage DESC NULLS LAST, reasoning DESC NULLS LAST, evidence DESC NULLS LAST, reflection DESC NULLS LAST) AS rn FROM public_human_grading)
  WHERE rn = 1 AND clarity BETWEEN 0 AND 15 AND coverage BETWEEN 0 AND 30 AND reasoning BETWEEN 0 AND 20 AND evidence BETWEEN 0 AND 20 AND reflection BETWEEN 0 AND 15),
pairs AS (SELECT a.rater_id AS rater_a, b.rater_id AS rater_b, a.item_id, a.category, a.total AS x, b.total AS y FROM totals a JOIN totals b ON a.item_id = b.item_id AND a.rater_id < b.rater_id)"""
_SUMS = f"""sums AS (SELECT rater_a, rater_b, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x*x)::DOUBLE AS sxx, sum(y*y)::DOUBLE AS syy, sum(x*y)::DOUBLE AS sxy, sum(abs(x-y))::DOUBLE AS sd, count(*) FILTER (abs(x-y) <= 10)::DOUBLE AS near,
  count(*) FILTER ({_BAND.format('x')} = {_BAND.format('y')})::DOUBLE AS same, count(*) FILTER (x = y)::DOUBLE AS equal,
  {', '.join(f"count(*) FILTER ({_BAND.format(v)} = {i})::DOUBLE AS {v}{i}" for v in 'xy' for i in range(3))} FROM pairs GROUP BY ALL),
measured AS (SELECT *, same / n AS o, (x0*y0 + x1*y1 + x2*y2) / (n*n) AS e, (sxx + syy - 2*sxy) / n AS apart, sxx/n + syy/n - 2*(sx/n)*(sy/n) AS chance, n*sxx - sx*sx AS vx, n*syy - sy*sy AS vy FROM sums),
agreed AS (SELECT rater_a, rater_b, n::BIGINT AS items, sd/n AS mean_absolute_difference, near/n AS within_10, o AS band_agreement,
  CASE WHEN abs(e - 1) < 1e-9 THEN CASE WHEN abs(o - 1) < 1e-9 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END AS cohen_kappa,
  CASE WHEN chance < 1e-9 THEN CASE WHEN apart < 1e-9 THEN 1.0 ELSE 0.0 END ELSE 1 - apart / chance END AS quadratic_weighted_kappa,
  CASE WHEN vx = 0 OR vy = 0 THEN CASE WHEN equal = n THEN 1.0 ELSE 0.0 END ELSE (n*sxy - sx*sy) / (sqrt(vx) * sqrt(vy)) END AS pearson FROM measured)"""


@query(f"WITH {_TOTALS}, {_SUMS} SELECT rater_a, rater_b, items, round(mean_absolute_difference, 9) AS mean_absolute_difference, round(within_10, 9) AS within_10, round(band_agreement, 9) AS band_agreement, round(cohen_kappa, 9) AS cohen_kappa, round(quadratic_weighted_kappa, 9) AS quadratic_weighted_kappa, round(pearson, 9) AS pearson FROM agreed")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    return M.pairwise_agreement(totals(spark, d), "item_id", "rater_id", "total")


@query(f"WITH {_TOTALS}, {_SUMS} SELECT count(*) AS pairs, " + ", ".join(f"round(avg(round({c}, 9)::DECIMAL(38,12))::DOUBLE, 4) AS {c}" for c in ("mean_absolute_difference", "within_10", "band_agreement", "cohen_kappa", "quadratic_weighted_kappa", "pearson")) + " FROM agreed")
def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    a = M.pairwise_agreement(totals(spark, d), "item_id", "rater_id", "total")
    names = ["mean_absolute_difference", "within_10", "band_agreement", "cohen_kappa", "quadratic_weighted_kappa", "pearson"]
    return a.agg(F.count("*").alias("pairs"), *(F.round(M.mean(F.col(c)), 4).alias(c) for c in names))


_DIMS = ("clarity", "coverage", "reasoning", "evidence", "reflection")


@query(f"""WITH {_TOTALS}, long AS (UNPIVOT (SELECT item_id, rater_id, category, {', '.join(_DIMS)} FROM totals) ON {', '.join(_DIMS)} INTO NAME dimension VALUE mark)
SELECT a.category, a.dimension, grouping(a.category) AS all_categories, count(*) AS pairs, round(avg(abs(a.mark - b.mark)), 9) AS mean_absolute_difference
FROM long a JOIN long b ON a.item_id = b.item_id AND a.dimension = b.dimension AND a.rater_id < b.rater_id GROUP BY GROUPING SETS ((a.category, a.dimension), (a.dimension))""")
def agreement_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the five dimensions pooled over all pairs of raters, by category and in total."""
    t = totals(spark, d)
    a = t.select("item_id", F.col("rater_id").alias("ra"), "category", *(F.col(c).alias(f"a_{c}") for c in _DIMS))
    b = t.select("item_id", F.col("rater_id").alias("rb"), *(F.col(c).alias(f"b_{c}") for c in _DIMS))
    # One join for all dimensions; the five differences are unpivoted after it.
    gaps = F.array(*(F.struct(F.lit(c).alias("dimension"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("gap")) for c in _DIMS))
    p = a.join(b, "item_id").where("ra < rb").select("category", F.explode(gaps).alias("g")).select("category", "g.*")
    sums = p.groupBy("category", "dimension").agg(F.count("*").alias("pairs"), F.sum("gap").alias("gap"))
    grouped = sums.groupingSets([("category", "dimension"), ("dimension",)], "category", "dimension").agg(F.grouping("category").cast("bigint").alias("all_categories"), F.sum("pairs").alias("pairs"), F.sum("gap").alias("gap"))
    return grouped.select("category", "dimension", "all_categories", "pairs", F.round(F.col("gap") / F.col("pairs"), 9).alias("mean_absolute_difference"))


_ABSTAIN = "无法回答|不足以|查不到|没有找到|cannot answer|must decline|not enough"


@query(f"""WITH a AS (SELECT DISTINCT case_id, dimension, answerable, relevant_chunk_ids, coalesce(cited_chunk_ids, []) AS cited_chunk_ids, answer, coalesce(abstained, FALSE) AS abstained FROM answer_fixtures WHERE answer IS NOT NULL),
m AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[S([0-9]+)\\]', 1), lambda x: x::INT) AS marks, abstained OR regexp_matches(answer, '{_ABSTAIN}') AS declines FROM a),
v AS (SELECT *, list_filter(marks, lambda i: i >= 1 AND i <= len(cited_chunk_ids)) AS valid FROM m),
c AS (SELECT *, len(list_intersect(list_distinct(relevant_chunk_ids), list_distinct(list_transform(valid, lambda i: cited_chunk_ids[i])))) AS hit, len(list_distinct(relevant_chunk_ids)) AS gold FROM v)
SELECT dimension, count(*) AS answers, round(avg(CASE WHEN answerable AND gold > 0 THEN (hit / gold)::DECIMAL(38,12) END)::DOUBLE, 6) AS citation_recall, round(avg(CASE WHEN answerable THEN coalesce((hit / nullif(len(marks), 0))::DECIMAL(38,12), 0) END)::DOUBLE, 6) AS citation_precision,
  round(avg(CASE WHEN answerable THEN coalesce((len(valid) / nullif(len(marks), 0))::DECIMAL(38,12), 0) END)::DOUBLE, 6) AS marker_validity, round(avg(CASE WHEN answerable THEN (NOT declines)::INT END), 6) AS response_rate,
  round(avg(CASE WHEN NOT answerable THEN (declines AND len(valid) = 0)::INT END), 6) AS no_answer_accuracy FROM c GROUP BY dimension""")
def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Citations and abstention of answers; precision counts markers, not distinct chunks."""
    a = table(spark, d, "answer_fixtures").where("answer is not null").select(
        "case_id", "dimension", "answerable", "relevant_chunk_ids", F.coalesce("cited_chunk_ids", F.array().cast("array<string>")).alias("cited"), "answer", F.coalesce("abstained", F.lit(False)).alias("abstained")
    ).distinct()
    a = a.withColumn("marks", F.transform(F.regexp_extract_all("answer", F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    a = a.withColumn("valid", F.filter("marks", lambda i: (i >= 1) & (i <= F.size("cited"))))
    a = a.withColumn("ids", F.array_distinct(F.transform("valid", lambda i: F.get("cited", i - 1)))).withColumn("gold", F.size(F.array_distinct("relevant_chunk_ids")))
    hit, n = F.size(F.array_intersect("relevant_chunk_ids", "ids")), F.size("marks")
    declines = F.col("abstained") | F.col("answer").rlike(_ABSTAIN)
    yes, no = F.col("answerable"), ~F.col("answerable")
    part = lambda top, of: F.coalesce(F.try_divide(top, of), F.lit(0.0))
    return a.groupBy("dimension").agg(
        F.count("*").alias("answers"), F.round(M.mean(F.when(yes & (F.col("gold") > 0), hit / F.col("gold"))), 6).alias("citation_recall"), F.round(M.mean(F.when(yes, part(hit, n))), 6).alias("citation_precision"),
        F.round(M.mean(F.when(yes, part(F.size("valid"), n))), 6).alias("marker_validity"), F.round(M.mean(F.when(yes, (~declines).cast("int"))), 6).alias("response_rate"),
        F.round(M.mean(F.when(no, (declines & (F.size("valid") == 0)).cast("int"))), 6).alias("no_answer_accuracy"),
    )


@query("""WITH p AS (SELECT q.case_id, regexp_replace(lower(a.answer), '[^a-z0-9一-鿿]+', '', 'g') AS a, unnest(reference_points) AS point FROM (SELECT DISTINCT case_id, answer FROM grading_cases) a JOIN (SELECT DISTINCT case_id, reference_points FROM questions) q
  ON regexp_extract(a.case_id, '([0-9]+)$', 1) = regexp_extract(q.case_id, '([0-9]+)$', 1))
SELECT case_id, count(*) AS points, count(*) FILTER (contains(a, regexp_replace(lower(point), '[^a-z0-9一-鿿]+', '', 'g'))) AS covered FROM p GROUP BY case_id""")
def point_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reference points of a question that are in the answer of the grading case of the same number."""
    no = F.regexp_extract("case_id", "([0-9]+)$", 1)
    a = table(spark, d, "grading_cases").select("case_id", "answer").distinct().select(no.alias("no"), X.answer_key(F.col("answer")).alias("a"))
    q = table(spark, d, "questions").select("case_id", "reference_points").distinct().select("case_id", no.alias("no"), F.explode("reference_points").alias("point"))
    return a.join(q, "no").groupBy("case_id").agg(F.count("*").alias("points"), F.count(F.when(F.col("a").contains(X.answer_key(F.col("point"))), 1)).alias("covered"))


@query("SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_disc(value, 0.95) AS p95_rank FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated percentiles, and the 95th by nearest rank."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_rank"))


@query("""SELECT event_type, count(*) AS runs, round(avg((value > 50)::INT), 6) AS success_rate, round(coalesce(avg(CASE WHEN user_id % 10 = 0 THEN (value > 50)::INT END), 1.0), 6) AS recovery_rate, bool_and(value >= 0) AS supported, round(quantile_cont(value, 0.5), 9) AS p50 FROM events GROUP BY event_type""")
def business_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates by engine (event type): nulls excluded, recovery only over recovery rows, empty rates 1."""
    ok = (F.col("value") > 50).cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("runs"), F.round(F.avg(ok), 6).alias("success_rate"), F.round(F.coalesce(F.avg(F.when(F.col("user_id") % 10 == 0, ok)), F.lit(1.0)), 6).alias("recovery_rate"),
        F.every(F.col("value") >= 0).alias("supported"), F.round(F.percentile("value", 0.5), 9).alias("p50"),
    )


@query("""WITH m AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, avg(value::DECIMAL(38,12))::DOUBLE AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, max(v) FILTER (arm = 'control') AS control, max(v) FILTER (arm = 'treatment') AS treatment, round(max(v) FILTER (arm = 'treatment') - max(v) FILTER (arm = 'control'), 6) + 0.0 AS delta FROM m GROUP BY event_type""")
def ab_delta(spark: SparkSession, d: str) -> DataFrame:
    arm = F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment")
    m = table(spark, d, "events").withColumn("arm", arm).groupBy("event_type").pivot("arm", ["control", "treatment"]).agg(M.mean(F.col("value")))
    return m.select("event_type", "control", "treatment", (F.round(F.col("treatment") - F.col("control"), 6) + 0.0).alias("delta"))


@query(P.RANKING + """, tops AS (SELECT case_id, max(score) AS s FROM ranking GROUP BY case_id), o AS (SELECT answerable, challenge_type, coalesce(s, 0) >= 60 AS allowed FROM cases LEFT JOIN tops USING (case_id)),
g AS (SELECT challenge_type, avg(allowed::INT) FILTER (answerable) AS r FROM o GROUP BY challenge_type)
SELECT round(avg(allowed::INT), 6) AS response_rate, round(avg(allowed::INT) FILTER (answerable), 6) AS answerable_response, round(avg((NOT allowed)::INT) FILTER (NOT answerable), 6) AS no_answer_accuracy,
  round((avg(allowed::INT) FILTER (answerable) + avg((NOT allowed)::INT) FILTER (NOT answerable)) / 2, 6) AS balanced_accuracy, round((SELECT max(abs(r - (SELECT avg(allowed::INT) FILTER (answerable) FROM o))) FROM g), 6) AS worst_gap FROM o""")
def boundary_metrics(spark: SparkSession, d: str) -> DataFrame:
    top = P.ranking(spark, d).where("rank = 1").select("case_id", "score")
    o = P.cases(spark, d).join(top, "case_id", "left").select("answerable", "challenge_type", (F.coalesce("score", F.lit(0.0)) >= 60).cast("int").alias("allowed"))
    yes, no = F.when(F.col("answerable"), F.col("allowed")), F.when(~F.col("answerable"), 1 - F.col("allowed"))
    g = o.groupBy("challenge_type").agg(F.avg(yes).alias("r"))
    t = o.agg(F.avg("allowed").alias("a"), F.avg(yes).alias("y"), F.avg(no).alias("n"))
    worst = g.crossJoin(F.broadcast(t)).agg(F.max(F.abs(F.col("r") - F.col("y"))).alias("w"))  # challenge types with one row
    r6 = lambda c: F.round(c, 6)
    return t.crossJoin(F.broadcast(worst)).select(r6(F.col("a")).alias("response_rate"), r6(F.col("y")).alias("answerable_response"), r6(F.col("n")).alias("no_answer_accuracy"), r6((F.col("y") + F.col("n")) / 2).alias("balanced_accuracy"), r6(F.col("w")).alias("worst_gap"))


@query()
def gate_grid(spark: SparkSession, d: str) -> DataFrame:
    f = P.features(spark, d, True, "answerable")
    axes = {"top1_score": [0, 40, 80, 120], "normalized_margin": [0.0, 0.01, 0.05, 0.1], "union_coverage": [0.0, 0.3, 0.5, 0.7, 0.9]}
    return M.grid_search(f, "answerable", axes, 0.8)


@query("""WITH v AS (SELECT user_id, event_type, value FROM events), cells AS (SELECT user_id % 3 = 0 AS y, (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS l, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT t, coalesce(sum(n) FILTER (y AND l >= i), 0) / sum(n) FILTER (y) AS recall, coalesce(sum(n) FILTER (NOT y AND l < i), 0) / sum(n) FILTER (NOT y) AS none FROM (VALUES (1, 10.0::DOUBLE), (2, 50.0), (3, 100.0)) AS k(i, t), cells GROUP BY t)
SELECT t AS value, recall, none AS no_answer_accuracy, (recall + none) / 2 AS balanced FROM g WHERE recall >= 0.1 ORDER BY balanced DESC, recall DESC, t LIMIT 1""")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 3 == 0).alias("y"), "value")
    return M.grid_search(e, "y", {"value": [10, 50, 100]}, 0.1)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Statistical; tests compare it with the normal interval."""
    return M.bootstrap_interval(table(spark, d, "events"), "user_id", "value")


@query("SELECT event_type || '/' || (user_id % 4) AS key, count(*) AS requests FROM events GROUP BY key")
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.concat("event_type", F.lit("/"), F.col("user_id") % 4).alias("key")).agg(F.count("*").alias("requests"))


@query("""SELECT asset, count(*) AS cases, count(DISTINCT id) AS unique_cases FROM (SELECT 'questions' AS asset, case_id AS id FROM questions UNION ALL SELECT 'answers', case_id FROM answer_fixtures UNION ALL SELECT 'grading', case_id FROM grading_cases UNION ALL SELECT 'bank', question_id FROM question_bank) GROUP BY asset""")
def portfolio_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for asset, name, key in (("questions", "questions", "case_id"), ("answers", "answer_fixtures", "case_id"), ("grading", "grading_cases", "case_id"), ("bank", "question_bank", "question_id")):
        t = table(spark, d, name).agg(F.lit(asset).alias("asset"), F.count("*").alias("cases"), F.countDistinct(key).alias("unique_cases"))
        out = t if out is None else out.unionByName(t)
    return out




@query()
def logistic_gate(spark: SparkSession, d: str) -> DataFrame:
    """A logistic gate over the boundary features: for each strength of regularisation the out-of-fold balanced
    accuracy over five folds by hash. Iterative, so without SQL."""
    f = P.features(spark, d).join(P.cases(spark, d).select("case_id", "answerable"), "case_id")
    names = ["top1_score", "normalized_margin", "max_document_coverage", "union_coverage", "anchor_coverage"]
    rows = f.where("reason is null").select(F.col("answerable").alias("y"), *names, F.pmod(F.xxhash64("case_id"), F.lit(5)).alias("fold"))
    return M.logistic_folds(rows, "y", names, "fold", (0.01, 0.1, 1.0, 10.0))
