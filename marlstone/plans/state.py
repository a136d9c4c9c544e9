"""Queries of learning state, over grading cases and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import state as S
from marlstone.plans.metrics import grader_sql
from marlstone.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

_SCORED = f"(SELECT *, clarity + coverage + reasoning + evidence + reflection AS score FROM (SELECT case_id, topic, answer, {grader_sql()} FROM (SELECT DISTINCT case_id, topic, answer FROM grading_cases)))"
_WEAK = "list_filter([CASE WHEN clarity < 10 THEN 'clarity' END, CASE WHEN coverage < 20 THEN 'coverage' END, CASE WHEN reasoning < 13 THEN 'reasoning' END, CASE WHEN evidence < 13 THEN 'evidence' END, CASE WHEN reflection < 10 THEN 'reflection' END], lambda x: x IS NOT NULL)"


def graded(spark: SparkSession, d: str) -> DataFrame:
    g = S.dimension_scores(table(spark, d, "grading_cases").select("case_id", "topic", "answer").distinct(), "answer")
    return g.withColumn("score", F.col("clarity") + F.col("coverage") + F.col("reasoning") + F.col("evidence") + F.col("reflection"))


@query(f"SELECT case_id, score, {_WEAK} AS weak, CASE WHEN length(answer) < 30 THEN 0.45 WHEN length(answer) < 100 THEN 0.58 ELSE 0.72 END::DOUBLE AS confidence FROM {_SCORED}")
def grade_details(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("case_id", "score", S.weak_dimensions().alias("weak"), S.confidence(F.col("answer")).alias("confidence"))


@query(f"SELECT topic, w AS weak, count(*) AS mistakes FROM (SELECT topic, unnest({_WEAK}) AS w FROM {_SCORED} WHERE score < 80) GROUP BY ALL")
def mistakes(spark: SparkSession, d: str) -> DataFrame:
    low = graded(spark, d).where(F.col("score") < S.LOW_SCORE)
    return low.select("topic", F.explode(S.weak_dimensions()).alias("weak")).groupBy("topic", "weak").agg(F.count("*").alias("mistakes"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value")


@query("""WITH a AS (SELECT user_id, event_id, value >= 50 AS passed, sum((value < 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, sum(passed::INT) OVER (PARTITION BY user_id, run ORDER BY event_id) AS x FROM a), g AS (SELECT a.user_id, a.event_id, sum(a.passed::INT) OVER (PARTITION BY a.user_id, a.run ORDER BY e.ts, e.event_id) AS in_row FROM a JOIN events e USING (event_id))
SELECT user_id, event_id, CAST(in_row AS BIGINT) AS in_row, CASE WHEN in_row >= 2 THEN 'mastered' WHEN in_row = 1 THEN 'reviewing' ELSE 'open' END AS mastery, CASE WHEN in_row >= 2 THEN 14 WHEN in_row = 1 THEN 3 ELSE 1 END AS review_days FROM g""")
def mastery_fold(spark: SparkSession, d: str) -> DataFrame:
    m = S.mastery(attempts(spark, d), "user_id", ["ts", "event_id"], F.coalesce(F.col("value") >= 50, F.lit(False)))
    return m.select("user_id", "event_id", "in_row", "mastery", "review_days")


@query("""WITH p AS (SELECT o_orderkey AS plan, CAST(o_orderkey % 14 + 1 AS INT) AS days, CAST(o_orderkey % 600 + 60 AS INT) AS minutes FROM orders)
SELECT plan, CAST(i + 1 AS INT) AS day, CASE WHEN i = days - 1 THEN 'review' WHEN i / greatest(days - 1, 1) >= 0.78 THEN 'mock' WHEN i / greatest(days - 1, 1) >= 0.45 THEN 'practice' WHEN i = 0 THEN 'diagnostic' ELSE 'study' END AS phase,
  greatest(15, minutes // days) + (i < minutes - greatest(15, minutes // days) * days)::INT AS minutes
FROM (SELECT *, unnest(range(0, days)) AS i FROM p)""")
def plan_schedule(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(k.alias("plan"), (k % 14 + 1).cast("int").alias("days"), (k % 600 + 60).cast("int").alias("minutes"))
    return S.schedule(p, "plan", "days", "minutes")


@query("SELECT l_orderkey AS plan, bool_and(l_linestatus = 'F') AS completed, count(*) AS tasks, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY l_orderkey")
def task_completion(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.every(done).alias("completed"), F.count("*").alias("tasks"), F.count(F.when(done, 1)).alias("done"))


@query("""SELECT plan, task FROM (SELECT o_custkey AS customer, o_orderkey AS plan, l_linenumber AS task, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber) AS rn
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND l_linestatus = 'O') WHERE rn = 1""")
def revision_proposal(spark: SparkSession, d: str) -> DataFrame:
    """The first pending task of each customer's latest active plan, without a window over the customer."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    t = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("task"))
    j = o.join(t, o["o_orderkey"] == t["l_orderkey"])
    return j.groupBy("o_custkey").agg(F.max_by(F.struct(F.col("o_orderkey").alias("plan"), "task"), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("x.*")


@query("""SELECT user_id, count(*) AS steps, arg_min(event_type, (ts, event_id)) AS first_step, arg_max(event_type, (ts, event_id)) AS last_step, count(DISTINCT event_type) AS kinds, max(n) FILTER (event_type IN ('purchase', 'signup', 'refund')) > 1 AS repeated_effect
FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) GROUP BY user_id""")
def tool_trace(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    effect = F.col("event_type").isin("purchase", "signup", "refund")
    return per.groupBy("user_id").agg(
        F.sum("n").alias("steps"), F.min_by("event_type", "first").alias("first_step"), F.max_by("event_type", "last").alias("last_step"), F.count("*").alias("kinds"),
        (F.max(F.when(effect, F.col("n"))) > 1).alias("repeated_effect"),
    )


@query()
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """The window is anchored at its first event: stateful, tested against a plain loop."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return S.limited(e, "user_id", "ms", 60_000, 2).select("event_id", "allowed")


@query("""WITH n AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) > 1800000000, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM n)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, count(DISTINCT event_type) AS kinds FROM s GROUP BY ALL""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(table(spark, d, "events"), "user_id", "ts", "event_type").select("user_id", "session", "events", "kinds")


@query("""SELECT rater_id AS user, count(*) AS ratings, count(DISTINCT item_id) AS items, min(rated_at) AS first_at, max(rated_at) AS last_at FROM public_human_grading GROUP BY rater_id""")
def user_export(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_human_grading").groupBy(F.col("rater_id").alias("user")).agg(F.count("*").alias("ratings"), F.countDistinct("item_id").alias("items"), F.min("rated_at").alias("first_at"), F.max("rated_at").alias("last_at"))


@query("""SELECT 'events' AS t, count(*) FILTER (user_id % 7 = 0) AS deleted, count(*) FILTER (user_id % 7 <> 0) AS kept FROM events UNION ALL SELECT 'orders', count(*) FILTER (o_custkey % 7 = 0), count(*) FILTER (o_custkey % 7 <> 0) FROM orders""")
def user_delete(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key in (("events", "user_id"), ("orders", "o_custkey")):
        gone = F.col(key) % 7 == 0
        t = table(spark, d, name).agg(F.lit(name).alias("t"), F.count(F.when(gone, 1)).alias("deleted"), F.count(F.when(~gone, 1)).alias("kept"))
        out = t if out is None else out.unionByName(t)
    return out


@query("""SELECT case_id, score FROM (SELECT * FROM """ + _SCORED + """ WHERE score < 80 ORDER BY score, case_id LIMIT 100) WHERE topic IS NOT NULL AND contains(topic, '表达')""")
def mistake_listing(spark: SparkSession, d: str) -> DataFrame:
    """The hundred worst, and of these the ones of a topic: the limit comes before the filter."""
    worst = graded(spark, d).where(F.col("score") < S.LOW_SCORE).orderBy("score", "case_id").limit(100)
    return worst.where(F.col("topic").isNotNull() & F.col("topic").contains("表达")).select("case_id", "score")


@query("""SELECT json_valid(payload) AS parsed, json_extract_string(payload, '$.task') AS task, count(*) AS records, count(*) FILTER (json_array_length(payload, '$.rubric') > 0) AS with_rubric FROM raw_records GROUP BY ALL""")
def payload_parser(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("payload", "task string, question string, answer string, rubric array<string>, rights_class string")
    t = table(spark, d, "raw_records").withColumn("p", p)
    return t.groupBy(F.col("p").isNotNull().alias("parsed"), F.col("p.task").alias("task")).agg(F.count("*").alias("records"), F.count(F.when(F.size("p.rubric") > 0, 1)).alias("with_rubric"))


@query("""SELECT item_id, count(*) AS points, count(*) FILTER (contains(candidate_answer, point)) AS grounded FROM (SELECT DISTINCT item_id, candidate_answer, unnest(reference_points) AS point FROM public_human_grading) GROUP BY item_id""")
def enrichment_grounding(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "public_human_grading").select("item_id", "candidate_answer", F.explode("reference_points").alias("point")).distinct()
    return r.groupBy("item_id").agg(F.count("*").alias("points"), F.count(F.when(F.col("candidate_answer").contains(F.col("point")), 1)).alias("grounded"))


@query("""SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 3 AS slot FROM embeddings""")
def cyclic_assignment(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.row_number().over(w) - 1).alias("i"))
    return e.withColumn("slot", F.pmod("i", F.lit(3)))
