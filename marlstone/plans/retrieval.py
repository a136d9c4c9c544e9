"""Queries of retrieval. Searches ask with every question whose number is divisible by 50, against all rows; those with
``every`` ask with all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import curation as C
from marlstone.operators import retrieval as R
from marlstone.plans.registry import Registry, table
from marlstone.session import keep

REGISTRY = Registry()
query = REGISTRY.query

ASKED = "CAST(regexp_extract(case_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0"
POLICY = {"margin": (20.0, 0.02), "coverage": (0.6, 0.5, 0.4), "composite": (0.6, 0.5, 20.0, 0.02, 0.6)}


def terms_sql(t: str) -> str:
    """Terms of lexical search of a SQL expression, repeats kept."""
    return f"""list_concat(regexp_extract_all(lower({t}), '[a-zA-Z0-9_+.-]{{2,}}'), flatten(list_transform(regexp_extract_all(lower({t}), '[一-鿿]+'), lambda r:
      list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_concat(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)),
      CASE WHEN length(r) BETWEEN 2 AND 8 THEN [r] ELSE []::VARCHAR[] END)))))"""


def cases(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    q = table(spark, d, "questions")
    q = q if every else q.where((F.regexp_extract("case_id", "([0-9]+)$", 1).cast("bigint") % 50) == 0)
    return q.select("case_id", "question", "relevant_chunk_ids", "answerable", "challenge_type").distinct()


CASES = f"cases AS (SELECT DISTINCT case_id, question, relevant_chunk_ids, answerable, challenge_type FROM questions WHERE {ASKED})"
DOC_TEXT = "concat_ws(' ', title, text)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_text() -> F.Column:
    return F.concat_ws(" ", "title", "text")


def bm25_sql(scope: str = "TRUE", k: int = 5, final: bool = True, text: str = DOC_TEXT, every: bool = False) -> str:
    body = f"""WITH {CASES.removesuffix(f" WHERE {ASKED})") + ")" if every else CASES},
docs AS (SELECT chunk_id, {terms_sql(text)} AS terms FROM documents WHERE {scope}),
sizes AS (SELECT chunk_id, len(terms) AS dl FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
asked AS (SELECT case_id, term, count(*) AS qtf FROM (SELECT case_id, unnest({terms_sql("question")}) AS term FROM cases) GROUP BY ALL),
posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
scored AS (SELECT case_id, chunk_id, sum(CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(dl, 1) / avgdl)) * (1 + ln(1 + qtf)) * 1e12 + 0.5) AS BIGINT)) AS s
  FROM asked JOIN posts USING (term) JOIN df USING (term) JOIN sizes USING (chunk_id), stats GROUP BY ALL),
ranking AS (SELECT case_id, chunk_id, round(s / 1e12, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, chunk_id) AS rank FROM scored WHERE s > 0 QUALIFY rank <= {k})"""
    return body + ("\nSELECT case_id, chunk_id, score, rank FROM ranking" if final else "")


RANKING = bm25_sql(final=False)


def ranking(spark: SparkSession, d: str, k: int = 5, scope: str | None = None, every: bool = False) -> DataFrame:
    docs = documents(spark, d)
    return R.bm25(cases(spark, d, every), docs.where(F.col("privacy_lane") == scope) if scope else docs, "case_id", "question", "chunk_id", doc_text(), k)


@query(bm25_sql(every=True))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d, every=True)


@query(bm25_sql("privacy_lane = 'generic'"))
def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d, scope="generic")


@query(f"SELECT count(*) AS n, avg(len({terms_sql(DOC_TEXT)})) AS avgdl FROM documents")
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(documents(spark, d), "chunk_id", doc_text())


@query(f"SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest({terms_sql(DOC_TEXT)}) AS term FROM documents) GROUP BY term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    p = R.postings(documents(spark, d), "chunk_id", doc_text())
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("""SELECT CASE WHEN c.chunk_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status, count(*) AS chunks
FROM (SELECT DISTINCT unnest(relevant_chunk_ids) AS chunk_id FROM answer_fixtures) w LEFT JOIN (SELECT DISTINCT chunk_id FROM documents) c USING (chunk_id) GROUP BY ALL
UNION ALL SELECT 'left', count(*) FROM documents WHERE chunk_id NOT IN (SELECT DISTINCT unnest(relevant_chunk_ids) FROM answer_fixtures)""")
def delete_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Delete the cited chunks by id: how many were there, were missing, and are left."""
    docs = documents(spark, d).select("chunk_id")
    gone = table(spark, d, "answer_fixtures").select(F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()
    known = docs.distinct().withColumn("there", F.lit(True))
    status = gone.join(known, "chunk_id", "left").groupBy(F.when(F.col("there"), "deleted").otherwise("missing").alias("status")).agg(F.count("*").alias("chunks"))
    left = docs.join(gone, "chunk_id", "left_anti").agg(F.lit("left").alias("status"), F.count("*").alias("chunks"))
    return status.unionByName(left.select("status", "chunks"))


@query(RANKING + """
SELECT c.case_id, coalesce(string_agg('[S' || rank || '] ' || regexp_extract(text, '^[^。.!?！？\\n]*[。.!?！？]?'), chr(10) ORDER BY rank), '') AS answer,
  coalesce(list(r.chunk_id ORDER BY rank) FILTER (r.chunk_id IS NOT NULL), []) AS citations, count(r.chunk_id) = 0 AS abstained
FROM cases c LEFT JOIN (SELECT * FROM ranking WHERE rank <= 3) r USING (case_id) LEFT JOIN documents d USING (chunk_id) GROUP BY c.case_id""")
def bm25_answer(spark: SparkSession, d: str) -> DataFrame:
    """Extractive answers: the first sentence of each of the best three chunks, cited; none found abstains."""
    best = ranking(spark, d).where("rank <= 3").join(documents(spark, d).select("chunk_id", "text"), "chunk_id")
    line = F.concat(F.lit("[S"), F.col("rank"), F.lit("] "), F.regexp_extract("text", r"^[^。.!?！？\n]*[。.!?！？]?", 0))
    parts = best.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "chunk_id"))).alias("p"))  # three a case
    return cases(spark, d).select("case_id").join(parts, "case_id", "left").select(
        "case_id", F.coalesce(F.array_join(F.col("p.line"), "\n"), F.lit("")).alias("answer"),
        F.coalesce(F.col("p.chunk_id"), F.array().cast("array<string>")).alias("citations"), F.col("p").isNull().alias("abstained"),
    )


@query(RANKING + """
SELECT case_id, rank, used_before, least(t, 12000 - used_before - h) AS kept_chars FROM (
  SELECT case_id, rank, h, t, CAST(coalesce(sum(h + t) OVER (PARTITION BY case_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM (
    SELECT case_id, rank, length('[S' || rank || '] ' || coalesce(title, source_id)) AS h, length(text) AS t FROM ranking JOIN documents USING (chunk_id)))
WHERE 12000 - used_before - h > 0""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    r = ranking(spark, d).join(documents(spark, d).select("chunk_id", "title", "source_id", "text"), "chunk_id")
    header = F.concat(F.lit("[S"), F.col("rank"), F.lit("] "), F.coalesce("title", "source_id"))
    return R.packed_context(r, "case_id", header, F.col("text")).select("case_id", "rank", "used_before", "kept_chars")


@query(RANKING + """, tops AS (SELECT case_id, max(score) AS score FROM ranking GROUP BY case_id)
SELECT c.case_id, coalesce(score >= 30.0, FALSE) AS allowed, CASE WHEN score IS NULL THEN 'no_documents' WHEN score >= 30.0 THEN 'passed' ELSE 'below_threshold' END AS reason FROM cases c LEFT JOIN tops USING (case_id)""")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    top = ranking(spark, d).where("rank = 1").select("case_id", "score")
    s = F.col("score")
    return cases(spark, d).select("case_id").join(top, "case_id", "left").select(
        "case_id", F.coalesce(s >= 30.0, F.lit(False)).alias("allowed"), F.when(s.isNull(), "no_documents").when(s >= 30.0, "passed").otherwise("below_threshold").alias("reason")
    )


_LEXICAL = """list_distinct(list_filter(list_concat(regexp_extract_all(replace(lower({t}), '％', '%'), '[0-9]+(\\.[0-9]+)?%|[0-9]+\\.[0-9]+|[A-Za-z0-9]+')), lambda x: x LIKE '%\\%' ESCAPE '\\' OR regexp_matches(x, '^[0-9]') OR length(x) >= 2))"""


def features(spark: SparkSession, d: str, every: bool = False, *more: str) -> DataFrame:
    """Boundary features of the cases, with their columns ``more``."""
    asked = cases(spark, d, every)
    r = R.with_queries(ranking(spark, d, every=every), asked, "case_id", "question").join(documents(spark, d).select("chunk_id", doc_text().alias("doc")), "chunk_id")
    return R.boundary_features(asked, r, "case_id", "question", "doc", more=more)


@query()
def boundary_features(spark: SparkSession, d: str) -> DataFrame:
    """Checked by tests against a plain Python version: the token pattern needs look-around, which the SQL
    engine lacks."""
    return features(spark, d, every=True)


@query()
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    f = keep(features(spark, d, every=True))  # a row a case; each policy would search again
    out = None
    for name, policy in (("margin", R.margin_policy), ("coverage", R.coverage_policy), ("composite", R.composite_policy)):
        g = R.gate(f, policy(*POLICY[name])).select("case_id", F.lit(name).alias("policy"), "allowed", "decision")
        out = g if out is None else out.unionByName(g)
    return out


_METRICS = RANKING + """,
gold AS (SELECT DISTINCT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM cases WHERE answerable),
hits AS (SELECT case_id, count(*) AS hits, min(rank) AS first, sum(CAST(1 / log2(rank + 1.0) AS DECIMAL(38,12))) AS dcg FROM ranking JOIN gold USING (case_id, chunk_id) GROUP BY case_id),
found AS (SELECT case_id, count(*) AS retrieved FROM ranking GROUP BY case_id),
per_case AS (SELECT case_id, challenge_type, answerable, n,
  CASE WHEN answerable AND n > 0 THEN coalesce(round(hits / n, 6), 0.0) ELSE 0.0 END AS recall,
  CASE WHEN answerable AND n > 0 THEN coalesce(round(1.0 / first, 6), 0.0) ELSE 0.0 END AS reciprocal_rank,
  CASE WHEN answerable AND n > 0 THEN coalesce(round(CAST(dcg AS DOUBLE) / CAST((SELECT sum(CAST(1 / log2(i + 1.0) AS DECIMAL(38,12))) FROM range(1, CAST(least(n, 5) AS BIGINT) + 1) AS r(i)) AS DOUBLE), 6), 0.0) ELSE 0.0 END AS ndcg,
  CASE WHEN NOT answerable THEN coalesce(retrieved, 0) = 0 END AS no_answer_correct
  FROM (SELECT *, len(list_distinct(relevant_chunk_ids)) AS n FROM cases) LEFT JOIN hits USING (case_id) LEFT JOIN found USING (case_id))"""
_SUMMARY = """count(*) AS query_count, count(*) FILTER (answerable) AS answerable_count,
  round(CAST(avg(CAST(recall AS DECIMAL(38,12))) FILTER (answerable) AS DOUBLE), 6) AS recall_at_k, round(CAST(avg(CAST(reciprocal_rank AS DECIMAL(38,12))) FILTER (answerable) AS DOUBLE), 6) AS mrr,
  round(CAST(avg(CAST(ndcg AS DECIMAL(38,12))) FILTER (answerable) AS DOUBLE), 6) AS ndcg_at_k, round(avg(no_answer_correct::INT) FILTER (NOT answerable), 6) AS no_answer_accuracy"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.per_case_metrics(cases(spark, d), keep(ranking(spark, d)), "case_id", "chunk_id", "relevant_chunk_ids", "answerable")


@query(_METRICS + " SELECT case_id, recall, reciprocal_rank, ndcg, no_answer_correct FROM per_case")
def retrieval_per_case(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("case_id", "recall", "reciprocal_rank", "ndcg", "no_answer_correct")


@query(_METRICS + f" SELECT {_SUMMARY} FROM per_case")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    return m.agg(*R.metric_summary(m))


@query(_METRICS + f" SELECT challenge_type, grouping(challenge_type) AS is_total, {_SUMMARY} FROM per_case GROUP BY GROUPING SETS ((challenge_type), ())")
def retrieval_metrics_by_slice(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    return m.rollup("challenge_type").agg(F.grouping("challenge_type").cast("bigint").alias("is_total"), *R.metric_summary(m))


@query(bm25_sql(final=False, every=True) + """, tops AS (SELECT answerable, coalesce(max(score), 0.0) AS s FROM cases LEFT JOIN ranking USING (case_id) GROUP BY case_id, answerable),
cand AS (SELECT 0.0::DOUBLE AS t, 0 AS strict UNION SELECT s, 0 FROM tops UNION SELECT s, 1 FROM tops),
rated AS (SELECT t, strict, avg((s > t OR (strict = 0 AND s = t))::INT) FILTER (answerable) AS recall, avg((NOT (s > t OR (strict = 0 AND s = t)))::INT) FILTER (NOT answerable) AS none FROM cand, tops GROUP BY ALL)
SELECT t AS score_threshold, strict = 1 AS strictly_above, round((recall + none) / 2, 6) AS balanced_accuracy, round(recall, 6) AS answerable_recall, round(none, 6) AS no_answer_accuracy
FROM rated ORDER BY (recall + none) / 2 DESC, recall DESC, t, strict LIMIT 1""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    top = ranking(spark, d, every=True).where("rank = 1").select("case_id", "score")
    scores = cases(spark, d, every=True).join(top, "case_id", "left").select("answerable", F.coalesce("score", F.lit(0.0)).alias("score"))
    return R.calibrated_threshold(scores, "answerable", "score")


@query(RANKING + """ SELECT (SELECT count(*) FROM cases) AS query_count, count(DISTINCT case_id) AS hit_count, count(*) / (SELECT count(*) FROM cases) AS average_selected FROM ranking""")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    found = ranking(spark, d).groupBy("case_id").agg(F.count("*").alias("n"))
    j = cases(spark, d).select("case_id").join(found, "case_id", "left")
    return j.agg(F.count("*").alias("query_count"), F.count("n").alias("hit_count"), (F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("average_selected"))


@query(f"""WITH first AS ({bm25_sql(k=20)}),
words AS (SELECT f.case_id, f.chunk_id, f.rank, list_distinct({terms_sql("question")}) AS q, list_distinct({terms_sql(DOC_TEXT)}) AS t FROM first f JOIN (SELECT DISTINCT case_id, question FROM questions) USING (case_id) JOIN documents USING (chunk_id))
SELECT case_id, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, rank) AS rank
FROM (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0.0 END AS s FROM words) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY s DESC, rank) <= 5""")
def reranked_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 documents of lexical search ordered anew by the share of the question's terms that they hold."""
    r = ranking(spark, d, 20).join(documents(spark, d).select("chunk_id", doc_text().alias("doc")), "chunk_id").join(cases(spark, d).select("case_id", "question"), "case_id")
    share = X.coverage(F.array_distinct(X.search_terms(F.col("question"))), F.array_distinct(X.search_terms(F.col("doc"))))
    scored = r.select("case_id", "chunk_id", "rank", share.alias("s"))
    return R.reranked(scored, F.col("s"), "case_id", 5).select("case_id", "chunk_id", F.round("s", 6).alias("score"), "rank")


_TOPS = ", tops AS (SELECT case_id, coalesce(max(score), 0.0) AS s FROM cases LEFT JOIN ranking USING (case_id) GROUP BY case_id), placed AS (SELECT s, row_number() OVER (ORDER BY s, case_id) - 1 AS i, count(*) OVER () AS n FROM tops)"


@query(RANKING + _TOPS + """, spots AS (SELECT DISTINCT CAST(round_even(q * (n - 1) / 10.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT n FROM placed), range(0, 11) AS r(q))
SELECT s AS threshold, lead(s) OVER (ORDER BY s) AS next_threshold, round((s + lead(s) OVER (ORDER BY s)) / 2, 9) AS midpoint FROM (SELECT DISTINCT s FROM placed JOIN spots USING (i))""")
def threshold_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a calibration: the scores at eleven empirical quantiles (index rounded half to even) of the best
    scores, distinct, with the midpoints between neighbours."""
    top = ranking(spark, d).where("rank = 1").select("case_id", "score")
    s = cases(spark, d).select("case_id").join(top, "case_id", "left").select("case_id", F.coalesce("score", F.lit(0.0)).alias("s"))
    whole = F.round(F.col("s") * 1_000_000).cast("bigint").cast("string")  # in the order of the scores, ranges of an eighth first
    digest = F.concat(F.lpad(F.hex(F.least(F.floor(F.col("s") * 8), F.lit(4095))), 3, "0"), F.lpad(whole, 18, "0"))
    placed = keep(C.global_rank(s.withColumn("digest", digest), "digest", "case_id"))
    n = placed.count()
    at = sorted({round(q * (n - 1) / 10) for q in range(11)}) if n else []
    few = placed.where((F.col("rn") - 1).isin(at)).select("s").distinct()  # eleven at most
    after = F.lead("s").over(Window.orderBy("s"))
    return few.select(F.col("s").alias("threshold"), after.alias("next_threshold"), F.round((F.col("s") + after) / 2, 9).alias("midpoint"))


_SUFFIX = " 相关 依据 方法"


@query()
def query_retry(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose best score stays below the gate are asked once more with a fixed suffix and a larger
    k; others keep their first result."""
    q = cases(spark, d, every=True)
    first = keep(ranking(spark, d, every=True))  # five rows a question; each use would search again
    same = lambda other: F.col("case_id").eqNullSafe(other["_id"])
    strong = first.where("rank = 1 and score >= 60").select(F.col("case_id").alias("_id"))
    weak = q.select("case_id", "question").join(strong, same(strong), "left_anti")
    again = weak.select("case_id", F.concat("question", F.lit(_SUFFIX)).alias("question"))
    second = R.bm25(again, documents(spark, d), "case_id", "question", "chunk_id", doc_text(), 10).withColumn("attempt", F.lit(2))
    return first.join(strong, same(strong), "left_semi").withColumn("attempt", F.lit(1)).unionByName(second)


@query("""SELECT DISTINCT case_id, chunk_id FROM (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM questions) WHERE chunk_id NOT IN (SELECT chunk_id FROM documents)""")
def missing_gold(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "questions").select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()
    return gold.join(documents(spark, d).select("chunk_id"), "chunk_id", "left_anti").select("case_id", "chunk_id")


@query("""SELECT split, source_id, count(DISTINCT case_id) AS cases FROM (SELECT case_id, lower(trim(split, E' \\t\\n\\r')) AS split, unnest(relevant_chunk_ids) AS chunk_id FROM questions) JOIN documents USING (chunk_id) GROUP BY ALL""")
def gold_families(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "questions").select("case_id", F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split"), F.explode("relevant_chunk_ids").alias("chunk_id"))
    return gold.join(documents(spark, d).select("chunk_id", "source_id"), "chunk_id").groupBy("split", "source_id").agg(F.countDistinct("case_id").alias("cases"))


@query("SELECT 'bm25' AS stage, count(*) AS queries, sum(n) AS candidates FROM (" + bm25_sql(k=1_000_000_000, final=False) + " SELECT case_id, count(*) AS n FROM ranking GROUP BY case_id)")
def stage_trace(spark: SparkSession, d: str) -> DataFrame:
    n = R.matches(cases(spark, d), documents(spark, d), "case_id", "question", "chunk_id", doc_text())
    return n.agg(F.lit("bm25").alias("stage"), F.count("*").alias("queries"), F.sum("candidates").alias("candidates")).select("stage", "queries", "candidates")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v)
SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.v, d.v), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.vec_id) AS rank
FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.dense(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding").select("query_id", "vec_id", "score", "rank")


@query(f"""WITH both_rankings AS ({bm25_sql(k=10)} UNION ALL {bm25_sql(k=10, text="text").replace("WITH ", "SELECT * FROM (WITH ", 1)})),
fused AS (SELECT case_id, chunk_id, sum(CAST(1.0::DOUBLE / (60 + rank) AS DECIMAL(38,12))) AS s FROM both_rankings GROUP BY ALL)
SELECT case_id, chunk_id, round(CAST(s AS DOUBLE), 9) AS score, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 5""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of lexical search over titles with texts and over texts alone."""
    a = ranking(spark, d, 10)
    b = R.bm25(cases(spark, d), documents(spark, d), "case_id", "question", "chunk_id", F.col("text"), 10)
    return R.reciprocal_rank_fusion([a, b], "case_id", "chunk_id")


@query("""SELECT chunk_id, row_number() OVER (ORDER BY doc_id) AS rank, round(1 - 0.01 * row_number() OVER (ORDER BY doc_id), 6) AS score FROM documents QUALIFY rank <= 5""")
def fake_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The test double: the first five documents by insertion order."""
    first = documents(spark, d).select("chunk_id", "doc_id").orderBy("doc_id").limit(5)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))
    return ranked.select("chunk_id", "rank", F.round(1 - 0.01 * F.col("rank"), 6).alias("score"))
