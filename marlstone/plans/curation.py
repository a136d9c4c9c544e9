"""Queries of similarity, duplicates, splits, checks and reports of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import arrow
from marlstone.functions import text as X
from marlstone.operators import curation as C
from marlstone.operators import similarity as S
from marlstone.plans.registry import Registry, table
from marlstone.plans.texts import template_sql
from marlstone.session import cut_table

REGISTRY = Registry()
query = REGISTRY.query


def bank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "question_bank")


_SPLIT = "lower(trim(split, E' \\t\\n\\r'))"
_REPS = "reps AS (SELECT normalized_text AS text, min(question_id) AS class FROM question_bank WHERE normalized_text IS NOT NULL GROUP BY normalized_text)"
_SHINGLES = """sets AS (SELECT class, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(31))] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], chr(31)))) END AS s
  FROM (SELECT class, regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]') AS w FROM reps)),
flat AS (SELECT class, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.class AS a, b.class AS b, count(*) AS "both", any_value(a.n) + any_value(b.n) - count(*) AS "either" FROM flat a JOIN flat b ON a.g = b.g AND a.class < b.class GROUP BY a.class, b.class HAVING count(*) * 5 >= (any_value(a.n) + any_value(b.n) - count(*)) * 4)"""


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    reps = cut_table(S.representatives(bank(spark, d), "question_id", "normalized_text"))
    return S.jaccard_join(reps.select("class", S.word_shingles(F.col("text")).alias("s")), "class", "s", 4, 5)


@query(f"""WITH {_REPS}, {_SHINGLES}, links AS (SELECT class, count(*) AS links FROM (SELECT a AS class FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY class)
SELECT DISTINCT question_id, class, coalesce(links, 0) AS links FROM question_bank JOIN reps ON normalized_text = text LEFT JOIN links USING (class)""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its class of equal texts and the number of near-same classes: five words, 0.8."""
    p = near_pairs(spark, d)
    links = p.select(F.col("a").alias("class")).unionByName(p.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    m = S.membership(bank(spark, d), "question_id", "normalized_text")
    return m.join(links, "class", "left").select("question_id", "class", F.coalesce("links", F.lit(0)).alias("links"))


@query(f'WITH {_REPS}, {_SHINGLES} SELECT a, b, "both", "either" FROM pairs')
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(spark, d).select("a", "b", "both", "either")


@query(f"""WITH RECURSIVE {_REPS}, {_SHINGLES}, edges AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT class AS v, class AS l FROM reps UNION SELECT w.v, e.y FROM walk w JOIN edges e ON w.l = e.x)
SELECT v AS class, min(l) AS component FROM walk GROUP BY v""")
def components(spark: SparkSession, d: str) -> DataFrame:
    reps = S.representatives(bank(spark, d), "question_id", "normalized_text")
    return S.components(reps, near_pairs(spark, d), "class")


@query("""WITH reps AS (SELECT answer AS text, min(case_id) AS class FROM grading_cases WHERE answer IS NOT NULL GROUP BY answer),
w AS (SELECT class, regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]') AS w FROM reps),
tf AS (SELECT class, t, count(*) AS tf FROM (SELECT class, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], chr(31)))) AS t FROM w WHERE len(w) >= 5) GROUP BY ALL),
norm AS (SELECT class, sum(tf * tf) AS n FROM tf GROUP BY class)
SELECT a.class AS a, b.class AS b, CAST(sum(a.tf * b.tf) AS BIGINT) AS dot FROM tf a JOIN tf b ON a.t = b.t AND a.class < b.class JOIN norm x ON x.class = a.class JOIN norm y ON y.class = b.class
GROUP BY a.class, b.class HAVING CAST(sum(a.tf * b.tf) AS HUGEINT) * sum(a.tf * b.tf) * 10000 >= CAST(any_value(x.n) AS HUGEINT) * any_value(y.n) * 7396""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose bags of five-word shingles have a cosine of 0.86 or more."""
    reps = S.representatives(table(spark, d, "grading_cases"), "case_id", "answer").select("class", S.words(F.col("text")).alias("w")).where(F.size("w") >= 5)
    shingle = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, 5)))
    tf = reps.select("class", F.explode(shingle).alias("t")).groupBy("class", "t").agg(F.count("*").alias("tf"))
    return S.cosine_join(tf, "class", "t", "tf", 86, 100).select("a", "b", "dot")


@query("""WITH w AS (SELECT case_id, regexp_extract_all(lower(answer), '[a-z0-9]+|[一-鿿]') AS w FROM (SELECT DISTINCT case_id, answer FROM grading_cases)),
flat AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], chr(31)))) AS s FROM w WHERE len(w) >= 12),
n AS (SELECT s, count(*) AS rows FROM flat GROUP BY s)
SELECT case_id, count(*) AS shingles, count(*) FILTER (rows > 1) AS shared, CAST(sum(rows - 1) AS BIGINT) AS partners_at_most FROM flat JOIN n USING (s) GROUP BY case_id""")
def shingle_overlap(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "grading_cases").select("case_id", "answer").distinct()
    return S.shared_shingles(g, "case_id", S.shingle_hashes(S.words(F.col("answer")), 12))


@query("""SELECT kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest FROM (
SELECT 'id' AS kind, count(*) AS n FROM question_bank GROUP BY question_id HAVING count(*) > 1 UNION ALL
SELECT 'text', count(*) FROM question_bank GROUP BY normalized_text HAVING count(*) > 1 UNION ALL
SELECT 'fingerprint', count(*) FROM question_bank WHERE content_fingerprint IS NOT NULL GROUP BY content_fingerprint HAVING count(*) > 1 UNION ALL
SELECT 'template', count(*) FROM question_bank GROUP BY """ + template_sql("canonical_text") + """ HAVING count(*) > 1) GROUP BY kind""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    b = bank(spark, d)
    kinds = {"id": F.col("question_id"), "text": F.col("normalized_text"), "fingerprint": F.col("content_fingerprint"), "template": X.template_text(F.col("canonical_text"))}
    out = None
    for kind, key in kinds.items():
        rows = b.where(key.isNotNull()) if kind == "fingerprint" else b
        n = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


@query()
def template_canonical_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of questions that agree but for numbers and ids; the canonical form needs Unicode tables."""
    q = table(spark, d, "questions").select("case_id", "question").distinct()
    return q.groupBy(arrow.template(F.col("question")).alias("template")).agg(F.count("*").alias("n"), F.min("case_id").alias("first_case")).where("n > 1")


_HASHED = "sha256('split-1' || chr(0) || source_id)"


@query(f"""WITH g AS (SELECT source_id, row_number() OVER (ORDER BY {_HASHED}, source_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source_id FROM documents)),
raw AS (SELECT DISTINCT n, n * 0.8 AS a, n * 0.1 AS b FROM g),
base AS (SELECT n, floor(a)::BIGINT AS ca, floor(b)::BIGINT AS cb, a - floor(a) AS ra, b - floor(b) AS rb FROM raw),
counted AS (SELECT n, ca + (CASE WHEN n - ca - 2 * cb > (CASE WHEN ra >= rb THEN 0 ELSE 2 END) THEN 1 ELSE 0 END) AS tr, cb + (CASE WHEN n - ca - 2 * cb > (CASE WHEN ra >= rb THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS de FROM base)
SELECT source_id, CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + de THEN 'dev' ELSE 'test' END AS split FROM g JOIN counted USING (n)""")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return C.group_split(table(spark, d, "documents"), "source_id", "split-1")


@query("SELECT question_id FROM (SELECT DISTINCT question_id FROM question_bank) ORDER BY sha256('review-1' || chr(0) || 'bank' || chr(0) || question_id), question_id LIMIT 50")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.review_sample(bank(spark, d), "question_id", "review-1", "bank", 50)


@query("""SELECT chunk_id, privacy_lane, CASE privacy_lane WHEN 'generic' THEN ((rn - 1) // 3) * 5 + [0, 1, 3][((rn - 1) % 3) + 1] ELSE ((rn - 1) // 2) * 5 + [2, 4][((rn - 1) % 2) + 1] END AS place FROM (
SELECT chunk_id, privacy_lane, row_number() OVER (PARTITION BY privacy_lane ORDER BY sha256('lanes-1' || chr(0) || chunk_id), chunk_id) AS rn FROM (SELECT DISTINCT chunk_id, privacy_lane FROM documents WHERE privacy_lane IN ('generic', 'personal')))""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    return C.interleaved(table(spark, d, "documents"), "chunk_id", "privacy_lane", "lanes-1").select("chunk_id", "privacy_lane", "place")


_RANK = "CASE lower(trim(review_status, E' \\t\\n\\r')) WHEN 'accepted' THEN 0 WHEN 'needs_answer' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'conflict' THEN 3 END"


@query(f"""SELECT privacy_lane, normalized_text, count(DISTINCT question_id) AS members, min(question_id) AS first_id, count(DISTINCT answers) AS versions,
  CASE WHEN count(DISTINCT answers) > 1 THEN 'conflict' ELSE ['accepted', 'needs_answer', 'needs_review', 'conflict'][max({_RANK}) + 1] END AS status,
  'dup_' || substring(sha256(privacy_lane || '|' || normalized_text), 1, 24) AS group_id
FROM (SELECT *, CASE WHEN len(answer_points) > 0 THEN array_to_string(answer_points, chr(31)) END AS answers FROM question_bank) GROUP BY privacy_lane, normalized_text""")
def canonicalize_questions(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.regexp_replace("review_status", r"^\s+|\s+$", ""))
    names = ["accepted", "needs_answer", "needs_review", "conflict"]
    rank = F.when(s == names[0], 0).when(s == names[1], 1).when(s == names[2], 2).when(s == names[3], 3)
    b = bank(spark, d).withColumn("answers", F.when(F.size("answer_points") > 0, F.array_join("answer_points", "\x1f"))).withColumn("rank", rank)
    g = b.groupBy("privacy_lane", "normalized_text").agg(F.countDistinct("question_id").alias("members"), F.min("question_id").alias("first_id"), F.countDistinct("answers").alias("versions"), F.max("rank").alias("r"))
    status = F.when(F.col("versions") > 1, "conflict").otherwise(F.get(F.array(*map(F.lit, names)), F.col("r")))
    return g.select("privacy_lane", "normalized_text", "members", "first_id", "versions", status.alias("status"), X.stable_id("dup_", F.col("privacy_lane"), F.col("normalized_text")).alias("group_id"))


@query("""SELECT coalesce(origin, 'all') AS origin, count(*) AS records, count(DISTINCT question_id) AS questions, count(*) FILTER (len(answer_points) > 0) AS answered,
  count(*) FILTER (review_status = 'accepted') AS accepted, count(*) FILTER (review_status IS DISTINCT FROM 'accepted') AS unresolved FROM question_bank GROUP BY GROUPING SETS ((origin), ())""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    accepted = F.coalesce(F.col("review_status") == "accepted", F.lit(False))
    return bank(spark, d).rollup("origin").agg(
        F.count("*").alias("records"), F.countDistinct("question_id").alias("questions"), F.count(F.when(F.size("answer_points") > 0, 1)).alias("answered"),
        F.count(F.when(accepted, 1)).alias("accepted"), F.count(F.when(~accepted, 1)).alias("unresolved"),
    ).withColumn("origin", F.coalesce("origin", F.lit("all")))


@query("""SELECT coalesce(r.source_id, s.source_id) AS source_id, r.source_id IS NULL AS unregistered, s.source_id IS NULL AS unused, coalesce(n, 0) AS documents, coalesce(authorities > 1, FALSE) AS mixed_authority
FROM source_registry r FULL OUTER JOIN (SELECT source_id, count(*) AS n, count(DISTINCT authority_level) AS authorities FROM documents GROUP BY source_id) s ON r.source_id = s.source_id""")
def provenance_join(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "documents").groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("authority_level").alias("authorities"), F.lit(True).alias("used"))
    known = table(spark, d, "source_registry").select("source_id", F.lit(True).alias("known"))
    j = known.join(used, "source_id", "full_outer")
    return j.select("source_id", F.col("known").isNull().alias("unregistered"), F.col("used").isNull().alias("unused"), F.coalesce("n", F.lit(0)).alias("documents"), F.coalesce(F.col("authorities") > 1, F.lit(False)).alias("mixed_authority"))


@query("SELECT count(*) AS rows, CAST(sum(CAST('0x' || substring(sha256(concat_ws('|', question_id, canonical_text)), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest FROM question_bank")
def dataset_digest(spark: SparkSession, d: str) -> DataFrame:
    return C.dataset_digest(bank(spark, d), F.concat_ws("|", "question_id", "canonical_text"))


@query(f"""SELECT reason, count(*) AS records FROM (SELECT CASE WHEN question IS NULL OR trim(question) = '' THEN 'no_question' WHEN split IS NULL THEN 'no_split' WHEN {_SPLIT} NOT IN ('train', 'dev', 'test') THEN 'bad_split'
  WHEN answerable AND len(relevant_chunk_ids) = 0 THEN 'answerable_without_gold' WHEN NOT answerable AND len(relevant_chunk_ids) > 0 THEN 'gold_without_answer' WHEN NOT answerable AND len(reference_points) > 0 THEN 'points_without_answer' ELSE 'valid' END AS reason FROM questions) GROUP BY reason""")
def record_validity(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    gold, points = F.size("relevant_chunk_ids") > 0, F.coalesce(F.size("reference_points"), F.lit(0)) > 0
    reason = (
        F.when(F.col("question").isNull() | (F.trim("question") == ""), "no_question").when(F.col("split").isNull(), "no_split").when(~s.isin("train", "dev", "test"), "bad_split")
        .when(F.col("answerable") & ~gold, "answerable_without_gold").when(~F.col("answerable") & gold, "gold_without_answer").when(~F.col("answerable") & points, "points_without_answer").otherwise("valid")
    )
    return table(spark, d, "questions").groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))


@query(f"""WITH q AS (SELECT DISTINCT case_id, question, {_SPLIT} AS split FROM questions WHERE split IS NOT NULL)
SELECT 'duplicate_id' AS category, count(*) AS findings FROM (SELECT case_id FROM q GROUP BY case_id HAVING count(*) > 1) UNION ALL
SELECT 'duplicate_content', count(*) FROM (SELECT question FROM q GROUP BY question HAVING count(DISTINCT case_id) > 1) UNION ALL
SELECT 'template', count(*) FROM (SELECT 1 FROM q GROUP BY {template_sql("question")} HAVING count(DISTINCT case_id) > 1) UNION ALL
SELECT 'cross_split', count(*) FROM (SELECT question FROM q GROUP BY question HAVING count(DISTINCT split) > 1)""")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings by category, counted by group over all splits."""
    s = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    q = table(spark, d, "questions").where("split is not null").select("case_id", "question", s.alias("split")).distinct()
    rules = {
        "duplicate_id": (F.col("case_id"), F.count("*")), "duplicate_content": (F.col("question"), F.countDistinct("case_id")),
        "template": (X.template_text(F.col("question")), F.countDistinct("case_id")), "cross_split": (F.col("question"), F.countDistinct("split")),
    }
    out = None
    for name, (key, n) in rules.items():
        found = q.groupBy(key.alias("k")).agg(n.alias("n")).where("n > 1").agg(F.lit(name).alias("category"), F.count("*").alias("findings"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"SELECT {_SPLIT} AS split, challenge_type, grouping({_SPLIT}) AS all_splits, grouping(challenge_type) AS all_types, count(*) AS cases, count(*) FILTER (answerable) AS answerable FROM questions GROUP BY CUBE ({_SPLIT}, challenge_type)")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").withColumn("split", F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")))
    return q.cube("split", "challenge_type").agg(F.grouping("split").cast("bigint").alias("all_splits"), F.grouping("challenge_type").cast("bigint").alias("all_types"), F.count("*").alias("cases"), F.count(F.when(F.col("answerable"), 1)).alias("answerable"))


_LAST = "SELECT *, row_number() OVER (PARTITION BY item_id, rater_id ORDER BY rated_at DESC, received_at DESC, clarity DESC NULLS LAST, coverage DESC NULLS LAST, reasoning DESC NULLS LAST) AS rn FROM public_human_grading"


@query(f"SELECT item_id, rater_id, rated_at, received_at FROM ({_LAST}) WHERE rn = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "public_human_grading").select("item_id", "rater_id", "rated_at", "received_at")
    return C.latest(r, ["item_id", "rater_id"], [F.col("rated_at"), F.col("received_at")])


@query("SELECT item_id, rater_id, min(received_at) AS first_received FROM public_human_grading GROUP BY ALL")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "public_human_grading").select("item_id", "rater_id", F.col("received_at").alias("first_received"))
    return C.latest(r, ["item_id", "rater_id"], [F.col("first_received")], first=True)


@query("""SELECT status, count(*) AS sources FROM (SELECT CASE WHEN b.source_id IS NULL THEN 'new' WHEN a.source_id IS NULL THEN 'removed' WHEN a.t IS NOT DISTINCT FROM b.t THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT source_id, coalesce(max(title), '') AS t FROM documents GROUP BY source_id) a FULL OUTER JOIN (SELECT source_id, coalesce(title, '') AS t FROM source_registry) b USING (source_id)) GROUP BY status""")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "documents").groupBy("source_id").agg(F.coalesce(F.max("title"), F.lit("")).alias("t"))
    before = table(spark, d, "source_registry").select("source_id", F.coalesce("title", F.lit("")).alias("t"))
    return C.changes(now, before, "source_id", "t").groupBy("status").agg(F.count("*").alias("sources"))


_KEYED = "keyed AS (SELECT privacy_lane AS lane, normalized_text AS t, min(question_id) AS class FROM question_bank WHERE normalized_text IS NOT NULL GROUP BY ALL)"


def _gram_sql(name: str, n: int) -> str:
    return f"{name} AS (SELECT lane, class, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= {n} THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - {n - 2}), lambda i: substring(t, i, {n}))) END) AS g FROM keyed), {name}_n AS (SELECT lane, class, count(*) AS n FROM {name} GROUP BY ALL)"


def _pair_sql(name: str) -> str:
    return f"{name}_p AS (SELECT a.lane, a.class AS a, b.class AS b, count(*) AS shared FROM {name} a JOIN {name} b ON a.lane = b.lane AND a.g = b.g AND a.class < b.class GROUP BY ALL)"


def similar_questions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts of one lane with three-gram similarity of 0.82 and two-gram similarity of 0.75 or more."""
    b = bank(spark, d).where("normalized_text is not null")
    reps = cut_table(b.groupBy("privacy_lane", F.col("normalized_text").alias("t")).agg(F.min("question_id").alias("class")))
    # The lane is part of each token, so texts of two lanes share none.
    tokens = F.transform(X.ngram_set(F.col("t"), 3, whole_if_short=True), lambda g: F.concat("privacy_lane", F.lit("\x1f"), g))
    sets = reps.select(F.concat_ws("\x1f", "privacy_lane", "class").alias("k"), tokens.alias("s"))
    pairs = S.jaccard_join(sets, "k", "s", 82, 100)
    texts = reps.select(F.concat_ws("\x1f", "privacy_lane", "class").alias("k"), "privacy_lane", "class", "t")
    left = texts.select(F.col("k").alias("a"), F.col("privacy_lane").alias("lane"), F.col("class").alias("class_a"), F.col("t").alias("ta"))
    right = texts.select(F.col("k").alias("b"), F.col("class").alias("class_b"), F.col("t").alias("tb"))
    grams = lambda c: X.ngram_set(F.col(c), 2, whole_if_short=True)
    two = pairs.join(left, "a").join(right, "b").withColumn("token_score", X.jaccard(grams("ta"), grams("tb"), 1.0))
    character = F.round(F.col("both") / F.col("either"), 6)
    return two.where("token_score >= 0.75").select("lane", "class_a", "class_b", "ta", "tb", character.alias("character_score"), F.round("token_score", 6).alias("token_score"))


@query(f"""WITH {_KEYED}, {_gram_sql("g3", 3)}, {_pair_sql("g3")}, {_gram_sql("g2", 2)}, {_pair_sql("g2")},
near AS (SELECT p.lane, p.a, p.b, shared / (x.n + y.n - shared) AS c FROM g3_p p JOIN g3_n x ON x.lane = p.lane AND x.class = p.a JOIN g3_n y ON y.lane = p.lane AND y.class = p.b WHERE shared * 100 >= (x.n + y.n - shared) * 82)
SELECT n.lane, n.a AS class_a, n.b AS class_b, round(c, 6) AS character_score, round(shared / (x.n + y.n - shared), 6) AS token_score
FROM near n JOIN g2_p p ON p.lane = n.lane AND p.a = n.a AND p.b = n.b JOIN g2_n x ON x.lane = n.lane AND x.class = n.a JOIN g2_n y ON y.lane = n.lane AND y.class = n.b WHERE shared / (x.n + y.n - shared) >= 0.75""")
def question_similarity(spark: SparkSession, d: str) -> DataFrame:
    return similar_questions(spark, d).select("lane", "class_a", "class_b", "character_score", "token_score")


def matched_pairs(texts: DataFrame) -> DataFrame:
    """(a, b, ratio): keys a < b of ``texts`` (k, t) whose sequence-matcher ratio is 0.92 or more, over all pairs.

    With u characters unmatched there are at most u + 1 blocks, so of the n and m bigrams (ends included) at
    least 0.38 (n + m) are shared: a Jaccard similarity of 19/31, by which candidates are joined exactly."""
    pairs = S.jaccard_join(texts.select("k", arrow.bigrams(F.col("t")).alias("s")), "k", "s", 19, 31).select("a", "b")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    return both.withColumn("ratio", arrow.ratio(F.col("ta"), F.col("tb"))).where("ratio >= 0.92").select("a", "b", "ratio")


@query()
def matcher_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Questions of any lanes whose longest matching blocks cover 92 % of both texts; the ratio has no SQL."""
    b = bank(spark, d).where("normalized_text is not null")
    reps = b.groupBy("privacy_lane", F.col("normalized_text").alias("t")).agg(F.min("question_id").alias("class"))
    keyed = cut_table(reps.select(F.concat_ws("\x1f", "privacy_lane", "class").alias("k"), "t"))
    part = lambda c, i: F.split(F.col(c), "\x1f")[i]
    return matched_pairs(keyed).select(part("a", 0).alias("lane"), part("b", 0).alias("lane_b"), part("a", 1).alias("class_a"), part("b", 1).alias("class_b"), F.round("ratio", 9).alias("ratio"))


@query("""WITH g AS (SELECT grp, row_number() OVER (ORDER BY sha256('two-way-1' || chr(0) || grp), grp) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT lower(trim(duplicate_group_id, E' \\t\\n\\r')) AS grp FROM question_bank WHERE duplicate_group_id IS NOT NULL))
SELECT grp AS group_id, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'dev' END AS split FROM g""")
def two_way_split(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups in hash order: the first fifth tests, the rest develops."""
    g = bank(spark, d).where("duplicate_group_id is not null").select(F.lower(F.regexp_replace("duplicate_group_id", r"^\s+|\s+$", "")).alias("group_id")).distinct()
    ranked = C.global_rank(g.withColumn("digest", C.hash_order("two-way-1", F.col("group_id"))), "digest", "group_id")
    n = int(ranked.count() * 0.2 + 0.5)
    return ranked.select("group_id", F.when(F.col("rn") <= n, "test").otherwise("dev").alias("split"))


@query(f"""WITH q AS (SELECT DISTINCT case_id, regexp_replace(lower(question), '\\s+', '', 'g') AS k, {_SPLIT} AS split, answerable, relevant_chunk_ids AS gold FROM questions WHERE split IS NOT NULL)
SELECT 'id_in_two_splits' AS rule, count(*) AS findings FROM (SELECT case_id FROM q GROUP BY case_id HAVING count(DISTINCT split) > 1) UNION ALL
SELECT 'same_question', count(*) FROM (SELECT k FROM q GROUP BY k HAVING count(DISTINCT case_id) > 1) UNION ALL
SELECT 'question_in_two_splits', count(*) FROM (SELECT k FROM q GROUP BY k HAVING count(DISTINCT split) > 1) UNION ALL
SELECT 'both_answerable_and_not', count(*) FROM (SELECT k FROM q GROUP BY k HAVING count(DISTINCT answerable) > 1) UNION ALL
SELECT 'same_gold', count(*) FROM (SELECT 1 FROM q WHERE answerable GROUP BY array_to_string(list_sort(gold), '|') HAVING count(DISTINCT case_id) > 1)""")
def identity_checks(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    q = table(spark, d, "questions").where("split is not null").select("case_id", F.regexp_replace(F.lower("question"), r"\s+", "").alias("k"), s.alias("split"), "answerable", F.array_join(F.array_sort("relevant_chunk_ids"), "|").alias("gold")).distinct()
    rules = {
        "id_in_two_splits": (q, "case_id", "split"), "same_question": (q, "k", "case_id"), "question_in_two_splits": (q, "k", "split"),
        "both_answerable_and_not": (q, "k", "answerable"), "same_gold": (q.where("answerable"), "gold", "case_id"),
    }
    out = None
    for name, (rows, key, of) in rules.items():
        found = rows.groupBy(key).agg(F.countDistinct(of).alias("n")).where("n > 1").agg(F.lit(name).alias("rule"), F.count("*").alias("findings"))
        out = found if out is None else out.unionByName(found)
    return out


def _grams_sql(text: str, n: int = 3) -> str:
    return f"CASE WHEN length({text}) = 0 THEN []::VARCHAR[] WHEN length({text}) <= {n} THEN [{text}] ELSE list_distinct(list_transform(range(1, length({text}) - {n - 2}), lambda i: substring({text}, i, {n}))) END"


_QUESTION = "regexp_replace(lower(question), '[^a-z0-9一-鿿]+', '', 'g')"


def _linked(keys: DataFrame, num: int, den: int, strict: bool = False) -> DataFrame:
    """(class, links): how many other texts ``t`` share more than num/den of their three-grams, by text."""
    keys = cut_table(keys)
    sets = keys.select("class", X.ngram_set(F.col("t"), 3, whole_if_short=True).alias("s"))
    p = S.jaccard_join(sets, "class", "s", num, den, strict)
    links = p.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return keys.select("class").join(links, "class", "left").select("class", F.coalesce("links", F.lit(0)).alias("links"))


def _links_sql(num: int, den: int, more: str) -> str:
    return f"""flat AS (SELECT class, len(s) AS n, unnest(s) AS g FROM (SELECT class, {_grams_sql("t")} AS s FROM reps)),
pairs AS (SELECT a.class AS a, b.class AS b, count(*) AS both, any_value(a.n) + any_value(b.n) - count(*) AS either FROM flat a JOIN flat b ON a.g = b.g AND a.class < b.class GROUP BY ALL HAVING count(*) * {den} {more} (any_value(a.n) + any_value(b.n) - count(*)) * {num}),
links AS (SELECT class, count(*) AS links FROM (SELECT a AS class FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY class)"""


@query(f"""WITH reps AS (SELECT {_QUESTION} AS t, min(case_id) AS class FROM questions WHERE question IS NOT NULL GROUP BY 1), {_links_sql(7, 10, ">")}
SELECT DISTINCT case_id, class, coalesce(links, 0) AS links FROM questions JOIN reps ON {_QUESTION} = t LEFT JOIN links USING (class)""")
def dev_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its class of equal texts and the classes whose three-gram similarity is above 0.70."""
    q = table(spark, d, "questions").where("question is not null").select("case_id", X.answer_key(F.col("question")).alias("t"))
    keys = q.groupBy("t").agg(F.min("case_id").alias("class"))
    return q.join(keys, "t").select("case_id", "class").distinct().join(_linked(keys, 7, 10, strict=True), "class").select("case_id", "class", "links")


@query(f"""WITH reps AS (SELECT {template_sql("canonical_text")} AS t, min(question_id) AS class FROM question_bank GROUP BY 1 HAVING t <> ''), {_links_sql(72, 100, ">=")}
SELECT class, coalesce(links, 0) AS links FROM reps LEFT JOIN links USING (class)""")
def template_clones(spark: SparkSession, d: str) -> DataFrame:
    """Each template of the bank, by its smallest question, with the templates whose three-gram similarity is 0.72 or more."""
    keys = bank(spark, d).groupBy(X.template_text(F.col("canonical_text")).alias("t")).agg(F.min("question_id").alias("class")).where("t <> ''")
    return _linked(keys, 72, 100)


@query(f"""WITH rows AS (SELECT DISTINCT item_id, regexp_replace(lower(candidate_answer), '[^a-z0-9一-鿿]+', '', 'g') AS a, reference_points AS p FROM public_human_grading WHERE candidate_answer IS NOT NULL),
points AS (SELECT item_id, a, regexp_replace(lower(x), '[^a-z0-9一-鿿]+', '', 'g') AS r FROM (SELECT item_id, a, unnest(p) AS x FROM rows) WHERE x IS NOT NULL),
sets AS (SELECT item_id, {_grams_sql("a")} AS sa, {_grams_sql("r")} AS sr FROM points)
SELECT item_id, count(*) AS comparisons, round(max(CASE WHEN len(sr) > 0 THEN len(list_intersect(sa, sr)) / len(sr) ELSE 0.0 END), 6) AS most_copied FROM sets GROUP BY item_id""")
def reference_copies(spark: SparkSession, d: str) -> DataFrame:
    """For each item the largest share of one of its own reference points' three-grams that a candidate answer has."""
    rows = table(spark, d, "public_human_grading").where("candidate_answer is not null").select("item_id", X.answer_key(F.col("candidate_answer")).alias("a"), "reference_points").distinct()
    points = rows.select("item_id", X.ngram_set(F.col("a"), 3, True).alias("sa"), F.explode("reference_points").alias("r")).where("r is not null")
    share = X.coverage(X.ngram_set(X.answer_key(F.col("r")), 3, True), F.col("sa"))
    return points.groupBy("item_id").agg(F.count("*").alias("comparisons"), F.round(F.max(share), 6).alias("most_copied"))


@query("""SELECT question_id, topic, canonical_text FROM (SELECT DISTINCT question_id, topic, canonical_text FROM question_bank
WHERE privacy_lane = 'generic' AND lower(trim(review_status, E' \t\n\r')) = 'accepted' AND lower(trim(difficulty, E' \t\n\r')) IN ('medium', '中等', 'hard', '困难')
AND contains(lower(coalesce(topic, '') || ' ' || canonical_text), 'rag')) ORDER BY question_id, topic, canonical_text LIMIT 20""")
def bank_selection(spark: SparkSession, d: str) -> DataFrame:
    """Accepted questions of a lane and difficulty that name a word: the first 20 by id (the limit is the feature)."""
    low = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    b = bank(spark, d).where((F.col("privacy_lane") == "generic") & (low("review_status") == "accepted") & low("difficulty").isin("medium", "中等", "hard", "困难"))
    b = b.where(F.lower(F.concat_ws(" ", F.coalesce("topic", F.lit("")), "canonical_text")).contains("rag"))
    return b.select("question_id", "topic", "canonical_text").distinct().orderBy("question_id", "topic", "canonical_text").limit(20)


def _fingerprint_sql(kind: str, parts: list[str]) -> str:
    joined = " || chr(30) || ".join(f"coalesce({p}, chr(28))" for p in parts)
    return f"sha256('{kind}' || chr(30) || {joined})"


@query(f"""WITH f AS (SELECT 'question' AS kind, case_id, {_fingerprint_sql("question", ["case_id", "question", "CAST(answerable AS VARCHAR)", "array_to_string(list_sort(relevant_chunk_ids), chr(31))"])} AS fingerprint FROM questions
UNION ALL SELECT 'answer', case_id, {_fingerprint_sql("answer", ["case_id", "question", "answer", "array_to_string(list_sort(cited_chunk_ids), chr(31))"])} FROM answer_fixtures
UNION ALL SELECT 'grading', case_id, {_fingerprint_sql("grading", ["case_id", "topic", "difficulty", "answer", "CAST(reference_score AS VARCHAR)"])} FROM grading_cases)
SELECT kind, fingerprint, min(case_id) AS case_id, count(*) AS rows FROM f GROUP BY kind, fingerprint""")
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the content of each record by its kind, in a fixed field order with arrays sorted, and its rows."""
    listed = lambda c: F.array_join(F.array_sort(c), "\x1f")
    kinds = {
        "question": ("questions", ["case_id", "question", F.col("answerable").cast("string"), listed("relevant_chunk_ids")]),
        "answer": ("answer_fixtures", ["case_id", "question", "answer", listed("cited_chunk_ids")]),
        "grading": ("grading_cases", ["case_id", "topic", "difficulty", "answer", F.col("reference_score").cast("string")]),
    }
    out = None
    for kind, (name, parts) in kinds.items():
        whole = F.concat_ws("\x1e", F.lit(kind), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\x1c")) for p in parts))
        rows = table(spark, d, name).select(F.lit(kind).alias("kind"), "case_id", F.sha2(whole, 256).alias("fingerprint"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind", "fingerprint").agg(F.min("case_id").alias("case_id"), F.count("*").alias("rows"))
