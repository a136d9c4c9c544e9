"""Queries of text features, documents and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import arrow, privacy
from marlstone.functions import text as X
from marlstone.operators import documents as D
from marlstone.plans.registry import Registry, table
from marlstone.plans.retrieval import terms_sql

REGISTRY = Registry()
query = REGISTRY.query

_STRIP = r"regexp_replace({}, '^[\s\x{{3000}}\x{{A0}}]+|[\s\x{{3000}}\x{{A0}}]+$', '', 'g')"
_NORMAL = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"SELECT doc_id, sha256({_NORMAL}) AS digest, length({_NORMAL}) AS chars FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    n = X.normalize_text(F.col("text"))
    return documents(spark, d).select("doc_id", F.sha2(n, 256).alias("digest"), F.length(n).alias("chars"))


@query(f"""SELECT doc_id, len(p) AS paragraphs, sha256(array_to_string(p, chr(31))) AS digest FROM
(SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_NORMAL}, '\\n\\s*\\n'), lambda x: {_STRIP.format("x")}), lambda x: length(x) > 0) AS p FROM documents)""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = X.paragraphs(X.normalize_text(F.col("text")))
    return documents(spark, d).select("doc_id", F.size(p).alias("paragraphs"), F.sha2(F.array_join(p, "\x1f"), 256).alias("digest"))


_PREFIX = r"^(?i)(?:(?:Q|Question|问题)\s*)?[0-9０-９一二三四五六七八九十]+[.、:：)）-]?\s*"
_QKEY = rf"lower(regexp_replace(regexp_replace(regexp_replace({_STRIP.format('canonical_text')}, '{_PREFIX}', ''), '[\s\x{{3000}}\x{{A0}}]+', '', 'g'), '[,，.。;；:：!！?？''\"“”‘’()（）\[\]【】]', '', 'g'))"


@query(f"SELECT question_id, {_QKEY} AS question_key, 'k_' || substring(sha256({_QKEY}), 1, 24) AS stable_id, count(*) AS copies FROM question_bank GROUP BY ALL")
def question_keys(spark: SparkSession, d: str) -> DataFrame:
    k = X.question_key(F.col("canonical_text"))
    return table(spark, d, "question_bank").groupBy("question_id", k.alias("question_key"), X.stable_id("k_", k).alias("stable_id")).agg(F.count("*").alias("copies"))


@query("SELECT case_id, regexp_replace(lower(answer), '[^a-z0-9一-鿿]+', '', 'g') AS answer_key, count(*) AS copies FROM answer_fixtures GROUP BY ALL")
def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "answer_fixtures").groupBy("case_id", X.answer_key(F.col("answer")).alias("answer_key")).agg(F.count("*").alias("copies"))


def template_sql(t: str) -> str:
    out = f"lower({t})"
    for p in (X.TEMPLATE_ID, X.TEMPLATE_NUMBER, X.TEMPLATE_STEP, X.TEMPLATE_PLACEHOLDER):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"regexp_replace({out}, '[^a-z0-9一-鿿]+', '', 'g')"


@query(f"SELECT template, count(*) AS answers, count(DISTINCT case_id) AS cases FROM (SELECT case_id, {template_sql('answer')} AS template FROM grading_cases) GROUP BY template")
def template_texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "grading_cases").select("case_id", X.template_text(F.col("answer")).alias("template"))
    return t.groupBy("template").agg(F.count("*").alias("answers"), F.countDistinct("case_id").alias("cases"))


@query(f"SELECT doc_id, len(t) AS terms, len(list_distinct(t)) AS kinds, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).select("doc_id", X.search_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("kinds"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query()
def boundary_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Needs look-around; tested against plain Python."""
    q = table(spark, d, "questions").select("case_id", "question").distinct()
    return q.select("case_id", F.array_sort(X.lexical_tokens(F.col("question"))).alias("lexical"), F.size(X.informative_tokens(F.col("question"))).alias("informative"))


@query()
def leakage_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Needs Unicode names; tested against plain Python."""
    t = arrow.tokens(F.col("question"))
    q = table(spark, d, "questions").select("case_id", "question").distinct().withColumn("t", t).withColumn("ok", arrow.supported(F.col("question")))
    return q.select("case_id", F.size("t").alias("tokens"), F.size(X.array_shingles(F.col("t"), 12)).alias("shingles"), "ok")


@query()
def semantic_bag(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("case_id", "question").distinct()
    return q.select(F.explode(arrow.semantic(F.col("question"))).alias("unit"), "case_id").groupBy("unit").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query("""SELECT gram, count(*) AS texts FROM (SELECT DISTINCT q, unnest(CASE WHEN length(q) <= 3 THEN CASE WHEN q = '' THEN [] ELSE [q] END ELSE list_distinct(list_transform(range(1, length(q) - 1), lambda i: substring(q, i, 3))) END) AS gram
FROM (SELECT DISTINCT normalized_text AS q FROM question_bank WHERE normalized_text IS NOT NULL)) GROUP BY gram""")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_bank").select(F.col("normalized_text").alias("q")).where("q is not null").distinct()
    return q.select(F.explode(X.ngram_set(F.col("q"), 3, whole_if_short=True)).alias("gram")).groupBy("gram").agg(F.count("*").alias("texts"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sequential; tested against plain Python and by putting pieces together again."""
    return D.chunked(documents(spark, d).select("doc_id", "text"), "doc_id", "text")


@query()
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return D.markdown_blocks(documents(spark, d), "doc_id", "text", F.coalesce("title", "chunk_id"))


@query("""WITH l AS (SELECT doc_id, i, trim(s, E' \\t\\r\\n') AS s FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS p FROM documents WHERE text LIKE '%|%')))
SELECT doc_id, CAST(i - 1 AS INT) AS line_no, trim(split_part(s, '|', 2)) AS question, trim(split_part(s, '|', 3)) AS answer FROM l
WHERE s LIKE '|%' AND NOT regexp_matches(s, '^\\|[\\s:|-]+$') AND lower(trim(split_part(s, '|', 2))) NOT IN ('题目', '问题', 'question') AND doc_id IN (SELECT doc_id FROM l WHERE i = 1 AND lower(trim(split_part(s, '|', 2))) IN ('题目', '问题', 'question'))""")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return D.table_questions(documents(spark, d), "doc_id", "text")


@query()
def extract_questions(spark: SparkSession, d: str) -> DataFrame:
    """Checked by tests on small texts."""
    q = D.line_questions(documents(spark, d), "doc_id", "text", F.coalesce("title", F.lit("")))
    return q.select("doc_id", "ordinal", "question", F.size("answers").alias("answer_lines"), X.stable_id("cand_", F.col("doc_id"), F.col("ordinal"), F.col("question")).alias("candidate_id"))


def _reason() -> F.Column:
    hits = privacy.curation_hits(F.col("text"))
    return F.when(F.length(X.strip(F.coalesce("text", F.lit("")))) == 0, "uncertain_content").when(F.size(hits) > 0, F.when(privacy.curation_unsafe(hits), "unsafe_content").otherwise("sensitive_content"))


@query()
def qa_derivation(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text").withColumn("reason", _reason())
    return D.derived(docs, "doc_id", "text", F.col("reason")).groupBy("task").agg(F.count("*").alias("samples"), F.sum(F.length("answer")).alias("chars"))


@query()
def qa_derivation_report(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy(F.coalesce(_reason(), F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("blocks"))


def _w(t: str) -> str:
    """Counts of the ingestion gate in SQL, without look-around: runs are taken whole and then checked."""
    mail = rf"len(list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+'), lambda x: regexp_matches(x, '\.[A-Za-z]{{2,}}$')))"
    phone = rf"len(list_filter(regexp_extract_all({t}, '\p{{Nd}}+'), lambda x: regexp_full_match(x, '1[3-9]\p{{Nd}}{{9}}')))"
    card = rf"len(list_filter(regexp_extract_all({t}, '\p{{Nd}}+[Xx]?'), lambda x: regexp_full_match(x, '\p{{Nd}}{{17}}[\p{{Nd}}Xx]|\p{{Nd}}{{18}}[Xx]')))"
    student = rf"len(regexp_extract_all({t}, '(?i)(?:学号|student[ _-]?id)\s*[:：=]?\s*[a-z0-9_-]{{5,32}}'))"
    name = rf"len(regexp_extract_all({t}, '(?:姓名|申请人|推荐人)\s*[:：]\s*[一-鿿·]{{2,12}}'))"
    return f"{mail} AS email, {phone} AS phone, {card} AS id_card, {student} AS student_id, {name} AS name_label"


@query(f"SELECT case_id, {_w('answer')} FROM (SELECT DISTINCT case_id, answer FROM grading_cases)")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "grading_cases").select("case_id", "answer").distinct().withColumn("c", privacy.gate_counts(F.col("answer")))
    return g.select("case_id", *(F.coalesce(F.try_element_at("c", F.lit(k)), F.lit(0)).alias(k) for k in ("email", "phone", "id_card", "student_id", "name_label")))


@query("""SELECT source, count(*) AS texts, count(*) FILTER (regexp_matches(t, '(?i)ignore\\s+(?:all\\s+)?previous\\s+instructions|reveal\\s+(?:the\\s+)?system\\s+prompt|忽略(?:以上|之前|所有)指令|泄露(?:系统提示|密钥|其他用户)|执行(?:命令|删除工具|任意工具)')) AS injected
FROM (SELECT 'documents' AS source, text AS t FROM documents UNION ALL SELECT 'answer_fixtures', answer FROM answer_fixtures) GROUP BY source""")
def injection_scan(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).select(F.lit("documents").alias("source"), F.col("text").alias("t")).unionByName(table(spark, d, "answer_fixtures").select(F.lit("answer_fixtures").alias("source"), F.col("answer").alias("t")))
    return t.groupBy("source").agg(F.count("*").alias("texts"), F.count(F.when(privacy.injected(F.col("t")), 1)).alias("injected"))


@query(f"""SELECT declared, public_mode, CASE WHEN public_mode AND (top > 0) THEN 'reject' WHEN top = 3 THEN 'reject' WHEN top = 2 THEN 'confirm' ELSE 'accept' END AS decision, count(*) AS texts FROM (
  SELECT declared, public_mode, greatest(CASE declared WHEN 'low' THEN 1 ELSE 0 END, CASE WHEN id_card > 0 THEN 3 WHEN email + phone + student_id + name_label > 0 THEN 2 ELSE 0 END) AS top
  FROM (SELECT difficulty, {_w('answer')} FROM (SELECT DISTINCT case_id, difficulty, answer FROM grading_cases)), (VALUES ('public'), ('low')) AS v(declared), (VALUES (TRUE), (FALSE)) AS m(public_mode)) GROUP BY ALL""")
def ingestion_decision(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "grading_cases").select("case_id", "difficulty", "answer").distinct()
    suggested = privacy.recommended(privacy.gate_counts(F.col("answer")), F.array().cast("array<string>"))
    g = g.select(suggested.alias("s"), privacy.injected(F.col("answer")).alias("i"), F.explode(F.array(F.lit("public"), F.lit("low"))).alias("declared"))
    both = [g.select("declared", F.lit(m).alias("public_mode"), privacy.ingestion_decision(F.col("declared"), F.col("s"), F.col("i"), m).alias("decision")) for m in (True, False)]
    return both[0].unionByName(both[1]).groupBy("declared", "public_mode", "decision").agg(F.count("*").alias("texts"))


@query()
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Needs look-around; tested on small texts."""
    g = table(spark, d, "grading_cases").select("case_id", "answer").distinct()
    r = privacy.redact(F.col("answer"))
    return g.select("case_id", r.alias("redacted"), (r != F.col("answer")).alias("changed"))


@query("SELECT doc_id, replace(replace(text, 'Agent', '[REDACTED]'), '评审老师', '[REDACTED]') AS clean FROM documents")
def identity_terms(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", privacy.replace_terms(F.col("text"), ["Agent", "评审老师", "x"]).alias("clean"))


@query()
def sensitive_scan(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "grading_cases").select("case_id", "answer").distinct().withColumn("h", privacy.curation_hits(F.col("answer")))
    return g.select(F.explode_outer("h").alias("category"), privacy.curation_unsafe(F.col("h")).alias("unsafe")).groupBy("category", "unsafe").agg(F.count("*").alias("texts"))


@query()
def anonymize(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "grading_cases").select("case_id", "answer").distinct()
    return privacy.anonymized(g, "answer").select("case_id", "anonymized")


@query(r"""SELECT sum(len(regexp_extract_all(text, '(?i)(?:[A-Z]:[\\/](?:Users|home)[\\/]|/(?:home|Users)/)[^\s"'']+')) + len(regexp_extract_all(text, '(?i)(?:access[_-]?token|api[_-]?key|password)')) + len(regexp_extract_all(text, '[^\s@]+@[^\s@]+\.[^\s@]+'))) AS findings, count(*) AS assets FROM documents""")
def public_asset_scan(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).agg(F.sum(privacy.asset_findings(F.col("text"))).alias("findings"), F.count("*").alias("assets"))


@query("SELECT case_id, length(question) AS length, substring(sha256(question), 1, 16) AS digest FROM (SELECT DISTINCT case_id, question FROM questions)")
def input_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("case_id", "question").distinct().select("case_id", privacy.summary(F.col("question")).alias("s")).select("case_id", "s.*")


# Keyword rules of the intent router, of the taxonomy and of the topic category, in order.
INTENTS = {"plan": "计划|plan", "practice": "练习|题目|practice", "grade": "批改|评分|grade", "redo": "重做|重答|redo", "mistakes": "错题|mistake", "revision": "确认调整|revision"}
TAXONOMY = {
    "english_expression": "english|英文|英语", "application_decision": "申请|导师|联系|选择|offer|时间管理|夏令营|预推免",
    "pressure_followup": "压力|质疑|冲突|责任|困难|失败|不会|追问", "self_intro_story": "自我介绍|动机|优势|未来规划|个人成长|专业选择",
    "project_research": "项目|科研|研究|实验|创新|复现|基线|消融|贡献",
}
CATEGORY = {"technical": "agent|rag|检索|模型|算法", "interview": "自我介绍|面试|表达|项目"}


def _first_rule(text: F.Column, rules: dict[str, str], default: str) -> F.Column:
    out = None
    for name, pattern in rules.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def _rule_sql(text: str, rules: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules.items()) + f" ELSE '{default}' END"


_SEARCHABLE = "lower(concat_ws(' ', topic, direction, canonical_text, normalized_text))"


@query(f"SELECT {_rule_sql('lower(question)', INTENTS, 'ask')} AS intent, count(*) AS questions FROM questions GROUP BY intent")
def intent_router(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").groupBy(_first_rule(F.lower("question"), INTENTS, "ask").alias("intent")).agg(F.count("*").alias("questions"))


@query(f"SELECT {_rule_sql(_SEARCHABLE, TAXONOMY, 'professional_explanation')} AS taxonomy, privacy_lane, count(*) AS records FROM question_bank WHERE review_status = 'accepted' GROUP BY ALL")
def taxonomy_profile(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "topic", "direction", "canonical_text", "normalized_text"))
    b = table(spark, d, "question_bank").where("review_status = 'accepted'")
    return b.groupBy(_first_rule(text, TAXONOMY, "professional_explanation").alias("taxonomy"), "privacy_lane").agg(F.count("*").alias("records"))


@query(f"SELECT topic, {_rule_sql('lower(topic)', CATEGORY, 'general')} AS category, count(*) AS records FROM question_bank WHERE topic IS NOT NULL GROUP BY ALL")
def topic_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "question_bank").where("topic is not null").groupBy("topic", _first_rule(F.lower("topic"), CATEGORY, "general").alias("category")).agg(F.count("*").alias("records"))
