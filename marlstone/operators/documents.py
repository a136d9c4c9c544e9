"""From files and texts to blocks, chunks and question candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import arrow
from marlstone.functions import text as X

CHUNKER_VERSION = "chunks-v1"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
# Words that mark questions and contexts with questions, and headers of question tables.
QUESTION_WORDS = ("什么", "如何", "为什么", "是否", "请", "介绍", "哪些", "怎样")
QUESTION_CONTEXT = ("问题", "高频", "qa", "问答", "题库", "面试题")
QUESTION_HEADERS, ANSWER_HEADERS = ("题目", "问题", "question"), ("答案", "要点", "answer")
BARE_LABEL = r"^(?i)(?:Q|Question|问题)\s*[0-9０-９一二三四五六七八九十]+[.、:：)）-]?$"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): lines of each text from 0, for LF and CRLF."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("line_no", "line"))


def paragraph_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(X.paragraphs(X.normalize_text(F.col(text)))).alias("block", "paragraph"))


def markdown_blocks(df: DataFrame, key: str, text: str, initial: Column) -> DataFrame:
    """(key, block, section, text): paragraphs of Markdown under the heading before them; ``initial`` names
    the section before any heading. Heading lines open a section and are no text of it."""
    w = Window.partitionBy(key).orderBy("line_no")
    marked = df.select(key, initial.alias("_initial"), F.posexplode(F.split(X.normalize_text(F.col(text)), "\n")).alias("line_no", "line"))
    heading = F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 2))
    marked = marked.withColumn("h", heading).withColumn("part", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(w))
    marked = marked.withColumn("section", F.coalesce(F.last("h", ignorenulls=True).over(w), F.col("_initial")))
    body = marked.where(F.col("h").isNull()).groupBy(key, "part").agg(
        F.first("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body")
    )  # lines of one section of one document
    out = body.select(key, "part", "section", F.posexplode(X.paragraphs(F.col("body"))).alias("p", "text"))
    return out.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("part", "p"))).select(key, "block", "section", "text")


def chunked(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """(key, position, text, checksum, chunk_id): pieces of each text, each different piece once per key, in
    order of first appearance; positions count the kept pieces from 1."""
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be at least 100 and overlap smaller than size")
    clean = X.strip(F.regexp_replace(F.col(text), "\n{3,}", "\n\n"))
    whole = df.select(key, F.sha2(F.col(text), 256).alias("source_checksum"), clean.alias("t")).where(F.length("t") > 0)
    pieces = whole.select(key, "source_checksum", F.posexplode(arrow.chunks(F.col("t"), size, overlap)).alias("at", "text")).withColumn("checksum", F.sha2("text", 256))
    first = pieces.groupBy(key, "checksum").agg(F.min_by(F.struct("at", "text", "source_checksum"), "at").alias("x")).select(key, "checksum", "x.*")
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    named = F.concat_ws("\n", F.lit(CHUNKER_VERSION), F.col(key).cast("string"), "source_checksum", F.col("position").cast("string"), "text")
    return placed.select(key, "position", "text", "checksum", F.concat(F.col(key).cast("string"), F.lit(":"), F.substring(F.sha2(named, 256), 1, 20)).alias("chunk_id"))


def is_question(line: Column, in_context: Column) -> Column:
    value, cleaned = X.strip(line), X.clean_question(line)
    numbered = value.rlike(X.NUMBER_PREFIX)
    word = cleaned.rlike("|".join(QUESTION_WORDS))
    asks = value.rlike("[?？]$") | (word & (numbered | in_context)) | (numbered & in_context & (F.length(cleaned) >= 4))
    return (F.length(value) > 0) & ~value.rlike(BARE_LABEL) & asks


def in_question_context(*parts: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", *parts))
    return joined.rlike("|".join(QUESTION_CONTEXT))


def line_questions(df: DataFrame, key: str, text: str, context: Column) -> DataFrame:
    """(key, ordinal, question, answers): a question line opens a record, the lines up to the next one that
    are no headings are its answers. Table rows and empty lines are passed over."""
    w = Window.partitionBy(key).orderBy("line_no")
    raw = df.select(key, context.alias("_context"), F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("line_no", "raw"))
    t = raw.withColumn("line", X.strip(F.col("raw"))).where((F.length("line") > 0) & ~F.col("line").startswith("|"))
    head = F.col("line").startswith("#")
    t = t.withColumn("head", head).withColumn("h", F.when(head, X.strip(F.regexp_replace("line", "^#+", ""))))
    t = t.withColumn("content", F.when(head, F.col("h")).otherwise(X.strip(F.regexp_replace("line", r"^[*\- ]+", ""))))
    heading = F.coalesce(F.last("h", ignorenulls=True).over(w), F.lit(""))
    bare = F.col("head") & F.col("content").rlike(BARE_LABEL)
    t = t.withColumn("asks", is_question(F.col("content"), in_question_context(F.col("_context"), heading)) & ~bare)
    t = t.withColumn("ordinal", F.sum(F.col("asks").cast("int")).over(w)).where((F.col("ordinal") > 0) & ~bare & (F.col("asks") | ~F.col("head")))
    entry = F.struct("line_no", "content", "asks")
    got = t.groupBy(key, "ordinal").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # lines of one question
    answers = F.filter(F.transform(F.filter("e", lambda x: ~x["asks"]), lambda x: x["content"]), lambda a: F.length(a) > 0)
    return got.select(key, "ordinal", X.clean_question(F.col("e")[0]["content"]).alias("question"), answers.alias("answers"))


def table_questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, question, answer) of Markdown tables with a question column: a header row, a row of
    dashes, then rows up to the first line that is no table row."""
    w = Window.partitionBy(key).orderBy("line_no")
    t = lines(df, key, text).withColumn("row", X.strip(F.col("line")).startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(X.strip(F.col("line")), r"^\|+|\|+$", ""), r"\|"), X.strip)
    t = t.withColumn("cells", F.when(F.col("row"), cells))
    t = t.withColumn("dashes", F.coalesce(F.col("row") & F.forall("cells", lambda c: c.rlike("^:?-{3,}:?$")), F.lit(False)))
    begins = F.col("row") & F.coalesce(F.lead("dashes").over(w), F.lit(False)) & ~F.col("dashes")
    t = t.withColumn("begins", begins).withColumn("no", F.sum(F.when(~F.col("row") | F.col("begins"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.first(F.when(F.col("begins"), F.transform("cells", F.lower)), ignorenulls=True).over(inside)
    t = t.withColumn("header", header).where(F.col("row") & ~F.col("begins") & ~F.col("dashes") & F.col("header").isNotNull())
    column = lambda names: F.array_min(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("header", n).cast("int")), lambda p: p > 0))
    q, a = column(QUESTION_HEADERS), column(ANSWER_HEADERS)
    out = t.where(q.isNotNull()).select(key, "line_no", F.get("cells", q - 1).alias("question"), F.coalesce(F.get("cells", a - 1), F.lit("")).alias("answer"))
    return out.where(F.length("question") > 0)


# Tasks of question derivation with the text before the passage.
TASKS = {
    "fact_qa": "", "strategy_qa": "Apply the verified guidance in sequence: ",
    "scenario_followup": "Confirm the applicable constraints, then use this guidance: ",
    "rubric": "Check whether the response is supported by this guidance: ",
    "tool_trace": "Identify the decision, check the stated constraints, and produce an evidence-only conclusion using: ",
    "refusal_boundary": None,
}
DECLINE = "Decline to reveal unavailable private detail and answer only from the privacy-safe guidance."


def derived(df: DataFrame, key: str, text: str, reason: Column) -> DataFrame:
    """(key, task, sample_id, answer): six rows for each block whose ``reason`` for rejection is null."""
    safe = F.regexp_replace(X.strip(F.col(text)), r"\s+", " ")
    tasks = F.array(*(F.struct(F.lit(k).alias("task"), F.lit(v).alias("lead")) for k, v in TASKS.items()))
    rows = df.where(reason.isNull()).select(key, safe.alias("safe"), F.explode(tasks).alias("t"))
    answer = F.when(F.col("t.lead").isNull(), F.lit(DECLINE)).otherwise(F.concat("t.lead", "safe"))
    return rows.select(key, F.col("t.task").alias("task"), X.stable_id("sample-", F.col(key), F.col("t.task")).alias("sample_id"), answer.alias("answer"))
