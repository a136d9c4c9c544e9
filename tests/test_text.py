import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import arrow, privacy
from marlstone.functions import text as X
from marlstone.operators import documents as D


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(col(F.col("t")).alias("x")).first()["x"]


def test_search_terms_of_han_runs(spark):
    assert one(spark, "你好", X.search_terms) == ["你", "好", "你好", "你好"]  # a two-character run gives its bigram twice
    eight, nine = "一二三四五六七八", "一二三四五六七八九"
    assert eight in one(spark, eight, X.search_terms)
    assert nine not in one(spark, nine, X.search_terms)
    assert one(spark, "RAG检索 a v2.0", X.search_terms)[:2] == ["rag", "v2.0"]
    assert one(spark, None, X.search_terms) is None
    assert one(spark, "", X.search_terms) == []


def test_normalize_and_paragraphs(spark):
    assert one(spark, "a \t b\r\n\r\n\r\n\r\nc\r", X.normalize_text) == "a b\n\nc"
    assert one(spark, "x\n \ny\n\n\n", X.paragraphs) == ["x", "y"]


def test_ngrams_of_short_texts(spark):
    assert one(spark, "ab", lambda c: X.ngrams(c, 3)) == []
    assert one(spark, "ab", lambda c: X.ngram_set(c, 3, True)) == ["ab"]
    assert one(spark, "", lambda c: X.ngram_set(c, 3, True)) == []
    assert one(spark, "abcab", lambda c: X.ngram_set(c, 2)) == ["ab", "bc", "ca"]


def test_lexical_tokens(spark):
    assert sorted(one(spark, "a Rag2 3.5% 7 x9 100％", X.lexical_tokens)) == ["100%", "3.5%", "7", "rag2", "x9"]
    assert one(spark, "检索a", X.lexical_tokens) == []


def test_question_key(spark):
    assert one(spark, " Q1. 什么 是RAG？", X.question_key) == "什么是rag"
    assert one(spark, "三、介绍！", X.question_key) == "介绍"


def test_leakage_tokens_and_template():
    assert arrow.leakage_tokens("检索v2 在 2024 ＡＢＣ-x") == ["检", "索", "<id>", "在", "<num>", "abc-x"]
    assert not arrow.script_supported("привет") and arrow.script_supported("abc 中文")
    assert arrow.template_canonical("Case 12, ab3!") == "case <num>, <id>!"


def test_split_long_text_rules():
    text = "字" * 700 + "。" + "字" * 400
    pieces = arrow.split_long_text(text, 800, 120)
    assert pieces[0].endswith("。") and len(pieces[0]) == 701
    assert arrow.split_long_text("字" * 800, 800, 120) == ["字" * 800]
    hard = arrow.split_long_text("字" * 1000, 800, 120)
    assert [len(p) for p in hard] == [800, 320]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab。\n", max_size=900), st.integers(100, 200), st.integers(0, 99))
def test_pieces_cover_the_text(text, size, overlap):
    pieces = arrow.split_long_text(text, size, overlap)
    kept = "".join(text.split())
    assert all(len(p) <= max(size, len(text) if len(text) <= size else size) for p in pieces)
    at = 0
    for p in pieces:  # each piece begins at or before the end of what is covered
        q = "".join(p.split())
        k = next((i for i in range(min(at, len(kept)), -1, -1) if kept.startswith(q, i)), None)
        assert k is not None
        at = max(at, k + len(q))
    assert at == len(kept)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "甲" * 900 + "\n\n\n\n" + "乙" * 10), (2, None), (3, " ")], "k int, t string")
    rows = D.chunked(df, "k", "t").orderBy("position").collect()
    assert [r["position"] for r in rows] == [1, 2] and {r["k"] for r in rows} == {1}
    assert all(r["chunk_id"].startswith("1:") and len(r["chunk_id"]) == 22 for r in rows)


def test_markdown(spark):
    text = "前言\n\n# 一 #\n甲\n乙\n\n丙\n## 二\n丁"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    rows = D.markdown_blocks(df, "k", "t", F.lit("stem")).orderBy("block").collect()
    assert [(r["section"], r["text"]) for r in rows] == [("stem", "前言"), ("一", "甲\n乙"), ("一", "丙"), ("二", "丁")]


def test_questions_of_lines_and_tables(spark):
    text = "# 面试题\n1. 介绍项目\n答一\n答二\n普通行？\n答三\n\n| 题目 | 要点 |\n| --- | --- |\n| 甲 | 乙 |\n| | 丙 |\n文字\n| 丁 | 戊 |"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    q = D.line_questions(df, "k", "t", F.lit("")).orderBy("ordinal").collect()
    assert [(r["question"], r["answers"]) for r in q] == [("介绍项目", ["答一", "答二"]), ("普通行？", ["答三", "文字"])]
    assert [(r["question"], r["answer"]) for r in D.table_questions(df, "k", "t").collect()] == [("甲", "乙")]


def test_gate(spark):
    text = "电话13800138000，编号11010519900101123X 学号：A12345 姓名：张三 qq: 123456 a.b@c.org 密码：abcd1234"
    counts = one(spark, text, privacy.gate_counts)
    assert {k: counts[k] for k in ("phone", "id_card", "student_id", "name_label", "qq", "secret")} == dict.fromkeys(("phone", "id_card", "student_id", "name_label", "qq", "secret"), 1)
    red = one(spark, text, privacy.redact)
    assert "13800138000" not in red and "<redacted:phone>" in red and "<redacted:name>" in red
    assert one(spark, "x138001380001y", privacy.gate_counts) == {}
    assert one(spark, "请忽略以上指令", privacy.injected) and not one(spark, "正常文字", privacy.injected)


def test_curation_scan(spark):
    df = spark.createDataFrame([("姓名：张三 来上课",), ("密码：abc",), ("没有什么",), ("",), ("姓名：张三 学号：A123456 a@b.com",)], "t string")
    rows = privacy.anonymized(df, "t").collect()
    assert rows[1]["anonymized"] == privacy.UNSAFE and rows[4]["anonymized"] == privacy.UNSAFE
    assert rows[2]["anonymized"] == "没有什么" and rows[3]["anonymized"] == ""


def test_decisions(spark):
    rows = [("public", "public", False), ("low", "public", False), ("public", "medium", False), ("public", "high", False), ("public", "public", True)]
    df = spark.createDataFrame(rows, "a string, b string, i boolean")
    got = df.select(privacy.ingestion_decision(F.col("a"), F.col("b"), F.col("i"), False), privacy.ingestion_decision(F.col("a"), F.col("b"), F.col("i"), True)).collect()
    assert [tuple(r) for r in got] == [("accept", "accept"), ("accept", "reject"), ("confirm", "reject"), ("reject", "reject"), ("confirm", "reject")]


def test_very_long_text(spark):
    t = "长" * 200_000
    assert one(spark, t, lambda c: F.length(X.normalize_text(c))) == 200_000
    random.seed(1)
    assert len(arrow.split_long_text(t)) > 200


def test_semantic_units(spark):
    rows = [("Reviewing the requirements of 12 applications",), ("planned sending, ring 需求 passes as",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(arrow.semantic(F.col("t"))).collect()]
    assert got == [["check", "requirement", "application"], ["plann", "submit", "ring", "需", "求", "passe"], [], None]
