"""Queries that asked with a fiftieth of the questions ask with all of them."""

import pytest

from marlstone.plans import catalogue, metrics, retrieval
from oracle import connect, same

DOCS = [
    ("k1", "s1", "缓存", "缓存接口失效时先看日志清单。缓存 RAG 20%"), ("k2", "s1", None, "RAG 检索与召回 20% 的评测"),
    ("k3", "s2", "评测", "召回阈值的标定，先看评测"), ("k4", "s2", None, None), ("k5", "s3", "日志", "日志清单 API log"),
]
#: Only the first number is divisible by 50; some keys have no number or are null.
QUESTIONS = [
    ("rc_50", "缓存接口怎样失效", ["k1"], True, "standard"), ("rc_7", "RAG 检索 20%", ["k2"], True, "standard"), ("rc_7", "RAG 检索 20%", ["k2"], True, "standard"),
    ("rc_8", "zzz", [], False, None), ("plain", "评测 召回 召回", ["k3"], True, "paraphrase"), (None, "日志 API", [], False, "unanswerable"),
    ("rc_9", None, [], False, None),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(DOCS, "chunk_id string, source_id string, title string, text string").toPandas().to_parquet(f"{d}/documents.parquet")
    spark.createDataFrame(QUESTIONS, "case_id string, question string, relevant_chunk_ids array<string>, answerable boolean, challenge_type string").toPandas().to_parquet(f"{d}/questions.parquet")
    return d


def rows(spark, d, name):
    return catalogue.queries()[name](spark, d).collect()


def test_bm25_topk_asks_with_every_question(spark, small):
    same(spark, small, connect(small), catalogue.queries()["bm25_topk"], catalogue.oracles()["bm25_topk"])
    assert {r["case_id"] for r in rows(spark, small, "bm25_topk")} == {"rc_50", "rc_7", "plain", None}


def test_boundary_features_asks_with_every_question(spark, small):
    got = {r["case_id"]: r for r in rows(spark, small, "boundary_features")}
    assert got.keys() == {q[0] for q in QUESTIONS} and len(rows(spark, small, "boundary_features")) == len(got)
    assert got["rc_7"]["reason"] is None and got["rc_7"]["anchor_coverage"] == got["rc_7"]["union_coverage"] == 1.0
    assert got["rc_8"]["reason"] == got["rc_9"]["reason"] == "no_documents"


def test_gate_decisions_decides_every_question(spark, small):
    got = {(r["case_id"], r["policy"]): r["decision"] for r in rows(spark, small, "gate_decisions")}
    assert got.keys() == {(q[0], p) for q in QUESTIONS for p in ("margin", "coverage", "composite")}
    assert got["rc_7", "coverage"] == "passed" and got["rc_8", "coverage"] == "no_documents"


def test_gate_grid_counts_every_question(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(metrics.M, "grid_search", lambda observations, *_: seen.append(observations) or observations)
    rows(spark, small, "gate_grid")
    assert sorted(str((r["case_id"], r["answerable"])) for r in seen[0].collect()) == sorted({str((q[0], q[3])) for q in QUESTIONS})


def test_query_retry_asks_with_every_question(spark, small):
    got = rows(spark, small, "query_retry")  # all are weak over so few documents
    assert {r["case_id"] for r in got if r["attempt"] == 2} == {"rc_50", "rc_7", "plain", None} and not [r for r in got if r["attempt"] == 1]


def test_query_retry_keeps_strong_results(spark, small, monkeypatch):
    """Of the null key too: each question has either its first or its second results."""
    first = spark.createDataFrame([("rc_50", "k1", 61.0, 1), ("rc_50", "k5", 2.0, 2), (None, "k5", 70.0, 1), ("rc_7", "k2", 59.9, 1)], "case_id string, chunk_id string, score double, rank int")
    monkeypatch.setattr(retrieval, "ranking", lambda *_, **__: first)
    got = rows(spark, small, "query_retry")
    assert sorted(str(r["case_id"]) + r["chunk_id"] for r in got if r["attempt"] == 1) == ["Nonek5", "rc_50k1", "rc_50k5"]
    assert {r["case_id"] for r in got if r["attempt"] == 2} == {"rc_7", "plain"}


def test_threshold_calibration_rates_every_question(spark, small):
    same(spark, small, connect(small), catalogue.queries()["threshold_calibration"], catalogue.oracles()["threshold_calibration"])
    got = rows(spark, small, "threshold_calibration")[0]  # one question alone has no unanswerable ones to be told from
    assert (got["score_threshold"], got["strictly_above"], got["answerable_recall"], got["no_answer_accuracy"]) == (0.0, True, 1.0, 1.0)
