import random

import numpy as np
import pytest

from marlstone.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, lang string, tokens string"


def docs(n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"])
        out.append((i, ("检索实验 " if rng.random() < 0.5 else "the paper ") * rng.randint(3, 30), s if rng.random() < 0.9 else f" {s.upper()}", rng.choice(["zh", "EN", None, "zh-CN"]), "x"))
    return out + [(n, None, "big", None, "x"), (n + 1, "", "mid", None, "x"), (n + 2, "text here", None, None, "x"), (n + 3, "text here", "other", None, "x")]


@pytest.mark.skipif(not __import__("os").path.exists(M.TOKENIZERS), reason="no tokenizers")
def test_shares_and_repeats(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.3, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = M.mix(df, targets)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert shares["gone"]["documents"] == 0
    for s, want in (("big", 0.3), ("mid", 0.4), ("small", 0.3)):
        assert abs(shares[s]["actual_share"] - want) < 0.01 and shares[s]["most_copies"] <= shares[s]["max_repeats"]
    assert shares["small"]["most_copies"] > 1
    chosen = m.selection.collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and all(r["source"] in ("big", "mid", "small") for r in chosen)
    again = {(r["doc_id"], r["copies"]) for r in M.mix(df, targets).selection.collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in chosen}


@pytest.mark.skipif(not __import__("os").path.exists(M.TOKENIZERS), reason="no tokenizers")
def test_empty(spark):
    df = spark.createDataFrame(docs(20), SCHEMA)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert M.mix(df.limit(0), targets).selection.count() == 0
    none = M.mix(df, targets.limit(0))
    assert none.selection.count() == 0 and none.shares.count() == 0


def test_rake_meets_the_first_marginal():
    tokens = np.array([10.0, 30, 20, 40])
    w, _ = M.rake(tokens, tokens * 2, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([60.0, 40]), np.array([40.0, 60])])
    assert np.allclose([w[:2].sum(), w[2:].sum()], [60, 40]) and np.allclose([w[[0, 2]].sum(), w[[1, 3]].sum()], [40, 60], atol=0.5) and (w <= tokens * 2 + 1e-9).all()


@pytest.mark.skipif(not __import__("os").path.exists(M.TOKENIZERS), reason="no tokenizers")
def test_long_texts_are_counted_in_pieces():
    c = M.TokenCounter()
    text = "word 检索 " * 60_000
    assert abs(c.count(text) - 60_000 * c.count("word 检索 ")) < 60_000
