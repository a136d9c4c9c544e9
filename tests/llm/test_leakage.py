import random

import pytest

from marlstone.llm import leakage as L
from marlstone.llm.common import squeeze

STOCK = "请在三分钟内完成作答，先给结论，再给依据，最后说明不确定之处。"


def han(rng, n):
    return "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    passages = [(i, STOCK + han(rng, 40) + "，" + han(rng, 20) + "。" + (STOCK if i % 2 else "") + han(rng, 30) + "。", "dev") for i in range(12)]
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    passages += [(100 + i, " ".join(rng.sample(words, 30)).capitalize() + ".", "test") for i in range(6)]
    docs = []
    for i in range(60):
        text = han(rng, 200)
        if i % 3 == 0:
            p = passages[i // 3 % len(passages)]
            q = p[1]
            n = {0: 28, 1: 27, 2: 45}[i // 3 % 3] if p[0] < 100 else {0: 80, 1: 79, 2: 120}[i // 3 % 3]
            core = squeeze(q.replace(STOCK, "#").split("#")[1] if STOCK in q else q)[:n]
            noisy = "".join(c + rng.choice(["", "", " ", "，", "\n"]) for c in core).upper()
            text = text[:50] + noisy + text[50:]
        if i % 5 == 0:
            text += STOCK
        docs.append((i, text, f"x{i}"))
    docs += [(900, None, "n"), (901, "", "e"), (902, han(rng, 50_000) + passages[0][1], "long"), (0, docs[0][1], "again")]
    return docs, passages


def brute(docs, passages):
    sentences = {}
    for i, t, _ in passages:
        for s in {squeeze(x) for x in L.sentences(t)}:
            sentences.setdefault(s, set()).add(i)
    stock = {s for s, who in sentences.items() if len(who) >= 4}
    out = set()
    for d, t, _ in docs:
        q = squeeze(t)
        for p, s, _ in passages:
            k, _ = L.sizes_of(s)
            for seg in L.segments(s, stock):
                if any(seg[a : a + k] in q for a in range(len(seg) - k + 1)):
                    out.add((d, p))
    return out


@pytest.mark.parametrize("small", [10**9, 1])
def test_against_brute_force(spark, data, small):
    docs, passages = data
    d = spark.createDataFrame(docs, "doc_id bigint, text string, passage_id string")
    p = spark.createDataFrame(passages, "passage_id bigint, text string, split string")
    got = {(r["doc_id"], r["passage_id"]) for r in L.leaked_passages(d, p, small_index=small).collect()}
    want = brute(docs, passages)
    assert got == want and len(want) > 8


def test_empty_tables(spark, data):
    docs, passages = data
    d = spark.createDataFrame(docs, "doc_id bigint, text string, extra string")
    p = spark.createDataFrame(passages, "passage_id bigint, text string, split string")
    assert L.leaked_passages(d.limit(0), p).count() == 0 and L.leaked_passages(d, p.limit(0)).count() == 0
    only_stock = spark.createDataFrame([(i, STOCK, "dev") for i in range(9)] + [(50, None, "dev"), (51, "短", "dev")], "passage_id bigint, text string, split string")
    assert L.leaked_passages(d, only_stock).count() == 0


def test_report(spark, data):
    docs, passages = data
    d = spark.createDataFrame(docs, "doc_id bigint, text string, extra string")
    p = spark.createDataFrame(passages, "passage_id bigint, text string, split string")
    got = {r["split"]: r["hits"] for r in L.leak_report(L.leaked_passages(d, p), p).collect()}
    want = brute(docs, passages)
    assert got == {"dev": sum(p < 100 for _, p in want), "test": sum(p >= 100 for _, p in want)}
