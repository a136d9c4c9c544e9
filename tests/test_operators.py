import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.arrow import search_terms
from marlstone.operators import curation as C
from marlstone.operators import metrics as M
from marlstone.operators import policies as P
from marlstone.operators import retrieval as R
from marlstone.operators import similarity as S
from marlstone.operators import state as T


def random_sets(n, seed):
    rng = random.Random(seed)
    base = [rng.sample("abcdefghijklmnop", rng.randint(1, 9)) for _ in range(n)]
    return [(i, sorted(set(b) if rng.random() < 0.6 else set(base[i - 1][:-1] or b))) for i, b in enumerate(base)]


@pytest.mark.parametrize("num,den,strict", [(35, 100, False), (7, 10, True), (4, 5, False), (1, 1, False)])
def test_jaccard_join_equals_brute_force(spark, num, den, strict):
    rows = random_sets(80, num)
    df = spark.createDataFrame(rows, "k int, s array<string>")
    got = {(r["a"], r["b"]) for r in S.jaccard_join(df, "k", "s", num, den, strict).collect()}
    want = set()
    for i, a in rows:
        for j, b in rows:
            both, either = len({*a} & {*b}), len({*a} | {*b})
            if i < j and (both * den > either * num if strict else both * den >= either * num):
                want.add((i, j))
    assert got == want


def test_cosine_join_equals_brute_force(spark):
    rng = random.Random(3)
    bags = {i: Counter(rng.choices("abcdefgh", k=rng.randint(1, 12))) for i in range(70)}
    df = spark.createDataFrame([(i, t, n) for i, b in bags.items() for t, n in b.items()], "k int, t string, n int")
    got = {(r["a"], r["b"]) for r in S.cosine_join(df, "k", "t", "n", 86, 100).collect()}
    dot = lambda x, y: sum(x[t] * y[t] for t in x)
    want = {(i, j) for i in bags for j in bags if i < j and dot(bags[i], bags[j]) ** 2 * 10000 >= 86 * 86 * dot(bags[i], bags[i]) * dot(bags[j], bags[j])}
    assert got == want


def test_pairs_that_only_share_tokens_are_not_shuffled(spark):
    """Each pair that shared a token of its prefixes was a row of a shuffle; of frames of text those are most pairs."""
    rng = random.Random(17)
    bags = {i: set(rng.sample(range(60), 25)) for i in range(120)}
    bags |= {i + 120: {*bags[i]} ^ {rng.randrange(60)} for i in range(10)}
    want = {(i, j) for i in bags for j in bags if i < j and len(bags[i] & bags[j]) * 5 >= len(bags[i] | bags[j]) * 4}
    df = spark.createDataFrame([(i, sorted(b)) for i, b in bags.items()], "k int, s array<int>")
    vectors = df.select(F.col("k").cast("bigint").alias("id"), F.transform("s", lambda t: F.xxhash64(t)).alias("h"), F.transform("s", lambda _: F.lit(1)).alias("f"))
    met = {tuple(r) for r in S._candidates(vectors, 4, 5, False).collect()}
    assert want <= met and len(met) < len(want) + 130 * 129 // 2 // 50
    assert {(r["a"], r["b"]) for r in S.jaccard_join(df, "k", "s", 4, 5).collect()} == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({*range(60), *range(100, 131)})
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = S.components(spark.createDataFrame([(v,) for v in nodes], "v int"), spark.createDataFrame(edges, "a int, b int"), "v")
    assert {r["v"]: r["component"] for r in got.collect()} == {v: find(v) for v in nodes}


def test_membership_of_copies_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("a", "x", 2), ("c", None, 3)], "k string, t string, extra int")
    assert {tuple(r) for r in S.membership(df, "k", "t").collect()} == {("a", "a"), ("b", "a")}
    empty = df.limit(0)
    assert S.membership(empty, "k", "t").count() == 0
    sets = empty.select("k", F.array("t").alias("s"))
    assert S.jaccard_join(sets, "k", "s", 1, 2).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "rag rag 检索"), ("b", "rag"), ("c", None), ("d", "rag")], "id string, t string")
    q = spark.createDataFrame([("q", "rag rag")], "qid string, q string")
    got = {r["id"]: (r["score"], r["rank"]) for r in R.bm25(q, docs, "qid", "q", "id", F.col("t"), 5).collect()}
    lens = {"a": 6, "b": 1, "c": 0, "d": 1}
    avg = sum(lens.values()) / 4

    def score(tf, dl):
        idf = math.log(1 + (4 - 3 + 0.5) / 3.5)
        return idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(dl, 1) / avg)) * (1 + math.log1p(2))

    assert got["a"][0] == pytest.approx(score(2, 6), abs=1e-6) and got["b"][0] == pytest.approx(score(1, 1), abs=1e-6)
    assert (got["b"][1], got["d"][1], got["a"][1]) == (1, 2, 3) if got["b"][0] > got["a"][0] else (2, 3, 1)
    assert "c" not in got
    assert R.bm25(q, docs.limit(0), "qid", "q", "id", F.col("t"), 5).count() == 0


def test_bm25_in_passes_shuffles_no_pairs(spark, monkeypatch):
    """Beyond the terms of one pass the search joined all pairs of documents and queries by shuffles."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(["rag", "api", "sql", "检索", "证据", "模型评测", "日志"], k=rng.randint(0, n)))
    docs = spark.createDataFrame([(f"d{i:03}", text(6)) for i in range(150)], "id string, t string")
    q = spark.createDataFrame([(f"q{i}", text(5)) for i in range(30)], "qid string, q string")
    want = {tuple(r) for r in R.bm25(q, docs, "qid", "q", "id", F.col("t"), None).where("rank <= 4").collect()}

    def forbidden(*_):
        raise AssertionError("pairs are shuffled")

    monkeypatch.setattr(R, "SMALL_ROWS", 0, raising=False)
    monkeypatch.setattr(R, "_scored_by_joins", forbidden)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # many blocks of documents
    try:
        assert {tuple(r) for r in R.bm25(q, docs, "qid", "q", "id", F.col("t"), 4, 60).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_matches_in_passes_shuffles_no_pairs(spark):
    """Each pair of a document and a query that share a term was a row of a shuffle."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choices(["rag", "api", "sql", "检索", "证据", "模型评测", "日志"], k=rng.randint(0, n)))
    rows, asked = [(f"d{i}", text(4)) for i in range(90)], [(f"q{i}", text(4)) for i in range(25)]
    docs, q = spark.createDataFrame(rows, "id string, t string"), spark.createDataFrame(asked, "qid string, q string")
    of = lambda d, n: {r["qid"]: r["candidates"] for r in R.matches(q, d, "qid", "q", "id", F.col("t"), n).collect()}
    terms = lambda t: set(search_terms(t))
    want = {i: n for i, t in asked if (n := sum(1 for _, x in rows if terms(t) & terms(x)))}
    assert of(docs, 10**6) == of(docs, 40) == of(docs.union(docs), 40) == want


def test_boundary_features_by_hand(spark):
    q = spark.createDataFrame([("q", "RAG检索 20%"), ("n", "x"), ("s", "y")], "case_id string, question string")
    r = spark.createDataFrame([("q", 1, 4.0, "RAG 检索"), ("q", 2, 3.0, "20% 别的"), ("s", 1, 1.0, "y")], "case_id string, rank int, score double, doc string")
    f = {x["case_id"]: x for x in R.boundary_features(q, r, "case_id", "question", "doc").collect()}
    assert f["n"]["reason"] == "no_documents" and f["s"]["reason"] == "insufficient_documents"
    assert f["q"]["reason"] is None and f["q"]["normalized_margin"] == 0.25 and f["q"]["anchor_coverage"] == 1.0 and f["q"]["union_coverage"] == 1.0
    assert f["q"]["max_document_coverage"] == pytest.approx(2 / 3)


def test_packing(spark):
    r = spark.createDataFrame([("q", 1, "a" * 50), ("q", 2, "b" * 50), ("q", 3, "c" * 50)], "qid string, rank int, t string")
    got = R.packed_context(r, "qid", F.lit("12345"), F.col("t"), 100).orderBy("rank").collect()
    assert [x["kept_chars"] for x in got] == [50, 40]


def test_calibration_against_brute_force(spark):
    rng = random.Random(2)
    obs = [(rng.random() < 0.6, round(rng.random() * 3, 1)) for _ in range(60)]
    got = R.calibrated_threshold(spark.createDataFrame(obs, "y boolean, s double"), "y", "s").first()
    best = max(
        ((sum(s >= t for y, s in obs if y) / sum(y for y, _ in obs) + sum(s < t for y, s in obs if not y) / sum(not y for y, _ in obs)) / 2)
        for t in {0.0, *(s for _, s in obs), *(math.nextafter(s, 9) for _, s in obs)}
    )
    assert got["balanced_accuracy"] == pytest.approx(best, abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40))
def test_allocation(n):
    counts = C.allocation(n, (0.8, 0.1, 0.1))
    assert sum(counts) == n and (n < 3 or min(counts) >= 1)


def test_group_split_keeps_groups(spark):
    df = spark.createDataFrame([(f"g{i % 17}", i) for i in range(100)] + [(None, 1)], "g string, x int")
    s = C.group_split(df, "g", "seed").collect()
    assert len(s) == 17 and Counter(r["split"] for r in s) == {"train": 13, "dev": 2, "test": 2}
    with pytest.raises(ValueError):
        C.group_split(df, "g", "seed", (0.5, 0.6, 0.1))


def test_global_rank(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(500)], "k string").withColumn("d", F.sha2("k", 256))
    rows = C.global_rank(df, "d", "k").collect()
    order = sorted(rows, key=lambda r: (r["d"], r["k"]))
    assert [r["rn"] for r in order] == list(range(1, 501))


def test_agreement_degenerate(spark):
    same = spark.createDataFrame([(i, r, 70) for i in range(4) for r in "ab"], "i int, r string, s int")
    got = M.pairwise_agreement(same, "i", "r", "s").first()
    assert got["cohen_kappa"] == 1.0 and got["quadratic_weighted_kappa"] == 1.0 and got["pearson"] == 1.0
    flat = spark.createDataFrame([(1, "a", 70), (1, "b", 90), (2, "a", 70), (2, "b", 90)], "i int, r string, s int")
    got = M.pairwise_agreement(flat, "i", "r", "s").first()
    assert got["pearson"] == 0.0 and got["mean_absolute_difference"] == 20


def test_bootstrap(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(10, 3)) for i in range(400)]
    b = M.bootstrap_interval(spark.createDataFrame(rows, "c int, v double"), "c", "v").first()
    half = 1.96 * 3 / math.sqrt(400)
    assert b["low"] < b["estimate"] < b["high"] and 0.6 * 2 * half < b["high"] - b["low"] < 1.5 * 2 * half


def test_grid_search(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.5, rng.random(), rng.random()) for _ in range(200)]
    axes = {"a": [0.0, 0.3, 0.6], "b": [0.0, 0.5]}
    got = M.grid_search(spark.createDataFrame(rows, "y boolean, a double, b double"), "y", axes, 0.5).first()
    best = None
    for ta in axes["a"]:
        for tb in axes["b"]:
            rec = sum(x >= ta and z >= tb for y, x, z in rows if y) / sum(y for y, *_ in rows)
            none = sum(not (x >= ta and z >= tb) for y, x, z in rows if not y) / sum(not y for y, *_ in rows)
            if rec >= 0.5 and (best is None or ((rec + none) / 2, rec, -ta, -tb) > best):
                best = ((rec + none) / 2, rec, -ta, -tb)
    assert (got["balanced"], got["recall"], -got["a"], -got["b"]) == pytest.approx(best)


def test_mastery(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([True, False, True, True, True])], "u int, i int, ok boolean")
    m = T.mastery(df, "u", ["i"], F.col("ok")).orderBy("i").collect()
    assert [(r["mastery"], r["review_days"]) for r in m] == [("reviewing", 3), ("open", 1), ("reviewing", 3), ("mastered", 14), ("mastered", 14)]


def test_limiter_against_loop(spark):
    rng = random.Random(4)
    rows = [(u, t) for u in range(5) for t in sorted(rng.sample(range(6000), 40))]
    got = {(r["u"], r["t"]): r["allowed"] for r in T.limited(spark.createDataFrame(rows, "u int, t bigint"), "u", "t", 1000, 4).collect()}
    for u in range(5):
        start, n = None, 0
        for _, t in [x for x in rows if x[0] == u]:
            if start is None or t - start >= 1000:
                start, n = t, 0
            n += 1
            assert got[u, t] == (n <= 4)


def test_urls():
    good = ["https://example.org/a", "https://8.8.8.8/x", "https://a-b.example.com/%20x"]
    bad = ["http://example.org/", "https://u@example.org/", "https://example.org:443/", "https://example.org/?q", "https://EXAMPLE.org/", "https://10.0.0.1/", "https://host.local/", "https://example.org/%2f", "https://example.org/../a", "https://localhost/", " https://example.org/", None, ""]
    assert all(P.url_problem(u) is None for u in good) and all(P.url_problem(u) for u in bad)


def test_scopes(spark):
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/a/x.txt",), ("/p/q.txt",), ("/a/b/简历.txt",), ("/z",)], "path string")
    policy = spark.createDataFrame([(1, "/a/x.txt", "file", "f"), (2, "/a/b", "directory", "d"), (3, "/a", "file", "no")], "pos int, source_path string, path_type string, source_id string")
    got = {r["path"]: (r["source_id"], r["reason"]) for r in P.scope_decisions(paths, "path", policy, ["/p"], ["简历"]).collect()}
    assert got == {"/a/b/c.txt": ("d", "allowlisted_source"), "/a/x.txt": ("f", "allowlisted_source"), "/p/q.txt": (None, "protected_root"), "/a/b/简历.txt": (None, "protected_name_term"), "/z": (None, "default_deny")}


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "z")], "k string, at int, v string")
    assert {tuple(r) for r in C.latest(df, ["k"], [F.col("at")]).collect()} == {("a", 2, None), ("b", 5, "z")}
    assert {tuple(r) for r in C.latest(df, ["k"], [F.col("at")], first=True).collect()} == {("a", 1, "x"), ("b", 5, "z")}


def test_stable_id_counts_nulls_as_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    assert len({r[0] for r in df.select(X.stable_id("p_", F.col("x"), F.col("y"))).collect()}) == 1


def test_logistic_folds(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        y = rng.random() < 0.4
        rows.append((y, rng.gauss(1.5 if y else 0, 1), rng.gauss(0, 1), rng.randrange(3)))
    df = spark.createDataFrame(rows, "y boolean, a double, b double, fold int")
    got = {r["c"]: r for r in M.logistic_folds(df, "y", ["a", "b"], "fold", [0.1, 10.0]).collect()}
    assert all(0.7 < r["balanced_accuracy"] < 0.9 and r["weights"][0] > abs(r["weights"][1]) for r in got.values())
    assert M.logistic_folds(df.where("y"), "y", ["a", "b"], "fold", [1.0]).count() == 0


def test_group_split_two_ways_and_handshake(spark):
    df = spark.createDataFrame([("https://a", "text", 10), ("https://b", "text", 10), ("https://a", "odd", 10), ("https://a", "text", 9999), (None, None, None)], "o string, m string, n int")
    got = [r[0] for r in df.select(P.handshake(F.col("o"), F.col("m"), F.col("n"), ["https://a"], ["text"], 100)).collect()]
    assert got == ["ok", "origin_not_allowed", "unsupported_mode", "message_too_large", "origin_not_allowed"]
    safe = spark.createDataFrame([({"Token": "abc", "path": "x"},)], "f map<string,string>").select(P.safe_fields(F.col("f")).alias("f")).first()["f"]
    assert safe["path"] == "x" and "abc" not in safe["Token"]


def test_matched_pairs_equal_brute_force(spark):
    from marlstone.functions.arrow import matcher_ratio
    from marlstone.plans.curation import matched_pairs

    rng = random.Random(8)
    rows = [("", "k0"), ("", "k1"), ("ab", "k2"), ("ab", "k3")]
    for i in range(30):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50 if i else 25)]
        for j in range(3):
            x = list(base)
            for at in rng.sample(range(len(x)), rng.randint(0, 4)):
                x[at] = rng.choice(["", "#", x[at] * 2])
            rows.append(("".join(x), f"t{i:02d}{j}"))
    want = {(a, b) for t, a in rows for u, b in rows if a < b and matcher_ratio(t, u) >= 0.92}
    got = {(r["a"], r["b"]) for r in matched_pairs(spark.createDataFrame(rows, "t string, k string")).collect()}
    # Three scattered replacements in fifty characters leave three-gram similarity far below 0.82.
    assert got == want and len(want) > 30
