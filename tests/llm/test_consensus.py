import random
from datetime import datetime, timedelta

from marlstone.llm import consensus as C

SCHEMA = "item_id string, rater_id string, clarity int, coverage int, reasoning int, confidence int, rated_at timestamp, received_at timestamp, raters string"
T0 = datetime(2024, 1, 1)


def ratings(seed=1, items=120):
    rng = random.Random(seed)
    out, truth = [], {}
    bad = {"const": lambda q: 0.5, "random": lambda q: rng.random(), "reversed": lambda q: 1 - q}
    good = {f"r{i}": (lambda q, b=b: q + b + rng.gauss(0, 0.05)) for i, b in enumerate((-0.15, 0, 0, 0.1, 0.2, 0))}
    for i in range(items):
        q = truth[f"i{i}"] = rng.uniform(0.15, 0.8)
        for r, f in {**{k: good[k] for k in rng.sample(list(good), 4)}, **{k: bad[k] for k in rng.sample(list(bad), 1)}, "hot": lambda q: q + rng.gauss(0, 0.04)}.items():
            v = min(1, max(0, f(q)))
            out.append((f"i{i}", r, round(v * 15), round(v * 30), round(v * 20), rng.choice([None, 1, 3, 5, 9]), T0, T0, "x"))
    return out, truth


def test_careless_raters_and_consensus(spark):
    rows, truth = ratings()
    df = spark.createDataFrame(rows + rows[:40], SCHEMA)
    c = C.consensus(df)
    assert {r["rater_id"] for r in c.raters.where("not follows").collect()} == {"const", "random", "reversed"}
    items = {r["item_id"]: r for r in c.items.collect()}
    error = sum(abs(items[i]["coverage"] / 30 - q) for i, q in truth.items()) / len(truth)
    assert error < 0.06 and len(items) == len(truth)
    alpha = {r["dimension"]: r["alpha"] for r in c.agreement.collect()}
    assert set(alpha) == set(C.SCALES) and all(0 < a < 1 for a in alpha.values())


def test_alpha_by_hand(spark):
    rows = [("a", "x", 0, None, None, 3, T0, T0, ""), ("a", "y", 15, None, None, 3, T0, T0, ""), ("b", "x", 15, None, None, 3, T0, T0, ""), ("b", "y", 15, None, None, 3, T0, T0, ""), ("c", "x", 7, None, None, 3, T0, T0, "")]
    a = {r["dimension"]: r for r in C.consensus(spark.createDataFrame(rows, SCHEMA)).agreement.collect()}
    marks = [0, 1, 1, 1]  # of items with two marks
    observed = (2 * 1 + 0) / 4
    expected = sum((x - y) ** 2 for i, x in enumerate(marks) for j, y in enumerate(marks) if i != j) / 12
    assert abs(a["clarity"]["alpha"] - (1 - observed / expected)) < 1e-9 and a["coverage"]["alpha"] is None


def test_corrections_and_bad_marks(spark):
    rows = [("a", "x", 99, -1, 10, None, T0, T0, ""), ("a", "x", 3, 5, 10, None, T0 + timedelta(days=1), T0, ""), ("a", "y", None, None, None, None, T0, T0, ""), (None, "z", 1, 1, 1, 1, T0, T0, ""), ("b", None, 1, 1, 1, 1, T0, T0, ""), ("c", "x", 16, 31, 21, 1, T0, T0, "")]
    c = C.consensus(spark.createDataFrame(rows, SCHEMA))
    got = c.items.collect()
    assert [(r["item_id"], r["clarity"], r["coverage"], r["reasoning"], r["raters"]) for r in got] == [("a", 3, 5, 10, 1)]
    assert got[0]["agreement"] is None


def test_empty(spark):
    c = C.consensus(spark.createDataFrame([], SCHEMA))
    assert c.items.count() == 0 and c.raters.count() == 0
    assert C.careless_raters(spark.createDataFrame([], SCHEMA)).count() == 0
