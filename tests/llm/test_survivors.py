import random
from datetime import datetime, timedelta

from marlstone.llm import survivors as S

SCHEMA = "duplicate_group_id string, question_id string, review_status string, answer_points array<string>, updated_at timestamp, topic string, n_records string"
T0 = datetime(2024, 1, 1)
STATUS = ["accepted", "needs_review", "needs_answer", "conflict", None]


def make(n, groups, seed, ties=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        points = rng.sample(["甲", "乙", "丙", "丁"], rng.randint(0, 4)) + rng.sample(["", "TODO", " 甲 ", "甲。"], rng.randint(0, 2))
        at = None if rng.random() < 0.1 else T0 + timedelta(days=rng.randint(0, 3 if ties else 400))
        rows.append((f" G{rng.randrange(groups)} ", f"q{i:03d}", rng.choice(STATUS), points, at, rng.choice([None, None, f"t{i}"]), "x"))
    return rows


def key(row):
    usable = {p.strip().strip("。") for p in row[3] or []} - {"", "TODO"}
    return ([4, 3, 2, 1, 0][STATUS.index(row[2])], len(usable), row[4] or datetime.min)


def brute(rows, layers=4):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0].strip().lower(), []).append(r)
    for g, rs in groups.items():
        rest, ordered, first = list(rs), [], None
        better = lambda a, b: all(x >= y for x, y in zip(key(a), key(b))) and key(a) != key(b)
        for _ in range(layers):
            layer = [r for r in rest if not any(better(o, r) for o in rest)]
            layer.sort(key=lambda r: r[1])
            layer.sort(key=key, reverse=True)
            first = first or layer
            ordered += layer
            rest = [r for r in rest if r not in layer]
        rest.sort(key=key, reverse=True)
        best = first[0]
        topic = next((r[5] for r in [*ordered, *rest] if r[5]), None) if best[5] is None else best[5]
        unique = len({r[1] for r in rs}) >= 1 and all(all(x >= y for x, y in zip(key(best), key(r))) for r in rs) and sum(key(r) == key(best) for r in rs) == 1
        out[g] = (best[1], topic, len(first), unique)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["duplicate_group_id"]: (r["question_id"], r["topic"], r["skyline_size"], r["unique_best"]) for r in S.survivors(df, fields=["topic"]).collect()}
    want = brute(rows)
    assert {g: (v[0], v[2], v[3]) for g, v in got.items()} == {g: (v[0], v[2], v[3]) for g, v in want.items()}
    return got, want


def test_against_brute_force(spark):
    got, want = check(spark, make(120, 12, 1))
    assert got == want


def test_hot_group_and_ties(spark):
    check(spark, make(200, 2, 2, ties=True))


def test_edges(spark):
    rows = [("g", "a", None, None, None, None, "x")] * 3 + [("g", "b", "Accepted\t", ["甲", "甲 "], T0, None, "x"), (None, "c", None, None, None, None, "x"), ("  ", "d", None, None, None, None, "x"), ("one", "e", None, ["-"], None, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["duplicate_group_id"]: r for r in S.survivors(df, fields=["topic", "review_status"]).collect()}
    assert set(got) == {"g", "one"} and got["g"]["question_id"] == "b" and got["g"]["n_records"] == 2 and got["one"]["n_records"] == 1
    assert [tuple(r) for r in S.unique_survivors(df).collect()] == [("g", "b")]
    assert S.survivors(df.limit(0), fields=["topic"]).count() == 0
