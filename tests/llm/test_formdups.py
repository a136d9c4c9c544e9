import json
import random

from marlstone.llm import formdups as D


def test_text_forms(spark):
    rows = [("b", "A b，c"), ("a", "ａB​c。"), ("a", "ａB​c。"), ("c", "abc+"), ("d", None), ("e", " …"), ("f", ""), ("g", "长" * 100_000), ("h", "长 " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, t string, copies string")
    assert {tuple(r) for r in D.copy_pairs(df, "id", "t").collect()} == {("a", "b"), ("e", "f"), ("g", "h")}
    got = {r["id"]: (r["copies"], r["forms"]) for r in D.collapse(df, "id", "t").collect()}
    assert got == {"a": (3, 2), "c": (1, 1), "e": (2, 2), "g": (2, 2)}
    assert D.copy_pairs(df.limit(0), "id", "t").count() == 0


def test_json_forms(spark):
    a = {"task": "QA", "q": "甲，乙", "list": ["x y", "z"], "n": 1, "nothing": None}
    rows = [
        ("1", json.dumps(a)), ("2", json.dumps({k: a[k] for k in reversed(a)}, ensure_ascii=False, indent=1)), ("3", json.dumps(a | {"q": "甲乙"}, separators=(",", ":"))),
        ("4", json.dumps(a | {"list": ["x", "yz"]})), ("5", json.dumps({k: v for k, v in a.items() if k != "nothing"})), ("6", json.dumps(a | {"task": "qb"})),
        ("7", "no json {"), ("8", "No JSON"), ("9", json.dumps({"o": {"b": 1, "a": [2]}})), ("10", json.dumps({"o": {"a": [2], "b": 1}}, indent=2)), ("11", json.dumps({"q": 'say "hi", ok'})), ("12", json.dumps({"q": "say hi ok"})),
        ("13", json.dumps({"l": ['a", "b']})), ("14", json.dumps({"l": ["a", "b"]})), ("15", None),
    ]
    df = spark.createDataFrame(rows, "id string, t string")
    assert {tuple(r) for r in D.copy_pairs(df, "id", "t", as_json=True).collect()} == {("1", "2"), ("1", "3"), ("7", "8"), ("10", "9"), ("11", "12")}


def test_json_values_are_told_by_type(spark):
    values = {
        "a": "[note] text", "b": "【note】 text", "c": " [note] text", "d": "[S1][S2] so", "e": "(S1)(S2) so", "f": "\u200b[S1][S2] so", "g": '["x","y"]', "h": "x y",
        "i": ["x\ny", "b"], "j": ["x y", "b"], "k": ["xny", "b"], "l": ["x\\ny", 'b"'], "m": [1, 2], "n": [12], "o": ["+1", None], "p": ["＋1", None], "q": ["+1"], "r": {"z": ["C++"]}, "s": {"z": ["c"]}, "t": {"Z": ["ｃ＋＋ "]},
        "u": [[1], 2], "v": [[1, 2]],
    }
    rows = [(k, json.dumps({"q": v, "n": 1})) for k, v in values.items()] + [("w", "\ufeff " + json.dumps({"n": 1, "Q": "note-text"}, indent=1))]
    got = {tuple(r) for r in D.copy_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t", as_json=True).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "w"), ("d", "e"), ("d", "f"), ("g", "h"), ("i", "j"), ("k", "l"), ("o", "p"), ("r", "t")}


def test_json_forms_agree_between_jvm_and_python(spark):
    texts = [json.dumps(x) for x in ({"a": "[b] C++ Ａ", "B": ["x\ty", "＋", None, ""], "n": None, "e": []}, {"k": True, "l": [1, 2], "m": -3}, {"x": "“ﬁ①²”"})]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.canonical_object(df["t"])).collect()] == [D.canonical_json(t) for t in texts]


def test_hot_record(spark):
    rng = random.Random(1)
    rows = [(f"k{i:04d}", "".join(c + rng.choice(["", " ", "，"]) for c in "甲乙丙丁戊己庚") if i % 3 == 0 else f"t{i}") for i in range(600)]
    got = D.copy_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    assert got.count() == 199 and {r["id_1"] for r in got.collect()} == {"k0000"}
