import json

from pyspark.sql import functions as F

from marlstone.operators import state
from marlstone.streaming import stateful


def stream(spark, tmp_path, rows, schema, files=2):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(files):
        (d / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i::files]))
    return spark.readStream.schema(schema).json(str(d))


def run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name)


def test_rate_limit_equals_batch(spark, tmp_path):
    rows = [{"u": i % 3, "t": i * 130} for i in range(60)]
    got = run(stateful.rate_limited(stream(spark, tmp_path, rows, "u int, t bigint", 1), "u", "t"), "limits", spark)
    want = state.limited(spark.createDataFrame([(r["u"], r["t"]) for r in rows], "u int, t bigint"), "u", "t")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_windows(spark, tmp_path):
    rows = [{"at": f"2024-01-01T00:{m:02d}:00Z", "k": "a"} for m in range(0, 60, 10)] + [{"at": "2024-01-01T09:00:00Z", "k": "a"}]
    got = run(stateful.tumbling_counts(stream(spark, tmp_path, rows, "at timestamp, k string", 1), "at", "k"), "counts", spark, "complete")
    assert {r["n"] for r in got.collect()} == {6, 1}


def test_protocol(spark):
    messages = [{"type": "session.created"}, {"type": "response.output.delta", "kind": "text", "text": "x"}, {"type": "response.output.delta", "kind": "text", "text": "x" * 20001}, {"type": "odd"}, {"type": "response.output.delta", "kind": "audio"}]
    df = spark.createDataFrame([(json.dumps(m),) for m in messages] + [("no",)], "v string")
    got = [(r["event"], r["problem"]) for r in stateful.decoded(df, "v").collect()]
    assert got == [("ready", None), ("delta", None), (None, "too_large"), (None, "unknown_type"), (None, "no_payload"), (None, "not_json")]


def test_session_states(spark, tmp_path):
    events = ["connect", "open", "ready", "input", "delta", "done", "closed", "socket_closed"]
    rows = [{"s": "x", "t": i, "e": e} for i, e in enumerate(events)]
    got = run(stateful.session_states(stream(spark, tmp_path, rows, "s string, t bigint, e string", 1), "s", "t", "e"), "states", spark)
    assert [r["state"] for r in got.orderBy("at").collect()] == ["connecting", "queued", "ready", "listening", "responding", "ready", "stopped", "stopped"]
    assert got.select(F.countDistinct("session")).first()[0] == 1
