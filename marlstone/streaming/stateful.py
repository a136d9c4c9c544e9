"""Streams over an event log. Batch tables of the same columns give the same results in ``operators.state``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(events: DataFrame, user: str, at_ms: str, window_ms: int = 1000, limit: int = 4, late: str = "1 hour") -> DataFrame:
    """(user, at, allowed) with a window anchored at its first event, kept as state by user.

    Events of one user are taken in the order of their times within a micro-batch. State is 16 bytes a user and
    goes once the watermark is ten windows past the user's last event; events ``late`` behind the latest are
    dropped (times up to 1970 count as its first moment there). No timer of the wall clock runs, so a stream that
    has read its input ends."""
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at")
        start, n = state.get if state.exists else (None, 0)
        out = []
        for t in rows["at"]:
            if start is None or t - start >= window_ms:
                start, n = int(t), 0
            n += 1
            out.append(n <= limit)
        state.update((start, n))
        state.setTimeoutTimestamp(max(int(rows["at"].iloc[-1]), state.getCurrentWatermarkMs()) + 10 * max(window_ms, 1000))
        yield pd.DataFrame({"user": [key[0]] * len(rows), "at": rows["at"].to_numpy(), "allowed": out})

    kind = dict(events.select(F.col(user).alias("user")).dtypes)["user"]
    at = F.col(at_ms).cast("bigint")
    return (
        events.select(F.col(user).alias("user"), at.alias("at"), F.timestamp_millis(F.greatest(at, F.lit(1))).alias("when")).withWatermark("when", late).groupBy("user")
        .applyInPandasWithState(step, f"user {kind}, at bigint, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def tumbling_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; a window is final once the watermark has passed it, later rows are dropped."""
    e = events.select(F.col(at).cast("timestamp").alias("at"), F.col(kind).alias("kind")).withWatermark("at", late)
    return e.groupBy(F.window("at", size).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def session_counts(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.select(F.col(at).cast("timestamp").alias("at"), F.col(user).alias("user")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), "user").agg(F.count("*").alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# Events of the live protocol, kinds of output and the greatest length of each.
EVENT_TYPES = ("session.queued", "session.queue_update", "session.queue_done", "session.created", "response.output.delta", "response.done", "session.closed", "error")
MAX_TEXT, MAX_AUDIO = 20_000, 1_048_576


def decoded(messages: DataFrame, value: str) -> DataFrame:
    """Adds ``event`` (queue, queue_done, ready, listen, delta, done, closed or error) and ``problem`` (null,
    not_json, unknown_type, unknown_kind, no_payload, too_large) of protocol messages."""
    get = lambda p: F.get_json_object(F.col(value), f"$.{p}")
    kind, out = get("type"), get("kind")
    delta = kind == "response.output.delta"
    payload = F.when(out == "text", get("text")).when(out == "audio", get("audio"))
    problem = (
        F.when(F.json_object_keys(value).isNull(), "not_json").when(kind.isNull() | ~kind.isin(*EVENT_TYPES), "unknown_type")
        .when(delta & (out.isNull() | ~out.isin("listen", "text", "audio")), "unknown_kind").when(delta & (out != "listen") & payload.isNull(), "no_payload")
        .when(delta & (out == "text") & (F.length(payload) > MAX_TEXT), "too_large").when(delta & (out == "audio") & (F.length(payload) > MAX_AUDIO), "too_large")
    )
    event = (
        F.when(kind.isin("session.queued", "session.queue_update"), "queue").when(kind == "session.queue_done", "queue_done").when(kind == "session.created", "ready")
        .when(delta & (out == "listen"), "listen").when(delta, "delta").when(kind == "response.done", "done").when(kind == "session.closed", "closed").when(kind == "error", "error")
    )
    return messages.withColumn("problem", problem).withColumn("event", F.when(F.col("problem").isNull(), event))


# The state of a live session after each event; a message that cannot be decoded fails it.
AFTER = {
    "connect": "connecting", "open": "queued", "queue": "queued", "queue_done": "queued", "ready": "ready", "listen": "listening", "delta": "responding",
    "done": "ready", "closed": "stopped", "stop": "stopped", "error": "failed", "invalid": "failed",
}


def next_state(state: str, event: str) -> str:
    """The state after an event. Input listens only from ready, a socket that closes fails a session that was
    not stopped, and unknown events keep the state."""
    if event == "input":
        return "listening" if state == "ready" else state
    if event == "socket_closed":
        return state if state == "stopped" else "failed"
    return AFTER.get(event, state)


def session_states(events: DataFrame, session: str, at_ms: str, event: str) -> DataFrame:
    """(session, at, event, state) with the state after each event, kept as state by session."""
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        now = state.get[0] if state.exists else "idle"
        out = []
        for e in rows["event"]:
            now = next_state(now, e)
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"session": [key[0]] * len(rows), "at": rows["at"].to_numpy(), "event": rows["event"].to_numpy(), "state": out})

    kind = dict(events.select(F.col(session).alias("session")).dtypes)["session"]
    return (
        events.select(F.col(session).alias("session"), F.col(at_ms).cast("bigint").alias("at"), F.col(event).alias("event")).groupBy("session")
        .applyInPandasWithState(step, f"session {kind}, at bigint, event string, state string", "state string", "append", GroupStateTimeout.NoTimeout)
    )
