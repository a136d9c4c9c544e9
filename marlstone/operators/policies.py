"""Decisions by rules: source scopes, handshakes, public addresses, fields of logs."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of log fields whose values are never written, and host suffixes that are not public.
SENSITIVE_KEYS = ("answer", "text", "question", "prompt", "content", "message", "token", "api_key", "password", "secret")
PRIVATE_SUFFIXES = (".local", ".localhost", ".internal", ".lan", ".home", ".corp", ".invalid", ".test", ".example")
MAX_URL = 2048


def scope_decisions(paths: DataFrame, path: str, policy: DataFrame, protected_roots: Sequence[str], protected_terms: Sequence[str]) -> DataFrame:
    """Adds ``source_id`` and ``reason``: a protected root comes before a protected term in the file name,
    then the first matching row of the policy (pos, source_path, path_type, source_id), else denied.

    Files match by equality and folders by their prefixes, so both are hash joins; no path is compared with
    every row of the policy."""
    p = F.col(path)
    name = F.lower(F.element_at(F.split(p, "/"), -1))
    root = F.lit(False)
    for r in protected_roots:
        root = root | (p == r) | p.startswith(r.rstrip("/") + "/")
    term = F.lit(False)
    for t in protected_terms:
        term = term | name.contains(t.lower())
    parts = F.split(p, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    asked = paths.select(path).distinct().select(path, F.explode(prefixes).alias("_at"))
    rules = policy.select(F.regexp_replace("source_path", "/+$", "").alias("_at"), "path_type", "source_id", "pos")
    hits = asked.join(rules, "_at").where((F.col("path_type") == "directory") | (F.col("_at") == p))
    first = hits.groupBy(path).agg(F.min_by("source_id", "pos").alias("_source"))
    j = paths.join(first, path, "left")
    reason = F.when(root, "protected_root").when(term, "protected_name_term").when(F.col("_source").isNotNull(), "allowlisted_source").otherwise("default_deny")
    return j.withColumn("reason", reason).withColumn("source_id", F.when(F.col("reason") == "allowlisted_source", F.col("_source"))).drop("_source")


def handshake(origin: Column, mode: Column, length: Column, origins: Sequence[str], modes: Sequence[str], most: int) -> Column:
    """ok, or the first rule that fails: origin, mode, size."""
    return (
        F.when(origin.isNull() | ~origin.isin(*origins), "origin_not_allowed").when(mode.isNull() | ~mode.isin(*modes), "unsupported_mode")
        .when(F.coalesce(length, F.lit(0)) > most, "message_too_large").otherwise("ok")
    )


def url_problem(value: str | None) -> str | None:
    """Why an address is no canonical public https address, or None if it is one: no user, port, query or
    fragment, a public host in lower case, and a path that is encoded only where it must be."""
    if not value or len(value) > MAX_URL or value != value.strip() or re.search(r"[\x00-\x1f\x7f\\]", value):
        return "form"
    try:
        u = urlsplit(value)
        host, port = u.hostname, u.port
    except ValueError:
        return "form"
    if u.scheme != "https":
        return "scheme"
    if u.username is not None or u.password is not None or port is not None or u.query or u.fragment or value.endswith(("?", "#")):
        return "parts"
    if not host or host != host.lower() or host.endswith(".") or "%" in u.netloc:
        return "host"
    try:
        ip = ipaddress.ip_address(host)
        if not ip.is_global or ip.is_multicast or ip.compressed != host:
            return "host"
    except ValueError:
        labels = host.split(".")
        proper = all(re.fullmatch(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", x) for x in labels)
        if len(host) > 253 or len(labels) < 2 or not proper or labels[-1].isdigit() or host.endswith(PRIVATE_SUFFIXES):
            return "host"
    for code in re.findall(r"%(.{0,2})", u.path, re.S):
        if not re.fullmatch("[0-9A-F]{2}", code) or chr(int(code, 16)) in "/\\%" or int(code, 16) < 0x20 or re.fullmatch(r"[A-Za-z0-9._~-]", chr(int(code, 16))):
            return "path"
    try:
        path = unquote(u.path, errors="strict")
    except UnicodeDecodeError:
        return "path"
    if any(x in (".", "..") for x in path.split("/")) or unicodedata.normalize("NFC", path) != path:
        return "path"
    shown = f"[{host}]" if ":" in host else host
    return None if value == f"https://{shown}{u.path}" else "form"


def url_problems(col: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(url_problem).astype("object")

    return F.pandas_udf(run, T.StringType())(col)


def safe_fields(fields: Column) -> Column:
    """A map of log fields without the values of sensitive keys: their length and a short digest instead."""
    sensitive = F.array(*map(F.lit, SENSITIVE_KEYS))
    return F.transform_values(
        fields,
        lambda k, v: F.when(F.array_contains(sensitive, F.lower(k)), F.concat(F.lit("redacted length="), F.length(v), F.lit(" sha256="), F.substring(F.sha2(v, 256), 1, 12))).otherwise(v),
    )
