"""Compare a query with its SQL on the same tables."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float("%.9g" % v) + 0.0
    if isinstance(v, decimal.Decimal):
        return float("%.9g" % float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(spark, sf, con, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    ours = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(repr([plain(r[i]) for i in at]) for r in got.fetchall())
    assert not ours - theirs and not theirs - ours, (list((ours - theirs))[:2], list((theirs - ours))[:2])
