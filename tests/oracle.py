"""Compare a query's rows with DuckDB's, as multisets of values by column name."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from korrel.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return str([plain(x) for x in v])
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    told = con.execute(sql)
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in told.fetchall())
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == wanted, (list((found - wanted).items())[:2], list((wanted - found).items())[:2])
