"""Functions that no composition of built-in ones expresses: JSON edits and the greatest common divisor.

They are registered in a database's own session and reached only through rewritten calls.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([^.\[]+)|\[(\d+|#)\]")


def _steps(path: str) -> list:
    return [int(b) if b.isdigit() else b if b else a for a, b in _STEP.findall(path)]


def _merge(target, patch):
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = _merge(out.get(key), value)
    return out


def _strip(value):
    if isinstance(value, dict):
        return {k: _strip(v) for k, v in value.items() if v is not None}
    return [_strip(x) for x in value] if isinstance(value, list) else value


def edit(text: str | None, path: str | None, value: str | None, how: str) -> str | None:
    """``text`` with the value at ``path`` set, inserted (only if absent), replaced (only if there) or removed."""
    if text is None:
        return None
    try:
        doc = json.loads(text)
    except ValueError:
        return None
    if how == "pretty":
        return json.dumps(doc, indent=4, ensure_ascii=False)
    if how == "strip":
        doc = _strip(doc)
    elif how == "patch":
        doc = _merge(doc, json.loads(value))
    else:
        new = json.loads(value)["v"] if value is not None and how != "remove" else None
        steps, at = _steps(path), doc
        for step in steps[:-1]:
            if isinstance(at, dict) and step not in at and how in ("set", "insert"):
                at[step] = {}
            try:
                at = at[step]
            except (KeyError, IndexError, TypeError):
                return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
        last = steps[-1]
        if isinstance(at, dict):
            there = last in at
        elif isinstance(at, list):
            last = len(at) if last == "#" else last
            there = isinstance(last, int) and last < len(at)
        else:
            last, there = None, False
        if how == "remove" and there:
            del at[last]
        elif there and how in ("set", "replace"):
            at[last] = new
        elif not there and how in ("set", "insert") and last is not None:
            if isinstance(at, dict):
                at[last] = new
            elif last == len(at):
                at.append(new)
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def register(spark: SparkSession) -> set[str]:
    @F.pandas_udf("string")
    def korrel_json_edit(text: pd.Series, path: pd.Series, value: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([edit(*(None if x is pd.NA or isinstance(x, float) else x for x in row)) for row in zip(text, path, value, how)], dtype=object)

    @F.pandas_udf("long")
    def korrel_gcd(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else math.gcd(int(x), int(y)) for x, y in zip(a, b)], dtype="Int64")

    for f in (korrel_json_edit, korrel_gcd):
        spark.udf.register(f.func.__name__, f)
    return {"korrel_json_edit", "korrel_gcd"}
