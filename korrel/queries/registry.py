"""Registered queries by name, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korrel.plans.database import Database
from korrel.plans.policy import Access
from korrel.session import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def mark(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return mark


def tables_in(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z]+", sql.lower()))
    return [t for t in TABLES if t in words]


def statement(name: str, sql: str, oracle: str | None = None, access: Access | None = None, dialect: str = "spark") -> None:
    """Register a statement run through the guarded database; its oracle is itself or ``oracle``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Database.of(spark, sf_dir, *tables_in(sql), access=access, dialect=dialect).frame(sql)

    query(name, oracle or sql)(run)
