"""Rules over texts: each turns documents into violations (key, rule, line_no, text)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.operators import extract, syntax
from korrel.operators.prefix import running
from korrel.operators.text import lines
from korrel.session import checkpointed

PAGE = 100
CONVENTIONAL = r"^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\([^)]+\))?!?: \S"


def _lines_that(df: DataFrame, key: str, text: str, name: str, test, quick: Column | None = None) -> DataFrame:
    rows = lines(df.filter(quick) if quick is not None else df, key, text)
    return rows.filter(test(F.col("line"))).select(key, F.lit(name).alias("rule"), "line_no", F.col("line").alias("text"))


def _whole(df: DataFrame, key: str, text: str, name: str, test: Column) -> DataFrame:
    return df.filter(test).select(key, F.lit(name).alias("rule"), F.lit(1).alias("line_no"), F.lit("").alias("text"))


def check(df: DataFrame, key: str, text: str, rule: str) -> DataFrame:
    """The violations of one rule ``name:argument``. Comments and literals are found by line patterns, not syntax.

    ``q:`` takes a pattern of ``syntax`` over the elements of pages; what it captures as ``@violation`` is one.
    """
    name, _, a = rule.partition(":")
    c = F.col(text)
    if name == "q":
        found = syntax.matches(extract.elements(df, key, text), df, key, text, a)
        return found.filter("capture = 'violation'").select(key, F.lit(rule).alias("rule"), F.col("line").alias("line_no"), F.col("text"))
    if name == "forbid":
        return _lines_that(df, key, text, rule, lambda x: F.contains(x, F.lit(a)), F.contains(c, F.lit(a)))
    if name == "forbid_any_case":
        return _lines_that(df, key, text, rule, lambda x: F.contains(F.lower(x), F.lit(a.lower())), F.contains(F.lower(c), F.lit(a.lower())))
    if name == "forbid_regex":
        return _lines_that(df, key, text, rule, lambda x: x.rlike(a))
    if name == "require":
        return _whole(df, key, text, rule, ~F.contains(c, F.lit(a)))
    if name == "require_any_case":
        return _whole(df, key, text, rule, ~F.contains(F.lower(c), F.lit(a.lower())))
    if name == "no_todo":
        return _lines_that(df, key, text, rule, lambda x: x.rlike(r"(?i)\b(todo|fixme|xxx)\b"))
    if name == "no_comment":
        return _lines_that(df, key, text, rule, lambda x: x.rlike(r"^\s*(//|#|/\*|--)"))
    if name == "require_comment":
        return _whole(df, key, text, rule, ~c.rlike(r"(?m)^\s*(//|#|/\*|--)"))
    if name == "no_literal":
        pattern = {"string": r"\"[^\"]*\"|'[^']*'", "number": r"(?<![\w.])[0-9]+(\.[0-9]+)?(?!\w)"}[a]
        return _lines_that(df, key, text, rule, lambda x: x.rlike(pattern))
    if name == "forbid_import":
        return _lines_that(df, key, text, rule, lambda x: x.rlike(rf"^\s*(import|from|require|use|include)\b.*\b{re.escape(a)}\b"))
    if name == "max_lines":
        return _whole(df, key, text, rule, F.size(F.split(c, "\n", -1)) > int(a))
    if name == "max_line":
        return _lines_that(df, key, text, rule, lambda x: F.char_length(x) > int(a))
    if name == "max_subject":
        return _whole(df, key, text, rule, F.char_length(F.element_at(F.split(c, "\n", -1), 1)) > int(a))
    if name == "conventional":
        return _whole(df, key, text, rule, ~c.rlike(CONVENTIONAL))
    raise ValueError(f"unknown rule {name}")


def max_function_lines(defs: DataFrame, limit: int) -> DataFrame:
    return defs.filter(F.col("end_line") - F.col("start_line") + 1 > limit)


def scan(df: DataFrame, key: str, text: str, rules: list[str]) -> DataFrame:
    """The violations of all rules."""
    return reduce(DataFrame.unionByName, (check(df, key, text, r) for r in rules))


def scan_page(violations: DataFrame, key: str, offset: int = 0) -> tuple[DataFrame, int]:
    """The ``PAGE`` violations from ``offset`` on, by key, rule and line, with their ``place`` from 1; and how many there
    are in all. Equal ones go by their text."""
    order = [key, "rule", "line_no", "text"]
    counted = violations.groupBy(*order).agg(F.count("*").alias("__n"))  # a line may break a rule twice
    placed = checkpointed(running(counted, [], order, F.col("__n"), "__before", "__all"))
    total = placed.agg(F.max("__all")).first()[0] or 0
    near = placed.filter((F.col("__before") < offset + PAGE) & (F.col("__before") + F.col("__n") > offset))
    each = near.withColumn("place", F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__n"))))
    return each.filter((F.col("place") > offset) & (F.col("place") <= offset + PAGE)).select(*order, "place"), total


def added(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Violations after that weren't there before, as a multiset by text: moved ones aren't new."""
    return after.select(key, "rule", "text").exceptAll(before.select(key, "rule", "text"))


def in_scope(path: Column, scope: str) -> Column:
    """``dir/`` holds what is under it, anything else is one path."""
    return F.startswith(path, F.lit(scope)) if scope.endswith("/") else path == scope
