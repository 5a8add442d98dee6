"""Structured texts as rows: JSON keys and pointers, Markdown sections, test reports, coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.operators.text import lines


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """(pointer): the top-level keys of each row's object; none where it isn't one."""
    return df.select(F.explode(F.json_object_keys(column)).alias("pointer"))


def _step(c: Column, key: str) -> Column:
    """What an object has under ``key``, or an array at that place."""
    if not re.fullmatch(r"[\w -]+", key):  # no path can name it
        return F.try_element_at(F.from_json(c, "map<string,string>"), F.lit(key))
    own = F.get_json_object(c, f"$['{key}']")
    return F.coalesce(F.get_json_object(c, f"$[{key}]"), own) if re.fullmatch(r"0|[1-9][0-9]*", key) else own


def json_pointer(c: Column, pointer: str) -> Column:
    """The text at an RFC 6901 pointer, step by step: a number is a place in an array and a key of an object."""
    for step in pointer.split("/")[1:]:
        c = _step(c, step.replace("~1", "/").replace("~0", "~"))
    return c


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, level, lines): each heading with the lines up to the next; fences hide headings."""
    rows = lines(df, key, text)
    order = Window.partitionBy(key).orderBy("line_no")
    fence = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(order) % 2 == 1
    mark = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    rows = rows.withColumn("level", F.when(~fence & (mark != ""), F.length(mark)))
    rows = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(order)).filter("section > 0")
    found = rows.groupBy(key, "section").agg(F.min_by("line", "line_no").alias("line"), F.max("level").alias("level"), F.count("*").cast("int").alias("lines"))
    return found.select(key, F.regexp_replace("line", r"^#+\s+|\s+#*\s*$", "").alias("heading"), "level", "lines")


_CASE = "testcase array<struct<_classname:string,_name:string,failure:array<struct<_message:string,_VALUE:string>>,error:array<struct<_message:string,_VALUE:string>>,skipped:array<string>>>"
_SUITES = f"{_CASE}, testsuite array<struct<{_CASE.replace('testcase ', 'testcase:', 1)}>>"


def junit_cases(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, suite, name, result) from JUnit reports: a suite, or suites below a common root."""
    found = F.from_xml(xml, _SUITES)
    none = F.array().cast(df.select(found["testcase"]).schema[0].dataType)
    below = F.flatten(F.transform(F.coalesce(found["testsuite"], F.array().cast(df.select(found["testsuite"]).schema[0].dataType)), lambda x: F.coalesce(x["testcase"], none)))
    rows = df.select(key, F.explode(F.concat(F.coalesce(found["testcase"], none), below)).alias("c"))
    result = F.when(F.size("c.failure") > 0, "failed").when(F.size("c.error") > 0, "failed").when(F.size("c.skipped") > 0, "skipped").otherwise("passed")
    return rows.select(key, F.col("c._classname").alias("suite"), F.col("c._name").alias("name"), result.alias("result"))


_TRX = "Results struct<UnitTestResult:array<struct<_testName:string,_outcome:string>>>"


def trx_cases(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, suite, name, result) from TRX reports; the suite is what the name has before its last dot."""
    found = F.from_xml(xml, _TRX, {"ignoreNamespace": "true"})["Results"]["UnitTestResult"]
    rows = df.select(key, F.explode(found).alias("c"))
    outcome = F.lower("c._outcome")
    result = F.when(outcome == "passed", "passed").when(outcome.isin("notexecuted", "inconclusive", "pending"), "skipped").otherwise("failed")
    name = F.col("c._testName")
    return rows.select(key, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("suite"), F.substring_index(name, ".", -1).alias("name"), result.alias("result"))


def unittest_cases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, suite, name, result) from the lines that a verbose unittest run prints."""
    said = r"^(\w+) \(([\w.<>]+)\).* \.\.\. (ok|FAIL|ERROR|skipped|expected failure|unexpected success)"
    rows = lines(df, key, text).withColumn("state", F.regexp_extract("line", said, 3)).filter("state <> ''")
    result = F.when(F.col("state").isin("ok", "expected failure"), "passed").when(F.col("state") == "skipped", "skipped").otherwise("failed")
    name, place = F.regexp_extract("line", said, 1), F.regexp_extract("line", said, 2)
    # newer versions print the test's own name behind its class
    return rows.select(key, F.when(place.endswith(F.concat(F.lit("."), name)), F.substring(place, F.lit(1), F.length(place) - F.length(name) - 1)).otherwise(place).alias("suite"), name.alias("name"), result.alias("result"))


def judge(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Two runs side by side: what broke, was mended, came, went or stayed."""
    b = before.select(key, "suite", "name", F.col("result").alias("before"))
    a = after.select(key, "suite", "name", F.col("result").alias("after"))
    verdict = (
        F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "same")
        .when(F.col("after") == "failed", "broken").when(F.col("before") == "failed", "mended").otherwise("changed")
    )
    return b.join(a, [key, "suite", "name"], "full").select(key, "name", "before", "after", verdict.alias("verdict"))


_COVERAGE = "functions array<struct<functionName:string,ranges:array<struct<startOffset:int,endOffset:int,count:int>>>>"


def coverage(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, function, state): called, not called, or unknown where there are no ranges."""
    f = F.explode(F.from_json(json, _COVERAGE)["functions"])
    rows = df.select(key, f.alias("f"))
    count = F.element_at("f.ranges", 1)["count"]
    state = F.when(F.size("f.ranges") == 0, "unknown").when(count > 0, "called").otherwise("not_called")
    return rows.select(key, F.col("f.functionName").alias("function"), state.alias("state"))
