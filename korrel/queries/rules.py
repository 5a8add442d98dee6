"""Rule scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import rules as R
from korrel.queries.registry import query
from korrel.queries.text import LINES, PLANTED_LINES, planted
from korrel.session import load


def _scan(name: str, rule: str, where: str) -> None:
    sql = f"WITH {LINES} SELECT doc_id, '{rule.replace(chr(39), chr(39) * 2)}' AS rule, CAST(line_no AS INT) AS line_no, line AS text FROM l WHERE {where}"
    query(f"rule_{name}", sql)(lambda spark, sf_dir: R.check(load(spark, sf_dir, "documents"), "doc_id", "text", rule))


def _remarks(name: str, rule: str, where: str) -> None:
    """As ``_scan``, over documents that have remarks."""
    sql = f"WITH {PLANTED_LINES} SELECT doc_id, '{rule}' AS rule, CAST(line_no AS INT) AS line_no, line AS text FROM l WHERE {where}"
    query(f"rule_{name}", sql)(lambda spark, sf_dir: R.check(planted(spark, sf_dir), "doc_id", "text", rule))


def _whole(name: str, rule: str, where: str) -> None:
    sql = f"SELECT doc_id, '{rule}' AS rule, 1 AS line_no, '' AS text FROM documents WHERE {where}"
    query(f"rule_{name}", sql)(lambda spark, sf_dir: R.check(load(spark, sf_dir, "documents"), "doc_id", "text", rule))


_scan("forbid", "forbid:clown", "contains(line, 'clown')")
_scan("forbid_any_case", "forbid_any_case:IDIOT", "contains(lower(line), 'idiot')")
_scan("forbid_regex", "forbid_regex:[0-9]{3}-[0-9]{2,4}", "regexp_matches(line, '[0-9]{3}-[0-9]{2,4}')")
_remarks("no_todo", "no_todo", r"regexp_matches(line, '(?i)\b(todo|fixme|xxx)\b')")
_remarks("no_comment", "no_comment", r"regexp_matches(line, '^\s*(//|#|/\*|--)')")
_scan("no_literal", "no_literal:string", """regexp_matches(line, '"[^"]*"|''[^'']*''')""")
_scan("max_line", "max_line:400", "length(line) > 400")
_whole("require", "require:the", "NOT contains(text, 'the')")
_whole("require_any_case", "require_any_case:THE", "NOT contains(lower(text), 'the')")
_whole("require_comment", "require_comment", r"NOT regexp_matches(text, '(?m)^\s*(//|#|/\*|--)')")
_whole("max_lines", "max_lines:20", "len(string_split(text, chr(10))) > 20")
_whole("max_subject", "max_subject:72", "length(string_split(text, chr(10))[1]) > 72")
_whole("conventional", "conventional", r"NOT regexp_matches(text, '^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\([^)]+\))?!?: \S')")


@query("rule_forbid_import", "SELECT doc_id, 'forbid_import:os' AS rule, 1 AS line_no, 'import os' AS text FROM documents WHERE doc_id % 7 = 0")
def forbid_import(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "import os\nx").otherwise("import sys").alias("text"))
    return R.check(rows, "doc_id", "text", "forbid_import:os")


@query("rule_max_function_lines", "SELECT p_partkey FROM part WHERE p_size > 40")
def function_lines(spark, sf_dir):
    defs = load(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"))
    return R.max_function_lines(defs, 40).select("p_partkey")


@query("rule_scan", f"WITH {LINES} SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'forbid:idiot' AS rule FROM l WHERE contains(line, 'idiot') UNION ALL SELECT 'forbid:clown' FROM l WHERE contains(line, 'clown') UNION ALL SELECT 'require:the' FROM documents WHERE NOT contains(text, 'the')) GROUP BY 1")
def scan(spark, sf_dir):
    found = R.scan(load(spark, sf_dir, "documents"), "doc_id", "text", ["forbid:idiot", "forbid:clown", "require:the"])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("rule_scan_page", f"WITH {LINES}, v AS (SELECT doc_id, 'forbid:the' AS rule, CAST(line_no AS INT) AS line_no, line AS text FROM l WHERE contains(line, 'the') UNION ALL SELECT doc_id, 'require:ation', 1, '' FROM documents WHERE NOT contains(text, 'ation')), n AS (SELECT *, row_number() OVER (ORDER BY doc_id, rule, line_no, text) AS place, count(*) OVER () AS found FROM v) SELECT * FROM n WHERE place > 100 AND place <= 200")
def page(spark, sf_dir):
    """The second page of what a scan finds, and how much that is."""
    rows, found = R.scan_page(R.scan(load(spark, sf_dir, "documents"), "doc_id", "text", ["forbid:the", "require:ation"]), "doc_id", R.PAGE)
    return rows.withColumn("found", F.lit(found).cast("long"))


@query("rule_added", f"WITH {LINES} SELECT doc_id, 'forbid:idiot' AS rule, 'idiot' AS text FROM documents")
def added(spark, sf_dir):
    """Texts that got one line more; their lines moved down, which adds nothing."""
    before = load(spark, sf_dir, "documents").select("doc_id", "text")
    after = before.withColumn("text", F.concat(F.lit("idiot\n"), "text"))
    return R.added(R.check(before, "doc_id", "text", "forbid:idiot"), R.check(after, "doc_id", "text", "forbid:idiot"), "doc_id")


@query("rule_scope", "SELECT doc_id FROM documents WHERE source = 'src1'")
def scope(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"))
    return rows.filter(R.in_scope(F.col("path"), "src1/")).select("doc_id")
