"""Searches of kept indexes, and searches that give up."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import text as T
from korrel.operators.indexes import SuffixIndex, TrigramIndex
from korrel.queries.registry import query
from korrel.queries.text import LINES
from korrel.session import load

_LONG = "repeat('a', 400) || 'b'"
_ENDLESS = f"planted AS (SELECT doc_id, text || CASE WHEN doc_id % 100 = 7 THEN chr(10) || {_LONG} ELSE '' END AS text FROM documents)"


@query("text_regex_budget", f"""WITH {_ENDLESS}, {LINES.replace('FROM documents)', 'FROM planted)')}, h AS (SELECT *, line = {_LONG} AS endless, regexp_extract(line, '(a|aa)+\\.?$') AS m FROM l)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN NOT endless THEN CAST(length(line) - length(m) + 1 AS INT) END AS "column", CASE WHEN endless THEN 'not_searched' ELSE 'match' END AS outcome, line FROM h WHERE endless OR m <> ''""")
def budget(spark, sf_dir):
    """Some lines make the pattern try two to the hundredth ways; they are told apart from those without a match."""
    tail = F.when(F.col("doc_id") % 100 == 7, F.concat(F.lit("\n"), F.repeat(F.lit("a"), 400), F.lit("b"))).otherwise("")
    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))
    return T.search_within(rows, "doc_id", "text", r"(a|aa)+\.?$", 0.5)


def _positions(literal: str) -> str:
    return f"p AS (SELECT doc_id, unnest(range(1, length(t) + 1)) AS pos, t FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, '{literal}')), h AS (SELECT doc_id, pos FROM p WHERE substring(t, pos, {len(literal)}) = '{literal}')"


@query("text_find_places", f"WITH {_positions('ouou')} SELECT doc_id AS key, CAST(pos AS INT) AS at FROM h ORDER BY doc_id, pos LIMIT 40")
def places(spark, sf_dir):
    return SuffixIndex.build(load(spark, sf_dir, "documents"), "doc_id", "text").first("OUou")


@query("text_find_tally", f"WITH {_positions('ana')} SELECT doc_id AS key, CAST(count(*) AS BIGINT) AS hits FROM h GROUP BY doc_id")
def tally(spark, sf_dir):
    return SuffixIndex.build(load(spark, sf_dir, "documents"), "doc_id", "text").tally("ana")


@query("text_trigram_index", "SELECT doc_id AS key FROM documents WHERE doc_id % 7 <> 3 AND (contains(text, 'ation') OR contains(text, 'ente '))")
def trigram_index(spark, sf_dir):
    """Two segments, some rows taken out of the first and one of those added again; then what the texts really have."""
    docs = load(spark, sf_dir, "documents")
    index = TrigramIndex(spark)
    index.add(docs.filter("doc_id % 2 = 0"), "doc_id", "text")
    index.remove(docs.filter("doc_id % 7 = 3 or doc_id % 14 = 0"), "doc_id")
    index.add(docs.filter("doc_id % 2 = 1 and doc_id % 7 <> 3 or doc_id % 14 = 0"), "doc_id", "text")
    found = docs.join(index.candidates(["ation", "ente "]), F.col("doc_id") == F.col("key"), "left_semi")
    return found.filter(F.col("text").contains("ation") | F.col("text").contains("ente ")).select(F.col("doc_id").alias("key"))
