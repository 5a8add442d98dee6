"""Text search, substring occurrences and the shaping of hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import structured
from korrel.operators import text as T
from korrel.queries.registry import query
from korrel.session import load

#: DuckDB: the lines of documents, numbered, without an empty one behind a final line end.
LINES = r"""l AS (SELECT doc_id, i AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE NOT (i = len(parts) AND parts[i] = ''))"""


#: Documents with a line more, so that scans for remarks and failures have something to find.
PLANTED = "planted AS (SELECT doc_id, text || chr(10) || CASE doc_id % 3 WHEN 0 THEN '// TODO: mend' WHEN 1 THEN '# a remark' ELSE 'panic: it failed' END AS text FROM documents)"
PLANTED_LINES = f"{PLANTED}, {LINES.replace('FROM documents)', 'FROM planted)')}"


def planted(spark, sf_dir):
    kind = F.col("doc_id") % 3
    line = F.when(kind == 0, "// TODO: mend").when(kind == 1, "# a remark").otherwise("panic: it failed")
    return load(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), line).alias("text"))


@query("text_literal", f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(instr(line, 'the of') AS INT) AS \"column\", line FROM l WHERE instr(line, 'the of') > 0")
def literal(spark, sf_dir):
    return T.search_lines(load(spark, sf_dir, "documents"), "doc_id", "text", "the of")


@query("text_alternation", f"""WITH {LINES}, h AS (SELECT doc_id, line_no, line, list_min(list_filter([instr(line, 'idiot'), instr(line, 'clown')], lambda x: x > 0)) AS c FROM l)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(c AS INT) AS "column", line FROM h WHERE c > 0""")
def alternation(spark, sf_dir):
    return T.search_lines(load(spark, sf_dir, "documents"), "doc_id", "text", "idiot|clown")


@query("text_regex", f"""WITH {LINES}, h AS (SELECT doc_id, line_no, line, regexp_extract(line, '[A-Z][a-z]+ the [a-z]+ing') AS m FROM l)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(instr(line, m) AS INT) AS "column", line FROM h WHERE m <> ''""")
def regex(spark, sf_dir):
    return T.search_lines(load(spark, sf_dir, "documents"), "doc_id", "text", "[A-Z][a-z]+ the [a-z]+ing", regex=True)


@query("text_exact_total", f"WITH {LINES} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, CAST(least(count(*), 200) AS BIGINT) AS shown FROM l WHERE instr(line, ' of ') > 0")
def exact_total(spark, sf_dir):
    """All hits are counted, however few are shown."""
    hits = T.search_lines(load(spark, sf_dir, "documents"), "doc_id", "text", " of ")
    return hits.agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("docs")).withColumn("shown", F.least("total", F.lit(T.SHOWN).cast("long")))


@query("text_trigrams", "SELECT gram, CAST(count(*) AS BIGINT) AS items FROM (SELECT DISTINCT item_id, substring(text, i, 3) AS gram FROM benchmark, LATERAL (SELECT unnest(range(1, length(text) - 1)) AS i)) GROUP BY gram")
def trigram_postings(spark, sf_dir):
    return T.postings(load(spark, sf_dir, "benchmark"), "item_id", "text").groupBy("gram").agg(F.count("*").alias("items"))


@query("text_trigram_candidates", "SELECT item_id FROM benchmark WHERE contains(text, 'ation') OR contains(text, 'ente ')")
def trigram_candidates(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark")
    found = T.candidates(T.postings(rows, "item_id", "text"), "item_id", ["ation", "ente "])
    return rows.join(found, "item_id", "left_semi").filter(F.col("text").contains("ation") | F.col("text").contains("ente ")).select("item_id")


@query("text_occurrences", "SELECT doc_id, CAST((length(t) - length(replace(t, 'tion', ''))) // 4 AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'tion')")
def occurrences(spark, sf_dir):
    return T.tally(load(spark, sf_dir, "documents"), "doc_id", "text", "TION")


@query("text_overlapping", "SELECT item_id, CAST(count(*) AS BIGINT) AS hits FROM (SELECT item_id, unnest(range(1, length(t) - 1)) AS i, t FROM (SELECT item_id, lower(text) AS t FROM benchmark)) WHERE substring(t, i, 3) = 'ana' GROUP BY item_id")
def overlapping(spark, sf_dir):
    return T.tally(load(spark, sf_dir, "benchmark"), "item_id", "text", "ana")


@query("text_top_files", "SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) // 3 AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'the') ORDER BY hits DESC, doc_id LIMIT 20")
def top_files(spark, sf_dir):
    return T.top(T.tally(load(spark, sf_dir, "documents"), "doc_id", "text", "the"), "doc_id")


@query("text_rank_groups", f"""WITH {LINES}, h AS (SELECT doc_id, line_no, CASE WHEN line LIKE 'The%' THEN 0 ELSE 2 END AS rank, CASE WHEN line LIKE '%,%' THEN 'comment' ELSE 'code' END AS kind FROM l WHERE instr(line, 'ing') > 0),
g AS (SELECT doc_id, rank, kind, CAST(count(*) AS BIGINT) AS hits, CAST(min(line_no) AS INT) AS first_line FROM h GROUP BY ALL)
SELECT *, CAST(sum(hits) OVER (PARTITION BY doc_id) AS BIGINT) AS file_hits FROM g""")
def rank(spark, sf_dir):
    hits = T.search_lines(load(spark, sf_dir, "documents"), "doc_id", "text", "ing")
    return T.rank_groups(hits, "doc_id", F.col("line").startswith("The"), F.when(F.col("line").contains(","), "comment").otherwise("code"))


@query("text_page_groups", """WITH h AS (SELECT doc_id, CAST((length(t) - length(replace(t, 'idiot', ''))) // 5 AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'idiot')),
n AS (SELECT *, row_number() OVER (ORDER BY hits DESC, doc_id) AS place FROM h), p AS (SELECT *, sum(hits + 3) OVER (ORDER BY place) AS spent FROM n WHERE place > 2)
SELECT doc_id, hits, CAST(place AS INT) AS place, CAST(spent AS BIGINT) AS spent FROM p WHERE spent <= 60 OR place = 3""")
def paging(spark, sf_dir):
    groups = T.tally(load(spark, sf_dir, "documents"), "doc_id", "text", "idiot")
    return T.page(groups, [F.desc("hits"), F.col("doc_id")], F.col("hits") + 3, 60, 2)


@query("text_snippet", r"""SELECT item_id, CASE WHEN n <= 120 THEN text ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END) || substring(text, s, 120) || (CASE WHEN s + 120 <= n THEN '…' ELSE '' END) END AS snippet
FROM (SELECT *, least(greatest(1, c - 58), greatest(1, n - 119)) AS s FROM (SELECT item_id, text, length(text) AS n, instr(text, 'en') AS c FROM benchmark WHERE contains(text, 'en') AND NOT contains(text, chr(10))))""")
def snippets(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark").filter(F.col("text").contains("en") & ~F.col("text").contains("\n"))
    return rows.select("item_id", T.snippet(F.col("text"), F.instr("text", "en"), 3).alias("snippet"))


@query("text_legend", f"WITH {LINES} SELECT line, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY line HAVING count(*) > 1")
def repeated_lines(spark, sf_dir):
    return T.legend(T.lines(load(spark, sf_dir, "documents"), "doc_id", "text"))


@query("text_scope", "SELECT page_id FROM pages WHERE lower(split_part(split_part(url, '://', 2), '?', 1)) LIKE lower(split_part((SELECT split_part(url, '://', 2) FROM pages WHERE page_id = 0), '/', 1)) || '/%'")
def scope(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)).alias("path"))
    host = rows.filter("page_id = 0").first()["path"].split("/")[0]
    return rows.filter(T.in_scope(F.col("path"), host.upper())).filter(F.lower("path") != host.lower()).select("page_id")


@query("text_exclusions", "SELECT CAST(count(*) AS BIGINT) AS listed, CAST(count(*) FILTER (WHERE length(text) > 5000) AS BIGINT) AS too_large, CAST(count(*) FILTER (WHERE length(text) <= 5000 AND contains(text, '%%%')) AS BIGINT) AS noise FROM documents")
def exclusions(spark, sf_dir):
    large, noise = F.char_length("text") > 5000, F.col("text").contains("%%%")
    return load(spark, sf_dir, "documents").agg(F.count("*").alias("listed"), F.count_if(large).alias("too_large"), F.count_if(~large & noise).alias("noise"))


@query("text_vocabulary", "SELECT item_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'))) AS INT) AS words FROM benchmark")
def vocabulary(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(T.vocabulary(F.col("text"))).alias("words"))


@query("text_token_estimate", r"SELECT doc_id, CAST(ceil(length(text) / CASE WHEN length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) / greatest(length(text), 1) >= 0.18 THEN 3.2 ELSE 3.8 END) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("text_minified", "SELECT page_id, octet_length(encode(html)) >= 4096 AND octet_length(encode(html)) / len(string_split(html, chr(10))) > 400 AS minified FROM pages")
def minified(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.minified(F.col("url"), F.col("html")).alias("minified"))


@query("text_escapes", "SELECT doc_id, text AS clean FROM documents")
def escapes(spark, sf_dir):
    """Coloured texts come back as they were."""
    coloured = F.concat(F.lit("\x1b[31m"), "text", F.lit("\x1b[0m"))
    return load(spark, sf_dir, "documents").select("doc_id", T.strip_escapes(coloured).alias("clean"))


@query("text_log_digest", f"WITH {PLANTED_LINES} SELECT doc_id, CAST(count(*) AS BIGINT) AS failures FROM l WHERE regexp_matches(line, '(?i)\\b(error|fail(ed|ure)?|panic|exception|assert|traceback)\\b') GROUP BY doc_id")
def log_digest(spark, sf_dir):
    rows = T.lines(planted(spark, sf_dir), "doc_id", "text")
    return rows.filter(T.failures(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("failures"))


@query("text_fuzzy_locate", "SELECT item_id, position((SELECT substring(text, 11, 30) FROM benchmark WHERE item_id = 3) IN text) > 0 AS found FROM benchmark")
def fuzzy(spark, sf_dir):
    """Which items have a passage that stands in one of them, spaced otherwise."""
    rows = load(spark, sf_dir, "benchmark")
    passage = rows.filter("item_id = 3").first()["text"][10:40].replace(" ", "  \n ")
    return rows.select("item_id", (T.locate_unique(F.col("text"), passage) > 0).alias("found"))


@query("text_spans", """WITH w AS (SELECT item_id, i * 10 AS o FROM benchmark, LATERAL (SELECT unnest(range(0, 8)) AS i)), s AS (SELECT item_id, 0 AS a, 60 AS b, 'outer' AS symbol FROM benchmark UNION ALL SELECT item_id, 20, 35, 'inner' FROM benchmark)
SELECT item_id, CAST(o AS INT) AS "offset", CASE WHEN o >= 60 THEN NULL WHEN o >= 20 AND o < 35 THEN 'string' ELSE 'code' END AS kind, CASE WHEN o >= 60 THEN NULL WHEN o >= 20 AND o < 35 THEN 'inner' ELSE 'outer' END AS symbol FROM w""")
def spans(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select("item_id")
    places = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(70), F.lit(10))).alias("offset"))
    found = items.select("item_id", F.inline(F.expr("array(named_struct('start', 0, 'end', 60, 'kind', 'code', 'symbol', 'outer'), named_struct('start', 20, 'end', 35, 'kind', 'string', 'symbol', 'inner'))")))
    return T.spans_at(places, found, "item_id")


@query("text_condense", "SELECT p_brand AS old, p_type AS new, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def condense(spark, sf_dir):
    return T.condensed(load(spark, sf_dir, "part").select(F.col("p_brand").alias("old"), F.col("p_type").alias("new")), "old", "new")


@query("source_sniff", "SELECT 'utf8' AS encoding, CAST(count(*) AS BIGINT) AS n FROM benchmark UNION ALL SELECT 'utf16le', count(*) FROM benchmark UNION ALL SELECT 'binary', count(*) FROM benchmark")
def sniff(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark")
    forms = [F.encode("text", "UTF-8"), F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")), F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("00")))]
    every = rows.select(F.explode(F.array(*forms)).alias("data"))
    return every.groupBy(T.sniff(F.col("data")).alias("encoding")).agg(F.count("*").alias("n"))


@query("source_json_keys", "SELECT 'k' AS pointer, CAST(count(*) AS BIGINT) AS n FROM events")
def json_keys(spark, sf_dir):
    return structured.json_keys(load(spark, sf_dir, "events"), "props").groupBy("pointer").agg(F.count("*").alias("n"))


@query("source_json_pointer", "SELECT event_id, json_extract_string(props, '/k') AS value FROM events")
def json_pointer(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", structured.json_pointer(F.col("props"), "/k").alias("value"))


@query("source_markdown_sections", "SELECT c_custkey, 'Top' AS heading, 1 AS level, 2 AS lines FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 2, 3 FROM customer")
def markdown(spark, sf_dir):
    text = F.concat(F.lit("# Top\nfirst\n## "), "c_mktsegment", F.lit("\nsecond\nthird\n"))
    return structured.markdown_sections(load(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("source_trx", "SELECT c_custkey, 'clinic.Visits' AS suite, 'adds' AS name, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'passed' END AS result FROM customer")
def trx(spark, sf_dir):
    outcome = F.when(F.col("c_acctbal") < 0, "Failed").otherwise("Passed")
    report = F.concat(F.lit('<TestRun xmlns="urn:t"><Results><UnitTestResult testName="clinic.Visits.adds" outcome="'), outcome, F.lit('"/></Results></TestRun>'))
    return structured.trx_cases(load(spark, sf_dir, "customer").select("c_custkey", report.alias("xml")), "c_custkey", "xml")


@query("source_unittest", "SELECT c_custkey, 'visits.Adding' AS suite, n AS name, CASE WHEN n = 'test_b' THEN 'skipped' WHEN c_acctbal < 0 THEN 'failed' ELSE 'passed' END AS result FROM customer, (VALUES ('test_a'), ('test_b')) t(n)")
def unittest(spark, sf_dir):
    state = F.when(F.col("c_acctbal") < 0, "FAIL").otherwise("ok")
    said = F.concat(F.lit("test_a (visits.Adding.test_a) ... "), state, F.lit("\ntest_b (visits.Adding) ... skipped 'why'\n\nRan 2 tests\n"))
    return structured.unittest_cases(load(spark, sf_dir, "customer").select("c_custkey", said.alias("text")), "c_custkey", "text")


@query("source_test_reports", "SELECT c_custkey, 'a' AS name, 'passed' AS before, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'passed' END AS after, CASE WHEN c_acctbal < 0 THEN 'broken' ELSE 'same' END AS verdict FROM customer")
def test_reports(spark, sf_dir):
    report = "<testsuite><testcase classname='m' name='a'>{}</testcase></testsuite>"
    rows = load(spark, sf_dir, "customer")
    before = structured.junit_cases(rows.select("c_custkey", F.lit(report.format("")).alias("xml")), "c_custkey", "xml")
    after = structured.junit_cases(rows.select("c_custkey", F.when(F.col("c_acctbal") < 0, report.format("<failure message='x'>y</failure>")).otherwise(report.format("")).alias("xml")), "c_custkey", "xml")
    return structured.judge(before, after, "c_custkey")


@query("source_coverage", "SELECT event_id, 'f' AS function, CASE WHEN value > 0 THEN 'called' ELSE 'not_called' END AS state FROM events")
def coverage(spark, sf_dir):
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("f").alias("functionName"), F.array(F.struct(F.lit(0).alias("startOffset"), F.lit(9).alias("endOffset"), F.when(F.col("value") > 0, 1).otherwise(0).alias("count"))).alias("ranges"))).alias("functions")))
    return structured.coverage(load(spark, sf_dir, "events").select("event_id", doc.alias("json")), "event_id", "json")


@query("text_kind_filter", "SELECT item_id, 'comment' AS kind, CAST(NULL AS BIGINT) AS removed FROM benchmark WHERE item_id % 3 = 1 UNION ALL SELECT NULL, kind, CAST(count(*) AS BIGINT) FROM (SELECT CASE item_id % 3 WHEN 0 THEN 'code' ELSE 'string' END AS kind FROM benchmark WHERE item_id % 3 <> 1) GROUP BY kind")
def kind_filter(spark, sf_dir):
    """The hits that stay, and how many of which kind went."""
    hits = load(spark, sf_dir, "benchmark").select("item_id", F.element_at(F.array(*map(F.lit, ("code", "comment", "string"))), (F.col("item_id") % 3 + 1).cast("int")).alias("kind"))
    kept, removed = T.filter_kinds(hits, "comment")
    return kept.withColumn("removed", F.lit(None).cast("long")).unionByName(removed, allowMissingColumns=True)


_NESTED = """'{"a":{"0":"o' || event_id || '","it''s":[1,{"~":2}]},"b":[10,{"1":null}]}'"""


@query("source_json_pointer_edges", """SELECT event_id, 'o' || event_id AS object_key, '10' AS place, '2' AS quoted, CAST(NULL AS VARCHAR) AS none FROM events""")
def json_pointer_edges(spark, sf_dir):
    """Numbers as keys of objects and places of arrays, keys with quotes, and what isn't there."""
    rows = load(spark, sf_dir, "events").select("event_id", F.expr(_NESTED.replace("''", "\\'")).alias("j"))
    at = lambda p: structured.json_pointer(F.col("j"), p)
    return rows.select("event_id", at("/a/0").alias("object_key"), at("/b/0").alias("place"), at("/a/it's/1/~0").alias("quoted"), at("/b/01").alias("none"))


@query("text_normalized", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain, CAST(1 AS INT) AS at FROM benchmark WHERE NOT contains(text, '#') AND NOT contains(text, '//') AND NOT contains(text, '/*')")
def normalized(spark, sf_dir):
    """A comment over two lines between two words is no part of a text."""
    rows = load(spark, sf_dir, "benchmark").filter(~F.contains("text", F.lit("#")) & ~F.contains("text", F.lit("//")) & ~F.contains("text", F.lit("/*")))
    return rows.select("item_id", T.normalized(F.concat(F.lit("/* one\n two */"), "text", F.lit("// end"))).alias("plain"), F.lit(1).alias("at"))
