"""Facts extracted from pages, and patterns over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import extract as E
from korrel.operators import rules
from korrel.queries.registry import query
from korrel.session import load

_BREAKS = "(length({x}) - length(replace({x}, chr(10), '')))"
#: Tags by a plain reading: marks, partners of one name, then levels of all together.
_NODES = f"""t AS (SELECT page_id, unnest(regexp_extract_all(html, '{E.TAGS}')) AS mark, unnest(regexp_split_to_array(html, '{E.TAGS}')) AS gap, unnest(range(len(regexp_extract_all(html, '{E.TAGS}')) + 1)) AS k FROM pages),
m AS (SELECT page_id, CAST(k AS INT) AS k, mark, CAST(coalesce(sum(length(mark) + length(gap)) OVER w, 0) + length(gap) AS INT) AS start, CAST(coalesce(sum({_BREAKS.format(x='mark')} + {_BREAKS.format(x='gap')}) OVER w, 0) + {_BREAKS.format(x='gap')} + 1 AS INT) AS line,
  CASE WHEN starts_with(mark, '<!--') THEN 'comment' ELSE lower(regexp_extract(mark, '^</?([A-Za-z][^\\s/>]*)', 1)) END AS kind, CASE WHEN starts_with(mark, '</') THEN -1 ELSE 1 END AS step FROM t WHERE mark IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, kind IN ('comment', 'script', 'style') OR ends_with(mark, '/>') AS lone FROM m),
p1 AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY page_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (step + 1) // 2 AS lv FROM l WHERE NOT lone),
p2 AS (SELECT page_id, k FROM p1 QUALIFY CASE WHEN step = 1 THEN lead(step) OVER (PARTITION BY page_id, kind, lv ORDER BY k) = -1 ELSE lag(step) OVER (PARTITION BY page_id, kind, lv ORDER BY k) = 1 END),
q1 AS (SELECT l.*, sum(step) OVER (PARTITION BY page_id ORDER BY k) AS up FROM l JOIN p2 USING (page_id, k)),
q2 AS (SELECT o.page_id, o.k, o.mark, o.kind, o.start, o.line, o.up AS lv, c.start + length(c.mark) AS "end", c.line AS end_line FROM q1 o ASOF JOIN (SELECT *, up + 1 AS up1 FROM q1 WHERE step = -1) c ON c.page_id = o.page_id AND c.up1 = o.up AND c.k > o.k WHERE o.step = 1),
n AS (SELECT * FROM q2 UNION ALL SELECT page_id, k, mark, kind, start, line, NULL, start + length(mark), line + {_BREAKS.format(x='mark')} FROM l WHERE (page_id, k) NOT IN (SELECT page_id, k FROM p2) AND (lone OR step = 1)),
d AS (SELECT n.*, (SELECT count(*) FROM q2 o WHERE o.page_id = n.page_id AND o.start < n.start AND n.start < o."end") AS depth, (SELECT max(o.k) FROM q2 o WHERE o.page_id = n.page_id AND o.start < n.start AND n.start < o."end") AS parent FROM n)"""
_ATTRIBUTE = """CASE WHEN regexp_matches(mark, '(?is)^<[^>]*?\\s{a}\\s*=\\s*(?:"([^">]*)"|''([^''>]*)''|([^\\s"''>]+))') THEN regexp_extract(mark, '(?is)^<[^>]*?\\s{a}\\s*=\\s*(?:"([^">]*)"|''([^''>]*)''|([^\\s"''>]+))', 1) || regexp_extract(mark, '(?is)^<[^>]*?\\s{a}\\s*=\\s*(?:"([^">]*)"|''([^''>]*)''|([^\\s"''>]+))', 2) || regexp_extract(mark, '(?is)^<[^>]*?\\s{a}\\s*=\\s*(?:"([^">]*)"|''([^''>]*)''|([^\\s"''>]+))', 3) END"""


@query("facts_extract", f"""WITH {_NODES} SELECT page_id AS file_id, k AS slot, kind, coalesce({_ATTRIBUTE.format(a='id')}, {_ATTRIBUTE.format(a='class')}) AS name, start, CAST("end" AS INT) AS "end", line, CAST(end_line AS INT) AS end_line, CAST(depth AS INT) AS depth, CAST(parent AS INT) AS parent FROM d""")
def extract(spark, sf_dir):
    return E.facts(load(spark, sf_dir, "pages"), "page_id", "html")[0]


@query("facts_extract_uses", f"""WITH {_NODES}, u AS (SELECT *, 'href' AS use, {_ATTRIBUTE.format(a='href')} AS name FROM d UNION ALL SELECT *, 'src', {_ATTRIBUTE.format(a='src')} FROM d) SELECT page_id AS file_id, k AS idx, CAST(parent AS INT) AS from_slot, use AS kind, name, start, line FROM u WHERE name IS NOT NULL AND kind <> 'comment'""")
def uses(spark, sf_dir):
    return E.facts(load(spark, sf_dir, "pages"), "page_id", "html")[1]


@query("facts_brackets", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS pos FROM documents),
m AS (SELECT doc_id, pos, translate(ch, ')]}', '([{') AS kind, CASE WHEN ch IN ('(', '[', '{') THEN 1 ELSE -1 END AS step FROM c WHERE ch IN ('(', ')', '[', ']', '{', '}')),
l AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (step + 1) // 2 AS lv FROM m),
p AS (SELECT *, CASE WHEN step = 1 THEN lead(step) OVER s = -1 ELSE lag(step) OVER s = 1 END AS whole FROM l WINDOW s AS (PARTITION BY doc_id, kind, lv ORDER BY pos))
SELECT doc_id, kind, CAST(count(*) FILTER (step = 1) AS BIGINT) AS spans FROM p WHERE step = 1 GROUP BY doc_id, kind""")
def brackets(spark, sf_dir):
    """How many brackets open in each document, whether or not they close."""
    return E.brackets(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("spans"))


RULE = '(ul (li (a) @violation) (#match? @violation "[A-Z]") (#not-match? @violation "</li>"))'


@query("rule_query", f"""WITH {_NODES}, s AS (SELECT a.page_id, a.line AS line_no, substr(html, a.start + 1, a."end" - a.start) AS text, a.start, a."end" FROM d a JOIN d b ON b.page_id = a.page_id AND b.k = a.parent AND b.kind = 'li' JOIN d c ON c.page_id = b.page_id AND c.k = b.parent AND c.kind = 'ul' JOIN pages ON pages.page_id = a.page_id WHERE a.kind = 'a')
SELECT page_id, 'q:{RULE}' AS rule, line_no, text FROM (SELECT DISTINCT * FROM s) WHERE regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '</li>')""")
def rule_query(spark, sf_dir):
    return rules.check(load(spark, sf_dir, "pages"), "page_id", "html", f"q:{RULE}")
