"""Relevance ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import ranking as R
from korrel.queries.registry import query
from korrel.session import load

#: DuckDB: the simple terms of documents (their words have no compounds; words with digits are left out in both).
_TERMS = "w AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM benchmark)"
QUESTION = ["the", "ation", "de", "ente", "des"]


def _plain(spark, sf_dir):
    """Benchmark texts with letters only."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("text"))


_KEPT = f"{_TERMS}, t AS (SELECT item_id, term FROM w WHERE length(term) BETWEEN 2 AND 64), n AS (SELECT item_id, count(*) AS size FROM t GROUP BY 1), a AS (SELECT (SELECT count(*) FROM benchmark) AS n_docs, greatest((SELECT sum(size) FROM n) / (SELECT count(*) FROM benchmark), 1.0) AS mean), f AS (SELECT item_id, term, count(*) AS tf FROM t WHERE term IN ('the', 'ation', 'de', 'ente', 'des') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)"


@query("rank_terms", f"WITH {_TERMS} SELECT item_id, term, CAST(count(*) AS BIGINT) AS tf FROM w WHERE length(term) BETWEEN 2 AND 64 GROUP BY 1, 2")
def term_frequencies(spark, sf_dir):
    return R.frequencies(_plain(spark, sf_dir), "item_id", "text").drop("size")


@query("rank_bm25", f"WITH {_KEPT} SELECT item_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM f JOIN d USING (term) JOIN n USING (item_id), a GROUP BY 1")
def bm25(spark, sf_dir):
    return R.bm25(_plain(spark, sf_dir), "item_id", "text", QUESTION).select("item_id", F.round("score", 6).alias("score"))


@query("rank_bm25_top", f"WITH {_KEPT}, s AS (SELECT item_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM f JOIN d USING (term) JOIN n USING (item_id), a GROUP BY 1) SELECT * FROM s ORDER BY score DESC, item_id LIMIT 10")
def bm25_top(spark, sf_dir):
    return bm25(spark, sf_dir).orderBy(F.desc("score"), "item_id").limit(10)


@query("rank_bm25_ceiling", f"WITH {_KEPT} SELECT round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.2), 6) AS ceiling FROM d, a")
def ceiling(spark, sf_dir):
    return R.bm25_ceiling(_plain(spark, sf_dir), "item_id", "text", QUESTION).select(F.round("ceiling", 6).alias("ceiling"))


_FIELDS = "x AS (SELECT o_orderkey AS doc, 'name' AS field, 1 AS line, lower(o_orderstatus) AS term FROM orders UNION ALL SELECT o_orderkey, 'doc', 2, lower(substring(o_orderpriority, 3)) FROM orders UNION ALL SELECT o_orderkey, 'body', CAST(l_linenumber AS INT) + 2, lower(l_returnflag) FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query("rank_fielded", f"""WITH {_FIELDS}, c AS (SELECT * FROM (VALUES ('f', 0), ('p', 0), ('r', 1), ('urgent', 2)) t(term, concept)), g AS (SELECT * FROM (VALUES ('name', 3.0::DOUBLE, 0.3::DOUBLE), ('doc', 1.0, 0.75), ('body', 0.5, 0.75)) t(field, w, b)),
l AS (SELECT doc, field, count(*) AS length FROM x GROUP BY 1, 2), m AS (SELECT field, greatest(avg(length), 1.0) AS mean FROM l GROUP BY 1), z AS (SELECT doc, count(*) AS size FROM x GROUP BY 1), n AS (SELECT count(*) AS n_docs FROM z),
h AS (SELECT x.*, concept FROM x JOIN c USING (term)), f AS (SELECT doc, field, term, concept, count(*) AS tf FROM h GROUP BY 1, 2, 3, 4),
p AS (SELECT doc, term, concept, sum(w * tf / (1 - b + b * length / mean)) AS tf FROM f JOIN l USING (doc, field) JOIN m USING (field) JOIN g USING (field) GROUP BY 1, 2, 3), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT doc, concept, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2) AS s FROM p JOIN d USING (term), n), q AS (SELECT doc, sum(s) AS words FROM (SELECT doc, concept, 0.9 * max(s) + 0.1 * sum(s) AS s FROM s GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT doc, min(CASE WHEN before <> concept THEN line - last END) AS gap FROM (SELECT doc, line, concept, lag(concept) OVER w AS before, lag(line) OVER w AS last FROM (SELECT DISTINCT doc, line, concept FROM h) WINDOW w AS (PARTITION BY doc ORDER BY line, concept)) GROUP BY 1)
SELECT doc, round(words + coalesce(ln(0.3 + exp(-gap)) - ln(0.3), 0) + 0.25 * ln(1 + size), 6) AS score FROM q JOIN o USING (doc) JOIN z USING (doc)""")
def fielded(spark, sf_dir):
    orders, items = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    name = orders.select(F.col("o_orderkey").alias("doc"), F.lit("name").alias("field"), F.lit(1).alias("line"), F.lower("o_orderstatus").alias("term"))
    doc = orders.select(F.col("o_orderkey").alias("doc"), F.lit("doc").alias("field"), F.lit(2).alias("line"), F.lower(F.expr("substring(o_orderpriority, 3)")).alias("term"))
    body = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_orderkey").alias("doc"), F.lit("body").alias("field"), (F.col("l_linenumber") + 2).alias("line"), F.lower("l_returnflag").alias("term"))
    return R.fielded_bm25(name.union(doc).union(body), [["f", "p"], ["r"], ["urgent"]]).select("doc", F.round("score", 6).alias("score"))


def _rounds(n: int) -> str:
    """PageRank unrolled for DuckDB."""
    ctes = ["e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::DOUBLE AS weight FROM supplier JOIN customer ON s_suppkey % 7 = c_custkey % 7 AND s_nationkey <> c_nationkey GROUP BY 1, 2)", "v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "b AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS base FROM v)", "s AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e)", "k AS (SELECT node FROM v WHERE node NOT IN (SELECT src FROM e))", "r0 AS (SELECT node, base AS rank FROM b)"]
    for i in range(n):
        ctes.append(f"r{i + 1} AS (SELECT b.node, 0.15 * base + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node IN (SELECT node FROM k)) * base) AS rank FROM b LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{i} JOIN s ON src = node GROUP BY 1) g ON g.dst = b.node)")
    return f"WITH {', '.join(ctes)} SELECT node, round(rank, 6) AS rank FROM r{n}"


@query("rank_pagerank", _rounds(8))
def pagerank(spark, sf_dir):
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    s = s.groupBy("s_nationkey", (F.col("s_suppkey") % 7).alias("m")).agg(F.count("*").alias("a"))
    c = c.groupBy("c_nationkey", (F.col("c_custkey") % 7).alias("m")).agg(F.count("*").alias("b"))
    edges = s.join(c, "m").filter("s_nationkey <> c_nationkey").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), (F.col("a") * F.col("b")).cast("double").alias("weight"))
    return R.pagerank(edges, iterations=8).select("node", F.round("rank", 6).alias("rank"))


@query("rank_mutual_information", "WITH t AS (SELECT p_brand, p_size < 20 AS small, p_retailprice > 1200 AS dear FROM part), c AS (SELECT p_brand, count(*)::DOUBLE AS n, sum(small::INT)::DOUBLE AS a, sum(dear::INT)::DOUBLE AS b, sum((small AND dear)::INT)::DOUBLE AS x FROM t GROUP BY 1) SELECT p_brand, round((CASE WHEN x > 0 THEN x / n * log2(x * n / (a * b)) ELSE 0 END) + (CASE WHEN a - x > 0 THEN (a - x) / n * log2((a - x) * n / (a * (n - b))) ELSE 0 END) + (CASE WHEN b - x > 0 THEN (b - x) / n * log2((b - x) * n / ((n - a) * b)) ELSE 0 END) + (CASE WHEN n - a - b + x > 0 THEN (n - a - b + x) / n * log2((n - a - b + x) * n / ((n - a) * (n - b))) ELSE 0 END), 9) AS bits FROM c")
def mutual(spark, sf_dir):
    t = load(spark, sf_dir, "part").select("p_brand", (F.col("p_size") < 20).alias("a"), (F.col("p_retailprice") > 1200).alias("b"))
    c = t.groupBy("p_brand").agg(F.count("*").cast("double").alias("n"), F.count_if("a").cast("double").alias("a"), F.count_if("b").cast("double").alias("b"), F.count_if(F.col("a") & F.col("b")).cast("double").alias("x"))
    return c.select("p_brand", F.round(R.mutual_information(F.col("x"), F.col("a"), F.col("b"), F.col("n")), 9).alias("bits"))


@query("rank_greedy_cover", """WITH RECURSIVE b AS (SELECT p_brand AS brand, count(*)::DOUBLE AS cost, list_distinct(list(p_size)) AS items FROM part GROUP BY 1), g AS (SELECT p_size AS item, sum(p_retailprice) AS gain FROM part GROUP BY 1), i AS (SELECT brand, cost, unnest(items) AS item FROM b),
r(place, brand, money, seen) AS (SELECT -1, NULL::VARCHAR, (SELECT sum(cost) / 4 FROM b), []::INT[] UNION ALL
SELECT place + 1, best.brand, money - best.cost, list_concat(seen, best.items) FROM (SELECT r.place, r.money, r.seen, (SELECT arg_max({'brand': x.brand, 'cost': x.cost, 'items': x.items}, {'v': x.worth / x.cost, 'n': -x.n}) FROM (SELECT i.brand, any_value(i.cost) AS cost, list(i.item) AS items, sum(g.gain) AS worth, (SELECT count(*) FROM b WHERE b.brand < i.brand) AS n FROM i JOIN g USING (item) WHERE NOT list_contains(r.seen, i.item) AND i.cost <= r.money GROUP BY i.brand) x WHERE x.worth > 0) AS best FROM r) WHERE best IS NOT NULL),
c AS (SELECT coalesce(sum(gain), 0) AS covered FROM g WHERE list_contains((SELECT arg_max(seen, place) FROM r), item)), s AS (SELECT arg_max(brand, {'w': w, 'b': brand}) AS brand, max(w) AS w FROM (SELECT brand, sum(gain) AS w FROM i JOIN g USING (item) WHERE cost <= (SELECT sum(cost) / 4 FROM b) GROUP BY 1))
SELECT CAST(place AS INT) AS place, r.brand AS brand FROM r, c, s WHERE place >= 0 AND covered >= s.w UNION ALL SELECT 0, s.brand FROM c, s WHERE covered < s.w""")
def cover(spark, sf_dir):
    """Brands that cover most retail price by size under a budget."""
    part = load(spark, sf_dir, "part")
    costs = part.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("cost"))
    items = part.select(F.col("p_brand").alias("name"), F.col("p_size").alias("item"))
    gains = part.groupBy(F.col("p_size").alias("item")).agg(F.sum("p_retailprice").alias("gain"))
    picked = R.cover_rounds(items, costs, gains, part.count() / 4)
    return spark.createDataFrame([(k, x) for k, x in enumerate(picked)], "place int, brand string")


_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query("rank_tree_regions", f"""WITH p AS (SELECT page_id, {_URL} AS path, length(html) AS size FROM pages), d AS (SELECT *, list_filter(string_split(path, '/')[:-2], lambda x: x <> '') AS dirs FROM p),
u AS (SELECT page_id, size, k, array_to_string(dirs[:k], '/') AS up FROM d, LATERAL (SELECT unnest(range(0, len(dirs) + 1)) AS k)), c AS (SELECT up FROM u GROUP BY up HAVING sum(size) > 30000 AND count(*) > 1),
m AS (SELECT page_id, count(*) AS cuts FROM u WHERE up IN (SELECT up FROM c) GROUP BY 1)
SELECT d.page_id, CASE WHEN len(dirs) = 0 OR coalesce(cuts, 0) = 0 THEN '.' ELSE array_to_string(dirs[:least(cuts, len(dirs))], '/') END AS region FROM d LEFT JOIN m USING (page_id)""")
def regions(spark, sf_dir):
    """Pages in regions of some 30,000 characters, by host and folder."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("path"), F.char_length("html").alias("size"))
    return R.tree_regions(pages, "path", F.col("size"), 30_000).select("page_id", "region")


@query("rank_stems", "SELECT n_nationkey, regexp_replace(lower(n_name) || 'ies', 'ies$', 'y') AS a, lower(n_name) AS b FROM nation WHERE NOT regexp_matches(lower(n_name), '([aeiou]|ss|us|is)$')")
def stems(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").filter(~F.lower("n_name").rlike("([aeiou]|ss|us|is)$"))
    return rows.select("n_nationkey", R.plural_stem(F.concat("n_name", F.lit("ies"))).alias("a"), R.plural_stem(F.concat("n_name", F.lit("s"))).alias("b"))


@query("rank_top_per_group", "SELECT c_mktsegment, c_custkey, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place FROM customer) WHERE place <= 3")
def top_per_group(spark, sf_dir):
    return R.top_per_group(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", 3).select("c_mktsegment", "c_custkey", "place")
