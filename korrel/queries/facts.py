"""The fact graph: definitions and references made of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import facts as G
from korrel.queries.registry import query
from korrel.session import checkpointed, load, parts_for

#: A call graph of parts and suppliers: part p calls supplier s where a line item has both.
_EDGES = "e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem)"


def _facts(spark, sf_dir) -> G.Facts:
    """Customers are files; orders are definitions, each calling the next order of its customer."""
    customers, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    files = customers.select(F.col("c_custkey").cast("int").alias("file_id"), F.concat(F.lit("src/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"), F.when(F.col("c_custkey") % 50 == 0, "skipped").otherwise("parsed").alias("status"))
    defs = orders.select(F.col("o_custkey").cast("int").alias("file_id"), F.col("o_orderkey").cast("int").alias("slot"), F.lit("function").alias("kind"), F.concat(F.lit("f"), F.col("o_orderkey") % 97).alias("name"), F.concat(F.lit("m.f"), "o_orderkey").alias("qname"), (F.col("o_orderkey") % 400).cast("int").alias("line"))
    key = F.col("o_orderkey").cast("int")
    refs = orders.select(F.col("o_custkey").cast("int").alias("file_id"), key.alias("from_slot"), F.when(F.col("o_orderstatus") == "P", "read").otherwise("call").alias("kind"), F.concat(F.lit("f"), (F.col("o_orderkey") + 1) % 97).alias("name"), key.alias("start"), F.lit(1).alias("line"), (key + 1).alias("target_slot"), (F.col("o_orderkey") % 11 == 0).alias("is_dynamic"))
    target = orders.select(key.alias("target_slot"), F.col("o_custkey").cast("int").alias("target_file"))
    refs = refs.join(target, "target_slot", "left").withColumn("reason", F.when(F.col("target_file").isNull(), "untyped_receiver"))
    refs = refs.withColumn("target_slot", F.when(F.col("target_file").isNotNull(), F.col("target_slot")))
    imports = refs.filter("target_file is not null and target_file <> file_id").select("file_id", "target_file").distinct()
    return G.Facts(files, defs, refs, imports)


_D = "d AS (SELECT o_orderkey AS k, o_custkey AS f, o_orderstatus AS s FROM orders), c AS (SELECT a.k AS src, a.f AS sf, b.k AS dst, a.s FROM d a JOIN d b ON b.k = a.k + 1)"


@query("facts_defined_at", "SELECT 'm.f' || o_orderkey AS qname, 'src/' || c_mktsegment || '/' || c_name AS path, CAST(o_orderkey % 400 AS INT) AS line FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 97 = 5")
def defined_at(spark, sf_dir):
    return _facts(spark, sf_dir).defined_at("f5").select("qname", "path", "line")


@query("facts_callers", f"""WITH {_D}, x1 AS (SELECT src, sf, 1 AS depth FROM c WHERE dst % 97 = 5 AND s <> 'P'), x2 AS (SELECT c.src, c.sf, 2 AS depth FROM c WHERE s <> 'P' AND dst IN (SELECT src FROM x1 WHERE src % 97 <> 5)), x AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2)
SELECT x.depth, 'src/' || c_mktsegment || '/' || c_name AS path, CAST(src AS INT) AS start, 'm.f' || src AS qname FROM x JOIN customer ON c_custkey = sf""")
def callers(spark, sf_dir):
    return _facts(spark, sf_dir).callers("f5", depth=2).sites.select("depth", "path", "start", "qname")


@query("facts_callees", f"WITH {_D} SELECT 1 AS depth, 'src/' || c_mktsegment || '/' || c_name AS path, CAST(src AS INT) AS start, 'm.f' || dst AS qname FROM c JOIN customer ON c_custkey = sf WHERE src % 97 = 5 AND s <> 'P'")
def callees(spark, sf_dir):
    return _facts(spark, sf_dir).callees("f5", depth=1).sites.select("depth", "path", "start", "qname")


@query("facts_references", f"WITH {_D} SELECT 'src/' || c_mktsegment || '/' || c_name AS path, CAST(src AS INT) AS start, CASE WHEN s = 'P' THEN 'read' ELSE 'call' END AS kind FROM c JOIN customer ON c_custkey = sf WHERE dst % 97 = 5")
def references(spark, sf_dir):
    return _facts(spark, sf_dir).references("f5").sites.select("path", "start", "kind")


@query("facts_unknown", f"""WITH RECURSIVE {_D}, i AS (SELECT DISTINCT c.sf AS file, d.f AS target FROM c JOIN d ON d.k = c.dst WHERE c.sf <> d.f), w(f) AS (SELECT f FROM d WHERE k % 97 = 5 UNION SELECT i.file FROM w JOIN i ON i.target = w.f)
SELECT CAST(k AS INT) AS start, 'same_name' AS why FROM d WHERE (k + 1) % 97 = 5 AND k + 1 NOT IN (SELECT k FROM d) AND f % 50 <> 0 UNION ALL SELECT CAST(k AS INT), 'dynamic_key' FROM d WHERE k % 11 = 0 AND f IN (SELECT f FROM w) AND f % 50 <> 0""")
def unknown(spark, sf_dir):
    return _facts(spark, sf_dir).callers("f5").unknown.select("start", "why")


@query("facts_stats", f"WITH {_D} SELECT CAST(count(*) AS BIGINT) AS refs, CAST((SELECT count(*) FROM c) AS BIGINT) AS resolved, CAST(0 AS BIGINT) AS outside, CAST(count(*) - (SELECT count(*) FROM c) AS BIGINT) AS unresolved FROM d")
def stats(spark, sf_dir):
    return _facts(spark, sf_dir).stats()


@query("facts_refused", "SELECT 'DepthOutOfRange' AS a, 'SubjectNotFound' AS b")
def refused(spark, sf_dir):
    from korrel.plans.errors import Refusal

    told = []
    for name, depth in (("f5", 9), ("nobody", 1)):
        try:
            _facts(spark, sf_dir).callers(name, depth=depth)
        except Refusal as refusal:
            told.append(refusal.name)
    return spark.createDataFrame([tuple(told)], "a string, b string")


def _graph(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10000000).alias("b"))
    # dealt before equal ones are dropped, by parts of some 16 MB, so that no task's table grows with the input; kept, as every round reads it
    rows = rows.repartition(parts_for(rows), "a", "b").distinct()
    return checkpointed(rows.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*"))


@query("facts_depths", f"WITH RECURSIVE {_EDGES}, u AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), w(n, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN u ON src = n WHERE depth < 4) SELECT n, CAST(min(depth) AS INT) AS depth FROM w GROUP BY n")
def depths(spark, sf_dir):
    return G.depths(_graph(spark, sf_dir), spark.createDataFrame([(1,)], "n long"), 4)


@query("facts_closure", f"WITH RECURSIVE {_EDGES}, u AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), w(n) AS (SELECT 1::BIGINT UNION SELECT dst FROM w JOIN u ON src = n) SELECT n FROM w")
def closure(spark, sf_dir):
    return G.closure(_graph(spark, sf_dir), spark.createDataFrame([(1,)], "n long"))


@query("facts_test_reach", "WITH RECURSIVE d AS (SELECT o_orderkey AS k, o_custkey AS f, o_orderstatus AS s FROM orders), w(start, k, n) AS (SELECT k, k, 0 FROM d WHERE k % 97 = 5 UNION SELECT w.start, d.k, n + 1 FROM w JOIN d ON d.k + 1 = w.k AND d.s <> 'P' WHERE n < 8) SELECT CAST(start AS BIGINT) AS slot, CASE WHEN max((f % 10 = 0)::INT) = 1 THEN 'tested' WHEN max(n) >= 8 THEN 'unknown' ELSE 'untested' END AS state FROM w JOIN d USING (k) GROUP BY start")
def test_reach(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    found = facts.test_reach(facts.defined_at("f5"), F.col("file_id") % 10 == 0)
    return found.select(F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("slot"), "state")


@query("facts_delta", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'removed' WHEN o_orderkey % 5 = 0 THEN 'added' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 OR (o_orderkey % 7 = 0 AND o_orderkey % 15 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)")
def delta(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("x").alias("h"))
    before = rows.filter("k % 5 <> 0 or k % 15 = 0")
    after = rows.filter("k % 3 <> 0 or k % 15 = 0").withColumn("h", F.when((F.col("k") % 7 == 0) & (F.col("k") % 15 != 0), "y").otherwise("x"))
    return G.delta(before, after, ["k"], "h")


@query("facts_users_ranking", "WITH u AS (SELECT l_suppkey AS dst, l_partkey AS src, count(*) AS uses FROM lineitem GROUP BY 1, 2) SELECT dst, src, CAST(uses AS BIGINT) AS uses FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY uses DESC, src) AS place FROM u) WHERE place <= 4")
def users(spark, sf_dir):
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.users_ranking(edges, load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n")))


@query("facts_routes", "SELECT c_name AS handler, '/' || r_name || '/' || n_name || '/c/' || c_custkey AS route FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def routes(spark, sf_dir):
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    top = region.select(F.lit("").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.concat(F.lit("/"), "r_name").alias("prefix"))
    sub = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("/"), "n_name").alias("prefix"))
    handlers = load(spark, sf_dir, "customer").select(F.col("c_name").alias("handler"), F.concat(F.lit("n"), "c_nationkey").alias("router"), F.concat(F.lit("/c/"), "c_custkey").alias("path"))
    return G.routes(top.union(sub), handlers)


@query("facts_alpha_hash", "SELECT o_custkey, sha256(string_agg(CAST(p AS VARCHAR), ',' ORDER BY i)) AS h FROM (SELECT o_custkey, i, list_position(l, l[i]) AS p FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY 1), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)) GROUP BY 1")
def alpha(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return rows.select("o_custkey", G.alpha_hash(F.col("l.o_orderpriority")).alias("h"))
