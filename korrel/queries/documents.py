"""Document commands: stages, predicates, accumulators, window operators and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import pipeline as P
from korrel.plans.policy import Access, Mask
from korrel.queries.registry import query
from korrel.session import load


def _documents(spark, sf_dir, *names, **settings) -> P.Documents:
    found = {n: load(spark, sf_dir, n) for n in names if n != "carts"}
    if "carts" in names:
        lines = load(spark, sf_dir, "lineitem")
        item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))
        found["carts"] = lines.groupBy(F.col("l_orderkey").alias("_id")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    return P.Documents(found, **settings)


def command(name: str, spec: dict, sql: str | None, *tables: str, **settings) -> None:
    query(f"doc_{name}", sql)(lambda spark, sf_dir: _documents(spark, sf_dir, *tables, **settings).run(spec))


def pipeline(name: str, on: str, stages: list, sql: str | None, *more: str, **settings) -> None:
    command(name, {"aggregate": on, "pipeline": stages}, sql, on, *more, **settings)


CARTS = "carts AS (SELECT l_orderkey AS _id, list({'no': l_linenumber, 'part': l_partkey, 'qty': l_quantity} ORDER BY l_linenumber, l_partkey, l_quantity) AS items, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1)"

command("find", {"find": "orders", "filter": {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, "sort": {"o_totalprice": -1, "o_orderkey": 1}, "skip": 5, "limit": 40, "projection": {"o_orderkey": 1, "o_totalprice": 1}},
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 5", "orders")
command("distinct", {"distinct": "orders", "key": "o_orderpriority", "query": {"o_orderstatus": {"$ne": "P"}}}, "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus <> 'P'", "orders")
command("distinct_array", {"distinct": "carts", "key": "flags"}, "SELECT DISTINCT l_returnflag AS value FROM lineitem", "carts")
command("count", {"countDocuments": "orders", "filter": {"o_totalprice": {"$gte": 50000, "$lt": 150000}}}, "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000", "orders")
command("count_none", {"countDocuments": "orders", "filter": {"o_totalprice": {"$lt": 0}}}, "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0", "orders")
command("masked_and_hidden", {"find": "customer", "filter": {"c_nationkey": 3}}, "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 3", "customer", access=Access(hidden=["customer.c_acctbal"], masked={"customer.c_name": Mask("full")}))
command("view", {"aggregate": "big", "pipeline": [{"$count": "n"}]}, "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 200000", "orders", views={"big": ("orders", [{"$match": {"o_totalprice": {"$gt": 200000}}}])})

pipeline("predicates", "orders", [{"$match": {"$and": [{"$or": [{"o_orderstatus": {"$in": ["F", "P"]}}, {"o_totalprice": {"$lte": 20000}}]}, {"$nor": [{"o_orderkey": {"$mod": [7, 0]}}, {"o_orderpriority": {"$regex": "^1-", "$options": "i"}}]}, {"o_custkey": {"$nin": [1, 2, 3], "$not": {"$gt": 1400}, "$exists": True}}]}}, {"$project": {"o_orderkey": 1}}],
         "SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice <= 20000) AND NOT (o_orderkey % 7 = 0 OR o_orderpriority LIKE '1-%') AND o_custkey NOT IN (1, 2, 3) AND NOT o_custkey > 1400")
pipeline("bit_predicates", "orders", [{"$match": {"o_orderkey": {"$bitsAllSet": 5, "$bitsAnyClear": [1], "$bitsAnySet": 12, "$bitsAllClear": 64}}}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_orderkey & 5 = 5 AND o_orderkey & 2 <> 2 AND o_orderkey & 12 <> 0 AND o_orderkey & 64 = 0")
pipeline("array_predicates", "carts", [{"$match": {"flags": {"$all": ["A", "R"], "$size": 2}, "items": {"$elemMatch": {"qty": {"$gt": 40}, "no": {"$lte": 3}}}}}, {"$project": {"_id": 1}}], f"WITH {CARTS} SELECT _id FROM carts WHERE flags = ['A', 'R'] AND len(list_filter(items, lambda x: x.qty > 40 AND x.no <= 3)) > 0")
pipeline("expr_predicate", "lineitem", [{"$match": {"$expr": {"$gt": [{"$multiply": ["$l_quantity", "$l_discount"]}, 4]}, "l_returnflag": {"$type": "string"}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1}}], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_discount > 4")
pipeline("text_predicate", "benchmark", [{"$match": {"$text": {"$search": "ation the"}}}, {"$project": {"item_id": 1}}], "SELECT item_id FROM benchmark WHERE lower(text) LIKE '%ation%' OR lower(text) LIKE '%the%' OR CAST(item_id AS VARCHAR) LIKE '%the%'")
pipeline("project_compute", "orders", [{"$project": {"o_orderkey": 1, "half": {"$divide": ["$o_totalprice", 2]}, "what": {"$concat": ["$o_orderstatus", "-", "$o_orderpriority"]}}}], "SELECT o_orderkey, o_totalprice / 2 AS half, o_orderstatus || '-' || o_orderpriority AS what FROM orders")
pipeline("project_exclude", "region", [{"$project": {"r_name": 0}}], "SELECT r_regionkey FROM region")
pipeline("add_set_unset", "nation", [{"$addFields": {"k2": {"$add": ["$n_nationkey", 100]}}}, {"$set": {"k3": {"$subtract": ["$k2", "$n_regionkey"]}}}, {"$unset": ["n_name", "n_regionkey"]}], "SELECT n_nationkey, n_nationkey + 100 AS k2, n_nationkey + 100 - n_regionkey AS k3 FROM nation")
pipeline("nested_paths", "carts", [{"$addFields": {"meta": {"n": {"$size": "$items"}, "first": {"$arrayElemAt": ["$flags", 0]}}}}, {"$set": {"meta.n": {"$multiply": ["$meta.n", 10]}}}, {"$unset": "meta.first"}, {"$project": {"_id": 1, "n": "$meta.n"}}], f"WITH {CARTS} SELECT _id, len(items) * 10 AS n FROM carts")
pipeline("group", "orders", [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "lo": {"$min": "$o_orderkey"}, "hi": {"$max": "$o_orderkey"}, "c": {"$count": {}}}}, {"$set": {"total": {"$round": ["$total", 2]}, "mean": {"$round": ["$mean", 4]}}}],
         "SELECT o_orderstatus AS _id, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(count(*) AS BIGINT) AS c FROM orders GROUP BY 1")
pipeline("group_all", "lineitem", [{"$group": {"_id": None, "n": {"$sum": 1}, "q": {"$sum": "$l_quantity"}}}, {"$project": {"_id": 0, "n": 1, "q": 1}}], "SELECT CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS q FROM lineitem")
pipeline("group_compound", "orders", [{"$group": {"_id": {"s": "$o_orderstatus", "y": {"$year": "$o_orderdate"}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "s": "$_id.s", "y": "$_id.y", "n": 1}}], "SELECT o_orderstatus AS s, CAST(year(o_orderdate) AS INT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
pipeline("statistics", "lineitem", [{"$group": {"_id": "$l_returnflag", "sp": {"$stdDevPop": "$l_quantity"}, "ss": {"$stdDevSamp": "$l_quantity"}, "cp": {"$covariancePop": ["$l_quantity", "$l_tax"]}, "cs": {"$covarianceSamp": ["$l_quantity", "$l_tax"]}}}, {"$project": {"_id": 1, "sp": {"$round": ["$sp", 6]}, "ss": {"$round": ["$ss", 6]}, "cp": {"$round": ["$cp", 6]}, "cs": {"$round": ["$cs", 6]}}}],
         "SELECT l_returnflag AS _id, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem GROUP BY 1")
pipeline("top_and_bottom", "orders", [{"$group": {"_id": "$o_custkey", "top": {"$top": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "bottom": {"$bottom": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "two": {"$topN": {"n": 2, "sortBy": {"o_orderdate": 1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "worst": {"$bottomN": {"n": 1, "sortBy": {"o_orderdate": 1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "max2": {"$maxN": {"input": "$o_orderkey", "n": 2}}, "min2": {"$minN": {"input": "$o_orderkey", "n": 2}}}}],
         "SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1] AS top, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[-1] AS bottom, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:2] AS two, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[-1:] AS worst, list(o_orderkey ORDER BY o_orderkey DESC)[1:2] AS max2, list(o_orderkey ORDER BY o_orderkey)[1:2] AS min2 FROM orders GROUP BY 1")
pipeline("push_and_sets", "nation", [{"$group": {"_id": "$n_regionkey", "all": {"$push": "$n_name"}, "set": {"$addToSet": "$n_regionkey"}}}, {"$project": {"_id": 1, "all": {"$sortArray": {"input": "$all", "sortBy": 1}}, "n": {"$size": "$set"}}}], "SELECT n_regionkey AS _id, list(n_name ORDER BY n_name) AS \"all\", 1 AS n FROM nation GROUP BY 1")
pipeline("percentiles", "orders", [{"$group": {"_id": "$o_orderstatus", "m": {"$median": {"input": "$o_totalprice", "method": "approximate"}}, "p": {"$percentile": {"input": "$o_totalprice", "p": [0.25, 0.75], "method": "approximate"}}}}, {"$project": {"_id": 1, "m": 1, "p75": {"$arrayElemAt": ["$p", 1]}}}], None)
pipeline("unwind", "carts", [{"$unwind": {"path": "$items", "includeArrayIndex": "i"}}, {"$project": {"_id": 1, "i": 1, "part": "$items.part"}}], f"WITH {CARTS} SELECT _id, CAST(i - 1 AS BIGINT) AS i, items[i].part AS part FROM carts, LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i)")
pipeline("unwind_scalar", "region", [{"$unwind": "$r_name"}], "SELECT r_regionkey, r_name FROM region")
pipeline("sort_by_count", "lineitem", [{"$sortByCount": "$l_linenumber"}], "SELECT l_linenumber AS _id, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1")
pipeline("replace_root", "carts", [{"$replaceRoot": {"newRoot": {"$arrayElemAt": ["$items", 0]}}}], f"WITH {CARTS} SELECT items[1].no AS no, items[1].part AS part, items[1].qty AS qty FROM carts")
pipeline("replace_with", "nation", [{"$replaceWith": {"k": "$n_nationkey", "n": {"$toLower": "$n_name"}}}], "SELECT n_nationkey AS k, lower(n_name) AS n FROM nation")
pipeline("bucket", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 50000, 100000, 200000], "default": 999999, "output": {"n": {"$sum": 1}}}}], "SELECT CASE WHEN o_totalprice < 0 OR o_totalprice >= 200000 THEN 999999 WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 50000 ELSE 100000 END AS _id, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
pipeline("bucket_auto", "part", [{"$bucketAuto": {"groupBy": "$p_size", "buckets": 4}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "count": 1}}],
         "WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), b AS (SELECT v, n, floor((sum(n) OVER (ORDER BY v) - n) * 4 / sum(n) OVER ()) AS b FROM c), g AS (SELECT b, min(v) AS lo, max(v) AS top, sum(n) AS n FROM b GROUP BY 1) SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), top) AS hi, CAST(n AS BIGINT) AS count FROM g")
pipeline("facet", "orders", [{"$facet": {"byStatus": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}], "total": [{"$count": "n"}]}}, {"$project": {"kinds": {"$size": "$byStatus"}, "n": {"$let": {"vars": {"t": {"$arrayElemAt": ["$total", 0]}}, "in": "$$t.n"}}}}], "SELECT CAST(count(DISTINCT o_orderstatus) AS INT) AS kinds, CAST(count(*) AS BIGINT) AS n FROM orders")
pipeline("lookup", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$o"}, "total": {"$round": [{"$reduce": {"input": "$o", "initialValue": 0.0, "in": {"$add": ["$$value", "$$this.o_totalprice"]}}}, 2]}}}], "SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", "orders")
pipeline("lookup_array", "carts", [{"$match": {"_id": {"$lte": 200}}}, {"$addFields": {"parts": {"$map": {"input": "$items", "as": "i", "in": "$$i.part"}}}}, {"$lookup": {"from": "part", "localField": "parts", "foreignField": "p_partkey", "as": "p"}}, {"$project": {"_id": 1, "n": {"$size": "$p"}}}], "SELECT l_orderkey AS _id, CAST(count(DISTINCT l_partkey) AS INT) AS n FROM lineitem WHERE l_orderkey <= 200 GROUP BY 1", "part")
pipeline("lookup_pipeline", "nation", [{"$lookup": {"from": "customer", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$k"]}}}], "as": "c"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$c"}}}], "SELECT n_nationkey, CAST(count(c_custkey) AS INT) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", "customer")
pipeline("union_with", "region", [{"$project": {"name": "$r_name"}}, {"$unionWith": {"coll": "nation", "pipeline": [{"$project": {"name": "$n_name"}}]}}], "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation", "nation")


@query("doc_graph_lookup", "WITH RECURSIVE s AS (SELECT s_suppkey AS start, s_suppkey AS k, 0 AS depth FROM supplier WHERE s_suppkey <= 40 UNION SELECT start, k // 2, depth + 1 FROM s WHERE depth < 3) SELECT start AS s_suppkey, CAST(count(*) AS INT) AS n, CAST(max(depth) AS BIGINT) AS deepest FROM (SELECT start, k, min(depth) AS depth FROM s GROUP BY 1, 2) JOIN supplier ON s_suppkey = k GROUP BY 1")
def graph_lookup(spark, sf_dir):
    tree = load(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey div 2").alias("parent"))
    docs = P.Documents({"tree": tree})
    stages = [{"$match": {"s_suppkey": {"$lte": 40}}}, {"$graphLookup": {"from": "tree", "startWith": "$s_suppkey", "connectFromField": "parent", "connectToField": "s_suppkey", "as": "up", "maxDepth": 3, "depthField": "d"}},
              {"$project": {"s_suppkey": 1, "n": {"$size": "$up"}, "deepest": {"$reduce": {"input": "$up", "initialValue": {"$numberLong": "0"}, "in": {"$cond": [{"$gt": ["$$this.d", "$$value"]}, "$$this.d", "$$value"]}}}}}]
    return docs.run({"aggregate": "tree", "pipeline": stages})


pipeline("window_ranks", "customer", [{"$setWindowFields": {"partitionBy": "$c_mktsegment", "sortBy": {"c_nationkey": 1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}}, {"$setWindowFields": {"partitionBy": "$c_mktsegment", "sortBy": {"c_custkey": 1}, "output": {"n": {"$documentNumber": {}}, "prev": {"$shift": {"output": "$c_custkey", "by": -1, "default": -1}}}}}, {"$project": {"c_custkey": 1, "r": 1, "d": 1, "n": 1, "prev": 1}}],
         "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS r, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS d, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INT) AS n, lag(c_custkey, 1, -1) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS prev FROM customer")
pipeline("window_frames", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"s": {"$sum": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}, "m": {"$max": "$o_totalprice", "window": {"documents": [-1, 1]}}, "f": {"$locf": "$o_orderdate"}, "i": {"$integral": {"input": "$o_totalprice"}, "window": {"documents": ["unbounded", "current"]}}, "v": {"$derivative": {"input": "$o_totalprice"}, "window": {"documents": [-1, 0]}}, "e": {"$expMovingAvg": {"input": "$o_totalprice", "N": 3}}}}}, {"$project": {"o_orderkey": 1, "s": {"$round": ["$s", 2]}, "m": 1, "f": 1, "i": {"$round": ["$i", 3]}, "v": {"$floor": {"$multiply": ["$v", 100]}}, "e": {"$gt": ["$e", 0]}}}],
         "WITH t AS (SELECT *, lag(o_totalprice) OVER w AS px, lag(o_orderkey) OVER w AS pt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m, o_orderdate AS f, round(coalesce(sum((o_orderkey - pt) * (o_totalprice + px) / 2) OVER w, 0), 3) AS i, CAST(floor((o_totalprice - px) / (o_orderkey - pt) * 100) AS BIGINT) AS v, true AS e FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
pipeline("window_range", "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"n": {"$sum": 1, "window": {"range": [-1, 0], "unit": "hour"}}}}}, {"$project": {"event_id": 1, "n": 1}}], "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
pipeline("linear_fill", "events", [{"$set": {"x": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}}}, {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"y": {"$linearFill": "$x"}}}}, {"$project": {"event_id": 1, "known": {"$ne": ["$y", None]}, "same": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, {"$eq": ["$x", "$y"]}, True]}}}],
         "SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL AND first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT NULL AS known, true AS same FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events)")

pipeline("expr_arithmetic", "part", [{"$project": {"p_partkey": 1, "a": {"$abs": {"$subtract": ["$p_size", 25]}}, "c": {"$ceil": "$p_retailprice"}, "f": {"$floor": "$p_retailprice"}, "e": {"$round": [{"$exp": {"$divide": ["$p_size", 50]}}, 6]}, "l": {"$round": [{"$ln": "$p_size"}, 6]}, "g": {"$round": [{"$log": ["$p_size", 2]}, 6]}, "t": {"$round": [{"$log10": "$p_size"}, 6]}, "m": {"$mod": ["$p_size", 7]}, "p": {"$pow": ["$p_size", 2]}, "s": {"$round": [{"$sqrt": "$p_size"}, 6]}, "z": {"$trunc": {"$multiply": ["$p_retailprice", -1]}}, "r": {"$round": ["$p_retailprice", 1]}}}, {"$unset": "r"}],
         "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(exp(p_size / 50), 6) AS e, round(ln(p_size), 6) AS l, round(log2(p_size), 6) AS g, round(log10(p_size), 6) AS t, p_size % 7 AS m, CAST(p_size * p_size AS DOUBLE) AS p, round(sqrt(p_size), 6) AS s, trunc(-p_retailprice) AS z FROM part")
pipeline("expr_trigonometry", "part", [{"$project": {"p_partkey": 1, "s": {"$round": [{"$sin": "$p_size"}, 6]}, "c": {"$round": [{"$cos": "$p_size"}, 6]}, "t": {"$round": [{"$tan": "$p_size"}, 4]}, "a": {"$round": [{"$atan2": ["$p_size", 3]}, 6]}, "h": {"$round": [{"$tanh": "$p_size"}, 6]}, "d": {"$round": [{"$degreesToRadians": "$p_size"}, 6]}, "i": {"$round": [{"$asin": {"$divide": ["$p_size", 100]}}, 6]}}}],
         "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(atan2(p_size, 3), 6) AS a, round(tanh(p_size), 6) AS h, round(radians(p_size), 6) AS d, round(asin(p_size / 100), 6) AS i FROM part")
pipeline("expr_comparison", "customer", [{"$project": {"c_custkey": 1, "c": {"$cmp": ["$c_nationkey", 12]}, "e": {"$eq": ["$c_nationkey", 3]}, "g": {"$gte": ["$c_acctbal", 0]}, "a": {"$and": [{"$gt": ["$c_acctbal", 0]}, {"$lt": ["$c_nationkey", 9]}]}, "o": {"$or": [{"$ne": ["$c_mktsegment", "BUILDING"]}, False]}, "n": {"$not": [{"$lte": ["$c_acctbal", 100]}]}, "s": {"$switch": {"branches": [{"case": {"$lt": ["$c_acctbal", 0]}, "then": "debt"}, {"case": {"$lt": ["$c_acctbal", 5000]}, "then": "some"}], "default": "much"}}, "i": {"$ifNull": [None, "$c_mktsegment", "x"]}}}],
         "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN -1 WHEN c_nationkey = 12 THEN 0 ELSE 1 END AS c, c_nationkey = 3 AS e, c_acctbal >= 0 AS g, c_acctbal > 0 AND c_nationkey < 9 AS a, c_mktsegment <> 'BUILDING' AS o, NOT c_acctbal <= 100 AS n, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS s, c_mktsegment AS i FROM customer")
pipeline("expr_arrays", "carts", [{"$set": {"q": {"$map": {"input": "$items", "as": "i", "in": "$$i.qty"}}}}, {"$project": {"_id": 1, "big": {"$size": {"$filter": {"input": "$q", "as": "x", "cond": {"$gt": ["$$x", 25]}}}}, "sum": {"$reduce": {"input": "$q", "initialValue": 0.0, "in": {"$add": ["$$value", "$$this"]}}}, "last": {"$arrayElemAt": ["$q", -1]}, "rev": {"$reverseArray": "$flags"}, "two": {"$slice": ["$q", 2]}, "at": {"$indexOfArray": ["$flags", "R"]}, "has": {"$in": ["N", "$flags"]}, "cat": {"$size": {"$concatArrays": ["$q", "$q"]}}, "rng": {"$range": [0, {"$size": "$q"}, 2]}, "arr": {"$isArray": "$q"}, "zip": {"$size": {"$zip": {"inputs": ["$q", "$q"]}}}}}],
         f"WITH {CARTS}, c AS (SELECT *, list_transform(items, lambda x: x.qty) AS q FROM carts) SELECT _id, CAST(len(list_filter(q, lambda x: x > 25)) AS INT) AS big, list_sum(q) AS sum, q[-1] AS last, list_reverse(flags) AS rev, q[1:2] AS two, coalesce(list_position(flags, 'R'), 0) - 1 AS at, list_contains(flags, 'N') AS has, 2 * len(q) AS cat, CAST(range(0, len(q), 2) AS INT[]) AS rng, true AS arr, len(q) AS zip FROM c")
pipeline("expr_sets", "carts", [{"$project": {"_id": 1, "d": {"$setDifference": ["$flags", ["A"]]}, "e": {"$setEquals": ["$flags", ["R", "A"]]}, "i": {"$setIntersection": ["$flags", ["A", "R"]]}, "s": {"$setIsSubset": ["$flags", ["A", "N", "R"]]}, "u": {"$size": {"$setUnion": ["$flags", ["X"]]}}, "all": {"$allElementsTrue": [[True, False]]}, "any": {"$anyElementTrue": [[True, False]]}}}],
         f"WITH {CARTS} SELECT _id, list_filter(flags, lambda x: x <> 'A') AS d, flags = ['A', 'R'] AS e, list_filter(flags, lambda x: x IN ('A', 'R')) AS i, true AS s, len(flags) + 1 AS u, false AS \"all\", true AS \"any\" FROM carts")
pipeline("expr_strings", "part", [{"$project": {"p_partkey": 1, "c": {"$concat": ["$p_brand", "/", "$p_type"]}, "i": {"$indexOfCP": ["$p_name", "e"]}, "l": {"$toLower": "$p_brand"}, "u": {"$toUpper": "$p_type"}, "n": {"$strLenCP": "$p_name"}, "b": {"$strLenBytes": "$p_name"}, "s": {"$substrCP": ["$p_name", 1, 3]}, "k": {"$strcasecmp": ["$p_brand", "brand#33"]}, "t": {"$trim": {"input": {"$concat": [" ", "$p_brand", " "]}}}, "x": {"$ltrim": {"input": "$p_brand", "chars": "Bra"}}, "r": {"$replaceAll": {"input": "$p_brand", "find": "#", "replacement": "-"}}, "o": {"$replaceOne": {"input": "$p_type", "find": "A", "replacement": "_"}}, "p": {"$arrayElemAt": [{"$split": ["$p_brand", "#"]}, 1]}, "m": {"$regexMatch": {"input": "$p_name", "regex": "a.e", "options": "i"}}, "f": {"$size": {"$regexFindAll": {"input": "$p_brand", "regex": "[0-9]"}}}, "y": {"$toString": "$p_size"}}}],
         "SELECT p_partkey, p_brand || '/' || p_type AS c, instr(p_name, 'e') - 1 AS i, lower(p_brand) AS l, upper(p_type) AS u, length(p_name) AS n, strlen(p_name) AS b, substring(p_name, 2, 3) AS s, CASE WHEN lower(p_brand) < 'brand#33' THEN -1 WHEN lower(p_brand) = 'brand#33' THEN 0 ELSE 1 END AS k, p_brand AS t, ltrim(p_brand, 'Bra') AS x, replace(p_brand, '#', '-') AS r, CASE WHEN instr(p_type, 'A') > 0 THEN substring(p_type, 1, instr(p_type, 'A') - 1) || '_' || substring(p_type, instr(p_type, 'A') + 1) ELSE p_type END AS o, split_part(p_brand, '#', 2) AS p, regexp_matches(p_name, '(?i)a.e') AS m, len(regexp_extract_all(p_brand, '[0-9]')) AS f, CAST(p_size AS VARCHAR) AS y FROM part")
pipeline("expr_dates", "orders", [{"$project": {"o_orderkey": 1, "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "w": {"$dayOfWeek": "$o_orderdate"}, "j": {"$dayOfYear": "$o_orderdate"}, "iw": {"$isoWeek": "$o_orderdate"}, "iy": {"$isoWeekYear": "$o_orderdate"}, "id": {"$isoDayOfWeek": "$o_orderdate"}, "sw": {"$week": "$o_orderdate"}, "a": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "day", "amount": 40}}, "b": {"$dateSubtract": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}, "x": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": {"$dateFromString": {"dateString": "1998-12-31T00:00:00Z"}}, "unit": "month"}}, "t": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "s": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d %H:%M"}}, "p": {"$let": {"vars": {"p": {"$dateToParts": {"date": "$o_orderdate"}}}, "in": {"$add": ["$$p.year", "$$p.day"]}}}, "f": {"$dateFromParts": {"year": {"$year": "$o_orderdate"}, "month": 2}}}}],
         "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS w, dayofyear(o_orderdate) AS j, week(o_orderdate) AS iw, isoyear(o_orderdate) AS iy, isodow(o_orderdate) AS id, CAST(strftime(o_orderdate, '%U') AS INT) AS sw, o_orderdate + INTERVAL 40 DAY AS a, o_orderdate - INTERVAL 1 MONTH AS b, date_diff('month', o_orderdate, TIMESTAMP '1998-12-31') AS x, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS s, year(o_orderdate) + day(o_orderdate) AS p, make_timestamp(year(o_orderdate), 2, 1, 0, 0, 0) AS f FROM orders")
pipeline("expr_conversions", "events", [{"$set": {"k": {"$getField": {"input": {"k": {"$toInt": {"$arrayElemAt": [{"$split": [{"$arrayElemAt": [{"$split": ["$props", ": "]}, 1]}, "}"]}, 0]}}}, "field": "k"}}}}, {"$project": {"event_id": 1, "k": 1, "l": {"$toLong": "$k"}, "d": {"$toDouble": "$k"}, "b": {"$toBool": "$k"}, "n": {"$isNumber": "$value"}, "t": {"$type": "$event_type"}, "c": {"$convert": {"input": "$event_type", "to": "int", "onError": -1}}, "z": {"$literal": "$x"}}}],
         "SELECT event_id, k, CAST(k AS BIGINT) AS l, CAST(k AS DOUBLE) AS d, k <> 0 AS b, true AS n, 'string' AS t, -1 AS c, '$x' AS z FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")


@query("doc_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'seen' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 1 END AS mark FROM orders")
def update(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return P.update(rows, {"o_orderstatus": "P"}, {"$inc": {"o_totalprice": 5}, "$set": {"o_orderpriority": "seen", "mark": 1}, "$setOnInsert": {"z": 1}}).drop("o_orderstatus")


@query("doc_update_arrays", f"WITH {CARTS} SELECT _id, flags || ['X', 'Y'] AS flags FROM carts")
def update_arrays(spark, sf_dir):
    rows = _documents(spark, sf_dir, "carts").collections["carts"].select("_id", "flags")
    return P.update(rows, {}, {"$push": {"flags": {"$each": ["X", "Y"]}}})


@query("doc_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def delete(spark, sf_dir):
    return P.delete(load(spark, sf_dir, "orders"), {"o_orderstatus": "F"}).select("o_orderkey")


@query("doc_infer", "SELECT * FROM (VALUES ('r_regionkey', 'int', true), ('r_name', 'string', true)) t(field, kinds, not_null)")
def infer(spark, sf_dir):
    return spark.createDataFrame(_documents(spark, sf_dir, "region").infer("region"), "field string, kinds string, not_null boolean")


@query("doc_sample")
def sample(spark, sf_dir):
    return _documents(spark, sf_dir, "orders").run({"aggregate": "orders", "pipeline": [{"$sample": {"size": 10}}]})


@query("doc_refusals", "SELECT * FROM (VALUES (1, 'OperatorDenied'), (2, 'OperatorDenied'), (3, 'HiddenFieldUsed'), (4, 'MaskedFieldUsed'), (5, 'TableRefused'), (6, 'OperatorDenied'), (7, 'CommandInvalid'), (8, 'OperatorDenied'), (9, 'MaskedFieldUsed'), (10, 'OperatorDenied')) t(n, refusal)")
def refusals(spark, sf_dir):
    from korrel.plans.errors import Refusal

    docs = _documents(spark, sf_dir, "customer", "supplier", "orders", access=Access(hidden=["customer.c_acctbal"], masked={"customer.c_name": Mask()}, blocked=["supplier"]))
    told = []
    on = lambda *stages: {"aggregate": "customer", "pipeline": list(stages)}
    for n, spec in enumerate([on({"$out": "x"}), {"find": "customer", "filter": {"$where": "1"}}, {"find": "customer", "filter": {"c_acctbal": 1}}, {"find": "customer", "filter": {"c_name": "x"}}, {"find": "supplier"},
                              {"aggregate": "orders", "pipeline": [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}]}, {"drop": "customer"}, on({"$project": {"x": "$$ROOT"}}), on({"$facet": {"a": []}}), on({"$match": {"c_custkey": {"$jsonSchema": {}}}})], 1):
        try:
            docs.run(spec)
            told.append((n, "none"))
        except Refusal as refusal:
            told.append((n, refusal.name))
    return spark.createDataFrame(told, "n int, refusal string")
