"""Relational operators: what an admitted statement may be made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators.logs import as_of_join
from korrel.queries.registry import query, statement
from korrel.session import load

BIG = "CAST(count(*) AS BIGINT)"

statement("rel_scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.06")
statement("rel_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
statement("rel_left_join", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
statement("rel_right_join", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
statement("rel_full_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
statement("rel_semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
statement("rel_anti_join", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')")
statement("rel_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_quantity > 49)")
statement("rel_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
statement("rel_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("rel_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("rel_using_join", "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN (SELECT c_nationkey AS n_nationkey FROM customer) c USING (n_nationkey) GROUP BY n_name")
statement("rel_group_aggregate", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_returnflag, l_linestatus")
statement("rel_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 3")
statement("rel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("rel_count_distinct", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag")
statement("rel_filter_clause", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_total FROM orders GROUP BY o_orderpriority")
statement("rel_cube", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
statement("rel_rollup", "SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS bal, CAST(grouping(c_nationkey) AS BIGINT) AS g FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
statement("rel_grouping_sets", "SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
statement("rel_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
statement("rel_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
statement("rel_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
statement("rel_intersect_all", "SELECT o_orderstatus AS k FROM orders INTERSECT ALL SELECT l_linestatus FROM lineitem")
statement("rel_except", "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation")
statement("rel_except_all", "SELECT l_linestatus AS k FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders")
statement("rel_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
statement("rel_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 10")
statement("rel_values", "SELECT o_orderkey, b FROM orders JOIN (VALUES ('F', 'x'), ('O', 'y'), ('P', NULL)) AS t(a, b) ON o_orderstatus = a")
statement("rel_cte", "WITH big AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey), top AS (SELECT * FROM big WHERE total > 150000) SELECT o_orderkey, round(total, 2) AS total FROM orders JOIN top ON o_orderkey = l_orderkey")
statement("rel_recursive", "WITH RECURSIVE t(client, master, depth) AS (SELECT client_id, master_id, 0 FROM clients WHERE master_id IS NOT NULL UNION ALL SELECT t.client, c.master_id, depth + 1 FROM t JOIN clients c ON c.client_id = t.master WHERE c.master_id IS NOT NULL AND depth < 3) SELECT client, master, depth FROM t")
statement("rel_scalar_subquery", "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
statement("rel_lateral", "SELECT c_custkey, t.top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c.c_custkey) t")
statement("rel_generate", "SELECT vec_id, label, x FROM (SELECT vec_id, label, explode(slice(embedding, 1, 3)) AS x FROM embeddings) t", "SELECT vec_id, label, unnest(embedding[1:3]) AS x FROM embeddings")
statement("rel_range_join", "SELECT CAST(a.event_id AS BIGINT) AS a, CAST(b.event_id AS BIGINT) AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTES", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE")
statement("rel_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, coalesce(nullif(p_brand, 'Brand#11'), 'own') AS brand FROM part")
statement("rel_star_join", "SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY r_name")

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
statement("win_ranks", "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey), v AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
statement("win_offsets", f"SELECT o_orderkey, lag(o_totalprice) {W} AS before, lead(o_totalprice, 2) {W} AS later, first_value(o_totalprice) {W} AS f, last_value(o_totalprice) {W} AS l, nth_value(o_totalprice, 2) {W} AS n2 FROM orders")
statement("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM orders")
statement("win_range_frame", "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS near FROM part")
statement("win_default_frame", "SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey), 2) AS running FROM customer")
statement("win_rate_limit", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS calls FROM events", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS calls FROM events")
statement("win_filtered", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS clicks FROM events")


@query("rel_asof_join", "SELECT event_id, o_orderkey FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.at")
def asof(spark, sf_dir):
    """Each event with its user's latest order before it."""
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    events = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return as_of_join(events, orders, ["user_id"], "ts", "at").select("event_id", "o_orderkey")


@query("rel_asof_nulls", "WITH c AS (SELECT client_id, valid_at, max(change_id) AS change_id FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY 1, 2) SELECT k.click_id, c.change_id FROM clicks k ASOF LEFT JOIN c ON k.client_id = c.client_id AND k.ts >= c.valid_at")
def asof_nulls(spark, sf_dir):
    """Each click with its client's latest change before it; clicks of nobody have none."""
    changes = load(spark, sf_dir, "client_changes").groupBy("client_id", "valid_at").agg(F.max("change_id").alias("change_id"))
    return as_of_join(load(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), changes, ["client_id"], "ts", "valid_at").select("click_id", "change_id")
