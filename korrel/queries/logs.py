"""Usage reports, ledgers, receipts, certificates."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import certify as C
from korrel.operators import logs as L
from korrel.queries.registry import query
from korrel.session import load

PRICES = [(0, "opal-4-mini", 0.5, 2.0, 0.1), (1, "opal-4", 3.0, 15.0, 0.3), (2, "flint", 1.0, 5.0, 0.2)]


def _lines(spark, sf_dir):
    """Events as transcript lines: (session, pos, value); every fifth line is no JSON, ids repeat."""
    e = load(spark, sf_dir, "events")
    message = F.struct(
        F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("m"), F.expr("event_id div 2"))).alias("id"),
        F.element_at(F.array(*map(F.lit, ("opal-4-mini", "opal-4-20", "opal-45", "flint@1"))), (F.col("event_id") % 4 + 1).cast("int")).alias("model"),
        F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.expr("event_id div 3")).alias("id"), F.concat(F.lit("mcp__srv__"), "event_type").alias("name"))).alias("content"),
        F.struct((F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 40).alias("output_tokens"), F.lit(7).alias("cache_read_input_tokens"), (F.col("event_id") % 30).alias("cache_creation_input_tokens"), F.struct((F.col("event_id") % 50).alias("ephemeral_1h_input_tokens")).alias("cache_creation")).alias("usage"),
    )
    doc = F.to_json(F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), message.alias("message")))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 5 == 4, "{broken").otherwise(doc).alias("value"))


_RAW = """e AS (SELECT user_id AS session, event_id AS pos, ts, event_type, CASE WHEN event_id % 9 <> 0 THEN 'm' || event_id // 2 END AS id, ['opal-4-mini', 'opal-4-20', 'opal-45', 'flint@1'][CAST(event_id % 4 + 1 AS INT)] AS model,
  event_id % 100 AS input, event_id % 40 AS output, 7 AS cache_read, event_id % 30 - least(event_id % 30, event_id % 50) AS write_5m, least(event_id % 30, event_id % 50) AS write_1h FROM events WHERE event_id % 5 <> 4),
k AS (SELECT session, coalesce(id, '~' || pos) AS id, max_by(input, pos) AS input, max_by(output, pos) AS output, max_by(cache_read, pos) AS cache_read, max_by(write_5m, pos) AS write_5m, max_by(write_1h, pos) AS write_1h, min_by(model, pos) AS model FROM e GROUP BY 1, 2)"""


def _messages(spark, sf_dir):
    rows = L.read_lines(_lines(spark, sf_dir))
    rows = rows.select("session", "pos", F.col("message.id").alias("id"), F.col("message.model").alias("model"), *(c.alias(k) for k, c in L.usage().items()))
    return L.last_wins(rows, "session", F.col("id"), "pos", ["model"], ["input", "output", "cache_read", "write_5m", "write_1h"])


@query("log_read_lines", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 5 <> 4")
def read_lines(spark, sf_dir):
    return L.read_lines(_lines(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("log_timestamps", "SELECT event_id AS pos, CAST(epoch(date_trunc('second', ts)) * 1000 AS BIGINT) AS ms FROM events WHERE event_id % 5 <> 4")
def timestamps(spark, sf_dir):
    return L.read_lines(_lines(spark, sf_dir)).select("pos", L.milliseconds(F.col("timestamp")).alias("ms"))


@query("log_last_wins", f"WITH {_RAW} SELECT session, model, CAST(input AS BIGINT) AS input, CAST(output AS BIGINT) AS output, CAST(write_5m AS BIGINT) AS write_5m, CAST(write_1h AS BIGINT) AS write_1h FROM k")
def last_wins(spark, sf_dir):
    return _messages(spark, sf_dir).select("session", "model", "input", "output", "write_5m", "write_1h")


@query("log_tools", "SELECT user_id AS session, event_type AS tool, CAST(count(DISTINCT event_id // 3) AS BIGINT) AS calls FROM events WHERE event_id % 5 <> 4 GROUP BY 1, 2")
def tools(spark, sf_dir):
    rows = L.read_lines(_lines(spark, sf_dir)).select("session", F.explode("message.content").alias("c"))
    return rows.groupBy("session", L.tool_name(F.col("c.name")).alias("tool")).agg(F.count_distinct("c.id").alias("calls"))


_PRICE = "CASE WHEN model LIKE 'opal-4-mini%' AND substring(model, 12, 1) IN ('', '-', '@', ':', '[') THEN [0.5, 2.0, 0.1] WHEN model LIKE 'opal-4%' AND substring(model, 7, 1) IN ('', '-', '@', ':', '[') THEN [3.0, 15.0, 0.3] WHEN model LIKE 'flint%' AND substring(model, 6, 1) IN ('', '-', '@', ':', '[') THEN [1.0, 5.0, 0.2] END"


@query("log_session_report", f"""WITH {_RAW}, p AS (SELECT *, CAST({_PRICE} AS DOUBLE[]) AS p FROM k)
SELECT session, model, CAST(count(*) AS BIGINT) AS turns, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(count(*) FILTER (WHERE p IS NULL) AS BIGINT) AS unpriced,
  round(sum(((input + 1.25 * write_5m + 2.0 * write_1h) * p[1] + output * p[2] + cache_read * p[3]) / 1e6), 9) AS cost FROM p GROUP BY ROLLUP (session, model)""")
def report(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "place int, prefix string, input_price double, output_price double, cache_price double")
    rows = L.price_of(_messages(spark, sf_dir), "model", prices).withColumn("cost", L.cost())
    return rows.rollup("session", "model").agg(F.count("*").alias("turns"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.count_if(F.col("price").isNull()).alias("unpriced"), F.round(F.sum("cost"), 9).alias("cost"))


@query("log_interval_join", "SELECT a.event_id AS window_id, CAST(count(*) AS BIGINT) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE + INTERVAL 5 SECOND WHERE a.event_type = 'purchase' GROUP BY 1")
def intervals(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    windows = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("finish"))
    found = L.interval_join(events, "ts", windows, "begin", "finish", ["user_id"], F.expr("INTERVAL 5 SECONDS"))
    return found.groupBy("window_id").agg(F.count("*").alias("n"))


@query("log_tally", "SELECT user_id, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS large, CAST(count(*) FILTER (WHERE event_type = 'purchase' AND value < 10) AS BIGINT) AS small_purchases FROM events GROUP BY 1")
def tally(spark, sf_dir):
    tests = {"events": F.lit(True), "clicks": F.col("event_type") == "click", "large": F.col("value") > 50, "small_purchases": (F.col("event_type") == "purchase") & (F.col("value") < 10)}
    return load(spark, sf_dir, "events").groupBy("user_id").agg(*L.tally(tests))


@query("log_session_pick", "SELECT CAST(max(user_id) AS BIGINT) AS session FROM events WHERE ts = (SELECT max(ts) FROM events)")
def pick(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), F.desc("user_id")).limit(1).select(F.col("user_id").alias("session"))


_LEDGER = "r AS (SELECT 'd' || event_id // 3 AS id, event_id AS pos, event_type AS text, CASE WHEN event_id % 10 = 0 THEN 'd' || event_id // 6 END AS supersedes FROM events), l AS (SELECT id, max(pos) AS pos, max_by(text, pos) AS text, arg_max_null(supersedes, pos) AS supersedes FROM r GROUP BY 1)"


def _ledger(spark, sf_dir, by=6):
    e = load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("d"), F.expr("event_id div 3")).alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("d"), F.expr(f"event_id div {by}"))).alias("supersedes"))


@query("ledger_current", f"WITH {_LEDGER} SELECT id, pos, text FROM l WHERE id NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL)")
def ledger(spark, sf_dir):
    return L.fold_ledger(_ledger(spark, sf_dir))[0].select("id", "pos", "text")


@query("ledger_conflicts", f"WITH {_LEDGER.replace('// 6', '// 60')} SELECT supersedes AS id, CAST(count(*) AS BIGINT) AS successors FROM l WHERE supersedes IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def conflicts(spark, sf_dir):
    return L.fold_ledger(_ledger(spark, sf_dir, 60))[1]


def _receipts(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("f"), "o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).cast("string").alias("before"), ((F.col("o_orderkey") + 1) % 3).cast("string").alias("after"))


_REPLAY = "t AS (SELECT 'f' || o_custkey AS path, o_orderkey AS seq, o_orderkey % 3 AS b, (o_orderkey + 1) % 3 AS a FROM orders), v AS (SELECT path, seq, CASE WHEN lag(a) OVER (PARTITION BY path ORDER BY seq) IS NULL OR lag(a) OVER (PARTITION BY path ORDER BY seq) = b THEN 'verified' ELSE 'mismatch' END AS verdict FROM t)"


@query("verify_replay", f"WITH {_REPLAY} SELECT * FROM v")
def replay(spark, sf_dir):
    return L.replay(_receipts(spark, sf_dir), "path", "seq", "before", "after").select("path", "seq", "verdict")


@query("verify_worst", f"WITH {_REPLAY} SELECT path, max_by(verdict, CASE verdict WHEN 'verified' THEN 1 ELSE 4 END) AS verdict FROM v GROUP BY 1")
def worst(spark, sf_dir):
    return L.replay(_receipts(spark, sf_dir), "path", "seq", "before", "after").groupBy("path").agg(L.worst(F.col("verdict")).alias("verdict"))


@query("verify_uncovered", "SELECT 'f' || (c_custkey + 10) AS path, 'unverified' AS verdict FROM customer WHERE c_custkey + 10 NOT IN (SELECT o_custkey FROM orders)")
def uncovered(spark, sf_dir):
    changed = load(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey") + 10).alias("path"))
    return L.uncovered(changed, _receipts(spark, sf_dir), "path")


@query("verify_hash_chain", """WITH RECURSIVE t AS (SELECT n_regionkey AS r, n_name AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
h(r, i, head) AS (SELECT DISTINCT r, 0::BIGINT, '' FROM t UNION ALL SELECT h.r, t.i, sha256(head || chr(30) || x) FROM h JOIN t ON t.r = h.r AND t.i = h.i + 1)
SELECT r AS n_regionkey, max_by(head, i) AS head FROM h GROUP BY 1""")
def chain(spark, sf_dir):
    return L.hash_chain(load(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_name"])


@query("cache_sweep", "SELECT p_partkey FROM (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey DESC) AS kept FROM part) WHERE kept > 5000")
def sweep(spark, sf_dir):
    return L.sweep(load(spark, sf_dir, "part"), "p_partkey", "p_size", 5000).select("p_partkey")


@query("certify_leaves", "SELECT doc_id, sha256(unhex('00') || unhex(lpad(hex(strlen(p) % 256), 2, '0')) || unhex('000000') || encode(p) || unhex(sha256(text))) AS leaf FROM (SELECT doc_id, 'docs/' || doc_id AS p, text FROM documents)")
def leaves(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", C.leaf(F.concat(F.lit("docs/"), "doc_id"), F.sha2("text", 256)).alias("leaf"))


#: Level by level, up to 2 ** 24 leaves: pairs are hashed, an odd last node goes up as it is.
_LEAVES = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256(unhex('00') || unhex(lpad(hex(strlen(p) % 256), 2, '0')) || unhex('000000') || encode(p) || unhex(sha256(text))) AS h FROM (SELECT doc_id, 'docs/' || doc_id AS p, text FROM documents)"
_UP = "l{b} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END AS h FROM l{a} GROUP BY i // 2)"


@query("certify_merkle_root", f"WITH l0 AS ({_LEAVES}), {', '.join(_UP.format(a=k, b=k + 1) for k in range(24))} SELECT h AS root FROM l24")
def root(spark, sf_dir):
    found = C.merkle_root(leaves(spark, sf_dir), "doc_id")
    return spark.createDataFrame([(found,)], "root string")


@query("certify_merkle_tree", f"WITH l0 AS (SELECT i, CASE WHEN i % 10 = 3 THEN sha256(h) ELSE h END AS h FROM ({_LEAVES})), {', '.join(_UP.format(a=k, b=k + 1) for k in range(24))} SELECT h AS root FROM l24")
def tree(spark, sf_dir):
    """The root after a tenth of the leaves changed, by the nodes above those."""
    rows = leaves(spark, sf_dir)
    made = C.MerkleTree(rows, "doc_id")
    numbered = rows.select((F.col("doc_id") - rows.agg(F.min("doc_id")).first()[0]).alias("i"), F.sha2("leaf", 256).alias("h"))
    made.update(numbered.filter("i % 10 = 3"))
    return spark.createDataFrame([(made.root(),)], "root string")


@query("certify_status", "SELECT 'complete' AS a, 'partial' AS b, 'refused' AS c")
def status(spark, sf_dir):
    n = load(spark, sf_dir, "documents").count()
    large = load(spark, sf_dir, "documents").filter(F.char_length("text") > 5000).count()
    told = [C.Certificate("s", n, n - large, {"too_large": large}), C.Certificate("s", n, n - large - 1, {"too_large": large}, ["docs/1"]), C.Certificate("s", n, n + 1)]
    return spark.createDataFrame([tuple(x.status() for x in told)], "a string, b string, c string")
