"""Statements under access rules: masked, hidden and blocked data, and the database's own operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.plans.database import Database
from korrel.plans.errors import Refusal
from korrel.plans.policy import Access, Mask
from korrel.plans.writes import WriteGrant, Writer
from korrel.queries.registry import query, statement
from korrel.session import load

RULES = Access(hidden=["customer.c_acctbal"], masked={"customer.c_name": Mask("partial", 4), "supplier.s_name": Mask("full")}, blocked=["supplier"])
OPEN = Access(hidden=["customer.c_acctbal"], masked={"customer.c_name": Mask("partial", 4), "supplier.s_name": Mask("full")})
_PARTIAL = "CASE WHEN length({0}) <= 4 THEN repeat('*', greatest(length({0}), 3)) ELSE repeat('*', length({0}) - 4) || right({0}, 4) END"
_FLAGSHIP = "SELECT c_custkey, {name} AS customer, {acctbal} AS balance, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"
_FLAGSHIP_SQL = _FLAGSHIP.format(name=_PARTIAL.format("c_name"), acctbal="CAST(NULL AS DOUBLE)")


@query("guard_flagship", _FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Database.of(spark, sf_dir, "customer", "orders", access=RULES).frame(_FLAGSHIP.format(name="c_name", acctbal="c_acctbal"))


statement("guard_hidden_is_null", "SELECT c_custkey, c_acctbal, c_acctbal IS NULL AS gone, coalesce(c_acctbal, -1) AS filled FROM customer", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal, true AS gone, CAST(-1 AS DOUBLE) AS filled FROM customer", RULES)
statement("guard_mask_full", "SELECT s_suppkey, s_name FROM supplier", "SELECT s_suppkey, '***' AS s_name FROM supplier", OPEN)
statement("guard_mask_through_cte", "WITH m AS (SELECT c_custkey AS k, c_name AS who FROM customer WHERE c_custkey % 2 = 0) SELECT k, x.who FROM (SELECT * FROM m) x", f"SELECT c_custkey AS k, {_PARTIAL.format('c_name')} AS who FROM customer WHERE c_custkey % 2 = 0", RULES)
statement("guard_masked_join_output", "SELECT o_orderkey, c.c_name FROM orders JOIN customer c ON c.c_custkey = o_custkey WHERE o_orderstatus = 'P'", f"SELECT o_orderkey, {_PARTIAL.format('c_name')} AS c_name FROM orders JOIN customer c ON c.c_custkey = o_custkey WHERE o_orderstatus = 'P'", RULES)

_MAILS = "concat(substring(lower(c_name), 1, 5), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('@', lower(c_mktsegment), '.example') END)"


@query("guard_mask_email", """
WITH m AS (SELECT c_custkey, substring(lower(c_name), 1, 5) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@' || lower(c_mktsegment) || '.example' END AS mail FROM customer)
SELECT c_custkey, CASE WHEN position('@' IN mail) > 1 THEN left(mail, 1) || '***' || substring(mail, position('@' IN mail)) WHEN length(mail) <= 4 THEN repeat('*', greatest(length(mail), 3)) ELSE repeat('*', length(mail) - 4) || right(mail, 4) END AS mail FROM m""")  # fmt: skip
def mask_email(spark, sf_dir):
    db = Database(spark, Access(masked={"people.mail": Mask("email")}))
    db.add("people", load(db.spark, sf_dir, "customer").select("c_custkey", F.expr(_MAILS).alias("mail")))
    return db.frame("SELECT c_custkey, mail FROM people")


@query("guard_mask_number", f"SELECT c_custkey, {_PARTIAL.format('CAST(c_nationkey AS VARCHAR)')} AS c_nationkey FROM customer")
def mask_number(spark, sf_dir):
    return Database.of(spark, sf_dir, "customer", access=Access(masked={"customer.c_nationkey": Mask("partial", 4)})).frame("SELECT c_custkey, c_nationkey FROM customer")


@query("guard_generated_hidden", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(NULL AS VARCHAR) AS lower_name FROM customer")
def generated_hidden(spark, sf_dir):
    db = Database(spark, Access(hidden=["customer.c_name"]))
    db.add("customer", load(db.spark, sf_dir, "customer").withColumn("lower_name", F.lower("c_name")), ["lower_name"])
    return db.frame("SELECT c_custkey, c_name, lower_name FROM customer")


@query("guard_refusals", """SELECT * FROM (VALUES (1, 'MaskedColumnUsed'), (2, 'MaskedColumnUsed'), (3, 'MaskedColumnUsed'), (4, 'MaskedColumnUsed'), (5, 'MaskedColumnUsed'),
  (6, 'TableRefused'), (7, 'TableRefused'), (8, 'FunctionDenied'), (9, 'MultipleStatements'), (10, 'StatementNotRead'), (11, 'EmptyStatement'), (12, 'TableNotFound'), (13, 'UnsupportedFrame'), (14, 'TableRefused'), (15, 'FunctionDenied'), (16, 'FunctionDenied'), (17, 'GuardedColumnInWrite'), (18, 'GuardedColumnInWrite'), (19, 'GuardedColumnInWrite'), (20, 'FunctionDenied')) t(n, refusal)""")  # fmt: skip
def refusals(spark, sf_dir):
    """Which refusal each of some statements meets."""
    from korrel.plans.errors import Refusal

    db = Database.of(spark, sf_dir, "customer", "orders", "supplier", access=RULES)
    told = []
    for n, sql in enumerate(
        ["SELECT lower(c_name) AS x FROM customer", "SELECT c_custkey FROM customer WHERE c_name LIKE 'C%'", "SELECT DISTINCT c_name FROM customer", "SELECT c_name FROM customer UNION ALL SELECT o_orderstatus FROM orders",
         "SELECT to_json(struct(*)) AS j FROM customer", "SELECT count(*) AS n FROM supplier", "SELECT * FROM information_schema.tables", "SELECT input_file_name() AS f", "SELECT 1; SELECT 2", "DROP TABLE orders", "-- nothing",
         "SELECT * FROM elsewhere", "SELECT sum(o_totalprice) OVER (ORDER BY o_orderkey GROUPS 1 PRECEDING) AS s FROM orders"], 1):
        try:
            db.frame(sql)
            told.append((n, "none"))
        except Refusal as refusal:
            told.append((n, refusal.name))
    for sql in (f"SELECT * FROM IDENTIFIER('parquet.`{sf_dir}/supplier.parquet`')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')", "SELECT IDENTIFIER('input_file_name')() FROM orders"):
        try:
            db.frame(sql)
            told.append((len(told) + 1, "none"))
        except Refusal as refusal:
            told.append((len(told) + 1, refusal.name))
    for value in ("to_json(struct(*))", "`c_name`", "c_name||'x'", "reflect('java.lang.System', 'getProperty', 'user.home')"):
        try:
            Writer(db, WriteGrant()).update("customer", {"c_mktsegment": value})
            told.append((len(told) + 1, "none"))
        except Refusal as refusal:
            told.append((len(told) + 1, refusal.name))
    return spark.createDataFrame(told, "n int, refusal string")


@query("db_tables", "SELECT * FROM (VALUES ('customer', 1), ('orders', 1)) t(name, withheld)")
def list_tables(spark, sf_dir):
    shown, withheld = Database.of(spark, sf_dir, "customer", "orders", "supplier", access=RULES).tables()
    return spark.createDataFrame([(x, withheld) for x in shown], "name string, withheld int")


@query("db_describe", "SELECT * FROM (VALUES ('c_custkey', 'bigint', 'plain'), ('c_name', 'string', 'partial'), ('c_nationkey', 'int', 'plain'), ('c_acctbal', 'double', 'hidden'), ('c_mktsegment', 'string', 'plain')) t(name, type, access)")
def describe(spark, sf_dir):
    found = Database.of(spark, sf_dir, "customer", access=RULES).describe("customer")
    return spark.createDataFrame([(x["name"], x["type"], x["access"]) for x in found], "name string, type string, access string")


@query("db_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def count(spark, sf_dir):
    return spark.createDataFrame([(Database.of(spark, sf_dir, "orders").count("orders"),)], "n long")


@query("db_sample")
def sample(spark, sf_dir):
    """The first rows of a table, as many as the sample asks for."""
    return Database.of(spark, sf_dir, "orders").sampled("orders", 20)


@query("db_explain")
def explain(spark, sf_dir):
    lines = Database.of(spark, sf_dir, "orders").explain("SELECT count(*) AS n FROM orders")
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line int, text string")


@query("db_write_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def update(spark, sf_dir):
    db = Database.of(spark, sf_dir, "orders")
    Writer(db, WriteGrant()).update("orders", {"o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'P'")
    return db.frame("SELECT o_orderkey, o_totalprice FROM orders")


@query("db_write_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete(spark, sf_dir):
    db = Database.of(spark, sf_dir, "orders")
    Writer(db, WriteGrant()).delete("orders", "o_orderstatus = 'F'")
    return db.frame("SELECT o_orderkey FROM orders")


@query("db_write_statements", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT r_regionkey + 100, lower(r_name), NULL FROM region")
def statements(spark, sf_dir):
    """SQL over a table with another name in it, with the columns that an INSERT names."""
    db = Database.of(spark, sf_dir, "region", "nation")
    for sql in ("INSERT INTO nation /* (n_regionkey) */ (n_name, n_nationkey) SELECT r_name, r_regionkey + 100 FROM region", "UPDATE nation AS n SET n_name = lower(n.n_name) WHERE n.n_nationkey >= 100", "DELETE FROM nation n WHERE n.n_regionkey = 0"):
        Writer(db, WriteGrant()).run(sql)
    return db.frame("SELECT n_nationkey, n_name, n_regionkey FROM nation")


@query("db_write_refusals", "SELECT n_nationkey, 'SqlFailed' AS unknown_column, 'GuardedColumnInWrite' AS guarded_column, 'WriteNotGranted' AS no_grant, 'DestructiveNotGranted' AS all_rows FROM nation")
def write_refusals(spark, sf_dir):
    """What is refused leaves the table as it was."""
    db = Database.of(spark, sf_dir, "nation", access=Access(masked={"nation.n_name": Mask("full")}))
    told = []
    for sql, grant in (("INSERT INTO nation (n_nationkey, nosuch) VALUES (90, 1)", WriteGrant()), ("INSERT INTO nation (n_nationkey, /* x */ n_name) VALUES (90, 'x')", WriteGrant()), ("DELETE FROM nation WHERE n_nationkey = 1", None), ("DELETE FROM nation", WriteGrant())):
        try:
            Writer(db, grant).run(sql)
            told.append("none")
        except Refusal as refusal:
            told.append(refusal.name)
    names = ("unknown_column", "guarded_column", "no_grant", "all_rows")
    return db.frame("SELECT n_nationkey FROM nation").select("n_nationkey", *(F.lit(x).alias(n) for x, n in zip(told, names)))


@query("db_write_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def insert(spark, sf_dir):
    db = Database.of(spark, sf_dir, "region", "nation")
    Writer(db, WriteGrant()).insert("region", db.frame("SELECT n_nationkey + 100 AS r_regionkey, n_name AS r_name FROM nation"))
    return db.frame("SELECT r_regionkey, r_name FROM region")
