"""The access rules: which statements are refused, what the others show."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korrel.functions.dialect import rewrite
from korrel.plans import errors
from korrel.plans.database import Database, Databases, Limiter, Limits
from korrel.plans.policy import Access, Mask
from korrel.plans.writes import WriteGrant, Writer
from korrel.sources.render import Renderer

#: What must never be shown.
SECRETS = ("badge-", "pin-", "key-of-", "555-01", "ines@", "tomas@")


def make(spark, strict, **settings):
    """A clinic: staff with hidden badges and pins and masked numbers, their visits, and a vault nobody may read."""
    rules = Access(hidden=["staff.badge", "*.pin"], masked={"staff.phone": Mask("partial", 2), "staff.contact": Mask("email")}, blocked=["vault"], strict=strict)
    db = Database(spark, rules, Limits(timeout_ms=120_000, rate_per_minute=10_000), **settings)
    staff = [(11, "Ines", "555-0142", "ines@clinic.test", "badge-a", "pin-1"), (12, "Tomas", "555-0177", "tomas@clinic.test", "badge-b", "pin-2"), (13, "Wu", None, "no mail", "badge-c", None)]
    db.add("staff", db.spark.createDataFrame(staff, "emp long, nick string, phone string, contact string, badge string, pin string"))
    db.add("visits", db.spark.createDataFrame([(70, 11, 15.0), (71, 11, 40.5), (72, 13, 5.0)], "visit long, emp long, minutes double"))
    db.add("vault", db.spark.createDataFrame([("key-of-x",)], "entry string"))
    db.add_view("reachable", "SELECT emp, phone FROM staff")
    db.add_view("shouted", "SELECT nick, upper(contact) AS c FROM staff")
    db.add_view("opened", "SELECT entry FROM vault")
    return db


@pytest.fixture(scope="module")
def db(spark):
    return make(spark, True)


GUARDED = ("phone", "contact", "badge", "pin")
#: Every way to use a value other than to put it out as it is.
USES = [
    "SELECT concat({c}, '!') AS v FROM staff", "SELECT length({c}) AS v FROM staff", "SELECT {c} IS NULL AS v FROM staff", "SELECT CASE {c} WHEN 'x' THEN 1 END AS v FROM staff",
    "SELECT array({c}) AS v FROM staff", "SELECT named_struct('k', {c}) AS v FROM staff", "SELECT min({c}) AS v FROM staff", "SELECT collect_list({c}) AS v FROM staff",
    "SELECT emp FROM staff WHERE {c} > 'a'", "SELECT emp FROM staff ORDER BY {c} LIMIT 1", "SELECT DISTINCT {c} FROM staff", "SELECT {c}, count(*) AS n FROM staff GROUP BY {c}",
    "SELECT nick FROM staff GROUP BY nick HAVING max({c}) = 'z'", "SELECT rank() OVER (PARTITION BY {c} ORDER BY emp) AS r FROM staff", "SELECT lag({c}) OVER (ORDER BY emp) AS r FROM staff",
    "SELECT a.emp FROM staff a JOIN staff b ON a.{c} = b.{c}", "SELECT emp FROM staff JOIN (SELECT 'q' AS {c}) USING ({c})", "SELECT emp FROM visits WHERE emp IN (SELECT emp FROM staff WHERE {c} = 'x')",
    "SELECT visit FROM visits v WHERE EXISTS (SELECT 1 FROM staff s WHERE s.emp = v.emp AND s.{c} <> '')", "SELECT visit, (SELECT max({c}) FROM staff) AS m FROM visits", "SELECT (SELECT {c} FROM staff LIMIT 1) AS m",
    "SELECT nick FROM staff WHERE nick = ANY (SELECT {c} FROM staff)".replace("= ANY (", "IN ("), "SELECT nick FROM staff UNION ALL SELECT {c} FROM staff", "SELECT {c} FROM staff EXCEPT SELECT nick FROM staff",
    "WITH w AS (SELECT {c} AS k FROM staff) SELECT lower(k) AS v FROM w", "SELECT substr(k, 1, 1) AS v FROM (SELECT {c} AS k FROM staff)", "SELECT explode(split({c}, '')) AS v FROM staff",
    "SELECT s.v FROM visits, LATERAL (SELECT emp AS v FROM staff WHERE {c} = 'x') s", "SELECT transform(array(1), i -> {c}) AS v FROM staff", "SELECT hash({c}) AS v FROM staff TABLESAMPLE (100 PERCENT)",
]
#: Statements and the shape of their answers.
SHAPES = [
    ("SELECT * FROM staff", "ppmmhh"), ("SELECT contact AS c, phone AS p, emp FROM staff", "mmp"), ("SELECT k FROM (SELECT phone AS k FROM staff)", "m"), ("WITH w AS (SELECT badge AS b, nick FROM staff) SELECT nick FROM w", "p"),
    ("SELECT phone FROM reachable", "m"), ("SELECT s.pin, v.visit FROM staff s JOIN visits v USING (emp)", "hp"), ("SELECT a.phone, b.contact FROM staff a CROSS JOIN staff b", "mm"), ("TABLE visits", "ppp"), ("VALUES (1, 'a'), (2, 'b')", "pp"),
    ("SELECT upper(nick) AS u, emp % 2 AS e FROM staff WHERE nick LIKE '%s'", "pp"), ("SELECT emp, sum(minutes) AS m FROM visits GROUP BY emp HAVING count(*) > 1", "pp"), ("SELECT avg(minutes) OVER (PARTITION BY emp) AS a FROM visits", "p"),
    ("SELECT nick FROM staff UNION SELECT 'else'", "p"), ("SELECT to_json(struct(v.*)) AS j FROM visits v", "p"), ("SELECT visit, (SELECT count(*) FROM staff s WHERE s.emp = v.emp) AS n FROM visits v", "pp"), ("SELECT 1 AS one; -- the end", "p"),
    ("SELECT emp, phone FROM staff ORDER BY emp DESC LIMIT 1 OFFSET 1", "pm"), ("SELECT count(*) AS n FROM staff TABLESAMPLE (100 PERCENT)", "p"), ("SELECT n, sum(n) OVER (ORDER BY n ROWS 1 PRECEDING) AS s FROM range(3) t(n)", "pp"),
]
#: Statements and the refusal that each meets.
REFUSED = [
    ("TABLE vault", "TableRefused"), ("SELECT count(*) AS n FROM VAULT", "TableRefused"), ("SELECT * FROM opened", "TableRefused"), ("SELECT emp FROM staff WHERE (SELECT count(*) FROM vault) > 0", "TableRefused"), ("SELECT * FROM somewhere.staff", "TableRefused"),
    ("SELECT * FROM csv.`/etc/passwd`", "TableRefused"), ("SELECT * FROM IDENTIFIER('vault')", "TableRefused"), ("SELECT * FROM IDENTIFIER('parquet.`/tmp/x`')", "TableRefused"), ("WITH w AS (SELECT * FROM IDENTIFIER('va' || 'ult')) SELECT * FROM w", "TableRefused"),
    ("SELECT emp FROM visits WHERE emp IN (SELECT 1 FROM IDENTIFIER('vault'))", "TableRefused"), ("SELECT IDENTIFIER('badge') FROM staff", "FunctionDenied"), ("SELECT IDENTIFIER('reflect')('java.lang.Runtime', 'getRuntime') AS r", "FunctionDenied"),
    ("SELECT emp FROM staff ORDER BY IDENTIFIER('pin')", "FunctionDenied"), ("SELECT IDENTIFIER('up' || 'per')(nick) AS u FROM staff", "FunctionDenied"), ("SELECT reflect('java.lang.System', 'nanoTime') AS t", "FunctionDenied"), ("SELECT homemade(emp) FROM staff", "FunctionDenied"),
    ("SELECT system.builtin.upper(nick) AS u FROM staff", "FunctionDenied"), ("SELECT input_file_name() AS f FROM visits", "FunctionDenied"), ("SELECT current_user() AS u", "FunctionDenied"), ("SELECT struct(*) AS s FROM staff", "MaskedColumnUsed"),
    ("SELECT to_json(struct(s.*)) AS j FROM staff s", "MaskedColumnUsed"), ("SELECT c FROM shouted", "MaskedColumnUsed"), ("WITH RECURSIVE r(k, n) AS (SELECT pin, 1 FROM staff UNION ALL SELECT k, n + 1 FROM r WHERE n < 3) SELECT k FROM r", "MaskedColumnUsed"),
    ("SELECT * FROM staff NATURAL JOIN (SELECT 'badge-a' AS badge)", "MaskedColumnUsed"), ("SELECT emp FROM staff; SELECT 1", "MultipleStatements"), ("  ", "EmptyStatement"), ("", "MissingSql"), ("/* nothing */", "EmptyStatement"), ("TRUNCATE TABLE visits", "StatementNotRead"),
    ("UPDATE staff SET nick = 'x'", "StatementNotRead"), ("CREATE TABLE t AS SELECT 1", "StatementNotRead"), ("SHOW TABLES", "StatementNotRead"), ("DESCRIBE staff", "StatementNotRead"), ("CACHE TABLE staff", "StatementNotRead"), ("ADD JAR '/tmp/x.jar'", "StatementNotRead"),
    ("SELECT * FROM absent", "TableNotFound"), ("SELECT wages FROM staff", "SqlFailed"), ("SELEC emp FROM staff", "SqlFailed"), ("SELECT sum(minutes) OVER (ORDER BY visit GROUPS 2 PRECEDING) AS s FROM visits", "UnsupportedFrame"),
]


def verdict(db, sql):
    try:
        return db._shape(*db._checked(sql))
    except errors.Refusal as refusal:
        return refusal.name


@pytest.mark.parametrize("use", USES)
def test_guarded_values_only_leave_as_they_are(db, use):
    assert {verdict(db, use.format(c=c)) for c in GUARDED} == {"MaskedColumnUsed"}


@pytest.mark.parametrize("sql, wanted", SHAPES + REFUSED)
def test_verdict(db, sql, wanted):
    assert verdict(db, sql) == wanted


def test_the_same_is_refused_where_hidden_reads_as_null(spark):
    lax = make(spark, False)
    for sql, wanted in REFUSED:
        if wanted in ("TableRefused", "FunctionDenied"):
            assert verdict(lax, sql) == wanted, sql
    for use in USES:
        assert {verdict(lax, use.format(c=c)) for c in ("phone", "contact")} == {"MaskedColumnUsed"}, use


def test_answers_show_no_secret(db):
    for sql, _ in SHAPES:
        text = db.query(sql).rendered.text
        assert not any(x in text for x in SECRETS), sql


def test_masked_and_hidden_values(db):
    answer = db.query("SELECT * FROM staff ORDER BY emp")
    assert answer.rendered.text.startswith('[[11,"Ines","******42","i***@clinic.test",null,null]') and answer.shape == "ppmmhh" and not answer.more


def test_hidden_reads_as_null_unless_strict(spark):
    text = make(spark, False).query("SELECT emp, length(badge) AS n, pin IS NULL AS none FROM staff ORDER BY emp").rendered.text
    assert text == '[[11,null,"true"],[12,null,"true"],[13,null,"true"]]'


def test_data_without_a_registered_name_is_refused(db, small):
    from korrel.plans import guard

    with pytest.raises(errors.TableRefused):
        guard.origins(db.spark.read.parquet(f"{small}/region.parquet"), db.access)


def test_every_operation_counts_against_the_rate(spark):
    db = Database(spark, limits=Limits(rate_per_minute=3, timeout_ms=60_000))
    db.add("n", db.spark.range(3))
    assert db.count("n") == 3 and db.explain("SELECT id FROM n") and db.sample("n").rendered.text
    for call in (lambda: db.count("n"), lambda: db.explain("SELECT id FROM n"), lambda: db.sample("n")):
        with pytest.raises(errors.RateLimited):
            call()


MASKS = [
    (Mask("email"), "tomas@clinic.test", "t***@clinic.test"), (Mask("email"), "nobody", "**body"), (Mask("email"), "@clinic.test", "********test"), (Mask("email"), "ørn@b.c", "ø***@b.c"),
    (Mask("full"), "anything", "***"), (Mask("partial"), "DE0012345678", "********5678"), (Mask("partial"), "xy", "***"), (Mask("partial", 3), "ßçñøå", "**ñøå"), (Mask("partial", 0), "key", "***"), (Mask("full"), None, None),
]


def test_masks(spark):
    from pyspark.sql import functions as F

    for mask, text, wanted in MASKS:
        assert spark.createDataFrame([(text,)], "t string").select(mask.column(F.col("t"))).first()[0] == wanted


def by_hand(mask: Mask, text: str) -> str:
    partial = "*" * max(len(text), 3) if len(text) <= mask.keep else "*" * (len(text) - mask.keep) + text[len(text) - mask.keep :]
    if mask.mode == "partial":
        return partial
    at = text.rfind("@")
    return partial if at < 1 else text[0] + "***" + text[at:]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab@é.", max_size=9), min_size=1, max_size=30), st.sampled_from(["email", "partial"]), st.integers(0, 5))
def test_masks_by_hand(spark, texts, mode, keep):
    from pyspark.sql import functions as F

    mask = Mask(mode, keep)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mask.column(F.col("t")).alias("m")).collect()
    assert all(r["m"] == by_hand(mask, r["t"]) for r in rows)


def test_rules_are_checked_and_merged():
    for bad in ("users", "a.b]", ".x", "x."):
        with pytest.raises(errors.InvalidDbConfig):
            Access(hidden=[bad])
    both = Access(hidden=["a.b"], allowed=["a", "c"]).merged(Access(masked={"a.b": Mask()}, blocked=["d"], allowed=["A"]))
    assert both.treatment("A", "B") == "hidden" and both.table("a") == "open" and both.table("c") == "not allowed" and both.table("d") == "blocked"


def test_limits():
    for bad in ({"max_rows": 0}, {"max_rows": 10_001}, {"timeout_ms": 120_001}):
        with pytest.raises(errors.LimitOutOfRange):
            Limits(**bad)
    now = [0.0]
    limiter = Limiter(2, lambda: now[0])
    limiter.admit()
    limiter.admit()
    with pytest.raises(errors.RateLimited):
        limiter.admit()
    now[0] = 60.0
    limiter.admit()


def test_row_cap_and_timeout(spark):
    db = Database(spark, limits=Limits(max_rows=5, timeout_ms=60_000))
    db.add("big", db.spark.range(100).withColumnRenamed("id", "n"))
    answer = db.query("SELECT n FROM big ORDER BY n", "csv")
    assert answer.more and answer.stopped == "rows" and answer.rendered.text == "n\n0\n1\n2\n3\n4\n"
    slow = Database(spark, limits=Limits(timeout_ms=300))
    slow.add("big", slow.spark.range(200_000).withColumnRenamed("id", "n"))
    with pytest.raises(errors.QueryTimeout):
        slow.query("SELECT sum(a.n * b.n) AS s FROM big a, big b WHERE a.n + b.n > 7")


def test_choose_a_database(spark):
    known = Databases()
    with pytest.raises(errors.NoDatabase):
        known.choose()
    known.known |= {"a": "A", "b": "B"}
    with pytest.raises(errors.DbNameRequired):
        known.choose()
    with pytest.raises(errors.UnknownDatabase):
        known.choose("c")
    assert known.choose("b") == "B"


def test_rendering():
    rows = [(1, 'a,"b"', None, b"\x01\xff", float("nan")), (2, "x|y\nz", True, b"0" * 65, 2.5)]
    columns = ["id", "t", "n", "b", "f"]
    assert Renderer("json", 100, 10_000).render(columns, rows).text == '[[1,"a,\\"b\\"",null,"x\'01ff\'","NaN"],[2,"x|y\\nz","true","<blob 65 bytes>",2.5]]'
    assert Renderer("csv", 100, 10_000).render(columns, rows).text == 'id,t,n,b,f\n1,"a,""b""",,x\'01ff\',NaN\n2,"x|y\nz",true,<blob 65 bytes>,2.5\n'
    assert "x\\|y<br>z" in Renderer("markdown", 100, 10_000).render(columns, rows).text
    cut = Renderer("json", 3, 10_000).render(["t"], [("abcdef",)])
    assert cut.text == '[["abc…[+3 chars]"]]' and cut.cut_cells == 1
    stopped = Renderer("csv", 100, 12).render(["t"], [("abcd",), ("efgh",), ("i",)])
    assert stopped.rows == 2 and stopped.stopped == "bytes"
    with pytest.raises(errors.UnknownFormat):
        Renderer("xml", 1, 1)


def test_writes(spark):
    db = make(spark, True)
    with pytest.raises(errors.WriteNotGranted):
        Writer(db, None).delete("visits", "visit = 70")
    writer = Writer(db, WriteGrant())
    assert writer.update("visits", {"minutes": "minutes + 1"}, "visit = 70").rows_affected == 1
    with pytest.raises(errors.DestructiveNotGranted):
        writer.delete("visits")
    with pytest.raises(errors.GuardedColumnInWrite):
        writer.update("staff", {"phone": "'x'"}, "emp = 11")
    with pytest.raises(errors.TableRefused):
        writer.delete("vault")
    assert db.count("visits") == 3
    assert Writer(db, WriteGrant(destructive=True)).delete("visits").destructive and db.count("visits") == 0
    now = [0.0]
    late = WriteGrant(clock=lambda: now[0])
    now[0] = 901.0
    with pytest.raises(errors.WriteNotGranted):
        Writer(db, late).delete("visits", "visit = 70")


@pytest.mark.parametrize("value, wanted", [
    ("contact", "GuardedColumnInWrite"), ("`phone`", "GuardedColumnInWrite"), ("nick||badge", "GuardedColumnInWrite"), ("to_json(struct(*))", "GuardedColumnInWrite"), ("concat_ws(',', array(pin))", "GuardedColumnInWrite"),
    ("CASE WHEN PIN IS NULL THEN 'a' END", "GuardedColumnInWrite"), ("transform(array(1), i -> staff.badge)[0]", "SqlFailed"), ("(SELECT max(entry) FROM vault)", "GuardedColumnInWrite"), ("EXISTS (SELECT 1 FROM staff)", "GuardedColumnInWrite"),
    ("reflect('java.lang.System', 'nanoTime')", "FunctionDenied"), ("IDENTIFIER('badge')", "FunctionDenied"), ("IDENTIFIER('reflect')('java.lang.System', 'nanoTime')", "FunctionDenied"), ("homemade(nick)", "FunctionDenied"),
    ("max(nick)", "ActionDenied"), ("row_number() OVER (ORDER BY emp)", "ActionDenied"), ("lag(badge) OVER (ORDER BY emp)", "ActionDenied"), ("upper(explode(array('a', 'b')))", "SqlFailed"), ("nick +", "SqlFailed"), ("absent", "SqlFailed"),
])
def test_writes_neither_read_guarded_columns_nor_call_what_is_not_listed(spark, db, value, wanted):
    for write in (lambda: Writer(db, WriteGrant()).update("staff", {"nick": value}, "emp = 11"), lambda: Writer(db, WriteGrant()).delete("staff", f"cast({value} AS STRING) = 'x'")):
        try:
            write()
            found = "none"
        except errors.Refusal as refusal:
            found = refusal.name
        assert found == wanted


def test_sql_writes(spark):
    db = make(spark, True)
    run = lambda sql, **grant: Writer(db, WriteGrant(**grant)).run(sql)
    assert run("INSERT INTO visits VALUES (80, 12, 1.5), (81, 12, 2)").rows_affected == 2
    assert run("INSERT INTO visits (emp, visit) SELECT emp, emp + 100 FROM staff").rows_affected == 3
    assert run("UPDATE visits SET minutes = visit * 2, emp = 99 WHERE visit >= 100").rows_affected == 3
    assert run("DELETE FROM visits WHERE emp = 99 AND visit < 113;").rows_affected == 2
    assert [tuple(r) for r in db.frame("SELECT visit, emp, minutes FROM visits WHERE visit > 72 ORDER BY visit").collect()] == [(80, 12, 1.5), (81, 12, 2.0), (113, 99, 226.0)]
    for sql, wanted in [
        ("SELECT 1", "StatementOnlyReads"), ("", "EmptyStatement"), ("UPDATE staff SET nick = lower(contact)", "GuardedColumnInWrite"), ("UPDATE staff SET pin = '0'", "GuardedColumnInWrite"), ("DELETE FROM staff WHERE badge = 'x'", "GuardedColumnInWrite"),
        ("INSERT INTO visits SELECT emp, emp, phone FROM staff", "GuardedColumnInWrite"), ("INSERT INTO visits SELECT emp, emp, length(pin) FROM staff", "MaskedColumnUsed"), ("INSERT INTO visits SELECT 1, 2, entry FROM vault", "TableRefused"), ("DELETE FROM vault", "TableRefused"),
        ("DELETE FROM IDENTIFIER('vault')", "TableRefused"), ("DELETE FROM a.visits", "TableRefused"), ("TRUNCATE TABLE visits", "DestructiveNotGranted"), ("DROP TABLE visits", "DestructiveNotGranted"), ("INSERT OVERWRITE visits VALUES (1, 2, 3)", "ActionDenied"), ("CREATE TABLE x (a INT)", "ActionDenied"), ("INSERT INTO visits VALUES (1)", "SqlFailed"),
    ]:
        try:
            run(sql)
            found = "none"
        except errors.Refusal as refusal:
            found = refusal.name
        assert found == wanted, sql
    assert run("TRUNCATE TABLE visits", destructive=True).rows_affected == 6 and db.count("visits") == 0
    assert run("DROP TABLE visits", destructive=True).destructive and "visits" not in db.tables()[0]


def test_sql_writes_by_the_statements_own_names(spark):
    db = make(spark, True)
    run = lambda sql, **grant: Writer(db, WriteGrant(**grant)).run(sql)
    for sql, wanted in [
        ("INSERT INTO visits (visit, nosuch, minutes) VALUES (90, 5, 1.5)", "SqlFailed"), ("INSERT INTO staff (emp, /*x*/ phone) VALUES (1, 'x')", "GuardedColumnInWrite"), ("INSERT INTO visits (visit, visit) VALUES (1, 2)", "SqlFailed"),
        ("INSERT INTO staff (emp, `phone`) VALUES (1, 'x')", "GuardedColumnInWrite"), ("UPDATE visits v SET w.minutes = 1 WHERE w.emp = 1", "SqlFailed"), ("DELETE FROM staff s WHERE s.phone = 'x'", "GuardedColumnInWrite"), ("CREATE TABLE vault AS SELECT 1 AS a", "TableRefused"), ("CREATE TABLE copy AS SELECT phone FROM staff", "GuardedColumnInWrite"), ("CREATE TABLE visits AS SELECT 1 AS a", "SqlFailed"),
    ]:
        try:
            run(sql)
            found = "none"
        except errors.Refusal as refusal:
            found = refusal.name
        assert found == wanted, sql
    before = db.count("visits")
    assert run("INSERT INTO visits /* (emp) */ (minutes, visit) SELECT 1.5, 90 WHERE '(values' <> ')'").rows_affected == 1
    assert db.count("visits") == before + 1 and [tuple(r) for r in db.frame("SELECT emp, minutes FROM visits WHERE visit = 90").collect()] == [(None, 1.5)]
    assert run("UPDATE visits AS v SET minutes = v.minutes + 1 WHERE v.visit = 90").rows_affected == 1
    assert run("DELETE FROM visits v WHERE v.visit = 90").rows_affected == 1
    assert run("CREATE TABLE late AS SELECT visit, minutes FROM visits WHERE minutes > 0").rows_affected == db.count("late")


def test_written_values_stay(spark):
    db = make(spark, True)
    Writer(db, WriteGrant(destructive=True)).run("UPDATE visits SET minutes = cast(unix_micros(now()) AS double) + rand()")
    read = lambda: sorted(r["minutes"] for r in db.frame("SELECT minutes FROM visits").collect())
    assert read() == read()
    Writer(db, WriteGrant()).insert("visits", spark.range(3).selectExpr("id AS visit", "rand() AS minutes"))
    assert read() == read()


def test_writes_in_a_dialect(spark):
    db = make(spark, True, dialect="postgres")
    run = lambda sql: Writer(db, WriteGrant(destructive=True)).run(sql)
    assert run("UPDATE visits SET minutes = strpos('abc', 'b')::double precision WHERE visit = 70").rows_affected == 1
    assert [r["minutes"] for r in db.frame("SELECT minutes FROM visits WHERE visit = 70").collect()] == [2.0]
    assert run("DELETE FROM visits v WHERE strpos(v.visit::text, '7') = 1").rows_affected > 0


def test_tables_with_readers_of_their_own(spark, tmp_path):
    import sqlite3

    from korrel.sources.files import sqlite_table

    path = str(tmp_path / "own.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER, day DATE, at DATETIME, price NUMERIC, mixed DECIMAL, big NUMERIC, flag BOOLEAN, note TEXT, ratio REAL, vacant NUMERIC)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, NULL)", [(1, "2020-01-02", "2020-01-02 03:04:05", 1.5, 7, 1 << 60, 1, "a", 2), (2, None, "x", 2, "n/a", 1, 0, None, 0.5)])
    db = Database(spark, Access(masked={"t.note": Mask("full")}))
    df = sqlite_table(db.spark, path, "t")
    assert dict(df.dtypes) == {"id": "bigint", "day": "string", "at": "string", "price": "double", "mixed": "string", "big": "bigint", "flag": "bigint", "note": "string", "ratio": "double", "vacant": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "2020-01-02", "2020-01-02 03:04:05", 1.5, "7", 1 << 60, 1, "a", 2.0, None), (2, None, "x", 2.0, "n/a", 1, 0, None, 0.5, None)]
    db.add("t", df)
    assert [tuple(r) for r in db.frame("SELECT id, note, count(*) OVER () AS n FROM t ORDER BY id").collect()] == [(1, "***", 2), (2, None, 2)]
    with pytest.raises(errors.MaskedColumnUsed):
        db.frame("SELECT upper(note) FROM t")
    db.add_view("w", "SELECT id, note AS other FROM t")
    with pytest.raises(errors.MaskedColumnUsed):
        db.frame("SELECT length(other) FROM w")
    with pytest.raises(errors.Refusal):
        db.add_view("x", "DROP TABLE t")


def test_dialect_rewriting():
    assert rewrite("SELECT total(x) FILTER (WHERE y > 1) FROM t", "sqlite") == "SELECT (coalesce(sum(cast(x AS DOUBLE)) FILTER (WHERE y > 1), 0.0D)) FROM t"
    assert rewrite("SELECT 'iif(1,2,3)', iif(a, 'x)', b)", "sqlite") == "SELECT 'iif(1,2,3)', if(a, 'x)', b)"
    assert "startswith(a, 'b')" in rewrite("SELECT starts_with(a, 'b')", "postgres")


def test_recursion_has_as_many_rows_as_it_has(spark):
    db = Database(spark)
    db.add("many", db.spark.range(300_000).toDF("a"))
    assert db.frame("WITH RECURSIVE t(a, d) AS (SELECT a, 0 FROM many UNION ALL SELECT a, d + 1 FROM t WHERE d < 3) SELECT a, d FROM t").count() == 1_200_000
