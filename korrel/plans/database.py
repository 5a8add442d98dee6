"""A database: named tables under access rules, answered by one reading statement at a time."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import internal
from korrel.functions.dialect import rewrite
from korrel.plans import guard
from korrel.plans.errors import LimitOutOfRange, MissingSql, MissingTable, QueryTimeout, RateLimited, TableNotFound, TableRefused, UnknownDatabase
from korrel.plans.policy import Access, Mask, hide
from korrel.session import TABLES, load
from korrel.sources.render import Rendered, Renderer

CEILING = {"max_rows": 10_000, "max_cell_chars": 100_000, "max_result_bytes": 200_000, "timeout_ms": 120_000, "rate_per_minute": 10_000}
RATE_SECONDS = 60
_COPIED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")


@dataclass
class Limits:
    max_rows: int = 200
    max_cell_chars: int = 2000
    max_result_bytes: int = 16_000
    timeout_ms: int = 5_000
    rate_per_minute: int = 60

    def __post_init__(self):
        for name, value in asdict(self).items():
            if not 0 < value <= CEILING[name]:
                raise LimitOutOfRange(f"{name}={value}")


@dataclass
class Answer:
    """``shape`` has a letter for each column: plain, masked or hidden. ``more``: rows were left out."""

    rendered: Rendered
    shape: str
    more: bool
    stopped: str
    nulled: list[str] = field(default_factory=list)
    elapsed_ms: int = 0


class Limiter:
    """At most so many calls in any sixty seconds."""

    def __init__(self, per_minute: int, clock=time.monotonic):
        self.per_minute, self.clock, self.calls = per_minute, clock, deque()

    def admit(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= RATE_SECONDS:
            self.calls.popleft()
        if len(self.calls) >= self.per_minute:
            raise RateLimited()
        self.calls.append(now)


class Database:
    """Tables are DataFrames. In the default dialect statements are Spark SQL; ``sqlite`` and ``postgres``
    statements have their functions rewritten first."""

    def __init__(self, spark: SparkSession, access: Access | None = None, limits: Limits | None = None, dialect: str = "spark"):
        self.access, self.limits, self.dialect = access or Access(), limits or Limits(), dialect
        self.spark = spark.newSession()
        for key in _COPIED:
            if value := spark.conf.get(key, None):
                self.spark.conf.set(key, value)
        # recursion ends by levels; Spark's cap on its rows in all would fail a statement over large tables
        self.spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        self.limiter = Limiter(self.limits.rate_per_minute)
        self.frames: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}
        self.functions = guard.builtin_functions(self.spark)
        if dialect != "spark":
            self.functions |= internal.register(self.spark)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, *names: str, **settings) -> Database:
        db = cls(spark, **settings)
        for name in names or TABLES:
            db.add(name, load(db.spark, sf_dir, name))
        return db

    def add(self, name: str, df: DataFrame, generated: list[str] = ()) -> None:
        """Register a table; hidden columns are NULL from here on, wherever they are read."""
        self.frames[name.lower()] = df
        hide(df, name, self.access, generated).createOrReplaceTempView(name)

    def add_view(self, name: str, sql: str) -> None:
        """A view of one reading statement over what is registered."""
        plan = guard.parse(self.spark, sql)
        guard.check_parsed(plan, self._names(), Access(), self.functions)
        self.views[name.lower()] = sql
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {sql}")

    def _names(self) -> set[str]:
        return {*self.frames, *self.views}

    def _open(self, table: str | None) -> str:
        if not table:
            raise MissingTable()
        if self.access.table(table) != "open":
            raise TableRefused(table)
        if table.lower() not in self._names():
            raise TableNotFound(table)
        return table

    def tables(self) -> tuple[list[str], int]:
        """The open tables, and how many others there are."""
        shown = sorted(x for x in self._names() if self.access.table(x) == "open")
        return shown, len(self._names()) - len(shown)

    def describe(self, table: str) -> list[dict]:
        name = self._open(table)
        columns = []
        for f in self.spark.table(name).schema.fields:
            treatment = self.access.treatment(name, f.name)
            label = treatment.mode if isinstance(treatment, Mask) else treatment
            columns.append({"name": f.name, "type": f.dataType.simpleString(), "not_null": not f.nullable, "access": label})
        return columns

    def frame(self, sql: str) -> DataFrame:
        """The checked statement as a DataFrame with masked columns masked. Nothing has run yet."""
        df, found = self._checked(sql)
        return self._treated(df, found)

    def _checked(self, sql: str, rewritten: bool = False):
        if not sql:
            raise MissingSql()
        text = rewrite(sql, self.dialect) if self.dialect != "spark" and not rewritten else sql
        plan = guard.parse(self.spark, text)
        guard.check_parsed(plan, self._names(), self.access, self.functions)
        df = guard.analyze(self.spark, text)
        return df, guard.origins(df, self.access)

    def _treated(self, df: DataFrame, found: list) -> DataFrame:
        if not any(found):
            return df
        names = [f"c{k}" for k in range(len(df.columns))]
        plain = df.toDF(*names)
        out = []
        for f, o, name in zip(df.schema.fields, found, names):
            c = F.col(name)
            out.append((o.treatment.column(c, f.dataType) if o and isinstance(o.treatment, Mask) else c).alias(f.name))
        return plain.select(*out)

    def _shape(self, df: DataFrame, found: list) -> str:
        hidden = {c.lower() for t in self.frames for c in self.frames[t].columns if self.access.treatment(t, c) == "hidden"}
        return "".join("m" if o and isinstance(o.treatment, Mask) else "h" if o or c.lower() in hidden else "p" for c, o in zip(df.columns, found))

    def query(self, sql: str, form: str = "json") -> Answer:
        self.limiter.admit()
        began = time.monotonic()
        df, found = self._checked(sql)
        rows = self._within(self._treated(df, found).limit(self.limits.max_rows + 1))
        more = len(rows) > self.limits.max_rows
        rendered = Renderer(form, self.limits.max_cell_chars, self.limits.max_result_bytes).render(df.columns, rows[: self.limits.max_rows])
        stopped = rendered.stopped if rendered.stopped != "none" else "rows" if more else "none"
        nulled = sorted({c for t in self.frames for c in self.frames[t].columns if self.access.treatment(t, c) == "hidden" and c in df.columns})
        return Answer(rendered, self._shape(df, found), more or rendered.stopped != "none", stopped, nulled, round(1000 * (time.monotonic() - began)))

    def _within(self, df: DataFrame) -> list:
        """Collect under the timeout: the job group is cancelled when it runs out."""
        out: dict = {}
        group, context = f"korrel-{uuid.uuid4().hex}", self.spark.sparkContext

        def work():
            context.setJobGroup(group, "query", interruptOnCancel=True)
            try:
                out["rows"] = df.collect()
            except Exception as error:
                out["error"] = error

        thread = threading.Thread(target=inheritable_thread_target(self.spark)(work), daemon=True)
        thread.start()
        thread.join(self.limits.timeout_ms / 1000)
        if thread.is_alive():
            context.cancelJobGroup(group)
            raise QueryTimeout(f"{self.limits.timeout_ms} ms")
        if "error" in out:
            raise out["error"]
        return out["rows"]

    def count(self, table: str) -> int:
        self.limiter.admit()
        return self._within(self.frame(f"SELECT count(*) AS n FROM {self._open(table)}"))[0]["n"]

    def sample(self, table: str, n: int = 20, form: str = "json") -> Answer:
        """The first ``n`` rows, not random ones."""
        return self.query(self._sample_sql(table, n), form)

    def sampled(self, table: str, n: int = 20) -> DataFrame:
        """What ``sample`` answers, as a DataFrame."""
        return self.frame(self._sample_sql(table, n))

    def _sample_sql(self, table: str, n: int) -> str:
        return f"SELECT * FROM {self._open(table)} LIMIT {min(max(1, n), self.limits.max_rows)}"

    def explain(self, sql: str) -> list[str]:
        self.limiter.admit()
        df, _ = self._checked(sql)
        return str(df._jdf.queryExecution().simpleString()).splitlines()


class Databases:
    """Several databases by name."""

    def __init__(self):
        self.known: dict[str, Database] = {}

    def choose(self, name: str | None = None) -> Database:
        from korrel.plans.errors import DbNameRequired, NoDatabase

        if not self.known:
            raise NoDatabase()
        if name is None:
            if len(self.known) > 1:
                raise DbNameRequired()
            return next(iter(self.known.values()))
        if name not in self.known:
            raise UnknownDatabase(name)
        return self.known[name]
