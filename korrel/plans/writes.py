"""Changes to registered tables under a grant: a new DataFrame takes the table's place, or nothing changes."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.functions.dialect import rewrite
from korrel.plans import guard
from korrel.plans.database import Database
from korrel.plans.errors import ActionDenied, DestructiveNotGranted, EmptyStatement, GuardedColumnInWrite, SqlFailed, StatementOnlyReads, TableNotFound, TableRefused, WriteNotGranted
from korrel.session import checkpointed

ARMED_SECONDS, ACTIVE_SECONDS = 15 * 60, 60 * 60


@dataclass
class WriteGrant:
    """Armed until first used, then active for a while. ``destructive`` allows emptying and dropping."""

    destructive: bool = False
    table: str | None = None
    clock: object = time.monotonic
    armed_at: float = field(default=0.0)
    used_at: float | None = None
    revoked: bool = False

    def __post_init__(self):
        self.armed_at = self.clock()

    def use(self, table: str) -> None:
        now = self.clock()
        late = now - self.armed_at > ARMED_SECONDS if self.used_at is None else now - self.used_at > ACTIVE_SECONDS
        if self.revoked or late or self.table not in (None, table):
            raise WriteNotGranted()
        self.used_at = now if self.used_at is None else self.used_at


@dataclass
class Written:
    action: str
    table: str
    rows_affected: int
    destructive: bool
    elapsed_ms: int


class Writer:
    def __init__(self, db: Database, grant: WriteGrant | None):
        self.db, self.grant = db, grant

    def _open(self, table: str) -> DataFrame:
        if self.grant is None:
            raise WriteNotGranted()
        if self.db.access.table(table) != "open":
            raise TableRefused(table)
        if table.lower() not in self.db.frames:
            raise TableNotFound(table)
        self.grant.use(table)
        return self.db.frames[table.lower()]

    def _named(self, table: str, alias: str | None) -> DataFrame:
        """The table under the name that its columns may have before them."""
        frame = self.db.frames[table.lower()]
        return frame.alias(alias) if alias else frame

    def _expression(self, table: str, text: str, alias: str | None = None, rewritten: bool = False) -> Column:
        """An expression over one row, of listed functions and columns that aren't guarded, by the analyzed plan."""
        old = self._named(table, alias)
        text = text if rewritten or self.db.dialect == "spark" else rewrite(text, self.db.dialect)
        try:
            stack = [self._parser().parseExpression(text)]
        except (ParseException, Py4JJavaError) as error:
            raise SqlFailed(str(error).splitlines()[0][:300]) from None
        while stack:
            e = stack.pop()
            if guard._kind(e) in guard._SUBQUERIES or "Subquery" in guard._kind(e):
                raise GuardedColumnInWrite("a subquery")
            if "Window" in guard._kind(e):
                raise ActionDenied("an expression over more than a row")
            guard.check_expression(e, self.db.functions)
            stack += guard._seq(e.children())
        try:
            plan = old.select(F.expr(text).alias("value"))._jdf.queryExecution().analyzed()
        except AnalysisException as error:
            raise SqlFailed(str(error).splitlines()[0][:300]) from None
        if guard._kind(plan) != "Project" or not plan.child().sameResult(old._jdf.queryExecution().analyzed()):
            raise ActionDenied("an expression over more than a row")
        names = {a.exprId().id(): a.name() for a in guard._seq(plan.child().output())}
        for e in guard._expressions(plan):
            name = names.get(e.exprId().id()) if guard._kind(e) == "AttributeReference" else None
            if name is not None and self.db.access.treatment(table, name) != "plain":
                raise GuardedColumnInWrite(name)
        return F.expr(text)

    def _parser(self):
        return self.db.spark._jsparkSession.sessionState().sqlParser()

    def _swap(self, action: str, table: str, new: DataFrame, affected: int, destructive: bool, began: float) -> Written:
        """``new`` takes the table's place; it is written already, so that its values are what they are."""
        if destructive and not self.grant.destructive:
            raise DestructiveNotGranted(f"{action} {table}")
        self.db.add(table, new)
        return Written(action, table, affected, destructive, round(1000 * (time.monotonic() - began)))

    def insert(self, table: str, rows: DataFrame) -> Written:
        """Rows by the names of their columns; those that aren't named are null."""
        began, old = time.monotonic(), self._open(table)
        known = {f.name.lower() for f in old.schema.fields}
        for c in rows.columns:
            if self.db.access.treatment(table, c) != "plain":
                raise GuardedColumnInWrite(c)
            if c.lower() not in known:
                raise SqlFailed(f"no column {c}")
        fields = {f.name.lower(): f for f in rows.schema.fields}
        if len(fields) < len(rows.columns):
            raise SqlFailed("a column is named twice")
        same = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name.lower() in fields else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields))
        added = checkpointed(same)
        return self._swap("insert", table, checkpointed(old.unionAll(added)), added.count(), False, began)

    def update(self, table: str, values: dict[str, str], where: str = "true", alias: str | None = None, rewritten: bool = False) -> Written:
        began, old = time.monotonic(), self._open(table)
        for c in values:
            if self.db.access.treatment(table, c) != "plain":
                raise GuardedColumnInWrite(c)
        low = {k.lower(): self._expression(table, v, alias, rewritten) for k, v in values.items()}
        if unknown := set(low) - {c.lower() for c in old.columns}:
            raise SqlFailed(f"no column {sorted(unknown)[0]}")
        hit = F.coalesce(self._expression(table, where, alias, rewritten), F.lit(False))
        named = self._named(table, alias).withColumn("__hit", hit)
        changed = checkpointed(named.select(*(F.when(F.col("__hit"), low[f.name.lower()]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name.lower() in low else F.col(f"`{f.name}`") for f in old.schema.fields), "__hit"))
        told = changed.agg(F.count("*").alias("n"), F.count_if("__hit").alias("hit")).first()
        return self._swap("update", table, changed.drop("__hit"), told["hit"], told["hit"] == told["n"] and told["n"] > 1, began)

    def delete(self, table: str, where: str = "true", alias: str | None = None, rewritten: bool = False) -> Written:
        began, old = time.monotonic(), self._open(table)
        hit = F.coalesce(self._expression(table, where, alias, rewritten), F.lit(False))
        marked = checkpointed(self._named(table, alias).select(*(F.col(f"`{c}`") for c in old.columns), hit.alias("__hit")))
        told = marked.agg(F.count("*").alias("n"), F.count_if("__hit").alias("hit")).first()
        return self._swap("delete", table, marked.filter("not __hit").drop("__hit"), told["hit"], told["hit"] == told["n"] and told["n"] > 1, began)

    def create(self, table: str, rows: DataFrame) -> Written:
        """A new table of the rows. The grant has to name it, or no table."""
        began = time.monotonic()
        if self.grant is None:
            raise WriteNotGranted()
        if self.db.access.table(table) != "open":
            raise TableRefused(table)
        if table.lower() in {*self.db.frames, *self.db.views}:
            raise SqlFailed(f"{table} is there already")
        self.grant.use(table)
        made = checkpointed(rows)
        return self._swap("create", table, made, made.count(), False, began)

    def drop(self, table: str) -> Written:
        began, _ = time.monotonic(), self._open(table)
        if not self.grant.destructive:
            raise DestructiveNotGranted(f"drop {table}")
        n = self.db.frames.pop(table.lower()).count()
        self.db.spark.catalog.dropTempView(table)
        return Written("drop", table, n, True, round(1000 * (time.monotonic() - began)))

    def truncate(self, table: str) -> Written:
        began, old = time.monotonic(), self._open(table)
        return self._swap("truncate", table, old.limit(0), old.count(), True, began)

    def run(self, sql: str) -> Written:
        """INSERT, UPDATE, DELETE, TRUNCATE, DROP or CREATE TABLE AS as one statement over one table, in the database's
        dialect; the table may have another name in it. What an INSERT reads is read
        like any query, and no guarded column may be in it. Reading statements don't belong here."""
        text = guard.without_trailing(sql)
        if not text:
            raise EmptyStatement()
        if text.split(None, 1)[0].lower() in ("select", "with", "values", "table", "from"):
            raise StatementOnlyReads()
        text = rewrite(text, self.db.dialect) if self.db.dialect != "spark" else text
        try:
            plan = self._parser().parsePlan(text)
        except (ParseException, Py4JJavaError) as error:
            raise SqlFailed(str(error).splitlines()[0][:300]) from None
        kind = guard._kind(plan)
        if kind == "DeleteFromTable":
            return self.delete(self._target(plan.table()), plan.condition().sql(), self._alias(plan.table()), True)
        if kind == "UpdateTable":
            values = {str(guard._seq(a.key().nameParts())[-1]): a.value().sql() for a in guard._seq(plan.assignments())}
            return self.update(self._target(plan.table()), values, plan.condition().get().sql() if plan.condition().isDefined() else "true", self._alias(plan.table()), True)
        if kind == "InsertIntoStatement":
            if plan.overwrite() or guard._seq(plan.partitionSpec().keys().toSeq()):
                raise ActionDenied("only INSERT INTO table [(columns)] query")
            table = self._target(plan.table())
            old, rows = self._open(table), self._rows(plan.query(), text)
            names = [str(x) for x in guard._seq(plan.userSpecifiedCols())] or old.columns
            if len(names) != len(rows.columns):
                raise SqlFailed(f"{len(rows.columns)} values for {len(names)} columns")
            return self.insert(table, rows.toDF(*names))
        if kind == "CreateTableAsSelect":
            return self.create(self._target(plan.name()), self._rows(plan.query(), text))
        if kind == "TruncateTable":
            return self.truncate(self._target(plan.table()))
        if kind == "DropTable":
            return self.drop(self._target(plan.child()))
        raise ActionDenied(kind)

    def _rows(self, query, text: str) -> DataFrame:
        """The reading part of a statement, checked like any query; no guarded column may be in it."""
        origin, raw = query.origin(), text.encode("utf-16-le")
        if not origin.startIndex().isDefined():
            raise ActionDenied("a query without a place in the statement")
        own = raw[2 * origin.startIndex().get() : 2 * origin.stopIndex().get() + 2].decode("utf-16-le")
        rows, origins = self.db._checked(own, rewritten=True)
        if any(origins):
            raise GuardedColumnInWrite("what the query reads")
        return rows

    def _alias(self, node) -> str:
        return str(node.alias()) if guard._kind(node) == "SubqueryAlias" else self._target(node)

    def _target(self, node) -> str:
        while guard._kind(node) == "SubqueryAlias":
            node = node.child()
        names = {"UnresolvedRelation": "multipartIdentifier", "UnresolvedTable": "multipartIdentifier", "UnresolvedTableOrView": "multipartIdentifier", "UnresolvedIdentifier": "nameParts"}
        if guard._kind(node) not in names:
            raise TableRefused(guard._kind(node))
        parts = [str(x) for x in guard._seq(getattr(node, names[guard._kind(node)])())]
        if len(parts) != 1:
            raise TableRefused(".".join(parts))
        return parts[0]
