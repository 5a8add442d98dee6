"""What a statement may do: one reading statement, listed functions, open tables, guarded values by origin.

The parsed plan tells statement kinds, functions and tables before anything is resolved. The analyzed plan
tells where each value comes from: every occurrence of a guarded table seeds its columns' expression ids, and
ids are followed through projections, aliases, subqueries and views. A guarded value may leave the query as a
plain output; any other use of it (a predicate, a key, an expression, a set operation) refuses the statement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from korrel.plans.errors import (
    ActionDenied,
    EmptyStatement,
    FunctionDenied,
    MaskedColumnUsed,
    MultipleStatements,
    SqlFailed,
    StatementNotRead,
    TableNotFound,
    TableRefused,
    UnsupportedFrame,
)
from korrel.plans.policy import Access, Mask

#: Functions that reach outside the data, run code, or tell about the host.
DENIED_FUNCTIONS = set(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length spark_partition_id "
    "monotonically_increasing_id assert_true raise_error user current_user session_user sleep current_catalog "
    "from_avro to_avro from_protobuf to_protobuf sql_keywords collations read_files "
    "last_insert_rowid changes load_extension nextval".split()
)
#: Parsed or analyzed nodes through which values only pass, or that the walk below knows.
_PASS = set("SubqueryAlias View Filter Sort LocalLimit GlobalLimit Limit Offset ResolvedHint UnresolvedHint Subquery Repartition RepartitionByExpression LocalRelation OneRowRelation LogicalRelation Range Sample".split())
_SETS = set("Distinct Deduplicate Union Intersect Except UnionLoop".split())
_KNOWN = _PASS | _SETS | set("Project Aggregate Join LateralJoin AsOfJoin Window Generate Expand WithCTE CTERelationDef CTERelationRef UnionLoopRef Pivot Unpivot RebalancePartitions InlineCTE LogicalRDD".split())
#: What a parsed reading statement consists of besides; anything else, such as names made up by IDENTIFIER(), is refused.
_PARSED = _KNOWN | set(
    "UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases "
    "UnresolvedHaving WithWindowDefinition ResolvedInlineTable".split()
)
_SUBQUERIES = set("ScalarSubquery Exists ListQuery LateralSubquery".split())
_COMMANDS = re.compile(r"Insert|Delete|Update|Merge|Drop|Create|Alter|Truncate|Replace|Set|Reset|Cache|Uncache|Refresh|Show|Describe|Explain|Analyze|Load|Add|List|Comment|Use|Repair|Clear|Overwrite|Append|Command|Call|Execute|Declare")


def _seq(items) -> list:
    return [items.apply(k) for k in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(node):
    """All expressions of one node, their subexpressions too."""
    stack = _seq(node.expressions())
    while stack:
        e = stack.pop()
        yield e
        stack += _seq(e.children())
        if _kind(e) == "OuterReference":
            stack.append(e.e())


def _plans(node):
    """The node, its children and the plans of its subqueries."""
    stack = [node]
    while stack:
        one = stack.pop()
        yield one
        stack += _seq(one.children())
        stack += _seq(one.innerChildren()) if _kind(one) in ("UnresolvedWith", "View") else []
        if _kind(one) == "UnresolvedWith":
            stack += [pair._2() for pair in _seq(one.cteRelations())]
        for e in _expressions(one):
            if _kind(e) in _SUBQUERIES:
                stack.append(e.plan())


def without_trailing(sql: str) -> str:
    """The statement without comments and semicolons behind it."""
    text = sql.strip()
    while True:
        new = re.sub(r"(;|--[^\n'\"]*|/\*(?:[^*]|\*(?!/))*\*/)\s*$", "", text).rstrip()
        if new == text:
            return text
        text = new


def parse(spark: SparkSession, sql: str):
    """The parsed plan of one reading statement."""
    text = without_trailing(sql)
    if not text or not re.sub(r"--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", "", text).strip():
        raise EmptyStatement()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JJavaError) as error:
        said = str(error)
        if re.search(r"(?i)near '(?:groups|exclude)'|\bEXCLUDE\b|\bGROUPS\b", said) and re.search(r"(?i)\bover\b", text):
            raise UnsupportedFrame() from None
        if re.search(r"near ';'|extra input ';'|at or near \";\"", said) or re.search(r";\s*\S", _without_strings(text)):
            raise MultipleStatements() from None
        if re.match(r"(?i)\s*(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|vacuum|attach|pragma|begin|commit)\b", text) or re.search(r"(?i)\bfor\s+update\b", text):
            raise StatementNotRead() from None
        raise SqlFailed(said.splitlines()[0][:300]) from None
    for node in _plans(plan):
        if _COMMANDS.search(_kind(node)) and _kind(node) not in ("UnresolvedSubqueryColumnAliases", "SetOperation"):
            raise StatementNotRead(_kind(node))
    return plan


def _without_strings(text: str) -> str:
    return re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*", "''", text)


def check_parsed(plan, tables: set[str], access: Access, functions: set[str] | None) -> None:
    """Functions and tables that the parsed plan names."""
    names, relations = set(), set()
    for node in _plans(plan):
        kind = _kind(node)
        if kind == "PlanWithUnresolvedIdentifier":
            raise TableRefused("IDENTIFIER")
        if kind not in _PARSED:
            raise ActionDenied(kind)
        if kind == "UnresolvedWith":
            names |= {pair._1().lower() for pair in _seq(node.cteRelations())}
        elif kind == "UnresolvedRelation":
            relations.add(tuple(_seq(node.multipartIdentifier())))
        elif kind == "UnresolvedTableValuedFunction":
            _check_function([str(x) for x in _seq(node.name())], functions)
        for e in _expressions(node):
            check_expression(e, functions)
    for parts in relations:
        if len(parts) > 1:
            raise TableRefused(".".join(parts))
        name = parts[0].lower()
        if name in names:
            continue
        if access.table(name) != "open" or name.startswith("pg_") or name.startswith("sqlite_"):
            raise TableRefused(parts[0])
        if name not in tables:
            raise TableNotFound(parts[0])


def check_expression(e, functions: set[str] | None) -> None:
    """One parsed expression, without those in it."""
    if _kind(e) == "UnresolvedFunction":
        _check_function([str(x) for x in _seq(e.nameParts())], functions)
    if _kind(e) == "ExpressionWithUnresolvedIdentifier":
        raise FunctionDenied("IDENTIFIER")


def _check_function(parts: list[str], functions: set[str] | None) -> None:
    name = parts[-1].lower()
    if len(parts) > 1 or name in DENIED_FUNCTIONS or (functions is not None and name not in functions):
        raise FunctionDenied(".".join(parts))


_builtin: set[str] = set()


def builtin_functions(spark: SparkSession) -> set[str]:
    """Names of the session's built-in functions: what SHOW SYSTEM FUNCTIONS lists, without those denied."""
    if not _builtin:
        _builtin.update(row[0].lower() for row in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return _builtin - DENIED_FUNCTIONS


@dataclass(frozen=True)
class Origin:
    table: str
    column: str
    treatment: str | Mask


class _Walk:
    def __init__(self, access: Access):
        self.access, self.ctes, self.views = access, {}, 0

    def guarded(self, expression, found: dict) -> bool:
        stack = [expression]
        while stack:
            e = stack.pop()
            kind = _kind(e)
            if kind == "AttributeReference" and e.exprId().id() in found:
                return True
            stack += _seq(e.children())
            if kind == "OuterReference":
                stack.append(e.e())
        return False

    def plain(self, e, found: dict):
        """The guarded origin of an output that is a bare column, renamed or not."""
        while _kind(e) in ("Alias", "Cast", "UpCast"):
            child = e.children().apply(0)
            if _kind(e) != "Alias" and child.dataType().json() != e.dataType().json():
                return None
            e = child
        return found.get(e.exprId().id()) if _kind(e) == "AttributeReference" else None

    def node(self, node, outer: dict) -> dict:
        """Guarded ids of the node's output. ``outer``: those of the query around it."""
        kind = _kind(node)
        if kind not in _KNOWN:
            if not self.views:
                raise ActionDenied(kind)
            # what a registered table is made of, such as a reader of its own; nothing guarded may pass through it
            for child in _seq(node.children()):
                if self.node(child, outer):
                    raise MaskedColumnUsed(kind)
            return {}
        if kind in ("LogicalRelation", "LogicalRDD") and not self.views:
            raise TableRefused("data without a registered name")
        if kind == "View":
            self.views += 1
            try:
                return self._node(node, kind, outer)
            finally:
                self.views -= 1
        return self._node(node, kind, outer)

    def _node(self, node, kind: str, outer: dict) -> dict:
        if kind == "SubqueryAlias":
            name = node.identifier().name()
            if self.access.table(name) != "open" and _kind(node.child()) == "View":
                raise TableRefused(name)
            if self.access.guards(name) and _kind(node.child()) == "View":
                found = self.node(node.child(), outer)
                for a in _seq(node.output()):
                    treatment = self.access.treatment(name, a.name())
                    if isinstance(treatment, Mask) or treatment == "hidden" and self.access.strict:
                        found[a.exprId().id()] = Origin(name, a.name(), treatment)
                return found
        found: dict = {}
        if kind == "CTERelationRef" or kind == "UnionLoopRef":
            ids = self.ctes.get(node.cteId() if kind == "CTERelationRef" else node.loopId(), [])
            return {a.exprId().id(): o for a, o in zip(_seq(node.output()), ids) if o}
        if kind == "WithCTE":
            for definition in _seq(node.cteDefs()):
                inside = self.node(definition.child(), outer)
                self.ctes[definition.id()] = [inside.get(a.exprId().id()) for a in _seq(definition.output())]
            return self.node(node.plan(), outer)
        for child in _seq(node.children()):
            inside = self.node(child, outer)
            if kind in _SETS and any(a.exprId().id() in inside for a in _seq(child.output())):
                raise MaskedColumnUsed(kind)
            found |= inside
        seen = found | outer
        for e in _expressions(node):
            if _kind(e) in _SUBQUERIES:
                inside = self.node(e.plan(), seen)
                if any(a.exprId().id() in inside for a in _seq(e.plan().output())):
                    raise MaskedColumnUsed("a subquery's result")
        if kind == "Project":
            out = {}
            for e in _seq(node.projectList()):
                origin = self.plain(e, found)
                if origin:
                    out[e.exprId().id()] = origin
                elif self.guarded(e, seen):
                    raise MaskedColumnUsed(e.name())
            return out
        for e in _seq(node.expressions()):
            if kind not in ("View", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias") and self.guarded(e, seen):
                raise MaskedColumnUsed(kind)
        kept = {a.exprId().id() for a in _seq(node.output())}
        return {k: v for k, v in found.items() if k in kept}


def origins(df: DataFrame, access: Access) -> list[Origin | None]:
    """For each output column the guarded column it is, or None. Refuses any other use of guarded columns."""
    plan = df._jdf.queryExecution().analyzed()
    found = _Walk(access).node(plan, {})
    return [found.get(a.exprId().id()) for a in _seq(plan.output())]


def analyze(spark: SparkSession, sql: str) -> DataFrame:
    try:
        return spark.sql(without_trailing(sql))
    except AnalysisException as error:
        condition = error.getCondition() or ""
        if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
            raise TableNotFound(str(error).splitlines()[0][:200]) from None
        if condition.startswith("UNRESOLVED_ROUTINE"):
            raise FunctionDenied(str(error).splitlines()[0][:200]) from None
        raise SqlFailed(str(error).splitlines()[0][:300]) from None
