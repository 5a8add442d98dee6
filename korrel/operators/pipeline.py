"""Document commands (find, aggregate, distinct, countDocuments, updates) compiled to DataFrames.

A command is checked before anything runs: unknown and denied stages and operators, hidden and masked fields,
and collections out of bounds are refused by name. Hidden fields are dropped first; masked ones may only pass.
"""

from __future__ import annotations

from itertools import count as counting
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.operators.prefix import running, smoothed
from korrel.operators.expressions import Scope, compile_expression, compile_filter, literal
from korrel.plans.errors import CommandInvalid, HiddenFieldUsed, MaskedFieldUsed, OperatorDenied, TableNotFound, TableRefused
from korrel.plans.policy import Access, Mask
from korrel.session import checkpointed

MAX_BYTES, MAX_DEPTH, VIEW_LEVELS = 100_000, 64, 8
DENIED_STAGES = {"$out", "$merge"}


def _depth(x) -> int:
    if isinstance(x, dict):
        return 1 + max(map(_depth, x.values()), default=0)
    return 1 + max(map(_depth, x), default=0) if isinstance(x, list) else 0


def parse(command: str | dict) -> dict:
    if isinstance(command, str):
        if len(command.encode()) > MAX_BYTES:
            raise CommandInvalid("too long")
        try:
            command = json.loads(command)
        except ValueError as error:
            raise CommandInvalid(str(error)) from None
    if not isinstance(command, dict) or not command or _depth(command) > MAX_DEPTH:
        raise CommandInvalid("not one JSON object of bounded depth")
    return command


class Documents:
    """Collections by name under access rules; views are a collection and a pipeline."""

    def __init__(self, collections: dict[str, DataFrame], access: Access | None = None, views: dict[str, tuple[str, list]] | None = None):
        self.collections, self.access, self.views = collections, access or Access(), views or {}

    # sources

    def _rules(self, name: str, df: DataFrame) -> tuple[set[str], dict[str, Mask]]:
        told = {c: self.access.treatment(name, c) for c in df.columns}
        return {c for c, t in told.items() if t == "hidden"}, {c: t for c, t in told.items() if isinstance(t, Mask)}

    def _open(self, name) -> str:
        if not isinstance(name, str) or name.startswith("system.") or self.access.table(name) != "open":
            raise TableRefused(str(name))
        if name not in self.collections and name not in self.views:
            raise TableNotFound(name)
        return name

    def _base(self, name: str, level: int = 0) -> tuple[str, DataFrame, list]:
        """The collection under a name, and the stages of the views above it."""
        self._open(name)
        if name in self.collections:
            return name, self.collections[name], []
        if level == VIEW_LEVELS:
            raise CommandInvalid("views over views over views")
        on, stages = self.views[name]
        base, df, first = self._base(on, level + 1)
        return base, df, [*first, *stages]

    def foreign(self, name) -> DataFrame:
        """A collection that another command reaches: it may have no guarded data."""
        base, df, stages = self._base(self._open(name))
        if self.access.guards(base) and any(self._rules(base, df)):
            raise OperatorDenied(f"{name} has guarded fields")
        return self.stages(df, stages, State())

    # commands

    def run(self, command: str | dict) -> DataFrame:
        c = parse(command)
        if "find" in c:
            stages = [{"$match": c.get("filter", {})}]
            stages += [{f"${k}": c[k]} for k in ("sort", "skip") if c.get(k)]
            stages += [{"$limit": c["limit"]}] if c.get("limit") else []
            stages += [{"$project": c["projection"]}] if c.get("projection") else []
            return self._answer(c["find"], stages)
        if "aggregate" in c:
            return self._answer(c["aggregate"], c.get("pipeline", []))
        if "distinct" in c:
            key = c["key"]
            stages = [{"$match": c.get("query", c.get("filter", {}))}, {"$unwind": f"${key}"}, {"$group": {"_id": f"${key}"}}, {"$sort": {"_id": 1}}, {"$project": {"_id": 0, "value": "$_id"}}]
            return self._answer(c["distinct"], stages)
        if "countDocuments" in c:
            return self._answer(c["countDocuments"], [{"$match": c.get("filter", {})}, {"$count": "n"}])
        raise CommandInvalid(f"{next(iter(c))} isn't find, aggregate, distinct or countDocuments")

    def _answer(self, name: str, stages: list) -> DataFrame:
        base, df, first = self._base(name)
        hidden, masks = self._rules(base, df)
        state = State(hidden, masks)
        out = self.stages(df.drop(*hidden), [*first, *stages], state)
        return out.select(*(m.column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if (m := state.masks.get(f.name)) else F.col(f"`{f.name}`") for f in out.schema.fields))

    def stages(self, df: DataFrame, stages: list, state: State) -> DataFrame:
        if not isinstance(stages, list):
            raise CommandInvalid("a pipeline is a list")
        for stage in stages:
            if not isinstance(stage, dict) or len(stage) != 1:
                raise CommandInvalid("a stage is one operator")
            name, spec = next(iter(stage.items()))
            if name in DENIED_STAGES or name not in STAGES:
                raise OperatorDenied(name)
            df = STAGES[name](self, df, spec, state)
        return df

    def infer(self, name: str, sample: int = 100) -> list[tuple[str, str, bool]]:
        """(field, kinds seen, never null) over the first documents."""
        _, df, stages = self._base(name)
        rows = self.stages(df, stages, State()).limit(sample)
        seen = rows.select(*(F.count(F.col(f"`{c}`")).alias(c) for c in rows.columns), F.count("*").alias("__n")).first()
        return [(f.name, f.dataType.simpleString() + ("" if seen[f.name] == seen["__n"] else "|null"), seen[f.name] == seen["__n"]) for f in rows.schema.fields]


class State:
    """Rules that hold so far: hidden names, and masks of fields that have only passed."""

    def __init__(self, hidden: set[str] = frozenset(), masks: dict[str, Mask] | None = None):
        self.hidden, self.masks = set(hidden), dict(masks or {})

    def scope(self, df: DataFrame) -> Scope:
        return Scope(df.columns, self.hidden, set(self.masks))

    def name(self, path: str) -> str:
        """A field that is named, not computed with: hidden ones don't exist."""
        if path.split(".")[0].lower() in {x.lower() for x in self.hidden}:
            raise HiddenFieldUsed(path)
        return path

    def fresh(self) -> None:
        """The documents are new ones; no masked field is left."""
        self.masks = {}


def _match(self, df, spec, state):
    return df.filter(compile_filter(spec, state.scope(df)))


def _set_path(df: DataFrame, path: str, value: Column) -> Column:
    """The root column with the value at a dotted path."""
    root, *rest = path.split(".")
    if not rest:
        return value
    base = F.col(f"`{root}`") if root in df.columns else F.struct()
    return base.withField(".".join(f"`{x}`" for x in rest), value)


def _add_fields(self, df, spec, state):
    scope, new = state.scope(df), {}
    for path, e in spec.items():
        state.name(path)
        if path.split(".")[0] in state.masks:
            raise MaskedFieldUsed(path)
        new[path.split(".")[0]] = _set_path(df, path, compile_expression(e, scope))
    return df.withColumns(new)


def _unset(self, df, spec, state):
    for path in spec if isinstance(spec, list) else [spec]:
        root, *rest = state.name(path).split(".")
        df = df.withColumn(root, F.col(f"`{root}`").dropFields(".".join(f"`{x}`" for x in rest))) if rest and root in df.columns else df.drop(root)
        state.masks = {k: v for k, v in state.masks.items() if k != root or rest}
    return df


def _project(self, df, spec, state):
    if not spec:
        raise CommandInvalid("$project of nothing")
    plain = {k: v for k, v in spec.items() if k != "_id"}
    drops = [k for k, v in plain.items() if v in (0, False) and not isinstance(v, (str, dict, list))]
    if drops and len(drops) != len(plain):
        raise CommandInvalid("$project either takes or leaves fields")
    if drops or not plain and spec.get("_id") in (0, False):
        return _unset(self, df, [*drops, *(["_id"] if spec.get("_id", 1) in (0, False) else [])], state)
    scope, out, kept = state.scope(df), [], {}
    if "_id" in df.columns and spec.get("_id", 1) in (1, True) and not isinstance(spec.get("_id", 1), (str, dict)):
        out.append(F.col("_id"))
    nested: dict[str, list[Column]] = {}
    for path, e in spec.items():
        state.name(path)
        if isinstance(e, (int, float, bool)):
            if path == "_id":
                continue
            root, *rest = path.split(".")
            if rest:
                nested.setdefault(root, []).append(scope.field(path).alias(rest[-1]))
            elif root in df.columns:
                out.append(F.col(f"`{root}`"))
                if root in state.masks:
                    kept[root] = state.masks[root]
        else:
            if path in state.masks:
                raise MaskedFieldUsed(path)
            out.append(compile_expression(e, scope).alias(path))
    out += [F.struct(*cs).alias(root) for root, cs in nested.items()]
    state.masks = kept
    return df.select(*out)


def _order(spec: dict, state: State, scope: Scope) -> list[Column]:
    if not isinstance(spec, dict) or not spec:
        raise CommandInvalid("a sort names fields")
    out = []
    for path, way in spec.items():
        if way not in (1, -1):
            raise CommandInvalid(f"sort {path}: {way}")
        c = scope.field(path)
        out.append(c.asc_nulls_first() if way == 1 else c.desc_nulls_last())
    return out


def _sort(self, df, spec, state):
    return df.orderBy(*_order(spec, state, state.scope(df)))


def _limit(self, df, spec, state):
    if not isinstance(spec, int) or spec < 1:
        raise CommandInvalid("$limit is 1 at least")
    return df.limit(spec)


def _count(self, df, spec, state):
    state.fresh()
    return df.agg(F.count("*").alias(spec)).filter(F.col(spec) > 0)


def _sample(self, df, spec, state):
    return df.withColumn("__r", F.rand(spec.get("seed", 7))).orderBy("__r").limit(spec["size"]).drop("__r")


def _unwind(self, df, spec, state):
    spec = {"path": spec} if isinstance(spec, str) else spec
    path = spec["path"][1:]
    state.scope(df).check(path)
    root, *rest = path.split(".")
    value = state.scope(df).field(path)
    kind = df.select(value.alias("v")).schema[0].dataType.typeName()
    items = value if kind == "array" else F.when(value.isNotNull(), F.array(value))
    keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    if index:
        found = df.select("*", (F.posexplode_outer if keep else F.posexplode)(items).alias("__k", "__v"))
        found = found.withColumn(index, (F.col("__k").cast("long") if kind == "array" else F.lit(None).cast("long")))
    else:
        found = df.select("*", (F.explode_outer if keep else F.explode)(items).alias("__v"))
    return found.withColumn(root, _set_path(df, path, F.col("__v")) if rest else F.col("__v")).drop("__k", "__v")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _ordered(c: Column, keys: list[tuple[Column, int]], n: Column | int, last: bool = False) -> Column:
    """The first or last values by some order: a collected list of (keys, value), sorted by the keys' ways."""
    item = F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(keys)), c.alias("v"))

    def compare(x, y):
        result = F.lit(0)
        for i in reversed(range(len(keys))):
            a, b = x[f"k{i}"], y[f"k{i}"]
            own = F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1) * keys[i][1]
            result = F.when(own != 0, own).otherwise(result)
        return result

    rows = F.transform(F.array_sort(F.collect_list(item), compare), lambda x: x["v"])
    rows = F.reverse(rows) if last else rows
    return F.slice(rows, F.lit(1), F.lit(n).cast("int"))


def _end(c: Column, keys: list[tuple[Column, int]], last: bool = False) -> Column:
    """The first or last value by some order; where all keys go one way, without collecting the group."""
    ways = {way for _, way in keys}
    if len(ways) > 1:
        return F.element_at(_ordered(c, keys, 1, last), 1)
    pick = F.max_by if (ways == {1}) == last else F.min_by
    return pick(F.struct(c.alias("v")), F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(keys))))["v"]


def _merged(c: Column, order: list[tuple[Column, int]], kind: T.DataType) -> Column:
    """Objects merged field by field: of each the last value that is there, by the documents' order."""
    if not isinstance(kind, T.StructType):
        raise CommandInvalid("$mergeObjects merges objects")

    def last(name: str) -> Column:
        field = c.getField(name)
        if not order:
            return F.last(field, ignorenulls=True)
        there = [(F.when(field.isNotNull(), 1), 1)] if {w for _, w in order} == {1} else [(F.when(field.isNull(), 1), -1)]
        return _end(field, [*there, *order], True)

    return F.when(F.count(c) > 0, F.struct(*(last(f.name).alias(f.name) for f in kind.fields)))


def accumulator(op: str, a, scope: Scope, order: list[tuple[Column, int]], df: DataFrame | None = None) -> Column:
    """An accumulator over a group. ``order`` is that of the documents before it, which are ``df``."""
    go = lambda e: compile_expression(e, scope)
    sort_of = lambda spec: [(scope.field(k), w) for k, w in spec.items()]
    if op == "$sum":
        return F.coalesce(F.sum(go(a) if isinstance(a, int) else _number(go(a))), F.lit(0))
    if op == "$count":
        return F.count("*")
    if op in ("$avg", "$stdDevPop", "$stdDevSamp"):
        return {"$avg": F.avg, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}[op](_number(go(a)))
    if op in ("$min", "$max"):
        return (F.min if op == "$min" else F.max)(go(a))
    if op in ("$first", "$last"):
        if not order:
            return (F.first if op == "$first" else F.last)(go(a))
        return _end(go(a), order, op == "$last")
    if op in ("$firstN", "$lastN"):
        return _ordered(go(a["input"]), order or [(F.lit(0), 1)], a["n"], op == "$lastN")
    if op in ("$maxN", "$minN"):
        value = go(a["input"])
        rows = F.sort_array(F.collect_list(value), op == "$minN")
        return F.slice(rows, 1, a["n"])
    if op in ("$top", "$bottom"):
        return _end(go(a["output"]), sort_of(a["sortBy"]), op == "$bottom")
    if op in ("$topN", "$bottomN"):
        return _ordered(go(a["output"]), sort_of(a["sortBy"]), a["n"], op == "$bottomN")
    if op == "$push":
        return F.transform(F.collect_list(F.struct(go(a).alias("v"))), lambda x: x["v"])  # nulls stay
    if op == "$addToSet":
        return F.collect_set(go(a))
    if op == "$mergeObjects":
        if df is None:
            raise OperatorDenied("$mergeObjects outside of groups")
        return _merged(go(a), order, df.select(go(a)).schema[0].dataType)
    if op == "$median":
        return F.percentile_approx(_number(go(a["input"])), 0.5, 10000)
    if op == "$percentile":
        return F.percentile_approx(_number(go(a["input"])), [float(p) for p in a["p"]], 10000)
    if op in ("$covariancePop", "$covarianceSamp"):
        x, y = a
        return (F.covar_pop if op.endswith("Pop") else F.covar_samp)(_number(go(x)), _number(go(y)))
    raise OperatorDenied(op)


def _outputs(spec: dict, scope: Scope, order=(), df: DataFrame | None = None) -> list[Column]:
    out = []
    for name, e in spec.items():
        if not isinstance(e, dict) or len(e) != 1:
            raise CommandInvalid(f"{name} is one accumulator")
        op, a = next(iter(e.items()))
        out.append(accumulator(op, a, scope, list(order), df).alias(name))
    return out


def _group(self, df, spec, state, order=()):
    scope = state.scope(df)
    if "_id" not in spec:
        raise CommandInvalid("$group has an _id")
    key = compile_expression(spec["_id"], scope).alias("_id")
    outputs = _outputs({k: v for k, v in spec.items() if k != "_id"}, scope, order, df)
    state.fresh()
    if spec["_id"] is None:
        return df.agg(F.count("*").alias("__n"), *outputs).filter("__n > 0").select(F.lit(None).cast("string").alias("_id"), *(F.col(f"`{k}`") for k in spec if k != "_id"))
    return df.groupBy(key).agg(*outputs) if outputs else df.select(key).distinct()


def _sort_by_count(self, df, spec, state):
    return _group(self, df, {"_id": spec, "count": {"$sum": 1}}, state).orderBy(F.desc("count"), "_id")


def _replace_root(self, df, spec, state):
    e = spec["newRoot"] if isinstance(spec, dict) and "newRoot" in spec else spec
    found = df.select(compile_expression(e, state.scope(df)).alias("__doc"))
    if found.schema[0].dataType.typeName() != "struct":
        raise CommandInvalid("a document takes the root's place")
    state.fresh()
    return found.filter("__doc is not null").select("__doc.*")


def _bucket(self, df, spec, state):
    scope, edges = state.scope(df), spec["boundaries"]
    if sorted(edges) != edges or len(edges) < 2:
        raise CommandInvalid("boundaries ascend")
    value = compile_expression(spec["groupBy"], scope)
    key = None
    for low, high in zip(edges, edges[1:]):
        test = (value >= literal(low)) & (value < literal(high))
        key = F.when(test, literal(low)) if key is None else key.when(test, literal(low))
    rest = spec.get("default")
    key = key.otherwise(literal(rest)) if "default" in spec else key.otherwise(F.raise_error(F.lit("a value is in no bucket")).cast("double"))
    out = _outputs(spec.get("output", {"count": {"$sum": 1}}), scope)
    state.fresh()
    return df.groupBy(key.alias("_id")).agg(*out).orderBy("_id")


#: The preferred numbers of one decade.
_SERIES = {
    "R5": [1.0, 1.6, 2.5, 4.0, 6.3],
    "R10": [1.0, 1.25, 1.6, 2.0, 2.5, 3.15, 4.0, 5.0, 6.3, 8.0],
    "R20": [1.0, 1.12, 1.25, 1.4, 1.6, 1.8, 2.0, 2.24, 2.5, 2.8, 3.15, 3.55, 4.0, 4.5, 5.0, 5.6, 6.3, 7.1, 8.0, 9.0],
    "1-2-5": [1.0, 2.0, 5.0],
    "E6": [1.0, 1.5, 2.2, 3.3, 4.7, 6.8],
    "E12": [1.0, 1.2, 1.5, 1.8, 2.2, 2.7, 3.3, 3.9, 4.7, 5.6, 6.8, 8.2],
}


def preferred(x: float, granularity: str, up: bool) -> float:
    """The next number of a series above or below ``x``; 0 stays, and below nothing is 0."""
    if x == 0:
        return 0.0
    if granularity == "POWERSOF2":
        k = math.floor(math.log2(x))
        near = [2.0**j for j in range(k - 1, k + 3)]
    else:
        k = math.floor(math.log10(x))
        near = [float(f"{m}e{j}") for j in range(k - 1, k + 2) for m in _SERIES[granularity]]
    return min(v for v in near if v > x) if up else max(v for v in near if v < x)


def _preferred_bounds(counts: DataFrame, n: int, granularity: str) -> list[float]:
    """Where the buckets begin and the last one ends. A bucket takes its share of the rows and what is left below the
    next preferred number; of each bucket two sums over the counted values come to the driver."""
    ends = counts.agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.max("__total").alias("total"), F.count_if(F.col("__v").isNull() | (F.col("__v") < 0)).alias("wrong")).first()
    if ends["total"] is None:
        return []
    if ends["wrong"]:
        raise CommandInvalid("granularity takes numbers from 0 on")
    bounds, taken, share = [preferred(ends["low"], granularity, False)], 0, max(1, round(ends["total"] / n))
    while taken < ends["total"] and len(bounds) <= n:
        if len(bounds) == n or taken + share >= ends["total"]:
            bounds.append(preferred(ends["high"], granularity, True))
            break
        last = counts.filter((F.col("__before") < taken + share) & (F.col("__before") + F.col("__n") >= taken + share)).first()["__v"]
        bounds.append(preferred(last, granularity, True))
        taken = counts.filter(F.col("__v") < bounds[-1]).agg(F.sum("__n")).first()[0]
    return bounds


def _bucket_auto(self, df, spec, state):
    """About equal numbers; equal values share a bucket. With a granularity buckets begin and end at preferred numbers."""
    granularity = spec.get("granularity")
    if granularity is not None and granularity not in {*_SERIES, "POWERSOF2"}:
        raise OperatorDenied(f"granularity {granularity}")
    scope, n = state.scope(df), spec["buckets"]
    value = compile_expression(spec["groupBy"], scope)
    value = _number(value) if granularity else value
    counts = df.groupBy(value.alias("__v")).agg(F.count("*").alias("__n"))
    placed = running(counts, [], ["__v"], F.col("__n"), "__before", "__total")
    if granularity:
        placed = checkpointed(placed)
        bounds = _preferred_bounds(placed, n, granularity)
        at = F.lit(-1)
        for low in bounds[:-1]:
            at = at + (F.col("__v") >= low).cast("int")
        rows = df.withColumn("__v", value).withColumn("__b", F.greatest(at, F.lit(0)))
    else:
        placed = placed.withColumn("__b", F.floor(F.col("__before") * n / F.col("__total")))
        rows = df.withColumn("__v", value).join(placed.select(F.col("__v").alias("__w"), "__b"), F.col("__v").eqNullSafe(F.col("__w"))).drop("__w")
    own = _outputs(spec.get("output", {"count": {"$sum": 1}}), Scope(rows.columns, state.hidden, set(state.masks)))
    state.fresh()
    found = rows.groupBy("__b").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), *own)
    if granularity:
        edge = lambda k: F.element_at(F.array(*map(F.lit, bounds or [0.0])), (F.col("__b") + k).cast("int"))
        return found.withColumn("_id", F.struct(edge(1).alias("min"), edge(2).alias("max"))).orderBy("__b").drop("__b", "__lo", "__hi")
    upper = F.coalesce(F.lead("__lo").over(Window.orderBy("__b")), F.col("__hi"))  # as many rows as buckets
    return found.withColumn("_id", F.struct(F.col("__lo").alias("min"), upper.alias("max"))).orderBy("__b").drop("__b", "__lo", "__hi")


def _facet(self, df, spec, state):
    if state.masks:
        raise MaskedFieldUsed("$facet")
    parts = []
    for name, stages in spec.items():
        if any("$facet" in s for s in stages):
            raise OperatorDenied("$facet in $facet")
        rows = self.stages(df, stages, State(state.hidden))
        parts.append(rows.agg(F.collect_list(F.struct("*")).alias(name)))
    state.fresh()
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def _lookup(self, df, spec, state):
    other, name = self.foreign(spec["from"]), spec["as"]
    state.name(name)
    if "pipeline" in spec and "localField" not in spec:
        bound = {k: compile_expression(e, state.scope(df)) for k, e in spec.get("let", {}).items()}
        if not bound:
            rows = self.stages(other, spec["pipeline"], State()).agg(F.collect_list(F.struct("*")).alias(name))
            return df.crossJoin(F.broadcast(rows))
        # variables are joined on: the pipeline's $expr equalities tell on what
        first, *rest = spec["pipeline"]
        pairs = _equalities(first.get("$match", {}).get("$expr", {}), set(bound))
        if not pairs:
            raise OperatorDenied("a $lookup pipeline compares its variables for equality first")
        rows = self.stages(other, rest, State())
        keyed = other if not rest else rows
        grouped = keyed.groupBy(*(F.col(f"`{field}`").alias(f"__k{i}") for i, (_, field) in enumerate(pairs))).agg(F.collect_list(F.struct(*keyed.columns)).alias(name))
        condition = reduce(lambda a, b: a & b, (bound[v].eqNullSafe(F.col(f"__k{i}")) for i, (v, _) in enumerate(pairs)))
        return df.join(grouped, condition, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType))).drop(*(f"__k{i}" for i in range(len(pairs))))
    local, foreign = spec["localField"], spec["foreignField"]
    state.scope(df).check(local)
    rows = self.stages(other, spec.get("pipeline", []), State())
    grouped = rows.groupBy(F.col(foreign).alias("__k")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
    value = state.scope(df).field(local)
    if df.select(value.alias("v")).schema[0].dataType.typeName() == "array":
        lists = df.select(value.alias("__a")).distinct()  # equal lists find the same
        matched = lists.select("__a", F.explode(F.array_distinct("__a")).alias("__k")).join(grouped, "__k").groupBy("__a").agg(F.flatten(F.collect_list(name)).alias(name))
        out = df.join(matched, value == F.col("__a"), "left").drop("__a")
    else:
        out = df.join(grouped, value.eqNullSafe(F.col("__k")), "left").drop("__k")
    return out.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def _equalities(e, names: set[str]) -> list[tuple[str, str]]:
    parts = e["$and"] if "$and" in e else [e]
    found = []
    for part in parts:
        if not isinstance(part, dict) or set(part) != {"$eq"}:
            return []
        a, b = part["$eq"]
        a, b = (b, a) if isinstance(b, str) and b.startswith("$$") else (a, b)
        if not (isinstance(a, str) and a[2:] in names and isinstance(b, str) and b.startswith("$")):
            return []
        found.append((a[2:], b[1:]))
    return found


def _union_with(self, df, spec, state):
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = self.stages(self.foreign(spec["coll"]), spec.get("pipeline", []), State())
    return df.unionByName(other, allowMissingColumns=True)


def _graph_lookup(self, df, spec, state):
    """Breadth first along equal fields, each foreign document once for each start, at its least depth."""
    other, name = self.foreign(spec["from"]), spec["as"]
    if "restrictSearchWithMatch" in spec:
        other = other.filter(compile_filter(spec["restrictSearchWithMatch"], Scope(other.columns)))
    depth = spec.get("maxDepth")
    start = compile_expression(spec["startWith"], state.scope(df))
    nodes = other.select(F.col(spec["connectToField"]).alias("__to"), F.col(spec["connectFromField"]).alias("__from"), F.struct(*other.columns).alias("__doc"))
    keyed = df.withColumn("__start", start)
    frontier = keyed.select("__start").distinct().withColumn("__at", F.col("__start"))
    seen = None
    for level in counting() if depth is None else range(depth + 1):
        found = frontier.join(nodes, F.col("__at") == F.col("__to")).select("__start", "__to", "__from", "__doc", F.lit(level).cast("long").alias("__depth"))
        if seen is not None:
            found = found.join(seen.select("__start", "__to").distinct(), ["__start", "__to"], "left_anti")
        found = checkpointed(found) if level else found
        if level and found.isEmpty():
            break
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select("__start", F.col("__from").alias("__at")).filter("__at is not null").distinct()
    doc = F.col("__doc").withField(spec["depthField"], F.col("__depth")) if "depthField" in spec else F.col("__doc")
    grouped = seen.withColumn("__doc", doc).groupBy("__start").agg(F.collect_list("__doc").alias(name))
    return keyed.join(grouped, "__start", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType))).drop("__start")


_BOUND = {"unbounded": None, "current": 0}


def _frame(window: dict | None, base, keyed: bool):
    if not window:
        return base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = "documents" if "documents" in window else "range"
    low, high = window[kind]
    low = Window.unboundedPreceding if low == "unbounded" else 0 if low == "current" else low
    high = Window.unboundedFollowing if high == "unbounded" else 0 if high == "current" else high
    if kind == "documents":
        return base.rowsBetween(low, high)
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}.get(window.get("unit"), 1)
    scale = lambda x: x if x in (Window.unboundedPreceding, Window.unboundedFollowing) else x * unit
    return base.rangeBetween(scale(low), scale(high))


def _window_fields(self, df, spec, state):
    scope = state.scope(df)
    keys = [compile_expression(spec["partitionBy"], scope)] if spec.get("partitionBy") is not None else []
    order = _order(spec["sortBy"], state, scope) if spec.get("sortBy") else []
    base = Window.partitionBy(*keys).orderBy(*order) if order else Window.partitionBy(*keys)
    sort_field = scope.field(next(iter(spec["sortBy"]))) if order else None
    new, averages = {}, []
    for k, (name, e) in enumerate(spec["output"].items()):
        state.name(name)
        op, a = next((k, v) for k, v in e.items() if k != "window")
        window = e.get("window")
        if op == "$expMovingAvg":
            averages.append((name, _number(compile_expression(a["input"], scope)), a["alpha"] if "alpha" in a else 2.0 / (a["N"] + 1)))
            continue
        if window and "range" in window and window.get("unit"):
            base_range = Window.partitionBy(*keys).orderBy(F.unix_timestamp(sort_field.cast("timestamp")))
            frame = _frame(window, base_range, True)
        else:
            frame = _frame(window, base, bool(order))
        if op == "$integral":
            df = df.withColumn(f"__area{k}", _area(a, scope, base, sort_field))
            new[name] = _integral(F.col(f"__area{k}"), frame)
            continue
        new[name] = _window_operator(op, a, scope, base, frame, sort_field)
    shown = [c for c in df.columns if not c.startswith("__area")]
    made = df.withColumns(new).select(*(F.col(f"`{c}`") for c in dict.fromkeys([*shown, *new])))
    for name, x, alpha in averages:
        keyed = made.withColumns({f"__by{k}": c for k, c in enumerate(keys)})
        made = smoothed(keyed, [f"__by{k}" for k in range(len(keys))], order, x, alpha, name).drop(*(f"__by{k}" for k in range(len(keys))))
    return made


def _unit(a, sort_field) -> Column:
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}.get(a.get("unit"), 1)
    return F.unix_micros(sort_field.cast("timestamp")) / 1e6 / seconds if a.get("unit") else sort_field.cast("double")


def _area(a, scope, base, sort_field) -> Column:
    """The area between a row and the one before it; none before the first."""
    x, t = _number(compile_expression(a["input"], scope)), _unit(a, sort_field)
    area = (t - F.lag(t).over(base)) * (F.lag(x).over(base) + x) / 2
    return F.when(F.lag(F.lit(1)).over(base).isNull(), 0.0).otherwise(area)


def _integral(area: Column, frame) -> Column:
    """Areas add up, but for the first row's, which lies before the frame; one that isn't known makes the sum unknown."""
    first = F.first(area).over(frame)
    unknown = F.count_if(area.isNull()).over(frame) - first.isNull().cast("int")
    return F.when(F.count(F.lit(1)).over(frame) <= 1, 0.0).when(unknown == 0, F.sum(area).over(frame) - F.coalesce(first, F.lit(0.0)))


def _window_operator(op, a, scope, base, frame, sort_field) -> Column:
    go = lambda e: compile_expression(e, scope)
    if op == "$rank":
        return F.rank().over(base)
    if op == "$denseRank":
        return F.dense_rank().over(base)
    if op == "$documentNumber":
        return F.row_number().over(base)
    if op == "$shift":
        by, value = a["by"], go(a["output"])
        default = a.get("default")
        found = (F.lead(value, by) if by >= 0 else F.lag(value, -by)).over(base)
        if default is None:
            return found
        there = (F.lead(F.lit(1), by) if by >= 0 else F.lag(F.lit(1), -by)).over(base)
        return F.when(there.isNull(), literal(default)).otherwise(found)
    if op == "$derivative":
        x, t = _number(go(a["input"])), _unit(a, sort_field)
        return F.try_divide(F.last(x).over(frame) - F.first(x).over(frame), F.last(t).over(frame) - F.first(t).over(frame))
    if op == "$locf":
        return F.last(go(a), ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    if op == "$linearFill":
        x, t = _number(go(a)), sort_field.cast("double")
        before, after = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
        known = F.when(x.isNotNull(), t)
        x0, t0 = F.last(x, ignorenulls=True).over(before), F.last(known, ignorenulls=True).over(before)
        x1, t1 = F.first(x, ignorenulls=True).over(after), F.first(known, ignorenulls=True).over(after)
        return F.when(x.isNotNull(), x).otherwise(x0 + (x1 - x0) * F.try_divide(t - t0, t1 - t0))
    if op in ("$first", "$last"):
        return (F.first if op == "$first" else F.last)(go(a)).over(frame)
    if op == "$sum":
        return F.coalesce(F.sum(go(a) if isinstance(a, int) else _number(go(a))).over(frame), F.lit(0))
    if op == "$push":
        return F.transform(F.collect_list(F.struct(go(a).alias("v"))).over(frame), lambda x: x["v"])
    if op in ("$maxN", "$minN"):
        return F.slice(F.sort_array(F.collect_list(go(a["input"])).over(frame), op == "$minN"), 1, a["n"])
    return accumulator(op, a, scope, []).over(frame)


STAGES = {
    "$match": _match, "$project": _project, "$addFields": _add_fields, "$set": _add_fields, "$unset": _unset, "$sort": _sort, "$limit": _limit, "$skip": lambda self, df, spec, state: df.offset(spec),
    "$count": _count, "$sample": _sample, "$group": _group, "$unwind": _unwind, "$sortByCount": _sort_by_count, "$replaceRoot": _replace_root, "$replaceWith": _replace_root, "$bucket": _bucket,
    "$bucketAuto": _bucket_auto, "$facet": _facet, "$lookup": _lookup, "$unionWith": _union_with, "$graphLookup": _graph_lookup, "$setWindowFields": _window_fields,
}


# updates

def _pull(c, v):
    if isinstance(v, dict) and any(k.startswith("$") for k in v):
        from korrel.operators.expressions import compile_field

        return F.filter(c, lambda x: ~compile_field(x, v, Scope([])))
    return F.filter(c, lambda x: ~x.eqNullSafe(literal(v)))


def _push(c, v, unique=False):
    spec = v if isinstance(v, dict) and "$each" in v else {"$each": [v]}
    new = F.array(*map(literal, spec["$each"]))
    if unique:
        return F.concat(c, F.array_except(new, c))
    if "$position" in spec:
        k = spec["$position"]
        found = F.concat(F.slice(c, 1, k) if k else F.slice(c, 1, 0), new, F.slice(c, F.lit(k + 1), F.size(c)))
    else:
        found = F.concat(c, new)
    if "$sort" in spec:
        found = F.sort_array(found, spec["$sort"] > 0)
    if "$slice" in spec:
        n = spec["$slice"]
        found = F.slice(found, 1, n) if n >= 0 else F.slice(found, F.greatest(F.lit(1), F.size(found) + n + 1), F.lit(-n))
    return found


UPDATES = {
    "$set": lambda c, v: literal(v), "$inc": lambda c, v: F.coalesce(c, F.lit(0)) + literal(v), "$mul": lambda c, v: F.coalesce(c, F.lit(0)) * literal(v), "$min": lambda c, v: F.least(c, literal(v)), "$max": lambda c, v: F.greatest(c, literal(v)),
    "$currentDate": lambda c, v: F.current_timestamp().cast("timestamp_ntz"), "$push": _push, "$addToSet": lambda c, v: _push(c, v, True), "$pull": _pull, "$pullAll": lambda c, v: F.array_except(c, literal(v)),
    "$pop": lambda c, v: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))) if v < 0 else F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
    "$bit": lambda c, v: reduce(lambda x, kv: {"and": x.bitwiseAND, "or": x.bitwiseOR, "xor": x.bitwiseXOR}[kv[0]](kv[1]), v.items(), c),
}


def update(df: DataFrame, where: dict, change: dict) -> DataFrame:
    """The documents with those that match changed; $setOnInsert does nothing, as nothing is inserted."""
    hit = compile_filter(where, Scope(df.columns))
    new, gone, renamed = {}, [], {}
    for op, fields in change.items():
        if op == "$setOnInsert":
            continue
        if op == "$unset":
            gone += list(fields)
        elif op == "$rename":
            renamed |= fields
        elif op in UPDATES:
            for name, v in fields.items():
                old = new.get(name, F.col(f"`{name}`") if name in df.columns else F.lit(None))
                new[name] = UPDATES[op](old, v)
        else:
            raise OperatorDenied(op)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = [F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in new else F.when(~hit, F.col(f"`{c}`")).alias(c) if c in gone or c in renamed else F.col(f"`{c}`") for c in df.columns]
    out += [F.when(hit, v).alias(c) for c, v in new.items() if c not in df.columns]
    out += [F.when(hit, F.col(f"`{c}`")).alias(n) for c, n in renamed.items()]
    return df.select(*out)


def delete(df: DataFrame, where: dict) -> DataFrame:
    return df.filter(~compile_filter(where, Scope(df.columns)))
