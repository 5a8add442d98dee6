"""Document expressions as Columns: a JSON expression in, one Column out.

A null and a missing field are the same here. Arrays and strings count from 0, as the operators say it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.plans.errors import CommandInvalid, HiddenFieldUsed, MaskedFieldUsed, OperatorDenied

DENIED = {"$function", "$accumulator", "$where", "$jsonSchema"}


class Scope:
    """What a name means: the input document's fields, and variables bound by $let, $map, $filter, $reduce."""

    def __init__(self, columns: list[str], hidden: set[str] = frozenset(), masked: set[str] = frozenset(), variables: dict[str, Column] | None = None):
        self.columns, self.hidden, self.masked, self.variables = columns, {x.lower() for x in hidden}, {x.lower() for x in masked}, variables or {}

    def bind(self, **variables: Column) -> Scope:
        return Scope(self.columns, self.hidden, self.masked, self.variables | variables)

    def check(self, path: str) -> None:
        root = path.split(".")[0].lower()
        if root in self.hidden:
            raise HiddenFieldUsed(path)
        if root in self.masked:
            raise MaskedFieldUsed(path)

    def field(self, path: str) -> Column:
        self.check(path)
        root, *rest = path.split(".")
        if root.lower() not in {c.lower() for c in self.columns}:
            return F.lit(None)
        return reduce(lambda c, step: c.getField(step), rest, F.col(f"`{root}`"))

    def variable(self, name: str) -> Column:
        root, *rest = name.split(".")
        if root in ("ROOT", "CURRENT"):
            if not rest:
                raise OperatorDenied(f"$${root}")
            return self.field(".".join(rest))
        if root == "NOW":
            return F.current_timestamp()
        if root == "CLUSTER_TIME":
            return F.current_timestamp()
        if root == "REMOVE":
            return F.lit(None)
        if root not in self.variables:
            raise CommandInvalid(f"$${name}")
        return reduce(lambda c, step: c.getField(step), rest, self.variables[root])


def literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        if "$oid" in value:
            return F.lit(value["$oid"])
        if "$date" in value:
            return F.lit(value["$date"]).cast("timestamp_ntz")
        for name, kind in (("$numberLong", "bigint"), ("$numberInt", "int"), ("$numberDouble", "double"), ("$numberDecimal", "decimal(38,10)")):
            if name in value:
                return F.lit(str(value[name])).cast(kind)
        if "$uuid" in value:
            return F.lit(value["$uuid"])
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    return F.lit(value)


def _sign(c: Column) -> Column:
    return F.signum(c).cast("int")


def _cmp(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)


def _toward_zero(x: Column, places: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), places) if places is not None else F.lit(1.0)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def _at(a: Column, k: Column) -> Column:
    return F.try_element_at(a, F.when(k >= 0, k + 1).otherwise(k).cast("int"))


def _slice(a: Column, *rest: Column) -> Column:
    if len(rest) == 1:
        n = rest[0]
        return F.when(n >= 0, F.slice(a, F.lit(1), n.cast("int"))).otherwise(F.slice(a, F.greatest(F.lit(1), F.size(a) + n.cast("int") + 1), F.abs(n).cast("int")))
    start, n = rest
    return F.slice(a, F.when(start >= 0, start + 1).otherwise(F.greatest(F.lit(1), F.size(a) + start + 1)).cast("int"), n.cast("int"))


def _range(start, stop, step=None):
    step = F.lit(1) if step is None else step
    last = F.when(step > 0, stop - 1).otherwise(stop + 1)
    empty = F.when(step > 0, start > last).otherwise(start < last)
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.sequence(start.cast("int"), last.cast("int"), step.cast("int")))


def _distinct_sorted(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a))


def _replace_one(text: Column, find: Column, new: Column) -> Column:
    at = F.position(find, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.char_length(find), F.char_length(text)))).otherwise(text)


def _zero(position: Column) -> Column:
    return position - 1


def _week(d: Column) -> Column:
    """Weeks from Sunday; days before the year's first Sunday are in week 0."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def _truth(c: Column) -> Column:
    """Null is false, and so is zero; booleans are themselves."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _log(x: Column, base: Column | None = None) -> Column:
    return F.ln(x) if base is None else F.ln(x) / F.ln(base)


def _fold(op) -> Callable[..., Column]:
    return lambda *a: reduce(op, a)


#: Operators of plain arguments.
PLAIN: dict[str, Callable[..., Column]] = {
    "$abs": F.abs, "$add": _fold(lambda a, b: a + b), "$ceil": F.ceil, "$divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "$exp": F.exp, "$floor": F.floor,
    "$ln": F.ln, "$log": _log, "$log10": F.log10, "$mod": lambda a, b: a % b, "$multiply": _fold(lambda a, b: a * b), "$pow": F.pow,
    "$round": lambda a, p=None: F.bround(a, 0 if p is None else p), "$sqrt": F.sqrt, "$subtract": lambda a, b: a - b, "$trunc": _toward_zero,
    "$sin": F.sin, "$cos": F.cos, "$tan": F.tan, "$asin": F.asin, "$acos": F.acos, "$atan": F.atan, "$atan2": F.atan2, "$sinh": F.sinh, "$cosh": F.cosh, "$tanh": F.tanh,
    "$degreesToRadians": F.radians, "$radiansToDegrees": F.degrees,
    "$cmp": _cmp, "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b), "$gt": lambda a, b: _cmp(a, b) > 0, "$gte": lambda a, b: _cmp(a, b) >= 0, "$lt": lambda a, b: _cmp(a, b) < 0, "$lte": lambda a, b: _cmp(a, b) <= 0,
    "$and": lambda *a: reduce(lambda x, y: x & y, map(_truth, a), F.lit(True)), "$or": lambda *a: reduce(lambda x, y: x | y, map(_truth, a), F.lit(False)), "$not": lambda a: ~_truth(a),
    "$ifNull": lambda *a: F.coalesce(*a),
    "$arrayElemAt": _at, "$concatArrays": lambda *a: F.concat(*a), "$in": lambda x, a: F.array_contains(a, x), "$indexOfArray": lambda a, x, *r: F.coalesce(F.array_position(a, x), F.lit(0)).cast("int") - 1,
    "$isArray": lambda a: F.typeof(a).startswith("array"), "$range": _range, "$reverseArray": F.reverse, "$size": F.size, "$slice": _slice,
    "$arrayToObject": lambda a: F.map_from_entries(a), "$objectToArray": lambda o: F.transform(F.map_entries(o), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))),
    "$allElementsTrue": lambda a: F.forall(a, _truth), "$anyElementTrue": lambda a: F.exists(a, _truth), "$setDifference": lambda a, b: F.array_except(a, b), "$setEquals": lambda a, b: _distinct_sorted(a).eqNullSafe(_distinct_sorted(b)),
    "$setIntersection": _fold(F.array_intersect), "$setIsSubset": lambda a, b: F.size(F.array_except(a, b)) == 0, "$setUnion": _fold(F.array_union),
    "$mergeObjects": lambda *a: F.map_concat(*a),
    "$concat": lambda *a: F.concat(*(x.cast("string") for x in a)), "$indexOfCP": lambda t, x, *r: _zero(F.position(x, t)), "$indexOfBytes": lambda t, x, *r: F.when(F.position(x, t) > 0, F.octet_length(F.substring(t, F.lit(1), F.position(x, t) - 1))).otherwise(-1),
    "$split": lambda t, d: F.split(t, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1), "$strLenBytes": F.octet_length, "$strLenCP": F.char_length, "$strcasecmp": lambda a, b: _cmp(F.lower(a), F.lower(b)),
    "$substr": lambda t, a, n: F.substring(t, (a + 1).cast("int"), F.when(n < 0, F.char_length(t)).otherwise(n).cast("int")), "$substrCP": lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int")),
    "$substrBytes": lambda t, a, n: F.decode(F.substring(F.encode(t, "UTF-8"), (a + 1).cast("int"), n.cast("int")), "UTF-8"), "$toLower": F.lower, "$toUpper": F.upper, "$toString": lambda a: a.cast("string"),
    "$dayOfMonth": F.dayofmonth, "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear, "$hour": F.hour, "$minute": F.minute, "$second": lambda d: F.second(d), "$month": F.month, "$year": F.year,
    "$isoDayOfWeek": lambda d: F.weekday(d) + 1, "$isoWeek": F.weekofyear, "$isoWeekYear": lambda d: F.extract(F.lit("YEAROFWEEK"), d).cast("int"), "$week": _week, "$millisecond": lambda d: (F.date_format(d, "SSS")).cast("int"),
    "$toDate": lambda a: a.cast("timestamp_ntz"), "$isNumber": lambda a: F.typeof(a).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), "$toBool": lambda a: F.when(a.isNotNull(), _truth(a)),
    "$toDecimal": lambda a: a.try_cast("decimal(38,10)"), "$toDouble": lambda a: a.try_cast("double"), "$toInt": lambda a: a.try_cast("int"), "$toLong": lambda a: a.try_cast("bigint"), "$toObjectId": lambda a: F.when(a.rlike("^[0-9a-fA-F]{24}$"), F.lower(a)),
    "$type": lambda a: F.when(a.isNull(), "missing").otherwise(_bson_type(a)), "$rand": lambda *a: F.rand(), "$tsSecond": lambda a: F.unix_timestamp(a), "$binarySize": F.octet_length,
}

_TYPES = {"string": "string", "int": "int", "smallint": "int", "tinyint": "int", "bigint": "long", "double": "double", "float": "double", "boolean": "bool", "timestamp_ntz": "date", "timestamp": "date", "date": "date", "binary": "binData"}


def _bson_type(a: Column) -> Column:
    kind = F.typeof(a)
    found = F.when(kind.startswith("array"), "array").when(kind.startswith("struct") | kind.startswith("map"), "object").when(kind.startswith("decimal"), "decimal")
    for spark, bson in _TYPES.items():
        found = found.when(kind == spark, bson)
    return found.otherwise("object")


_UNITS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond"}
_CONVERT = {"double": "double", "string": "string", "bool": "boolean", "date": "timestamp_ntz", "int": "int", "long": "bigint", "decimal": "decimal(38,10)"}
_DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%%": "'%'"}


def _java_format(text: str) -> str:
    out, k, plain = "", 0, ""
    while k < len(text):
        if text[k : k + 2] in _DATE_LETTERS:
            out += (f"'{plain}'" if plain else "") + _DATE_LETTERS[text[k : k + 2]]
            plain, k = "", k + 2
        elif text[k] == "%":
            raise CommandInvalid(f"date format {text[k : k + 2]}")
        else:
            plain += text[k]
            k += 1
    return out + (f"'{plain}'" if plain else "")


def _shift(date: Column, unit: str, amount: Column) -> Column:
    if unit not in _UNITS:
        raise CommandInvalid(f"unit {unit}")
    return F.timestamp_add(unit.upper(), amount.cast("int"), date)


def _regex(spec: dict) -> str:
    flags = spec.get("options", "")
    return f"(?{flags})" if flags else ""


def compile_expression(e, scope: Scope) -> Column:
    """The Column of a JSON expression."""
    go = lambda x: compile_expression(x, scope)
    if isinstance(e, str):
        if e.startswith("$$"):
            return scope.variable(e[2:])
        return scope.field(e[1:]) if e.startswith("$") else F.lit(e)
    if isinstance(e, list):
        return F.array(*map(go, e))
    if not isinstance(e, dict):
        return F.lit(e)
    names = [k for k in e if k.startswith("$")]
    if not names:
        return F.struct(*(go(v).alias(k) for k, v in e.items()))
    if len(e) != 1:
        raise CommandInvalid(f"one operator at a time: {names}")
    op, a = next(iter(e.items()))
    if op in DENIED:
        raise OperatorDenied(op)
    if op in ("$oid", "$date", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$uuid"):
        return literal(e)
    if op == "$literal":
        return literal(a)
    if op in PLAIN:
        arguments = a if isinstance(a, list) else [a]
        if op in ("$dayOfMonth", "$year", "$month", "$hour", "$minute", "$second", "$week", "$isoWeek", "$dayOfWeek", "$dayOfYear", "$millisecond", "$isoDayOfWeek", "$isoWeekYear") and isinstance(a, dict) and "date" in a:
            arguments = [a["date"]]
        if op == "$round" and len(arguments) == 2:
            return F.bround(go(arguments[0]), int(arguments[1]))
        return PLAIN[op](*map(go, arguments))
    if op in SPECIAL:
        return SPECIAL[op](a, scope, go)
    raise OperatorDenied(op)


def _cond(a, scope, go):
    test, yes, no = a if isinstance(a, list) else (a["if"], a["then"], a["else"])
    return F.when(_truth(go(test)), go(yes)).otherwise(go(no))


def _switch(a, scope, go):
    found = None
    for branch in a["branches"]:
        test, then = _truth(go(branch["case"])), go(branch["then"])
        found = F.when(test, then) if found is None else found.when(test, then)
    return found.otherwise(go(a["default"])) if "default" in a else found


def _let(a, scope, go):
    return compile_expression(a["in"], scope.bind(**{k: go(v) for k, v in a["vars"].items()}))


def _map(a, scope, go):
    return F.transform(go(a["input"]), lambda x: compile_expression(a["in"], scope.bind(**{a.get("as", "this"): x})))


def _filter(a, scope, go):
    found = F.filter(go(a["input"]), lambda x: _truth(compile_expression(a["cond"], scope.bind(**{a.get("as", "this"): x}))))
    return F.slice(found, F.lit(1), go(a["limit"]).cast("int")) if "limit" in a else found


def _reduce(a, scope, go):
    return F.aggregate(go(a["input"]), go(a["initialValue"]), lambda value, this: compile_expression(a["in"], scope.bind(value=value, this=this)))


def _zip(a, scope, go):
    lists = [go(x) for x in a["inputs"]]
    size = (F.greatest if a.get("useLongestLength") else F.least)(*map(F.size, lists)) if len(lists) > 1 else F.size(lists[0])
    return F.transform(_range(F.lit(0), size), lambda k: F.array(*(F.try_element_at(x, k + 1) for x in lists)))


def _sort_array(a, scope, go):
    by = a["sortBy"]
    if isinstance(by, int):
        return F.sort_array(go(a["input"]), by > 0)

    def compare(x, y):
        result = F.lit(0)
        for name, way in reversed(by.items()):
            c = _cmp(x[name], y[name]) * way
            result = F.when(c != 0, c).otherwise(result)
        return result

    return F.array_sort(go(a["input"]), compare)


def _trim(how):
    def special(a, scope, go):
        text = go(a["input"])
        if "chars" not in a:
            return how(text)
        return how(text, go(a["chars"]))

    return special


def _date_parts(a, scope, go):
    d = go(a["date"])
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.hour(d).alias("hour"), F.minute(d).alias("minute"), F.second(d).alias("second"), PLAIN["$millisecond"](d).alias("millisecond"))


def _from_parts(a, scope, go):
    part = lambda name, default: (go(a[name]) if name in a else F.lit(default)).cast("int")
    seconds = part("second", 0) + part("millisecond", 0) / 1000
    return F.make_timestamp_ntz(part("year", 1970), part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), seconds.cast("decimal(8,6)"))


def _date_string(a, scope, go):
    found = F.date_format(go(a["date"]), _java_format(a.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")))
    return F.coalesce(found, go(a["onNull"])) if "onNull" in a else found


def _from_string(a, scope, go):
    text = go(a["dateString"])
    found = F.try_to_timestamp(text, F.lit(_java_format(a["format"]))) if "format" in a else F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))
    return found.cast("timestamp_ntz")


def _trunc_date(a, scope, go):
    size, d, unit = int(a.get("binSize", 1)), go(a["date"]), a["unit"]
    if size == 1:
        base = F.date_trunc(unit, d).cast("timestamp_ntz")
        return F.date_sub(F.next_day(F.date_sub(d, 7), "Sunday"), 0).cast("timestamp_ntz") if unit == "week" else base
    step = {"day": 86400, "hour": 3600, "minute": 60, "second": 1, "week": 604800}[unit] * size
    origin = 946684800  # bins count from the year 2000
    return F.timestamp_seconds(F.floor((F.unix_timestamp(d.cast("timestamp")) - origin) / step) * step + origin).cast("timestamp_ntz")


def _date_diff(a, scope, go):
    """Boundaries crossed, not whole units."""
    unit, start, end = a["unit"], go(a["startDate"]), go(a["endDate"])
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start).cast("timestamp_ntz"), F.date_trunc(unit, end).cast("timestamp_ntz"))


def _convert(a, scope, go):
    kind = a["to"]["type"] if isinstance(a["to"], dict) else a["to"]
    if kind not in _CONVERT:
        raise CommandInvalid(f"$convert to {kind}")
    value = go(a["input"])
    found = value.try_cast(_CONVERT[kind])
    if "onError" in a:
        found = F.when(value.isNotNull() & found.isNull(), go(a["onError"])).otherwise(found)
    return F.coalesce(found, go(a["onNull"])) if "onNull" in a else found


def _match_at(a, go):
    text, pattern = go(a["input"]), F.concat(F.lit(_regex(a)), go(a["regex"]))
    return text, pattern


def _regex_find(a, scope, go):
    text, pattern = _match_at(a, go)
    found = F.struct(F.regexp_substr(text, pattern).alias("match"), (F.regexp_instr(text, pattern) - 1).alias("idx"))
    return F.when(F.regexp_like(text, pattern), found)


def _get_field(a, scope, go):
    return go(a["input"]).getField(a["field"]) if isinstance(a, dict) and "input" in a else scope.field(a if isinstance(a, str) else a["field"])


SPECIAL: dict[str, Callable] = {
    "$cond": _cond, "$switch": _switch, "$let": _let, "$map": _map, "$filter": _filter, "$reduce": _reduce, "$zip": _zip, "$sortArray": _sort_array,
    "$trim": _trim(F.btrim), "$ltrim": _trim(F.ltrim), "$rtrim": _trim(F.rtrim),
    "$regexMatch": lambda a, s, go: F.regexp_like(*_match_at(a, go)), "$regexFind": _regex_find,
    "$regexFindAll": lambda a, s, go: F.transform(F.regexp_extract_all(*_match_at(a, go), F.lit(0)), lambda m: F.struct(m.alias("match"))),
    "$replaceOne": lambda a, s, go: _replace_one(go(a["input"]), go(a["find"]), go(a["replacement"])), "$replaceAll": lambda a, s, go: F.replace(go(a["input"]), go(a["find"]), go(a["replacement"])),
    "$dateAdd": lambda a, s, go: _shift(go(a["startDate"]), a["unit"], go(a["amount"])), "$dateSubtract": lambda a, s, go: _shift(go(a["startDate"]), a["unit"], -go(a["amount"])),
    "$dateDiff": _date_diff, "$dateFromParts": _from_parts, "$dateFromString": _from_string, "$dateToParts": _date_parts, "$dateToString": _date_string, "$dateTrunc": _trunc_date, "$convert": _convert,
    "$getField": _get_field, "$setField": lambda a, s, go: go(a["input"]).withField(a["field"], go(a["value"])), "$unsetField": lambda a, s, go: go(a["input"]).dropFields(a["field"]),
}


# predicates

_COMPARE = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}
_BITS = {"$bitsAllSet": lambda c, m: c.bitwiseAND(m) == m, "$bitsAnySet": lambda c, m: c.bitwiseAND(m) != 0, "$bitsAllClear": lambda c, m: c.bitwiseAND(m) == 0, "$bitsAnyClear": lambda c, m: c.bitwiseAND(m) != m}


def _mask(value) -> Column:
    return F.lit(sum(1 << k for k in value) if isinstance(value, list) else value)


def _value(v) -> Column:
    return literal(v)


def compile_field(c: Column, spec, scope: Scope) -> Column:
    """What a filter says of one field. Absent fields fail comparisons, and pass $ne, $nin and $not."""
    if not isinstance(spec, dict) or not any(k.startswith("$") for k in spec) or set(spec) <= {"$oid", "$date", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$uuid"}:
        return c.isNull() if spec is None else F.coalesce(c == _value(spec), F.lit(False))
    if "$regularExpression" in spec:
        spec = {"$regex": spec["$regularExpression"]["pattern"], "$options": spec["$regularExpression"].get("options", "")}
    found = []
    for op, v in spec.items():
        if op in ("$where", "$function", "$accumulator", "$jsonSchema"):
            raise OperatorDenied(op)
        if op == "$eq":
            test = c.isNull() if v is None else c == _value(v)
        elif op == "$ne":
            test = c.isNotNull() if v is None else ~F.coalesce(c == _value(v), F.lit(False))
        elif op in _COMPARE:
            test = _COMPARE[op](c, _value(v))
        elif op in ("$in", "$nin"):
            known = [x for x in v if x is not None]
            test = F.coalesce(c.isin(*(x if not isinstance(x, dict) else literal(x) for x in known)), F.lit(False)) if known else F.lit(False)
            if None in v:
                test = test | c.isNull()
            test = ~test if op == "$nin" else test
        elif op == "$all":
            test = reduce(lambda a, b: a & b, (F.array_contains(c, _value(x)) for x in v), F.lit(True))
        elif op == "$exists":
            test = c.isNotNull() if v else c.isNull()
        elif op == "$type":
            test = _bson_type(c).isin(*(v if isinstance(v, list) else [v])) & c.isNotNull()
        elif op == "$size":
            test = F.size(c) == v
        elif op == "$mod":
            test = c % v[0] == v[1]
        elif op == "$regex":
            test = F.regexp_like(c, F.lit(_regex({"options": spec.get("$options", "")}) + (v if isinstance(v, str) else v["$regularExpression"]["pattern"])))
        elif op == "$options":
            continue
        elif op in _BITS:
            test = _BITS[op](c, _mask(v))
        elif op == "$not":
            test = ~compile_field(c, v, scope)
        elif op == "$elemMatch":
            test = F.exists(c, _element(v, scope))
        else:
            raise OperatorDenied(op)
        found.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def _element(spec: dict, scope: Scope):
    if any(k.startswith("$") for k in spec):
        return lambda x: compile_field(x, spec, scope)
    return lambda x: reduce(lambda a, b: a & b, (compile_field(x.getField(k), s, scope) for k, s in spec.items()))


def compile_filter(spec: dict, scope: Scope) -> Column:
    if not isinstance(spec, dict):
        raise CommandInvalid("a filter is an object")
    found = []
    for name, v in spec.items():
        if name in ("$and", "$or", "$nor"):
            parts = [compile_filter(x, scope) for x in v]
            if not parts:
                raise CommandInvalid(f"{name} of nothing")
            joined = reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), parts)
            found.append(~joined if name == "$nor" else joined)
        elif name == "$expr":
            found.append(_truth(compile_expression(v, scope)))
        elif name == "$comment":
            continue
        elif name == "$text":
            words = [w for w in v["$search"].lower().split() if w]
            texts = [F.lower(F.col(f"`{c}`").cast("string")) for c in scope.columns if c.lower() not in scope.hidden | scope.masked]
            found.append(F.coalesce(reduce(lambda a, b: a | b, (t.contains(w) for t in texts for w in words)), F.lit(False)))
        elif name.startswith("$"):
            raise OperatorDenied(name)
        else:
            found.append(compile_field(scope.field(name), v, scope))
    return reduce(lambda a, b: a & b, found, F.lit(True))
