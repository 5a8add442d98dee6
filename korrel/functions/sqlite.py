"""SQLite's functions where Spark has none of that name, or one that means something else."""

from __future__ import annotations

import re

from korrel.functions.dialect import Shim, quotient, renamed, template

#: SQLite's LIKE ignores ASCII case.
WORDS = {"like": "ILIKE", "current_time": "date_format(current_timestamp(), 'HH:mm:ss')"}

#: strftime's letters; the ones Spark patterns can't say are handled in ``_strftime``.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}


def _time(a: list[str]) -> str:
    """The moment that a time value and its modifiers say."""
    if not a:
        return "current_timestamp()"
    value = a[0]
    moment = "current_timestamp()" if value.lower() == "'now'" else f"cast({value} AS TIMESTAMP)"
    if any(x.lower() in ("'unixepoch'", "'auto'") for x in a[1:]):
        moment = f"timestamp_seconds({value})"
    for modifier in a[1:]:
        words = modifier.strip("'").lower().split()
        if words == ["start", "of", words[-1]] and words[-1] in ("day", "month", "year"):
            moment = f"date_trunc('{words[-1]}', {moment})"
        elif len(words) == 2 and words[1].rstrip("s") in ("month", "year"):
            # the day of the month stays and runs over into the next: 31 January and a month is 2 or 3 March
            month = f"date_trunc('MONTH', {moment})"
            moment = f"({month} + INTERVAL '{words[0].lstrip('+')}' {words[1].rstrip('s').upper()} + ({moment} - {month}))"
        elif len(words) == 2 and words[1].rstrip("s") in ("day", "hour", "minute", "second"):
            moment = f"({moment} + INTERVAL '{words[0].lstrip('+')}' {words[1].rstrip('s').upper()})"
        elif words not in (["unixepoch"], ["auto"], ["utc"], ["localtime"], ["subsec"]):
            return "cast(NULL AS TIMESTAMP)"
    return moment


def _strftime(a: list[str], s: str) -> str:
    form, moment = a[0].strip("'"), _time(a[1:])
    pieces, text, k = [], "", 0
    special = {"s": f"cast(unix_timestamp({moment}) AS STRING)", "w": f"cast(dayofweek({moment}) - 1 AS STRING)", "u": f"cast(weekday({moment}) + 1 AS STRING)", "J": f"cast({_julian(moment)} AS STRING)",
               "W": f"lpad(cast(floor((dayofyear({moment}) + 6 - weekday({moment})) / 7) AS STRING), 2, '0')", "%": "'%'"}
    while k < len(form):
        if form[k] == "%" and k + 1 < len(form):
            letter = form[k + 1]
            if text:
                pieces.append(f"'{text}'")
                text = ""
            if letter in _LETTERS:
                pieces.append(f"date_format({moment}, '{_LETTERS[letter]}')")
            elif letter in special:
                pieces.append(special[letter])
            else:
                return "cast(NULL AS STRING)"
            k += 2
        else:
            text += form[k]
            k += 1
    if text:
        pieces.append(f"'{text}'")
    return f"concat({', '.join(pieces) or chr(39) * 2}){s}"


def _julian(moment: str) -> str:
    return f"(unix_micros(cast({moment} AS TIMESTAMP)) / 86400000000D + 2440587.5D)"


def _glob(a: list[str], s: str) -> str:
    """glob(pattern, text): * ? and sets, with case."""
    import re

    if not (a[0].startswith("'") and a[0].endswith("'")):
        raise ValueError("glob takes a literal pattern")
    out, k, text = "", 0, a[0][1:-1]
    while k < len(text):
        c = text[k]
        end = text.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            out += text[k : end + 1].replace("\\", "\\\\")
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"({a[1]} RLIKE r'(?s)^{out}$')"


def _extreme(name: str, fold: str) -> Shim:
    def shim(a, s):
        if len(a) == 1:
            return f"{name}({a[0]}){s}"
        return f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {fold}({', '.join(a)}) END"

    return shim


def _log(a, s):
    if len(a) == 1:
        return f"CASE WHEN ({a[0]}) > 0 THEN log10({a[0]}) END"
    return f"CASE WHEN ({a[0]}) > 0 AND ({a[1]}) > 0 THEN log({a[0]}, {a[1]}) END"


def _domain(expression: str, condition: str) -> Shim:
    return lambda a, s: f"CASE WHEN {condition.format(*a)} THEN {expression.format(*a)} END"


def _substr(a, s):
    """Counting from 1, or from the end; 0 stands before the first character."""
    if len(a) == 2:
        return f"CASE WHEN ({a[1]}) < 0 AND abs({a[1]}) > char_length({a[0]}) THEN {a[0]} ELSE substring({a[0]}, {a[1]}) END"
    return f"CASE WHEN ({a[1]}) = 0 THEN substring({a[0]}, 1, greatest(({a[2]}) - 1, 0)) ELSE substring({a[0]}, {a[1]}, {a[2]}) END"


def _json_extract(a, s):
    """One path gives the value, several an array of the values."""
    if len(a) == 2:
        return f"get_json_object({a[0]}, {a[1]})"
    values = ", ".join(f"coalesce(to_json(try_variant_get(try_parse_json({a[0]}), {path}, 'variant')), 'null')" for path in a[1:])
    return f"CASE WHEN ({a[0]}) IS NOT NULL THEN concat('[', concat_ws(',', {values}), ']') END"


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _json_type(a, s):
    what = f"variant_get(try_parse_json({a[0]}), {a[1] if len(a) > 1 else chr(39) + '$' + chr(39)}, 'variant')"
    kind = f"schema_of_variant({what})"
    return (
        f"CASE WHEN {what} IS NULL THEN NULL WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} = 'BOOLEAN' THEN CASE WHEN cast({what} AS BOOLEAN) THEN 'true' ELSE 'false' END "
        f"WHEN {kind} = 'BIGINT' THEN 'integer' WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} LIKE 'OBJECT%' THEN 'object' ELSE 'real' END"
    )


def _json_object(a, s):
    return "to_json(named_struct(" + ", ".join(a) + "), map('ignoreNullFields', 'false'))"


def _typeof(a, s):
    kinds = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "real", "float": "real", "string": "text", "binary": "blob", "void": "null", "boolean": "integer"}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items())
    return f"CASE WHEN ({a[0]}) IS NULL THEN 'null' ELSE CASE typeof({a[0]}) {cases} ELSE CASE WHEN typeof({a[0]}) LIKE 'decimal%' THEN 'real' ELSE 'text' END END END"


def _printf(a, s):
    """Each value as its conversion wants it: whole numbers, doubles or text; nulls as 0 or nothing."""
    if not a or not re.fullmatch(r"'(?:[^']|'')*'", a[0]):
        return f"format_string({', '.join(a)})"
    rest, out, form = list(a[1:]), [], ""
    for plain, flags, letter in re.findall(r"((?:[^%]|%%)+)|%([-+ 0#,]*\d*(?:\.\d+)?)l*([a-zA-Z])", a[0]):
        if plain:
            form += plain
            continue
        value = rest.pop(0) if rest else "NULL"
        if letter in "diuxXo":
            out.append(f"coalesce(cast({value} AS BIGINT), 0L)")
            form += f"%{flags}{'d' if letter in 'diu' else letter}"
        elif letter in "feEgG":
            out.append(f"coalesce(cast({value} AS DOUBLE), 0D)")
            form += f"%{flags}{letter}"
        else:
            text = f"coalesce(cast({value} AS STRING), '')"
            out.append(f"substring({text}, 1, 1)" if letter == "c" else text)
            form += f"%{flags}s"
    return f"format_string({', '.join([form, *out])})"


def _char(a, s):
    """The characters of code points."""
    return "concat(" + ", ".join(f"decode(unhex(lpad(hex(cast({x} AS BIGINT)), 8, '0')), 'UTF-32')" for x in a) + ")" if a else "''"


SHIMS: dict[str, Shim] = {
    "iif": renamed("if"),
    "format": _printf,
    "printf": _printf,
    "char": _char,
    "glob": _glob,
    "unicode": renamed("ascii"),
    "quote": template("CASE WHEN ({0}) IS NULL THEN 'NULL' WHEN typeof({0}) = 'string' THEN concat('''', replace(cast({0} AS STRING), '''', ''''''), '''') ELSE cast({0} AS STRING) END"),
    "max": _extreme("max", "greatest"),
    "min": _extreme("min", "least"),
    "random": lambda a, s: "cast((rand() - 0.5D) * 18446744073709551615D AS BIGINT)",
    "randomblob": template("unhex(substring(replace(concat(uuid(), uuid(), uuid(), uuid()), '-', ''), 1, 2 * ({0})))"),
    "zeroblob": template("unhex(repeat('00', {0}))"),
    "log": _log,
    "log10": _domain("log10({0})", "({0}) > 0"),
    "log2": _domain("log2({0})", "({0}) > 0"),
    "ln": _domain("ln({0})", "({0}) > 0"),
    "sqrt": _domain("sqrt({0})", "({0}) >= 0"),
    "acos": _domain("acos({0})", "abs({0}) <= 1"),
    "asin": _domain("asin({0})", "abs({0}) <= 1"),
    "acosh": _domain("acosh({0})", "({0}) >= 1"),
    "atanh": _domain("atanh({0})", "abs({0}) < 1"),
    "mod": template("CASE WHEN ({1}) <> 0 THEN mod(cast({0} AS DOUBLE), cast({1} AS DOUBLE)) END"),
    "trunc": template("CASE WHEN ({0}) < 0 THEN ceil({0}) ELSE floor({0}) END"),
    "round": lambda a, s: f"cast(round({', '.join(a)}) AS DOUBLE)",
    "likelihood": template("{0}"),
    "likely": template("{0}"),
    "unlikely": template("{0}"),
    "typeof": _typeof,
    "substr": _substr,
    "substring": _substr,
    "group_concat": lambda a, s: f"listagg(cast({a[0]} AS STRING), {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)}){s}",
    "string_agg": lambda a, s: f"listagg(cast({a[0]} AS STRING), {a[1]}){s}",
    "total": template("coalesce(sum(cast({0} AS DOUBLE)){s}, 0.0D)"),
    "date": lambda a, s: f"date_format({_time(a)}, 'yyyy-MM-dd')",
    "time": lambda a, s: f"date_format({_time(a)}, 'HH:mm:ss')",
    "datetime": lambda a, s: f"date_format({_time(a)}, 'yyyy-MM-dd HH:mm:ss')",
    "julianday": lambda a, s: _julian(_time(a)),
    "unixepoch": lambda a, s: f"unix_timestamp({_time(a)})",
    "strftime": _strftime,
    "timediff": lambda a, s: f"cast(({_time(a[:1])} - {_time(a[1:])}) AS STRING)",
    "json": template("to_json(try_parse_json({0}))"),
    "jsonb": template("to_json(try_parse_json({0}))"),
    "json_extract": _json_extract,
    "/": quotient("nullif({0}, 0)"),
    "upper": lambda a, s: f"translate({a[0]}, '{_SMALL}', '{_LARGE}')",  # other letters have no case
    "lower": lambda a, s: f"translate({a[0]}, '{_LARGE}', '{_SMALL}')",
    "json_object": _json_object,
    "json_type": _json_type,
    "json_valid": template("CASE WHEN ({0}) IS NULL THEN NULL WHEN try_parse_json({0}) IS NULL THEN 0 ELSE 1 END"),
    "json_error_position": template("CASE WHEN try_parse_json({0}) IS NULL THEN 1 ELSE 0 END"),
    "json_quote": template("CASE WHEN typeof({0}) = 'string' THEN substring(to_json(array({0})), 2, char_length(to_json(array({0}))) - 2) ELSE coalesce(cast({0} AS STRING), 'null') END"),
    "json_group_array": template("to_json(collect_list({0}){s})"),
    "json_group_object": template("to_json(map_from_entries(collect_list(struct(cast({0} AS STRING), {1})){s}))"),
    "json_set": lambda a, s: f"korrel_json_edit({a[0]}, {a[1]}, to_json(named_struct('v', {a[2]})), 'set')",
    "json_insert": lambda a, s: f"korrel_json_edit({a[0]}, {a[1]}, to_json(named_struct('v', {a[2]})), 'insert')",
    "json_replace": lambda a, s: f"korrel_json_edit({a[0]}, {a[1]}, to_json(named_struct('v', {a[2]})), 'replace')",
    "json_remove": lambda a, s: f"korrel_json_edit({a[0]}, {a[1]}, NULL, 'remove')",
    "json_patch": lambda a, s: f"korrel_json_edit({a[0]}, NULL, {a[1]}, 'patch')",
    "json_pretty": lambda a, s: f"korrel_json_edit({a[0]}, NULL, NULL, 'pretty')",
    "sqlite_version": lambda a, s: "'3.50.0'",
}
SHIMS["json_array"] = lambda a, s: f"to_json(array({', '.join(a)}))"
