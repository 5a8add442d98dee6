"""PostgreSQL's functions where Spark has none of that name, or one that means something else."""

from __future__ import annotations

import re

from korrel.functions.dialect import Shim, quotient, renamed, template

WORDS: dict[str, str] = {"::": "::"}


def _concat(a, s):
    return f"concat_ws('', {', '.join(f'cast({x} AS STRING)' for x in a)})"


def _log(a, s):
    return f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})"


def _trunc(a, s):
    if len(a) == 1:
        return f"CASE WHEN ({a[0]}) < 0 THEN ceil({a[0]}) ELSE floor({a[0]}) END"
    return f"(CASE WHEN ({a[0]}) < 0 THEN ceil(({a[0]}) * power(10, {a[1]})) ELSE floor(({a[0]}) * power(10, {a[1]})) END / power(10, {a[1]}))"


def _regexp_replace(a, s):
    """The first match only, without the flag g; \\1 is the first group."""
    flags = a[3].strip("'") if len(a) > 3 else ""
    pattern = f"concat('(?{flags.replace('g', '')})', {a[1]})" if flags.replace("g", "") else a[1]
    new = f"replace(replace({a[2]}, '$', '\\\\$'), '\\\\', '$')" if "\\" in a[2] else a[2]
    if "g" in flags:
        return f"regexp_replace({a[0]}, {pattern}, {new})"
    return f"regexp_replace({a[0]}, concat('(?s)^(.*?)(?:', {pattern}, ')'), concat('$1', {new}))"


def _encode(a, s):
    form = a[1].strip("'").lower()
    return {"hex": f"lower(hex({a[0]}))", "base64": f"base64({a[0]})"}[form]


def _decode(a, s):
    form = a[1].strip("'").lower()
    return {"hex": f"unhex({a[0]})", "base64": f"unbase64({a[0]})"}[form]


def _extract_path(text: bool) -> Shim:
    def shim(a, s):
        path = "$" + "".join(f"[{x.strip(chr(39))}]" if x.strip("'").isdigit() else f".{x.strip(chr(39))}" for x in a[1:])
        found = f"get_json_object({a[0]}, '{path}')"
        return found if text else f"to_json(try_parse_json({found}))"

    return shim


def _json_object(a, s):
    return f"to_json(named_struct({', '.join(a)}), map('ignoreNullFields', 'false'))"


def _json_typeof(a, s):
    v = f"try_parse_json({a[0]})"
    kind = f"schema_of_variant({v})"
    return (
        f"CASE WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} = 'BOOLEAN' THEN 'boolean' WHEN {kind} = 'STRING' THEN 'string' WHEN {kind} LIKE 'ARRAY%' THEN 'array' "
        f"WHEN {kind} LIKE 'OBJECT%' THEN 'object' WHEN {kind} IS NOT NULL THEN 'number' END"
    )


def _percentile(name: str) -> Shim:
    return lambda a, s: f"{name}({', '.join(a)}){s}"


def _positions(a, s):
    return f"filter(sequence(1, size({a[0]})), i -> element_at({a[0]}, i) <=> {a[1]})"


def _justify(part: str) -> Shim:
    def shim(a, s):
        # days of 24 hours and months of 30 days
        hours = f"extract(DAY FROM {a[0]}) * 24 + extract(HOUR FROM {a[0]})"
        return {"hours": f"make_dt_interval(cast(floor(({hours}) / 24) AS INT), cast(({hours}) % 24 AS INT), cast(extract(MINUTE FROM {a[0]}) AS INT), extract(SECOND FROM {a[0]}))"}.get(part, a[0])

    return shim


def _left(a, s):
    return f"CASE WHEN ({a[1]}) < 0 THEN left({a[0]}, greatest(char_length({a[0]}) + ({a[1]}), 0)) ELSE left({a[0]}, {a[1]}) END"


def _right(a, s):
    return f"CASE WHEN ({a[1]}) < 0 THEN substring({a[0]}, 1 - ({a[1]})) ELSE right({a[0]}, {a[1]}) END"


def _extract(a, s):
    """extract(part FROM x) where PostgreSQL counts otherwise than Spark."""
    found = re.match(r"(?is)(\w+)\s+from\s+(.*)$", a[0])
    return _part(found[1], found[2], f"extract({a[0]})") if found else f"extract({', '.join(a)})"


def _part(part: str, value: str, otherwise: str) -> str:
    part = part.strip("' ").lower()
    if part == "dow":  # Sunday is 0
        return f"(dayofweek({value}) - 1)"
    if part == "isodow":
        return f"(weekday({value}) + 1)"
    if part == "epoch":
        return f"(unix_micros(cast({value} AS TIMESTAMP)) / 1000000D)"
    return otherwise


def _to_char(a, s):
    """Numbers have a place for the sign before them; with FM nothing is padded."""
    form = a[1].strip("'") if len(a) == 2 else ""
    plain = re.fullmatch(r"(?i)(fm)?([90.,dg]+)", form)
    if not plain:
        return f"to_char({', '.join(a)})"
    whole = re.split(r"[.dD]", plain[2])[0]
    least = len(re.sub(r"[^09]", "", whole[whole.find("0") :])) if "0" in whole else 0
    digits = f"ltrim(to_char(abs({a[0]}), '{plain[2].replace('0', '9')}'))"
    if least:  # from the first 0 on there are digits
        before = f"substring_index({digits}, '.', 1)"
        after = f", '.', substring_index({digits}, '.', -1)" if len(whole) < len(plain[2]) else ""
        digits = f"concat(lpad({before}, greatest({least}, char_length({before})), '0'){after})"
    signed = f"concat(CASE WHEN ({a[0]}) < 0 THEN '-' ELSE '' END, {digits})"
    return signed if plain[1] else f"lpad({signed}, {len(plain[2]) + 1}, ' ')"


def _substr(a, s):
    """Places before the first character count, but hold nothing."""
    if len(a) == 1:  # substring(x FROM a FOR b)
        return f"substring({a[0]})"
    if len(a) == 2:
        return f"substring({a[0]}, greatest({a[1]}, 1))"
    return f"substring({a[0]}, greatest({a[1]}, 1), greatest(({a[2]}) + least(({a[1]}) - 1, 0), 0))"


def _age(a, s):
    """Years, months and days between two days, in words; with one argument, up to today."""
    one, other = (f"cast({x} AS DATE)" for x in (a if len(a) > 1 else ["current_date()", a[0]]))
    months = f"cast(months_between({one}, {other}) AS INT)"
    parts = {"year": f"({months}) div 12", "mon": f"({months}) % 12", "day": f"datediff({one}, add_months({other}, {months}))"}
    words = [f"CASE WHEN {n} <> 0 THEN concat({n}, CASE WHEN {n} = 1 THEN ' {name}' ELSE ' {name}s' END) END" for name, n in parts.items()]
    return f"coalesce(nullif(concat_ws(' ', {', '.join(words)}), ''), CASE WHEN {one} IS NOT NULL AND {other} IS NOT NULL THEN '00:00:00' END)"


def _array_to_string(a, s):
    return f"array_join(transform({a[0]}, x -> cast(x AS STRING)), {', '.join(a[1:])})"


_BITS = "cast(CASE WHEN {0} LIKE '%/%' THEN substring_index({0}, '/', -1) ELSE '32' END AS INT)"


def _dotted(number: str) -> str:
    return "concat_ws('.', " + ", ".join(f"cast(({number}) div {1 << shift} % 256 AS STRING)" for shift in (24, 16, 8, 0)) + ")"


def _network(a, s):
    bits = _BITS.format(a[0])
    address = f"aggregate(split(substring_index({a[0]}, '/', 1), '[.]'), 0L, (n, x) -> n * 256 + cast(x AS BIGINT))"
    return f"concat({_dotted(f'({address}) div shiftleft(1L, 32 - {bits}) * shiftleft(1L, 32 - {bits})')}, '/', {bits})"


def _netmask(a, s):
    return _dotted(f"4294967296L - shiftleft(1L, 32 - {_BITS.format(a[0])})")


def _headline(a, s):
    """The words of the query in bold."""
    text, wanted = a[-2:] if len(a) < 4 else a[1:3]
    return f"regexp_replace({text}, concat('(?i)\\\\b(', array_join({wanted}, '|'), ')\\\\b'), '<b>$1</b>')"


def _lexemes(a, s):
    return f"array_distinct(filter(split(lower({a[-1]}), '[^a-z0-9]+'), w -> w <> ''))"


#: Names that only differ.
_RENAMED = {
    "strpos": "instr", "starts_with": "startswith", "chr": "char", "regexp_matches": "regexp_extract_all", "regexp_split_to_array": "split", "string_to_array": "split",
    "array_cat": "concat", "cardinality": "size", "json_array_length": "json_array_length", "jsonb_array_length": "json_array_length",
    "json_object_keys": "explode_keys", "clock_timestamp": "current_timestamp", "statement_timestamp": "current_timestamp", "transaction_timestamp": "current_timestamp",
    "now": "current_timestamp", "version": "version", "btrim": "btrim", "every": "every", "unnest": "explode", "isfinite": "isnotnull",
}

SHIMS: dict[str, Shim] = {k: renamed(v) for k, v in _RENAMED.items() if v != k and v != "explode_keys"}
SHIMS |= {
    "extract": _extract,
    "date_part": lambda a, s: _part(a[0], a[1], f"date_part({a[0]}, {a[1]})"),
    "to_char": _to_char,
    "log": _log,
    "trunc": _trunc,
    "gcd": lambda a, s: f"korrel_gcd({a[0]}, {a[1]})",
    "lcm": lambda a, s: f"CASE WHEN ({a[0]}) = 0 OR ({a[1]}) = 0 THEN 0 ELSE abs({a[0]}) div korrel_gcd({a[0]}, {a[1]}) * abs({a[1]}) END",
    "scale": template("CASE WHEN locate('.', cast({0} AS STRING)) = 0 THEN 0 ELSE char_length(cast({0} AS STRING)) - locate('.', cast({0} AS STRING)) END"),
    "div": template("cast(({0}) / ({1}) AS BIGINT)"),
    "concat": _concat,
    "textcat": template("concat({0}, {1})"),
    "format": lambda a, s: f"format_string({', '.join([a[0].replace('%I', '%s').replace('%L', '%s'), *a[1:]])})",
    "quote_ident": template("CASE WHEN {0} RLIKE '^[a-z_][a-z0-9_]*$' THEN {0} ELSE concat('\"', replace({0}, '\"', '\"\"'), '\"') END"),
    "quote_literal": template("concat('''', replace(cast({0} AS STRING), '''', ''''''), '''')"),
    "quote_nullable": template("coalesce(concat('''', replace(cast({0} AS STRING), '''', ''''''), ''''), 'NULL')"),
    "to_hex": template("lower(hex({0}))"),
    "like_escape": template("replace({0}, {1}, '\\\\')"),
    "normalize": template("{0}"),
    "regexp_replace": _regexp_replace,
    "regexp_match": template("CASE WHEN regexp_like({0}, {1}) THEN array(regexp_substr({0}, {1})) END"),
    "regexp_matches": template("regexp_extract_all({0}, {1}, 0)"),
    "regexp_split_to_table": template("explode(split({0}, {1}))"),
    "string_to_array": template("split({0}, concat('\\\\Q', {1}, '\\\\E'))"),
    "string_to_table": template("explode(split({0}, concat('\\\\Q', {1}, '\\\\E')))"),
    "array_to_string": _array_to_string,
    "/": quotient("{0}"),
    "left": _left,
    "right": _right,
    "substr": _substr,
    "substring": _substr,
    "initcap": template("array_join(transform(regexp_extract_all({0}, r'[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+', 0), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')"),
    **{f"sha{n}": template(f"unhex(sha2({{0}}, {n}))") for n in (224, 256, 384, 512)},
    "encode": _encode,
    "decode": _decode,
    "age": _age,
    "timezone": template("from_utc_timestamp({1}, {0})"),
    "make_timestamptz": renamed("make_timestamp"),
    "justify_hours": _justify("hours"),
    "justify_days": _justify("days"),
    "justify_interval": _justify("hours"),
    "overlaps": template("({0} < {3} AND {2} < {1})"),
    "json_agg": template("to_json(collect_list({0}){s})"),
    "jsonb_agg": template("to_json(collect_list({0}){s})"),
    "json_object_agg": template("to_json(map_from_entries(collect_list(struct(cast({0} AS STRING), {1})){s}))"),
    "jsonb_object_agg": template("to_json(map_from_entries(collect_list(struct(cast({0} AS STRING), {1})){s}))"),
    "array_agg": lambda a, s: f"transform(collect_list(struct({a[0]} AS v)){s}, x -> x.v)",
    "string_agg": lambda a, s: f"listagg(cast({a[0]} AS STRING), {a[1]}){s}",
    "to_jsonb": renamed("to_json"),
    "row_to_json": renamed("to_json"),
    "array_to_json": renamed("to_json"),
    "json_build_object": _json_object,
    "jsonb_build_object": _json_object,
    "json_build_array": lambda a, s: f"to_json(array({', '.join(a)}))",
    "jsonb_build_array": lambda a, s: f"to_json(array({', '.join(a)}))",
    "json_object": template("to_json(str_to_map(array_join({0}, ',')))"),
    "json_object_keys": template("explode(json_object_keys({0}))"),
    "jsonb_object_keys": template("explode(json_object_keys({0}))"),
    "json_array_elements": template("explode(transform(from_json({0}, 'array<variant>'), x -> to_json(x)))"),
    "jsonb_array_elements": template("explode(transform(from_json({0}, 'array<variant>'), x -> to_json(x)))"),
    "json_array_elements_text": template("explode(from_json({0}, 'array<string>'))"),
    "jsonb_array_elements_text": template("explode(from_json({0}, 'array<string>'))"),
    "json_each_text": template("explode(from_json({0}, 'map<string,string>'))"),
    "jsonb_each_text": template("explode(from_json({0}, 'map<string,string>'))"),
    "json_each": template("explode(from_json({0}, 'map<string,string>'))"),
    "jsonb_each": template("explode(from_json({0}, 'map<string,string>'))"),
    **{f"json{b}_extract_path": _extract_path(False) for b in ("", "b")},
    **{f"json{b}_extract_path_text": _extract_path(True) for b in ("", "b")},
    "json_typeof": _json_typeof,
    "jsonb_typeof": _json_typeof,
    **{f"json{b}_strip_nulls": (lambda a, s: f"korrel_json_edit({a[0]}, NULL, NULL, 'strip')") for b in ("", "b")},
    "jsonb_set": lambda a, s: f"korrel_json_edit({a[0]}, concat('$.', array_join(split(btrim({a[1]}, '{{}}'), ','), '.')), concat('{{\"v\":', {a[2]}, '}}'), 'set')",
    "jsonb_insert": lambda a, s: f"korrel_json_edit({a[0]}, concat('$.', array_join(split(btrim({a[1]}, '{{}}'), ','), '.')), concat('{{\"v\":', {a[2]}, '}}'), 'insert')",
    "jsonb_pretty": lambda a, s: f"korrel_json_edit({a[0]}, NULL, NULL, 'pretty')",
    "jsonb_path_query_first": template("get_json_object({0}, {1})"),
    "jsonb_path_query": template("get_json_object({0}, {1})"),
    "jsonb_path_query_array": template("concat('[', coalesce(get_json_object({0}, {1}), ''), ']')"),
    "jsonb_path_exists": template("(get_json_object({0}, {1}) IS NOT NULL)"),
    "jsonb_path_match": template("coalesce(get_json_object({0}, {1}) = 'true', false)"),
    "array_length": template("nullif(size({0}), 0)"),
    "array_lower": template("CASE WHEN size({0}) > 0 THEN 1 END"),
    "array_upper": template("nullif(size({0}), 0)"),
    "array_ndims": template("CASE WHEN size({0}) > 0 THEN 1 END"),
    "array_dims": template("CASE WHEN size({0}) > 0 THEN concat('[1:', size({0}), ']') END"),
    "array_position": template("nullif(array_position({0}, {1}), 0)"),
    "array_positions": _positions,
    "array_prepend": template("array_prepend({1}, {0})"),
    "array_replace": template("transform({0}, x -> CASE WHEN x <=> {1} THEN {2} ELSE x END)"),
    "array_fill": template("array_repeat({0}, element_at({1}, 1))"),
    "trim_array": template("slice({0}, 1, size({0}) - ({1}))"),
    "generate_subscripts": template("explode(sequence(1, size({0})))"),
    "generate_series": lambda a, s: f"explode(sequence({', '.join(a)}))",
    "num_nulls": lambda a, s: "(" + " + ".join(f"cast(({x}) IS NULL AS INT)" for x in a) + ")",
    "num_nonnulls": lambda a, s: "(" + " + ".join(f"cast(({x}) IS NOT NULL AS INT)" for x in a) + ")",
    "gen_random_uuid": renamed("uuid"),
    "pg_typeof": template("typeof({0})"),
    "pg_size_pretty": template("CASE WHEN abs({0}) < 10240 THEN concat({0}, ' bytes') WHEN abs({0}) < 10485760 THEN concat(round(({0}) / 1024), ' kB') ELSE concat(round(({0}) / 1048576), ' MB') END"),
    "current_database": lambda a, s: "'korrel'",
    "current_schema": lambda a, s: "'public'",
    **{k: template(f"cast({{0}} AS {t})") for k, t in {"text": "STRING", "int2": "SMALLINT", "int4": "INT", "int8": "BIGINT", "float4": "FLOAT", "float8": "DOUBLE", "numeric": "DECIMAL(38,10)", "bool": "BOOLEAN", "timestamptz": "TIMESTAMP", "varchar": "STRING", "bpchar": "STRING"}.items()},
    # ranges are structs (lo, hi, lower_inc, upper_inc)
    "isempty": template("({0}.lo > {0}.hi OR {0}.lo = {0}.hi AND NOT ({0}.lower_inc AND {0}.upper_inc))"),
    "lower_inc": template("{0}.lower_inc"),
    "upper_inc": template("{0}.upper_inc"),
    "lower_inf": template("({0}.lo IS NULL)"),
    "upper_inf": template("({0}.hi IS NULL)"),
    "range_merge": template("named_struct('lo', least({0}.lo, {1}.lo), 'hi', greatest({0}.hi, {1}.hi), 'lower_inc', true, 'upper_inc', false)"),
    # networks are text: address/bits, for IPv4
    "host": template("substring_index({0}, '/', 1)"),
    "masklen": template("cast(CASE WHEN {0} LIKE '%/%' THEN substring_index({0}, '/', -1) ELSE '32' END AS INT)"),
    "family": template("CASE WHEN {0} LIKE '%:%' THEN 6 ELSE 4 END"),
    # full text by word sets; ranks are not PostgreSQL's
    **dict.fromkeys(("to_tsvector", "plainto_tsquery", "phraseto_tsquery", "websearch_to_tsquery", "to_tsquery"), _lexemes),
    "ts_rank_cd": template("(size(array_intersect({0}, {1})) / greatest(size({1}), 1))"),
    "ts_headline": _headline,
    "network": _network,
    "netmask": _netmask,
    "ts_rank": template("(size(array_intersect({0}, {1})) / greatest(size({1}), 1))"),
}
SHIMS["date_bin"] = lambda a, s: (
    f"timestamp_micros(unix_micros(cast({a[2]} AS TIMESTAMP)) + cast(floor((unix_micros(cast({a[1]} AS TIMESTAMP)) - unix_micros(cast({a[2]} AS TIMESTAMP))) "
    f"/ (unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {a[0]}) * 1D)) AS BIGINT) * unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {a[0]}))"
)
