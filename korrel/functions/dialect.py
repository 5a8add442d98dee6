"""SQLite and PostgreSQL function calls rewritten to Spark SQL expressions that mean the same."""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|\s+|->>|->|::|\|\||.", re.S)
_SUFFIX = re.compile(r"\s*(?:(?:FILTER|OVER|WITHIN\s+GROUP)\s*\(|OVER\s+[A-Za-z_]\w*)", re.I)

#: name -> function of the arguments' SQL and of what follows the call (FILTER, OVER, WITHIN GROUP).
Shim = Callable[[list[str], str], str]


#: PostgreSQL's type names that Spark has under another.
TYPES = {
    "text": "STRING", "varchar": "STRING", "character varying": "STRING", "bpchar": "STRING", "name": "STRING", "json": "STRING", "jsonb": "STRING", "bool": "BOOLEAN", "bytea": "BINARY", "int2": "SMALLINT", "int4": "INT", "int8": "BIGINT",
    "integer": "INT", "real": "FLOAT", "float4": "FLOAT", "float8": "DOUBLE", "double precision": "DOUBLE", "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP", "timestamp without time zone": "TIMESTAMP_NTZ",
}


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _close(parts: list[str], at: int, opening: str = "(", closing: str = ")") -> int:
    """Where the bracket opened at ``at`` closes."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k] == opening) - (parts[k] == closing)
        if depth == 0:
            return k
    return -1


def _arguments(parts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for x in parts:
        depth += (x in "([") - (x in ")]") if len(x) == 1 else 0
        if x == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return out if any(x.strip() for part in out for x in part) else []


def rewrite(sql: str, dialect: str) -> str:
    from korrel.functions import postgres, sqlite

    shims = {"sqlite": sqlite.SHIMS, "postgres": postgres.SHIMS}[dialect]
    words = {"sqlite": sqlite.WORDS, "postgres": postgres.WORDS}[dialect]
    return _rewrite(tokens(sql), shims, words)


def _rewrite(parts: list[str], shims: dict[str, Shim], words: dict[str, str]) -> str:
    out, k = [], 0
    while k < len(parts):
        word = parts[k]
        after = k + 1
        while after < len(parts) and parts[after].isspace():
            after += 1
        if re.fullmatch(r"[A-Za-z_]\w*", word) and after < len(parts) and parts[after] == "(" and word.lower() in shims and not (out and out[-1] == "."):
            end = _close(parts, after)
            if end > 0:
                arguments = [_rewrite(x, shims, words).strip() for x in _arguments(parts[after + 1 : end])]
                suffix, k = "", end + 1
                while m := _SUFFIX.match("".join(parts[k:])):
                    if m[0].endswith("("):
                        opened = next(j for j in range(k, len(parts)) if parts[j] == "(")
                        closed = _close(parts, opened)
                        suffix += "".join(parts[k : opened + 1]) + _rewrite(parts[opened + 1 : closed], shims, words) + ")"
                        k = closed + 1
                    else:
                        taken = ""
                        while len(taken) < len(m[0]):
                            taken += parts[k]
                            k += 1
                        suffix += taken
                out.append(shims[word.lower()](arguments, suffix))
                continue
        if word.lower() == "array" and after < len(parts) and parts[after] == "[":
            end = _close(parts, after, "[", "]")
            inside = _rewrite(parts[after + 1 : end], shims, words)
            out.append(f"array({inside})")
            k = end + 1
            continue
        if word == "/" and "/" in shims:
            left = _chain(out)
            right, k = _factor(parts, k + 1)
            out.append(shims["/"]([left.strip(), _rewrite(right, shims, words).strip()], ""))
            continue
        if word == "::" and "::" in words:
            typed = re.match(r"\s*([A-Za-z_]\w*(?:\s+precision|\s+varying|\s+with(?:out)?\s+time\s+zone)?)", "".join(parts[k + 1 :]), re.I)
            if typed and (known := TYPES.get(" ".join(typed[1].lower().split()))):
                left, k = _operand(out), k + 1
                taken = ""
                while len(taken) < len(typed[0]):
                    taken += parts[k]
                    k += 1
                out.append(f"cast({left} AS {known})")
                continue
        if word in ("->", "->>"):
            left = _operand(out)
            k += 1
            while k < len(parts) and parts[k].isspace():
                k += 1
            path = parts[k]
            k += 1
            out.append(f"get_json_object({left}, {_path(path)})")
            continue
        out.append(words.get(word.lower(), word) if not (out and out[-1] == ".") else word)
        k += 1
    return "".join(out)


def _operand(out: list[str]) -> str:
    """Take the operand in front of an operator back from what is written."""
    taken = []
    while out and out[-1].isspace():
        out.pop()
    while out:
        x = out.pop()
        taken.insert(0, x)
        if x == ")":
            depth = 1
            while depth and out:
                y = out.pop()
                depth += (y == ")") - (y == "(")
                taken.insert(0, y)
            continue
        if out and out[-1] == "." or x == ".":
            continue
        break
    return "".join(taken)


def _chain(out: list[str]) -> str:
    """Take the factors in front of a division back from what is written: a * b / c divides a * b."""
    taken = _operand(out)
    while True:
        at = len(out)
        while at and out[at - 1].isspace():
            at -= 1
        if not at or out[at - 1] not in ("*", "%"):
            return taken
        sign = out[at - 1]
        del out[at - 1 :]
        taken = f"{_operand(out)} {sign} {taken}"


def _factor(parts: list[str], k: int) -> tuple[list[str], int]:
    """The tokens of the operand at ``k``, and where it ends: a signed name, number, call or bracket."""
    begin = k
    while k < len(parts) and (parts[k].isspace() or parts[k] in "+-"):
        k += 1
    if k < len(parts) and parts[k] == "(":
        k = _close(parts, k) + 1
    else:
        k += 1
        while k + 1 < len(parts) and parts[k] == ".":
            k += 2
        if k < len(parts) and parts[k] == "(":
            k = _close(parts, k) + 1
    return parts[begin:k], k


_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"


def quotient(by_zero: str) -> Shim:
    """Division that drops the rest where both sides are whole numbers; ``by_zero`` says what a divisor of 0 becomes."""

    def shim(a: list[str], s: str) -> str:
        left, right = a[0], by_zero.format(a[1])
        if all(re.fullmatch(r"-?\d+", x) for x in a):
            return f"({left} div {right})"
        return f"(CASE WHEN typeof({left}) IN {_WHOLE} AND typeof({a[1]}) IN {_WHOLE} THEN cast({left} AS BIGINT) div cast({right} AS BIGINT) ELSE ({left}) / {right} END)"

    return shim


def _path(text: str) -> str:
    body = text.strip("'")
    if body.startswith("$"):
        return f"'{body}'"
    return f"'$[{body}]'" if body.isdigit() else f"'$.{body}'"


def renamed(name: str) -> Shim:
    return lambda a, s: f"{name}({', '.join(a)}){s}"


def template(text: str, least: int = 0) -> Shim:
    """``{0}`` .. are arguments, ``{s}`` what follows the call (put behind the whole unless it is named)."""

    def shim(a: list[str], s: str) -> str:
        filled = text.format(*a, *[""] * 8, s=s)
        return f"({filled})" if "{s}" in text else f"({filled}){s}"

    return shim
