"""Line search, substring occurrences, trigram candidates, and the shaping of hits, as Column expressions.

Columns count characters, from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.operators.prefix import running
from korrel.plans.errors import CommandInvalid

SHOWN, SNIPPET = 200, 120
#: Lines whose search took too long that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 4096, 4096
CODE_CHARS, PROSE_CHARS, SYMBOL_SHARE = 3.2, 3.8, 0.18


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), lines from 1; the empty line behind a final line end isn't one."""
    found = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("line_no", "line"), F.size(F.split(F.col(text), "\r?\n", -1)).alias("__n"))
    return found.filter(~((F.col("line") == "") & (F.col("line_no") + 1 == F.col("__n")))).select(key, (F.col("line_no") + 1).alias("line_no"), "line")


def alternatives(pattern: str) -> list[str]:
    """The parts between bars; the pattern itself if one is empty."""
    parts = pattern.split("|")
    return parts if all(parts) else [pattern]


def first_of(line: Column, literals: list[str]) -> Column:
    """Where the earliest of the literals begins; 0 if none does."""
    at = [F.instr(line, x) for x in literals]
    found = F.least(*(F.when(x > 0, x) for x in at)) if len(at) > 1 else F.when(at[0] > 0, at[0])
    return F.coalesce(found, F.lit(0))


def required_literals(pattern: str) -> list[str]:
    """A literal that every match of each top-level branch has; none for some branch means none at all."""
    if re.search(r"\(\?[a-z]*i", pattern):
        return []
    branches, depth, own, k = [], 0, "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            own += pattern[k : k + 2]
            k += 2
            continue
        if c == "[":
            end = pattern.find("]", k + 2)
            own += pattern[k : end + 1]
            k = end + 1 if end > 0 else len(pattern)
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            branches.append(own)
            own = ""
        else:
            own += c
        k += 1
    branches.append(own)
    found = []
    for branch in branches:
        flat = re.sub(r"\((?:[^()]|\([^()]*\))*\)[*+?]?(?:\{[^}]*\})?|\[[^\]]*\][*+?]?(?:\{[^}]*\})?", "\x00", branch)
        flat = re.sub(r"\\[a-zA-Z0-9][*+?]?|[.^$][*+?]?", "\x00", flat)
        flat = re.sub(r"\\?[^\x00][*?]\??|.\{0[^}]*\}", "\x00", flat)
        flat = re.sub(r"\+\??|\{[^}]*\}", "\x00", flat)
        best = max((x.replace("\\", "") for x in flat.split("\x00")), key=len, default="")
        if not best:
            return []
        found.append(best)
    return found


def search_lines(df: DataFrame, key: str, text: str, pattern: str, regex: bool = False) -> DataFrame:
    """(key, line_no, column, line): the first hit of each line that has one.

    A literal is looked for whole; only if no line has it are its alternatives. Texts without any literal that
    a regex needs aren't split into lines.
    """
    if regex:
        need = required_literals(pattern)
        rows = df.filter(first_of(F.col(text), need) > 0) if need else df
        hits = lines(rows, key, text)
        expression = f"(?U){pattern}"
        hits = hits.filter(F.col("line").rlike(expression))
        return hits.select(key, "line_no", F.regexp_instr("line", F.lit(expression)).alias("column"), "line")
    whole = lines(df.filter(F.instr(F.col(text), pattern) > 0), key, text).select(key, "line_no", F.instr("line", pattern).alias("column"), "line").filter("column > 0")
    parts = alternatives(pattern)
    if len(parts) == 1 or not whole.isEmpty():
        return whole
    found = lines(df.filter(first_of(F.col(text), parts) > 0), key, text)
    return found.select(key, "line_no", first_of(F.col("line"), parts).alias("column"), "line").filter("column > 0")


def search_within(df: DataFrame, key: str, text: str, pattern: str, seconds: float) -> DataFrame:
    """(key, line_no, column, outcome, line): lines that match (``match``), and those whose search took longer than
    ``seconds`` (``not_searched``), so that a pattern that explodes is never taken for one that doesn't match.

    The budget is time, as neither Spark's nor Python's matchers tell their steps. A line that took longer isn't tried
    again where the same task meets it again.
    """

    def run(batches):
        import pyarrow as pa
        import regex

        find, endless = regex.compile(pattern), set()
        for batch in batches:
            rows = []
            for at, line in enumerate(batch.column("line").to_pylist()):
                if line in endless:
                    rows.append((at, None, "not_searched"))
                    continue
                try:
                    hit = find.search(line, timeout=seconds)
                except TimeoutError:
                    if len(line) <= LONGEST and len(endless) < REMEMBERED:
                        endless.add(line)
                    rows.append((at, None, "not_searched"))
                    continue
                if hit:
                    rows.append((at, hit.start() + 1, "match"))
            taken = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), taken.column(2)], names=[key, "line_no", "column", "outcome", "line"])

    need = required_literals(pattern)
    rows = lines(df.filter(first_of(F.col(text), need) > 0) if need else df, key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, line_no int, column int, outcome string, line string")


def trigrams(c: Column) -> Column:
    """The text's distinct runs of three characters, sorted; none where it is shorter."""
    places = F.when(F.char_length(c) >= 3, F.sequence(F.lit(1), F.char_length(c) - 2)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_distinct(F.transform(places, lambda k: F.substring(c, k, F.lit(3)))))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): which rows have which trigram."""
    return df.select(F.explode(trigrams(F.col(text))).alias("gram"), F.col(key))


def candidates(index: DataFrame, key: str, literals: list[str]) -> DataFrame | None:
    """Keys whose rows have all trigrams of some literal; None if a literal is too short to tell."""
    if any(len(x) < 3 for x in literals):
        return None
    found = None
    for literal in literals:
        grams = sorted({literal[k : k + 3] for k in range(len(literal) - 2)})
        own = index.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(key)
        found = own if found is None else found.union(own)
    return found.distinct()


def occurrences(c: Column, literal: str) -> Column:
    """How often the literal occurs, overlaps counted."""
    last = F.char_length(c) - len(literal) + 1
    if set(literal[:k] == literal[len(literal) - k :] for k in range(1, len(literal))) <= {False}:
        return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(literal)))) / len(literal)).cast("long")  # it can't overlap itself
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda k: F.substring(c, k, F.lit(len(literal))) == literal)).cast("long")


def tally(df: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """(key, hits) of the rows that have the folded literal."""
    folded = F.lower(F.col(text))
    return df.filter(F.contains(folded, F.lit(literal.lower()))).select(key, occurrences(folded, literal.lower()).alias("hits"))


def top(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc("hits"), key).limit(n)


def rank_groups(hits: DataFrame, key: str, definition: Column, kind: Column) -> DataFrame:
    """One group for each key, kind and role, definitions first, then code, then keys with many hits.

    ``place`` numbers the groups; the number of hits of all the key's groups counts.
    """
    rank = F.when(definition, 0).otherwise(2)
    groups = hits.groupBy(key, rank.alias("rank"), kind.alias("kind")).agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"))
    total = F.sum("hits").over(Window.partitionBy(key))
    return groups.withColumn("file_hits", total).select("*", (F.col("kind") != "code").cast("int").alias("not_code")).drop("not_code")


def order_of_groups(key: str) -> list[Column]:
    return [F.col("rank"), (F.col("kind") != "code").cast("int"), F.desc("file_hits"), F.col(key), F.col("first_line"), F.col("kind")]


def page(groups: DataFrame, order: list[Column], cost: Column, budget: int, offset: int = 0) -> DataFrame:
    """The groups from ``offset`` on that fit the budget together, one at least; ``order`` tells groups apart."""
    numbered = running(groups, [], order, F.lit(1).cast("long"), "__before", "__all").withColumn("place", (F.col("__before") + 1).cast("int")).drop("__before", "__all")
    spent = running(numbered.filter(F.col("place") > offset), [], ["place"], cost, "spent", "__all").drop("__all").withColumn("spent", F.col("spent") + cost)
    return spent.filter((F.col("spent") <= budget) | (F.col("place") == offset + 1))


def snippet(line: Column, column: Column, length: int, width: int = SNIPPET) -> Column:
    """The part of a long line round a match, with marks where it was cut."""
    start = F.greatest(F.lit(1), column - F.lit((width - length) // 2))
    start = F.least(start, F.greatest(F.lit(1), F.char_length(line) - width + 1))
    part = F.substring(line, start, F.lit(width))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(start + width <= F.char_length(line), "…").otherwise(""))
    return F.when(F.char_length(line) <= width, line).otherwise(cut)


def legend(hits: DataFrame, line: str = "line") -> DataFrame:
    """(line, n) of the lines that hits share."""
    return hits.groupBy(line).agg(F.count("*").alias("n")).filter("n > 1")


def in_scope(path: Column, prefix: str) -> Column:
    """A path at or under ``prefix``, whatever the case."""
    p = prefix.rstrip("/").lower()
    return (F.lower(path) == p) | F.startswith(F.lower(path), F.lit(p + "/")) if p else F.lit(True)


def minified(path: Column, text: Column) -> Column:
    """``.min.`` in the name, or at least 4 KiB with a line over 32 KiB or 400 bytes a line."""
    rows = F.split(text, "\n", -1)
    longest = F.array_max(F.transform(rows, F.octet_length))
    return path.rlike(r"(?i)\.min\.[^/]+$") | ((F.octet_length(text) >= 4096) & ((longest > 32 * 1024) | (F.octet_length(text) / F.size(rows) > 400)))


def vocabulary(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))


def token_estimate(text: Column) -> Column:
    """Tokens by characters: fewer a token in texts with many signs."""
    signs = F.char_length(F.regexp_replace(text, r"[A-Za-z0-9\s]", ""))
    code = signs / F.greatest(F.char_length(text), F.lit(1)) >= SYMBOL_SHARE
    return F.ceil(F.char_length(text) / F.when(code, CODE_CHARS).otherwise(PROSE_CHARS)).cast("long")


def strip_escapes(text: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(text, "\x1b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|[@-Z\\\\-_])", "")


def failures(text: Column) -> Column:
    """Whether a log line tells of a failure, and not of a vendored frame."""
    return text.rlike(r"(?i)\b(error|fail(ed|ure)?|panic|exception|assert|traceback)\b") & ~text.rlike(r"(node_modules|site-packages|/usr/lib)/")


def condensed(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new, n): a change made in many places, once."""
    return pairs.groupBy(old, new).agg(F.count("*").alias("n"))


def normalized(text: Column) -> Column:
    """Without comments and spare white space, for finding a passage that was set differently."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/", " "), r"\s+", " "))


def locate_unique(text: Column, passage: str) -> Column:
    """Where the normalised passage stands if it stands in one place alone; else 0."""
    spot = " ".join(re.sub(r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/", " ", passage).split())
    return F.when(occurrences(normalized(text), spot) == 1, F.instr(normalized(text), spot)).otherwise(0)


def spans_at(offsets: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each offset with the innermost span over it: start <= offset < end, the largest start."""
    s = spans.withColumnRenamed(key, "__key")
    joined = offsets.join(s, (F.col(key) == F.col("__key")) & (F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")), "left")
    return joined.groupBy(key, "offset").agg(F.max_by(F.struct("kind", "symbol"), "start").alias("inner")).select(key, "offset", "inner.kind", "inner.symbol")


def sniff(data: Column) -> Column:
    """The encoding a file's bytes speak for: a mark at the start, NUL bytes, valid UTF-8, or the fallback."""
    head = F.hex(F.substring(data, 1, 3))
    utf8 = F.is_valid_utf8(data.cast("string"))
    return (
        F.when(head.startswith("FFFE"), "utf16le").when(head.startswith("FEFF"), "utf16be").when(F.hex(data).rlike("^(..)*00"), "binary").when(utf8, "utf8").otherwise("windows-1254")
    )


def filter_kinds(hits: DataFrame, *kinds: str) -> tuple[DataFrame, DataFrame]:
    """Hits of those kinds (code, comment, string), and (kind, removed) for the others."""
    if not kinds or not set(kinds) <= KINDS:
        raise CommandInvalid(f"kinds are {', '.join(sorted(KINDS))}")
    wanted = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    return hits.filter(wanted), hits.filter(~wanted).groupBy("kind").agg(F.count("*").alias("removed"))


#: What a place in a file can be.
KINDS = {"code", "comment", "string"}
