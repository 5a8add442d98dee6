"""Facts from raw texts: what is nested in what, by prefix sums over tags or brackets instead of a parser.

Each text is cut into marks (tags, brackets) by one pattern. An opening mark counts one up, a closing one down; a
closing mark belongs to the opening one that stands before it on its level. Marks without a partner of their own
name are left out first, so what is never closed has no extent and doesn't shift the levels of what follows.
All windows are those of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.session import checkpointed

#: What is one mark in a page. Comments and the texts of scripts and styles hide tags.
TAGS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>]*>"
BRACKETS = r"[()\[\]{}]"


def marks(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, k, mark, start, line): the pattern's matches in their order; start counts characters from 0, lines from 1."""
    found = df.select(F.col(key), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    rows = found.repartition(F.col(key)).select(key, F.posexplode(F.arrays_zip("m", "gap")).alias("k", "x")).filter(F.col("x.m").isNotNull())
    breaks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n")))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda f: F.coalesce(F.sum(f(F.col("x.m")) + f(F.col("x.gap"))).over(before), F.lit(0)) + f(F.col("x.gap"))
    return rows.select(key, "k", F.col("x.m").alias("mark"), total(F.char_length).cast("int").alias("start"), (total(breaks) + 1).cast("int").alias("line"))


def paired(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (by.., k, step: 1 or -1) that have a partner, with its ``mate`` (k) and their ``level`` from 1 up."""
    ordered = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("step").over(ordered), F.lit(0)) + (F.col("step") + 1) / 2
    leveled = rows.withColumn("level", level.cast("int"))
    side = Window.partitionBy(*by, "level").orderBy("k")
    next_, last = F.lead(F.struct("step", "k")).over(side), F.lag(F.struct("step", "k")).over(side)
    mate = F.when((F.col("step") == 1) & (next_["step"] == -1), next_["k"]).when((F.col("step") == -1) & (last["step"] == 1), last["k"])
    return leveled.withColumn("mate", mate).filter("mate is not null")


_NODE = ["slot", "kind", "start", "end", "line", "end_line", "depth", "parent", "mark"]


def _nested(rows: DataFrame, key: str, lone: Column) -> DataFrame:
    """(key, slot, kind, start, end, line, end_line, depth, parent, mark) of marks (key, k, mark, kind, step, start, line).

    Marks that ``lone`` is true of are nodes by themselves, as are opening ones that nothing closes.
    """
    rows = checkpointed(rows)  # read many times below, as are the spans and nodes
    kept = paired(rows.filter(~lone), [key, "kind"]).select(key, F.col("k"), F.lit(True).alias("whole"))
    all_ = rows.join(kept, [key, "k"], "left")
    spans = checkpointed(paired(all_.filter("whole").drop("whole"), [key]))  # levels of all names together, so no two spans cross
    closing = spans.filter("step = -1").select(key, F.col("mate").alias("k"), (F.col("start") + F.char_length("mark")).alias("end"), F.col("line").alias("end_line"))
    tail = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n")))
    single = all_.filter(F.col("whole").isNull() & (lone | (F.col("step") == 1))).select(key, "k", "mark", "kind", "start", "line", F.lit(None).cast("int").alias("level"), (F.col("start") + F.char_length("mark")).alias("end"), (F.col("line") + tail(F.col("mark"))).cast("int").alias("end_line"))
    opened = spans.filter("step = 1").join(closing, [key, "k"]).select(key, "k", "mark", "kind", "start", "line", "level", "end", "end_line")
    nodes = checkpointed(opened.unionByName(single))
    # What a node lies in: of the spans that are open where it begins, the last. Depth runs up over openings and ends.
    turns = nodes.select(key, F.col("start").alias("at"), F.lit(1).alias("side"), F.when(F.col("level").isNotNull(), 1).otherwise(0).alias("turn"), "k").unionByName(
        nodes.filter("level is not null").select(key, F.col("end").alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("turn"), "k")
    )
    before = Window.partitionBy(key).orderBy("at", "side", "k").rowsBetween(Window.unboundedPreceding, -1)
    deep = turns.withColumn("depth", F.coalesce(F.sum("turn").over(before), F.lit(0)).cast("int")).filter("side = 1")
    # on the level above, the last opening before it
    up = deep.select(key, "at", "k", (F.col("depth") + 1).alias("floor"), F.when(F.col("turn") == 1, F.col("k")).alias("open"), F.lit(None).cast("int").alias("asks"), "depth").unionByName(
        deep.select(key, "at", "k", F.col("depth").alias("floor"), F.lit(None).cast("int").alias("open"), F.col("k").alias("asks"), "depth")
    )
    last = F.last("open", ignorenulls=True).over(Window.partitionBy(key, "floor").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1))
    parents = up.withColumn("parent", last).filter("asks is not null").select(key, F.col("asks").alias("k"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"))
    return nodes.join(parents, [key, "k"]).withColumnRenamed("k", "slot").select(key, *_NODE)


def elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, slot, kind, start, end, line, end_line, depth, parent, mark): the elements of pages; ``mark`` is the opening
    tag's text. Elements that stand alone, or that nothing closes, end with their tag. A null page has none."""
    rows = marks(df, key, html, TAGS)
    kind = F.when(F.startswith("mark", F.lit("<!--")), "comment").otherwise(F.lower(F.regexp_extract("mark", r"^</?([A-Za-z][^\s/>]*)", 1)))
    rows = rows.withColumns({"kind": kind, "step": F.when(F.startswith("mark", F.lit("</")), -1).otherwise(1)})
    lone = F.col("kind").isin("comment", "script", "style") | F.endswith("mark", F.lit("/>"))
    return _nested(rows, key, lone)


def brackets(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same of round, square and curly brackets; ``kind`` is the opening one."""
    rows = marks(df, key, text, BRACKETS)
    kind = F.translate("mark", ")]}", "([{")
    return _nested(rows.withColumns({"kind": kind, "step": F.when(F.col("mark") == kind, 1).otherwise(-1)}), key, F.lit(False))


def attribute(mark: Column, name: str) -> Column:
    """An attribute of an opening tag, quoted or not; null where it has none."""
    pattern = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s"'>]+))"""
    found = F.concat(*(F.regexp_extract(mark, pattern, k) for k in (1, 2, 3)))
    return F.when(mark.rlike(pattern), found)


def facts(df: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """Definitions and references of pages, as ``Facts`` and ``linking`` read them.

    defs(file_id, slot, kind, name, start, end, line, end_line, depth, parent): every element; its name is its id, else
    its class. refs(file_id, idx, from_slot, kind, name, start, line): what elements name by href or src; ``from_slot``
    is the element around it.
    """
    made = elements(df, key, html).withColumnRenamed(key, "file_id")
    defs = made.withColumn("name", F.coalesce(attribute(F.col("mark"), "id"), attribute(F.col("mark"), "class"))).drop("mark")
    used = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), attribute(F.col("mark"), k).alias("name")) for k in ("href", "src")))).alias("u")
    refs = made.filter("kind <> 'comment'").select("file_id", F.col("slot").alias("idx"), F.col("parent").alias("from_slot"), used, "start", "line").filter("u.name is not null")
    return defs.select("file_id", "slot", "kind", "name", "start", "end", "line", "end_line", "depth", "parent"), refs.select("file_id", "idx", "from_slot", "u.kind", "u.name", "start", "line")
