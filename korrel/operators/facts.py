"""A fact graph as relations: definitions, references and imports; bounded breadth-first questions.

Definitions are (file_id, slot); files carry paths and whether they were read. Tables as in the tests:
files(file_id, path, status), defs(file_id, slot, kind, name, qname, line), refs(file_id, from_slot, kind,
name, start, line, target_file, target_slot, reason, is_dynamic), imports(file_id, target_file).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.plans.errors import DepthOutOfRange, SubjectNotFound
from korrel.session import checkpointed

INVOKING = ("call", "new")
#: Reasons of unresolved references that may still be the subject; the others leave the repository or are typed.
OUTSIDE = ("global", "external_module")
BINDABLE = ("untyped_receiver", "ambiguous", "dynamic", "unknown_import", "computed_member", "any_type", "union_type", "unresolved_export", "missing_file", "shadowed", "parse_error")
MAX_DEPTH = 4


def node(file: str = "file_id", slot: str = "slot") -> Column:
    """A definition's identity as one number."""
    return F.shiftleft(F.col(file).cast("long"), 32).bitwiseOR(F.col(slot).cast("long"))


@dataclass
class Answer:
    """``status`` is complete, or partial if something may be missing."""

    status: str
    subjects: DataFrame
    sites: DataFrame
    unknown: DataFrame
    outside: DataFrame | None
    unread: DataFrame


class Facts:
    def __init__(self, files: DataFrame, defs: DataFrame, refs: DataFrame, imports: DataFrame, tokens: DataFrame | None = None):
        self.files, self.defs, self.refs, self.imports, self.tokens = files, defs, refs, imports, tokens

    def defined_at(self, name: str, path: str | None = None) -> DataFrame:
        """By simple name, or exactly if it is qualified; modules aren't subjects."""
        by = F.col("qname") if "." in name else F.col("name")
        found = self.defs.filter((by == name) & (F.col("kind") != "module")).join(self.files.select("file_id", "path"), "file_id")
        return (found.filter(F.col("path") == path) if path else found).orderBy("path", "line")

    def edges(self) -> DataFrame:
        """(src, dst, kind, file_id, start): resolved references between definitions."""
        known = self.refs.filter("target_slot is not null and from_slot is not null")
        return known.select(node("file_id", "from_slot").alias("src"), node("target_file", "target_slot").alias("dst"), "kind", "file_id", "start", "line")

    def _walk(self, subjects: DataFrame, depth: int, incoming: bool) -> DataFrame:
        """(node, site columns, depth): every edge out of what was first reached one step before."""
        if not 1 <= depth <= MAX_DEPTH:
            raise DepthOutOfRange(str(depth))
        here, there = ("dst", "src") if incoming else ("src", "dst")
        calls = self.edges().filter(F.col("kind").isin(*INVOKING))
        seen = subjects.select(node().alias("n")).distinct()
        frontier, found = seen, []
        for level in range(1, depth + 1):
            step = calls.join(frontier, calls[here] == frontier["n"], "left_semi").withColumn("depth", F.lit(level))
            found.append(step)
            if level < depth:
                frontier = checkpointed(step.select(F.col(there).alias("n")).distinct().join(seen, "n", "left_anti"))
                seen = seen.union(frontier)
        return reduce(DataFrame.unionAll, found).withColumnRenamed(there, "n")

    def _subjects(self, name: str, path: str | None) -> DataFrame:
        found = self.defined_at(name, path)
        if found.isEmpty():
            raise SubjectNotFound(name)
        return found

    def _sites(self, walked: DataFrame) -> DataFrame:
        d = self.defs.select(node().alias("n"), "qname")
        return walked.join(d, "n", "left").join(self.files.select("file_id", "path"), "file_id").select("depth", "path", "start", "kind", "qname", "line").orderBy("depth", "path", "start", "kind")

    def callers(self, name: str, path: str | None = None, depth: int = 1) -> Answer:
        if not 1 <= depth <= MAX_DEPTH:
            raise DepthOutOfRange(str(depth))
        subjects = self._subjects(name, path)
        return self._finish(name, subjects, self._sites(self._walk(subjects, depth, True)), None)

    def callees(self, name: str, path: str | None = None, depth: int = 1) -> Answer:
        if not 1 <= depth <= MAX_DEPTH:
            raise DepthOutOfRange(str(depth))
        subjects = self._subjects(name, path)
        own = self.refs.filter("target_slot is null").join(subjects.select("file_id", F.col("slot").alias("from_slot")), ["file_id", "from_slot"], "left_semi")
        leaves = F.col("reason").isin(*OUTSIDE)
        return self._finish(name, subjects, self._sites(self._walk(subjects, depth, False)), own.filter(leaves), own.filter(~leaves & F.col("kind").isin(*INVOKING)))

    def references(self, name: str, path: str | None = None) -> Answer:
        subjects = self._subjects(name, path)
        keys = subjects.select(F.col("file_id").alias("target_file"), F.col("slot").alias("target_slot"))
        hits = self.refs.join(keys, ["target_file", "target_slot"], "left_semi").join(self.files.select("file_id", "path"), "file_id")
        return self._finish(name, subjects, hits.select(F.lit(1).alias("depth"), "path", "start", "kind", "name", "line").orderBy("path", "start"), None)

    def importers(self, subjects: DataFrame) -> DataFrame:
        """(file_id): files that reach a subject's file over imports, those files themselves too."""
        return closure(self.imports.select(F.col("target_file").alias("src"), F.col("file_id").alias("dst")), subjects.select(F.col("file_id").alias("n")).distinct()).withColumnRenamed("n", "file_id")

    def _finish(self, name, subjects, sites, outside, unknown=None) -> Answer:
        simple = name.rsplit(".", 1)[-1]
        unread = self.files.filter("status <> 'parsed'")
        if self.tokens is not None:
            unread = unread.join(self.tokens.filter(F.col("token") == simple), "file_id", "left_semi")
        if unknown is None:
            same = self.refs.filter((F.col("name") == simple) & F.col("target_slot").isNull() & F.col("reason").isin(*BINDABLE)).withColumn("why", F.lit("same_name"))
            dynamic = self.refs.filter("is_dynamic").join(self.importers(subjects), "file_id", "left_semi").withColumn("why", F.lit("dynamic_key"))
            unknown = same.unionByName(dynamic)
        unknown = unknown.join(unread.select("file_id"), "file_id", "left_anti")
        status = "complete" if unknown.isEmpty() and unread.isEmpty() else "partial"
        return Answer(status, subjects, sites, unknown, outside, unread)

    def stats(self) -> DataFrame:
        resolved = F.col("target_slot").isNotNull()
        return self.refs.agg(F.count("*").alias("refs"), F.count_if(resolved).alias("resolved"), F.count_if(~resolved & F.col("reason").isin(*OUTSIDE)).alias("outside"), F.count_if(~resolved & ~F.col("reason").isin(*OUTSIDE)).alias("unresolved"))

    def test_reach(self, subjects: DataFrame, is_test: Column, limit: int = 8) -> DataFrame:
        """(n, state): tested if some caller's caller is in a test file; unknown if ``limit`` steps didn't tell."""
        edges = self.edges().filter(F.col("kind").isin(*INVOKING)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = subjects.select(node().alias("n"))
        tests = self.defs.join(self.files.filter(is_test), "file_id", "left_semi").select(node().alias("n"))
        reached, rest = closure_pairs(edges, start, limit)
        hit = reached.join(tests, "n", "left_semi").select(F.col("start").alias("n")).distinct().withColumn("tested", F.lit(True))
        open_ = rest.select(F.col("start").alias("n")).distinct().withColumn("open", F.lit(True))
        state = F.when(F.col("tested"), "tested").when(F.col("open"), "unknown").otherwise("untested")
        return start.join(hit, "n", "left").join(open_, "n", "left").select("n", state.alias("state"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(n): what (src, dst) edges reach from ``start`` (n), with the start."""
    seen = frontier = checkpointed(start.select("n").distinct())
    while not frontier.isEmpty():
        frontier = checkpointed(edges.join(frontier, edges["src"] == frontier["n"], "left_semi").select(F.col("dst").alias("n")).distinct().join(seen, "n", "left_anti"))
        seen = seen.union(frontier)
    return seen


def closure_pairs(edges: DataFrame, start: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(start, n): what each start reaches in so many rounds, itself too; and those of the last round, from which
    nobody has gone on."""
    seen = frontier = checkpointed(start.select(F.col("n").alias("start"), "n").distinct())
    for _ in range(rounds):
        frontier = checkpointed(frontier.join(edges, frontier["n"] == edges["src"]).select("start", F.col("dst").alias("n")).distinct().join(seen, ["start", "n"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen, frontier


def depths(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(n, depth): least number of edges from the start, up to ``rounds``."""
    seen = checkpointed(start.select("n").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, rounds + 1):
        step = edges.join(frontier, edges["src"] == frontier["n"], "left_semi").select(F.col("dst").alias("n")).distinct()
        frontier = checkpointed(step.join(seen, "n", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def delta(before: DataFrame, after: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Symbols added, removed or changed between two snapshots."""
    b, a = before.select(*keys, F.col(digest).alias("__b")), after.select(*keys, F.col(digest).alias("__a"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return b.join(a, keys, "full").select(*keys, change.alias("change")).filter("change is not null")


def routes(mounts: DataFrame, handlers: DataFrame) -> DataFrame:
    """(handler, route): prefixes composed along mounts (parent, child, prefix) from the root '' on.

    A router that is mounted below itself is left out there: its routes would have no end.
    """
    above = F.array().cast("array<string>")
    reached = frontier = mounts.filter("parent = ''").select(F.col("child").alias("router"), F.col("prefix").alias("at"), F.array_append(above, F.col("child").cast("string")).alias("above"))
    while True:
        below = frontier.join(mounts, frontier["router"] == mounts["parent"]).filter(~F.array_contains("above", F.col("child").cast("string")))
        frontier = checkpointed(below.select(F.col("child").alias("router"), F.concat("at", "prefix").alias("at"), F.array_append("above", F.col("child").cast("string")).alias("above")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return handlers.join(reached, "router").select("handler", F.concat("at", "path").alias("route"))


def alpha_hash(names: Column) -> Column:
    """A hash of a sequence of names that doesn't change when they are renamed one to one."""
    return F.sha2(F.array_join(F.transform(names, lambda x: F.array_position(names, x).cast("string")), ","), 256)


def users_ranking(edges: DataFrame, seeds: DataFrame, per_seed: int = 4) -> DataFrame:
    """(dst, src, uses): who uses each seed most."""
    from korrel.operators.ranking import top_per_group

    uses = edges.join(seeds.select(F.col("n").alias("dst")), "dst", "left_semi").groupBy("dst", "src").agg(F.count("*").alias("uses"))
    return top_per_group(uses, "dst", "uses", "src", per_seed).drop("place")
