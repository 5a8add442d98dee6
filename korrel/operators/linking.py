"""Names resolved to definitions: scoped lookup, re-export chains, star exports; and again after a change.

Relations (other columns are kept or ignored):

files(file_id, status)             ``parsed``, or not read
decls(file_id, name, scope_start, scope_end, slot | spec, imported)
                                   what a scope declares: a definition (slot), or a name imported (``*``: the module)
specs(file_id, spec, outcome, target_file)
                                   what an import's text stands for: file, external, not_found, unindexed
exports(file_id, idx, name, kind, slot | spec, imported)
                                   kind local, binding (exported again under ``name``) or star (all of a module's)
refs(file_id, idx, name, start, receiver)
                                   a use of ``name``; with a receiver, of a member of what that name stands for
members(file_id, slot, name, parent)
                                   definitions inside others

A re-exported name is a pointer to another file's export. All such pointers are followed at once by pointer
jumping, so a chain of n takes log n joins. Star exports are searched in their order, level by level, for what
imports and members ask alone. A chain that comes to a file for the second time, or is longer than ``CHAIN`` files, is a cycle.
Nothing is collected on the driver but how many rows a round left open, and, where these are ``FEW``, their keys.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.session import written

CHAIN = 64
#: Rows that are sent to a table instead of dealing it anew.
FEW = 100_000
#: Declarations of one name in one file that are held as a list.
LIST = 256
WHOLE_MODULE, DEFAULT = "*", "default"
#: A module as the target of a reference has no slot of its own.
MODULE_SLOT = -1
#: What becomes of an import whose text stands for no file.
MISSES = {"external": "external_module", "not_found": "module_not_found", "unindexed": "unindexed_module", "namespace": "global"}


@dataclass
class Relations:
    files: DataFrame
    decls: DataFrame
    specs: DataFrame
    exports: DataFrame
    refs: DataFrame
    members: DataFrame | None = None


@dataclass
class Linked:
    """``links``: (file_id, idx, target_file, target_slot, reason), one for each reference; ``deps``: (file_id, on_file),
    the files that were looked into for some reference of a file, made when first read; ``jumps``: where each explicit
    export leads. ``looked`` is what the deps are made of."""

    links: DataFrame
    looked: DataFrame
    jumps: DataFrame

    @cached_property
    def deps(self) -> DataFrame:
        return written(self.looked)


def _miss(outcome: Column) -> Column:
    return reduce(lambda made, x: made.when(outcome == x[0], x[1]), list(MISSES.items())[1:], F.when(outcome == "external", MISSES["external"])).otherwise("module_not_found")


def _explicit(r: Relations) -> DataFrame:
    """(file_id, name, state, end_file, end_name, slot, path): the first export of each name in a file.

    state is def, next (look for end_name in end_file), module (end_file), open (no such export there) or a reason.
    """
    own = r.exports.filter("kind <> 'star'").groupBy("file_id", "name").agg(F.min_by(F.struct("kind", "slot", "spec", "imported"), "idx").alias("e"))
    own = own.join(r.files.filter("status = 'parsed'").select("file_id"), "file_id", "left_semi")
    rows = own.select("file_id", "name", "e.*").join(r.specs.select("file_id", "spec", "outcome", "target_file"), ["file_id", "spec"], "left")
    there = F.col("outcome") == "file"
    state = F.when(F.col("kind") == "local", "def").when(there & (F.col("imported") == WHOLE_MODULE), "module").when(there, "next").otherwise(_miss(F.col("outcome")))
    return rows.select("file_id", "name", state.alias("state"), F.when(F.col("kind") == "binding", F.col("target_file")).alias("end_file"), F.when(F.col("kind") == "binding", F.col("imported")).alias("end_name"), F.when(F.col("kind") == "local", F.col("slot")).alias("slot"), F.array("file_id").alias("path"))


def _to_repeat(path: Column) -> Column:
    """``path`` up to the first file that it has had before, and no longer than ``CHAIN``: nothing behind was looked into."""
    again = F.array_position(F.transform(path, lambda x, k: F.array_position(path, x) == k + 1), False)
    return F.slice(path, F.lit(1), F.least(F.when(again > 0, again - 1).otherwise(F.size(path)), F.lit(CHAIN)).cast("int"))


_JUMP = ["file_id", "name", "state", "end_file", "end_name", "slot", "path"]


def _asked_of(table: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """The rows of ``table`` that ``n`` rows of ``keys`` can meet: few keys are sent to it, so that it isn't dealt anew."""
    return table if n > FEW else table.join(F.broadcast(keys.select(*on).distinct()), on, "left_semi")


def _jumped(rows: DataFrame, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rows`` of ``_explicit`` with every ``next`` followed to its end; ``known`` are followed already."""
    parsed = files.select(F.col("file_id").alias("__to"), (F.col("status") == "parsed").alias("read"))
    # a pointer into a file that wasn't read ends there; what points nowhere is spread by its own file
    open_ = rows.join(parsed, F.coalesce("end_file", "file_id") == F.col("__to"), "left")
    unread = (F.col("state") == "next") & ~F.coalesce("read", F.lit(False))
    rows = written(open_.withColumn("path", F.when(unread, F.array_append("path", F.col("end_file"))).otherwise(F.col("path"))).withColumn("state", F.when(unread, "unindexed_module").otherwise(F.col("state"))).select(*_JUMP))
    done, going = rows.filter("state <> 'next'"), rows.filter("state = 'next'")
    while n := going.count():  # what has come to its end isn't moved again
        all_ = done.unionByName(going)
        all_ = all_ if known is None else all_.unionByName(known)
        p = all_.select(F.col("file_id").alias("end_file"), F.col("name").alias("end_name"), F.struct("state", "end_file", "end_name", "slot", "path").alias("p"))
        waiting = going.join(_asked_of(p, going, ["end_file", "end_name"], n), ["end_file", "end_name"], "left")
        there = F.col("p").isNotNull()
        path = F.when(there, F.concat("path", "p.path")).otherwise(F.array_append("path", F.col("end_file")))
        round_ = (F.size(F.array_distinct(path)) < F.size(path)) | (F.size(path) > CHAIN)
        state = F.when(round_, "reexport_cycle").when(there, F.col("p.state")).otherwise("open")
        moved = written(waiting.select(
            "file_id", "name", state.alias("state"), F.when(there, F.col("p.end_file")).otherwise(F.col("end_file")).alias("end_file"),
            F.when(there, F.col("p.end_name")).otherwise(F.col("end_name")).alias("end_name"), F.col("p.slot").alias("slot"), _to_repeat(path).alias("path"),
        ))
        done, going = done.unionByName(moved.filter("state <> 'next'")), moved.filter("state = 'next'")
    return done


_ASK = ["ask_file", "ask_name"]
_LINK = ["file_id", "idx", "target_file", "target_slot", "reason"]


def _behind(r: Relations) -> DataFrame:
    """(from, by_star, star, outcome, to): what a search finds behind a file that was read: itself, and each of its stars."""
    parsed = r.files.filter("status = 'parsed'").select("file_id")
    stars = r.exports.filter("kind = 'star'").join(parsed, "file_id", "left_semi").join(r.specs.select("file_id", "spec", "outcome", "target_file"), ["file_id", "spec"], "left")
    return written(
        stars.select(F.col("file_id").alias("from"), F.lit(True).alias("by_star"), F.col("idx").alias("star"), "outcome", F.col("target_file").alias("to")).unionByName(
            parsed.select(F.col("file_id").alias("from"), F.lit(False).alias("by_star")), allowMissingColumns=True
        )
    )


def _searched(asks: DataFrame, behind: DataFrame, jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each (ask_file, ask_name) is: (.., reason, target_file, target_slot); and (.., on_file), what was looked into.

    The first success in the order of the star exports, else the first failure that says more than that nothing
    was found. Each level is kept once: what ends there, and what goes on to the files behind the stars (``go``).
    """
    jump = jumps.select(F.col("file_id").alias("file"), F.col("name").alias("wanted"), F.struct("state", "end_file", "end_name", "slot", "path").alias("j"))
    front = written(asks.select(*_ASK, F.array().cast("array<long>").alias("place"), F.col("ask_file").alias("file"), F.col("ask_name").alias("wanted"), F.array().cast("array<long>").alias("path")))
    levels = []
    while (n := front.count()) or not levels:
        met = front.join(_asked_of(jump, front, ["file", "wanted"], n), ["file", "wanted"], "left")
        seen = F.array_contains("path", F.col("file")) | (F.size("path") >= CHAIN)
        through = F.col("j").isNotNull()
        path = F.when(seen, F.col("path")).when(through, F.concat("path", "j.path")).otherwise(F.array_append("path", F.col("file")))
        round_ = seen | (through & (F.size(F.array_distinct(path)) < F.size(path))) | (F.size(path) > CHAIN)
        state = F.when(round_, "reexport_cycle").when(through, F.col("j.state")).otherwise("open")
        step = met.select(
            *_ASK, "place", state.alias("state"), F.when(through & (F.col("j.state") != "def"), F.col("j.end_file")).otherwise(F.col("file")).alias("at"),
            F.coalesce("j.end_name", "wanted").alias("wanted"), F.col("j.slot").cast("long").alias("slot"), _to_repeat(path).alias("path"),
        )
        # a definition lies in the file where its chain ended
        step = step.withColumn("at", F.when(F.col("state") == "def", F.element_at("path", -1)).otherwise(F.col("at")))
        open_, by_star = F.col("state") == "open", F.coalesce("by_star", F.lit(False))
        step = step.join(behind, (F.col("at") == F.col("from")) & open_ & (~F.col("by_star") | (F.col("wanted") != DEFAULT)), "left")
        # a star of nothing but a namespace leaves the search where it was
        star = F.when(F.col("outcome") == "file", "go").when(F.col("outcome") == "namespace", "export_not_found").otherwise(_miss(F.col("outcome")))
        state = F.when(~open_, F.col("state")).when(F.col("from").isNull(), "unindexed_module").when(by_star, star).otherwise("export_not_found")
        place = F.when(by_star, F.array_append("place", F.col("star").cast("long"))).otherwise(F.col("place"))
        levels.append(written(step.select(*_ASK, place.alias("place"), state.alias("state"), "at", "wanted", "slot", "path", "to")))
        front = levels[-1].filter("state = 'go'").select(*_ASK, "place", F.col("to").alias("file"), "wanted", "path")
    told = reduce(DataFrame.unionByName, [x.filter("state <> 'go'") for x in levels])
    rank = F.when(F.col("state").isin("def", "module"), 0).when(F.col("state") != "export_not_found", 1).otherwise(2)
    best = told.groupBy(*_ASK).agg(F.min_by(F.struct("state", "at", "slot"), F.struct(rank, "place")).alias("b"))
    slot = F.when(F.col("b.state") == "module", F.lit(MODULE_SLOT)).otherwise(F.col("b.slot"))
    won = F.col("b.state").isin("def", "module")
    found = best.select(*_ASK, F.when(~won, F.col("b.state")).alias("reason"), F.when(won, F.col("b.at")).alias("target_file"), F.when(won, slot).alias("target_slot"))
    on = F.explode(F.when(F.col("state") == "module", F.array_append("path", F.col("at"))).otherwise(F.col("path")))
    return found, told.select(*_ASK, on.alias("on_file")).distinct()


def scoped(refs: DataFrame, decls: DataFrame, name: str, *kept: str) -> DataFrame:
    """``refs`` with the declaration ``d`` (slot, spec, imported and ``kept``) of the innermost scope over each that
    declares ``name``; of two in one scope the smaller slot, then the smaller import. None where no scope does.

    A file's declarations of a name are a list that its references look through; of names with over ``LIST`` each
    reference meets its declarations as rows.
    """
    order = [(-F.col("scope_start")).alias("back"), F.col("scope_end").alias("end"), F.col("slot").isNull().alias("imports"), F.col("slot"), F.col("spec"), F.col("imported")]
    of = [F.col("file_id").alias("__file"), F.col("name").alias("__name")]
    same = (F.col("file_id") == F.col("__file")) & (F.col(name) == F.col("__name"))
    many = written(decls.groupBy(*of).count().filter(F.col("count") > LIST).drop("count"))
    rows = None
    if not many.isEmpty():
        d = decls.select(*of, "scope_start", "scope_end", F.struct(*order, *kept).alias("d")).join(many, ["__file", "__name"], "left_semi")
        crowded = refs.join(many, same, "left_semi")
        over = crowded.join(d, same & (F.col("scope_start") <= F.col("start")) & (F.col("start") < F.col("scope_end")))
        rows = crowded.join(over.groupBy("file_id", "idx").agg(F.min("d").alias("d")), ["file_id", "idx"], "left")
        refs, decls = refs.join(many, same, "left_anti"), decls.select("*", *of).join(many, ["__file", "__name"], "left_anti").drop("__file", "__name")
    lists = decls.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct(*order, *kept))).alias("__d"))
    inner = F.filter("__d", lambda x: (-x["back"] <= F.col("start")) & (F.col("start") < x["end"]))
    listed = refs.join(lists, same, "left").withColumn("d", F.get(inner, F.lit(0))).drop("__file", "__name", "__d")
    return listed if rows is None else listed.unionByName(rows)


def _stands_for(r: Relations, behind: DataFrame, jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``decls`` with what each stands for (target_file, target_slot, reason) and the export it asks for, if any; and
    what was looked into for those."""
    whole = F.coalesce(F.col("imported") == WHOLE_MODULE, F.lit(True))
    by = F.when(F.col("slot").isNotNull(), "own").when(F.col("spec").isNull(), "nothing").when(F.coalesce(F.col("outcome") == "file", F.lit(False)), F.when(whole, "module").otherwise("export")).otherwise("miss")
    decls = r.decls.join(r.specs.select("file_id", "spec", "outcome", F.col("target_file").alias("ask_file")), ["file_id", "spec"], "left").withColumn("by", by)
    decls = written(decls.select("file_id", "name", "scope_start", "scope_end", "slot", "spec", "imported", "by", F.when(F.col("by").isin("module", "export"), F.col("ask_file")).alias("ask_file"), F.when(F.col("by") == "export", F.col("imported")).alias("ask_name"), F.when(F.col("by") == "miss", _miss(F.col("outcome"))).when(F.col("by") == "nothing", "global").alias("reason")))
    exports = decls.filter("by = 'export'")
    found, looked = _searched(exports.select(*_ASK).distinct(), behind, jumps)
    at_once = decls.filter("by <> 'export'").withColumns({
        "target_file": F.when(F.col("by") == "own", F.col("file_id")).when(F.col("by") == "module", F.col("ask_file")),
        "target_slot": F.when(F.col("by") == "own", F.col("slot")).when(F.col("by") == "module", F.lit(MODULE_SLOT).cast("long")),
    })
    return exports.drop("reason").join(found, _ASK, "left").unionByName(at_once), looked


def _links(refs: DataFrame, r: Relations, jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, deps) of ``refs``. Declarations are resolved before references meet them, as those are many more; each
    reference is read and kept once. The deps are not made before somebody reads them."""
    behind = _behind(r)
    decls, looked = _stands_for(r, behind, jumps)
    told = ["target_file", "target_slot", "reason", *_ASK]
    named = scoped(refs.withColumn("__looked", F.coalesce("receiver", "name")), decls, "__looked", *told)
    keys = ["file_id", "idx", "name", "receiver"]
    met = named.select(*keys, *(F.when(F.col("d").isNull(), "global").otherwise(F.col("d.reason")).alias(c) if c == "reason" else F.col("d")[c].alias(c) for c in told))
    # whose member is meant: of a module (by itself, or exported under a name), or of a definition
    module = F.col("target_slot") == MODULE_SLOT
    inside = F.when(F.col("receiver").isNotNull() & F.col("target_slot").isNotNull(), F.when(~module, "definition").when(F.col("name").isNotNull(), "module"))
    met = written(met.withColumn("inside", F.coalesce(inside, F.lit("nothing"))))
    own = _in_definitions(met.filter("inside = 'definition'").select(*keys, "target_file", "target_slot"), r.members)
    links = met.filter("inside = 'nothing'").unionByName(own, allowMissingColumns=True).select(*_LINK)
    asked = met.filter("ask_file is not null").select("file_id", *_ASK).distinct()
    deps = asked.select("file_id", F.col("ask_file").alias("on_file")).unionByName(asked.join(looked, _ASK).select("file_id", "on_file"))
    modules = met.filter("inside = 'module'").select("file_id", "idx", F.col("target_file").alias("ask_file"), F.col("name").alias("ask_name"))
    if not modules.isEmpty():
        found, looked = _searched(modules.select(*_ASK).distinct(), behind, jumps)
        links = links.unionByName(modules.join(found, _ASK).select(*_LINK))
        deps = deps.unionByName(modules.select("file_id", *_ASK).distinct().join(looked, _ASK).select("file_id", "on_file"))
    # where a definition was looked into for a member, its file is known to be looked into already
    return links, deps.filter("file_id <> on_file").distinct()


def _in_definitions(owners: DataFrame, members: DataFrame | None) -> DataFrame:
    """References whose receiver is a definition: its member of that name, the one with the smallest slot."""
    keys = ["file_id", "idx", "name", "receiver"]
    missing = F.lit("member_not_found")
    if members is None:
        return owners.select(*keys, F.lit(None).cast("long").alias("target_file"), F.lit(None).cast("long").alias("target_slot"), missing.alias("reason"))
    m = members.groupBy(F.col("file_id").cast("long").alias("target_file"), F.col("parent").cast("long").alias("target_slot"), "name").agg(F.min("slot").cast("long").alias("member"))
    met = owners.join(m, ["target_file", "target_slot", "name"], "left")
    hit = F.col("member").isNotNull()
    return met.select(*keys, F.when(hit, F.col("target_file")).alias("target_file"), F.col("member").alias("target_slot"), F.when(~hit, missing).alias("reason"))


_NUMBERS = {"file_id", "idx", "slot", "spec", "target_file", "parent", "start", "scope_start", "scope_end"}


def _plain(r: Relations) -> Relations:
    """All numbers as long."""
    cast = lambda df: df if df is None else df.withColumns({c: F.col(c).cast("long") for c in df.columns if c in _NUMBERS})
    return Relations(**{k: cast(v) for k, v in vars(r).items()})


def link(r: Relations) -> Linked:
    """All references. Those in files that weren't read are linked as far as rows of them are given."""
    r = _plain(r)
    jumps = _jumped(_explicit(r), r.files)
    return Linked(*_links(r.refs, r, jumps), jumps)


def shape(r: Relations) -> DataFrame:
    """(file_id, shape): a digest of what others can see of a file: its status, exports and members."""
    e = r.exports.join(r.specs.select("file_id", "spec", "outcome", "target_file"), ["file_id", "spec"], "left")
    seen = e.groupBy("file_id").agg(F.sum(F.xxhash64("idx", "name", "kind", "slot", "outcome", "target_file", "imported").cast("decimal(38,0)")).alias("e"))
    made = r.files.join(seen, "file_id", "left")
    if r.members is not None:
        made = made.join(r.members.groupBy("file_id").agg(F.sum(F.xxhash64("slot", "name", "parent").cast("decimal(38,0)")).alias("m")), "file_id", "left")
    return made.select("file_id", F.xxhash64(*(c for c in ("status", "e", "m") if c in made.columns)).alias("shape"))


@dataclass
class Relinked(Linked):
    """``touched``: (file_id), the files whose references were looked up again."""

    touched: DataFrame


def relink(old: Linked, before: Relations, after: Relations, changed: DataFrame) -> Relinked:
    """What ``link(after)`` gives, from ``old`` = ``link(before)``; the relations differ in the files ``changed`` (file_id).

    Only changed files and those that looked into one whose shape changed are linked again; the other rows of the
    three tables are carried over. Of the chains of exports only those through a reshaped file are followed again.
    """
    before, after, changed = _plain(before), _plain(after), changed.select(F.col("file_id").cast("long")).distinct()
    b, a = shape(_of(before, changed)), shape(_of(after, changed))
    reshaped = written(changed.join(b.withColumnRenamed("shape", "b"), "file_id", "left").join(a.withColumnRenamed("shape", "a"), "file_id", "left").filter(~F.col("a").eqNullSafe(F.col("b"))).select("file_id"))
    through = old.jumps.select("file_id", "name", F.explode("path").alias("on")).join(reshaped.select(F.col("file_id").alias("on")), "on", "left_semi").select("file_id", "name").distinct()
    kept = written(old.jumps.join(through, ["file_id", "name"], "left_anti").join(reshaped, "file_id", "left_anti"))
    fresh = _explicit(after).join(kept.select("file_id", "name"), ["file_id", "name"], "left_anti")
    jumps = written(_jumped(fresh, after.files, kept).unionByName(kept))
    dependents = old.deps.join(reshaped.select(F.col("file_id").alias("on_file")), "on_file", "left_semi").select("file_id")
    touched = written(changed.unionByName(dependents).distinct())
    again = replace(after, decls=after.decls.join(touched, "file_id", "left_semi"))
    links, looked = _links(after.refs.join(touched, "file_id", "left_semi"), again, jumps)
    return Relinked(written(old.links.join(touched, "file_id", "left_anti").unionByName(links)), old.deps.join(touched, "file_id", "left_anti").unionByName(looked), jumps, touched)


def _of(r: Relations, files: DataFrame) -> Relations:
    return Relations(**{k: None if v is None else v.join(files, "file_id", "left_semi") for k, v in vars(r).items()})
