"""Usage reports from event logs, ledgers, receipts and hash chains."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.operators.prefix import latest, running
from korrel.plans.errors import SubjectNotFound

SLACK_MS = 5_000
CACHE_WRITE, CACHE_WRITE_HOUR = 1.25, 2.0
MESSAGE = "type string, timestamp string, message struct<id:string,model:string,content:array<struct<type:string,id:string,name:string>>,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,cache_creation:struct<ephemeral_1h_input_tokens:bigint>>>"


def append_lines(df: DataFrame, folder: str) -> None:
    """Append rows to a folder of NDJSON files; nulls are left out of their lines."""
    df.write.mode("append").json(folder)


def read_lines(lines: DataFrame, column: str = "value", schema: str = MESSAGE) -> DataFrame:
    """NDJSON rows; blank and malformed lines are skipped. Other columns stay."""
    kept = [c for c in lines.columns if c != column]
    parsed = lines.select(*kept, F.from_json(column, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r is not null and r._bad is null").select(*kept, "r.*").drop("_bad")


def milliseconds(c: Column) -> Column:
    """Epoch milliseconds of an ISO timestamp; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(c))


def usage(m: str = "message") -> dict[str, Column]:
    """A message's tokens; cache writes are split by how long they are kept."""
    u = F.col(f"{m}.usage")
    n = lambda c: F.coalesce(c, F.lit(0))
    written = n(u["cache_creation_input_tokens"])
    hour = F.least(written, n(u["cache_creation"]["ephemeral_1h_input_tokens"]))
    return {"input": n(u["input_tokens"]), "output": n(u["output_tokens"]), "cache_read": n(u["cache_read_input_tokens"]), "write_5m": written - hour, "write_1h": hour}


def last_wins(rows: DataFrame, session: str, key: Column, position: str, first: list[str], last: list[str]) -> DataFrame:
    """One row for each key of a session: ``last`` from the latest row, ``first`` from the earliest; null keys are all kept."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.col(position).cast("string")))
    keyed = rows.withColumn("__key", own)
    return keyed.groupBy(session, "__key").agg(*(F.max_by(c, position).alias(c) for c in last), *(F.min_by(c, position).alias(c) for c in first)).drop("__key")


def tool_name(c: Column) -> Column:
    return F.regexp_replace(c, "^mcp__[^_]+(?:_[^_]+)*__", "")


def price_of(rows: DataFrame, model: str, prices: DataFrame) -> DataFrame:
    """Rows with the first price in table order whose prefix the model has, ended by nothing or one of - @ : [ ."""
    rest = F.substring(F.col(model), F.length("prefix") + 1, F.lit(1))
    fits = F.startswith(F.col(model), F.col("prefix")) & rest.isin("", "-", "@", ":", "[")
    models = rows.select(model).distinct()
    heads = models.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length(model)), lambda k: F.substring(F.col(model), F.lit(1), k))))
    found = heads.join(prices, "prefix").filter(fits).groupBy(model).agg(F.min_by(F.struct("input_price", "output_price", "cache_price"), "place").alias("price"))
    return rows.join(found, model, "left")


def cost() -> Column:
    """Dollars from tokens and prices a million."""
    p = F.col("price")
    paid_in = F.col("input") + CACHE_WRITE * F.col("write_5m") + CACHE_WRITE_HOUR * F.col("write_1h")
    return (paid_in * p["input_price"] + F.col("output") * p["output_price"] + F.col("cache_read") * p["cache_price"]) / 1e6


def pick_session(sessions: DataFrame, name: str, last: str, wanted: str | None = None) -> str:
    """The session of that name, else the only one whose name begins so; without a wish the one that was last active."""
    if wanted is None:
        found = sessions.orderBy(F.desc(last), F.desc(name)).select(F.col(name).cast("string")).first()
        if found is None:
            raise SubjectNotFound("no session")
        return found[0]
    rows = sessions.select(F.col(name).cast("string").alias("s")).filter(F.col("s").startswith(wanted)).distinct()
    found = [r["s"] for r in rows.orderBy(F.col("s") != wanted, "s").limit(2).collect()]
    if not found or len(found) > 1 and found[0] != wanted:
        raise SubjectNotFound(f"{wanted}: {'several sessions begin so' if found else 'no session'}")
    return found[0]


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of its key that isn't later; nulls where there is none.

    Null keys and times match nothing. Both sides are put in one order of key and time, dealt into ranges, and each
    left row takes the right row before it; so a key may hold any share of the rows. Of several right rows at one
    time any one is taken.
    """
    rest = [c for c in right.columns if c not in key]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    r = right.filter(known & F.col(right_time).isNotNull()).select(*key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*rest).alias("__r"))
    own, whole = F.struct(*left.columns).alias("__l"), known & F.col(left_time).isNotNull()
    l = left.filter(whole).select(*key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), own)  # noqa: E741
    both = latest(r.unionByName(l, allowMissingColumns=True), key, ["__t", "__side"], F.col("__r"), "__before")
    alone = left.filter(~F.coalesce(whole, F.lit(False))).select(own, F.lit(None).cast(r.schema["__r"].dataType).alias("__before"))
    return both.filter("__side = 1").select("__l", "__before").unionByName(alone).select("__l.*", "__before.*")


def interval_join(events: DataFrame, ts: str, windows: DataFrame, start: str, end: str, key: list[str], slack: Column) -> DataFrame:
    """Events inside [start, end + slack] of a window with the same key.

    Both sides meet in time buckets as wide as the longest window, so the join is one of equals.
    """
    width = windows.agg(F.max(F.unix_micros(F.col(end).cast("timestamp") + slack) - F.unix_micros(F.col(start).cast("timestamp")))).first()[0]
    width = max(1, width or 1)
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / width)
    w = windows.withColumn("__b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) + slack))))
    e = events.withColumn("__b", bucket(F.col(ts)))
    return e.join(w, [*key, "__b"]).filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end) + slack)).drop("__b")


def tally(groups: dict[str, Column]) -> list[Column]:
    return [F.count_if(test).alias(name) for name, test in groups.items()]


def fold_ledger(rows: DataFrame, key: str = "id", position: str = "pos", supersedes: str = "supersedes") -> tuple[DataFrame, DataFrame]:
    """(current, conflicts): the latest row of each id that no latest row supersedes; ids with several successors."""
    columns = [c for c in rows.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("r")).select(key, "r.*")
    gone = latest.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key))
    conflicts = gone.groupBy(key).agg(F.count("*").alias("successors")).filter("successors > 1")
    return latest.join(gone.distinct(), key, "left_anti"), conflicts


def replay(receipts: DataFrame, path: str, order: str, before: str, after: str) -> DataFrame:
    """Receipts with a verdict: a path's digest before is the one after of the receipt before it."""
    w = Window.partitionBy(path).orderBy(order)
    previous = F.lag(after).over(w)
    verdict = F.when(previous.isNull() | (previous == F.col(before)), "verified").otherwise("mismatch")
    return receipts.withColumn("verdict", verdict)


VERDICTS = ["verified", "merged", "unverified", "mismatch"]


def worst(c: Column) -> Column:
    """The worst of a group's verdicts."""
    order = F.array(*map(F.lit, VERDICTS))
    return F.element_at(order, F.max(F.array_position(order, c)).cast("int"))


def uncovered(changed: DataFrame, receipts: DataFrame, path: str) -> DataFrame:
    return changed.join(receipts.select(path), path, "left_anti").withColumn("verdict", F.lit("unverified"))


def _chained(batches):
    """Heads of groups whose rows come one after the other: (group as text, its number, text of the row)."""
    mark, head, name = None, "", None
    for batch in batches:
        done = []
        for group, number, text in zip(*(c.to_pylist() for c in batch.columns)):
            if mark != number:
                if mark is not None:
                    done.append((name, head))
                mark, head, name = number, "", group
            head = hashlib.sha256(f"{head}\x1e{text}".encode()).hexdigest()
        if done:
            yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*done)], names=["g", "head"])
    if mark is not None:
        yield pa.record_batch([pa.array([name], pa.string()), pa.array([head], pa.string())], names=["g", "head"])


def hash_chain(df: DataFrame, group: str, order: str, parts: list[str]) -> DataFrame:
    """(group, head): SHA-256 folded over a group's rows in order; the chain of nothing is empty.

    A chain is one pass, in which nothing but its head is held. Rows of equal order go by their text.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), text.alias("t")).repartition("g").sortWithinPartitions("g", "o", "t")
    number = rows.select(F.col("g").cast("string").alias("g"), F.xxhash64("g", F.col("g").isNull()).alias("n"), "t")
    found = number.mapInArrow(_chained, "g string, head string")
    return found.select(F.col("g").cast(df.schema[group].dataType).alias(group), "head")


def sweep(entries: DataFrame, used: str, size: str, cap: int, oldest: Column | None = None) -> DataFrame:
    """What a cache drops: all last used before ``oldest``, and of the rest what lies beyond ``cap`` bytes, the longest
    unused first. Entries used at one moment go by their other columns."""
    late = F.lit(False) if oldest is None else F.coalesce(F.col(used) < oldest, F.lit(True))
    others = [c for c in entries.columns if c != used]
    kept = running(entries.filter(~late), [], [F.desc(used), *others], F.col(size), "__before", "__all")
    return kept.filter(F.col("__before") + F.col(size) > cap).select(*entries.columns).unionByName(entries.filter(late))
