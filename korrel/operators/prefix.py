"""Running totals in a global order, without a task that sees all rows of a group.

Rows are dealt into ranges of (group, order). Each range is summed up alone, the sums of a group's ranges
(one row for each range it touches) give every range its base, and a row's total is that base and what lies
before it in its range. So a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.session import checkpointed

_RANGE, _GROUP, _VALUE, _BASE = "__range", "__group", "__value", "__base"


def _dealt(rows: DataFrame, by: list[str], order: list[str | Column], value: Column, keep) -> DataFrame:
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))  # a struct is never null, so it joins
    return keep(rows.withColumns({_VALUE: value, _GROUP: group}).repartitionByRange(_GROUP, *order).withColumn(_RANGE, F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: list[str | Column], value: Column, before: str = "before", total: str = "total", keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` (never null) over the rows of the group that come earlier,
    and ``total``, the group's sum.

    ``order`` has to tell the rows of a group apart, or their order is open and equal ones stand in one range:
    where many may tie, sum them up first. Null keys are a group. ``keep`` cuts the lineage, so that ranges are
    drawn once. An empty table gives no rows.
    """
    dealt = _dealt(rows, by, order, value, keep)
    first = Window.unboundedPreceding
    sums = dealt.groupBy(_RANGE, _GROUP).agg(F.sum(_VALUE).alias(_VALUE))
    ranges = Window.partitionBy(_GROUP).orderBy(_RANGE)
    bases = sums.select(_RANGE, _GROUP, F.coalesce(F.sum(_VALUE).over(ranges.rowsBetween(first, -1)), F.lit(0)).alias(_BASE), F.sum(_VALUE).over(Window.partitionBy(_GROUP)).alias(total))
    inside = Window.partitionBy(_RANGE, _GROUP).orderBy(*order).rowsBetween(first, -1)
    own = dealt.withColumn(before, F.coalesce(F.sum(_VALUE).over(inside), F.lit(0)))
    return own.join(bases, [_RANGE, _GROUP]).withColumn(before, F.col(before) + F.col(_BASE)).drop(_RANGE, _GROUP, _VALUE, _BASE)


def latest(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``rows`` with ``name``: of the group's rows up to this one the last ``value`` that isn't null.

    Each range looks back in itself first; the last value of every range is handed on to those behind it.
    """
    dealt = _dealt(rows, by, order, value, keep)
    first = Window.unboundedPreceding
    ends = dealt.groupBy(_RANGE, _GROUP).agg(F.max_by(_VALUE, F.when(F.col(_VALUE).isNotNull(), F.struct(*order))).alias(_BASE))
    before = Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(first, -1)
    handed = ends.select(_RANGE, _GROUP, F.last(_BASE, ignorenulls=True).over(before).alias(_BASE))
    inside = Window.partitionBy(_RANGE, _GROUP).orderBy(*order).rowsBetween(first, 0)
    own = dealt.withColumn(name, F.last(_VALUE, ignorenulls=True).over(inside)).join(handed, [_RANGE, _GROUP])
    return own.withColumn(name, F.coalesce(name, _BASE)).drop(_RANGE, _GROUP, _VALUE, _BASE)


def _averages(alpha: float):
    """One pass over rows ordered by group: the average as if the group began here (own), what it is without what came
    before (rest), and the share of what came before that is left (fade). A null makes all behind it null."""

    def run(batches):
        part, mark, at = TaskContext.get().partitionId(), None, 0
        own = rest = fade = None
        for batch in batches:
            rows = []
            for key, x in zip(batch.column("__key").to_pylist(), batch.column(_VALUE).to_pylist()):
                if at == 0 or key != mark:
                    mark, own, rest, fade = key, x, None if x is None else alpha * x, 1 - alpha
                else:
                    own = None if own is None or x is None else alpha * x + (1 - alpha) * own
                    rest = None if rest is None or x is None else alpha * x + (1 - alpha) * rest
                    fade *= 1 - alpha
                rows.append((part, at, own, rest, fade))
                at += 1
            some = zip(*rows) if rows else [()] * 5
            columns = [pa.array(v, t) for v, t in zip(some, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, _RANGE, "__at", "__own", "__rest", "__fade"])

    return run


def smoothed(rows: DataFrame, by: list[str], order: list[str | Column], x: Column, alpha: float, name: str, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``rows`` with ``name``: alpha times ``x`` and 1 - alpha times the row before's average; the first row's is its x.

    The step is linear, so a range's rows compose to one step: ranges are averaged alone in one pass each, their steps
    are taken one after the other (one for each range a group touches), and each range gets what came before it.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    made = rows.withColumns({_VALUE: x.cast("double"), _GROUP: group}).withColumn("__key", F.xxhash64(_GROUP, F.to_json(_GROUP)))
    made = made.repartitionByRange(_GROUP, *order).sortWithinPartitions(_GROUP, *order)
    extra = f"`{_RANGE}` int, __at long, __own double, __rest double, __fade double"
    schema = made.limit(0).selectExpr("*", *(f"cast(null as {t.split()[1]}) as {t.split()[0]}" for t in extra.split(", "))).schema
    dealt = keep(made.mapInArrow(_averages(alpha), schema))
    ends = dealt.groupBy(_RANGE, _GROUP).agg(F.max_by(F.struct("__own", "__rest", "__fade"), "__at").alias("end"))
    steps = ends.groupBy(_GROUP).agg(F.array_sort(F.collect_list(F.struct(_RANGE, "end"))).alias("s")).filter(F.size("s") > 1)
    begin = F.struct(F.element_at("s", 1)["end"]["__own"].alias("now"), F.array().cast("array<struct<r:int,c:double>>").alias("told"))
    go = lambda a, e: F.struct((e["end"]["__rest"] + e["end"]["__fade"] * a["now"]).alias("now"), F.array_append(a["told"], F.struct(e[_RANGE].alias("r"), a["now"].alias("c"))).alias("told"))
    carried = steps.select(_GROUP, F.explode(F.aggregate(F.slice("s", 2, F.size("s")), begin, go)["told"]).alias("t")).select(_GROUP, F.col("t.r").alias(_RANGE), F.col("t.c").alias(_BASE), F.lit(True).alias("__later"))
    told = dealt.join(carried, [_RANGE, _GROUP], "left")
    return told.withColumn(name, F.when(F.col("__later"), F.col("__rest") + F.col("__fade") * F.col(_BASE)).otherwise(F.col("__own"))).select(*(F.col(f"`{c}`") for c in rows.columns if c != name), name)
