"""Mergeable quantile summaries from Manku-Rajagopalan-Lindsay buffers.

A summary is a buffer of points (x, weight) in ascending order; the weights add up to the rows it stands for.
Merging puts two or more buffers together; beyond its size a buffer is collapsed: the weighted positions are cut
into runs of one length, and the point in the middle of each run gets the run's weight. Where a run has two
middles, collapses take the left and the right one in turn, so that their errors don't add up one way. A point
that is heavier than a run stands for itself, so a value that many rows share costs one point and no error, and
a buffer keeps as many different values as it may. A collapse moves no rank by more than half a run, and the
sum of these halves is kept with the summary: its tracked error.

Buffers are filled where the rows are read; only buffers are exchanged, and those of one key meet ``FAN`` at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm.common import keep, parts_for, tidied
from korrel.operators.prefix import running

#: Points of a buffer that is still to be merged, of a finished summary, and buffers of a key that meet in a task.
BUFFER, POINTS, FAN = 1000, 500, 256
#: Rows that are summed up at a time, and points that are merged at a time.
CHUNK, RUN = 1 << 20, 1 << 18
#: The rank error allowed, as a share of the rows: one in so many.
PART = 50

SCHEMA = "grp string, batch int, at long, x long, w long"


def collapse(x: np.ndarray, w: np.ndarray, size: int, right: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``size`` points for ascending, distinct ``x`` of weights ``w``; and by how much a rank may be off."""
    if len(x) <= size:
        return x, w, 0
    down = np.sort(w)[::-1]
    above = np.concatenate([[0], np.cumsum(down)])[:size]
    total = int(w.sum())
    lone = int(np.argmax(down[:size] * (size - np.arange(size)) < total - above))  # points heavier than a run
    light = w <= down[lone]
    xs, ends = x[light], np.cumsum(w[light])
    run = -(-int(ends[-1]) // (size - lone))
    starts = np.arange(0, ends[-1], run)
    sizes = np.minimum(run, ends[-1] - starts)
    middle = starts + np.where(right, sizes // 2 + 1, (sizes + 1) // 2)
    x = np.concatenate([x[~light], xs[np.searchsorted(ends, middle)]])
    w = np.concatenate([w[~light], sizes])
    order = np.argsort(x, kind="stable")
    x, w = _summed(x[order], w[order])
    return x, w, run // 2


def _summed(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.add.reduceat(w, first)


def buffers(key: np.ndarray, x: np.ndarray, w: np.ndarray, size: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """A buffer of at most ``size`` points for each key: (keys, x, w) by key and x, and the error of those collapsed."""
    if not len(x):
        return key, x, w, {}
    order = np.lexsort((x, key))
    key, x, w = key[order], x[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (key[1:] != key[:-1])]))
    key, x, w = key[first], x[first], np.add.reduceat(w, first)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    large = np.flatnonzero(np.diff(edges) > size)
    pieces, errors, at = [], {}, 0
    for k in large.tolist():
        low, high = edges[k], edges[k + 1]
        cx, cw, error = collapse(x[low:high], w[low:high], size, (turn + len(errors)) % 2 == 1)
        pieces += [(key[at:low], x[at:low], w[at:low]), (np.full(len(cx), key[low]), cx, cw)]
        errors[int(key[low])], at = error, high
    pieces.append((key[at:], x[at:], w[at:]))
    return *(np.concatenate(p) for p in zip(*pieces)), errors


def _told(grp: pa.Array, batch: np.ndarray, at: np.ndarray, made: tuple, old: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``SCHEMA``: ``grp``, ``batch`` and ``at`` are each key's; errors are rows without an x."""
    key, x, w, errors = made
    lost = np.zeros(len(batch), np.int64) if old is None else old
    for k, error in errors.items():
        lost[k] += error
    off = np.flatnonzero(lost)
    keys = np.concatenate([key, off])
    xs = pa.array(np.concatenate([x, np.zeros(len(off), np.int64)]), mask=np.arange(len(keys)) >= len(key))
    return pa.RecordBatch.from_arrays([grp.take(pa.array(keys)), pa.array(batch[keys], pa.int32()), pa.array(at[keys]), xs, pa.array(np.concatenate([w, lost[off]]))], names=["grp", "batch", "at", "x", "w"])


def _gathered(batches, rows: int):
    """Tables of at least ``rows`` rows, but for the last."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _filled(size: int):
    @tidied
    def run(batches):
        part = TaskContext.get().partitionId()
        for turn, rows in enumerate(_gathered(batches, CHUNK)):
            grps = rows.column("grp").combine_chunks().dictionary_encode()
            batch = _column(rows, "batch").astype(np.int64)
            pairs = grps.indices.to_numpy() * (batch.max() + 1) + batch
            known, key = np.unique(pairs, return_inverse=True)
            grp, of = grps.dictionary.take(pa.array(known // (batch.max() + 1))), known % (batch.max() + 1)
            made = buffers(key, _column(rows, "x"), _column(rows, "c"), size, turn)
            yield _told(grp, of, np.full(len(known), (part << 16) + turn), made)

    return run


def _met(size: int):
    """Over rows of ``SCHEMA`` ordered by grp, batch and at: one buffer for each of these."""

    @tidied
    def run(batches):
        left, turn = None, 0
        for rows in _gathered(batches, RUN):
            rows = pa.concat_tables([left, rows]) if left is not None else rows
            last = _edges(rows)[-2]
            if last:  # the last key may go on
                yield _merge(rows.slice(0, last), size, turn)
                turn += 1
            left = rows.slice(last)
        if left is not None and left.num_rows:
            yield _merge(left, size, turn)

    return run


def _edges(rows: pa.Table) -> np.ndarray:
    grp, batch, at = rows.column("grp").combine_chunks(), _column(rows, "batch"), _column(rows, "at")
    codes = grp.dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (batch[1:] != batch[:-1]) | (at[1:] != at[:-1]), [True]]))


def _merge(rows: pa.Table, size: int, turn: int) -> pa.RecordBatch:
    edges = _edges(rows)
    first, key = edges[:-1], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    x, w = rows.column("x"), _column(rows, "w")
    point = pc.is_valid(x).to_numpy()
    lost = np.zeros(len(first), np.int64)
    np.add.at(lost, key[~point], w[~point])
    made = buffers(key[point], pc.fill_null(x, 0).to_numpy()[point], w[point], size, turn)
    return _told(rows.column("grp").combine_chunks().take(pa.array(first)), _column(rows, "batch")[first], _column(rows, "at")[first], made, lost)


def _meet(points: DataFrame, size: int) -> DataFrame:
    dealt = points.repartition(parts_for(points), "grp", "batch", "at").sortWithinPartitions("grp", "batch", "at")
    return dealt.mapInArrow(_met(size), SCHEMA)


def merge(points: DataFrame, size: int = POINTS, fan: int = FAN) -> DataFrame:
    """One summary of at most ``size`` points for each (grp, batch) of ``points``, whose ``at`` tells buffers apart.

    Where a key has more than ``fan`` buffers they meet in rounds, some ``fan`` / 2 at a time.
    """
    while (most := points.groupBy("grp", "batch").agg(F.count_distinct("at").alias("n")).agg(F.max("n")).first()[0] or 0) > fan:
        heaps = -(-2 * most // fan)
        points = keep(_meet(points.withColumn("at", F.pmod(F.xxhash64("at"), F.lit(heaps))), BUFFER), "quantile-round")
    return keep(_meet(points.withColumn("at", F.lit(0).cast("long")), size), "quantile-summary")


def summaries(rows: DataFrame, size: int = POINTS, fan: int = FAN) -> DataFrame:
    """A summary (rows of ``SCHEMA``) for each (grp, batch) of ``rows``: grp string, batch int from 0 on, x long, c long,
    of which none is null; a row stands for ``c`` rows. An empty table has none."""
    filled = rows.select("grp", "batch", "x", "c").mapInArrow(_filled(BUFFER), SCHEMA)
    return merge(keep(filled, "quantile-buffers"), size, fan)


def whole(batches: DataFrame, size: int = POINTS, fan: int = FAN) -> DataFrame:
    """The summary of all rows of each grp (batch -1), merged from the batches' summaries alone."""
    return merge(batches.withColumns({"at": F.col("batch").cast("long"), "batch": F.lit(-1)}), size, fan)


def _target(i: int | str, of: int) -> Column:
    """ceil(i * n / of)"""
    return F.expr(f"(n * {i} + {of - 1}) div {of}")


def quantiles(points: DataFrame, of: int, least: int = 1) -> DataFrame:
    """(grp, batch, i, n, target, points, answer, bound): for i of 1 .. ``of`` - 1 the least point up to which the weights
    reach ``target`` = ceil(i n / of), and the tracked error. Summaries of fewer than ``least`` rows are left out."""
    key = Window.partitionBy("grp", "batch")  # at most a summary's points
    upto = F.sum(F.when(F.col("x").isNotNull(), F.col("w"))).over(key.orderBy(F.col("x").asc_nulls_first()))
    seen = points.select("grp", "batch", "x", "w", upto.alias("upto"), F.sum(F.when(F.col("x").isNotNull(), F.col("w"))).over(key).alias("n"), F.count("x").over(key).alias("points"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("w"))).over(key), F.lit(0)).alias("bound"))
    each = seen.filter(F.col("x").isNotNull() & (F.col("n") >= least)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(of - 1)))).withColumn("target", _target("i", of))
    return each.filter("upto - w < target and target <= upto").select("grp", "batch", "i", "n", "target", "points", F.col("x").alias("answer"), "bound")


def ranked(rows: DataFrame, answers: DataFrame, of: int, least: int = 1) -> DataFrame:
    """(grp, batch, i, exact_x, n_below, n_upto): each answer (grp, batch, i, answer) held against all rows.

    Rows are counted by x for their batch and for the whole, and the counts run up over ranges of (grp, batch, x).
    An answer stands among them as a row that counts nothing, so what lies below it is what has run up there; the
    exact quantile is the row whose interval of ranks holds the target.
    """
    counted = rows.select("grp", F.explode(F.array("batch", F.lit(-1))).alias("batch"), "x", "c", F.lit(0).cast("long").alias("asks"))
    probes = answers.select("grp", "batch", F.col("answer").alias("x"), F.lit(0).cast("long").alias("c"), F.expr("shiftleft(1L, i)").alias("asks"))
    sums = counted.unionByName(probes).groupBy("grp", "batch", "x").agg(F.sum("c").alias("c"), F.bit_or("asks").alias("asks"))
    up = running(sums, ["grp", "batch"], ["x"], F.col("c"), "below", "n", keep=lambda df: keep(df, "quantile-ranks"))
    holds = lambda target: (F.col("below") < target) & (target <= F.col("below") + F.col("c"))
    wanted = [holds(_target(i, of)) for i in range(1, of)]
    some = up.filter(F.col("n") >= least).filter(reduce(or_, wanted, F.col("asks") != 0)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(of - 1))))
    asked = F.expr("shiftright(asks, i) & 1") == 1
    hit = holds(_target("i", of))
    return some.groupBy("grp", "batch", "i").agg(F.max(F.when(hit, F.col("x"))).alias("exact_x"), F.max(F.when(asked, F.col("below"))).alias("n_below"), F.max(F.when(asked, F.col("below") + F.col("c"))).alias("n_upto"))


def verified(rows: DataFrame, of: int = 4, least: int = 20, size: int = POINTS, fan: int = FAN) -> DataFrame:
    """The quantiles of every (grp, batch) and of every grp as a whole, with their exact ranks and errors."""
    batches = summaries(rows, size, fan)
    answers = keep(quantiles(batches.unionByName(whole(batches, size, fan)), of, least), "quantile-answers")
    told = answers.join(ranked(rows, answers, of, least), ["grp", "batch", "i"])
    error = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return told.withColumn("rank_error", error).withColumn("within", F.col("rank_error") * PART <= F.col("n"))


#: Batches that rows are dealt into.
BATCHES = 4


def _measured(rows: DataFrame, money: Column) -> DataFrame:
    """``x`` of each row: the money in hundredths, rounded half up, and 1000 times its batch. Money that is no finite
    number, or whose hundredths have no 62 bits, counts as lacking; a row without an id is of batch 0."""
    cents = F.floor(F.lit(100) * money.cast("double") + 0.5)
    batch = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % BATCHES, F.lit(0)).cast("int")
    sound = money.isNotNull() & ~F.isnan(money.cast("double")) & (F.abs(money.cast("double")) < float(1 << 55))
    return rows.filter(sound & F.col("grp").isNotNull()).withColumn("batch", batch).withColumn("x", cents + F.lit(1000) * F.col("batch"))


def streams(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """(grp, batch, x, c) of both streams, the stream's name before the grp.

    A click that arrives again counts once, by its earliest arrival (nulls first, then the least client and value);
    clicks without an id count once for each different row. Lines are counted by item and batch before they meet
    their item, so an item that a third of them share is four rows; an item listed again counts by its least row.
    """
    again = F.when(F.col("click_id").isNull(), F.struct("arrived_at", "client_id", "value"))
    first = clicks.groupBy("click_id", again.alias("again")).agg(F.min(F.struct("arrived_at", "client_id", "value")).alias("r"))
    value = first.select(F.concat(F.lit("value:"), F.col("r.client_id").cast("string")).alias("grp"), F.col("click_id").alias("id"), F.col("r.value").alias("money"), F.lit(1).cast("long").alias("c"))
    sold = lines.filter("item_id is not null").groupBy("item_id", F.col("vendor_id").alias("id")).agg(F.count("*").alias("c"))
    listed = items.groupBy("item_id").agg(F.min(F.struct("brand", "price")).alias("r"))
    price = sold.join(listed, "item_id").select(F.concat(F.lit("price:"), F.col("r.brand")).alias("grp"), "id", F.col("r.price").alias("money"), "c")
    made = [_measured(s, F.col("money")).select("grp", "batch", "x", "c") for s in (value, price)]
    return made[0].unionByName(made[1])


def stream_quantiles(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """The quarters of both streams, by (stream, grp, batch, i); see ``streams`` for odd rows. Empty tables have none."""
    told = verified(keep(streams(clicks, lines, items), "quantile-rows"))
    return told.select(F.substring_index("grp", ":", 1).alias("stream"), F.expr("substr(grp, instr(grp, ':') + 1)").alias("grp"), *told.columns[1:])
