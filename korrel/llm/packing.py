"""Mixture-controlled packing: deficit round-robin over source queues fills windows to token proportions.

Each source's documents form one queue of tokens, cut into blocks of ``quantum`` tokens. A round credits
queue q with ``weight_q / largest weight`` of a block; a queue whose credit reaches a block sends one, in the
queues' order, and keeps the rest as its deficit. After r rounds a queue has sent floor(r * w_q / w_max)
blocks, so the state of every queue before any block, and with it the block's place, is arithmetic: each
partition packs its own rows and carries the deficits of all windows and partitions before it, exactly. A
window takes the blocks as they come; what is left of the queues below a block fills the last windows.

Sources with a target have a queue each, and so have the largest others; the rest share queues in the order in
which their rows come, so that each of them is spread over its queue as it is over the table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm.common import keep, parts_for, slices, tidied
from korrel.llm.encode import encoder

LENGTH, QUANTUM = 1024, 128
#: Sources with a queue of their own; the others share SHARED more queues by their name's hash.
QUEUES, SHARED = 1024, 64
#: Numbers in the offsets table up to which it is broadcast (eight bytes each); beyond, parts are joined with it.
BROADCAST_NUMBERS = 1 << 21
SCALE = 1 << 20
SLICE = 1 << 22


def _tokens(tokenizer: str, end_id: int, own: dict[str, int]):
    @tidied
    def run(batches):
        part, sent = TaskContext.get().partitionId(), [0] * (len(own) + SHARED)
        encode = encoder(tokenizer)
        wide = "<u2" if max(len(encode.spaced), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for low, high in _cuts(batch.column(2)):
                ids, first = encode.encode([x or "" for x in batch.column(2)[low:high].to_pylist()])
                sizes, queues, before, blobs = (np.diff(first) + 1).tolist(), [], [], []
                for k, (source, size) in enumerate(zip(batch.column(1)[low:high].to_pylist(), sizes)):
                    queue = own.get(source)
                    queue = len(own) + zlib.crc32(source.encode()) % SHARED if queue is None else queue
                    queues.append(queue)
                    before.append(sent[queue])
                    sent[queue] += size
                    blobs.append(np.append(ids[first[k] : first[k + 1]], end_id).astype(wide).tobytes())
                columns = [pa.array([part] * len(sizes), pa.int64()), batch.column(0)[low:high], batch.column(1)[low:high], *(pa.array(x, pa.int64()) for x in (queues, sizes, before)), pa.array(blobs, pa.binary())]
                yield pa.record_batch(columns, names=["part", "doc_id", "source", "queue", "n", "before", "ids"])

    return run


def _cuts(texts: pa.Array):
    return slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE)


class Schedule:
    """Where each token of each queue goes."""

    def __init__(self, totals: list[int], weights: list[int], quantum: int):
        self.quantum = quantum
        self.full = np.array([t // quantum for t in totals], np.int64)
        self.weights = np.array([max(1, w) for w in weights], np.int64)
        self.most = int(self.weights.max()) if len(weights) else 1
        self.last = -(-self.full * self.most // self.weights)  # the round in which a queue sends its last block
        rest = np.array([t % quantum for t in totals], np.int64)
        self.tail = quantum * int(self.full.sum()) + np.cumsum(rest) - rest

    def sent(self, q: int, rounds: np.ndarray) -> np.ndarray:
        return np.minimum(self.full[q], np.minimum(rounds, self.last[q]) * self.weights[q] // self.most)

    def position(self, queue: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Place of a block's first token among all tokens; a queue's last, short block is in the tail."""
        rounds = -(-(block + 1) * self.most // self.weights[queue])
        rank = np.zeros(len(block), np.int64)
        for q in range(len(self.full)):
            rank += self.sent(q, rounds - (queue <= q))
        return np.where(block < self.full[queue], rank * self.quantum, self.tail[queue])


def cut_pieces(schedule: Schedule, length: int, queue: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """(row, start, length, position) of the pieces of rows that take ``size`` tokens of a queue from ``begin`` on."""
    quantum = schedule.quantum
    first, last = begin // quantum, (begin + size - 1) // quantum
    count = last - first + 1
    row = np.repeat(np.arange(len(begin)), count)
    block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    low = np.maximum(begin[row], block * quantum)
    high = np.minimum((begin + size)[row], (block + 1) * quantum)
    position = schedule.position(queue[row], block) + low - block * quantum
    start = low - begin[row]
    room = length - position % length  # pieces of the tail can cross a window's end
    over = np.flatnonzero(room < high - low)
    row, start, position, span = (np.concatenate([x, y]) for x, y in ((row, row[over]), (start, start[over] + room[over]), (position, position[over] + room[over]), (np.minimum(room, high - low), (high - low - room)[over])))
    order = np.lexsort((start, row))
    row, start, position, span = row[order], start[order], position[order], span[order]
    joins = np.zeros(len(row), bool)
    joins[1:] = (row[1:] == row[:-1]) & (position[1:] == position[:-1] + span[:-1]) & (position[1:] % length != 0)
    keep_at = np.flatnonzero(~joins)
    span = np.add.reduceat(span, keep_at) if len(keep_at) else span
    return row[keep_at], start[keep_at], span, position[keep_at]


def _pack(schedule: Schedule, length: int, with_ids: bool):
    def cut(batch):
        size, begin, queue = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        blobs = batch.column(5).to_pylist()
        row, start, span, position = cut_pieces(schedule, length, queue, begin, size)
        width = [len(x) // n for x, n in zip(blobs, size.tolist())]
        found = [np.frombuffer(blobs[r], f"<u{width[r]}")[a : a + n].astype("<u4").tobytes() for r, a, n in zip(row.tolist(), start.tolist(), span.tolist())]
        at = pa.array(row)
        columns = {
            "doc_id": batch.column(0).take(at), "source": batch.column(1).take(at), "start": pa.array(start), "length": pa.array(span),
            "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64()), "doc_tokens": pa.array(size[row]),
            "sequence_id": pa.array(position // length), "offset": pa.array(position % length),
        }
        if with_ids:
            columns["ids"] = pa.array(found, pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    @tidied
    def run(batches):
        for batch in batches:
            for low, high in slices(pc.binary_length(batch.column(5)).to_pylist(), SLICE):
                yield cut(batch.slice(low, high - low))

    return run


PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, end_id: int = 0, length: int = LENGTH, quantum: int = QUANTUM,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences of ``length`` tokens, of which only the last is not full.

    ``targets`` gives sources' shares of the tokens (default: their own shares, so that all queues end
    together); a source without one has the least weight. When a queue is empty the others go on. A row is
    its ids and ``end_id``; a null text is ``end_id`` alone. A null source is the source ''. Repeated rows
    and null ids are packed like any other row. An empty table has no pieces; other columns are ignored. A text
    of any length is encoded in parts; its ids are one row, four bytes each.
    """
    if length % quantum:
        raise ValueError("the quantum divides the length")
    if len(targets or {}) > QUEUES:
        raise ValueError(f"at most {QUEUES} sources can have a target")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    bytes_of = rows.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    named = sorted(targets or {})
    largest = bytes_of.filter(~F.col("source").isin(named)) if named else bytes_of
    named += [r["source"] for r in largest.orderBy(F.desc("n"), "source").limit(QUEUES - len(named)).collect()]
    own = {source: q for q, source in enumerate(named)}
    tokens = keep(rows.mapInArrow(_tokens(tokenizer, end_id, own), "part long, doc_id long, source string, queue long, n long, before long, ids binary"), "tokens")
    totals = keep(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "token-totals")
    sizes = {r["queue"]: r["n"] for r in totals.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    sums = [sizes.get(q, 0) for q in range(max(sizes, default=-1) + 1)]
    share = [float((targets or {}).get(named[q], 0) if q < len(named) else 0) if targets else s for q, s in enumerate(sums)]
    top = max(share, default=1) or 1
    schedule = Schedule(sums, [round(x / top * SCALE) for x in share], quantum)
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # a part has at most one number for each queue
    offsets = offsets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("queue", "base"))).alias("bases"))
    if totals.count() <= BROADCAST_NUMBERS:
        placed = tokens.join(F.broadcast(offsets), "part")
    else:
        parts = parts_for(docs)
        placed = tokens.repartition(parts, "part").join(offsets.repartition(parts, "part"), "part")
    begin = F.element_at("bases", F.col("queue")) + F.col("before")
    placed = placed.select("doc_id", "source", "n", begin.alias("begin"), "queue", "ids")
    return placed.mapInArrow(_pack(schedule, length, with_ids), PIECES + (", ids binary" if with_ids else ""))
