"""Documents as chunks of bounded size, and the exchange of sorted hash lists between chunks and buckets.

What has to be counted over all documents goes out of each chunk once, as one sorted list of distinct hashes for
each bucket of the hash space, packed by steps and byte planes: a few bytes a hash. The bucket answers each chunk
for just the hashes that it sent, in their order. Chunks and buckets are of fixed size, so with the input their
number grows, and that of the lists as their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.llm.common import keep, slices, table_bytes, texts_of, tidied

#: Bytes of text that a chunk has at most (a larger text is a chunk by itself), and for which there is a bucket.
CHUNK, BUCKET = 6 << 20, 1 << 23
#: Rows of a chunk.
ROWS = 1 << 18


def buckets_for(docs: DataFrame) -> int:
    return max(8, -(-table_bytes(docs) // BUCKET))


def chunked(docs: DataFrame, id_col: str, text_col: str, rest, name: str) -> DataFrame:
    """(chunk, ids, sizes, a, b, rest, texts), written to the shared folder: rows in their order, ``rest`` a column.

    ``sizes`` are bytes, -1 for a null text; ``a`` and ``b`` are 128 bits that name a text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), *(T.StructField(c, longs) for c in ("ids", "sizes", "a", "b")),
        T.StructField("rest", T.ArrayType(rows.schema["rest"].dataType)), T.StructField("texts", T.BinaryType()),
    ])
    return keep(rows.mapInArrow(_chunks, schema), name)


@tidied
def _chunks(batches):
    part, number = TaskContext.get().partitionId(), 0
    ids, rest, sizes, texts, held = [], [], [], [], 0

    def closed():
        count = sum(map(len, ids))
        names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in texts), np.int64).reshape(-1, 2)
        edge = pa.array([0, count], pa.int32())
        lists = [pa.concat_arrays(ids), pa.array(np.concatenate(sizes), pa.int64()), *(pa.array(np.ascontiguousarray(names[:, k])) for k in (0, 1)), pa.concat_arrays(rest)]
        columns = [pa.array([part << 32 | number], pa.int64()), *(pa.ListArray.from_arrays(edge, x) for x in lists), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())]
        return pa.record_batch(columns, names=["chunk", "ids", "sizes", "a", "b", "rest", "texts"])

    for batch in batches:
        found, known = texts_of(batch.column(1)), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        for low, high in slices([len(x) for x in found], CHUNK // 4):
            size = sum(map(len, found[low:high]))
            if ids and (held + size > CHUNK or sum(map(len, ids)) >= ROWS):
                yield closed()
                ids, rest, sizes, texts, held, number = [], [], [], [], 0, number + 1
            ids.append(batch.column(0)[low:high])
            rest.append(batch.column(2)[low:high])
            sizes.append(np.where(known[low:high], [len(x) for x in found[low:high]], -1))
            texts += found[low:high]
            held += size
    if ids:
        yield closed()


class Dealer:
    """Deals what belongs to ``chunks`` out to ``parts`` tasks, as many chunks to each; rows of a chunk meet."""

    def __init__(self, chunks: DataFrame, parts: int):
        first = (chunks.agg(F.max(F.shiftright("chunk", 32))).first()[0] or 0) + 1
        self.parts = parts
        # the first chunks of all partitions, then the second ones, and so on
        self.at = F.expr(f"cast(pmod((chunk & 4294967295L) * {first} + shiftright(chunk, 32), {parts}) as int)")

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("deal", self.at).repartitionById(self.parts, F.col("deal"))

    def by_chunk(self, df: DataFrame):
        """Groups of ``df``; their key is (deal, chunk)."""
        return self(df).groupBy("deal", "chunk")


def by_bucket(asked: DataFrame, buckets: int):
    """Groups of requests; a bucket is a task."""
    return asked.repartitionById(buckets, F.col("bucket")).groupBy("bucket")


def texts_in(sizes: np.ndarray, packed: bytes) -> list[bytes]:
    text, ends = zstandard.decompress(packed), np.cumsum(np.maximum(0, sizes)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def packed(*arrays: np.ndarray) -> bytes:
    """Byte planes, so that bytes of one rank stand together."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays]
    return zstandard.compress(b"".join(planes), 1)


def unpacked(data: bytes, *widths: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    count, at, out = len(raw) // sum(widths), 0, []
    for width in widths:
        plane = raw[at : at + count * width].reshape(width, count)
        out.append(np.ascontiguousarray(plane.T).view(f"<u{width}").ravel())
        at += count * width
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def requests(chunk: int, keys: np.ndarray, buckets: int, *counts: np.ndarray) -> pa.RecordBatch:
    """(bucket, chunk, block): the sorted ``keys`` of a chunk, with counts, for each bucket that has some."""
    limits = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    edges = np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
    used = np.flatnonzero(np.diff(edges))
    blocks = [packed(steps(keys[a:b]), *(x[a:b] for x in counts)) for a, b in zip(edges[used], edges[used + 1])]
    return pa.record_batch([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "chunk", "block"])


REQUESTS = "bucket int, chunk long, block binary"
