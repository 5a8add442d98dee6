"""Indexes of texts kept on shared storage: trigram postings in segments, and sorted suffixes.

Both are tables that later sessions read. Keys are whole numbers.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korrel.session import shared_folder

#: Files of postings for each segment, and keys that share a list of a trigram's postings.
BUCKETS, BLOCK = 64, 1 << 16
#: Trigrams that a task's Python holds before it hands them on.
HELD = 1 << 17
POSTINGS = "gram string, block long, gaps array<int>, bucket int"


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/korrel-{name}-{uuid.uuid4().hex}"


def _grams(batches):
    """The runs of three characters of each text, each once; in one pass, however long it is. They are handed on every
    ``HELD`` of them, as a batch's texts have many times its size."""
    for batch in batches:
        low, grams, held = 0, [], 0
        for at, text in enumerate(batch.column(1)):
            text = text.as_py()
            grams.append(sorted({text[k : k + 3] for k in range(len(text) - 2)}))
            held += len(grams[-1])
            if held >= HELD or at + 1 == batch.num_rows:
                yield pa.record_batch([batch.column(0).slice(low, len(grams)), pa.array(grams, pa.list_(pa.string()))], names=["key", "grams"])
                low, grams, held = at + 1, [], 0


class TrigramIndex:
    """Which rows have which runs of three characters. Texts are added and taken out in segments.

    A segment is a folder with a folder for each bucket of trigrams, so a search opens the buckets of its trigrams
    alone. A posting list holds the keys of one block as gaps from one to the next; so no list grows with the table.
    A key that is taken out counts no more in the segments up to then; it may be added again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or _new(spark, "trigrams")
        self.segments: list[str] = []
        self.removed: list[tuple[int, str]] = []  # (segments up to which it holds, table of keys)

    def add(self, df: DataFrame, key: str, text: str) -> None:
        """A segment of the rows' texts. Null texts and keys have none."""
        rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        self._write(rows.mapInArrow(_grams, "key long, grams array<string>").select("key", F.explode("grams").alias("gram")))

    def _write(self, grams: DataFrame) -> None:
        block, low = F.shiftright("key", 16), F.col("key") - F.shiftleft(F.shiftright("key", 16), 16)
        lists = grams.groupBy("gram", block.alias("block")).agg(F.sort_array(F.collect_set(low.cast("int"))).alias("keys"))
        gaps = F.zip_with("keys", F.concat(F.array(F.lit(0)), F.slice("keys", 1, F.size("keys") - 1)), lambda a, b: a - b)
        rows = lists.select("gram", "block", gaps.alias("gaps"), F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        path = f"{self.folder}/segment-{uuid.uuid4().hex}"
        rows.repartition("bucket", F.pmod("block", F.lit(64))).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        self.segments.append(path)

    def remove(self, keys: DataFrame, key: str) -> None:
        path = f"{self.folder}/removed-{uuid.uuid4().hex}"
        keys.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct().write.parquet(path)
        self.removed.append((len(self.segments), path))

    def _lists(self, grams: list[str] | None) -> DataFrame:
        """(gram, key) of the segments, of some trigrams or all."""
        parts = []
        for k, path in enumerate(self.segments):
            rows = self.spark.read.schema(POSTINGS).parquet(path)
            if grams is not None:
                buckets = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct()
                rows = rows.filter(F.col("bucket").isin(sorted(r[0] for r in buckets.collect())) & F.col("gram").isin(grams))
            place = Window.partitionBy("gram", "block").orderBy("pos")
            keys = rows.select("gram", "block", F.posexplode("gaps").alias("pos", "gap")).select("gram", (F.shiftleft("block", 16) + F.sum("gap").over(place)).alias("key"))
            gone = [p for upto, p in self.removed if upto > k]
            if gone:
                keys = keys.join(self.spark.read.schema("key long").parquet(*gone).distinct(), "key", "left_anti")
            parts.append(keys)
        none = self.spark.createDataFrame([], "gram string, key long")
        return reduce(DataFrame.unionByName, parts, none) if parts else none

    def candidates(self, literals: list[str]) -> DataFrame | None:
        """(key): rows that have all trigrams of some literal; None if a literal is too short to tell."""
        if not literals or any(len(x) < 3 for x in literals):
            return None
        wanted = {literal: sorted({literal[k : k + 3] for k in range(len(literal) - 2)}) for literal in literals}
        every = sorted({g for grams in wanted.values() for g in grams})
        hits = self._lists(every).groupBy("key").agg(F.collect_set("gram").alias("grams"))  # at most the literals' trigrams
        has = [F.size(F.array_except(F.lit(grams), "grams")) == 0 for grams in wanted.values()]
        return hits.filter(reduce(lambda a, b: a | b, has)).select("key")

    def compact(self) -> None:
        """All segments as one, without what was taken out. The old ones stay for readers that began before."""
        rows = self._lists(None).distinct()
        old = self.segments
        self.segments, self.removed = [], []
        try:
            self._write(rows)
        except Exception:
            self.segments = old
            raise


#: Characters by which suffixes are sorted, and characters of texts that are sorted at a time.
WIDTH, SEGMENT = 4, 1 << 20
SUFFIXES = "suffix string, places binary"


def _varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits to a byte, the lowest first; and where each number's bytes end."""
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 64, 7):
        more = numbers >= np.uint64(1) << np.uint64(bits)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        byte = numbers[some] >> np.uint64(7 * k) & np.uint64(127)
        out[(ends - size)[some] + k] = byte | (size[some] > k + 1).astype(np.uint64) << np.uint64(7)
    return out, ends


def _numbers(data: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    place = np.arange(len(data)) - np.repeat(first, np.diff([*first, len(data)]))
    return np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def _segment(pieces: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
    """(suffix, places) of pieces (key, characters before it, text, how many of its places are its own), sorted.

    Places are (key, at) as steps from one to the next; where the key changes, ``at`` begins anew.
    """
    text, lengths = "".join(p[2] for p in pieces), np.array([len(p[2]) for p in pieces])
    starts = np.cumsum(lengths) - lengths
    codes, at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1), np.arange(len(text))
    piece = np.repeat(np.arange(len(pieces)), lengths)
    ends = (starts + lengths)[piece]
    rank, width = codes, 1
    while width < WIDTH:  # ranks by some characters give those by twice as many
        pair = rank << np.uint64(32) | np.where(at + width < ends, rank[np.minimum(at + width, len(at) - 1)], np.uint64(0))
        rank, width = np.unique(pair, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), 2 * width
    own = np.flatnonzero(at - starts[piece] < np.array([p[3] for p in pieces])[piece])
    order = own[np.argsort(rank[own], kind="stable")]
    rank, piece = rank[order], piece[order]
    row = np.flatnonzero(np.concatenate([[True], np.diff(rank) != 0]))
    keys, place = np.array([p[0] for p in pieces], np.int64)[piece], order - starts[piece] + np.array([p[1] for p in pieces])[piece] + 1
    new = np.zeros(len(order), bool)
    new[row] = True
    step = np.where(new, keys, keys - np.roll(keys, 1))
    move = np.where(new | (step != 0), place, place - np.roll(place, 1))
    sign = (step << 1 ^ step >> 63).view(np.uint64)
    data, stops = _varints(np.stack([sign, (move << 1 ^ move >> 63).view(np.uint64)], 1).ravel())
    cuts = np.concatenate([[0], stops[2 * np.append(row[1:], len(order)) - 1]]).astype(np.int32)
    first = order[row]
    suffixes = [text[k:e] for k, e in zip(first.tolist(), np.minimum(first + WIDTH, ends[first]).tolist())]
    blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return pa.record_batch([pa.array(suffixes, pa.string()), blobs], names=["suffix", "places"])


def _segments(batches):
    """Texts are sorted some at a time; a long one in pieces, which go on for WIDTH - 1 characters that aren't their own."""
    pieces, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            key, text = key.as_py(), text.as_py()
            for low in range(0, len(text), SEGMENT):
                piece = text[low : low + SEGMENT + WIDTH - 1]
                pieces.append((key, low, piece, min(len(piece), SEGMENT)))
                size += len(piece)
                if size >= SEGMENT:
                    yield _segment(pieces)
                    pieces, size = [], 0
    if pieces:
        yield _segment(pieces)


def _places(batches):
    for batch in batches:
        for places in batch.column(0):
            step, move = (x.view(np.int64) for x in _numbers(np.frombuffer(places.as_buffer(), np.uint8)).reshape(-1, 2).T.copy())
            step, move = (x >> 1 & (1 << 63) - 1 ^ -(x & 1) for x in (step, move))
            new = step != 0
            new[0] = True
            total = np.cumsum(move)
            at = total - np.repeat((total - move)[new], np.diff([*np.flatnonzero(new), len(new)]))
            yield pa.record_batch([pa.array(np.cumsum(step)), pa.array(at.astype(np.int32))], names=["key", "at"])


class SuffixIndex:
    """Every position of the folded texts, sorted by the ``WIDTH`` characters from there on.

    What begins alike is one row for each ``SEGMENT`` of characters, with its positions as steps; rows are made where the
    texts are read and sorted in each file. So no characters are shuffled, and the index takes some two bytes for each
    position, while every suffix's own characters took as many times the texts. A search reads the row groups whose
    bounds its literal falls between. A longer literal is looked for in parts, whose positions must follow each other.
    Overlapping hits all count. Whole suffixes aren't compared: equal beginnings stay in the order of their places, which
    is the order that places are told in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str | None = None) -> SuffixIndex:
        spark = df.sparkSession
        path = path or _new(spark, "suffixes")
        folded = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lower(text).alias("text"))
        rows = folded.mapInArrow(_segments, SUFFIXES)
        rows.sortWithinPartitions("suffix").write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
        return cls(spark, path)

    def places(self, literal: str) -> DataFrame:
        """(key, at): where the folded literal begins; characters count from 1."""
        literal = literal.lower()
        if not literal:
            raise ValueError("an empty literal is everywhere")
        lows = sorted({max(0, min(low, len(literal) - WIDTH)) for low in range(0, len(literal), WIDTH)})  # the last part is a whole one too
        found = None
        for low in lows:
            rows = self.spark.read.schema(SUFFIXES).parquet(self.path).filter(F.startswith("suffix", F.lit(literal[low : low + WIDTH])))
            rows = rows.select("places").mapInArrow(_places, "key long, at int").select("key", (F.col("at") - low).alias("at"))
            found = rows if found is None else found.unionByName(rows)
        return found if len(lows) == 1 else found.groupBy("key", "at").agg(F.count("*").alias("n")).filter(F.col("n") == len(lows)).select("key", "at")

    def tally(self, literal: str) -> DataFrame:
        return self.places(literal).groupBy("key").agg(F.count("*").alias("hits"))

    def first(self, literal: str, n: int = 40) -> DataFrame:
        return self.places(literal).orderBy("key", "at").limit(n)
