"""Helpers shared by the operators: tables, the shared folder, batches, vector text hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
MAX64 = np.iinfo(np.uint64).max
#: With this Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What ``keep`` has written in the innermost function that is ``alone``.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, one of our own;
    on a cluster that is refused, as executors would each write to their own disk."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="korrel-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/korrel-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception as error:  # the session may be gone already
        print(f"left {path}: {type(error).__name__}")


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and no shuffle files stay."""
    path = new_dir(df.sparkSession, name)
    with _cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    if (made := _MADE.get()) is not None:
        made.append(kept)
    return kept


def forget(kept: DataFrame) -> None:
    """Delete what ``keep`` has written, once nothing reads it any more."""
    _remove(kept.sparkSession, kept.kept_at)


def alone(run: Callable) -> Callable:
    """``run``, of whose tables only the result stays: all others that it keeps are deleted when it ends.

    So its result is a table that it has kept, or no table.
    """

    @wraps(run)
    def wrapped(*args, **named):
        outer, made, out = _MADE.get(), [], None
        token = _MADE.set(made)
        try:
            out = run(*args, **named)
            if isinstance(out, DataFrame) and not any(out is x for x in made):
                raise ValueError(f"{run.__name__} has to keep what it returns")
        finally:
            _MADE.reset(token)
            for x in made:
                if x is not out:
                    forget(x)
        if isinstance(out, DataFrame) and outer is not None:
            outer.append(out)
        return out

    return wrapped


def table_bytes(df: DataFrame) -> int:
    """What Spark takes for the size of ``df``; where it knows none, 16 MB for each of the session's partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 24


def parts_for(df: DataFrame, mb: int = 16) -> int:
    """Shuffle partitions for ``df``: the session's number, or more so that each takes about ``mb`` of input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-table_bytes(df) // (mb << 20)), 200_000))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``limit`` in total; a larger single row stands alone."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def tidied(run: Callable) -> Callable:
    """``run`` for mapInArrow; memory that it has freed goes back to the system, as workers live on between tasks."""

    @wraps(run)
    def wrapped(batches):
        for out in run(batches):
            yield out
            del out
            trim()
        trim()

    return wrapped


@cache
def _libc():
    return ctypes.CDLL(None)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
#: Where the two families of hashes begin, and the factor by which neighbours are told apart.
_SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_LEFT = U64(0x9FB21C651E98DF25)
#: Bytes of each length in a lane of eight.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Spans of more bytes are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which all bits depend on all bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    return mix(a * _LEFT + b)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, families: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of each span of bytes: its lanes of eight bytes go one by one through ``mix``; long spans by XXH3.

    ``buffer`` (uint8) has eight bytes more than the last span. No sum of parts is ever compared, so no two
    spans meet by their structure, only by chance (2**-64 a pair, and the two families are independent).
    """
    size = ends - starts
    out = [mix(size.astype(U64) + U64(_SEEDS[which])) for which in families]
    lanes = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))
    at, left, short = np.arange(len(size)), size, size <= _LONG
    if not short.all():
        for k in np.flatnonzero(~short).tolist():
            raw = buffer[starts[k] : ends[k]].tobytes()
            for h, which in zip(out, families):
                h[k] = xxhash.xxh3_64_intdigest(raw, seed=_SEEDS[which])
        at, left = at[short], size[short]
    done = 0
    while True:
        more = left > done
        at, left = at[more], left[more]
        if not len(at):
            return out
        lane = lanes[starts[at] + done] & _MASKS[np.minimum(8, left - done)]
        for h in out:
            h[at] = mix(h[at] ^ lane)
        done += 8


def span_hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hashes(buffer, starts, ends, (which,))[0]


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` neighbours, by doubling: equal ones are those of equal hashes in the same order."""
    reach = 1
    while 2 * reach <= n:
        hashes, reach = pair(hashes[: max(0, len(hashes) - reach)], hashes[reach:]), 2 * reach
    rest = n - reach
    return pair(hashes[: max(0, len(hashes) - rest)], hashes[rest:]) if rest else hashes


class Words:
    """The words of some texts as spans of one byte buffer.

    A word is a run of bytes that ``is_separator`` doesn't mark (default: the six ASCII white spaces).
    ``first[d] : first[d + 1]`` are the words of text ``d``. ``tails`` are hashes of words, a row for each
    family, that come before the first text's: those at the end of the block before. They count as the text's,
    as its first ``lead`` words; ``base`` is the number that its first word has in the whole text.
    """

    def __init__(self, texts: list[bytes], is_separator: np.ndarray | None = None, translate: np.ndarray | None = None, tails: list[np.ndarray] | None = None, base: int = 0):
        self.raw = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
        self.buffer = self.raw if translate is None else translate[self.raw]
        gap = (_SEPARATORS if is_separator is None else is_separator)[self.buffer]
        edge = np.diff(gap.view(np.int8), prepend=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.ends) > len(self.starts):
            self.ends = self.ends[len(self.ends) - len(self.starts) :]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.tails, self.base, self.lead = tails, base, 0
        if tails is not None:
            self.lead = len(tails[0])
            self.first[1:] += self.lead
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        own = span_hash(self.buffer, self.starts, self.ends, which)
        return own if self.tails is None else np.concatenate([self.tails[which], own])

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they lie in one text."""
        count = max(0, len(hashes) - n + 1)
        return run_hash(hashes, n)[:count], self.doc[:count] == self.doc[n - 1 :][:count]


@cache
def _gap(marks: bytes) -> re.Pattern:
    return re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in range(256) if marks[b]) + b"]")


def blocks(text: bytes, limit: int, is_separator: np.ndarray | None = None) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes, none of which begins or ends inside a word."""
    gap, at = _gap((_SEPARATORS if is_separator is None else is_separator).tobytes()), 0
    while at < len(text):
        found = gap.search(text, at + limit)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def word_runs(texts: list[bytes], limit: int, is_separator: np.ndarray | None = None, translate: np.ndarray | None = None, carry: int = 0, families: int = 1) -> Iterator[tuple[int, int, Words]]:
    """(low, high, words): runs of texts of at most ``limit`` bytes, and the blocks of each longer text alone.

    So memory is bounded however long a text is. A block has the last ``carry`` words before it as its lead.
    """
    for low, high in slices([len(x) for x in texts], limit):
        if len(texts[low]) <= limit:
            yield low, high, Words(texts[low:high], is_separator, translate)
            continue
        tails, number = None, 0
        for block in blocks(texts[low], limit, is_separator):
            words = Words([block], is_separator, translate, tails, number - (len(tails[0]) if tails else 0))
            yield low, high, words
            number += len(words.starts)
            if carry:
                tails = [words.hashes(k)[-carry:] for k in range(families)]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` neighbours."""
    done, reach = values, 1
    while reach * 2 <= width:
        done = pick(done[: len(done) - reach], done[reach:])
        reach *= 2
    rest = width - reach
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def filesystem(uri: str):
    """The Arrow file system of a folder's URI, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
