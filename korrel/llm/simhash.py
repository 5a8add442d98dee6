"""SimHash near-duplicates: 64-bit fingerprints, linked at three or fewer differing bits.

Candidates come from deletion-variant signatures: the fingerprint is cut into two halves, so that of three
differing bits at least one half holds at most one. Each half is indexed under its 32 variants with one bit
left out; halves that differ in at most that bit are equal there. Equal variants are joined and verified.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import keep, parts_for, tidied

MAX_BITS = 3
#: Fingerprints of one variant that are compared in one piece; larger buckets are cut into blocks.
BLOCK = 1024

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\t-\r ]")


def _word_blocks(text: bytes, size: int = 1 << 20):
    """Lists of words, so that a very long text is never split as a whole."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def simhash(text: str | None, width: int = 3) -> int:
    """Fingerprint of the ``width``-word shingles, repeats included; zero where there is no word."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _word_blocks((text or "").encode().translate(_LOWER)):
        words = tail + words
        if len(words) < width:
            tail = words
            continue
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
        count = len(words) - width + 1
        found = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count)
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += count
        tail = words[count:]
    if not total and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), 42)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row for each row of ``docs``; a null text has the fingerprint zero."""

    @tidied
    def run(batches):
        for batch in batches:
            found = np.fromiter((simhash(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _variants(classes: DataFrame) -> DataFrame:
    keys = """explode(concat(
        transform(sequence(0, 31), i -> shiftleft(cast(i as bigint), 32) | ((fp & 4294967295L) & ~shiftleft(1L, i))),
        transform(sequence(0, 31), i -> shiftleft(cast(i + 32 as bigint), 32) | (shiftrightunsigned(fp, 32) & ~shiftleft(1L, i)))))"""
    return classes.select("fp", F.expr(keys).alias("key"))


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that join what is linked between ``left`` and ``right`` rows of ``fps``: at most one for each row."""
    near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= bits
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    found = fps.view(np.int64).tolist()
    return [(found[r], found[k]) for k, r in enumerate(label.tolist()) if r != k]


def _small(bits: int, block: int):
    """(a, b, key) from rows sorted by key and fp: verified pairs of buckets up to ``block``; keys of larger ones."""

    def run(batches):
        key, fps, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        last = iter([None])
        for batch in chain(batches, last):
            if batch is not None:
                key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
                fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(begin, append=len(key))
            large = (size > block) | (key[begin] == over) if over is not None else size > block
            found = []
            for k in key[begin[large]].tolist():
                if k != over:
                    found.append((None, None, k))
                over = k
            closed = np.ones(len(begin), bool)
            closed[-1] = batch is None  # the last bucket may go on in the next batch
            use = closed & ~large & (size > 1)
            for a, n in zip(begin[use & (size > 16)].tolist(), size[use & (size > 16)].tolist()):
                every = np.arange(n)
                found += [(x, y, None) for x, y in _forest(fps[a : a + n].view(np.uint64), every, every, bits)]
            use &= size <= 16
            row = np.repeat(use, size)
            k, f = key[row], fps[row].view(np.uint64)
            for step in range(1, int(size[use].max(initial=1))):
                x, y, same = f[:-step], f[step:], k[step:] == k[:-step]
                x, y, tag = x[same], y[same], k[step:][same] >> 32
                low, high = (np.bitwise_count((x ^ y) >> np.uint64(s) & np.uint64(0xFFFFFFFF)) for s in (0, 32))
                # a pair meets under many variants; it counts under one of them
                own = np.where(tag < 32, (low == 1) | ((low == 0) & (tag == 0)), (low > 1) & ((high == 1) | (tag == 32)))
                own &= low + high <= bits
                found += [(a, b, None) for a, b in zip(x[own].view(np.int64).tolist(), y[own].view(np.int64).tolist())]
            rest = begin[-1] if not closed[-1] and not large[-1] else len(key)
            key, fps = key[rest:], fps[rest:]
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b", "key"])

    return run


def _cells(bits: int):
    def run(batches):
        """Rows come sorted by cell; a cell holds two blocks of one bucket, so it is small."""
        cell, rows = None, []

        def closed():
            fps = np.array([x[0] for x in rows], np.int64).view(np.uint64)
            block = np.array([x[1] for x in rows])
            return _forest(fps, np.flatnonzero(block == cell[1]), np.flatnonzero(block == cell[2]), bits)

        for batch in batches:
            edges = []
            for key, low, high, fp, block in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (key, low, high) != cell:
                    edges += closed() if rows else []
                    cell, rows = (key, low, high), []
                rows.append((fp, block))
            if edges:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])
        if rows and (edges := closed()):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])

    return run


def links(classes: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct fingerprints with the same components as all links of ``bits`` or fewer.

    Buckets up to ``block`` fingerprints are verified where they meet. Larger ones are cut into blocks of about
    that size; each pair of blocks is compared apart, so no task holds a whole bucket.
    """
    if bits > 3:
        raise ValueError("two halves with one wildcard find three differing bits at most")
    variants = _variants(classes).select("key", "fp")
    met = variants.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_small(bits, block), "a long, b long, key long")
    met = keep(met, "simhash-links")
    pairs, large = met.filter("key is null").select("a", "b"), met.filter("key is not null").select("key")
    if large.isEmpty():
        return pairs
    many = variants.join(large, "key")
    blocks = many.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cells = (
        many.join(blocks, "key")
        .withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
        .withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "block")
    )
    more = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return pairs.union(more.mapInArrow(_cells(bits), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b) is connected with.

    Each round points every vertex at its smallest neighbour, shortens the pointers until they end at local
    minima, and contracts the edges; tables in the shared folder cut the lineage.
    """
    e = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    roots = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "pointers")
        while True:
            up = step.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            longer = keep(step.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "pointers")
            step = longer.select("v", "p")
            if longer.filter("moved").isEmpty():
                break
        if roots is None:
            roots = step.withColumnRenamed("p", "root")
        else:
            jump = step.select(F.col("v").alias("root"), "p")
            roots = keep(roots.join(jump, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "roots")
        ends = [step.select(F.col("v").alias(k), F.col("p").alias(f"p{k}")) for k in "ab"]
        e = e.join(ends[0], "a").join(ends[1], "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        e = keep(e.filter("a <> b").distinct(), "edges")
    if roots is None:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents with the same fingerprint are one vertex; ``component_id`` is the smallest id reachable.
    Empty and null texts have fingerprint zero and are linked like any other. Rows with a null id keep it;
    it is no one's component unless all ids of the component are null. Repeated rows come back repeated.
    An empty table gives an empty result; other columns are ignored.
    """
    found = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = components(links(classes.select("fp"), bits))
    rooted = classes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, one row for each such id; null ids stay."""
    first = near_duplicates(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(first, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
