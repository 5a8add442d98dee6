"""Answer certificates: statuses, accounting, canonical JSON and Merkle roots (RFC 9162)."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.operators.prefix import running
from korrel.session import checkpointed, shared_folder

EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def leaf(path: Column, digest: Column) -> Column:
    """SHA-256 of a zero byte, the path's length (four bytes, little-endian), the path and the digest, in hex."""
    size = F.octet_length(path)
    little = F.concat(*(F.lpad(F.hex(F.shiftright(size, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)))
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(little), F.encode(path, "UTF-8"), F.unhex(digest)), 256)


def merkle_root(leaves: DataFrame, order: str, digest: str = "leaf") -> str:
    """Root over the leaves in order: pairs are hashed level by level, an odd last one goes up as it is.

    Levels are DataFrames of (i, h), each half as long as the one below, kept in the shared folder.
    """
    def numbered(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), batch.column(0)], names=["part", "k", "h"])
            at += n

    dealt = leaves.select(F.col(order).alias("o"), F.col(digest).alias("h"))
    dealt = dealt.repartitionByRange("o").sortWithinPartitions("o").select("h")
    rows = checkpointed(dealt.mapInArrow(numbered, "part int, k long, h string"))
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one row a partition
    count, bases = 0, []
    for part, size in sizes:
        bases.append((part, count))
        count += size
    if not count:
        return EMPTY_ROOT
    bases = F.broadcast(leaves.sparkSession.createDataFrame(bases, "part int, base long"))
    level = checkpointed(rows.join(bases, "part").select((F.col("base") + F.col("k")).alias("i"), "h"))
    while count > 1:
        pairs = level.groupBy(F.expr("i div 2").alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"), F.count("*").alias("n"))
        both = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("a"), F.unhex("b")), 256)
        level = checkpointed(pairs.select("i", F.when(F.col("n") == 2, both).otherwise(F.col("a")).alias("h")))
        count = (count + 1) // 2
    return level.first()["h"]


class MerkleTree:
    """The tree of ``merkle_root`` with its levels kept as tables, so that a change hashes the nodes above it alone.

    Level 0 are the leaves (i, h), numbered from 0; each level is a folder of versions, of which the last that has a
    node holds. A batch of k changed or appended leaves writes some k nodes a level. Leaves whose order is null or
    not unique are refused: they have no one order.
    """

    def __init__(self, leaves: DataFrame, order: str, digest: str = "leaf"):
        self.spark = leaves.sparkSession
        self.folder = f"{shared_folder(self.spark)}/korrel-merkle-{uuid.uuid4().hex}"
        rows = leaves.select(F.col(order).alias("o"), F.col(digest).alias("h"))
        if not rows.groupBy("o").count().filter("o is null or count > 1").isEmpty():
            raise ValueError("the leaves' order isn't unique")
        self.version, self.versions, self.count = 0, [], 0
        self._apply(running(rows, [], ["o"], F.lit(1).cast("long"), "i", "n").select("i", "h"))

    def _level(self, k: int) -> DataFrame:
        """(i, h) of a level, each node as it was written last."""
        parts = [self.spark.read.schema("i long, h string").parquet(f"{self.folder}/level-{k}/{v}").withColumn("v", F.lit(v)) for v in self.versions[k]]
        if len(parts) == 1:
            return parts[0].drop("v")
        return reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.max_by("h", "v").alias("h"))

    def _apply(self, changed: DataFrame) -> None:
        self.version += 1
        k, size, below = 0, None, changed
        while True:
            path = f"{self.folder}/level-{k}/{self.version}"
            below.select("i", "h").write.parquet(path)
            written = self.spark.read.schema("i long, h string").parquet(path)
            if k == 0:
                most = written.agg(F.max("i")).first()[0]
                self.count = max(self.count, 0 if most is None else most + 1)
                size = self.count
            if k == len(self.versions):
                self.versions.append([])
            self.versions[k].append(self.version)
            if size <= 1:
                break
            pairs = written.select(F.expr("i div 2").alias("j")).distinct()
            both = self._level(k).withColumn("j", F.expr("i div 2")).join(pairs, "j", "left_semi")
            pair = both.groupBy("j").agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"), F.count("*").alias("n"))
            node = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("a"), F.unhex("b")), 256)
            below = pair.select(F.col("j").alias("i"), F.when(F.col("n") == 2, node).otherwise(F.col("a")).alias("h"))
            k, size = k + 1, (size + 1) // 2

    def update(self, changes: DataFrame) -> None:
        """Leaves (i, h) that changed, or that come after the last without a gap."""
        rows = checkpointed(changes.select(F.col("i").cast("long"), "h"))
        new = rows.agg(F.count("*").alias("n"), F.count_distinct("i").alias("known"), F.min("i").alias("low"), F.max("i").alias("high"), F.count_if(F.col("i") >= self.count).alias("added")).first()
        if new["n"] == 0:
            return
        if new["known"] < new["n"] or new["low"] < 0 or new["added"] != max(0, new["high"] + 1 - self.count):
            raise ValueError("leaves are changed once, and added without a gap")
        self._apply(rows)

    def root(self) -> str:
        if not self.count:
            return EMPTY_ROOT
        top = (self.count - 1).bit_length()
        return self._level(top).filter("i = 0").first()["h"]

    def audit_paths(self, leaves: DataFrame) -> DataFrame:
        """(i, path): what else is hashed on the way from each leaf (i) to the root, from the leaf up."""
        paths = leaves.select(F.col("i").cast("long"), F.col("i").cast("long").alias("at"), F.array().cast("array<string>").alias("path"))
        for k in range(max(0, self.count - 1).bit_length()):
            beside = self._level(k).select(F.col("i").alias("beside"), F.col("h"))
            met = paths.withColumn("beside", F.col("at").bitwiseXOR(F.lit(1))).join(beside, "beside", "left")
            paths = met.select("i", F.expr("at div 2").alias("at"), F.when(F.col("h").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("h"))).alias("path"))
        return paths.select("i", "path")


def merkle_of(digests: list[str]) -> str:
    """The same root by the recursive definition, for few leaves."""
    if not digests:
        return EMPTY_ROOT
    if len(digests) == 1:
        return digests[0]
    k = 1 << ((len(digests) - 1).bit_length() - 1)
    return hashlib.sha256(b"\x01" + bytes.fromhex(merkle_of(digests[:k])) + bytes.fromhex(merkle_of(digests[k:]))).hexdigest()


def _node(a: str, b: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def audit_path(digests: list[str], index: int) -> list[str]:
    """What else is hashed on the way from a leaf to the root, from the leaf up."""
    if len(digests) < 2:
        return []
    k = 1 << ((len(digests) - 1).bit_length() - 1)
    if index < k:
        return [*audit_path(digests[:k], index), merkle_of(digests[k:])]
    return [*audit_path(digests[k:], index - k), merkle_of(digests[:k])]


def updated_root(digest: str, index: int, count: int, path: list[str]) -> str:
    """The root once leaf ``index`` of ``count`` is ``digest``, by the leaf's audit path alone."""
    sides = []  # whether the leaf is in the left part, from the root down
    while count > 1:
        k = 1 << ((count - 1).bit_length() - 1)
        sides.append(index < k)
        index, count = (index, k) if index < k else (index - k, count - k)
    if len(sides) != len(path):
        raise ValueError("the path isn't this leaf's")
    for left, other in zip(reversed(sides), path):
        digest = _node(digest, other) if left else _node(other, digest)
    return digest


def canonical(value) -> str:
    """RFC 8785 for values without fractions: keys by UTF-16 order, no white space."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    raise ValueError(f"{type(value).__name__} has no canonical form here")


@dataclass
class Certificate:
    """What an answer looked at: listed less excluded files are evaluated or missing."""

    snapshot: str
    listed: int
    evaluated: int
    excluded: dict[str, int] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    budgets: dict[str, tuple[int, int]] = field(default_factory=dict)  # name: (spent, allowed)

    def problems(self) -> list[str]:
        found = []
        if self.listed - sum(self.excluded.values()) != self.evaluated + len(self.missing):
            found.append("files don't add up")
        if len(set(self.missing)) != len(self.missing):
            found.append("a file is missing twice")
        found += [f"{k} overspent" for k, (spent, allowed) in self.budgets.items() if spent > allowed]
        return found

    def status(self) -> str:
        self.missing.sort()
        return "refused" if self.problems() else "partial" if self.missing else "complete"

    def digest(self) -> str:
        body = {"snapshot": self.snapshot, "listed": self.listed, "evaluated": self.evaluated, "excluded": self.excluded, "missing": sorted(self.missing), "budgets": {k: list(v) for k, v in self.budgets.items()}}
        return hashlib.sha256(canonical(body).encode()).hexdigest()
