"""Kept indexes and trees against scans and definitions."""

from __future__ import annotations

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korrel.operators import certify, indexes, text
from korrel.operators.indexes import BUCKETS, SuffixIndex, TrigramIndex


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = [(k * 40_000, "".join(rng.choice("abAB é🙂\n") for _ in range(rng.randint(0, 120)))) for k in range(60)] + [(None, "abab"), (5, None), (6, "ab" * 90), (7, "ab" * 90)]
    return spark.createDataFrame(rows, "id long, text string").repartition(3), [r for r in rows if r[0] is not None and r[1] is not None]


@pytest.mark.parametrize("literal", ["a", "ABAB", "é🙂", "ab" * 12, "ab" * 13, "ab" * 40, "zz"])
def test_suffixes_find_what_a_scan_finds(texts, literal):
    df, rows = texts
    index = SuffixIndex.build(df, "id", "text")
    folded = literal.lower()
    wanted = sorted((k, i + 1) for k, t in rows for i in range(len(t)) if t.lower().startswith(folded, i))
    assert sorted(map(tuple, index.places(literal).collect())) == wanted
    assert [tuple(r) for r in index.first(literal).collect()] == wanted[:40]
    assert sum(r["hits"] for r in index.tally(literal).collect()) == len(wanted)
    plan = index.places(literal)._jdf.queryExecution().toString()
    assert "StringStartsWith" in plan


def test_trigram_segments(spark, texts):
    df, rows = texts
    index = TrigramIndex(spark)
    assert index.candidates(["aba"]).count() == 0 and index.candidates(["ab"]) is None
    index.add(df.filter("id % 80000 = 0"), "id", "text")
    index.add(df.filter("id % 80000 <> 0"), "id", "text")
    has = lambda *wanted: sorted(k for k, t in rows if any(all(w[i : i + 3] in t for i in range(len(w) - 2)) for w in wanted))
    for literals in (["aba"], ["abA", "é🙂\n"], ["ababab"]):
        assert sorted(r["key"] for r in index.candidates(literals).collect()) == has(*literals)
    gone = [6, 80_000, 120_000]
    index.remove(spark.createDataFrame([(k,) for k in gone], "id long"), "id")
    left = [k for k in has("aba") if k not in gone]
    assert sorted(r["key"] for r in index.candidates(["aba"]).collect()) == left
    index.add(spark.createDataFrame([(6, "xaba")], "id long, text string"), "id", "text")
    assert sorted(r["key"] for r in index.candidates(["aba"]).collect()) == sorted({*left, 6})
    assert [r["key"] for r in index.candidates(["xab"]).collect()] == [6]
    index.compact()
    assert len(index.segments) == 1 and sorted(r["key"] for r in index.candidates(["aba"]).collect()) == sorted({*left, 6})


def test_a_search_reads_its_buckets_alone(spark, texts):
    df, _ = texts
    index = TrigramIndex(spark)
    index.add(df, "id", "text")
    index.add(df.withColumn("id", F.col("id") + 1), "id", "text")
    plan = index.candidates(["aba"])._jdf.queryExecution().toString()
    filters = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert len(filters) == 2 and all("bucket" in x.split("PartitionFilters")[1].split("]")[0] for x in filters)
    assert BUCKETS > 1


def test_searches_that_give_up(spark):
    df = spark.createDataFrame([(1, "aaa\n" + "a" * 200 + "b\nno"), (2, "none"), (3, None)], "id int, text string")
    found = sorted((r["id"], r["line_no"], r["outcome"], r["column"]) for r in text.search_within(df, "id", "text", "(a|aa)+$", 0.3).collect())
    assert found == [(1, 1, "match", 1), (1, 2, "not_searched", None)]


def H(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def test_merkle_tree_after_changes(spark):
    leaves = [H(k) for k in range(13)]
    df = lambda rows: spark.createDataFrame(list(rows), "i long, h string")
    tree = certify.MerkleTree(df(enumerate(leaves)).withColumnsRenamed({"i": "o", "h": "leaf"}), "o")
    assert tree.root() == certify.merkle_of(leaves)
    rng = random.Random(1)
    for step in range(4):
        changes = {i: H((step, i)) for i in rng.sample(range(len(leaves)), 3)} | {len(leaves) + k: H((step, "new", k)) for k in range((0, 1, 4, 9)[step])}
        tree.update(df(changes.items()))
        leaves = [changes.get(i, h) for i, h in enumerate(leaves)] + [changes[i] for i in sorted(changes) if i >= len(leaves)]
        assert tree.count == len(leaves) and tree.root() == certify.merkle_of(leaves)
    asked = [0, 5, len(leaves) - 1]
    paths = {r["i"]: r["path"] for r in tree.audit_paths(df((i, "") for i in asked)).collect()}
    for i in asked:
        assert paths[i] == certify.audit_path(leaves, i) and certify.updated_root(leaves[i], i, len(leaves), paths[i]) == tree.root()
    for wrong in ([(0, "x"), (0, "y")], [(len(leaves) + 1, "x")], [(-1, "x")]):
        with pytest.raises(ValueError):
            tree.update(df(wrong))
    with pytest.raises(ValueError):
        certify.MerkleTree(df([(1, H(1)), (1, H(2))]).withColumnsRenamed({"i": "o", "h": "leaf"}), "o")
    assert certify.MerkleTree(df([]).withColumnsRenamed({"i": "o", "h": "leaf"}), "o").root() == certify.EMPTY_ROOT


def test_suffixes_are_no_larger_than_a_few_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.choice((0, 900, 3000))))) for k in range(400)] + [(400, "ab c" * 40_000), (401, "x" * 65_536)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    index = SuffixIndex.build(df, "id", "text", str(tmp_path / "suffixes"))
    size = sum(f.stat().st_size for f in (tmp_path / "suffixes").glob("*.parquet"))
    assert size < 3.5 * sum(len(t) for _, t in rows)
    for literal in ("b ca", "x" * 30, "hgf"):
        wanted = sorted((k, i + 1) for k, t in rows for i in range(len(t)) if t.startswith(literal, i))
        assert sorted(map(tuple, index.places(literal).collect())) == wanted


def test_trigrams_are_handed_on_in_small_batches():
    texts = ["".join(map(chr, range(k, k + 2000))) for k in range(300, 700)]
    batch = pa.record_batch([pa.array(range(400)), pa.array(texts)], names=["key", "text"])
    made = list(indexes._grams([batch]))
    assert max(sum(map(len, b["grams"].to_pylist())) for b in made) < indexes.HELD + 2000
    assert [k for b in made for k in b["key"].to_pylist()] == list(range(400))
    assert [g for b in made for g in b["grams"].to_pylist()] == [sorted({t[k : k + 3] for k in range(1998)}) for t in texts]


def test_an_endless_line_is_tried_once(spark):
    """Sixty equal lines would take fifteen seconds."""
    df = spark.createDataFrame([(k, "a" * 400 + "b\nba") for k in range(60)], "id long, text string").coalesce(1)
    text.search_within(df.limit(1), "id", "text", "a", 1.0).collect()
    began = time.monotonic()
    rows = text.search_within(df, "id", "text", r"(a|aa)+\.?$", 0.25).collect()
    assert time.monotonic() - began < 10
    assert sorted((r["id"], r["line_no"], r["outcome"]) for r in rows) == sorted((k, n, o) for k in range(60) for n, o in ((1, "not_searched"), (2, "match")))
