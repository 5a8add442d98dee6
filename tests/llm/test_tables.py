"""Manifests, quantile summaries and archives against brute force, on odd, skewed and empty tables."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from korrel.llm import merkle, quantiles, warc
from korrel.llm.queries import op11_merkle_manifest, op12_quantile_summaries, op13_warc_archives
from korrel.operators.prefix import running
from pyspark.sql import functions as F
from tests.oracle import connect, same

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# Running totals


def test_running_totals_over_ranges(spark):
    rows = [(g, k) for g in ("a", None, "b") for k in range({"a": 500, None: 20, "b": 1}[g])]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    found = {(r["g"], r["k"]): (r["before"], r["total"]) for r in running(df, ["g"], ["k"], F.col("k")).collect()}
    assert len(found) == len(rows)
    for (g, k), (before, total) in found.items():
        n = {"a": 500, None: 20, "b": 1}[g]
        assert (before, total) == (k * (k - 1) // 2, n * (n - 1) // 2)
    assert running(df.filter("false"), [], ["k"], F.lit(1)).count() == 0


# 11 Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def climb(nodes):
        """levels of digests, and for each place in each level its slot and run"""
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([H(*last[k : k + 16]) for k in range(0, len(last), 16)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            low = i // 16 * 16
            yield i - low, level[low : low + 16]
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        tampered = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            tampered[4] = r[4].translate(small)
        groups[r[1]].append(((r[0] is not None, r[0] or 0, H(*map(field, r))), H(*map(field, tampered)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[0][2] for x in sorted(groups[s])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    for g, s in enumerate(names):
        for i, ((_, _, leaf), changed, doc_id) in enumerate(sorted(groups[s])):
            steps = [*way(trees[s], i), *way(top, g)]
            cur = changed
            for slot, run in steps:
                cur = H(*run[:slot], cur, *run[slot + 1 :])
            proof = H(*(x for slot, run in steps for x in run[:slot] + run[slot + 1 :]))
            yield doc_id, leaf, trees[s][-1][0], top[-1][0], proof, cur, cur == top[-1][0]


def _same_proofs(spark, rows, parts=4):
    df = spark.createDataFrame(rows, DOCS + ", key string, i int").repartition(parts)
    found = merkle.proofs(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == Counter(proofs_by_hand([r[:5] for r in rows]))


def test_manifest_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, "hot", "en", k, f"Text {k} " * rng.randint(0, 9)) for k in range(273)]  # 16 * 17 + 1: a run of one
    rows += [(k, None, None, None, None) for k in range(17)] + [(None, "hot", None, 1, "no id")] * 3
    rows += [(7, "x", "fr", 1, "")] * 40 + [(7, "x", "fr", 1, None), (7, "x", "fr", 2, "LONG É " * 50_000)]
    rows += [(k, f"s{k:02d}é", "de", 1, "One Row") for k in range(20)] + [(5, "", "de", 1, "empty name")]
    _same_proofs(spark, [(*r, "k", 1) for r in rows])


def test_manifest_of_one_row_and_none(spark):
    _same_proofs(spark, [(0, "a", None, 3, "ABC", "k", 1)], 1)
    empty = spark.createDataFrame([], DOCS)
    assert merkle.proofs(empty).count() == 0 and merkle.manifest(empty.withColumn("leaf", F.lit("x")), "source", "doc_id").root() is None


def test_manifest_tells_every_change(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "source", merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"))
    made = merkle.manifest(rows, "source", "doc_id")
    paths = made.paths().collect()
    assert {r["root"] for r in paths} == {made.root()} and len(paths) == docs.count()
    other = merkle.manifest(rows.withColumn("leaf", F.when(F.col("doc_id") == 3, F.sha2("leaf", 256)).otherwise(F.col("leaf"))), "source", "doc_id")
    assert other.root() != made.root()


# 12 Quantile summaries


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 3000), st.integers(1, 400)), min_size=1, max_size=300), st.integers(1, 40), st.booleans())
def test_collapse_keeps_ranks(points, size, right):
    weights = Counter()
    for x, w in points:
        weights[x] += w
    x, w = (np.array(c, np.int64) for c in zip(*sorted(weights.items())))
    cx, cw, error = quantiles.collapse(x, w, size, right)
    assert cw.sum() == w.sum() and (np.diff(cx) > 0).all() and len(cx) <= size and set(cx.tolist()) <= set(x.tolist())
    exact, told = np.cumsum(w), np.concatenate([[0], np.cumsum(cw)])[np.searchsorted(cx, x, side="right")]
    assert np.abs(exact - told).max() <= error <= w.sum() // 2 + 1
    assert len(x) <= size or len(cx) >= size // 2


def test_collapses_take_both_middles():
    x, w = np.arange(100), np.ones(100, np.int64)
    left, right = quantiles.collapse(x, w, 25, False)[0], quantiles.collapse(x, w, 25, True)[0]
    assert left.tolist() == list(range(1, 100, 4)) and right.tolist() == list(range(2, 100, 4))


def _held_against_rows(found, groups, of, least, bounds=(10, 1000)):
    want = {(g, i) for g, xs in groups.items() if len(xs) >= least for i in range(1, of)}
    assert {(k, r["i"]) for k, r in found} == want and len(found) == len(want)
    for xs in groups.values():
        xs.sort()
    for k, r in found:
        xs, n = groups[k], len(groups[k])
        target = -(-r["i"] * n // of)
        assert (r["n"], r["target"], r["exact_x"]) == (n, target, xs[target - 1])
        assert min(bounds[0], len(set(xs))) <= r["points"] <= min(n, bounds[1])
        assert (r["n_below"], r["n_upto"]) == (bisect.bisect_left(xs, r["answer"]), bisect.bisect_right(xs, r["answer"]))
        assert r["rank_error"] == max(0, r["n_below"] + 1 - target, target - r["n_upto"]) <= r["bound"]
        assert r["within"] == (50 * r["rank_error"] <= n) and r["within"]
    by = defaultdict(list)
    for k, r in found:
        by[k].append((r["i"], r["answer"]))
    assert all(sorted(v) == sorted(v, key=lambda t: (t[1], t[0])) for v in by.values())


def test_summaries_of_skewed_keys(spark):
    """A key with most rows, values that nearly all rows share, and merges in rounds."""
    rng = random.Random(3)
    rows = [("hot", rng.randrange(4), int(rng.expovariate(1) * 1e6)) for _ in range(30_000)]
    rows += [("same", k % 4, 7 if k % 50 else k) for k in range(4000)] + [("few", 0, k % 3) for k in range(30)] + [("tiny", 1, k) for k in range(19)]
    df = spark.createDataFrame(rows, "grp string, batch int, x long").withColumn("c", F.lit(1).cast("long")).repartition(12)
    groups = defaultdict(list)
    for g, b, x in rows:
        groups[g, b].append(x)
        groups[g, -1].append(x)
    found = [((r["grp"], r["batch"]), r) for r in quantiles.verified(df, of=10, fan=4).collect()]
    _held_against_rows(found, groups, 10, 20)


def test_small_buffers_track_their_error(spark):
    rows = spark.range(0, 20_000, 1, 7).select(F.lit("g").alias("grp"), (F.col("id") % 2).cast("int").alias("batch"), (F.col("id") * 7919 % 20_011).alias("x"), F.lit(1).cast("long").alias("c"))
    batches = quantiles.summaries(rows, size=40)
    both = batches.unionByName(quantiles.whole(batches, size=40))
    answers = quantiles.quantiles(both, 20)
    met = answers.join(quantiles.ranked(rows, answers, 20), ["grp", "batch", "i"])
    off = met.withColumn("off", F.greatest(F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"), F.lit(0)))
    r = off.agg(F.max("off").alias("off"), F.max("bound").alias("bound"), F.max("points").alias("points"), F.count("*").alias("n"), F.count_if(F.expr("off > bound")).alias("wrong")).first()
    assert 0 < r["off"] <= r["bound"] and r["points"] <= 40 and r["n"] == 3 * 19 and r["wrong"] == 0


def test_streams_by_brute_force(spark, small):
    clicks, lines, items = (spark.read.parquet(f"{small}/{t}.parquet").toPandas() for t in ("clicks", "sale_lines", "items"))
    groups = defaultdict(list)

    def put(stream, grp, number, money):
        if grp is not None and grp == grp and money == money:
            batch = zlib.crc32(str(int(number)).encode()) % 4
            x = math.floor(100 * money + 0.5) + 1000 * batch
            groups[stream, str(grp), batch].append(x)
            groups[stream, str(grp), -1].append(x)

    for r in clicks.drop_duplicates("click_id").itertuples():
        put("value", int(r.client_id) if r.client_id == r.client_id else None, r.click_id, r.value)
    listed = {r.item_id: r for r in items.itertuples()}
    for r in lines.itertuples():
        if r.item_id == r.item_id:
            put("price", listed[r.item_id].brand, r.vendor_id, listed[r.item_id].price)
    _held_against_rows([((r["stream"], r["grp"], r["batch"]), r) for r in op12_quantile_summaries(spark, small).collect()], groups, 4, 20)


def test_streams_odd_rows(spark):
    clicks = [(k, "2024-01-01", 1, float(k)) for k in range(30)] * 2 + [(None, "2024-01-01", 1, 5.0)] * 3 + [(100, None, None, 1.0), (101, None, 1, None), (102, None, 1, float("nan")), (103, None, 1, 1e300), (104, None, 1, float("inf"))]
    lines = [(k % 3, 1, None if k % 2 else 4) for k in range(50)] + [(None, 1, 4), (9, 1, 4)]
    items = [(0, "b:x", 1.0), (1, None, 1.0), (2, "", None), (0, "b:x", 1.0)]
    made = [
        spark.createDataFrame(clicks, "click_id long, arrived_at string, client_id long, value double").withColumn("grp", F.lit(1)),
        spark.createDataFrame(lines, "item_id long, line_no int, vendor_id long"), spark.createDataFrame(items, "item_id long, brand string, price double").withColumn("vendor_id", F.lit(3)),
    ]
    rows = quantiles.streams(*made).groupBy("grp").agg(F.sum("c").alias("n"))
    assert {r["grp"]: r["n"] for r in rows.collect()} == {"value:1": 31, "price:b:x": 17}
    told = quantiles.stream_quantiles(*made).filter("batch = -1").collect()
    assert {(r["stream"], r["grp"], r["n"]) for r in told} == {("value", "1", 31)}
    assert quantiles.stream_quantiles(*(x.filter("false") for x in made)).count() == 0


# 13 WARC

PAGES = "page_id long, url string, html string"
BIG = "<p>A Payload é</p>" * 80


def archived_by_hand(rows):
    top = {}
    for page, url, html in rows:
        key = (page is not None, page or 0, url is not None, url or "")
        top[html] = max(top.get(html, key), key)
    seen = set()
    for page, url, html in rows:
        data, key = (html or "").encode(), (page is not None, page or 0, url is not None, url or "")
        revisit = len(data) >= 1000 and (key != top[html] or html in seen)
        if key == top[html]:
            seen.add(html)
        winner = top[html][1] if top[html][0] else None
        yield page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", winner if revisit else None


def test_archives_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, f"http://x/{k}", "<html>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 400)))) for k in range(120)]
    rows += [(k, "http://copy/", BIG) for k in range(200, 260)] + [(259, "http://copy/", BIG)] * 5 + [(259, "http://another/", BIG), (None, None, BIG)]
    rows += [(300, None, None), (301, "a\r\nWARC-Type: x", ""), (302, "u", "short"), (303, "u", "short"), (None, "n", BIG + "!"), (None, "n", BIG + "!"), (304, "u", "x" * 3_000_000), (305, "u", "\r\n\r\n" * 400)]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], PAGES + ", kind int, payload binary").repartition(3)
    assert Counter(map(tuple, warc.archived(df).collect())) == Counter(archived_by_hand(rows))
    assert warc.archived(df.filter("false")).count() == 0


def test_archives_are_read_by_their_index(spark, tmp_path):
    html = lambda k: f"<html><head><title>Page {k}</title></head><body>" + f"<p>Paragraph {k % 7} of a page like all others.</p>" * 20
    df = spark.createDataFrame([(k, f"http://x/{k}", html(k)) for k in range(900)], PAGES).repartition(2)
    index = warc.write_archives(df, str(tmp_path)).collect()
    assert len(index) == 900 and 1 <= len({r["file"] for r in index}) <= 2
    for r in index[::90]:
        with open(r["file"], "rb") as stream:
            fields, block = warc.parsed(warc.record_at(stream, r["offset"], r["size"]))
            assert block.endswith(html(r["page_id"]).encode()) and fields["WARC-Target-URI"] == f"http://x/{r['page_id']}"
            stream.seek(0)
            magic = int.from_bytes(stream.read(4), "little")
            assert magic == warc.DICTIONARY  # the dictionary leads
            stream.seek(r["offset"])
            with pytest.raises(zstandard.ZstdError):  # and is needed
                zstandard.ZstdDecompressor().decompressobj().decompress(stream.read(r["size"]))
    alone = 0
    for name in {r["file"] for r in index}:
        with open(name, "rb") as stream:
            alone += sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(x)) for x in warc.records(stream))
    assert sum(r["size"] for r in index) < alone / 2


def test_a_damaged_archive_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", BIG), (2, "u", "<p>" * 500)], PAGES).coalesce(1)
    index = warc.write_archives(df, str(tmp_path))
    path = index.first()["file"]
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.read_archives(index, str(tmp_path)).collect()
    open(path, "wb").write(data[:-5])
    with pytest.raises(Exception):
        warc.read_archives(index, str(tmp_path)).collect()


@pytest.mark.parametrize("run, sql", [(op11_merkle_manifest, merkle.MERKLE_SQL), (op13_warc_archives, warc.WARC_SQL)])
def test_queries_by_sql(spark, small, run, sql):
    same(run(spark, small), connect(small), sql)


# 6 Co-training: who takes part


@pytest.mark.parametrize("kind", ["drawn from one vocabulary", "alike but for a few words", "numbered"])
def test_every_different_text_is_taught_from(spark, kind):
    """Documents without a label take part however alike they are; equal texts once."""
    from korrel.llm import cotrain

    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(words[:60])
    make = {"drawn from one vocabulary": lambda k: " ".join(rng.choice(words) for _ in range(200)), "alike but for a few words": lambda k: f"{common} {' '.join(rng.sample(words, 6))} {k}", "numbered": lambda k: f"fine text number {k}"}[kind]
    texts = [make(k) for k in range(1000)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*texts, *texts[:50]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    features = cotrain._features(docs, "doc_id", "text", cotrain.META)
    assert cotrain._unlabelled(features, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")).count() == 1000


# 2 Benchmark decontamination: where samples don't reach the target


@pytest.mark.parametrize("length", [5, 11, 40, 150, 400])
@pytest.mark.filterwarnings("ignore:items of")
def test_classes_below_the_target_are_searched_exactly(monkeypatch, length):
    """Without any samples that count, unchanged parts still find every item edited as far as it may be."""
    from korrel.llm import decontaminate

    monkeypatch.setattr(decontaminate, "TARGET", 1.01)
    monkeypatch.setattr(decontaminate, "MANY", 4)
    monkeypatch.setattr(decontaminate, "_met", lambda size, rows, starts: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    rng = np.random.default_rng(length)
    words = lambda n: rng.integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    items, edits = [words(length) for _ in range(30)], int(decontaminate.EDITS * length)
    texts = [np.concatenate([words(rng.integers(0, 90)), decontaminate._edited(x, edits, rng), words(rng.integers(0, 9))]) for x in items]
    count = np.array([len(x) for x in texts])
    begin = np.cumsum(count + 1) - count - 1
    rows = np.concatenate([y for x in texts for y in (x, [np.uint64(0)])]).astype(np.uint64)
    doc, item, found, _ = decontaminate._search(decontaminate.build_index(items), items, rows, begin, count)
    assert doc.tolist() == item.tolist() == list(range(30)) and (found <= edits).all()
