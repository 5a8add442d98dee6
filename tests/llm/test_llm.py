"""The training-data operators against brute force, round trips and odd tables."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from korrel.llm import chat, cotrain, decontaminate, encode, frames, lm, media, packing, simhash, similar, substring, transducer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [(1, ""), (2, None), (3, "one"), (4, " \t\n"), (5, "two words"), (5, "two words"), (6, "Ünï çödé 🙂 " * 30), (7, "x " * 3000), (8, "a b c d e f g h i j k l m n o p q r s t u v w"), (9, "A B C d e f g h i j k l m n o p q r s t u v w y z"), (None, "no id"), (10, "<|endoftext|> tail's end'll  \n\n x")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(i, t, "s1" if k % 3 else None, "x", k, "y", 1) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA + ", source string, fp string, id int, kept string, part int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", source string, lang string, n_chars long")


@pytest.fixture(scope="module")
def prose(spark):
    """Invented prose with copies, near copies and shared passages."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeiourstlnd") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [text(rng.randint(1, 150)) for _ in range(60)]
    passage = text(55)
    for k in range(8):
        docs.append(docs[k])
        words = docs[k + 8].split()
        words[len(words) // 2] = "changed"
        docs.append(" ".join(words))
        docs.append(text(20) + " " + passage + "\n" + text(10))
    rng.shuffle(docs)
    return spark.createDataFrame(list(enumerate(docs)), SCHEMA).repartition(4), docs


# 1 SimHash


def fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fingerprints):
    label = list(range(len(fingerprints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fingerprints)):
        for b in range(a):
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 3:
                label[find(a)] = find(b)
    return [find(k) for k in range(len(fingerprints))]


def wanted_components(rows):
    found = [fingerprint(t) for _, t in rows]
    group = linked(found)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return Counter((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, found, group))


def test_simhash(spark, prose, odd, empty):
    df, docs = prose
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == wanted_components(list(enumerate(docs)))
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == wanted_components(ODD)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, _, c in wanted_components(ODD) if c is not None})


def test_simhash_reads_whole_long_texts():
    long = "word%d " * 5 % (1, 2, 3, 4, 5) * 60_000
    assert simhash.simhash(long) == simhash.simhash(long[:-1]) and len(long) > 1 << 20
    words = long.split()
    counts = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    ones = [sum(n for s, n in counts.items() if xxhash.xxh64_intdigest(" ".join(s).encode(), 42) >> b & 1) for b in range(64)]
    assert simhash.simhash(long) == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_in_dense_buckets(spark, block):
    rng = np.random.default_rng(3)
    found = set(rng.integers(0, 2**63, 30).tolist())
    for center in list(found)[:3]:
        for _ in range(120):
            x = center
            for _ in range(rng.integers(1, 6)):
                x ^= 1 << int(rng.integers(0, 64))
            found.add(x)
    fps = np.array(sorted(found), np.uint64)
    group = linked([int(x) for x in fps])
    wanted = {}
    for x, g in zip(fps.view(np.int64).tolist(), group):
        wanted.setdefault(g, set()).add(x)
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    got = {}
    for r in simhash.components(simhash.links(df, 3, block)).collect():
        got.setdefault(r["root"], set()).add(r["v"])
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in wanted.values() if len(x) > 1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["v"]: r["root"] for r in simhash.components(edges).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# 8 substring dedup


def cut(rows, window=20):
    """By definition; rows of one id and text are one document, null ids come last."""
    order = sorted({(math.inf if i is None else i, t or "") for i, t in rows})
    seen, out = {}, {}
    for i, t in order:
        words = WORDS.findall(t)
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if seen.setdefault(key, (i, t, k)) != (i, t, k):
                gone |= set(range(k, k + window))
        out[(i, t)] = len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)
    return Counter((i, *out[(math.inf if i is None else i, t or "")][:2], hashlib.sha256(out[(math.inf if i is None else i, t or "")][2].encode()).hexdigest()) for i, t in rows)


CUT = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def cut_rows(df, **settings):
    return Counter(map(tuple, substring.dedup_substrings(df, **settings).select(CUT).collect()))


def test_substrings(prose, odd, empty):
    df, docs = prose
    rows = list(enumerate(docs))
    assert cut_rows(df) == cut(rows) and sum(r[2] for r in cut(rows)) > 500
    assert cut_rows(df, window=7) == cut(rows, 7)
    assert cut_rows(odd) == cut(ODD)
    assert substring.dedup_substrings(empty).count() == 0
    whole = substring.cut_documents(odd)
    assert whole.columns == odd.columns and whole.count() == len(ODD)
    with pytest.raises(ValueError):
        substring.dedup_substrings(odd, window=1)


def test_repeats_over_small_batches(spark, prose):
    df, docs = prose
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert cut_rows(df) == cut(list(enumerate(docs)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeats_across_chunks_and_buckets(prose, monkeypatch):
    df, docs = prose
    monkeypatch.setattr(substring, "buckets_for", lambda docs: 13)
    found = df.repartition(7)  # executors have their own modules: chunks are cut by partitions here
    assert cut_rows(found) == cut(list(enumerate(docs)))


def doubled(rows, window=20):
    """Longest repeated window of each text, in doublings; copies of whole texts once."""
    order, first = sorted((i, t or "") for i, t in rows), {}
    for i, t in order:
        first.setdefault(t, i)
    texts = {i: WORDS.findall(t) for i, t in order if first[t] == i}
    longest, length = dict.fromkeys(texts, 0), window
    while True:
        seen = Counter(tuple(w[k : k + length]) for w in texts.values() for k in range(len(w) - length + 1))
        hit = [i for i, w in texts.items() if any(seen[tuple(w[k : k + length])] > 1 for k in range(len(w) - length + 1))]
        if not hit:
            return longest
        longest |= dict.fromkeys(hit, length)
        length *= 2


def test_levels_go_on_until_nothing_repeats(spark, prose):
    df, docs = prose
    rng = random.Random(9)
    long = [f"l{rng.randrange(500)}" for _ in range(700)]
    rows = [*enumerate(docs), (500, " ".join(long)), (501, "start " + " ".join(long)), (502, "again " * 90)]
    found = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    wanted = doubled(rows)
    assert {r["doc_id"]: r["longest_repeat"] for r in found if r["longest_repeat"] is not None} == wanted
    assert wanted[500] == wanted[501] == 640 and wanted[502] == 80 and sum(r["longest_repeat"] is None for r in found) == len(rows) - len(wanted)
    assert Counter(tuple(r[c] for c in CUT) for r in found) == cut(rows)


def test_cut_documents_tell_their_repeats_at_all_levels(spark, prose):
    df, docs = prose
    rng = random.Random(9)
    long = [f"l{rng.randrange(500)}" for _ in range(700)]
    rows = [*enumerate(docs), (500, " ".join(long)), (501, "start " + " ".join(long)), (502, "again " * 90), (503, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = substring.cut_documents(df, longest_col="longest").collect()
    wanted = doubled(rows)
    assert {r["doc_id"]: r["longest"] for r in whole if r["longest"] is not None} == wanted and wanted[500] == wanted[501] == 640
    told = {r["doc_id"]: r for r in substring.dedup_substrings(df).collect()}
    texts = {r["doc_id"]: r for r in substring.dedup_substrings(df, with_text=True).collect()}
    for c in ("n_words", "n_removed", "longest_repeat"):  # of texts that lose nothing too
        assert {i: r[c] for i, r in texts.items()} == {i: r[c] for i, r in told.items()}, c
    for r in whole:
        text = dict(rows)[r["doc_id"]]
        kept = r["text"] if told[r["doc_id"]]["n_removed"] else " ".join(WORDS.findall(text or ""))
        assert hashlib.sha256(kept.encode()).hexdigest() == told[r["doc_id"]]["kept_sha256"] and (told[r["doc_id"]]["n_removed"] or r["text"] == text)
    assert [tuple(r)[:2] for r in sorted(whole)] == sorted(map(tuple, substring.cut_documents(df).collect()))
    with pytest.raises(ValueError):
        substring.cut_documents(df, longest_col="text")


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_alike_by_structure_are_different_words(spark, n):
    one, other = thue_morse(n), thue_morse(n, "ba")
    tail = " ".join(f"t{k}" for k in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"x {one} {tail} {other}")]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert cut_rows(df) == cut(rows)
    check_packing(packing.pack(df.selectExpr("*", "'s' AS source"), BYTE).collect(), rows)
    got = {r["doc_id"]: r["ids_crc32"] for r in frames.id_files(df, BYTE).collect()}
    assert got == {i: zlib.crc32(ids_of(t, 2).tobytes()) for i, t in rows}
    library = Tokenizer.from_file(WORD)
    assert [r["n_tokens"] for r in transducer.token_counts(df, WORD).orderBy("doc_id").collect()] == [len(library.encode(t, add_special_tokens=False).ids) for _, t in rows]


def test_rows_without_an_id_are_told_apart(spark):
    """Two texts whose xxhash64 agree in the last 23 bits, and a copy of one of them."""
    from pyspark.sql import functions as F

    texts = spark.range(12_000).select(F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(22))).alias("t"))
    pair = texts.groupBy(F.xxhash64("t").bitwiseAND(F.lit((1 << 23) - 1)).alias("h")).agg(F.collect_list("t").alias("t")).filter("size(t) > 1").first()["t"][:2]
    rows = [(1, pair[0]), (None, pair[0]), (None, pair[1])]
    assert cut_rows(spark.createDataFrame(rows, SCHEMA).repartition(2)) == cut(rows)


# 3 token counts, 5 packing, 10 token-id files

BYTES, COUNTS = encode.encoder(BYTE), transducer.counter(WORD)
ALPHABET = list("aAstmdrevl'''  \n\t\r\x0b\x1c é1²٣$%<|>.") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'RE", " '", "İ", "ß", "Σ", "🙂", "中", "é", "hello", "THE"]
TEXTS = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(texts):
    library = Tokenizer.from_file(WORD) if not hasattr(test_counts_are_the_librarys, "t") else test_counts_are_the_librarys.t
    test_counts_are_the_librarys.t = library
    assert COUNTS.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(texts):
    ids, first = BYTES.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [x.ids for x in BYTES.library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thaneiorsd", min_size=1, max_size=40))
def test_transducer_is_bpe(word):
    symbols = [chr(b) for b in word.encode()]
    symbols[-1] = chr(256 + ord(symbols[-1]))
    assert COUNTS.pieces.count(word.encode()) == len(COUNTS.pieces.merged("".join(symbols)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=600))
def test_chunk_maps_compose(kinds):
    kinds = [3 if k in (4, 5) else k for k in kinds]
    state, wanted = 0, []
    for k in kinds:
        wanted.append(bool(transducer.BEGINS[state, k]))
        state = transducer.AFTER[state, k]
    assert transducer.beginnings(np.array(kinds, np.uint8)).tolist() == wanted


def test_equal_hashes_are_noticed(monkeypatch):
    texts = ["some words, some more words", "other words entirely", "", "don't  stop"] * 3
    library = Tokenizer.from_file(WORD)
    weak = lambda points, starts, ends: ((ends - starts).astype(np.uint64), (points[starts] + np.uint32(7) * points[ends - 1]).astype(np.uint64))
    monkeypatch.setattr(encode, "piece_hashes", weak)
    monkeypatch.setattr(transducer, "piece_hashes", weak)
    ids, first = encode.Encoder(BYTE).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [x.ids for x in BYTES.library.encode_batch(texts, add_special_tokens=False)]
    one = encode.Encoder(BYTE)  # and between calls
    for text in ("ab", "cd", "ab"):
        assert one.encode([text])[0].tolist() == BYTES.library.encode(text, add_special_tokens=False).ids
    counter = transducer.TokenCounter(WORD)
    for _ in range(2):
        assert counter.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_count_maps_compose_over_chunks_of_any_size(texts, size):
    before, transducer.CHUNK = transducer.CHUNK, size
    try:
        found = COUNTS.counts(texts).tolist()
    finally:
        transducer.CHUNK = before
    assert found == COUNTS.counts(texts).tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thaneiorsd", min_size=2, max_size=60), st.lists(st.integers(1, 59), min_size=1, max_size=6), st.integers(0, 2**16))
def test_composition_is_associative(word, cuts, order):
    edges = sorted({0, len(word), *(c for c in cuts if c < len(word))})
    parts = [word[a:b].encode() for a, b in zip(edges, edges[1:])]
    state, tokens = COUNTS.pieces.run(0, parts[0], len(parts) == 1)
    maps = [transducer.ChunkMap(b"", False, tokens, state)]
    maps += [transducer.ChunkMap(x, k == len(parts) - 2, 0, 0 if k == len(parts) - 2 else None) for k, x in enumerate(parts[1:])]
    while len(maps) > 1:
        k = order % (len(maps) - 1)
        maps[k : k + 2] = [COUNTS.pieces.then(maps[k], maps[k + 1])]
    assert (maps[0].state, maps[0].tokens) == (0, COUNTS.pieces.count(word.encode()))


LONG = "".join(f"word{k % 977}{' ' if k % 5 else chr(10)}The {k}'ll  " for k in range(90_000))


def test_very_long_texts_are_cut(spark):
    """Longer than what any operator holds at a time; the same answers as for whole texts."""
    assert len(LONG) > 3 * max(encode.SLICE, lm.SLICE // 4, 1 << 18)
    library = Tokenizer.from_file(WORD)
    assert COUNTS.counts(["a", LONG]).tolist() == [1, len(library.encode(LONG, add_special_tokens=False).ids)]
    ids, first = BYTES.encode([LONG, "b"])
    assert ids[: first[1]].tolist() == BYTES.library.encode(LONG, add_special_tokens=False).ids and first[2] == len(ids)
    assert list(encode.text_blocks("x" * 50, 9)) == ["x" * 50] and "".join(encode.text_blocks(LONG, 1000)) == LONG


def test_word_runs_cut_long_texts():
    from korrel.llm.common import Words, word_runs

    texts = [b"a b", LONG.encode(), b"", b"tail words"]
    whole = Words(texts)
    wanted = whole.grams(whole.hashes(), 5)
    wanted = [wanted[0][k] for k in np.flatnonzero(wanted[1])]
    found, numbers = [], 0
    for low, high, words in word_runs(texts, 1 << 16, carry=4):
        grams, inside = words.grams(words.hashes(), 5)
        found += grams[inside].tolist()
        numbers += len(words.starts)
    assert found == wanted and numbers == len(whole.starts)


def test_token_counts(odd, empty):
    got = Counter(map(tuple, transducer.token_counts(odd, WORD, limit=100).collect()))
    library = Tokenizer.from_file(WORD)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((i, len((t or "").encode()), count(t), count(t) > 100) for i, t in ODD) and transducer.token_counts(empty, WORD).count() == 0


def ids_of(text, end):
    return np.array([*BYTES.library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_id_files(odd, empty, prose):
    df, docs = prose
    base, wanted = 0, []
    for i, t in enumerate(docs):
        ids = ids_of(t, 2)
        wanted.append((i, base, len(ids), zlib.crc32(ids.tobytes())))
        base += len(ids)
    assert sorted(map(tuple, frames.id_files(df, BYTE).collect())) == wanted
    got = frames.id_files(odd, BYTE).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(ids_of(t, 2)), zlib.crc32(ids_of(t, 2).tobytes())) for i, t in ODD)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist() and got[0]["doc_id"] is None
    assert frames.id_files(empty, BYTE).count() == 0


def test_frames_are_read_one_by_one_and_checked():
    stream = io.BytesIO()
    writer = frames.FrameWriter(stream, 2)
    ids = [np.arange(k * 3, dtype=np.uint32) for k in (0, 5, 2)]
    for k, x in zip((7, None, 9), ids):
        writer.add(k, x)
    size = writer.close()
    assert size == len(stream.getvalue())
    reader = frames.FrameReader(stream)
    assert reader.doc_ids == [7, None, 9] and reader.ids(2).tolist() == ids[2].tolist() and len(reader) == 3 and reader.ids(0).tolist() == []
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stream.getvalue()), read_across_frames=True).read()[:30] == ids[1].astype("<u2").tobytes()
    broken = bytearray(stream.getvalue())
    broken[int(reader.begin[1]) + 8] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.FrameReader(io.BytesIO(bytes(broken))).ids(1)
    with pytest.raises(ValueError):
        frames.FrameReader(io.BytesIO(b"x" * 40))


def check_packing(rows, texts, length=1024):
    by_row = Counter()
    for r in rows:
        by_row[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    total = sum(len(ids_of(t, 0)) for _, t in texts)
    assert sum(r["length"] for r in rows) == total
    for seq in range(max((r["sequence_id"] for r in rows), default=-1) + 1):
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or seq == -(-total // length) - 1
    for i, t in texts:
        ids, at = ids_of(t, 0), 0
        for r in sorted((r for r in rows if r["doc_id"] == i and r["doc_tokens"] == len(ids)), key=lambda r: r["start"]):
            if r["start"] == at:
                assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
                at += r["length"]
        assert at == len(ids)


def test_packing(spark, odd, empty, prose):
    df, docs = prose
    from pyspark.sql import functions as F

    sourced = df.withColumn("source", F.concat(F.lit("s"), F.least(F.col("doc_id") % 7, F.lit(3)).cast("string")))
    rows = packing.pack(sourced, BYTE, length=256, quantum=32, with_ids=True).collect()
    check_packing(rows, list(enumerate(docs)), 256)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    check_packing(packing.pack(odd, BYTE).collect(), ODD)
    assert packing.pack(empty, BYTE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, BYTE, length=1000, quantum=128)


def test_windows_keep_their_mixture(spark, prose):
    from pyspark.sql import functions as F

    df, _ = prose
    sourced = df.withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b"))
    rows = packing.pack(sourced, BYTE, {"a": 0.5, "b": 0.5}, length=256, quantum=32).collect()
    share = Counter()
    for r in rows:
        share[r["sequence_id"]] += r["length"] * (r["source"] == "a")
    # until a's queue is empty; what it has below a block is in the last windows
    until = sum(share.values()) // 128
    assert until > 3 and all(share[seq] == 128 for seq in range(until - 1))


def test_every_target_holds_beyond_the_queues(spark, prose, monkeypatch):
    """More sources than queues: a small source's target holds, and one named '' is a source like others."""
    from pyspark.sql import functions as F

    df, docs = prose
    monkeypatch.setattr(packing, "QUEUES", 2)
    sourced = df.withColumn("source", F.when(F.col("doc_id") % 9 == 0, "rare").when(F.col("doc_id") % 9 == 1, "").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 9)))
    for name in ("rare", ""):
        rows = packing.pack(sourced, BYTE, {name: 0.9}, length=256, quantum=32).collect()
        check_packing(rows, list(enumerate(docs)), 256)
        share = Counter()
        for r in rows:
            share[r["sequence_id"]] += r["length"] * (r["source"] == name)
        until = sum(share.values()) // 256
        assert until > 2 and all(share[seq] >= 224 for seq in range(until - 1)), name
    check_packing(packing.pack(sourced, BYTE, length=256, quantum=32).collect(), list(enumerate(docs)), 256)
    with pytest.raises(ValueError):
        packing.pack(sourced, BYTE, {"a": 1, "b": 1, "c": 1})
    monkeypatch.setattr(packing, "BROADCAST_NUMBERS", 0)
    check_packing(packing.pack(sourced, BYTE, {"rare": 0.9}, length=256, quantum=32).collect(), list(enumerate(docs)), 256)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=6))
def test_schedule_is_deficit_round_robin(queues):
    full, weights = [n for n, _ in queues], [w for _, w in queues]
    schedule = packing.Schedule([n * 8 + 3 for n in full], weights, 8)
    credit, sent, order = [0] * len(full), [0] * len(full), []
    while sent != full:
        for q, w in enumerate(weights):
            credit[q] += w
            if credit[q] >= max(weights):
                credit[q] -= max(weights)
                if sent[q] < full[q]:
                    order.append((q, sent[q]))
                    sent[q] += 1
    if order:
        place = schedule.position(np.array([q for q, _ in order]), np.array([b for _, b in order]))
        assert place.tolist() == [8 * k for k in range(len(order))]


# 4 media


def test_media(odd, empty):
    rows = media.media_digests(odd).collect()
    wanted = []
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        wanted.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media.to_wav(payload)), hashlib.sha256(media.to_wav(payload)).hexdigest()))
    assert Counter(tuple(r)[:7] for r in rows) == Counter(wanted)
    assert len({(r["payload_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows}) and media.media_digests(empty).count() == 0
    full = media.media_features(media.store_texts(odd)).filter("doc_id = 6").first()
    assert len(full["peak_times"]) == len(full["peak_codes"]) > 0 and full["peak_times"] == sorted(full["peak_times"])


def plain_peaks(payload):
    """Pairs of spectral peaks by definition."""
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / 192) for k in range(192)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(97), np.arange(192)) / 192)
    peaks = []
    for at in range(0, len(payload) - 191, 96):
        power = np.abs(turns @ [(payload[at + k] - 128) * window[k] for k in range(192)]) ** 2
        own = [b for b in range(1, 96) if power[b] > power[b - 1] and power[b] >= power[b + 1] and round(power[b], 3) > 0]
        peaks.append(sorted(own, key=lambda b: (-round(power[b], 3), b))[:3])
    pairs = [(t, b << 16 | peaks[t + gap][0] << 8 | gap) for t, own in enumerate(peaks) for b in own for gap in (1, 2, 3) if t + gap < len(peaks) and peaks[t + gap]]
    return sorted(pairs)


def test_fingerprints_by_definition(prose):
    stored, found = media.store_media(prose[0])
    held = {r["doc_id"]: (r["n_bytes"], r["media"]) for r in stored.collect()}
    rows = found.collect()
    said = {r["doc_id"]: r["feature"] for r in media.digests(found).collect()}
    for r in rows:
        payload = media.from_wav(bytes(held[r["doc_id"]][1]))
        wanted = plain_peaks(payload)
        assert list(zip(r["peak_times"], r["peak_codes"])) == wanted
        times, codes = (np.array([x[k] for x in wanted], np.int32) for k in (0, 1))
        assert said[r["doc_id"]] == f"{len(wanted)}:{hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()[:32]}"
    assert sum(len(r["peak_times"]) for r in rows) > 1000


def test_peaks_find_a_tone():
    t = np.arange(192 * 6)
    samples = (128 + 90 * np.sin(2 * np.pi * 24 * t / 192)).astype(np.uint8)
    assert (media.spectral_peaks(samples)[:, 0] == 24).all() and media.spectral_peaks(np.full(192, 128, np.uint8)).max() == -1
    assert media.from_wav(media.to_wav(b"\x00\xff" * 96)) == b"\x00\xff" * 96


# 7 preferences


def test_preferences(spark):
    pairs = [
        (1, [("system", "s"), ("user", "q"), ("assistant", "good")], [("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", "why")]), (2, [("user", "a")], [("user", "a")]), (3, None, [("assistant", "x")]), (4, [], []), (4, [], []), (5, [("user", None)], [("user", None), ("assistant", "é")]),
    ]
    df = spark.createDataFrame(pairs, "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    rows = {r["pair_id"]: r for r in chat.format_preferences(df).collect()}
    one = rows[1]
    assert one["n_shared"] == 2 and one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n" and one["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["bad<|end|>\n"]
    assert rows[2]["n_shared"] == 1 and rows[2]["chosen"] == "" and rows[2]["chosen_spans"] == [] and rows[3]["n_shared"] == 0 and rows[3]["chosen"] == "" and rows[4]["prompt"] == "" and rows[5]["n_shared"] == 1
    turns = [(0, 0, "user", "q<|end|>"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", None), (2, 0, "assistant", "alone"), (None, 0, "user", "x"), (5, 0, None, "no answer")]
    found = {r["pair_id"]: r for r in chat.preference_table(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(found) == {0, 1} and found[0]["prompt"] == "<|user|>\nq< |end|><|end|>\n" and found[0]["rejected_spans"] == "14-22"
    assert chat.preference_table(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_preferences_sql(spark, small):
    import duckdb

    from tests.oracle import same

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    same(chat.preference_table(spark.read.parquet(f"{small}/conversations.parquet")), con, chat.PREFERENCE_SQL)


# 9 language models


def plain_losses(rows, target):
    """Background and target loss of each row, its own words taken out of both models."""
    tokens = [(i, WORDS.findall((t or "").translate(LOWER))) for i, t in rows]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, words in tokens:
        for k in (0, 1) if i in target else (0,):
            uni[k].update(words)
            bi[k].update(zip(words, words[1:]))
    vocabulary, out = len(uni[0]), []
    for i, words in tokens:
        own = [Counter(words), Counter(zip(words, words[1:]))]
        inside = (1, int(i in target))
        said = [sum(uni[k].values()) - inside[k] * len(words) for k in (0, 1)]
        losses = []
        for k in (0, 1):
            scale = said[1] / said[0] if k == 0 and said[0] and said[1] else 1
            loss = 0.0
            for before, w in zip([None, *words], words):
                p = (scale * (uni[k][w] - inside[k] * own[0][w]) + lm.ADDED) / (scale * said[k] + lm.ADDED * vocabulary)
                seen = uni[k][before] - inside[k] * own[0][before] if before is not None else 0
                if seen:
                    p = lm.MIX * (bi[k][(before, w)] - inside[k] * own[1][(before, w)]) / seen + (1 - lm.MIX) * p
                loss -= math.log(p)
            losses.append(loss / len(words) if words else -1.0)
        out.append((-1 if i is None else i, len(words), *losses))
    return out


def test_cross_entropy(spark, odd, empty, prose, monkeypatch):
    df, docs = prose
    none = lambda x: -1 if x is None else x
    for limit in (1 << 20, 0):
        monkeypatch.setattr(lm, "BROADCAST_IDS", limit)
        for rows, frame in ((list(enumerate(docs)), df), (ODD, odd)):
            target = {1, 3, 5, 8, 12}
            ids = spark.createDataFrame([(i,) for i in [*target, None, 999, 1]], "doc_id long")
            found = [(none(r["doc_id"]), r["n_words"], none(r["background_loss"]), none(r["target_loss"])) for r in lm.cross_entropy_difference(frame, ids).collect()]
            assert np.allclose(sorted(found), sorted(plain_losses(rows, target)), rtol=0, atol=1e-6)
    nobody = spark.createDataFrame([], "doc_id long")
    assert lm.cross_entropy_difference(empty, nobody).count() == 0 and lm.cross_entropy_difference(odd, nobody).count() == len(ODD)


def test_losses_of_a_long_text(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 1 << 10)
    rows = [(0, LONG[:30_000]), (1, LONG[7000:9000]), (2, "The word5 other")]
    texts, marked = [t.encode() for _, t in rows], np.array([True, False, True])
    keys, *totals = lm._summary(texts, marked)
    words = (keys & np.uint64(2)) != 0
    size, losses = lm._scores(texts, marked, keys, totals, (*(int(x[words].sum()) for x in totals), int(words.sum())))
    wanted = plain_losses(rows, {0, 2})
    assert size.tolist() == [x[1] for x in wanted] and np.allclose(np.array(losses) / size, np.array([x[2:] for x in wanted]).T, atol=1e-9)


# 6 classifier


def test_co_training(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        good, toxic = rng.random() < 0.7, rng.random() < 0.15
        words = [rng.choice("the of and to in for with on at by from it is was be".split()) + rng.choice("abcdefgh") for _ in range(rng.randint(20, 80))]
        if not good:
            words = [w + rng.choice(["%%%", "$$$", "###"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["vile", "scum", "trash"]))
        text = " ".join(words)
        rows.append((i, text, "en", "spam.example" if not good and rng.random() < 0.7 else "site%d" % (i % 5), len(text)))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (-1, "", "en", "x", 0), (5, rows[5][1], "en", "x", 1)], SCHEMA + ", lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:450], "doc_id long, quality int, toxic int")
    scored = cotrain.classify(docs, known)
    found = {r["doc_id"]: r for r in scored.collect()}
    held = labels[450:]
    assert sum((found[i]["p_quality"] >= 0.5) == bool(q) for i, q, _ in held) >= 0.95 * len(held)
    assert sum((found[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in held) >= 0.95 * len(held)
    assert scored.count() == 703 and scored.columns == ["doc_id", "p_quality", "p_toxic", "keep"]
    kept = cotrain.keep_good(docs, cotrain.train(docs, known))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored.collect() if r["keep"]}
    nothing = cotrain.classify(docs, known.limit(0)).collect()
    assert all(r["keep"] and r["p_quality"] == 1.0 and r["p_toxic"] == 0.0 for r in nothing)
    assert cotrain.classify(empty, known).count() == 0


def test_labelled_documents_beyond_the_sample_are_not_unlabelled(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "SAMPLE", 60)
    docs = spark.createDataFrame([*((i, f"text{i} of{i} its{i} own{i}", "en", "x", 9) for i in range(300)), (None, "no id", "en", "x", 5), (None, "nor this", "en", "x", 5)], SCHEMA + ", lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(290)], "doc_id long, quality int, toxic int")
    features = cotrain._features(docs, "doc_id", "text", cotrain.META)
    sample = cotrain._sample(features, labels)
    assert sample.num_rows == 60 and set(sample["quality"].to_pylist()) == {0, 1}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(cotrain, "BROADCAST_IDS", limit)
        assert cotrain._unlabelled(features, labels).count() == 12


def test_repeated_and_null_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(7 if i % 2 else None, f"same text {i % 3}", "en", "x", 9, i, "e", 1) for i in range(400)], SCHEMA + ", lang string, source string, n_chars long, id int, exact string, sign int")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    features = cotrain._features(docs, "doc_id", "text", cotrain.META)
    sample = cotrain._sample(features, labels)
    assert sample.num_rows == 1 and sample["quality"].to_pylist() == [0]
    assert cotrain._unlabelled(features, labels).count() == 3
    assert cotrain.classify(docs, labels).count() == 400


def test_views_teach_each_other(spark):
    """Words that no labelled document has are learned from the source, and a source from words."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.5
        words = [rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("aeiou") for _ in range(30)]
        if i < 700:  # labelled: sources tell, and some words do
            words += ["fine" if good else "awful"] * 2
            source = "good.example" if good else "bad.example"
            labels.append((i, int(good), 0))
        elif i < 1100:  # sources tell; new words come with them
            words += ["novel" if good else "unheard"] * 2
            source = "good.example" if good else "bad.example"
        else:  # words tell; new sources come with them
            words += ["fine" if good else "awful"] * 2
            source = "new-good.example" if good else "new-bad.example"
        rows.append((i, " ".join(words), "en", source, 100))
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long")
    models = cotrain.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    counted = [v.models[1] for v in models.views]

    def weight(v, name):
        at = np.flatnonzero(counted[v].names == name)
        return float(counted[v].weights[at[0]]) if len(at) else 0.0

    word = lambda x: int(cotrain.text_features([x.encode()])[1][0])
    page = lambda x: int(cotrain.meta_features({"source": [x]})[1][0])
    assert weight(0, word("novel")) > 1 and weight(0, word("unheard")) < -1
    assert weight(1, page("new-good.example")) > 1 and weight(1, page("new-bad.example")) < -1
    assert models.targets["toxic"].combine is None and models.targets["toxic"].constant == 0.0


def test_features_of_long_texts():
    whole = cotrain.text_features([LONG.encode(), b"", b"A a a b a b"])
    before, cotrain.SLICE = cotrain.SLICE, 1 << 14
    try:
        cut_up = cotrain.text_features([LONG.encode(), b"", b"A a a b a b"])
    finally:
        cotrain.SLICE = before
    assert all((a == b).all() for a, b in zip(whole, cut_up))
    lists = cotrain._steps(whole, 3)
    assert all((a == b).all() for a, b in zip(cotrain._pairs(lists), whole)) and all(len(x) for x in cotrain._pairs(lists.slice(1)))


# 2 decontamination


def edit_distance_in(item, words):
    row = [0] * (len(words) + 1)
    for k, x in enumerate(item):
        new = [k + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def test_leaks(spark, odd, empty):
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 14, 25, 40, 70])))) for k in range(40)]
    docs = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 2:
            passage = items[i % 40][1].split()
            for _ in range(0 if i % 4 == 1 else int(0.15 * len(passage))):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," if rng.random() < 0.3 else w for w in passage]
        docs.append((i, "  ".join(words)))
    wanted = {}
    for i, t in docs:
        for k, item in items:
            d = edit_distance_in(plain_words(item), plain_words(t))
            if d <= int(decontaminate.EDITS * len(item.split())):
                wanted[(i, k)] = d
    df, bench = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([*items, (99, None), (98, "too short"), (None, items[0][1])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(found) <= set(wanted) and len(found) >= 0.93 * len(wanted)
    assert {k for k, d in wanted.items() if d == 0} <= {k for k, d in found.items() if d == 0}
    clean = decontaminate.without_leaks(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in found}
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.without_leaks(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == 160


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Unique"), (2, "two words"), (3, "three of them"), (4, "now there are four"), (5, "中文句子在这里出现"), (None, "nameless item here today friends")]
    docs = [(10, "a UNIQUE thing"), (11, "the two, words!"), (12, "twowords two other words"), (13, "three of them now there are four"), (14, "前面中文句子在这里出现后面"), (15, "nameless item here today friends"), (16, None), (17, "")]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["start_word"], r["n_edits"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert found == {(10, 1, 1, 0), (11, 2, 1, 0), (13, 3, 0, 0), (13, 4, 3, 0), (14, 5, 2, 0)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()} == {12, 16, 17}


def test_leaks_in_long_texts(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 1 << 12)
    rng = random.Random(6)
    items = [" ".join(f"i{k}x{j}" for j in range(n)) for k, n in enumerate((3, 9, 40, 300))]
    words = [f"w{rng.randrange(900)}" for _ in range(20_000)]
    places = {}
    for k, item in sorted(enumerate(items), reverse=True):
        for at in (1500 + 997 * k, 9000 + 701 * k):
            words[at:at] = item.split()
    text = " ".join(words)
    for k, item in enumerate(items):
        places[k] = words.index(item.split()[0])
    rows, begin, count = decontaminate.word_rows([x.encode() for x in items])
    held = [rows[a : a + n] for a, n in zip(begin, count)]

    class Held:
        value = decontaminate.build_index(held), held, np.arange(4)

    found = [(int(d), int(i), int(e), int(s)) for part in decontaminate._hits([b"x", text.encode(), b"y"], Held) for d, i, e, s, _ in zip(*part)]
    assert sorted(found) == [(1, k, 0, places[k]) for k in range(4)]


@pytest.mark.parametrize("length", [400, 600, 900, 1300])
def test_long_edited_items_are_found(length):
    rng = np.random.default_rng(length)
    words = lambda n: rng.integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    items, edits = [words(length) for _ in range(60)], int(decontaminate.EDITS * length)
    texts = [np.concatenate([words(rng.integers(0, 300)), decontaminate._edited(x, edits, rng), words(rng.integers(0, 9))]) for x in items]
    count = np.array([len(x) for x in texts])
    begin = np.cumsum(count + 1) - count - 1
    rows = np.concatenate([y for x in texts for y in (x, [np.uint64(0)])]).astype(np.uint64)
    doc, item, found, _ = decontaminate._search(decontaminate.build_index(items), items, rows, begin, count)
    assert (doc == item).all() and (found <= edits).all() and len(doc) >= 0.97 * len(items)


def test_missed_target_is_reported(monkeypatch):
    monkeypatch.setattr(decontaminate, "TARGET", 1.01)
    monkeypatch.setattr(decontaminate, "MANY", 4)
    with pytest.warns(UserWarning, match="of edited ones found"):
        decontaminate.build_index([np.arange(1, 41, dtype=np.uint64)])


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(12))) for k in range(30)]
    docs = [(k, "before " + t + " after") for k, t in items]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_edits"]) for r in found) == [(k, k, 1, 0) for k in range(30)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(1, 4), max_size=14))
def test_alignment(item, words):
    texts = np.array([[*words, 0]], np.uint64)
    best, _ = decontaminate.edit_distances(np.array([item], np.uint64), np.array([len(item)]), texts)
    assert best[0] == edit_distance_in(item, words)


# the pipeline


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        done = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert done.columns == columns and 0 < done.count() <= before, name
            if k == 1:
                group = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs).collect()}
                assert {r["doc_id"] for r in done.collect()} == set(group.values()) and done.count() == len(set(group.values()))
            if k == 2:
                removed = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(docs).collect()}
                texts = {r["doc_id"]: r["text"] for r in docs.collect()}
                for r in done.collect():
                    assert (r["text"] == texts[r["doc_id"]]) == (removed[r["doc_id"]] == 0) and (removed[r["doc_id"]] == 0 or r["n_chars"] == len(r["text"]))
            if k == 3:
                bench = spark.read.parquet(f"{small}/benchmark.parquet")
                leaks = {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()}
                assert {r["doc_id"] for r in done.collect()} == {r["doc_id"] for r in docs.collect()} - leaks
        else:
            check_packing(done.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
        docs, before = done, done.count()
    assert corpus_pipeline.ORACLE_SQL is None


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("few", [16, 3])
def test_similar_documents_are_all_that_share_enough(spark, prose, empty, monkeypatch, few):
    rng = random.Random(8)
    docs = list(prose[1])
    for k in range(60):  # chains of edits: similarity on both sides of 0.8
        words = docs[rng.randrange(len(docs))].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(["new", "other", "words"])
        docs.append(" ".join(words))
    rows = [*enumerate(docs), *((1000 + k, t) for k, (_, t) in enumerate(ODD))]
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0:
                label = [label[b] if x == label[a] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(i, least.get(x, i))
    wanted = {i: least[x] for (i, _), x in zip(rows, label)}
    default = similar.similar_sets
    monkeypatch.setattr(similar, "similar_sets", lambda *r: default(*r, few))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()} == wanted
    assert similar.similar_documents(empty).count() == 0


def test_one_of_each_row(spark, odd, prose, empty):
    kept = similar.one_of_each(odd)
    assert kept.columns == odd.columns and similar.one_of_each(empty).count() == 0
    rows = [tuple(r) for r in kept.collect()]
    every = [tuple(r) for r in odd.collect()]
    assert set(rows) <= set(every) and sorted(r[0] for r in rows if r[0] is not None) == [1, 3, 5, 6, 7, 8, 10] and sum(r[0] is None for r in rows) == 1
    texts = spark.createDataFrame([(1, prose[1][0] * 3), (1, "quite another text of this id"), (2, prose[1][0] * 3), (None, prose[1][0] * 3), (None, "a text without any id at all")], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"][:9]) for r in similar.one_of_each(texts).collect()) == sorted([(1, prose[1][0][:9]), (1, "quite ano"), (0, "a text wi")])


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    """What no order brings side by side is found among all pairs of blocks."""
    from pyspark.sql import functions as F

    rng = random.Random(21)
    common = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for k in range(40):
        own = common[:30] + [f"own{k}x{j}" for j in range(30)]
        texts += [" ".join(own), " ".join([*own[:-1], "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    default = similar.similar_sets
    wanted = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert len(set(wanted.values())) == 40
    monkeypatch.setattr(similar, "_neighbours", lambda met, *order: met.withColumn("prev", F.struct(*met.columns)).filter("false"))
    monkeypatch.setattr(similar, "similar_sets", lambda *r: default(*r, 0))
    monkeypatch.setattr(similar, "BLOCK", 3)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()} == wanted


def test_what_many_texts_share_makes_no_pairs(spark, monkeypatch):
    """Texts with a long passage in common meet in large buckets; those that aren't similar aren't paired there."""
    rng = random.Random(22)
    common = [f"w{rng.randrange(10**6)}" for _ in range(45)]
    texts = [" ".join([*common, *(f"own{k}x{j}" for j in range(20))]) for k in range(240)]
    texts += [x + " end" for x in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, keep = [], similar.keep

    def counted(df, name):
        kept = keep(df, name)
        if name == "similar-pairs":
            made.append(kept.count())
        return kept

    monkeypatch.setattr(similar, "keep", counted)
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert found == {k: k - 240 if k >= 240 else k for k in range(250)}
    assert made[-1] < 250


def kept_tables(spark):
    from pathlib import Path

    from korrel.llm.common import shared_dir

    return {x.name for x in Path(shared_dir(spark).removeprefix("file:")).glob("korrel-*")}


def test_stages_leave_what_their_result_reads(spark, small, tmp_path):
    import corpus_pipeline

    docs, left = spark.read.parquet(f"{small}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = kept_tables(spark)
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        left.append(sorted(x.removeprefix("korrel-")[:-33] for x in kept_tables(spark) - before))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert left == [[], ["similar-chunks", "similar-rooted"], ["repeats", "repeats-told", "substring-chunks", "substring-firsts"]]


def test_pipeline_leaves_its_last_stages(spark, small):
    import corpus_pipeline

    before = kept_tables(spark)
    rows = corpus_pipeline.run(spark, small).count()
    left = sorted(x.removeprefix("korrel-")[:-33] for x in kept_tables(spark) - before)
    assert rows and [x for x in left if x.startswith(("stage-", "similar-", "substring-"))] == ["stage-benchmark-decontamination"]


def test_alone_keeps_its_result(spark):
    from korrel.llm.common import alone, keep

    @alone
    def inner():
        keep(spark.range(3), "passing")
        return keep(spark.range(5), "stays")

    @alone
    def outer(fault=None):
        found = inner()
        if fault:
            raise fault
        return keep(found.filter("id > 1"), "last")

    before = kept_tables(spark)
    assert inner().count() == 5 and outer().count() == 3
    with pytest.raises(KeyError):
        outer(KeyError("x"))
    with pytest.raises(ValueError):
        alone(lambda: keep(spark.range(2), "lost").filter("id > 0"))()
    assert sorted(x[:-33] for x in kept_tables(spark) - before) == ["korrel-last", "korrel-stays"]


def test_kept_tables_leave_no_shuffle_files(spark):
    import time

    from korrel.llm.common import keep

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(k).getName() for k in range(found.size()))
        return {x for x in names if x.startswith("shuffle_")}

    before = files()
    kept = keep(spark.range(1000).repartition(3, "id").groupBy("id").count(), "dealt")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert kept.count() == 1000 and not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
