"""Benchmark decontamination: documents with a passage within a small edit distance of a benchmark item.

A random walk over the words of an item-sized window (CGK) turns edit distance into Hamming distance: at each
step it puts out the word it stands on and, as a random bit of that word and step says, moves on or stays; walks
that differ by an edit soon stand on the same words again. Bit-sampling LSH compares a few random steps of the
walks, again and again with other samples and walks until edited items are found at the target rate. What meets
is aligned exactly. Words are compared, not characters, so case, punctuation and white space don't matter.

Windows begin every ``stride`` words of a document, so items are indexed from each of their first ``stride``
words. Items of more than PIECE words are looked for by pieces: of an item within EDITS at least one piece is, and
the whole item is aligned about it. Items of fewer than LEAST_WORDS words have no edits and are looked up whole.
Items come in blocks of bounded size, each held against all documents where they lie: no shuffle.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import Words, blocks, mix, run_hash, slices, texts_of, tidied

#: Share of an item's words that may be edited, and the fewest words of an item that can have an edit.
EDITS, LEAST_WORDS = 0.2, 5
#: Steps sampled at once, walks, and the share of edited items to be found.
SAMPLED, WALKS, TARGET = 3, 4, 0.97
#: Words up to which a few samples reach TARGET, and samples of each walk after which missing it is reported.
PIECE, MANY = 243, 96
#: Items of one block, which bounds the index that is broadcast: some 500 bytes a word of stride and item.
ITEMS = 2000
SLICE = 1 << 21
_BREAKS = np.array([not (b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Characters of scripts that put no space between words, in UTF-8: each is a word. Thai, Lao, Myanmar, Khmer, kana, Han.
_ALONE = re.compile(
    rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]"
    rb"|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xaf][\x80-\xbf]{2}"
)


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes with a zero behind each text; where each text begins there; how many words it has."""
    words = Words([x if x.isascii() else _ALONE.sub(rb" \g<0> ", x) for x in texts], _BREAKS, _LOWER)
    count = np.diff(words.first)
    rows = np.zeros(len(words.starts) + len(texts) + 1, np.uint64)
    rows[np.arange(len(words.starts)) + words.doc] = words.hashes() | np.uint64(1)
    return rows, words.first[:-1] + np.arange(len(texts)), count


@dataclass
class SizeClass:
    """Items of about one size: where their windows begin, and the steps that are looked at."""

    least: int
    stride: int
    walks: list[list[np.ndarray]]  # for each walk the samples, each some steps
    keys: list[np.ndarray] | None = None  # for each walk and sample: sorted keys
    owners: list[np.ndarray] | None = None  # and their items (times the stride, plus the first word's number)
    maps: list[np.ndarray] | None = None  # and a bit table that most other keys miss
    recall: float = 1.0  # of edited items, as measured
    #: where the samples miss TARGET, for each length of part: sorted hashes, their pieces and places there
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None


def _odd(seed: int, count: int) -> np.ndarray:
    return mix(np.arange(count, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def walk_keys(rows: np.ndarray, starts: np.ndarray, size: SizeClass):
    """For each walk and sample the windows' keys. Behind a text's end the walk stands on zero and stays."""
    for walk, samples in enumerate(size.walks):
        steps = int(max(s.max() for s in samples)) + 1
        odd = _odd(1000 + walk, steps)
        needed = {int(k) for s in samples for k in s}
        at, seen = starts.copy(), {}
        for k in range(steps):
            word = rows[at]
            if k in needed:
                seen[k] = word
            at += (word * odd[k] >> np.uint64(63)).view(np.int64)
        for sample in samples:
            key = np.zeros(len(starts), np.uint64)
            for k in sample.tolist():
                key = (key ^ seen[k]) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
            yield key


def _window_starts(begin: np.ndarray, count: np.ndarray, size: SizeClass) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in rows) of the windows of all texts: those with room for most of an item."""
    room = count - (size.least - int(EDITS * size.least)) + size.stride
    number = np.maximum(0, -(-room // size.stride))
    text = np.repeat(np.arange(len(begin)), number)
    return text, begin[text] + size.stride * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))


def _sampled(least: int, stride: int, count: int, seed: int) -> list[list[np.ndarray]]:
    """Samples of each walk's steps; the first of each from steps at which no walk can have left the item."""
    rng = np.random.default_rng(seed)
    sure, far = max(2, least - stride), max(3, int(1.6 * (least - stride)))
    pick = lambda top: np.sort(rng.choice(top, min(SAMPLED, top), replace=False))
    return [[pick(sure) if not k else pick(far) for k in range(count)] for _ in range(WALKS)]


def _edited(words: np.ndarray, edits: int, rng) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        new = int(rng.integers(1, 1 << 62)) | 1
        out[at : at + (kind > 0)] = [] if kind == 2 else [new]
    return np.array(out, np.uint64)


def _index(size: SizeClass, items: list[np.ndarray]) -> None:
    rows, starts, owners = [], [], []
    at = 0
    for k, words in enumerate(items):
        rows += [words, [np.uint64(0)]]
        shifts = np.arange(min(size.stride, len(words)))
        starts.append(at + shifts)
        owners.append(k * size.stride + shifts)
        at += len(words) + 1
    rows, starts, owners = np.concatenate(rows).astype(np.uint64), np.concatenate(starts), np.concatenate(owners)
    size.keys, size.owners, size.maps = [], [], []
    for key in walk_keys(rows, starts, size):
        order = np.argsort(key, kind="stable")
        size.keys.append(key[order])
        size.owners.append(owners[order])
        bits = np.zeros(1 << max(10, int(16 * len(key)).bit_length()), bool)
        bits[(key >> np.uint64(20)) & np.uint64(len(bits) - 1)] = True
        size.maps.append(bits)


def _met(size: SizeClass, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, owner) pairs with an equal key, each once."""
    found = []
    for key, keys, owners, bits in zip(walk_keys(rows, starts, size), size.keys, size.owners, size.maps):
        maybe = np.flatnonzero(bits[(key >> np.uint64(20)) & np.uint64(len(bits) - 1)])
        low, high = (np.searchsorted(keys, key[maybe], side) for side in ("left", "right"))
        number = high - low
        window = np.repeat(maybe, number)
        at = np.arange(len(window)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)
        found.append((window << 32) | owners[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _parted(items: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items cut into one part more than they can have edits: in any passage one of the parts is unchanged."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, words in enumerate(items):
        cuts = int(EDITS * len(words)) + 1
        edges = [len(words) * j // cuts for j in range(cuts + 1)]
        for a, b in zip(edges, edges[1:]):
            found.setdefault(b - a, []).append((int(run_hash(words[a:b], b - a)[0]), k, a))
    out = {}
    for n, some in found.items():
        keys, item, at = np.array([x[0] for x in some], np.uint64), *(np.array([x[j] for x in some], np.int64) for j in (1, 2))
        order = np.argsort(keys, kind="stable")
        out[n] = keys[order], item[order], at[order]
    return out


def _unchanged(size: SizeClass, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in rows, piece, first word of the part) wherever a part of a piece stands."""
    found = []
    for n, (keys, item, first) in size.parts.items():
        every = run_hash(rows, n)
        low, high = (np.searchsorted(keys, every, side) for side in ("left", "right"))
        at = np.flatnonzero(high > low)
        number = (high - low)[at]
        k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low[at], number)
        found.append((np.repeat(at, number), item[k], first[k]))
    return tuple(np.concatenate([x[j] for x in found]) for j in range(3))


def _recall(size: SizeClass, items: list[np.ndarray], rng) -> float:
    """The share found of items edited as far as they may be, among words of their own."""
    some = np.resize(rng.permutation(len(items)), 60)
    rows, begin, count, at = [], [], [], 0
    for k in some.tolist():
        body = _edited(items[k], int(EDITS * len(items[k])), rng)
        noise = [rng.integers(1, 1 << 62, rng.integers(0, n + 1), dtype=np.int64).astype(np.uint64) | np.uint64(1) for n in (2 * size.stride, 8)]
        text = np.concatenate([noise[0], body, noise[1], [np.uint64(0)]])
        rows.append(text)
        begin.append(at)
        count.append(len(text) - 1)
        at += len(text)
    text, starts = _window_starts(np.array(begin), np.array(count), size)
    window, owner = _met(size, np.concatenate(rows).astype(np.uint64), starts)
    return len(np.unique(text[window][some[text[window]] == owner // size.stride])) / len(some)


def _pieces(count: int) -> list[tuple[int, int]]:
    edges = [count * k // -(-count // PIECE) for k in range(-(-count // PIECE) + 1)]
    return list(zip(edges, edges[1:]))


def build_index(items: list[np.ndarray]) -> list[tuple[SizeClass, np.ndarray, np.ndarray]]:
    """Size classes of the pieces of ``items`` (hashed words), each with its pieces' items and places there.

    Samples are added until TARGET is met. A class that misses it with MANY is reported by a warning, and searched
    exactly besides: by the parts of its pieces that no allowed number of edits can all change.
    """
    cuts = [(k, a, b) for k, x in enumerate(items) for a, b in _pieces(len(x))]
    source, offset = (np.array([c[j] for c in cuts], np.int64) for j in (0, 1))
    items = [items[k][a:b] for k, a, b in cuts]
    sizes = np.array([len(x) for x in items], np.int64)
    found, least = [], LEAST_WORDS
    while len(sizes) and least <= sizes.max():
        most = max(least + 1, int(least * 1.5))
        own = np.flatnonzero((sizes >= least) & (sizes < most))
        if len(own):
            stride = 1 << max(0, int(least // 3).bit_length() - 1)
            rng = np.random.default_rng(least)
            chosen = [items[k] for k in own.tolist()]
            for count in range(4, MANY + 1, 4):
                size = SizeClass(least, stride, _sampled(least, stride, count, least))
                _index(size, chosen)
                size.recall = _recall(size, chosen, rng)
                if size.recall >= TARGET:
                    break
            else:
                warnings.warn(f"items of {least} to {most - 1} words: {size.recall:.2f} of edited ones found by samples, not {TARGET}; they are searched by unchanged parts too", stacklevel=2)
                size.parts = _parted(chosen)
            found.append((size, source[own], offset[own]))
        least = most
    return found


def edit_distances(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest word edits between each item and any run of its text's words, and where that run ends.

    Rows of ``items`` and ``texts`` are pairs, filled up with zeros; zeros of texts equal nothing.
    """
    count, width = texts.shape
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((count, width + 1), np.int32)
    best, ends = np.zeros(count, np.int32), np.zeros(count, np.int64)
    for k in range(items.shape[1]):
        differ = (texts != items[:, k : k + 1]) | (texts == 0)
        new = np.empty_like(row)
        new[:, 0] = k + 1
        np.minimum(row[:, :-1] + differ, row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = np.flatnonzero(lengths == k + 1)
        ends[done] = row[done].argmin(axis=1)
        best[done] = row[done].min(axis=1)
    return best, ends


def _short(items: list[np.ndarray], rows: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """What ``_search`` finds of items that can have no edit."""
    lengths, found = np.array([len(x) for x in items], np.int64), []
    for n in range(1, LEAST_WORDS):
        own = np.flatnonzero(lengths == n)
        if not len(own):
            continue
        words = np.array([items[k] for k in own.tolist()], np.uint64)
        keys = np.array([run_hash(x, n)[0] for x in words], np.uint64)
        order = np.argsort(keys, kind="stable")
        every = run_hash(rows, n)
        low, high = (np.searchsorted(keys[order], every, side) for side in ("left", "right"))
        at = np.flatnonzero(high > low)
        number = (high - low)[at]
        item = order[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low[at], number)]
        at = np.repeat(at, number)
        same = (rows[at[:, None] + np.arange(n)] == words[item]).all(axis=1)
        at, item = at[same], own[item[same]]
        doc = np.searchsorted(begin, at, "right") - 1
        found.append(np.stack([doc, item, np.zeros(len(at), np.int64), at - begin[doc]]))
    return found


def _best(found: list[np.ndarray]) -> np.ndarray:
    """Of each text and item the row with the fewest edits, the earliest of those."""
    if not found:
        return np.zeros((4, 0), np.int64)
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort(every[::-1])]
    new = np.ones(every.shape[1], bool)
    new[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    return every[:, new]


def _search(index, items: list[np.ndarray], rows: np.ndarray, begin: np.ndarray, count: np.ndarray):
    """(text, item, edits, first word) of each text's best passage for each item that it has within EDITS."""
    lengths = np.array([len(x) for x in items], np.int64)
    marks = np.zeros((len(items), 1024), bool)  # which words an item may have
    marks[np.repeat(np.arange(len(items)), lengths), (np.concatenate([*items, rows[:0]]) >> np.uint64(40) & np.uint64(1023)).astype(np.int64)] = True
    found = _short(items, rows, begin)
    # the places of a long item are taken together, as each of its alignments is dear
    grid = np.where(lengths > PIECE, np.maximum(1, (EDITS * lengths).astype(np.int64)), 1)
    for size, own, offset in index:
        text, starts = _window_starts(begin, count, size)
        window, owner = _met(size, rows, starts)
        item, shift = own[owner // size.stride], owner % size.stride
        doc, place = text[window], starts[window] - shift - offset[owner // size.stride]
        if size.parts is not None:
            at, piece, word = _unchanged(size, rows)
            doc, item = np.concatenate([doc, np.searchsorted(begin, at, "right") - 1]), np.concatenate([item, own[piece]])
            place = np.concatenate([place, at - word - offset[piece]])
        place = place // grid[item] * grid[item]
        pairs = np.unique(np.stack([doc, item, place]), axis=1) if len(doc) else np.zeros((3, 0), np.int64)
        some = max(1, min(2000, 2000 * PIECE // int(lengths[own].max())))
        for low in range(0, pairs.shape[1], some):
            doc, item, place = pairs[:, low : low + some]
            n = lengths[item]
            slack = (EDITS * n).astype(np.int64)
            more = np.where(n > PIECE, int(EDITS * PIECE) + 1, 0)  # a piece may lie as far off in its window
            first = np.maximum(begin[doc], place - slack - size.stride - more)
            stop = np.minimum((begin + count)[doc], place + grid[item] - 1 + n + slack + size.stride + more)
            reach = first[:, None] + np.arange(int((stop - first).max()))
            texts = np.where(reach < stop[:, None], rows[np.minimum(reach, len(rows) - 1)], np.uint64(0))
            # all but the edited words of an item are in its passage
            shared = marks[item[:, None], (texts >> np.uint64(40) & np.uint64(1023)).astype(np.int64)] & (texts != 0)
            near = np.flatnonzero(shared.sum(axis=1) >= n - slack)
            doc, item, n, slack, first, texts = (x[near] for x in (doc, item, n, slack, first, texts))
            if not len(near):
                continue
            wanted = np.zeros((len(item), int(n.max())), np.uint64)
            for k in np.unique(item).tolist():
                wanted[item == k, : lengths[k]] = items[k]
            edits, ends = edit_distances(wanted, n, texts)
            hit = np.flatnonzero(edits <= slack)
            start = np.maximum(0, first[hit] - begin[doc[hit]] + ends[hit] - n[hit])
            found.append(np.stack([doc[hit], item[hit], edits[hit], start]))
    return _best(found)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, with_null: bool):
    """The items in blocks of at most ITEMS rows, in the order of their ids."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows if with_null else rows.filter("id is not null")
    blocks = -(-rows.count() // ITEMS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks))))
    for k in range(blocks):
        yield sorted({(-1 if x["id"] is None else x["id"], x["text"]) for x in dealt.filter(F.col("block") == k).collect()})


def _indexed(spark, block):
    rows, begin, count = word_rows([text.encode() for _, text in block])
    use = np.flatnonzero(count > 0).tolist()
    items = [rows[begin[k] : begin[k] + count[k]] for k in use]
    ids = np.array([block[k][0] for k in use], np.int64)
    return spark.sparkContext.broadcast((build_index(items), items, ids))


def _long(text: bytes, index, items: list[np.ndarray]) -> np.ndarray:
    """``_search`` in a long text, block by block; each begins with as many words before it as an item can take."""
    reach, tail, number, found = int(1.5 * max(map(len, items), default=0)) + PIECE, np.zeros(0, np.uint64), 0, []
    for block in blocks(text, SLICE, _BREAKS):
        rows, _, count = word_rows([block])
        words = np.concatenate([tail, rows[: count[0]]])
        part = _search(index, items, np.append(words, np.zeros(2, np.uint64)), np.zeros(1, np.int64), np.array([len(words)]))
        part[3] += number - len(tail)
        found.append(part)
        number, tail = number + int(count[0]), words[-reach:]
    return _best(found)


def _hits(texts: list[bytes], held):
    index, items, ids = held.value
    lengths = np.array([len(x) for x in items], np.int64)
    for low, high in slices([len(x) for x in texts], SLICE):
        long = len(texts[low]) > SLICE
        doc, item, edits, start = _long(texts[low], index, items) if long else _search(index, items, *word_rows(texts[low:high]))
        yield doc + low, ids[item], edits, start, lengths[item]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start_word, n_edits, similarity): one row for each document and item that it has.

    A document has an item if some run of its words is at most EDITS of the item's words away from it, in words
    put in, left out or changed; the row tells the best such run, the first of equally good ones. So items of fewer
    than LEAST_WORDS words are found as they are. Words are runs of letters, digits and non-ASCII bytes; where a
    script has no spaces, each character. Items without words, a text or an id are not looked for; null texts have
    no words; null ids come back. An item id with several texts is any of them. Empty tables give an empty result;
    repeated documents come back repeated; other columns are ignored. Very long texts are searched in blocks.
    """
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_edits long, similarity double"
    for block in _blocks(benchmark, item_col, text_col, False):
        held = _indexed(spark, block)

        @tidied
        def run(batches, held=held):
            for batch in batches:
                for doc, item_id, edits, start, size in _hits(texts_of(batch.column(1)), held):
                    columns = [batch.column(0).take(pa.array(doc)), pa.array(item_id), pa.array(start), pa.array(edits.astype(np.int64)), pa.array((1 - edits / size).round(6))]
                    yield pa.record_batch(columns, names=["doc_id", "item_id", "start_word", "n_edits", "similarity"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without any benchmark item, those without an id too, with all their columns."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, text_col, True):
        held = _indexed(docs.sparkSession, block)

        @tidied
        def run(batches, held=held):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for doc, *_ in _hits(texts_of(batch.column(at)), held):
                    clean[doc] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
