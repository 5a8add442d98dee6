"""Substring dedup: words covered by a window of words that also starts earlier are removed.

Windows are looked at level by level, each level's twice as long as the one's before. At the first level, windows of
the length that counts, every chunk of documents sends the distinct hashes of its windows out as sorted lists and
learns which of them other chunks have too. Only windows repeated at one level are extended to twice their length
at the next: those whose two halves are repeated. The levels end when no candidate survives. What repeats at the
first level and starts earlier elsewhere is cut; the levels above tell how long a text's repeats are.

Copies of whole texts are known by their digest and go first; only the earliest is looked at. A window that repeats
inside a chunk leaves it once, so a passage in a third of all documents goes out once a chunk. What is cut is decided
by 128 bits of the windows' words, and rows of one id are told apart by 64 bits of their text; the levels above go by
64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.llm.chunks import REQUESTS, Dealer, buckets_for, by_bucket, chunked, packed, requests, texts_in, unpacked
from korrel.llm.common import blocks, forget, keep, pair, parts_for, signed, tidied, trim, word_runs

WINDOW = 20
#: Bytes of text that are hashed at a time.
SLICE = 1 << 21
#: Bits of the hashes that chunks send out; what meets by chance is told apart by the whole hashes.
BITS = np.uint64(48)
_LAST = np.iinfo(np.int64).max


class _Chunk:
    """The rows of a chunk: ``order`` ranks them by id and text; ``use`` are those that are looked at, so ranked."""

    def __init__(self, chunk: pa.Table, firsts: list[tuple[int, int, int]]):
        def column(name):
            return chunk[name].combine_chunks().flatten()

        self.doc_ids = column("ids")
        self.ids = self.doc_ids.fill_null(_LAST).to_numpy()
        self.sizes, a, b = (column(c).to_numpy() for c in ("sizes", "a", "b"))
        self.name, first = a, dict(((x, y), i) for x, y, i in firsts)
        count = len(a)
        self.order = np.lexsort((b, a, self.ids))
        same = np.zeros(count, bool)
        here, twin = self.order[1:], self.order[:-1]
        same[1:] = (a[here] == a[twin]) & (b[here] == b[twin]) & (self.ids[here] == self.ids[twin])
        #: the row that a repeated one is the same document as
        self.twin = np.empty(count, np.int64)
        self.twin[self.order] = self.order[np.maximum.accumulate(np.where(same, 0, np.arange(count)))] if count else self.order
        names = list(zip(a.tolist(), b.tolist()))
        for k in self.order.tolist():  # ascending ids, so the first of a chunk is its earliest
            first.setdefault(names[k], int(self.ids[k]))
        self.copy = np.fromiter((first[x] for x in names), np.int64, count) != self.ids
        self.use = self.order[(~self.copy & (self.twin == np.arange(count)))[self.order]]  # the earliest first
        self.texts = texts_in(self.sizes, chunk["texts"][0].as_py())

    def windows(self, window: int, families: int):
        """(row, place, hash of each family) of the windows of the rows that are looked at, run by run."""
        for low, _, words in word_runs([self.texts[k] for k in self.use.tolist()], SLICE, carry=window - 1, families=families):
            found = [words.grams(words.hashes(k), window) for k in range(families)]
            at = np.flatnonzero(found[0][1])
            yield self.use[low + words.doc[at]], words.base + at - words.first[words.doc[at]], [x[at] for x, _ in found]


def _firsts(told: pa.Table) -> list[tuple[int, int, int]]:
    return [(x["a"], x["b"], x["first"]) for some in told["firsts"].to_pylist() for x in some or []]


def _request(window: int, buckets: int):
    def run(key, chunk, told):
        if not chunk.num_rows:
            return pa.table(requests(0, np.zeros(0, np.uint64), buckets).columns, names=["bucket", "chunk", "block"])
        found = [h[0] >> (np.uint64(64) - BITS) for _, _, h in _Chunk(chunk, _firsts(told)).windows(window, 1)]
        keys = np.sort(np.concatenate([*found, np.zeros(0, np.uint64)]))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        out = requests(key[1].as_py(), keys << (np.uint64(64) - BITS), buckets)
        del found, keys
        trim()
        return pa.Table.from_batches([out])

    return run


def _answer(key, rows):
    """To each chunk of a bucket a bit for each of its hashes: whether another chunk has it too."""
    found = [np.cumsum(unpacked(x, 8)[0], dtype=np.uint64) for x in rows["block"].to_pylist()]
    every = np.sort(np.concatenate(found))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for x in found:
        at = np.minimum(np.searchsorted(again, x), max(0, len(again) - 1))
        bits.append(packed(np.packbits(again[at] == x if len(again) else np.zeros(len(x), bool))))
    sizes = [len(x) for x in found]
    del found, every
    trim()
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"].cast(pa.int64()), "block": pa.array(bits, pa.binary()), "n": pa.array(sizes, pa.int64())})


#: Windows that may repeat, by their document's rank and place, and the number of the chunk's earliest of the same words;
#: the second hash is only there for those.
FOUND = "chunk long, h1 array<long>, h2 array<long>, id array<long>, name array<long>, row array<int>, place array<long>, lead array<int>"
#: Windows that may repeat at a level above; and the rows that had some that do at the levels before, with their length.
LEVEL = "chunk long, h1 array<long>, row array<int>, place array<long>, rows array<int>, lengths array<long>"
TOLD = "chunk long, bucket long, block binary, n long"
_KINDS = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}


def _listed(schema: str, chunk: int, *columns: np.ndarray) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.ascontiguousarray(x), _KINDS[t].value_type)) for x, t in zip(columns, kinds[1:])]
    return pa.table([pa.array([chunk], pa.int64()), *lists], names=list(names))


def _lists(found: pa.Table, schema: str) -> list[np.ndarray]:
    return [found[x.split()[0]].combine_chunks().flatten().to_numpy() for x in schema.split(", ")[1:]]


def _nothing(schema: str) -> pa.Table:
    return pa.table({n: pa.array([], _KINDS[t]) for n, t in (x.split() for x in schema.split(", "))})


def _leads(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For each window the number of the first of the same words."""
    lead = np.zeros(len(h1), np.int64)
    for order in (np.argsort(h1), None):
        order = np.lexsort((h2, h1)) if order is None else order
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        if len(order):
            lead[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(begin, append=len(order)))
        if (np.diff(h1[order][begin].view(np.uint64)) > 0).all():  # else windows of one first hash are mixed
            break
    return lead


def _bits(told: pa.Table, width: int) -> np.ndarray:
    """The answers for a chunk's hashes in their order, ``width`` bits each."""
    blocks, sizes = told["block"].to_pylist(), told["n"].to_pylist()
    bits = [np.unpackbits(unpacked(blocks[k], 1)[0])[: width * sizes[k]] for k in np.argsort(told["bucket"].to_numpy()).tolist()]
    return np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool).reshape(-1, width)


def _candidates(window: int):
    """The windows of a chunk that repeat in it or, as the answers say, in another."""

    def run(key, chunk, told):
        if not chunk.num_rows:
            return _nothing(FOUND)
        rows = _Chunk(chunk, _firsts(told))
        shift = np.uint64(64) - BITS
        every = [(*h, row, place) for row, place, h in rows.windows(window, 2)]
        every = [np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(zip(*every) if every else [()] * 4, (np.uint64, np.uint64, np.int64, np.int64))]
        keys = np.sort(every[0] >> shift)
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        again = np.diff(begin, append=len(keys)) > 1
        again |= _bits(told.filter(told["bucket"].is_valid()), 1)[:, 0]
        again = keys[begin[again]]
        near = np.minimum(np.searchsorted(again, every[0] >> shift), max(0, len(again) - 1))
        at = np.flatnonzero(again[near] == every[0] >> shift) if len(again) else np.zeros(0, np.int64)
        h1, h2, row, place = (x[at] for x in every)
        del every, keys, near
        lead = _leads(h1, h2)
        h2 = h2[lead == np.arange(len(lead))]
        out = _listed(FOUND, key[1].as_py(), signed(h1), signed(h2), rows.ids[row], rows.name[row], row, place, lead)
        del rows
        trim()
        return out

    return run


def _sorted_leads(h1: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the chunk's first windows of the same words, by their hash: the order in which they are asked about."""
    k = np.flatnonzero(lead == np.arange(len(lead)))
    order = np.argsort(h1[k].view(np.uint64), kind="stable")
    return k[order], order


def _order_request(buckets: int):
    @tidied
    def run(batches):
        for batch in batches:
            for chunk, *lists in zip(*batch.columns):
                h1, h2, ids, name, _, place, lead = (x.values.to_numpy() for x in lists)
                k, order = _sorted_leads(h1, lead)
                many = np.bincount(lead, minlength=len(lead))[k] > 1
                yield requests(chunk.as_py(), h1[k].view(np.uint64), buckets, h2[order], ids[k], name[k], place[k] << 1 | many)

    return run


def _order_answer(key, rows):
    """To each chunk two bits for each of its windows: whether it repeats, and whether it also starts earlier."""
    found = [unpacked(x, 8, 8, 8, 8, 8) for x in rows["block"].to_pylist()]
    h1 = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in found])
    h2, ids, name, place = (np.concatenate([x[k] for x in found]).view(np.int64) for k in range(1, 5))
    sizes = [len(x[0]) for x in found]
    del found
    place, many = place >> 1, (place & 1).astype(bool)
    order = np.lexsort((place, name, ids, h2, h1))
    new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(order))
    first = np.repeat(order[begin], size)
    out = np.zeros((len(order), 2), bool)
    out[order, 0] = many[order] | (np.repeat(size, size) > 1)
    out[order, 1] = (ids[order] != ids[first]) | (name[order] != name[first]) | (place[order] != place[first])
    ends = np.cumsum(sizes).tolist()
    bits = [packed(np.packbits(out[a:b].ravel())) for a, b in zip([0, *ends], ends)]
    del h1, h2, ids, name, place, order, first, out
    trim()
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"].cast(pa.int64()), "block": pa.array(bits, pa.binary()), "n": pa.array(sizes, pa.int64())})


def _double(length: int, chunk: int, h1: np.ndarray, row: np.ndarray, place: np.ndarray, again: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """The windows of twice ``length`` both of whose halves repeat, and the rows that have some that repeats."""
    alive = np.flatnonzero(again)  # by row and place, as windows come
    begin = np.flatnonzero(np.diff(row[alive], prepend=-1))
    rank = np.cumsum(np.diff(row[alive], prepend=-1) != 0)  # of the row, in the order in which rows come
    at = rank << 40 | place[alive]
    to = np.searchsorted(at, at + length)
    pairs = np.flatnonzero(np.append(at, -1)[to] == at + length)
    left, right = alive[pairs], alive[to[pairs]]
    longer, sure = pair(h1[left].view(np.uint64), h1[right].view(np.uint64)), row[alive][begin]
    return _listed(LEVEL, chunk, signed(longer), row[left], place[left], np.concatenate([rows, sure]), np.concatenate([lengths, np.full(len(sure), length)]))


def _first_doubled(length: int):
    def run(key, found, told):
        if not found.num_rows or not told.num_rows:
            return _nothing(LEVEL)
        h1, _, _, _, row, place, lead = _lists(found, FOUND)
        again = np.zeros(len(h1), bool)
        again[_sorted_leads(h1, lead)[0]] = _bits(told, 2)[:, 0]
        return _double(length, key[1].as_py(), h1, row, place, again[lead], row[:0], place[:0])

    return run


def _distinct(h1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, ascending, each once; whether it is there again; and the number of each window's."""
    keys, at, count = np.unique(h1.view(np.uint64), return_inverse=True, return_counts=True)
    return keys, count > 1, at


def _level_request(buckets: int):
    @tidied
    def run(batches):
        for batch in batches:
            for chunk, h1 in zip(batch.column(0), batch.column(1)):
                yield requests(chunk.as_py(), _distinct(h1.values.to_numpy())[0], buckets)

    return run


def _doubled(length: int):
    def run(key, found, told):
        if not found.num_rows:
            return _nothing(LEVEL)
        h1, row, place, *before = _lists(found, LEVEL)
        _, again, at = _distinct(h1)
        return _double(length, key[1].as_py(), h1, row, place, (again | _bits(told, 1)[:, 0])[at], *before)

    return run


def _levels(found: DataFrame, told: DataFrame, window: int, buckets: int, deal: Dealer) -> DataFrame:
    """The last level, a kept table: rows with the lengths of their windows that repeat, level by level until none does."""
    length, step, before = window, _first_doubled, None
    while True:
        level = keep(deal.by_chunk(found).cogroup(deal.by_chunk(told)).applyInArrow(step(length), LEVEL), "repeats")
        if before is not None:
            forget(before)
        alive = level.filter("size(h1) > 0").select("chunk", "h1")
        if alive.isEmpty():
            return level
        told = by_bucket(alive.mapInArrow(_level_request(buckets), REQUESTS), buckets).applyInArrow(_answer, TOLD)
        found, before, length, step = level, level, 2 * length, _doubled


def _kept(raw: bytes, starts: np.ndarray, window: int, parts: list | None, digest=None) -> tuple[int, int]:
    """Words and removed words of a text; the kept words go to ``parts`` or ``digest``, block by block."""
    number = removed = 0
    said = False
    starts = np.sort(starts)
    for block in blocks(raw, SLICE):
        words = block.split()
        if len(starts):
            own = starts[(starts > number - window) & (starts < number + len(words))] - number
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(0, own), 1)
            np.add.at(edge, np.minimum(len(words), own + window), -1)
            cover = np.cumsum(edge[:-1]) > 0
            removed += int(cover.sum())
            number += len(words)
            if cover.any():
                words = [words[k] for k in np.flatnonzero(~cover).tolist()]
        else:
            number += len(words)
        if words and (digest is not None or parts is not None):
            text = b" ".join(words)
            if digest is not None:
                digest.update(b" " + text if said else text)
            if parts is not None:
                parts.append(text)
            said = True
    return number, removed


def _cut(window: int, with_text: bool, rest: T.DataType | None):
    def run(key, chunk, notes):
        if not chunk.num_rows:
            return _nothing("doc_id long, n_words long, n_removed long, longest_repeat long").append_column("kept", pa.array([], pa.string())).append_column("rest", pa.array([], chunk["rest"].type.value_type))
        rows = _Chunk(chunk, _firsts(notes))
        found = notes.filter(notes["row"].is_valid())
        starts: dict[int, np.ndarray] = {}
        longest: dict[int, int] = {}
        for n in range(found.num_rows):
            h1, row, place, lead = (found[c][n].values.to_numpy() for c in ("h1", "row", "place", "lead"))
            gone = np.zeros(len(row), bool)
            gone[_sorted_leads(h1, lead)[0]] = _bits(notes.filter(notes["bucket"].is_valid()), 2)[:, 1]  # those that another chunk has earlier
            gone = gone[lead] | (lead != np.arange(len(row)))
            order = np.argsort(row[gone], kind="stable")
            rows_gone, place = row[gone][order], place[gone][order]
            edges = np.flatnonzero(np.concatenate([[True], rows_gone[1:] != rows_gone[:-1]])) if len(order) else []
            starts |= {int(rows_gone[a]): x for a, x in zip(edges, np.split(place, edges[1:]))}
        for some in notes.filter(notes["longest"].is_valid())["longest"].to_pylist():
            longest |= {x["row"]: x["length"] for x in some}
        none, done = np.zeros(0, np.int64), {}
        for k in [*rows.use.tolist(), *np.flatnonzero(rows.copy).tolist()]:
            raw, parts, digest = rows.texts[k], [] if with_text else None, None if with_text else hashlib.sha256()
            if rows.copy[k]:
                count, removed = _kept(raw, none, window, None)
                removed = count if count >= window else 0
                if not with_text:
                    if not removed:
                        _kept(raw, none, window, None, digest)
                    kept = digest.hexdigest()
                else:
                    kept = "" if removed else raw.decode()
                done[k] = count, removed, None, kept
            elif with_text and k not in starts:
                done[k] = *_kept(raw, none, window, None), longest.get(k, 0), raw.decode()
            else:
                count, removed = _kept(raw, starts.get(k, none), window, parts, digest)
                done[k] = count, removed, longest.get(k, 0), b" ".join(parts).decode() if with_text else digest.hexdigest()
        whole = [done[int(k)] for k in rows.twin]
        kept = pa.array([x[3] for x in whole], pa.string())
        if with_text:
            kept = pa.compute.if_else(pa.array(rows.sizes >= 0), kept, pa.scalar(None, pa.string()))
        columns = [rows.doc_ids, *(pa.array([x[k] for x in whole], pa.int64()) for k in range(3)), kept, chunk["rest"].combine_chunks().flatten()]
        trim()
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "longest_repeat", "kept", "rest"])

    return run


def _together(*frames: DataFrame) -> DataFrame:
    """What is known of each chunk, as rows of one table with nulls where a frame has no such column."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _cut_rows(docs: DataFrame, window: int, id_col: str, text_col: str, with_text: bool, rest) -> DataFrame:
    if window < 2:
        raise ValueError("a window has two words at least")
    chunks = chunked(docs, id_col, text_col, rest, "substring-chunks")
    names = chunks.select("chunk", F.explode(F.arrays_zip("ids", "a", "b")).alias("x")).select("chunk", F.coalesce("x.ids", F.lit(_LAST)).alias("id"), "x.a", "x.b")
    names = keep(names.groupBy("a", "b", "chunk").agg(F.min("id").alias("id"), F.max("id").alias("most")), "substring-names")
    firsts = names.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("most").alias("most")).filter("first < most").select("a", "b", "first")
    firsts = names.join(firsts, ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("a", "b", "first")).alias("firsts"))
    firsts = keep(firsts, "substring-firsts")
    forget(names)
    buckets, deal = buckets_for(docs), Dealer(chunks, parts_for(docs))
    looked = deal.by_chunk(chunks.select("chunk", "ids", "sizes", "a", "b", "texts"))  # one exchange for both uses
    asked = looked.cogroup(deal.by_chunk(firsts)).applyInArrow(_request(window, buckets), REQUESTS)
    told = _together(firsts, by_bucket(asked, buckets).applyInArrow(_answer, TOLD))
    found = looked.cogroup(deal.by_chunk(told)).applyInArrow(_candidates(window), FOUND).filter("size(h1) > 0")
    found = keep(found, "repeats")
    told = keep(by_bucket(found.mapInArrow(_order_request(buckets), REQUESTS), buckets).applyInArrow(_order_answer, TOLD), "repeats-told")
    last, answers = _levels(found, told, window, buckets, deal), told
    longest = last.select("chunk", F.arrays_zip(F.col("rows").alias("row"), F.col("lengths").alias("length")).alias("longest"))
    told = keep(_together(answers, longest), "repeats-told")
    forget(answers)
    forget(last)
    notes = [firsts, told, found.select("chunk", "h1", "row", "place", "lead")]
    kind = chunks.schema["rest"].dataType.elementType
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed", "longest_repeat")), T.StructField("kept", T.StringType()), T.StructField("rest", kind)])
    return deal.by_chunk(chunks).cogroup(deal.by_chunk(_together(*notes))).applyInArrow(_cut(window, with_text, kind), schema)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (or kept_text), longest_repeat.

    A word goes if a window of ``window`` consecutive words covers it whose words also start earlier: in a
    document of smaller id, or earlier in the same one. Kept words are joined by one space; ``with_text``
    leaves texts that lose nothing as they are. ``longest_repeat`` is the length of the longest windows of a text
    that repeat, in doublings of ``window``: 0 if none does, null for copies of whole texts. Null texts have no
    words (and stay null in kept_text). A null id counts as the largest. Repeated rows of one id and text are one
    document and get equal rows; rows of one id with different texts are documents of their own, of which any one
    may count as the earlier. An empty table gives an empty result; other columns are ignored. A text of any length
    is hashed and cut in blocks; some 40 bytes a word are held of the longest.
    """
    found = _cut_rows(docs, window, id_col, text_col, with_text, F.lit(True))
    return found.withColumnRenamed("kept", "kept_text" if with_text else "kept_sha256").drop("rest")


def cut_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", longest_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns and their texts cut; ``size_col``, if there, follows the text.

    All rows stay: a text that loses all its words is empty. See ``dedup_substrings`` for what goes, and for
    ``longest_repeat``, which comes as ``longest_col`` if that is named (it may not be a column of ``docs``).
    """
    if longest_col in docs.columns:
        raise ValueError(f"there is a column {longest_col} already")
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), F.lit(True).alias("always"))
    rows = _cut_rows(docs, window, id_col, text_col, True, rest)

    def column(name: str):
        kind = docs.schema[name].dataType
        if name == text_col:
            return F.col("kept").alias(name)
        old = F.col("rest").getField(f"c{others.index(name)}")
        if name == size_col:
            return F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(old).cast(kind).alias(name)
        return old.alias(name)

    longest = [] if longest_col is None else [F.col("longest_repeat").alias(longest_col)]
    return rows.select(*map(column, docs.columns), *longest)
