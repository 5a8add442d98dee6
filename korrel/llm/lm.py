"""Cross-entropy difference: how much likelier a document's words are under a target than a background model.

Both are interpolated bigram models over one vocabulary, counted over all documents: the background over every
document, the target over those marked as target. They are matched: the background's counts are scaled to the
number of the target's words, so that smoothing weighs the same in both, and every document is scored by what
all others hold, its own words being taken out of both models' counts.

Counts are exact and gathered without bringing the words of all documents to one place. Documents are written as
chunks of bounded size. Each chunk sums its own n-grams and sends each bucket of the n-gram hash space one sorted
block; buckets add the blocks up and answer each chunk with the totals of just the n-grams it has; chunks score
their documents with the answers. A bucket is as large as a chunk is, so both grow in number, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.chunks import REQUESTS, Dealer, buckets_for, by_bucket, chunked, packed, requests, texts_in, unpacked
from korrel.llm.common import Words, keep, mix, pair, parts_for, tidied, trim, word_runs

#: Weight of the bigram, and what is added to each word's count.
MIX, ADDED = 0.7, 0.5
#: Bytes of text that are hashed at a time.
SLICE = 1 << 21
#: Keys that are kept before they are added up.
MANY = 1 << 22
#: Target ids up to which they are broadcast (eight bytes each); beyond, documents are joined with them.
BROADCAST_IDS = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _MARK = np.uint64(2), np.uint64(1)
_KEY = ~np.uint64(3)


def _keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram keys of each word, of each word and the one before it, and whether it has one. Words have bit 1."""
    hashes = words.hashes()
    return mix(hashes) & _KEY | _WORD, pair(hashes[:-1], hashes[1:]) & _KEY, words.doc[1:] == words.doc[:-1]


def _runs(texts: list[bytes]):
    return word_runs(texts, SLICE, translate=_LOWER, carry=1)


def _add_up(keys: np.ndarray, counts: np.ndarray, marked: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[begin], *(np.add.reduceat(x[order], begin) if len(keys) else x for x in (counts, marked))]


def _counted(raw: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys, sorted, how often each occurs, and how often with a mark."""
    every = np.sort(np.concatenate([*raw, np.zeros(0, np.uint64)]))
    plain = every & ~_MARK
    begin = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]])) if len(every) else np.zeros(0, np.int64)
    marked = np.add.reduceat((every & _MARK).astype(np.int64), begin) if len(every) else np.zeros(0, np.int64)
    return [plain[begin], np.diff(begin, append=len(every)), marked]


def _summary(texts: list[bytes], target: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with their counts in all texts and in target texts."""
    done, raw, waiting = None, [], 0
    for low, high, words in _runs(texts):
        own, pairs, inside = _keys(words)
        mark = target[low:high].astype(np.uint64)[words.doc]
        raw += [(own | mark)[words.lead :], (pairs | mark[1:])[inside]]
        waiting += len(raw[-1]) + len(raw[-2])
        if waiting > MANY:
            new, raw, waiting = _counted(raw), [], 0
            done = new if done is None else _add_up(*map(np.concatenate, zip(done, new)))
    new = _counted(raw)
    return new if done is None else _add_up(*map(np.concatenate, zip(done, new)))


def _request(buckets: int):
    @tidied
    def run(batches):
        for batch in batches:
            for chunk, marked, sizes, texts in zip(*(batch.column(k) for k in range(4))):
                found = _summary(texts_in(sizes.values.to_numpy(), texts.as_py()), marked.values.to_numpy(zero_copy_only=False))
                yield requests(chunk.as_py(), found[0], buckets, *found[1:])

    return run


def _answer(key, rows):
    """To each chunk of a bucket the totals of its keys; at -1 the bucket's numbers of words, target words and distinct words."""
    chunks, found = rows["chunk"].to_pylist(), [unpacked(x, 8, 8, 8) for x in rows["block"].to_pylist()]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in found]
    every, counts, target = _add_up(np.concatenate(keys), *(np.concatenate([x[k] for x in found]).astype(np.int64) for k in (1, 2)))
    answers = []
    for x in keys:
        at = np.searchsorted(every, x)
        answers.append(packed(counts[at], target[at]))
    words = (every & _WORD) != 0
    trim()
    return pa.table({
        "chunk": pa.array([*chunks, -1], pa.int64()), "bucket": pa.array([key[0].as_py()] * (len(chunks) + 1), pa.int64()),
        "block": pa.array([*answers, None], pa.binary()), "sums": pa.array([*[None] * len(chunks), [int(counts[words].sum()), int(target[words].sum()), int(words.sum())]], pa.list_(pa.int64())),
    })


def _repeats(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each row's key occurs in its document."""
    both = pair(doc.astype(np.uint64), keys)
    order = np.argsort(both)
    both = both[order]
    begin = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else order
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.diff(begin, append=len(order)), np.diff(begin, append=len(order)))
    return out


def _scores(texts: list[bytes], marked: np.ndarray, keys: np.ndarray, totals: list[np.ndarray], sums: tuple[int, int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and its two losses: background, target."""
    size, losses, long = np.zeros(len(texts), np.int64), np.zeros((2, len(texts))), {}
    for low, high, words in _runs(texts):
        own, pairs, inside = _keys(words)
        if not len(own):
            continue
        doc, has = words.doc, np.flatnonzero(inside) + 1
        if len(texts[low]) > SLICE:  # a block: counts of the whole text
            if low not in long:
                long = {low: _summary([texts[low]], np.zeros(1, bool))}
            all_keys, all_counts, _ = long[low]
            own_here, pairs_here = all_counts[np.searchsorted(all_keys, own)], all_counts[np.searchsorted(all_keys, pairs[inside])]
            number = np.full(1, all_counts[(all_keys & _WORD) != 0].sum())
        else:
            own_here, pairs_here = _repeats(doc, own), _repeats(doc[has], pairs[inside])
            number = np.diff(words.first)
        at_own, at_pair = np.searchsorted(keys, own), np.searchsorted(keys, pairs[inside])
        size[low:high] = number
        said = [sums[0] - number, sums[1] - number * marked[low:high]]  # words of the other documents
        for k, total in enumerate(totals):
            part = np.ones(high - low, np.int64) if k == 0 else marked[low:high].astype(np.int64)
            scale = np.divide(said[1], said[0], out=np.ones(high - low), where=(said[0] > 0) & (said[1] > 0)) if k == 0 else np.ones(high - low)
            count = total[at_own] - own_here * part[doc]
            chance = (count * scale[doc] + ADDED) / ((said[k] * scale)[doc] + ADDED * sums[2])
            before = count[has - 1]
            shared = np.divide(total[at_pair] - pairs_here * part[doc[has]], before, out=np.zeros(len(has)), where=before > 0)
            chance[has] = np.where(before > 0, MIX * shared + (1 - MIX) * chance[has], chance[has])
            loss = np.concatenate([[0.0], np.cumsum(-np.log(chance[words.lead :]))])
            ends = np.maximum(0, words.first - words.lead)
            losses[k, low:high] += loss[ends[1:]] - loss[ends[:-1]]
    return size, list(losses)


def _score(sums: tuple[int, int, int]):
    def run(key, chunk, answers):
        if not chunk.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("doc_id", "n_words"), (pa.int64(),) * 2)} | {n: pa.array([], pa.float64()) for n in ("target_loss", "background_loss", "difference")})
        marked = chunk["rest"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        texts = texts_in(chunk["sizes"].combine_chunks().flatten().to_numpy(), chunk["texts"][0].as_py())
        keys = _summary(texts, marked)[0]
        blocks = answers["block"].to_pylist()
        found = [unpacked(blocks[k], 8, 8) for k in np.argsort(answers["bucket"].to_numpy()).tolist()]
        totals = [np.concatenate([x[k] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1)]
        size, losses = _scores(texts, marked, keys, totals, sums)
        empty = size == 0
        background, target = (np.round(np.divide(x, size, where=~empty, out=np.zeros(len(x))), 9) for x in losses)
        trim()
        return pa.table({
            "doc_id": chunk["ids"].combine_chunks().flatten(), "n_words": pa.array(size), "target_loss": pa.array(target, mask=empty),
            "background_loss": pa.array(background, mask=empty), "difference": pa.array(np.round(target - background, 9), mask=empty),
        })

    return run


SCORES = "doc_id long, n_words long, target_loss double, background_loss double, difference double"


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) and whether their id is one of ``ids``."""
    ids = ids.withColumn("marked", F.lit(True))
    few = ids.count() <= BROADCAST_IDS
    # rows without an id would all meet under one key
    found = rows.filter("doc_id is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("marked", F.lit(False)).alias("marked"))
    return found.unionAll(rows.filter("doc_id is null").select("doc_id", "text", F.lit(False).alias("marked")))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, target_loss, background_loss, difference.

    ``target_ids`` lists the ids of the target's documents (others and repeated ones do no harm). Words are
    runs without ASCII white space, A-Z lower-cased. Losses are natural logarithms a word; the lower the
    difference (target less background), the closer the document. A word's chance is MIX of its share after
    the word before (where the model knows that one) and the rest its smoothed share of all words; words that
    one model lacks are in the shared vocabulary. Counts are those of all other rows: a document's own words
    are left out. A document without words, or a null text, has null scores. Without any target word the
    target model is uniform. Repeated rows count for each other and come back repeated; null ids are never
    targets; an empty table gives an empty result; other columns are ignored. A text longer than SLICE is read
    in blocks; besides the text and its distinct n-grams, memory doesn't grow with it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = target_ids.select(F.col(target_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    chunks = chunked(_marked(rows, ids), "doc_id", "text", F.col("marked"), "lm-chunks").drop("a", "b")
    buckets, deal = buckets_for(docs), Dealer(chunks, parts_for(docs))
    asked = chunks.select("chunk", "rest", "sizes", "texts").mapInArrow(_request(buckets), REQUESTS)
    answers = keep(by_bucket(asked, buckets).applyInArrow(_answer, "chunk long, bucket long, block binary, sums array<long>"), "lm-counts")
    told = answers.filter("chunk = -1").agg(*(F.sum(F.col("sums")[k]) for k in range(3))).first()
    sums = tuple(x or 0 for x in told)
    own = answers.filter("chunk >= 0").select("chunk", "bucket", "block")
    return deal.by_chunk(chunks).cogroup(deal.by_chunk(own)).applyInArrow(_score((*sums[:2], sums[2] or 1)), SCORES)


def target_documents(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and nowhere bad."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 1 and toxic = 0").select("doc_id")
