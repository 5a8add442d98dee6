"""Quality and toxicity by co-training: a text-content and a page-metadata classifier teach each other.

Both views start as logistic models over binary features, fitted on a bounded sample of labelled documents. Then, in
each round, each view labels all unlabelled documents, wherever it is confident; what the other view learns from them
are the counts of its features in either class, summed over all documents, from which it takes log-odds. The views'
margins are calibrated and combined by weights fitted on held-out labels, so that a view without information gets
none. Documents are turned into features once; rounds and scores read those. All documents are scored, whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import alone, keep, slices, span_hash, texts_of, tidied, word_runs

#: Labelled documents that are fitted to and held out: the bound of the sample. Rounds and labels cover all documents.
SAMPLE, HELD_OUT = 8000, 0.3
ROUNDS, SURE = 3, 0.97
#: A feature is used if it is seen often enough and its share differs between classes by so many deviations.
LEAST_SEEN, DEVIATIONS, RIDGE = 5, 4.0, 0.02
#: And, where it is counted over all documents, by so much in log-odds, as deviations vanish with their number.
LEAST_ODDS = 0.5
#: Ids of labelled documents up to which they are broadcast (eight bytes each); beyond, documents are joined with them.
BROADCAST_IDS = 1 << 20
BITS = 20
SLICE = 1 << 21
TARGETS = ("quality", "toxic")
META = ("lang", "source", "n_chars")

_BREAKS = np.array([not (b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes whose share of a text is a feature, in steps of 2 %.
_KINDS = [np.isin(np.arange(256), list(x)) for x in (b"0123456789", bytes(range(65, 91)), b"|", b"\n", b" ")]
_KINDS += [_BREAKS & ~np.isin(np.arange(256), list(b" \t\r\n.,;:'\"!?-|")), ~_BREAKS]
STEPS = 51


def _distinct(values: np.ndarray) -> np.ndarray:
    """The values, ascending, each once; by sorting, which is faster here than np.unique's hashing."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def text_features(texts: list[bytes], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, by row: the words, and steps of byte shares, word length and words said again.

    Words are runs of ASCII letters, digits and other characters' bytes, A-Z lower-cased; ``used`` keeps some.
    """
    count, found = len(texts), []
    kinds, length, number, again = (np.zeros((n, count), np.int64) for n in (len(_KINDS), 1, 1, 2))
    for low, high, words in word_runs(texts, SLICE, _BREAKS, _LOWER, carry=2):
        hashes, lead = words.hashes(), words.lead
        word = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        use = np.ones(len(word), bool) if used is None else used[word]
        use[:lead] = False
        found.append(_distinct((words.doc[use] + low) << 32 | word[use]))
        for k, kind in enumerate(_KINDS):
            kinds[k, low:high] += np.add.reduceat(kind[words.raw].view(np.uint8), words.offsets[:-1], dtype=np.int64)[: high - low] if high > low else 0
            if kind[32]:  # the separators behind the texts
                kinds[k, low : high - 1] -= 1
                kinds[k, high - 1] -= len(words.raw) - words.offsets[-1] + 1
        length[0, low:high] += np.bincount(words.doc[lead:], words.ends - words.starts, high - low).astype(np.int64)
        number[0, low:high] += np.bincount(words.doc[lead:], minlength=high - low)
        for back in (1, 2):  # words that are the one before, or the one before that, again
            same = (hashes[back:] == hashes[:-back]) & (words.doc[back:] == words.doc[:-back])
            same[: max(0, lead - back)] = False
            again[back - 1, low:high] += np.bincount(words.doc[back:][same], minlength=high - low)
    size, number = np.maximum(1, np.array([len(x) for x in texts], np.int64)), np.maximum(1, number[0])
    steps = [50 * x // size for x in kinds] + [np.minimum(STEPS - 1, 2 * length[0] // number)] + [50 * x // number for x in again]
    rows = np.arange(count) << 32
    pairs = _distinct(np.concatenate([*found, *(rows | ((1 << BITS) + k * STEPS + x) for k, x in enumerate(steps))]).astype(np.int64))
    return pairs >> 32, pairs & 0xFFFFFFFF


TEXT_SIZE = (1 << BITS) + (len(_KINDS) + 3) * STEPS
META_SIZE = 1 << 16
SIZES = (TEXT_SIZE, META_SIZE)


def meta_features(columns: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of the metadata columns, by row: each value, numbers by their binary order."""
    rows, features = [], []
    for name, values in columns.items():
        said = [f"{name}={x.bit_length() if isinstance(x, int) else x}".encode() for x in values]
        ends = np.cumsum([len(x) for x in said], dtype=np.int64)
        buffer = np.frombuffer(b"".join(said) + bytes(8), np.uint8)
        hashes = span_hash(buffer, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if said else np.zeros(0, np.uint64)
        rows.append(np.arange(len(values)))
        features.append((hashes >> np.uint64(48)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(rows)[order], np.concatenate(features)[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    """Weights of some features, ascending, and a bias. ``mean``: a margin is divided by the root of the features it has."""

    names: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    mean: bool = False


NOTHING = Linear(np.zeros(0, np.int64), np.zeros(0))


class View:
    """Several models over the same features, looked up together."""

    def __init__(self, size: int, models: list[Linear]):
        self.size, self.models = size, models
        self.names = np.unique(np.concatenate([m.names for m in models])).astype(np.int64)
        self.table = np.zeros((len(self.names) + 1, len(models)))  # the last row is for features that none has
        for k, m in enumerate(models):
            self.table[np.searchsorted(self.names, m.names), k] = m.weights
        self.at = None

    def index(self) -> np.ndarray:
        if self.at is None:
            self.at = np.full(self.size, len(self.names), np.int32)
            self.at[self.names] = np.arange(len(self.names), dtype=np.int32)
        return self.at

    def __getstate__(self):
        return self.__dict__ | {"at": None}

    def margins(self, count: int, rows: np.ndarray, features: np.ndarray) -> list[np.ndarray]:
        at = self.index()[features]
        use = at < len(self.names)
        rows, at = rows[use], at[use]
        out = []
        for k, m in enumerate(self.models):
            weights = self.table[at, k]
            margin = m.bias + np.bincount(rows, weights, count)
            out.append(margin / np.sqrt(np.maximum(1, np.bincount(rows, weights != 0, count))) if m.mean else margin)
        return out


def fit(size: int, count: int, rows: np.ndarray, features: np.ndarray, y: np.ndarray) -> Linear:
    """Select features by their deviation between the classes, then fit by Nesterov's accelerated descent."""
    positive = max(1, int(y.sum()))
    negative = max(1, count - positive)
    seen = np.bincount(features, minlength=size)
    with_y = np.bincount(features, y[rows], size)
    a, b, share = with_y / positive, (seen - with_y) / negative, seen / max(1, count)
    spread = np.sqrt(share * (1 - share) * (1 / positive + 1 / negative)) + 1e-12
    use = (seen >= LEAST_SEEN) & (np.abs(a - b) / spread >= DEVIATIONS)
    names = np.flatnonzero(use)
    at = np.full(size, -1)
    at[names] = np.arange(len(names))
    keep = use[features]
    r, f = rows[keep], at[features[keep]]
    w, bias = np.zeros(len(names)), float(np.log(positive / negative))
    ahead, ahead_bias, step = w.copy(), bias, 4.0 / max(1.0, np.bincount(r, minlength=count).max(initial=1))
    for k in range(400):
        error = (_sigmoid(ahead_bias + np.bincount(r, ahead[f], count)) - y) / max(1, count)
        new = ahead - step * (np.bincount(f, error[r], len(names)) + RIDGE / max(1, count) * ahead)
        new_bias = ahead_bias - step * error.sum()
        ahead, ahead_bias = new + k / (k + 3) * (new - w), new_bias + k / (k + 3) * (new_bias - bias)
        w, bias = new, new_bias
    return Linear(names, w, float(bias))


def log_odds(names: np.ndarray, positive: np.ndarray, negative: np.ndarray, totals: tuple[int, int]) -> Linear:
    """What counted features say: the log-odds of each between the classes."""
    a, b = (np.log((x + 0.5) / (n + 1)) for x, n in zip((positive, negative), totals))
    order = np.argsort(names)
    return Linear(names[order], (a - b)[order], 0.0, True)


def _platt(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights (last the bias) of a small ridge logistic regression on margins, by Newton's method."""
    x = np.column_stack([np.clip(c, -20, 20) for c in columns] + [np.ones(len(y))])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, x.T @ (p - smooth) + ridge @ w)
    return w


def _calibrated(w: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    return _sigmoid(sum(a * np.clip(c, -20, 20) for a, c in zip(w, columns)) + w[-1])


@dataclass
class Model:
    """Scores of one target: weights of both views' two margins each, or a constant where labels lack a class."""

    combine: np.ndarray | None = None
    constant: float = 0.0


@dataclass
class Models:
    """Both views, with a fitted and a counted model for each target, and how targets combine them."""

    views: list[View]
    targets: dict[str, Model] = field(default_factory=dict)

    def scores(self, count: int, found: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        margins = [v.margins(count, *x) for v, x in zip(self.views, found)]
        out = []
        for k, name in enumerate(TARGETS):
            model = self.targets[name]
            columns = [m[2 * k + j] for m in margins for j in (0, 1)]
            out.append(np.full(count, model.constant) if model.combine is None else _calibrated(model.combine, *columns))
        return out


def _take(pairs: tuple[np.ndarray, np.ndarray], chosen: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.full(count, -1)
    at[chosen] = np.arange(len(chosen))
    keep = at[pairs[0]] >= 0
    return at[pairs[0][keep]], pairs[1][keep]


FEATURES = "id long, exact long, text array<int>, meta array<int>"


def _steps(pairs: tuple[np.ndarray, np.ndarray], count: int) -> pa.ListArray:
    """Each row's features, ascending, as the first and the steps to the next: those compress well."""
    rows, features = pairs
    both = np.sort(rows.astype(np.int64) << 32 | features)
    rows, features = both >> 32, both & 0xFFFFFFFF
    edges = np.searchsorted(rows, np.arange(count + 1))
    step = np.diff(features, prepend=0)
    begin = edges[:-1][np.diff(edges) > 0]
    step[begin] = features[begin]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(step, pa.int32()))


def _pairs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    edges = lists.offsets.to_numpy().astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(lists.values.to_numpy(), dtype=np.int64)])
    size = np.diff(edges)
    rows = np.repeat(np.arange(len(size)), size)
    return rows, sums[1:][edges[0] : edges[-1]] - np.repeat(sums[edges[:-1]], size)


def _features(docs: DataFrame, id_col: str, text_col: str, meta: tuple[str, ...]) -> DataFrame:
    """(id, exact, text, meta): one row for each row of ``docs``, written to the shared folder."""

    @tidied
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for low, high in slices([len(x) for x in texts], SLICE):
                count = high - low
                text = text_features(texts[low:high])
                page = meta_features({c: batch.column(2 + k)[low:high].to_pylist() for k, c in enumerate(meta)})
                exact = [xxhash.xxh3_64_intdigest(x) for x in texts[low:high]]
                columns = [batch.column(0)[low:high], pa.array(np.array(exact, np.uint64).view(np.int64)), _steps(text, count), _steps(page, count)]
                yield pa.record_batch(columns, names=["id", "exact", "text", "meta"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"m{k}") for k, c in enumerate(meta)))
    return keep(rows.mapInArrow(run, FEATURES), "features")


def _unlabelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of all documents that have no label, equal texts once."""
    known = labels.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    named = features.filter("id is not null").join(known, "id", "left_anti")
    rows = named.unionByName(features.filter("id is null"))  # which would all meet under one key
    once = rows.groupBy("exact").agg(F.min_by(F.struct("text", "meta"), F.struct("id", F.hash("meta"))).alias("row"))
    return keep(once.select("row.text", "row.meta"), "unlabelled")


def _sample(features: DataFrame, labels: DataFrame) -> pa.Table:
    """(id, exact, text, meta, quality, toxic) of SAMPLE labelled documents at most; rows of one id count once."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    said = said.filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = features.join(F.broadcast(said), "id").groupBy("id").agg(F.min_by(F.struct("exact", "text", "meta", "quality", "toxic"), F.struct("exact", F.hash("meta"))).alias("row"))
    return rows.select("id", "row.*").toArrow().sort_by("id")


def _lessons(views: list[View], calibrate: list[list[np.ndarray | None]]):
    """(target, view, feature, positive, negative): counts of features in the rows that the other view is sure of.

    Feature -1 counts the rows. Each task adds its rows up in arrays as long as there are features.
    """

    @tidied
    def run(batches):
        sums = [[np.zeros((2, size + 1), np.int64) for size in SIZES] for _ in TARGETS]
        for batch in batches:
            found = [_pairs(batch.column(k)) for k in (0, 1)]
            margins = [v.margins(batch.num_rows, *x) for v, x in zip(views, found)]
            for t in range(len(TARGETS)):
                for taught, teacher in ((0, 1), (1, 0)):
                    if calibrate[t][teacher] is None:
                        continue
                    p = _calibrated(calibrate[t][teacher], *margins[teacher][2 * t : 2 * t + 2])
                    for label, sure in enumerate((p >= SURE, 1 - p >= SURE)):
                        rows, features = found[taught]
                        sums[t][taught][label, :-1] += np.bincount(features[sure[rows]], minlength=SIZES[taught])
                        sums[t][taught][label, -1] += int(sure.sum())
        for t, some in enumerate(sums):
            for v, counts in enumerate(some):
                used = np.flatnonzero(counts.any(axis=0))
                names = np.where(used == SIZES[v], -1, used)
                columns = [np.full(len(used), t), np.full(len(used), v), names, counts[0, used], counts[1, used]]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["target", "view", "feature", "positive", "negative"])

    return run


def _learned(pool: DataFrame, views: list[View], calibrate: list[list[np.ndarray | None]]) -> dict[tuple[int, int], Linear]:
    """The counted model of each target and view. Only features that tell the classes apart come to the driver."""
    rows = pool.mapInArrow(_lessons(views, calibrate), "target long, view long, feature long, positive long, negative long")
    counts = keep(rows.groupBy("target", "view", "feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")), "lessons")
    totals = {(r["target"], r["view"]): (r["positive"], r["negative"]) for r in counts.filter("feature = -1").collect()}
    out = {}
    for (target, view), (p, n) in totals.items():
        if not p or not n:
            continue
        seen, a, b = F.col("positive") + F.col("negative"), F.col("positive") / p, F.col("negative") / n
        share = seen / F.lit(p + n)
        spread = F.sqrt(share * (1 - share) * F.lit(1 / p + 1 / n)) + 1e-12
        odds = F.log((F.col("positive") + 0.5) / (p + 1)) - F.log((F.col("negative") + 0.5) / (n + 1))
        use = (F.col("feature") >= 0) & (seen >= LEAST_SEEN) & (F.abs(a - b) / spread >= DEVIATIONS) & (F.abs(odds) >= LEAST_ODDS)
        found = counts.filter((F.col("target") == target) & (F.col("view") == view)).filter(use).select("feature", "positive", "negative").toArrow()
        out[target, view] = log_odds(*(found[c].to_numpy() for c in ("feature", "positive", "negative")), (p, n))
    return out


@alone
def _train(features: DataFrame, labels: DataFrame) -> Models:
    found = _sample(features, labels)
    count = found.num_rows
    pairs = [_pairs(found[c].combine_chunks()) if count else (np.zeros(0, np.int64),) * 2 for c in ("text", "meta")]
    first = np.zeros(count, bool)
    first[np.unique(found["exact"].to_numpy(), return_index=True)[1]] = True  # copies would count as evidence
    held = np.arange(count) % 10 < 10 * HELD_OUT
    models, splits, taught = {}, [], []
    fitted = [[NOTHING] * 4 for _ in SIZES]  # for each view: target by target the fitted and the counted model
    for t, (name, default) in enumerate(zip(TARGETS, (1.0, 0.0))):
        y = np.array([-1 if x is None else int(x) for x in found[name].to_pylist()], np.int64)
        own, check = (np.flatnonzero((y >= 0) & first & part) for part in (~held, held))
        splits.append((check, y[check]))
        if min(len(set(y[own])), len(set(y[check]))) < 2:
            models[name] = Model(constant=float(y[y >= 0].mean()) if (y >= 0).any() else default)
            continue
        models[name] = Model()
        taught.append(t)
        for v, size in enumerate(SIZES):
            fitted[v][2 * t] = fit(size, len(own), *_take(pairs[v], own, count), y[own].astype(float))
    pool = _unlabelled(features, labels) if taught else None
    for turn in range(ROUNDS + 1):
        views = [View(size, some) for size, some in zip(SIZES, fitted)]
        margins = [v.margins(count, *x) for v, x in zip(views, pairs)]
        if turn == ROUNDS or not taught:
            break
        calibrate: list[list[np.ndarray | None]] = [[None, None] for _ in TARGETS]
        for t in taught:
            check, y = splits[t]
            calibrate[t] = [_platt([m[2 * t + j][check] for j in (0, 1)], y) for m in margins]
        for (t, v), model in _learned(pool, views, calibrate).items():
            fitted[v][2 * t + 1] = model
    for t in taught:
        check, y = splits[t]
        models[TARGETS[t]].combine = _platt([m[2 * t + j][check] for m in margins for j in (0, 1)], y)
    return Models(views, models)


@alone
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = META) -> Models:
    """Models of quality and toxic from SAMPLE labelled documents at most and all documents that have no label.

    Labels of one id are taken together (the worst); documents of one id count once, equal texts too. A labelled
    document beyond the sample takes no part. Null ids of labels are left out; documents with a null id have none.
    """
    return _train(_features(docs, id_col, text_col, meta), labels)


def _scored(batch: pa.RecordBatch, models: Models) -> pa.RecordBatch:
    quality, toxic = models.scores(batch.num_rows, [_pairs(batch.column(k)) for k in (1, 2)])
    return pa.record_batch([batch.column(0), pa.array(quality.round(6)), pa.array(toxic.round(6)), pa.array((quality >= 0.5) & (toxic < 0.5))], names=["doc_id", "p_quality", "p_toxic", "keep"])


def _score(features: DataFrame, models: Models) -> DataFrame:
    @tidied
    def run(batches):
        for batch in batches:
            yield _scored(batch, models)

    return features.select("id", "text", "meta").mapInArrow(run, "doc_id long, p_quality double, p_toxic double, keep boolean")


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = META) -> DataFrame:
    """One row for each row of ``docs``: doc_id, p_quality, p_toxic, keep. No shuffle.

    A document is kept if it is rather good than not, and rather not toxic. Null texts are empty, null metadata
    is a value of its own; ties at one half are kept for quality and rejected for toxicity. Texts longer than
    SLICE are read in blocks, so memory grows only with their distinct words.
    """
    return _score(_features(docs, id_col, text_col, meta), models)


def keep_good(docs: DataFrame, models: Models, text_col: str = "text", meta: tuple[str, ...] = META) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    at = [docs.columns.index(c) for c in (text_col, *meta)]

    @tidied
    def run(batches):
        used = models.views[0].index()[: 1 << BITS] < len(models.views[0].names)
        for batch in batches:
            texts = texts_of(batch.column(at[0]))
            for low, high in slices([len(x) for x in texts], SLICE):
                found = [text_features(texts[low:high], used), meta_features({c: batch.column(k)[low:high].to_pylist() for k, c in zip(at[1:], meta)})]
                quality, toxic = models.scores(high - low, found)
                yield batch.slice(low, high - low).filter(pa.array((quality >= 0.5) & (toxic < 0.5)))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``. Without labels of both classes a target's score is their
    mean (without any: good, not toxic); an empty table gives an empty result; other columns are ignored."""
    features = _features(docs, "doc_id", "text", META)
    return _score(features, _train(features, labels))
