"""Token counts by finite-state transducers compiled from a word-end BPE vocabulary file.

Two deterministic transducers run one after the other. The first has seven states over six character classes
and says where pre-tokens begin, by the pattern 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ .
Text is cut into chunks; each chunk's map from any state to the state behind it is found for all chunks at once,
the maps are composed by a parallel prefix scan, and the scan gives each chunk's first state.

The second reads a pre-token's bytes; its transitions carry the change of the token count. BPE's tokens of a text
with one more symbol are those of some shorter prefix and one token more, the only one that fits its neighbour.
So a state is the longest suffix that some token goes on from, and for each such suffix the last token before it
and the tokens since. States are interned and transitions compiled as texts first need them.

Its chunk maps take the state before a chunk to the state behind it and to the tokens that the chunk puts out.
All that depends on the state before is what the chunk has of a pre-token begun earlier; the rest starts in the
first state and is a constant. Maps are composed pair by pair, so that a text's tokens are those of one map.
"""

from __future__ import annotations

import json
import os
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import slices, tidied
from korrel.llm.encode import LETTER, character_classes, code_points, first_of_each, piece_hashes, text_blocks

LIMIT = 2048
#: Characters counted at a time, characters of a chunk, and what is kept before it is compiled anew.
SLICE, CHUNK, KEPT, STATES = 1 << 19, 128, 500_000, 150_000

GAP, WORD, DIGIT, SIGNS, ONE_MORE, TWO_MORE, SHORT_FORM = range(7)
#: Classes: space, letter, number, other, quote that one letter of a short form follows, or two.
QUOTE_ONE, QUOTE_TWO = 4, 5


def _class_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a pre-token begins, for each state and class."""
    after = np.tile(np.array([GAP, WORD, DIGIT, SIGNS, ONE_MORE, TWO_MORE], np.uint8), (7, 1))
    begins = np.tile(np.array([False, True, True, True, True, True]), (7, 1))
    begins[WORD, LETTER] = False
    after[SIGNS, [QUOTE_ONE, QUOTE_TWO]] = SIGNS
    begins[SIGNS, [3, QUOTE_ONE, QUOTE_TWO]] = False
    after[ONE_MORE, LETTER], after[TWO_MORE, LETTER] = SHORT_FORM, ONE_MORE
    begins[[ONE_MORE, TWO_MORE], LETTER] = False
    return after, begins


AFTER, BEGINS = _class_transducer()


def classes_of(points: np.ndarray) -> np.ndarray:
    kinds = character_classes()[points]
    quote = np.flatnonzero(points[:-2] == 39)
    a, b = points[quote + 1], points[quote + 2]
    kinds[quote[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE_ONE
    pairs = [(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")]
    kinds[quote[np.any(pairs, axis=0)]] = QUOTE_TWO
    return kinds


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """For each chunk the map of all chunks up to it, by doubling."""
    reach = 1
    while reach < len(maps):
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], 1)])
        reach *= 2
    return maps


def beginnings(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each place."""
    count = -(-len(kinds) // CHUNK)
    padded = np.zeros(count * CHUNK, np.int64)
    padded[: len(kinds)] = kinds
    steps = np.ascontiguousarray(padded.reshape(count, CHUNK).T)
    after, begins = (AFTER.astype(np.int64) * 6).ravel(), BEGINS.ravel()  # states come times six
    # a chunk with a gap in it has a constant map, found from any state; the others are followed from all seven
    ends = np.zeros(count, np.int64)
    for step in steps:
        ends = after[ends + step]
    maps = np.repeat(ends[:, None], 7, 1)
    whole = np.flatnonzero((steps != 0).all(axis=0))
    if len(whole):
        lanes = np.repeat(np.arange(0, 42, 6)[None, :], len(whole), 0)
        for step in steps[:, whole]:
            lanes = after[lanes + step[:, None]]
        maps[whole] = lanes
    state = np.zeros(count, np.int64)
    state[1:] = compose_scan(maps // 6)[:-1, GAP] * 6
    found = np.empty(steps.shape, bool)
    for k, step in enumerate(steps):
        at = state + step
        found[k] = begins[at]
        state = after[at]
    return found.T.reshape(-1)[: len(kinds)]


class ChunkMap(NamedTuple):
    """What a chunk does to the piece transducer.

    ``enter``: the bytes that are read in the state one comes with, and ``ends``, whether a pre-token ends with
    them; ``tokens``: those that the rest puts out; ``state``: the one behind, None if it is where ``enter`` leads.
    """

    enter: bytes
    ends: bool
    tokens: int
    state: int | None


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable ones stand for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PieceTransducer:
    """Tokens are strings of symbols: chr(byte), or chr(256 + byte) for a pre-token's last byte."""

    def __init__(self, vocabulary, merges, suffix: str):
        letters = _byte_letters()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            body = [chr(letters[x]) for x in (token[: -len(suffix)] if ends else token)]
            if ends:
                body[-1] = chr(256 + ord(body[-1]))
            return "".join(body)

        self.ranks = {(symbols(a), symbols(b)): k for k, (a, b) in enumerate(merges)}
        self.vocabulary = {symbols(x) for x in vocabulary}
        self.edges: dict = {}
        self.prefixes = {x[:k] for x in self.vocabulary for k in range(len(x))}
        self.forget()

    def forget(self):
        self.interned = {("", ((0, None, 0),)): 0}
        self.states = [("", ((0, None, 0),))]
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: again and again the leftmost pair of the lowest rank."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: str):
        """What stands at the token's right and left edge as it is merged, each with the rank that ends it; None if BPE splits it."""
        if token not in self.edges:
            parts, right, left = list(token), [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(pair, len(self.ranks)), k) for k, pair in enumerate(zip(parts, parts[1:])))
                if rank == len(self.ranks):
                    break
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            never = len(self.ranks)
            self.edges[token] = ([*right, (token, never)], [*left, (token, never)]) if len(parts) == 1 else None
        return self.edges[token]

    def _fits(self, before: str | None, token: str) -> bool:
        """Whether BPE leaves ``before`` and ``token`` side by side: no merge across comes before those at its sides."""
        own = self._edges(token)
        if own is None or before is None:
            return own is not None
        right, left, i, j = self._edges(before)[0], own[1], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            across = self.ranks.get((x, y))
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if i + 1 == len(right) and j + 1 == len(left):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _move(self, state: int, symbol: str) -> tuple[int, int]:
        suffix, live = self.states[state]
        found = []
        for depth, before, since in live:
            token = suffix[len(suffix) - depth :] + symbol
            if token in self.vocabulary and self._fits(before, token):
                found.append((token, 1 - since))
        if len(found) != 1:
            raise ValueError("not a proper BPE vocabulary: a prefix has no single last token")
        token, change = found[0]
        if ord(symbol) > 255:
            return 0, change
        longer = tuple((depth + 1, before, since + change) for depth, before, since in live if suffix[len(suffix) - depth :] + symbol in self.prefixes)
        deepest = max((x[0] for x in longer), default=0)
        key = ((suffix + symbol)[len(suffix) + 1 - deepest :], ((0, token, 0), *longer))
        if key not in self.interned:
            self.interned[key] = len(self.states)
            self.states.append(key)
        return self.interned[key], change

    def run(self, state: int, symbols: bytes, ends: bool) -> tuple[int, int]:
        """The state behind ``symbols``, the last of which ends a pre-token if ``ends``, and the tokens put out."""
        total, moves, last = 0, self.moves, len(symbols) - 1 if ends else -1
        for k, byte in enumerate(symbols):
            key = state << 9 | byte | (k == last) << 8
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, chr(byte + 256 * (k == last)))
            state, change = move
            total += change
        return state, total

    def count(self, piece: bytes) -> int:
        return self.run(0, piece, True)[1]

    def then(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks one after the other."""
        if not b.enter:
            return ChunkMap(a.enter, a.ends, a.tokens + b.tokens, b.state)
        if a.state is None:
            return ChunkMap(a.enter + b.enter, b.ends, b.tokens, b.state)
        state, more = self.run(a.state, b.enter, b.ends)
        return ChunkMap(a.enter, a.ends, a.tokens + more + b.tokens, state if b.state is None else b.state)

    def composed(self, maps: list[ChunkMap]) -> ChunkMap:
        while len(maps) > 1:
            pairs = [self.then(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[2 * len(pairs) :]
        return maps[0]


class TokenCounter:
    """Counts what ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` would return."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = [x["type"] for x in said["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or said["model"]["end_of_word_suffix"] is None:
            raise ValueError("this compiles lower-casing vocabularies with word ends")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"]):
            raise ValueError("added tokens that take their surroundings aren't known here")
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        added = {x["content"] for x in said["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added))) or r"(?!)")
        vocabulary = [x for x in said["model"]["vocab"] if x not in added]
        self.pieces = PieceTransducer(vocabulary, said["model"]["merges"], said["model"]["end_of_word_suffix"])
        self.known: dict[int, tuple[int, int]] = {}

    def _normal(self, text: str) -> tuple[str, int]:
        extra = 0
        if "<|" in text:
            text, extra = self.special.subn("\n", text)
        return (text.lower() if text.isascii() else self.normalize(text)), extra

    def counts(self, texts: list[str]) -> np.ndarray:
        out = []
        for low, high in slices([len(x) for x in texts], SLICE):
            if len(texts[low]) <= SLICE:
                out.append(self._slice(texts[low:high]))
            else:
                out.append(np.array([sum(int(self._slice([x])[0]) for x in text_blocks(texts[low], SLICE))]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _whole(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens that lie in one chunk: each distinct one is run once."""
        hashes, checks = piece_hashes(points, starts, ends)
        codes, distinct = pd.factorize(hashes)
        where = first_of_each(codes, len(distinct))
        sure = checks[where]
        if (sure[codes] != checks).any():  # two of one hash: each is run by itself
            return np.array([self.pieces.count(text[a:b].encode()) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        found = np.zeros(len(distinct), np.int64)
        for k, (key, check) in enumerate(zip(distinct.tolist(), sure.tolist())):
            known = self.known.get(key)
            if known is None or known[0] != check:
                known = self.known[key] = check, self.pieces.count(text[starts[where[k]] : ends[where[k]]].encode())
            found[k] = known[1]
        return found[codes]

    def _slice(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known.clear()
        if len(self.pieces.states) > STATES:
            self.pieces.forget()
        normal = [self._normal(x) for x in texts]
        text = "\n".join([x for x, _ in normal]) + "\n\n\n"  # a gap behind each text brings the first state back
        points = code_points(text)
        kinds = classes_of(points)
        begin = beginnings(kinds)
        stops = np.flatnonzero(begin | (kinds == 0))
        own = np.flatnonzero(begin[stops])
        starts, ends = stops[own], stops[own + 1]
        # chunks end where texts do, and so every text is some whole chunks
        lengths = np.fromiter((len(x) + 1 for x, _ in normal), np.int64, len(normal))
        first = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.unique(np.concatenate([np.arange(0, first[-1], CHUNK), first]))
        at, to = (np.searchsorted(edges, x, "right") - 1 for x in (starts, ends - 1))
        whole = at == to
        tokens = np.bincount(at[whole], self._whole(text, points, starts[whole], ends[whole]), len(edges)).astype(np.int64).tolist()
        count = len(edges) - 1
        enter, closes, state, edge = [b""] * count, [False] * count, [0] * count, edges.tolist()
        for a, b, c, d in zip(*(x[~whole].tolist() for x in (starts, ends, at, to))):
            state[c], more = self.pieces.run(0, text[a : edge[c + 1]].encode(), False)
            tokens[c] += more
            for k in range(c + 1, d):
                enter[k], state[k] = text[edge[k] : edge[k + 1]].encode(), None
            enter[d], closes[d] = text[edge[d] : b].encode(), True
        maps = list(map(ChunkMap, enter, closes, tokens, state))
        bounds = np.searchsorted(edges, first).tolist()
        found = [self.pieces.composed(maps[a:b]).tokens for a, b in zip(bounds, bounds[1:])]
        return np.array(found, np.int64) + np.fromiter((n for _, n in normal), np.int64, len(normal))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. No shuffle.

    Special strings in texts count as one token each, as the library has it by default. A null text is empty and
    has no bytes or tokens; null and repeated ids come back as they are; other columns are ignored. Texts longer
    than SLICE are counted part by part, cut where no token can reach across, so memory doesn't grow with them.
    """

    @tidied
    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = counter(tokenizer).counts(texts)
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.record_batch([batch.column(0), sizes, pa.array(found), pa.array(found > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
