"""Token ids of whole texts by a byte-level BPE vocabulary file, many texts at a time.

The library's BPE works on one pre-token at a time and knows no context, so each distinct pre-token is encoded
by the library once and its ids are kept; texts are cut into pre-tokens and put together again as vectors.
Pre-tokens are told apart by two independent 64-bit hashes; where only the second differs, the library encodes the
texts themselves. The cut follows the library's byte-level pattern:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex

from korrel.llm.common import slices, span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters that are cut at a time.
SLICE = 1 << 19
#: Where texts may be cut: a pre-token always begins there, and neither side looks across.
_CUT = re.compile(r"(?<=[\w!-~])[ \t\n\r]|(?<=[。！？，；：])(?=\w)")
#: Distinct pre-tokens kept; beyond it they are forgotten and encoded anew.
KEPT = 1_000_000

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of each code point, by the patterns \\s, \\p{L} and \\p{N}."""
    global _classes
    if _classes is None:
        every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
        found = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            marked = regex.findall(pattern, every)
            found[np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)] = kind
        _classes = found
    return _classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def piece_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span of code points."""
    raw = np.concatenate([points, np.zeros(2, np.uint32)]).view(np.uint8)
    one, other = span_hashes(raw, 4 * starts, 4 * ends, (0, 1))
    return one, other


def first_of_each(codes: np.ndarray, count: int) -> np.ndarray:
    where = np.empty(count, np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return where


def text_blocks(text: str, limit: int = SLICE) -> Iterator[str]:
    """A text in parts of about ``limit`` characters whose tokens are together the text's. Without white space
    or full stops a text is one part."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + limit) if at + limit < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def runs(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and whether a run of one class begins there; ``edges`` begin runs too."""
    kinds = character_classes()[points]
    new = np.ones(len(points) + 1, bool)
    new[1:-1] = kinds[1:] != kinds[:-1]
    new[edges] = True
    return kinds, new


def cut(points: np.ndarray, edges: np.ndarray, fixed: list[tuple[int, int]]) -> np.ndarray:
    """Whether a pre-token begins at each code point. Texts begin at ``edges``; ``fixed`` spans stay whole."""
    edges = np.concatenate([edges, np.array([x for span in fixed for x in span], np.int64)]).astype(np.int64)
    kinds, new = runs(points, edges)
    edge = np.zeros(len(points) + 1, bool)
    edge[edges] = edge[-1] = True
    starts = np.flatnonzero(new[:-1])
    ends = np.append(starts[1:], len(points))
    of = kinds[starts]
    last = ends[(of == SPACE) & ~edge[ends]] - 1  # last white space before something else in its text
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    quote = starts[(of == OTHER) & (ends - starts == 1) & ~edge[ends]]
    quote = quote[(points[quote] == 39) & new[quote]]
    if len(quote):
        padded = np.concatenate([points, [0, 0]])
        after, then = padded[quote + 1], padded[quote + 2]
        inside = ~edge[np.minimum(quote + 2, len(points))]
        two = np.isin(after, [ord(x) for x in "stmd"])
        pairs = ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))
        three = inside & np.any([(after == a) & (then == b) for a, b in pairs], axis=0)
        for span, hit in ((2, two), (3, three & ~two)):
            new[quote[hit] + 1] = False
            new[quote[hit] + span] = True
    for a, b in fixed:
        new[a + 1 : b] = False
    return new


class Encoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said["pre_tokenizer"]
        if said["normalizer"] or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("not a byte-level vocabulary without normalizer or prefix space")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"]):
            raise ValueError("added tokens that take their surroundings aren't known here")
        if any(_CUT.search(x["content"]) for x in said["added_tokens"]):
            raise ValueError("added tokens with white space aren't known here")
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in said["added_tokens"]) or r"(?!)")
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.spaced[[i for x, i in self.library.get_vocab().items() if x[0] == "Ġ"]] = True
        self.forget()

    def forget(self):
        self.slots: dict[int, int] = {}
        # what is known so far: checks[:known], and the ids of each from first[k] to first[k + 1]
        self.known, self.checks, self.first = 0, np.zeros(1 << 14, np.uint64), np.zeros((1 << 14) + 1, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _learn(self, hashes: list[int], checks: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Encode new pre-tokens; where each is kept."""
        # words with one space before them stay apart when they are joined; there tokens with a space begin words
        spaced = [x[0] == " " and x[1:].isalpha() for x in pieces]
        order = sorted(range(len(pieces)), key=spaced.__getitem__)
        hashes, pieces = [hashes[k] for k in order], [pieces[k] for k in order]
        alone = len(pieces) - sum(spaced)
        found = [x.ids for x in self.library.encode_batch_fast(pieces[:alone], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        new = np.fromiter((y for x in found for y in x), np.uint32, int(sizes.sum()))
        if alone < len(pieces):
            text = ["".join(pieces[k : k + 4096]) for k in range(alone, len(pieces), 4096)]
            joined = np.concatenate([np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(text, add_special_tokens=False)])
            begins = np.flatnonzero(self.spaced[joined])
            if len(begins) != len(pieces) - alone:
                raise ValueError("joined words don't come back as many")
            sizes = np.concatenate([sizes, np.diff(begins, append=len(joined))])
            new = np.concatenate([new, joined])
        low, high = self.known, self.known + len(pieces)
        begin = self.first[low]
        while len(self.ids) < begin + len(new):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.checks) < high:
            self.checks = np.concatenate([self.checks, np.zeros_like(self.checks)])
            self.first = np.concatenate([self.first, np.zeros(len(self.first) - 1, np.int64)])
        self.ids[begin : begin + len(new)] = new
        self.checks[low:high] = checks[order]
        self.first[low + 1 : high + 1] = begin + np.cumsum(sizes)
        self.slots.update(zip(hashes, range(low, high)))
        self.known = high
        where = np.empty(len(pieces), np.int64)
        where[order] = np.arange(low, high)
        return where

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one more entry than texts)."""
        out, sizes = [], []
        for low, high in slices([len(x) for x in texts], SLICE):
            if len(texts[low]) <= SLICE:
                ids, counts = self._slice(texts[low:high])
            else:
                parts = [self._slice([x])[0] for x in text_blocks(texts[low])]
                ids = np.concatenate(parts)
                counts = np.array([len(ids)])
            out.append(ids)
            sizes.append(counts)
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > KEPT:
            self.forget()
        text = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths)])
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        fixed = []
        if self.special.search(text):
            for at, one in zip(begin.tolist(), texts):
                fixed += [(at + m.start(), at + m.end()) for m in self.special.finditer(one)]
        points = code_points(text)
        starts = np.flatnonzero(cut(points, begin, fixed)[:-1])
        ends = np.append(starts[1:], len(points))
        hashes, checks = piece_hashes(points, starts, ends)
        codes, distinct = pd.factorize(hashes)
        where = first_of_each(codes, len(distinct))
        sure = checks[where]
        if (sure[codes] != checks).any():
            return self._plain(texts)
        keys = distinct.tolist()
        slots = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        known = slots >= 0
        if (self.checks[slots[known]] != sure[known]).any():
            self.forget()
            slots[:] = -1
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            at = where[missing]
            pieces = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            slots[missing] = self._learn([keys[k] for k in missing.tolist()], sure[missing], pieces)
        slot = slots[codes]
        size = self.first[slot + 1] - self.first[slot]
        total = np.cumsum(size)
        at = np.arange(total[-1]) + np.repeat(self.first[slot] - (total - size), size)
        before = np.searchsorted(starts, begin)
        bounds = np.concatenate([[0], total])[before]
        return self.ids[at], np.diff(bounds)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library alone."""
        found = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


