"""Patterns over nested nodes: ``(ul (li (a) @violation)) (#match? @violation "href")``.

A pattern names a node's kind (``_``: any) and, inside it, children in their order; ``@name`` captures the node before
it. Predicates: #eq? #not-eq? (with a text or another capture), #any-of?, #match? and #not-match?. Each child is an
equality join on its text and parent, so no more rows arise than there are matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.plans.errors import CommandInvalid
from korrel.session import checkpointed

_TOKEN = re.compile(r'\s*(?:([()])|("(?:[^"\\]|\\.)*")|([^\s()"]+))')


@dataclass
class Pattern:
    kind: str
    capture: str | None = None
    children: list[Pattern] = field(default_factory=list)


def read(text: str) -> tuple[Pattern, list[list[str]]]:
    """The pattern of a query and its predicates, each a list of its words."""
    stack: list[list] = [[]]
    at = 0
    text = text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise CommandInvalid(f"the query can't be read at {at}")
        at = found.end()
        paren, quoted, word = found.groups()
        if paren == "(":
            stack.append([])
        elif paren:
            if len(stack) == 1:
                raise CommandInvalid("a bracket too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", quoted[1:-1]) if quoted else word)
    if len(stack) > 1:
        raise CommandInvalid("a bracket is missing")
    predicates: list[list[str]] = []
    nodes = _nodes(stack[0], predicates)
    if len(nodes) != 1:
        raise CommandInvalid("a query has one pattern")
    return nodes[0], predicates


def _nodes(items: list, predicates: list[list[str]]) -> list[Pattern]:
    out: list[Pattern] = []
    for item in items:
        if isinstance(item, str):
            if not item.startswith("@") or not out:
                raise CommandInvalid(f"{item} stands for nothing here")
            out[-1].capture = item[1:]
        elif item and isinstance(item[0], str) and item[0].startswith("#"):
            if item[0] not in _PREDICATES or len(item) < 3 or not all(isinstance(x, str) for x in item):
                raise CommandInvalid(f"{item[0]} isn't a predicate with a capture and a value")
            predicates.append(item)
        elif item and isinstance(item[0], str):
            out.append(Pattern(item[0], None, _nodes(item[1:], predicates)))
        else:
            raise CommandInvalid("a node has a kind")
    return out


def _kinds(p: Pattern) -> set[str]:
    return {p.kind}.union(*map(_kinds, p.children))


def _value(word: str, texts: dict[str, Column]) -> Column:
    if not word.startswith("@"):
        return F.lit(word)
    if word[1:] not in texts:
        raise CommandInvalid(f"{word} isn't captured")
    return texts[word[1:]]


_PREDICATES = {
    "#eq?": lambda text, values: text == values[0],
    "#not-eq?": lambda text, values: text != values[0],
    "#any-of?": lambda text, values: text.isin(*values),
    "#match?": lambda text, values: F.regexp_like(text, values[0]),
    "#not-match?": lambda text, values: ~F.regexp_like(text, values[0]),
}


def matches(nodes: DataFrame, texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, capture, start, end, line, text): the captured nodes of every match, each once.

    ``nodes`` are those of ``extract.elements`` or ``brackets`` of ``texts`` (key, text).
    """
    pattern, predicates = read(query)
    kinds = _kinds(pattern)
    nodes = nodes if "_" in kinds else nodes.filter(F.col("kind").isin(*kinds))
    nodes = checkpointed(nodes.select(key, "kind", "slot", "start", "end", "line", "parent"))  # each part of the pattern reads them
    captured: dict[str, int] = {}
    count = 0

    def join(found: DataFrame | None, p: Pattern, above: int | None, left: int | None) -> tuple[DataFrame, int]:
        nonlocal count
        me, count = count, count + 1
        own = nodes if p.kind == "_" else nodes.filter(F.col("kind") == p.kind)
        own = own.select(F.col(key), *(F.col(c).alias(f"{c}{me}") for c in ("slot", "start", "end", "line", "parent")))
        if found is None:
            found = own
        else:
            found = found.join(own.withColumnRenamed(f"parent{me}", f"slot{above}"), [key, f"slot{above}"])
            if left is not None:
                found = found.filter(F.col(f"start{me}") > F.col(f"start{left}"))
        if p.capture is not None:
            if p.capture in captured:
                raise CommandInvalid(f"@{p.capture} is captured twice")
            captured[p.capture] = me
        last = None
        for child in p.children:
            found, last = join(found, child, me, last)
        return found, me

    found, _ = join(None, pattern, None, None)
    if not captured:
        raise CommandInvalid("a query captures something")
    found = found.join(texts.select(F.col(key), F.col(text).alias("__text")), key)
    source = {c: F.substring("__text", F.col(f"start{k}") + 1, F.col(f"end{k}") - F.col(f"start{k}")) for c, k in captured.items()}
    for name, first, *rest in predicates:
        found = found.filter(_PREDICATES[name](_value(first, source), [_value(x, source) for x in rest]))
    rows = [F.struct(F.lit(c).alias("capture"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"), F.col(f"line{k}").alias("line"), source[c].alias("text")) for c, k in captured.items()]
    return found.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*").distinct()
