"""Nesting from raw texts against a stack, and patterns over it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from korrel.operators import extract, rules, syntax
from korrel.plans.errors import CommandInvalid


def spans_by_hand(text):
    """(start, end, depth, parent's start) of each bracket that opens; ends by partners of one kind, then by a stack."""
    pairs, partner, stacks = dict(zip(")]}", "([{")), {}, {x: [] for x in "([{"}
    for k, c in enumerate(text):
        if c in stacks:
            stacks[c].append(k)
        elif c in pairs and stacks[pairs[c]]:
            partner[stacks[pairs[c]].pop()] = k
    whole, open_, end = set(partner) | set(partner.values()), [], {}
    for k in sorted(whole):
        if text[k] in stacks:
            open_.append(k)
        else:
            end[open_.pop()] = k + 1
    for k, c in enumerate(text):
        if c in stacks:
            around = [s for s, e in end.items() if s < k < e]
            yield k, end.get(k, k + 1), len(around), max(around, default=None)


def test_brackets_by_a_stack(spark):
    rng = random.Random(8)
    texts = ["", "([{}])", "(]", ")(", "((", "([)]", None] + ["".join(rng.choice("()[]{}ab\n") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    starts = {}
    found = extract.brackets(df, "id", "text").collect()
    for r in found:
        starts[r["id"], r["slot"]] = r["start"]
    told = {}
    for r in found:
        told.setdefault(r["id"], set()).add((r["start"], r["end"], r["depth"], starts.get((r["id"], r["parent"]))))
        assert r["line"] == texts[r["id"]][: r["start"]].count("\n") + 1 and r["end_line"] == texts[r["id"]][: r["end"]].count("\n") + 1
    assert told == {k: set(spans_by_hand(t)) for k, t in enumerate(texts) if t and any(c in "([{" for c in t)}


PAGE = """<!DOCTYPE html><html><body class='main'>
<!-- <p>not here</p> --><script>var t = "</p><a>";</script>
<ul id=menu><li><a href="/One">One</a></li><li><b>x<br/></b><a class=y href='/two'>two</a></li></ul>
<p>open<div><P>shut</P></div></body>"""


def test_elements_of_a_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "no tags")], "id int, html string")
    rows = {(r["kind"], PAGE[r["start"] : r["end"]]): r for r in extract.elements(df, "id", "html").collect()}
    assert {r["id"] for r in rows.values()} == {1}
    kinds = sorted(k for k, _ in rows)
    assert kinds == sorted(["html", "body", "comment", "script", "ul", "li", "li", "a", "b", "br", "a", "p", "div", "p"])
    by = {r["slot"]: r for r in rows.values()}
    two = rows["a", "<a class=y href='/two'>two</a>"]
    assert by[two["parent"]]["kind"] == "li" and by[by[two["parent"]]["parent"]]["kind"] == "ul" and two["depth"] == 3 and two["line"] == 3
    assert rows["p", "<p>"]["depth"] == 1 and rows["p", "<P>shut</P>"]["depth"] == 2 and ("html", "<html>") in rows
    defs, refs = extract.facts(df, "id", "html")
    assert {r["name"] for r in defs.collect()} == {None, "main", "menu", "y"}
    assert {(r["kind"], r["name"], by[r["from_slot"]]["kind"]) for r in refs.collect()} == {("href", "/One", "li"), ("href", "/two", "li")}


@pytest.mark.parametrize(
    "query, texts",
    [
        ("(li (a) @violation)", ['<a href="/One">One</a>', "<a class=y href='/two'>two</a>"]),
        ("(li (b) (a) @violation)", ["<a class=y href='/two'>two</a>"]),
        ("(li (a) (b) @violation)", []),
        ('(_ (a) @violation (#eq? @violation "<a class=y href=\'/two\'>two</a>"))', ["<a class=y href='/two'>two</a>"]),
        ('(li (a) @violation (#not-match? @violation "One"))', ["<a class=y href='/two'>two</a>"]),
        ('(ul (li (_) @x) @violation (#any-of? @x "<b>x<br/></b>" "none"))', ["<li><b>x<br/></b><a class=y href='/two'>two</a></li>"]),
        ("(ul (li (a) @x) @violation (#not-eq? @x @violation))", ['<li><a href="/One">One</a></li>', "<li><b>x<br/></b><a class=y href='/two'>two</a></li>"]),
    ],
)
def test_patterns(spark, query, texts):
    df = spark.createDataFrame([(1, PAGE)], "id int, html string")
    assert sorted(r["text"] for r in rules.check(df, "id", "html", f"q:{query}").collect()) == sorted(texts)


@pytest.mark.parametrize("query", ["", "(a", "a)", "(a))", "(a) (b)", "(a) @x (b)", "(a (#eq? @x))", "(a (#odd? @x 1))", "(a)", '(a) @x (#eq? @y "1")', "(a (b) @x) @x", "(() @x)"])
def test_patterns_that_cant_be_read(spark, query):
    df = spark.createDataFrame([(1, PAGE)], "id int, html string")
    with pytest.raises(CommandInvalid):
        syntax.matches(extract.elements(df, "id", "html"), df, "id", "html", query)


def test_no_pair_is_made_that_doesnt_match(spark):
    """Ten thousand siblings: a child is joined by its parent, not by its text."""
    df = spark.range(1).select(F.col("id"), F.concat(F.lit("<ul>"), F.repeat(F.lit("<li><a>1</a></li>"), 10_000), F.lit("</ul>")).alias("html"))
    assert syntax.matches(extract.elements(df, "id", "html"), df, "id", "html", "(ul (li (a) @x))").count() == 10_000


def test_a_pattern_reads_the_pages_once(spark):
    """The tags of a page aren't taken apart again for each part of a pattern."""
    from korrel.operators import extract, syntax

    pages = spark.createDataFrame([(1, "<ul><li><a>X</a></li><li><a>y</a></li></ul>")], "page_id long, html string")
    found = syntax.matches(extract.elements(pages, "page_id", "html"), pages, "page_id", "html", '(ul (li (a) @violation) (#match? @violation "[A-Z]"))')
    assert [r["text"] for r in found.collect()] == ["<a>X</a>"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 0
