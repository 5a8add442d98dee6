"""Operators on rows made by hand."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korrel.operators import certify, facts, logs, pipeline, ranking, rules, structured, text
from korrel.plans import errors
from korrel.plans.policy import Access, Mask


# text search


def corpus(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")


def hits(df):
    return sorted((r["k"], r["line_no"], r["column"], r["line"]) for r in df.collect())


def test_literal_is_whole_before_alternatives(spark):
    df = corpus(spark, "a|b here\nnothing", "b first\n  a", "", None)
    assert hits(text.search_lines(df, "k", "t", "a|b")) == [(0, 1, 1, "a|b here")]
    assert hits(text.search_lines(df.filter("k = 1"), "k", "t", "a|b")) == [(1, 1, 1, "b first"), (1, 2, 3, "  a")]
    assert text.alternatives("a||b") == ["a||b"]


def test_regex_and_required_literals(spark):
    df = corpus(spark, "foo1 bar\nfo bar", "Été chaud")
    assert hits(text.search_lines(df, "k", "t", r"foo\d\s+b", regex=True)) == [(0, 1, 1, "foo1 bar")]
    assert hits(text.search_lines(df, "k", "t", r"\w+ chaud", regex=True)) == [(1, 1, 1, "Été chaud")]
    assert text.required_literals(r"foo\d+bar|bazz?") == ["foo", "baz"]
    assert text.required_literals("(?i)foo") == [] and text.required_literals("a*") == []


def test_lines_end(spark):
    df = corpus(spark, "a\r\nb\n", "c")
    assert [(r["k"], r["line_no"], r["line"]) for r in text.lines(df, "k", "t").orderBy("k", "line_no").collect()] == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12), min_size=1, max_size=8), st.text(alphabet="ab", min_size=1, max_size=3))
def test_occurrences_by_hand(spark, texts, literal):
    found = {r["k"]: r["n"] for r in corpus(spark, *texts).select("k", text.occurrences(F.col("t"), literal).alias("n")).collect()}
    assert found == {k: sum(t.startswith(literal, i) for i in range(len(t))) for k, t in enumerate(texts)}


def test_trigram_candidates_lose_nothing(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(30)) for _ in range(60)]
    df = corpus(spark, *texts)
    found = {r["k"] for r in text.candidates(text.postings(df, "k", "t"), "k", ["abca", "dcb"]).collect()}
    assert {k for k, t in enumerate(texts) if "abca" in t or "dcb" in t} <= found
    assert text.candidates(text.postings(df, "k", "t"), "k", ["ab"]) is None


def test_scope_snippet_escapes_sniff(spark):
    paths = spark.createDataFrame([("Src/a",), ("src",), ("srcs/a",)], "p string")
    assert [r["p"] for r in paths.filter(text.in_scope(F.col("p"), "SRC/")).collect()] == ["Src/a", "src"]
    line = "x" * 200 + "HIT" + "y" * 200
    got = spark.createDataFrame([(line,)], "l string").select(text.snippet(F.col("l"), F.instr("l", "HIT"), 3)).first()[0]
    assert got.startswith("…") and got.endswith("…") and "HIT" in got and len(got) == 122
    clean = spark.createDataFrame([("\x1b[1;31mred\x1b[0m \x1b]0;t\x07x",)], "l string").select(text.strip_escapes(F.col("l"))).first()[0]
    assert clean == "red x"
    data = [(b"\xff\xfea\x00",), (b"\xfe\xff\x00a",), (b"a\x00b",), ("é".encode(),), (b"\xe9",)]
    assert [r[0] for r in spark.createDataFrame(data, "d binary").select(text.sniff(F.col("d"))).collect()] == ["utf16le", "utf16be", "binary", "utf8", "windows-1254"]


def test_minified_and_tokens(spark):
    rows = [("a.min.js", "x"), ("a.js", "y" * 5000), ("a.js", "short\n" * 1000), ("a.js", "x")]
    assert [r[0] for r in spark.createDataFrame(rows, "p string, t string").select(text.minified(F.col("p"), F.col("t"))).collect()] == [True, True, False, False]
    assert [r[0] for r in spark.createDataFrame([("word " * 19,), ("{}();" * 16,), ("",)], "t string").select(text.token_estimate(F.col("t"))).collect()] == [25, 25, 0]


def test_structured(spark):
    df = spark.createDataFrame([(1, "# A\nx\n```\n# no\n```\n## B ##\ny")], "k int, t string")
    assert [tuple(r) for r in structured.markdown_sections(df, "k", "t").orderBy("lines").collect()] == [(1, "B", 2, 2), (1, "A", 1, 5)]
    assert spark.createDataFrame([('{"a":{"b/c":[1,2]}}',)], "j string").select(structured.json_pointer(F.col("j"), "/a/b~1c/1")).first()[0] == "2"


# documents


@pytest.fixture(scope="module")
def docs(spark):
    users = spark.createDataFrame([(1, "Al", "al@x.org", "1", 30, ("Rome",)), (2, "Bo", "bo@x.org", "2", None, ("Oslo",)), (3, "Cy", "cy@x.org", "3", 50, None)], "_id int, name string, email string, ssn string, age int, profile struct<city:string>")
    orders = spark.createDataFrame([(1, 1, 9.5), (2, 1, 20.0)], "_id int, user int, total double")
    return pipeline.Documents({"users": users, "orders": orders, "secret": orders}, Access(hidden=["users.ssn"], masked={"users.email": Mask("email")}, blocked=["secret"]), {"rich": ("orders", [{"$match": {"total": {"$gt": 10}}}])})


def test_find_masks_and_hides(docs):
    rows = [r.asDict(recursive=True) for r in docs.run('{"find":"users","sort":{"_id":1},"limit":2}').collect()]
    assert rows[0] == {"_id": 1, "name": "Al", "email": "a***@x.org", "age": 30, "profile": {"city": "Rome"}} and len(rows) == 2


def test_null_and_missing(docs):
    assert [r["_id"] for r in docs.run({"find": "users", "filter": {"age": None}}).collect()] == [2]
    assert sorted(r["_id"] for r in docs.run({"find": "users", "filter": {"age": {"$ne": 30}}}).collect()) == [2, 3]
    assert sorted(r["_id"] for r in docs.run({"find": "users", "filter": {"age": {"$not": {"$gt": 40}}}}).collect()) == [1, 2]
    assert [r["_id"] for r in docs.run({"find": "users", "filter": {"profile.city": "Oslo"}}).collect()] == [2]
    assert docs.run({"countDocuments": "users", "filter": {"nothing": 1}}).collect() == []


def test_views_and_foreign_collections(docs):
    assert docs.run({"countDocuments": "rich"}).first()["n"] == 1
    for spec, refusal in [
        ({"aggregate": "orders", "pipeline": [{"$unionWith": "users"}]}, errors.OperatorDenied), ({"aggregate": "orders", "pipeline": [{"$lookup": {"from": "secret", "localField": "_id", "foreignField": "_id", "as": "x"}}]}, errors.TableRefused),
        ({"find": "system.views"}, errors.TableRefused), ({"find": "users", "sort": {"email": 1}}, errors.MaskedFieldUsed), ({"aggregate": "users", "pipeline": [{"$group": {"_id": "$ssn"}}]}, errors.HiddenFieldUsed),
        ({"aggregate": "users", "pipeline": [{"$project": {"e": "$email"}}]}, errors.MaskedFieldUsed), ({"aggregate": "users", "pipeline": [{"$limit": 0}]}, errors.CommandInvalid), ("{bad", errors.CommandInvalid), ({"aggregate": "users", "pipeline": [{"$nope": 1}]}, errors.OperatorDenied),
    ]:
        with pytest.raises(refusal):
            docs.run(spec)


def test_expressions_at_the_edges(docs):
    one = lambda e: docs.run({"aggregate": "orders", "pipeline": [{"$limit": 1}, {"$project": {"_id": 0, "v": e}}]}).first()["v"]
    assert one({"$round": [2.5]}) == 2 and one({"$round": [2.345, 2]}) == 2.34 and one({"$trunc": -2.7}) == -2
    assert one({"$divide": [1, 0]}) is None and one({"$range": [5, 0, -2]}) == [5, 3, 1] and one({"$range": [1, 1]}) == []
    assert one({"$slice": [[1, 2, 3, 4], -2]}) == [3, 4] and one({"$slice": [[1, 2, 3, 4], 1, 2]}) == [2, 3] and one({"$arrayElemAt": [[1, 2], 5]}) is None
    assert one({"$substrCP": ["hello", 1, 3]}) == "ell" and one({"$indexOfCP": ["abc", "z"]}) == -1 and one({"$replaceOne": {"input": "aa", "find": "a", "replacement": "b"}}) == "ba"
    assert one({"$setEquals": [[1, 2, 2], [2, 1]]}) is True and one({"$sortArray": {"input": [3, 1, 2], "sortBy": -1}}) == [3, 2, 1]
    assert one({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True}}) == [[1, 3], [2, None]] and one({"$switch": {"branches": [{"case": False, "then": 1}], "default": 2}}) == 2
    assert one({"$dateToString": {"date": {"$date": "2024-02-29T01:02:03"}, "format": "%Y%m%d-%H"}}) == "20240229-01" and one({"$convert": {"input": "x", "to": "int", "onError": 7}}) == 7


def test_updates(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], 5), (2, [9], 6)], "_id int, a array<int>, n int")
    run = lambda change: {r["_id"]: (r["a"], r["n"]) for r in pipeline.update(df, {"_id": 1}, change).collect()}
    assert run({"$push": {"a": {"$each": [7, 8], "$position": 1, "$slice": 4}}})[1] == ([1, 7, 8, 2], 5)
    assert run({"$addToSet": {"a": {"$each": [2, 4]}}})[1] == ([1, 2, 3, 4], 5) and run({"$pull": {"a": {"$gt": 1}}})[1] == ([1], 5)
    assert run({"$pullAll": {"a": [1, 3]}})[1] == ([2], 5) and run({"$pop": {"a": 1}})[1] == ([1, 2], 5) and run({"$pop": {"a": -1}})[1] == ([2, 3], 5)
    assert run({"$mul": {"n": 3}, "$max": {"n": 99}})[1] == ([1, 2, 3], 99) and run({"$bit": {"n": {"and": 4}}})[1][1] == 4 and run({"$inc": {"n": 1}})[2] == ([9], 6)
    assert pipeline.update(df, {"_id": 1}, {"$rename": {"n": "m"}, "$unset": {"a": ""}}).orderBy("_id").collect()[0].asDict() == {"_id": 1, "a": None, "n": None, "m": 5}
    with pytest.raises(errors.OperatorDenied):
        pipeline.update(df, {}, {"$where": {}})


# ranking


def test_terms(spark):
    got = spark.createDataFrame([("getHTTPResponse2 leftover-pos MAX_VALUE 9lives x",)], "t string").select(ranking.terms(F.col("t"))).first()[0]
    assert got == ["gethttpresponse2", "get", "http", "response", "leftover", "pos", "max_value", "max", "value"]


def test_bm25_prefers_rare_words_and_names(spark):
    df = spark.createDataFrame([(0, "a0", "common rare"), (1, "a1", "common common"), (2, "rare", "common"), (3, "a3", "common")], "k int, name string, t string")
    score = {r["k"]: r["score"] for r in ranking.bm25(df, "k", "t", ["rare", "rare", "common"], "name").collect()}
    assert score[2] > score[0] > score[1] and max(score.values()) <= ranking.bm25_ceiling(df.withColumn("t", F.concat_ws(" ", "name", "t")), "k", "t", ["rare", "common"]).first()[0]


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0), (0, 1, 1.0)], "src int, dst int, weight double")
    rank = {r["node"]: r["rank"] for r in ranking.pagerank(edges).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank[0] == max(rank.values())
    lean = {r["node"]: r["rank"] for r in ranking.pagerank(edges, teleport=spark.createDataFrame([(3, 1.0)], "node int, weight double")).collect()}
    assert lean[3] > rank[3] and abs(sum(lean.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        ranking.pagerank(edges, teleport=spark.createDataFrame([(3, -1.0)], "node int, weight double"))


def test_cover_in_rounds_is_the_lazy_one(spark):
    import random

    rng = random.Random(12)
    for _ in range(4):
        candidates = [(f"n{k}", rng.randint(1, 5), {f"i{rng.randrange(20)}" for _ in range(rng.randint(1, 6))}) for k in range(12)]
        gains = {f"i{k}": float(rng.randint(0, 9)) for k in range(18)}
        tables = [
            spark.createDataFrame([(n, i) for n, _, items in candidates for i in items], "name string, item string"),
            spark.createDataFrame([(n, float(c)) for n, c, _ in candidates], "name string, cost double"), spark.createDataFrame(list(gains.items()), "item string, gain double"),
        ]
        assert ranking.cover_rounds(*tables, 9.0) == ranking.greedy_cover(candidates, gains, 9.0)
    assert ranking.cover_rounds(*(t.filter("false") for t in tables), 9.0) == []


def test_bm25_counts_the_terms_that_terms_has(spark):
    """In one pass over the texts, by the same rules; a null text is a document of no size."""
    words = "getUserName XMLHttp snake_case__x $a _b a1b2 12ab ab12 A aB HTTP é_caféBar x9_Y foo Foo FOO fooBar $$ a_1 " + "q" * 70 + " q_" + "w" * 70
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(words.split(), k=9)), rng.choice(words.split())) for k in range(40)] + [(40, None, "foo"), (41, "", "")]
    df = spark.createDataFrame(rows, "id int, text string, name string")
    for name in (None, "name"):
        plain = ranking.frequencies(df, "id", "text", name).collect()
        wanted = ["foo", "bar", "user", "http", "a1b2", "ab"]
        sizes = {r["id"]: r["size"] for r in plain} | {k: 0 for k in (41,)}
        n, mean = len(rows), max(1.0, sum(sizes.values()) / len(sizes))
        hits = {(r["id"], r["term"]): r["tf"] for r in plain if r["term"] in wanted}
        df_ = {t: sum(1 for _, x in hits if x == t) for t in wanted}
        told = {}
        for (k, t), tf in hits.items():
            told[k] = told.get(k, 0.0) + math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[k] / mean))
        made = ranking.bm25(df, "id", "text", wanted, name)
        assert {r["id"]: round(r["score"], 9) for r in made.collect()} == {k: round(s, 9) for k, s in told.items()}
        assert "regexp_extract_all" not in str(made._jdf.queryExecution().toString())


def test_names_that_cover_the_same_tie_by_name(spark):
    """Sums of doubles in another order differ in their last bits; that picks nobody."""
    gains = [(k, 0.1 * 3**k) for k in range(30)]
    names = [f"n{k}" for k in range(12)]
    rows = [(n, i) for n in names for i in random.Random(n).sample(range(30), 30)]
    items = spark.createDataFrame(rows, "name string, item int").repartition(3)
    costs = spark.createDataFrame([(n, 5.0) for n in names], "name string, cost double")
    assert ranking.cover_rounds(items, costs, spark.createDataFrame(gains, "item int, gain double"), 9.0) == ["n0"]


def test_regions_are_the_trees(spark):
    import random

    rng = random.Random(3)
    paths = {"/".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) + ("/" if rng.random() < 0.9 else "") + f"f{k}" for k in range(120)} | {"top", "a/x/y/z/deep"}
    paths = {p.lstrip("/") for p in paths}
    sizes = [(p, rng.randint(1, 9)) for p in sorted(paths)]
    df = spark.createDataFrame(sizes, "p string, n int").repartition(3)
    for capacity in (1, 25, 90, 10_000):
        assert {r["p"]: r["region"] for r in ranking.tree_regions(df, "p", F.col("n"), capacity).collect()} == ranking.partition_tree(sizes, capacity)


def test_as_of_join_with_nulls_and_one_key(spark):
    from korrel.operators.logs import as_of_join

    left = [(k, 1 if k % 9 else None, k * 2 if k % 7 else None) for k in range(300)]
    right = [(k, 1 if k % 5 else None, k * 3 if k % 4 else None) for k in range(200)]
    l, r = spark.createDataFrame(left, "i int, k int, t int").repartition(5), spark.createDataFrame(right, "j int, k int, u int").repartition(3)  # noqa: E741
    found = {x["i"]: x["j"] for x in as_of_join(l, r, ["k"], "t", "u").collect()}
    for i, k, t in left:
        fits = [(u, j) for j, rk, u in right if rk is not None and rk == k and u is not None and t is not None and u <= t]
        assert found[i] == (max(fits)[1] if fits else None)
    assert as_of_join(l, r.filter("false"), ["k"], "t", "u").count() == 300 and as_of_join(l.filter("false"), r, ["k"], "t", "u").count() == 0


def test_averages_over_ranges(spark):
    from korrel.operators.prefix import smoothed

    rows = [(g, k, None if (g, k) == ("b", 30) else float((k * 7919) % 101)) for g, n in (("a", 5000), ("b", 60), ("c", 1), (None, 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, x double").repartition(9)
    found = {(r["g"], r["k"]): r["s"] for r in smoothed(df, ["g"], ["k"], F.col("x"), 0.3, "s").collect()}
    state, seen = {}, set()
    for g, k, x in rows:
        state[g] = x if g not in seen else None if state[g] is None or x is None else 0.3 * x + 0.7 * state[g]
        seen.add(g)
        assert (found[g, k] is None) == (state[g] is None) and (state[g] is None or abs(found[g, k] - state[g]) < 1e-9)
    assert len(found) == len(rows) and smoothed(df.filter("false"), [], ["k"], F.col("x"), 0.5, "s").count() == 0


def test_buckets_at_preferred_numbers(spark):
    from korrel.operators import pipeline as P

    assert [P.preferred(x, g, up) for x, g, up in ((1.0, "R5", True), (1.0, "R5", False), (7, "R5", True), (0.02, "1-2-5", True), (0, "E6", True), (8, "POWERSOF2", True), (8, "POWERSOF2", False), (99, "E12", True))] == [1.6, 0.63, 10.0, 0.05, 0.0, 16.0, 4.0, 100.0]
    db = P.Documents({"t": spark.createDataFrame([(k,) for k in range(100)], "v int").repartition(3)})
    go = lambda g: db.run({"aggregate": "t", "pipeline": [{"$bucketAuto": {"groupBy": "$v", "buckets": 5, "granularity": g}}]})
    for granularity, wanted in [("R20", [(0.0, 20.0, 20), (20.0, 40.0, 20), (40.0, 63.0, 23), (63.0, 90.0, 27), (90.0, 100.0, 10)]), ("POWERSOF2", [(0.0, 32.0, 32), (32.0, 64.0, 32), (64.0, 128.0, 36)]), ("1-2-5", [(0.0, 20.0, 20), (20.0, 50.0, 30), (50.0, 100.0, 50)])]:
        found = go(granularity).collect()
        assert [(r["_id"]["min"], r["_id"]["max"], r["count"]) for r in found] == wanted
    with pytest.raises(errors.OperatorDenied):
        go("R7")


def test_sweep_by_age_and_size(spark):
    from korrel.operators.logs import sweep

    df = spark.createDataFrame([(k, k // 2, 10) for k in range(10)] + [(99, None, 1)], "id int, used int, size int")
    assert sorted(x["id"] for x in sweep(df, "used", "size", 40).collect()) == [0, 1, 2, 3, 4, 5, 99]
    assert sorted(x["id"] for x in sweep(df, "used", "size", 1000, oldest=F.lit(2)).collect()) == [0, 1, 2, 3, 99]


def test_cover_intent_partition():
    assert ranking.greedy_cover([("a", 1, {"x"}), ("b", 1, {"y"}), ("c", 3, {"x", "y", "z"})], {"x": 1, "y": 1, "z": 9}, 3) == ["c"]
    assert ranking.intent("who really calls parse") == "callers" and ranking.intent("where is it") == "definition" and ranking.intent("tell me") == "explain"
    assert ranking.concepts("Where is the parseFile of the parseFile") == ["where", "parsefile"]


# facts


def repo(spark, files, defs, refs, imports, tokens=()):
    return facts.Facts(
        spark.createDataFrame(files, "file_id int, path string, status string"), spark.createDataFrame(defs, "file_id int, slot int, kind string, name string, qname string, line int"),
        spark.createDataFrame(refs, "file_id int, from_slot int, kind string, name string, start int, line int, target_file int, target_slot int, reason string, is_dynamic boolean"),
        spark.createDataFrame(imports, "file_id int, target_file int"), spark.createDataFrame(list(tokens), "file_id int, token string"),
    )


def test_fact_questions(spark):
    files = [(1, "a.ts", "parsed"), (2, "b.ts", "parsed"), (3, "c.ts", "parsed"), (4, "d.ts", "skipped")]
    defs = [(1, 1, "function", "f", "a.f", 1), (2, 1, "function", "g", "b.g", 1), (3, 1, "function", "h", "c.h", 1), (1, 0, "module", "f", "a", 0)]
    refs = [(2, 1, "call", "f", 5, 1, 1, 1, None, False), (3, 1, "call", "g", 7, 1, 2, 1, None, False), (2, 1, "call", "log", 9, 1, None, None, "global", False)]
    known = repo(spark, files[:3], defs, refs, [(2, 1), (3, 2)])
    answer = known.callers("f")
    assert answer.status == "complete" and [r["qname"] for r in answer.sites.collect()] == ["b.g"]
    assert [(r["depth"], r["qname"]) for r in known.callers("a.f", depth=2).sites.collect()] == [(1, "b.g"), (2, "c.h")]
    callees = known.callees("g")
    assert [r["qname"] for r in callees.sites.collect()] == ["a.f"] and callees.outside.count() == 1 and callees.status == "complete"
    assert known.references("f").sites.count() == 1 and known.stats().first().asDict() == {"refs": 3, "resolved": 2, "outside": 1, "unresolved": 0}
    for bad in (0, 5):
        with pytest.raises(errors.DepthOutOfRange):
            known.callers("f", depth=bad)
    with pytest.raises(errors.SubjectNotFound):
        known.callers("nobody")
    more = [*refs, (3, 1, "call", "f", 8, 1, None, None, "untyped_receiver", False), (3, 1, "call", "x", 9, 1, None, None, "computed_member", True)]
    partly = repo(spark, files, defs, more, [(2, 1), (3, 2)], [(4, "f")]).callers("f")
    assert partly.status == "partial" and sorted(r["why"] for r in partly.unknown.collect()) == ["dynamic_key", "same_name"] and [r["path"] for r in partly.unread.collect()] == ["d.ts"]


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    assert sorted(r["n"] for r in facts.closure(edges, spark.createDataFrame([(1,)], "n int")).collect()) == [1, 2, 3]


# logs


def test_usage_report(spark):
    def line(pos, i, tokens, model="opal-4-1", hour=0, written=0):
        return (1, pos, f'{{"type":"assistant","timestamp":"2024-01-01T00:00:0{pos}Z","message":{{"id":{i},"model":"{model}","content":[],"usage":{{"input_tokens":{tokens},"cache_creation_input_tokens":{written},"cache_creation":{{"ephemeral_1h_input_tokens":{hour}}}}}}}}}')

    rows = spark.createDataFrame([line(0, '"m"', 5), line(1, '"m"', 9, "other"), line(2, "null", 1), line(3, "null", 2, written=4, hour=9), (1, 4, "{broken"), (1, 5, "")], "session int, pos int, value string")
    read = logs.read_lines(rows)
    assert read.count() == 4
    flat = read.select("session", "pos", F.col("message.id").alias("id"), F.col("message.model").alias("model"), *(c.alias(k) for k, c in logs.usage().items()))
    last = sorted((r["model"], r["input"], r["write_5m"], r["write_1h"]) for r in logs.last_wins(flat, "session", F.col("id"), "pos", ["model"], ["input", "write_5m", "write_1h"]).collect())
    assert last == [("opal-4-1", 1, 0, 0), ("opal-4-1", 2, 0, 4), ("opal-4-1", 9, 0, 0)]
    assert spark.createDataFrame([("mcp__srv__tool",), ("plain",)], "t string").select(logs.tool_name(F.col("t"))).collect()[0][0] == "tool"


def test_gate_window(spark):
    stamp = lambda ms: F.timestamp_millis(F.lit(ms))
    events = spark.range(0, 20).select((1000 + F.col("id") * 400).alias("ms"), F.lit(1).alias("k")).withColumn("ts", F.timestamp_millis("ms"))
    window = spark.range(1).select(F.lit(1).alias("k"), stamp(1000).alias("a"), stamp(1000).alias("b"))
    found = logs.interval_join(events, "ts", window, "a", "b", ["k"], F.expr("INTERVAL 5 SECONDS"))
    assert found.count() == sum(1000 <= 1000 + 400 * k <= 6000 for k in range(20))


def test_ledger_and_receipts(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("b", 3, "z", "a"), ("c", 4, "w", "a")], "id string, pos int, text string, supersedes string")
    current, conflicts = logs.fold_ledger(rows)
    assert sorted(r["id"] for r in current.collect()) == ["b", "c"] and [tuple(r) for r in conflicts.collect()] == [("a", 2)]
    receipts = spark.createDataFrame([("p", 1, "0", "1"), ("p", 2, "1", "2"), ("p", 3, "9", "3")], "path string, seq int, before string, after string")
    assert [r["verdict"] for r in logs.replay(receipts, "path", "seq", "before", "after").orderBy("seq").collect()] == ["verified", "verified", "mismatch"]
    changed = spark.createDataFrame([("p",), ("q",)], "path string")
    assert [r["path"] for r in logs.uncovered(changed, receipts, "path").collect()] == ["q"]


# certificates


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 11])
def test_merkle_root(spark, n):
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(digests)], "k int, leaf string")
    assert certify.merkle_root(rows, "k") == certify.merkle_of(digests)


def test_canonical_json_and_status():
    assert certify.canonical({"b": [1, None, True], "a": "é\n", "€": {}}) == '{"a":"é\\n","b":[1,null,true],"€":{}}'
    with pytest.raises(ValueError):
        certify.canonical({"a": 1.5})
    assert certify.Certificate("s", 3, 2, {"binary": 1}).status() == "complete" and certify.Certificate("s", 3, 2, {}, ["x"]).status() == "partial"
    assert certify.Certificate("s", 3, 3, {}, [], {"ops": (5, 4)}).status() == "refused" and certify.Certificate("s", 1, 1).digest() == certify.Certificate("s", 1, 1).digest()


# rules


def test_rules(spark):
    df = spark.createDataFrame([(1, "feat: x\n// note\nimport os\nTODO 1"), (2, "bad subject")], "k int, t string")
    run = lambda rule: sorted((r["k"], r["line_no"]) for r in rules.check(df, "k", "t", rule).collect())
    assert run("no_todo") == [(1, 4)] and run("no_comment") == [(1, 2)] and run("require_comment") == [(2, 1)] and run("forbid_import:os") == [(1, 3)]
    assert run("conventional") == [(2, 1)] and run("max_lines:3") == [(1, 1)] and run("no_literal:number") == [(1, 4)] and run("max_subject:8") == [(2, 1)]
    with pytest.raises(ValueError):
        run("nope")


def test_added_is_a_multiset(spark):
    df = lambda t: rules.check(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", "forbid:x")
    assert rules.added(df("x\ny"), df("y\n\nx\nx"), "k").count() == 1


def test_streams(spark, tmp_path, small):
    from korrel.streaming import events as E

    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    E.run_once(E.tumbling(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), late="400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    E.run_once(E.tumbling(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), late="400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    whole = {(r["start"], r["event_type"]): r["n"] for r in E.tumbling(batch).collect()}
    streamed = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else {}
    assert all(whole[k] == n for k, n in streamed.items())


def test_files_and_lines(spark, tmp_path):
    from korrel.sources.files import list_files, scan_lines

    for name, text in (("a/one.txt", "x\ny\n"), ("a/b/two.txt", "z"), ("ab/three.txt", "u\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r["path"]: r["size"] for r in list_files(spark, str(tmp_path)).collect()}
    assert found == {"a/one.txt": 4, "a/b/two.txt": 1, "ab/three.txt": 2}
    assert {r["path"] for r in list_files(spark, str(tmp_path), "a").collect()} == {"a/one.txt", "a/b/two.txt"}
    assert sorted((r["path"].rsplit("/", 1)[1], r["line"]) for r in scan_lines(spark, str(tmp_path)).collect()) == [("one.txt", "x"), ("one.txt", "y"), ("three.txt", "u"), ("two.txt", "z")]


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    from korrel.sources.files import jdbc_table, sqlite_table

    path = str(tmp_path / "clinic.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE visits (visit INTEGER PRIMARY KEY, who VARCHAR(9), "minu tes" REAL, scan BLOB)')
        con.executemany("INSERT INTO visits VALUES (?, ?, ?, ?)", [(k * 3, f"w{k}", k / 2, bytes([k])) for k in range(50)] + [(500, None, 3, None), (501, 7, "long", b"")])
        con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        con.execute("INSERT INTO keyed VALUES ('a', 1)")
        con.execute("CREATE TABLE vacant (n INT)")
    rows = [tuple(r) for r in sqlite_table(spark, path, "visits", 5).orderBy("visit").collect()]
    assert rows[:50] == [(k * 3, f"w{k}", k / 2, bytes([k])) for k in range(50)] and rows[50:] == [(500, None, 3.0, None), (501, "7", None, b"")]
    assert [tuple(r) for r in sqlite_table(spark, path, "keyed").collect()] == [("a", 1)] and sqlite_table(spark, path, "vacant").count() == 0
    with pytest.raises(ValueError):
        sqlite_table(spark, path, "absent")
    with pytest.raises(Exception, match="(?i)driver"):
        jdbc_table(spark, "jdbc:postgresql://127.0.0.1/none", "t", "id", (0, 9))


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 13])
def test_one_leaf_updates_the_root(n):
    import hashlib

    digests = [hashlib.sha256(bytes([k])).hexdigest() for k in range(n)]
    for k in range(n):
        path = certify.audit_path(digests, k)
        assert certify.updated_root(digests[k], k, n, path) == certify.merkle_of(digests)
        new = hashlib.sha256(b"new").hexdigest()
        assert certify.updated_root(new, k, n, path) == certify.merkle_of([*digests[:k], new, *digests[k + 1 :]])
    with pytest.raises(ValueError):
        certify.updated_root(digests[0], 0, n, ["00" * 32] * 9)


def test_reports_of_other_runners(spark):
    nested = "<testsuites><testsuite><testcase classname='m' name='a'/></testsuite><testsuite><testcase classname='m' name='b'><failure message='x'>y</failure></testcase><testcase classname='n' name='c'><skipped/></testcase></testsuite></testsuites>"
    rows = spark.createDataFrame([(1, nested), (2, "<testsuite/>")], "k int, t string")
    assert sorted(map(tuple, structured.junit_cases(rows, "k", "t").collect())) == [(1, "m", "a", "passed"), (1, "m", "b", "failed"), (1, "n", "c", "skipped")]
    trx = '<TestRun xmlns="http://t"><Results><UnitTestResult testName="P.C.One" outcome="Passed"/><UnitTestResult testName="Two" outcome="NotExecuted"/><UnitTestResult testName="P.C.Three" outcome="Error"/></Results></TestRun>'
    found = structured.trx_cases(spark.createDataFrame([(1, trx)], "k int, t string"), "k", "t")
    assert sorted(map(tuple, found.collect())) == [(1, "", "Two", "skipped"), (1, "P.C", "One", "passed"), (1, "P.C", "Three", "failed")]
    said = "test_a (m.C.test_a) ... ok\ntest_b (m.C)\ntest_c (m.C.test_c) ... FAIL\ntest_d (m.C) ... expected failure\n----\nRan 3 tests"
    found = structured.unittest_cases(spark.createDataFrame([(1, said)], "k int, t string"), "k", "t")
    assert sorted(map(tuple, found.collect())) == [(1, "m.C", "test_a", "passed"), (1, "m.C", "test_c", "failed"), (1, "m.C", "test_d", "passed")]


def test_sessions_are_picked_by_name_or_prefix(spark):
    from korrel.plans.errors import SubjectNotFound

    rows = spark.createDataFrame([("abc", 5), ("abd", 9), ("ab", 1), ("x1", 7)], "s string, t int")
    assert logs.pick_session(rows, "s", "t") == "abd" and logs.pick_session(rows, "s", "t", "ab") == "ab" and logs.pick_session(rows, "s", "t", "x") == "x1"
    for wanted in ("a", "q"):
        with pytest.raises(SubjectNotFound):
            logs.pick_session(rows, "s", "t", wanted)


def test_as_of_join_takes_the_latest_that_is_not_later(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 4, 4)], "k string, t int, n int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("c", 1, "w")], "k string, at int, v string")
    assert sorted((r["n"], r["at"], r["v"]) for r in logs.as_of_join(left, right, ["k"], "t", "at").collect()) == [(1, 5, "y"), (2, None, None), (3, None, None), (4, None, None)]


def test_merged_objects_keep_what_later_ones_lack(spark):
    df = spark.createDataFrame([(1, 1, {"x": 1, "y": None}), (1, 2, {"x": None, "y": 5}), (1, 3, {"x": 7, "y": None}), (2, 1, None)], "g int, o int, d struct<x:int,y:int>")
    run = lambda way: {r["_id"]: r["m"] for r in pipeline.Documents({"c": df}).run({"aggregate": "c", "pipeline": [{"$sort": {"o": way}}, {"$group": {"_id": "$g", "m": {"$mergeObjects": "$d"}}}]}).collect()}
    up, down = run(1), run(-1)
    assert tuple(up[1]) == (7, 5) and tuple(down[1]) == (1, 5) and up[2] is None


def test_routes_and_closures_have_no_silent_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(25)], "src long, dst long")
    assert facts.closure(chain, spark.createDataFrame([(0,)], "n long")).count() == 26
    mounts = spark.createDataFrame([("", "r0", "/")] + [(f"r{k}", f"r{k + 1}", f"{k}/") for k in range(18)] + [("r3", "r1", "loop/")], "parent string, child string, prefix string")
    found = facts.routes(mounts, spark.createDataFrame([("h", "r18", "end")], "handler string, router string, path string")).collect()
    assert [r["route"] for r in found] == ["/" + "".join(f"{k}/" for k in range(18)) + "end"]


def test_what_is_used_again_is_read_once(spark, small):
    """The graph of the walks, and the counts of fielded scores, are kept."""
    from korrel.queries import facts as graph
    from korrel.queries import queries

    plan = lambda df: str(df._jdf.queryExecution().optimizedPlan())
    assert "parquet" not in plan(graph._graph(spark, small))
    assert "parquet" not in plan(queries()["rank_fielded"](spark, small))
