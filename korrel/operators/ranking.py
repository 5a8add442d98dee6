"""Relevance: terms, BM25 (plain and by fields with proximity), PageRank, mutual information, greedy coverage."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.session import checkpointed

K1, B, NAME_WEIGHT = 1.2, 0.75, 3
LEAST, MOST = 2, 64
#: Fields, their weights and length normalisation.
FIELD_WEIGHTS = {"name": 3.0, "path": 1.5, "signature": 1.0, "doc": 1.0, "body": 0.5, "outline": 2.0}
FIELD_B = {"name": 0.3, "path": 0.3, "signature": 0.3, "doc": 0.75, "body": 0.75, "outline": 0.3}
GROUP_REST, PROXIMITY, SIZE_PRIOR = 0.1, 0.3, 0.25
DAMPING, ITERATIONS, TOLERANCE = 0.85, 60, 1e-9
STOP_WORDS = frozenset("a an and are as at be by for from has in is it its of on or that the this to was were will with".split())


def terms(text: Column) -> Column:
    """Lower-cased words that don't begin with a digit, and the parts of compound ones; 2 to 64 characters."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)), lambda w: ~w.rlike("^[0-9]"))

    def parts(w):
        split = F.split(w, r"[_$]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
        own = F.filter(split, lambda p: (p != "") & ~p.rlike("^[0-9]"))
        return F.when(F.size(own) > 1, F.concat(F.array(w), own)).otherwise(F.array(w))

    every = F.transform(F.flatten(F.transform(words, parts)), F.lower)
    return F.filter(every, lambda t: (F.length(t) >= LEAST) & (F.length(t) <= MOST))


def frequencies(df: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """(key, term, tf, size): a name's terms count NAME_WEIGHT times."""
    every = terms(F.col(text))
    if name:
        every = F.concat(*[terms(F.col(name))] * NAME_WEIGHT, every)
    rows = df.select(key, every.alias("__t"))
    return rows.select(key, F.size("__t").alias("size"), F.explode("__t").alias("term")).groupBy(key, "size", "term").agg(F.count("*").alias("tf"))


_WORD = re.compile(r"[A-Za-z0-9_$]+")
_SEAM = re.compile(r"[_$]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def _parts(word: str) -> list[str]:
    """A word's terms, as ``terms`` has them."""
    if word[0].isdigit():
        return []
    own = [p for p in _SEAM.split(word) if p and not p[0].isdigit()] if not word.isalpha() or not (word.islower() or word[1:].islower()) else []
    return [t.lower() for t in ([word, *own] if len(own) > 1 else [word]) if LEAST <= len(t) <= MOST]


def _counted(wanted: list[str], weights: list[int]):
    """(.., size, hits): how many terms a row's texts have, and how often each wanted one, in one pass over its words."""

    def run(batches):
        parts = lru_cache(1 << 16)(_parts)
        for batch in batches:
            sizes, hits = [], []
            for texts in zip(*(batch.column(k) for k in range(len(weights)))):
                texts = [x.as_py() for x in texts]
                size, found = (0, dict.fromkeys(wanted, 0)) if None not in texts else (None, {})
                for text, weight in zip(texts, weights) if size is not None else ():
                    for word, n in Counter(_WORD.findall(text)).items():
                        own = parts(word)
                        size += weight * n * len(own)
                        for t in own:
                            if t in found:
                                found[t] += weight * n
                sizes.append(size)
                hits.append([{"term": t, "tf": n} for t, n in found.items() if n])
            kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
            yield pa.record_batch([batch.column(batch.num_columns - 1), pa.array(sizes, pa.int64()), pa.array(hits, kind)], names=["key", "size", "hits"])

    return run


def bm25(df: DataFrame, key: str, text: str, question: list[str], name: str | None = None) -> DataFrame:
    """(key, score) of the rows with some of the question's terms, each counted once; rows of equal keys and size are one.

    The texts are read once. Only sizes and the question's terms leave the scan; document counts and the mean length
    come with them as one row. A null text is a document without a size.
    """
    wanted = sorted({t.lower() for t in question})
    fields = [(text, 1)] + ([(name, NAME_WEIGHT)] if name else [])
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(*(F.col(c).cast("string").alias(f"t{k}") for k, (c, _) in enumerate(fields)), F.col(key).alias("key"))
    rows = checkpointed(texts.mapInArrow(_counted(wanted, [w for _, w in fields]), f"key {kind}, size long, hits array<struct<term:string,tf:long>>"))
    stats = rows.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("size"), F.lit(1.0)).alias("mean"))
    hits = rows.select("key", "size", F.inline("hits")).groupBy("key", "size", "term").agg(F.sum("tf").alias("tf"))
    df_counts = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most as many rows as the question has terms
    scored = hits.join(F.broadcast(df_counts), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return scored.groupBy(F.col("key").alias(key)).agg(F.sum(idf * weight).alias("score"))


def bm25_ceiling(df: DataFrame, key: str, text: str, question: list[str]) -> DataFrame:
    """(ceiling): no document's score is above it."""
    wanted = sorted({t.lower() for t in question})
    rows = df.select(key, F.array_distinct(terms(F.col(text))).alias("__t"))
    n = rows.agg(F.count("*").alias("n_docs"))
    counts = rows.select(F.explode(F.filter("__t", lambda t: t.isin(wanted))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counts.crossJoin(F.broadcast(n)).agg(F.sum(idf * (K1 + 1)).alias("ceiling"))


def fielded_bm25(fields: DataFrame, concepts: list[list[str]]) -> DataFrame:
    """(doc, score) from (doc, field, line, term): weighted fields, alternatives of one concept, proximity.

    Of a concept's terms the best counts whole and the others by GROUP_REST. Terms of different concepts near
    each other add log(a + exp(-gap)) - log(a); larger documents have a prior.
    """
    spark = fields.sparkSession
    wanted = spark.createDataFrame([(t.lower(), k) for k, group in enumerate(concepts) for t in group], "term string, concept int")
    known = F.create_map(*(F.lit(x) for f, w in FIELD_WEIGHTS.items() for x in (f, w)))
    slope = F.create_map(*(F.lit(x) for f, b in FIELD_B.items() for x in (f, b)))
    # the rows are read once: of other terms than the question's only their number in a field is kept
    asked = F.col("term").isin(sorted({t.lower() for group in concepts for t in group}))
    counted = checkpointed(fields.groupBy("doc", "field", F.when(asked, F.col("term")).alias("term"), F.when(asked, F.col("line")).alias("line")).agg(F.count("*").alias("n")))
    lengths = counted.groupBy("doc", "field").agg(F.sum("n").alias("length"))
    means = lengths.groupBy("field").agg(F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"))
    docs = counted.groupBy("doc").agg(F.sum("n").alias("size"))
    total = docs.agg(F.count("*").alias("n_docs"))
    hits = counted.join(F.broadcast(wanted), "term")
    tf = hits.groupBy("doc", "field", "term", "concept").agg(F.sum("n").alias("tf")).join(lengths, ["doc", "field"]).join(F.broadcast(means), "field")
    b = slope[F.col("field")]
    pseudo = tf.groupBy("doc", "term", "concept").agg(F.sum(known[F.col("field")] * F.col("tf") / (1 - b + b * F.col("length") / F.col("mean"))).alias("tf"))
    df_counts = pseudo.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = pseudo.join(F.broadcast(df_counts), "term").crossJoin(F.broadcast(total)).withColumn("s", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1))
    groups = scored.groupBy("doc", "concept").agg(((1 - GROUP_REST) * F.max("s") + GROUP_REST * F.sum("s")).alias("s"))
    words = groups.groupBy("doc").agg(F.sum("s").alias("words"))
    order = Window.partitionBy("doc").orderBy("line", "concept")
    near = hits.select("doc", "line", "concept").distinct()
    near = near.withColumn("gap", F.when(F.lag("concept").over(order) != F.col("concept"), F.col("line") - F.lag("line").over(order)))
    gaps = near.groupBy("doc").agg(F.min("gap").alias("gap"))
    bonus = F.coalesce(F.log(PROXIMITY + F.exp(-F.col("gap"))) - math.log(PROXIMITY), F.lit(0.0))
    return words.join(gaps, "doc").join(docs, "doc").select("doc", (F.col("words") + bonus + SIZE_PRIOR * F.log(1 + F.col("size"))).alias("score"))


def pagerank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, teleport: DataFrame | None = None, tolerance: float = TOLERANCE, every: int = 5) -> DataFrame:
    """(node, rank) of a weighted graph (src, dst, weight); the rank of nodes without edges out is teleported.

    ``teleport`` (node, weight) is normalised; negative weights are refused. Lineage is cut every few rounds.
    """
    if teleport is not None and not teleport.filter("weight < 0").isEmpty():
        raise ValueError("teleport weights aren't negative")
    weights = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    nodes = weights.select(F.col("src").alias("node")).union(weights.select("dst")).distinct()
    if teleport is None:
        start = nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select("node", (1 / F.col("n")).alias("base"))
    else:
        total = teleport.agg(F.sum("weight").alias("total"))
        start = nodes.join(teleport, "node", "left").crossJoin(F.broadcast(total)).select("node", (F.coalesce("weight", F.lit(0.0)) / F.col("total")).alias("base"))
    out = weights.groupBy("src").agg(F.sum("weight").alias("out"))
    share = checkpointed(weights.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    start = checkpointed(start)
    sinks = checkpointed(start.join(share.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node"))
    ranks = start.select("node", F.col("base").alias("rank"))
    for k in range(iterations):
        lost = ranks.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = ranks.join(share, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = start.join(sent, "node", "left").crossJoin(F.broadcast(lost))
        new = new.select("node", ((1 - damping) * F.col("base") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("base"))).alias("rank"))
        if (k + 1) % every == 0 and k + 1 < iterations:
            new = checkpointed(new)
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is not None and moved < tolerance:
                return new
        ranks = new
    return ranks


def mutual_information(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Of two events from their counts, in bits: a 2 x 2 table."""

    def cell(x, row, column):
        return F.when(x > 0, x / n * F.log2(x * n / (row * column))).otherwise(0.0)

    return cell(both, a, b) + cell(a - both, a, n - b) + cell(b - both, n - a, b) + cell(n - a - b + both, n - a, n - b)


def greedy_cover(candidates: list[tuple[str, float, set[str]]], gains: dict[str, float], budget: float) -> list[str]:
    """Names whose items' gains cover most under a budget: lazily by gain a cost, or the best single one.

    Sequential by nature; candidates come aggregated, in a number the caller bounds.
    """
    worth = lambda items, seen: sum(gains.get(x, 0.0) for x in items - seen)
    heap = [(-worth(items, set()) / cost, name, cost, items, 0) for name, cost, items in candidates if cost <= budget]
    heapq.heapify(heap)
    seen: set[str] = set()
    chosen, left, version = [], budget, 0
    while heap:
        value, name, cost, items, at = heapq.heappop(heap)
        if cost > left:
            continue
        if at < version:
            heapq.heappush(heap, (-worth(items, seen) / cost, name, cost, items, version))
            continue
        if value >= 0:
            break
        chosen.append(name)
        seen |= items
        left -= cost
        version += 1
    single = max(((worth(items, set()), name) for name, cost, items in candidates if cost <= budget), default=(0.0, ""))
    return chosen if sum(gains.get(x, 0.0) for x in seen) >= single[0] else [single[1]]


def cover_rounds(items: DataFrame, costs: DataFrame, gains: DataFrame, budget: float) -> list[str]:
    """The same names in the same order for candidates that are tables: items(name, item), costs(name, cost),
    gains(item, gain).

    A round sums up for each name what it would still add and picks the best for its cost (ties by name); what the
    picked one covers leaves the table. So there are as many rounds as names that are chosen, and only one row of
    each comes to the driver. Gains are counted in whole multiples of 2 ** -62 of the largest, so that sums don't depend
    on the order of rows and names that cover the same items are equal.
    """
    gains = gains.groupBy("item").agg(F.first("gain").cast("double").alias("gain"))
    most = gains.agg(F.max(F.abs("gain"))).first()[0]
    unit = math.ldexp(1.0, math.frexp(most or 1.0)[1] - 62)
    known = items.distinct().join(gains.select("item", F.rint(F.col("gain") / unit).cast("decimal(20,0)").alias("gain")), "item")
    known = checkpointed(known.join(costs.filter(F.col("cost") <= budget).select("name", F.col("cost").cast("double").alias("cost")), "name"))
    by_worth = lambda rows: rows.groupBy("name").agg(F.sum("gain").alias("worth"), F.first("cost").alias("cost"))
    single = by_worth(known).orderBy(F.desc("worth"), F.desc("name")).first()
    chosen, left, covered = [], budget, 0
    while (best := by_worth(known.filter(F.col("cost") <= left)).filter("worth > 0").orderBy(F.desc(F.col("worth").cast("double") / F.col("cost")), "name").first()) is not None:
        chosen.append(best["name"])
        left, covered = left - best["cost"], covered + int(best["worth"])
        taken = known.filter(F.col("name") == best["name"]).select("item")
        known = checkpointed(known.join(taken, "item", "left_anti"))
    if single is None or covered >= int(single["worth"]):
        return chosen
    return [single["name"]]


def stem(word: Column) -> Column:
    """A light suffix stem: plural and verb endings of words long enough."""
    w = F.lower(word)
    w = F.when(F.length(w) > 4, F.regexp_replace(w, "(ies)$", "y")).otherwise(w)
    w = F.when(F.length(w) > 5, F.regexp_replace(w, "(ing|edly|ed|ly)$", "")).otherwise(w)
    return F.when((F.length(w) > 3) & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", "")).otherwise(w)


def plural_stem(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(ss|us|is)$"), w).otherwise(F.regexp_replace(w, "s$", ""))


def top_per_group(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def concepts(question: str) -> list[str]:
    """A question's terms in order, without stop words."""
    found = [w.lower() for w in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", question)]
    return list(dict.fromkeys(w for w in found if w not in STOP_WORDS and LEAST <= len(w) <= MOST))


INTENTS = {"callers": ("who calls", "callers of", "used by"), "definition": ("where is", "defined"), "flow": ("how does", "flow"), "tests": ("tested", "tests for")}


def intent(question: str) -> str:
    """What a question asks for: the first intent whose words come in order at most four words apart."""
    words = question.lower().split()
    for name, phrases in INTENTS.items():
        for phrase in phrases:
            first, *rest = phrase.split()
            for k in (i for i, w in enumerate(words) if w.startswith(first)):
                at, whole = k, True
                for nxt in rest:
                    spot = next((i for i in range(at + 1, min(at + 6, len(words))) if words[i].startswith(nxt)), None)
                    whole, at = whole and spot is not None, spot if spot is not None else at
                if whole:
                    return name
    return "explain"


def partition_tree(sizes: list[tuple[str, int]], capacity: int) -> dict[str, str]:
    """Paths to regions: a directory that fits is one region, a larger one is cut by its subdirectories."""
    out: dict[str, str] = {}

    def cut(prefix: str, members: list[tuple[str, int]]) -> None:
        if sum(n for _, n in members) <= capacity or len(members) == 1:
            out.update({p: prefix or "." for p, _ in members})
            return
        groups: dict[str, list[tuple[str, int]]] = {}
        for p, n in members:
            rest = p[len(prefix) :].lstrip("/")
            head = rest.split("/")[0]
            groups.setdefault(f"{prefix}/{head}".lstrip("/") if "/" in rest else prefix, []).append((p, n))
        if set(groups) == {prefix}:
            out.update({p: prefix or "." for p, _ in members})
            return
        for name, own in groups.items():
            if name == prefix:
                out.update({p: prefix or "." for p, _ in own})
            else:
                cut(name, own)

    cut("", sorted(sizes))
    return out


def tree_regions(rows: DataFrame, path: str, size: Column, capacity: int) -> DataFrame:
    """``rows`` with ``region``, as ``partition_tree`` tells it: the highest directory that fits the capacity or has
    one path alone, else the path's own directory; ``.`` is the root.

    Sizes are summed up by directory, then for all directories above; a directory that doesn't fit is cut. What is
    cut lies under what is cut, so how many of a directory's ancestors are cut says which one is its region. At each
    depth the cut ones are no more than the total divided by the capacity.
    """
    steps = F.split(F.regexp_replace(F.col(path), "^/+", ""), "/")
    placed = rows.withColumns({"__size": size, "__dir": F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/")})
    own = placed.groupBy("__dir").agg(F.sum("__size").alias("s"), F.count("*").alias("n"))
    parts = F.filter(F.split("__dir", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    chain = checkpointed(own.select("__dir", "s", "n", F.explode(above).alias("up")))
    cut = chain.groupBy("up").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter((F.col("s") > capacity) & (F.col("n") > 1)).select("up")
    depth = chain.join(cut, "up", "left_semi").groupBy("__dir").agg(F.count("*").cast("int").alias("cuts"))
    region = F.array_join(F.slice(parts, F.lit(1), F.least(F.coalesce("cuts", F.lit(0)), F.size(parts))), "/")
    told = placed.join(depth, "__dir", "left").withColumn("region", F.when(region == "", ".").otherwise(region))
    return told.select(*rows.columns, "region")
