"""Maps of a corpus: region scores, each region's own terms, and evidence under a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.operators.prefix import running
from korrel.operators.ranking import STOP_WORDS, bm25, concepts, top_per_group
from korrel.session import checkpointed

TOP_DEPTH, EVIDENCE_CHARS, MAP_TOKENS = 3, 9_500, 16_000


def region_scores(hits: DataFrame, region: str, score: str, tie: str, depth: int = TOP_DEPTH) -> DataFrame:
    """(region, score, n): the sum of each region's best hits, and how many it has in all."""
    best = top_per_group(hits.select(region, F.col(score).alias("__s"), F.col(tie).alias("__t")), region, "__s", "__t", depth)
    totals = hits.groupBy(region).agg(F.count("*").alias("n"))
    return best.groupBy(region).agg(F.sum("__s").alias("score")).join(totals, region)


def concept_terms(rows: DataFrame, region: str, term: str, n: int = 5) -> DataFrame:
    """(region, term, weight, place): terms that tell a region from the others, by tf-idf over regions."""
    tf = rows.filter(~F.col(term).isin(*STOP_WORDS)).groupBy(region, term).agg(F.count("*").alias("tf"))
    regions = rows.agg(F.count_distinct(region).alias("regions"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    weighted = tf.join(df, term).crossJoin(F.broadcast(regions)).withColumn("weight", F.col("tf") * F.log(1 + F.col("regions") / F.col("df")))
    return top_per_group(weighted.select(region, term, "weight"), region, "weight", term, n)


def under_budget(rows: DataFrame, order: list, size, budget: int) -> DataFrame:
    """The first rows whose sizes fit the budget together, one at least; ``order`` tells rows apart."""
    counted = running(rows, [], order, F.lit(1).cast("long"), "place", "__all").withColumn("place", (F.col("place") + 1).cast("int")).drop("__all")
    placed = running(counted, [], ["place"], size, "spent", "__all").withColumn("spent", F.col("spent") + size).drop("__all")
    return placed.filter((F.col("spent") <= budget) | (F.col("place") == 1))


def evidence(target: DataFrame, callers: DataFrame, callees: DataFrame, tests: DataFrame, budget: int = EVIDENCE_CHARS) -> DataFrame:
    """(part, path, text, spent): a definition's body first, then who calls it, what it calls, its tests."""
    parts = [x.select(F.lit(k).alias("part"), "path", "text") for k, x in enumerate((target, callers, callees, tests))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return under_budget(every, ["part", "path", "text"], F.char_length("text"), budget)


def explore(docs: DataFrame, key: str, text: str, question: str, n: int = 10) -> DataFrame:
    """(key, score): the documents that answer a question best."""
    return bm25(docs, key, text, concepts(question)).orderBy(F.desc("score"), key).limit(n)


def corpus_map(docs: DataFrame, key: str, text: str, region: str, question: str, tokens, budget: int = MAP_TOKENS) -> DataFrame:
    """(region, score, n, spent): regions by their best documents, as many as fit the budget of tokens."""
    # the texts are read for the scores, and once more for the tokens of what has some
    hits = checkpointed(bm25(docs, key, text, concepts(question)).join(docs.select(key, region, tokens.alias("__tokens")), key))
    scored = region_scores(hits, region, "score", key).join(hits.groupBy(region).agg(F.sum("__tokens").alias("tokens")), region)
    return under_budget(scored, [F.desc("score"), region], F.col("tokens"), budget).select(region, "score", "n", "spent")
