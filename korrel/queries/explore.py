"""Maps, evidence, and the log writer."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import explore as X
from korrel.operators.logs import append_lines
from korrel.operators.text import token_estimate
from korrel.queries.registry import query
from korrel.session import load, shared_folder


@query("map_region_scores", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS score, n FROM (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place, CAST(count(*) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS n FROM customer) WHERE place <= 3 GROUP BY c_mktsegment, n")
def region_scores(spark, sf_dir):
    found = X.region_scores(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "c_custkey")
    return found.select("c_mktsegment", F.round("score", 2).alias("score"), "n")


@query("map_concepts", "WITH t AS (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS term FROM part), f AS (SELECT p_brand, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), w AS (SELECT p_brand, term, round(tf * ln(1 + (SELECT count(DISTINCT p_brand) FROM part) / df), 9) AS weight FROM f JOIN d USING (term)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, term) AS INT) AS place FROM w) WHERE place <= 5")
def concept_terms(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return X.concept_terms(rows, "p_brand", "term").select("p_brand", "term", F.round("weight", 9).alias("weight"), "place")


@query("map_budget", "SELECT p_partkey, CAST(place AS INT) AS place, CAST(spent AS BIGINT) AS spent FROM (SELECT p_partkey, row_number() OVER w AS place, sum(p_size) OVER w AS spent FROM part WINDOW w AS (ORDER BY p_retailprice DESC, p_partkey)) WHERE spent <= 400 OR place = 1")
def budget(spark, sf_dir):
    return X.under_budget(load(spark, sf_dir, "part"), [F.desc("p_retailprice"), "p_partkey"], F.col("p_size"), 400).select("p_partkey", "place", "spent")


@query("map_build")
def corpus_map(spark, sf_dir):
    """Sources of documents as regions."""
    docs = load(spark, sf_dir, "documents")
    return X.corpus_map(docs, "doc_id", "text", "source", "where is the idiot and the clown", token_estimate(F.col("text")))


@query("map_explore")
def explore(spark, sf_dir):
    return X.explore(load(spark, sf_dir, "documents"), "doc_id", "text", "how does the clown flow")


@query("map_evidence", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (1, 2, 3, 4)), x AS (SELECT o_orderkey - 1 AS part, 'f' || o_custkey AS path, o_orderpriority AS text FROM o) SELECT CAST(part AS INT) AS part, path, text, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(length(text)) OVER (ORDER BY part, path, text) AS spent, row_number() OVER (ORDER BY part, path, text) AS place FROM x) WHERE spent <= 25 OR place = 1")
def evidence(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), "o_custkey").alias("path"), F.col("o_orderpriority").alias("text"))
    return X.evidence(*(rows.filter(F.col("o_orderkey") == k) for k in (1, 2, 3, 4)), budget=25).drop("place")


@query("log_write_read", "SELECT event_id, event_type, value FROM events")
def write_read(spark, sf_dir):
    """Events appended as NDJSON in two writes and read back."""
    import uuid

    folder = f"{shared_folder(spark)}/korrel-log-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for part in (0, 1):
        append_lines(rows.filter(F.col("event_id") % 2 == part), folder)
    return spark.read.schema(rows.schema).json(folder)
