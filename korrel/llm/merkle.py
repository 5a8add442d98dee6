"""A Merkle manifest of a table: a tree of hashes for each group of rows, and one over the groups' roots.

Every inner node is kept with its preimage, the digests of its children one after the other. A leaf gets the
preimages of its ancestors by joins from the top down, each node handing its own and its ancestors' on to its
children. Cutting the 64 characters of its own slot out of a preimage leaves the siblings; putting another
digest there and hashing folds a changed leaf up to the root.

No key of a join or group has more than ``WIDTH`` rows below it, whatever a group's share of the table is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import keep
from korrel.operators.prefix import running

#: Children of a node, and characters of a digest.
WIDTH, DIGEST = 16, 64

STEP = "array<struct<slot:int,preimage:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text in UTF-8, their number and a colon before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def siblings(path: Column) -> Column:
    """The digests beside the way to the root, from the leaf's own run up, left to right."""
    cut = lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substr(s["preimage"], s["slot"] * DIGEST + DIGEST + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root if the leaf's digest were ``leaf``."""
    put = lambda h, s: F.sha2(F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * DIGEST), h, F.substr(s["preimage"], s["slot"] * DIGEST + DIGEST + 1)), 256)
    return F.aggregate(path, leaf, put)


def _parents(nodes: DataFrame) -> DataFrame:
    """(key, i, n, preimage, h) over (key, i, n, h): n nodes of a key are numbered by i; a node without others has none."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
    runs = nodes.filter("n > 1").groupBy("key", F.expr(f"i div {WIDTH}").alias("i"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"))
    made = runs.agg(F.array_join(digests, "").alias("preimage"))
    return made.withColumn("h", F.sha2("preimage", 256))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes``, each a written table, and (key, h): the node of each key that stands alone."""
    levels, tops = [], [nodes]
    while not (level := keep(_parents(tops[-1]), "merkle-level")).isEmpty():
        levels.append(level)
        tops.append(level)
    return levels, reduce(DataFrame.unionByName, [x.filter("n = 1").select("key", "h") for x in tops])


def _under(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """``nodes`` with the path from each to the root: its parent's slot and preimage, then its parent's own path."""
    alone = nodes.filter("n = 1").join(tops, "key")
    if above is None:
        return alone
    parent = above.select("key", F.col("i").alias("__parent"), F.col("preimage").alias("__preimage"), F.col("path").alias("__path"), "subroot", "root")
    step = F.array(F.struct((F.col("i") % WIDTH).cast("int").alias("slot"), F.col("__preimage").alias("preimage"))).cast(STEP)
    others = nodes.filter("n > 1").withColumn("__parent", F.expr(f"i div {WIDTH}")).join(parent, ["key", "__parent"])
    return alone.unionByName(others.withColumn("path", F.concat(step, "__path")).drop("__parent", "__preimage", "__path"))


def _descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    above = None
    for level in reversed(levels):
        above = _under(level.drop("h"), above, tops)
    return _under(nodes, above, tops)


@dataclass
class Manifest:
    """``leaves``: the rows with their place (key, i of n); ``levels``: the inner nodes of the groups' trees from the
    lowest up; ``groups``: (key, path, subroot, root), the way from each group's root to the whole's."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame

    def root(self) -> str | None:
        """None for an empty table."""
        first = self.groups.select("root").first()
        return first["root"] if first else None

    def paths(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``path``, their ancestors' preimages from the lowest up."""
        return _descend(self.leaves.withColumnRenamed("leaf", "h"), self.levels, self.groups).withColumnRenamed("h", "leaf").drop("key", "i", "n")


def manifest(rows: DataFrame, group: str, order: str) -> Manifest:
    """The tree over ``rows``, which have a digest ``leaf``: rows of one ``group`` ascend by ``order``, groups by name.

    Null groups are a group and come first, as do null orders; ties ascend by the digest. Repeated rows are leaves
    of their own. Names of columns that begin with two underscores, and key, i, n, path, subroot and root, are taken.
    """
    made = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")))
    others = [x for x in made.columns if x not in ("key", order, "leaf")]
    met = made.groupBy("key", order, "leaf", *others).agg(F.count("*").alias("__copies"))  # repeated rows could be many
    placed = running(met, ["key"], [order, "leaf", *others], F.col("__copies"), "i", "n", keep=lambda df: keep(df, "merkle-rows"))
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__copy")
    leaves = keep(placed.select("*", one).withColumn("i", F.col("i") + F.col("__copy")).drop("__copies", "__copy"), "merkle-leaves")
    levels, subroots = _climb(leaves.withColumnRenamed("leaf", "h"))
    named = keep(subroots.select(F.col("key").alias("name"), "h"), "merkle-groups")
    nodes = keep(running(named, [], ["name"], F.lit(1).cast("long"), "i", "n", keep=lambda df: keep(df, "merkle-groups")).withColumn("key", F.lit("")), "merkle-groups")
    upper, root = _climb(nodes)
    top = root.select("key", F.col("h").alias("root"), F.lit(None).cast("string").alias("subroot"), F.array().cast(STEP).alias("path"))
    groups = _descend(nodes, upper, top).select(F.col("name").alias("key"), F.col("h").alias("subroot"), "root", "path")
    return Manifest(leaves, levels, keep(groups, "merkle-groups"))


#: Capital letters, and what a text's tampering makes of them.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row in so many is tampered with.
EVERY = 5


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each of ``docs``.

    Nulls have a form of their own in a leaf, so a null text and an empty one differ. Rows without an id come first
    in their source and aren't tampered with. A text of any length is hashed whole where it is read; only digests
    are exchanged. Repeated rows are leaves of their own; an empty table gives no rows; other columns are ignored.
    """
    d = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(d["doc_id"].cast("string").cast("binary")) % EVERY == 0
    leaf, changed = leaf_hash(*d.values()), leaf_hash(*(d | {"text": F.translate("text", _CAPITALS, _SMALL)}).values())
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(hit, changed).alias("changed"))
    paths = manifest(rows, "source", "doc_id").paths()
    told = paths.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(docs: int, groups: int) -> str:
    """The trees level by level: d{l} are the documents on their way up, t{l} the nodes of a level, p{l} the preimages."""
    field_sql = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
    out = [
        f"a AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf, CASE WHEN {crc} % {EVERY} = 0 THEN {leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} END AS changed FROM documents)",
        "d0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, coalesce(changed, leaf) AS cur, '' AS sibs FROM a)",
        "t0 AS (SELECT key, i, n, leaf AS h FROM d0)",
    ]
    climb = lambda d, t, p, k: [
        f"{p}{k + 1} AS (SELECT key, i // {WIDTH} AS i, any_value(n) AS n, string_agg(h, '' ORDER BY i) AS p FROM {t}{k} GROUP BY key, i // {WIDTH})",
        f"{t}{k + 1} AS (SELECT key, i, (n + {WIDTH - 1}) // {WIDTH} AS n, CASE WHEN n = 1 THEN p ELSE sha256(p) END AS h FROM {p}{k + 1})",
        f"{d}{k + 1} AS (SELECT d.* REPLACE (d.i // {WIDTH} AS i, (d.n + {WIDTH - 1}) // {WIDTH} AS n, CASE WHEN d.n = 1 THEN cur ELSE sha256(p[:{DIGEST} * (d.i % {WIDTH})] || cur || p[{DIGEST} * (d.i % {WIDTH}) + {DIGEST + 1}:]) END AS cur, CASE WHEN d.n = 1 THEN sibs ELSE sibs || p[:{DIGEST} * (d.i % {WIDTH})] || p[{DIGEST} * (d.i % {WIDTH}) + {DIGEST + 1}:] END AS sibs) FROM {d}{k} d JOIN {p}{k + 1} p ON p.key = d.key AND p.i = d.i // {WIDTH})",
    ]
    for k in range(docs):
        out += climb("d", "t", "p", k)
    out += [
        f"v0 AS (SELECT '' AS key, key AS name, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM t{docs})",
        f"e0 AS (SELECT d.* REPLACE ('' AS key, v.i AS i, v.n AS n), v.h AS subroot FROM d{docs} d JOIN v0 v ON v.name = d.key)",
    ]
    for k in range(groups):
        out += climb("e", "v", "q", k)
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM e{groups}, v{groups}"


#: Up to 16 ** 6 documents of a source, and 16 ** 3 sources.
MERKLE_SQL = _levels_sql(6, 3)
