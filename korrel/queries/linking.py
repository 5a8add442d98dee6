"""Names to link, made of the order tables: customers are files in clusters of eight that import from each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.operators import linking as L
from korrel.queries.registry import query
from korrel.session import register

#: Files change: some exports get other names, some files can't be read any more, others change in their uses alone.
_CHANGED, _USES = "{f} % 40 = 7", "{f} % 40 = 8"


def _relations(after: bool) -> dict[str, str]:
    """SQL of each relation, which Spark and the oracle share. Orders are declarations, exports and imports."""
    in_change = (lambda f: f"({_CHANGED.format(f=f)})") if after else (lambda f: "FALSE")
    in_use = (lambda f: f"({_USES.format(f=f)} OR {_CHANGED.format(f=f)})") if after else (lambda f: "FALSE")
    key = "CAST(o_orderkey AS BIGINT)"
    return {
        "files": f"SELECT CAST(c_custkey AS BIGINT) AS file_id, CASE WHEN c_custkey % 50 = 0 OR (c_custkey % 3 = 0 AND {in_change('c_custkey')}) THEN 'skipped' ELSE 'parsed' END AS status FROM customer",
        "specs": f"SELECT CAST(o_custkey AS BIGINT) AS file_id, {key} AS spec, CASE o_orderkey % 29 WHEN 0 THEN 'external' WHEN 1 THEN 'not_found' WHEN 2 THEN 'unindexed' WHEN 3 THEN 'namespace' ELSE 'file' END AS outcome, CASE WHEN o_orderkey % 29 > 3 THEN CAST(o_custkey - o_custkey % 8 + o_orderkey % 8 AS BIGINT) END AS target_file FROM orders",
        "exports": f"SELECT CAST(o_custkey AS BIGINT) AS file_id, {key} AS idx, CASE WHEN o_orderkey % 31 > 2 THEN 'n' || CAST((o_orderkey + CASE WHEN {in_change('o_custkey')} THEN 1 ELSE 0 END) % 5 AS VARCHAR(9)) END AS name, CASE WHEN o_orderkey % 31 <= 2 THEN 'star' WHEN o_orderkey % 7 < 2 THEN 'local' ELSE 'binding' END AS kind, CASE WHEN o_orderkey % 7 < 2 THEN {key} END AS slot, {key} AS spec, CASE WHEN o_orderkey % 53 = 0 THEN '*' ELSE 'n' || CAST(o_orderkey % 6 AS VARCHAR(9)) END AS imported FROM orders",
        "decls": f"SELECT CAST(o_custkey AS BIGINT) AS file_id, 'd' || CAST(o_orderkey % 4 AS VARCHAR(9)) AS name, CAST(o_orderkey % 3 * 100 AS BIGINT) AS scope_start, CAST(1000 - o_orderkey % 3 * 100 AS BIGINT) AS scope_end, CASE WHEN o_orderkey % 4 = 0 THEN {key} END AS slot, CASE WHEN o_orderkey % 4 > 0 THEN {key} END AS spec, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN '*' ELSE 'n' || CAST(o_orderkey % 5 AS VARCHAR(9)) END END AS imported FROM orders",
        "refs": f"SELECT CAST(o_custkey AS BIGINT) AS file_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS idx, CASE WHEN l_linenumber % 3 = 0 THEN 'n' ELSE 'd' END || CAST((part + CASE WHEN {in_use('o_custkey')} THEN 1 ELSE 0 END) % 5 AS VARCHAR(9)) AS name, CAST(part % 1000 AS BIGINT) AS start, CASE WHEN l_linenumber % 3 = 0 THEN 'd' || CAST(part % 4 AS VARCHAR(9)) END AS receiver FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber) l JOIN orders ON l_orderkey = o_orderkey",
        "members": f"SELECT CAST(o_custkey AS BIGINT) AS file_id, {key} + 1000000000 AS slot, 'n' || CAST(o_orderkey // 7 % 5 AS VARCHAR(9)) AS name, {key} AS parent FROM orders",
    }


_MISS = "CASE {o} WHEN 'external' THEN 'external_module' WHEN 'unindexed' THEN 'unindexed_module' WHEN 'namespace' THEN 'global' ELSE 'module_not_found' END"


def _search(x: str, asks: str, to: str) -> str:
    """A depth-first search from each of ``asks``, as recursive SQL: {to}(ask_file, ask_name, ok, at, slot, reason) and,
    in {to}w, what was looked into."""
    return f"""{to}r(ask_file, ask_name, place, file, wanted, path, state, slot) AS (SELECT ask_file, ask_name, []::BIGINT[], ask_file, ask_name, []::BIGINT[], 'go', NULL::BIGINT FROM {asks} UNION ALL
SELECT ask_file, ask_name, CASE WHEN star IS NULL THEN place ELSE list_append(place, star) END,
  CASE WHEN cyc OR unread OR kind = 'local' THEN file WHEN kind = 'binding' THEN target_file WHEN star IS NULL THEN file ELSE star_to END,
  CASE WHEN NOT (cyc OR unread) AND kind = 'binding' THEN imported ELSE wanted END,
  CASE WHEN cyc THEN path ELSE list_append(path, file) END,
  CASE WHEN cyc THEN 'reexport_cycle' WHEN unread THEN 'unindexed_module' WHEN kind = 'local' THEN 'def' WHEN kind = 'binding' AND outcome <> 'file' THEN {_MISS.format(o='outcome')} WHEN kind = 'binding' AND imported = '*' THEN 'module' WHEN kind = 'binding' THEN 'go'
    WHEN star IS NULL OR star_outcome = 'namespace' THEN 'export_not_found' WHEN star_outcome = 'file' THEN 'go' ELSE {_MISS.format(o='star_outcome')} END, ex_slot
FROM (SELECT r.*, e.kind, e.slot AS ex_slot, e.outcome, e.target_file, e.imported, s.idx AS star, s.outcome AS star_outcome, s.target_file AS star_to, list_contains(r.path, r.file) OR len(r.path) >= 64 AS cyc, f.file_id IS NULL AS unread
  FROM (SELECT ask_file, ask_name, place, file, wanted, path FROM {to}r WHERE state = 'go') r LEFT JOIN {x}f f ON f.file_id = r.file LEFT JOIN {x}e e ON e.file_id = r.file AND e.name = r.wanted LEFT JOIN {x}s s ON s.file_id = r.file AND e.name IS NULL AND r.wanted <> 'default')),
{to} AS (SELECT ask_file, ask_name, b.state IN ('def', 'module') AS ok, b.file AS at, CASE WHEN b.state = 'module' THEN -1 ELSE b.slot END AS slot, b.state AS reason FROM (SELECT ask_file, ask_name, arg_min({{'state': state, 'file': file, 'slot': slot}}, {{'r': CASE WHEN state IN ('def', 'module') THEN 0 WHEN state <> 'export_not_found' THEN 1 ELSE 2 END, 'p': place}}) AS b FROM {to}r WHERE state <> 'go' GROUP BY 1, 2)),
{to}w AS (SELECT DISTINCT ask_file, ask_name, unnest(CASE WHEN state = 'module' THEN list_append(path, file) ELSE path END) AS on_file FROM {to}r WHERE state <> 'go')"""


def _linked(x: str, after: bool) -> str:
    """CTEs whose names begin with ``x``: {x}links(file_id, idx, target_file, target_slot, reason), {x}deps(file_id, on_file)."""
    tables = ",\n".join(f"{x}{k} AS ({sql})" for k, sql in _relations(after).items())
    return f"""{tables},
{x}f AS (SELECT file_id FROM {x}files WHERE status = 'parsed'),
{x}x AS (SELECT e.*, p.outcome, p.target_file FROM {x}exports e JOIN {x}specs p USING (file_id, spec)),
{x}e AS (SELECT * FROM {x}x WHERE kind <> 'star' QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY idx) = 1),
{x}s AS (SELECT * FROM {x}x WHERE kind = 'star'),
{x}n AS (SELECT r.file_id, r.idx, r.name, r.receiver, d.slot AS d_slot, d.spec AS d_spec, d.imported FROM {x}refs r LEFT JOIN {x}decls d ON d.file_id = r.file_id AND d.name = coalesce(r.receiver, r.name) AND d.scope_start <= r.start AND r.start < d.scope_end QUALIFY row_number() OVER (PARTITION BY r.file_id, r.idx ORDER BY d.scope_start DESC, d.scope_end, d.slot NULLS LAST, d.spec, d.imported) = 1),
{x}a AS (SELECT n.*, p.outcome, p.target_file AS ask_file, CASE WHEN imported <> '*' THEN imported WHEN receiver IS NOT NULL THEN name END AS ask_name FROM {x}n n LEFT JOIN {x}specs p ON p.file_id = n.file_id AND p.spec = n.d_spec),
{x}q AS (SELECT DISTINCT ask_file, ask_name FROM {x}a WHERE outcome = 'file' AND ask_name IS NOT NULL),
{_search(x, x + 'q', x + 'g')},
{x}m AS (SELECT a.file_id, a.idx, a.name, a.receiver, CASE WHEN a.d_slot IS NOT NULL THEN a.file_id WHEN a.outcome = 'file' AND a.ask_name IS NULL THEN a.ask_file WHEN g.ok THEN g.at END AS target_file,
  CASE WHEN a.d_slot IS NOT NULL THEN a.d_slot WHEN a.outcome = 'file' AND a.ask_name IS NULL THEN -1 WHEN g.ok THEN g.slot END AS target_slot,
  CASE WHEN a.d_slot IS NULL AND a.d_spec IS NULL THEN 'global' WHEN a.d_slot IS NOT NULL THEN NULL WHEN a.outcome <> 'file' THEN {_MISS.format(o='a.outcome')} WHEN NOT g.ok THEN g.reason END AS reason,
  a.receiver IS NOT NULL AND (a.d_slot IS NOT NULL OR (a.imported <> '*' AND g.ok)) AS inside FROM {x}a a LEFT JOIN {x}g g ON a.outcome = 'file' AND g.ask_file = a.ask_file AND g.ask_name = a.ask_name),
{x}p AS (SELECT DISTINCT target_file AS ask_file, name AS ask_name FROM {x}m WHERE inside AND target_slot = -1),
{_search(x, x + 'p', x + 'h')},
{x}o AS (SELECT file_id AS of, parent, name, min(slot) AS member FROM {x}members GROUP BY 1, 2, 3),
{x}links AS (SELECT m.file_id, m.idx, CASE WHEN NOT coalesce(inside, FALSE) THEN m.target_file WHEN m.target_slot = -1 THEN CASE WHEN h.ok THEN h.at END WHEN o.member IS NOT NULL THEN m.target_file END AS target_file,
  CASE WHEN NOT coalesce(inside, FALSE) THEN m.target_slot WHEN m.target_slot = -1 THEN CASE WHEN h.ok THEN h.slot END ELSE o.member END AS target_slot,
  CASE WHEN NOT coalesce(inside, FALSE) THEN m.reason WHEN m.target_slot = -1 THEN CASE WHEN NOT h.ok THEN h.reason END WHEN o.member IS NULL THEN 'member_not_found' END AS reason
  FROM {x}m m LEFT JOIN {x}h h ON inside AND m.target_slot = -1 AND h.ask_file = m.target_file AND h.ask_name = m.name LEFT JOIN {x}o o ON inside AND o.of = m.target_file AND o.parent = m.target_slot AND o.name = m.name),
{x}deps AS (SELECT DISTINCT file_id, on_file FROM (SELECT a.file_id, a.ask_file AS on_file FROM {x}a a WHERE outcome = 'file' UNION ALL SELECT a.file_id, w.on_file FROM {x}a a JOIN {x}gw w USING (ask_file, ask_name) WHERE outcome = 'file' UNION ALL SELECT m.file_id, w.on_file FROM {x}m m JOIN {x}hw w ON inside AND target_slot = -1 AND w.ask_file = m.target_file AND w.ask_name = m.name) WHERE file_id <> on_file)"""


def relations(spark, sf_dir: str, after: bool = False) -> L.Relations:
    register(spark, sf_dir, "customer", "orders", "lineitem")
    return L.Relations(**{k: spark.sql(sql.replace("//", "div")) for k, sql in _relations(after).items()})


@query("facts_link", f"WITH RECURSIVE {_linked('b', False)}\nSELECT file_id, idx, target_file, target_slot, reason FROM blinks")
def link(spark, sf_dir):
    return L.link(relations(spark, sf_dir)).links


@query("facts_relink", f"""WITH RECURSIVE {_linked('b', False)},
{_linked('z', True)},
reshaped AS (SELECT b.file_id FROM bfiles b JOIN zfiles z USING (file_id) WHERE {_CHANGED.format(f='file_id')} AND (b.status <> z.status OR EXISTS (SELECT 1 FROM bexports e WHERE e.file_id = b.file_id AND e.kind <> 'star'))),
touched AS (SELECT file_id FROM bfiles WHERE {_CHANGED.format(f='file_id')} OR {_USES.format(f='file_id')} UNION SELECT file_id FROM bdeps WHERE on_file IN (SELECT file_id FROM reshaped))
SELECT file_id, idx, target_file, target_slot, reason, file_id IN (SELECT file_id FROM touched) AS again FROM zlinks""")
def relink(spark, sf_dir):
    """Links after a change; ``again``: whether the file was linked again."""
    before, after = relations(spark, sf_dir), relations(spark, sf_dir, after=True)
    changed = before.files.filter(f"{_CHANGED.format(f='file_id')} or {_USES.format(f='file_id')}").select("file_id")
    made = L.relink(L.link(before), before, after, changed)
    return made.links.join(made.touched.withColumn("again", F.lit(True)), "file_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
