"""Linking against a depth-first search in Python: chains, cycles, ties, stars, and several changes."""

from __future__ import annotations

import random

import pytest

from korrel.operators import linking as L

SCHEMAS = {
    "files": "file_id int, status string",
    "decls": "file_id int, name string, scope_start int, scope_end int, slot int, spec int, imported string",
    "specs": "file_id int, spec int, outcome string, target_file int",
    "exports": "file_id int, idx int, name string, kind string, slot int, spec int, imported string",
    "refs": "file_id int, idx int, name string, start int, receiver string",
    "members": "file_id int, slot int, name string, parent int",
}


def frames(spark, rows):
    return L.Relations(**{k: spark.createDataFrame(rows[k], s).coalesce(2) for k, s in SCHEMAS.items()})


def by_hand(rows):
    """{(file, idx): (target_file, target_slot, reason)}"""
    status = dict(rows["files"])
    spec = {(f, s): (o, t) for f, s, o, t in rows["specs"]}
    explicit, stars = {}, {}
    for f, idx, name, kind, slot, s, imported in sorted(rows["exports"], key=lambda r: r[:2]):
        if kind == "star":
            stars.setdefault(f, []).append(s)
        else:
            explicit.setdefault((f, name), (kind, slot, s, imported))

    def target(f, s):
        outcome, t = spec.get((f, s), ("not_found", None))
        return (t, None) if outcome == "file" else (None, L.MISSES[outcome])

    def export(f, name, path):
        if f in path or len(path) >= L.CHAIN:
            return None, "reexport_cycle"
        if status.get(f) != "parsed":
            return None, "unindexed_module"
        path = [*path, f]
        if (f, name) in explicit:
            kind, slot, s, imported = explicit[f, name]
            if kind == "local":
                return (f, slot), None
            t, miss = target(f, s)
            if miss:
                return None, miss
            return ((t, L.MODULE_SLOT), None) if imported == "*" else export(t, imported, path)
        failed = None
        for s in stars.get(f, []) if name != "default" else []:
            t, miss = target(f, s)
            if t is None:
                failed = failed or (miss if miss != "global" else None)
                continue
            got, miss = export(t, name, path)
            if got:
                return got, None
            failed = failed or (miss if miss != "export_not_found" else None)
        return None, failed or "export_not_found"

    members = {}
    for f, slot, name, parent in sorted(rows["members"]):
        members.setdefault((f, parent, name), slot)
    out = {}
    for f, idx, name, start, receiver in rows["refs"]:
        over = [d for d in rows["decls"] if d[0] == f and d[1] == (receiver or name) and d[2] <= start < d[3]]
        if not over:
            out[f, idx] = (None, None, "global")
            continue
        _, _, _, _, slot, s, imported = min(over, key=lambda d: (-d[2], d[3], d[4] is None, d[4] or 0, d[5] or 0, d[6] or ""))
        if slot is not None:
            got, miss = (f, slot), None
        else:
            t, miss = target(f, s)
            got = None
            if t is not None:
                if imported == "*":
                    got, miss = (export(t, name, []) if receiver else ((t, L.MODULE_SLOT), None))
                    out[f, idx] = (*got, None) if got else (None, None, miss)
                    continue
                got, miss = export(t, imported, [])
        if got and receiver:
            if got[1] == L.MODULE_SLOT:
                got, miss = export(got[0], name, [])
            else:
                inner = members.get((*got, name))
                got, miss = ((got[0], inner), None) if inner is not None else (None, "member_not_found")
        out[f, idx] = (*got, None) if got else (None, None, miss)
    return out


def found(linked):
    rows = linked.links.collect()
    told = {(r["file_id"], r["idx"]): (r["target_file"], r["target_slot"], r["reason"]) for r in rows}
    assert len(told) == len(rows)
    return told


def scattered(rng, n=24):
    names = ["a", "b", "c", "default"]
    rows = {k: [] for k in SCHEMAS}
    for f in range(n):
        rows["files"].append((f, "parsed" if rng.random() < 0.9 else "skipped"))
        for s in range(6):
            outcome = rng.choice(["file"] * 9 + ["external", "not_found", "unindexed", "namespace"])
            rows["specs"].append((f, s, outcome, rng.randrange(n) if outcome == "file" else None))
        for idx in range(rng.randint(0, 5)):
            kind = rng.choice(["local", "binding", "binding", "binding", "star"])
            rows["exports"].append((f, idx, None if kind == "star" else rng.choice(names), kind, idx if kind == "local" else None, rng.randrange(6) if kind != "local" else None, rng.choice([*names, "*"]) if kind == "binding" else None))
        for k in range(5):
            low = rng.randrange(3) * 10
            own = rng.random() < 0.4
            rows["decls"].append((f, rng.choice("xyz"), low, 60 - low, k if own else None, None if own else rng.randrange(6), None if own else rng.choice([*names, "*"])))
            rows["members"].append((f, 100 + k, rng.choice(names), rng.randrange(5)))
        for idx in range(12):
            bare = rng.random() < 0.5
            rows["refs"].append((f, idx, rng.choice("xyzw") if bare else rng.choice(names), rng.randrange(60), None if bare else rng.choice("xyzw")))
    return rows


def test_links_and_three_changes(spark):
    wanted = {"reexport_cycle", "export_not_found", "unindexed_module", "external_module", "module_not_found", "member_not_found", "global"}
    rng = random.Random(4)
    rows = next(r for r in (scattered(rng) for _ in range(200)) if {x for *_, x in by_hand(r).values()} >= wanted)
    before = frames(spark, rows)
    linked = L.link(before)
    assert found(linked) == by_hand(rows)
    for k in range(3):
        other, hit = scattered(random.Random(50 + k)), set(rng.sample(range(24), 2))
        names = ["refs"] if k == 1 else list(SCHEMAS)  # once nothing but uses
        fresh = {t: [r for r in v if r[0] not in hit] + [r for r in other[t] if r[0] in hit] if t in names else v for t, v in rows.items()}
        after = frames(spark, fresh)
        made = L.relink(linked, before, after, spark.createDataFrame([(f,) for f in hit], "file_id int"))
        touched = {r["file_id"] for r in made.touched.collect()}
        assert found(made) == by_hand(fresh)
        assert hit <= touched and (touched == hit if k == 1 else len(touched) < 24)
        rows, before, linked = fresh, after, made


def test_long_chains_and_loops(spark):
    """66 files that hand a name on; the last defines it. One more than the most is a cycle."""
    n = 66
    rows = {k: [] for k in SCHEMAS}
    for f in range(n):
        rows["files"].append((f, "parsed"))
        rows["specs"].append((f, 0, "file", f + 1))
        rows["exports"].append((f, 0, "a", "local" if f == n - 1 else "binding", 7 if f == n - 1 else None, 0, "a"))
        rows["exports"].append((f, 1, "a", "local", 9, None, None))  # a second export of the name doesn't count
        rows["exports"].append((f, 2, "self", "binding", None, 1, "self"))
        rows["specs"].append((f, 1, "file", f))
        rows["decls"] += [(f, "x", 0, 9, None, 0, "a"), (f, "y", 0, 9, None, 1, "self")]
        rows["refs"] += [(f, 0, "x", 3, None), (f, 1, "y", 3, None), (f, 2, "x", 9, None)]
    told = found(L.link(frames(spark, rows)))
    assert told == by_hand(rows)
    assert told[1, 0] == (n - 1, 7, None) or told[1, 0][2] == "reexport_cycle"
    assert told[0, 0][2] == "reexport_cycle" and told[3, 0] == (n - 1, 7, None) and told[3, 1][2] == "reexport_cycle" and told[3, 2][2] == "global"


def test_what_lies_behind_a_cycle_is_not_looked_into(spark):
    """File 1 hands on all of 2, whose a is 3's b, which is 1's c; that 1 has c from 4 is of no use here."""
    rows = {k: [] for k in SCHEMAS} | {"files": [(f, "parsed") for f in range(5)]}
    rows["specs"] = [(0, 0, "file", 1), (1, 0, "file", 2), (1, 1, "file", 4), (2, 0, "file", 3), (3, 0, "file", 1)]
    rows["exports"] = [(1, 0, None, "star", None, 0, None), (1, 1, "c", "binding", None, 1, "d"), (2, 0, "a", "binding", None, 0, "b"), (3, 0, "b", "binding", None, 0, "c"), (4, 0, "d", "local", 7, None, None)]
    rows["decls"] = [(0, "x", 0, 9, None, 0, "a")]
    rows["refs"] = [(0, 0, "x", 3, None)]
    linked = L.link(frames(spark, rows))
    assert found(linked) == by_hand(rows) == {(0, 0): (None, None, "reexport_cycle")}
    assert {(r["file_id"], r["on_file"]) for r in linked.deps.collect()} == {(0, 1), (0, 2), (0, 3)}


def test_each_reference_is_read_once(spark):
    """However many searches follow, and with the deps not made before they are asked for."""
    rows = scattered(random.Random(4))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    r = frames(spark, rows)
    r.refs = r.refs.mapInArrow(count, SCHEMAS["refs"])
    linked = L.link(r)
    assert found(linked) == by_hand(rows)
    assert linked.deps.count() > 0
    assert read.value == len(rows["refs"])


def test_many_declarations_of_one_name(spark, monkeypatch):
    """Names with more declarations than a list holds meet their references as rows; the links are the same."""
    rows = scattered(random.Random(9))
    for k in range(12):
        rows["decls"].append((3, "x", k, 60 - k // 2, None if k % 2 else 200 + k, k % 6 if k % 2 else None, "a" if k % 2 else None))
    rows["refs"] += [(3, 100 + k, "x", 5 * k, None) for k in range(12)]
    monkeypatch.setattr(L, "LIST", 2)
    assert found(L.link(frames(spark, rows))) == by_hand(rows)


def test_a_declaration_of_nothing_leaves_its_references_global(spark):
    """As in the query's SQL; each reference has a link."""
    rows = {k: [] for k in SCHEMAS} | {"files": [(0, "parsed")], "decls": [(0, "x", 0, 9, None, None, None)], "refs": [(0, 0, "x", 3, None), (0, 1, "m", 3, "x")]}
    assert found(L.link(frames(spark, rows))) == {(0, 0): (None, None, "global"), (0, 1): (None, None, "global")}


@pytest.mark.parametrize("empty", [("refs",), tuple(SCHEMAS)])
def test_empty_relations(spark, empty):
    rows = scattered(random.Random(1), 3) | {k: [] for k in empty}
    assert L.link(frames(spark, rows)).links.count() == 0
