"""Preference formatting: one prompt from the turns that two conversations share, and two masked completions.

DataFrame functions only: turns are arrays of (role, text), the longest common prefix is the first place where
the arrays differ, and completions carry the spans that are trained on (what assistants say, with its end mark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
CLOSE = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    """The turns' text: <|role|>, a new line, the text, <|end|>, a new line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column) -> Column:
    """Character spans (start, end) of ``render``'s text that are trained on."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))

    def step(done, turn):
        begin = done["at"] + F.length(_head(turn))
        end = begin + F.length(_body(turn))
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        found = F.when(turn["role"] == TRAINED, F.concat(done["found"], span)).otherwise(done["found"])
        return F.struct(end.cast("long").alias("at"), found.alias("found"))

    return F.aggregate(turns, start, step, lambda done: done["found"])


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation's turns by turn, role and text; null roles and texts are empty.

    Marks in texts are broken up ('<|' becomes '< |'), so no text can end its turn.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = F.sort_array(F.collect_list(turn))
    plain = F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(plain.alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_shared, prompt, chosen, chosen_spans, rejected, rejected_spans) from (pair_id, chosen, rejected).

    Both sides are arrays of (role, text). The prompt is the longest run of first turns that are equal in both;
    each completion is the rest, with its trained spans. A side that is null or empty shares nothing and has an
    empty completion; equal sides are all prompt. Repeated pairs come back repeated.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", *(F.coalesce(F.col(c), empty).alias(c) for c in ("chosen", "rejected")))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda k: ~F.element_at("chosen", k).eqNullSafe(F.element_at("rejected", k)))
    rows = rows.withColumn("n_shared", F.coalesce(F.array_min(differ) - 1, shorter).cast("long"))

    def rest(side):
        return F.slice(F.col(side), F.col("n_shared").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))

    return rows.select(
        "pair_id", "n_shared", render(F.slice("chosen", F.lit(1), F.col("n_shared").cast("int"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"), spans(rest("chosen")).alias("chosen_spans"),
        render(rest("rejected")).alias("rejected"), spans(rest("rejected")).alias("rejected_spans"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation, and itself up to its last answer, which is another's.

    The other conversation is the one with the neighbouring id (2k and 2k + 1); its last answer comes with what
    follows it there. Conversations without an answer, an id or a neighbour that answers make no pair.
    """
    found = conversations(turns)
    places = F.when(F.size("turns") > 0, F.sequence(F.lit(1), F.size("turns"))).otherwise(F.array().cast("array<int>"))
    last = F.array_max(F.filter(places, lambda k: F.element_at("turns", k)["role"] == TRAINED))
    found = found.filter("conv_id is not null").withColumn("last", last).filter("last is not null")
    own = found.select("conv_id", F.col("turns").alias("chosen"), F.slice("turns", F.lit(1), F.col("last") - 1).alias("before"))
    tail = F.slice("turns", F.col("last"), F.size("turns")).alias("tail")
    other = found.select(F.expr("conv_id ^ 1").alias("conv_id"), tail)
    return own.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), "chosen", F.concat("before", "tail").alias("rejected"))


def _said(found: str) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";")


def preference_table(turns: DataFrame) -> DataFrame:
    """``format_preferences`` of ``swapped_answers``, with the spans as text: 'start-end;start-end'."""
    found = format_preferences(swapped_answers(turns))
    return found.withColumns({c: _said(c) for c in ("chosen_spans", "rejected_spans")})


PREFERENCE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), replace(coalesce(text, ''), '<|', '< |')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(pos) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY 1 HAVING max(pos) FILTER (WHERE role = 'assistant') IS NOT NULL),
p AS (SELECT a.conv_id, a.last, b.conv_id AS other, b.last AS other_last FROM l a JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
s AS (
  SELECT p.conv_id AS pair_id, 'c' AS side, t.pos, t.role, t.text FROM p JOIN t ON t.conv_id = p.conv_id
  UNION ALL SELECT p.conv_id, 'r', t.pos, t.role, t.text FROM p JOIN t ON t.conv_id = p.conv_id AND t.pos < p.last
  UNION ALL SELECT p.conv_id, 'r', p.last + t.pos - p.other_last, t.role, t.text FROM p JOIN t ON t.conv_id = p.other AND t.pos >= p.other_last),
n AS (
  SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same), max(pos) + 1) - 1 AS n_shared
  FROM (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos,
      c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
    FROM (SELECT * FROM s WHERE side = 'c') c FULL JOIN (SELECT * FROM s WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.pos = r.pos)
  GROUP BY 1),
x AS (
  SELECT s.*, n.n_shared, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM s JOIN n USING (pair_id)),
y AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side, pos > n_shared ORDER BY pos) AS BIGINT) AS stop FROM x)
SELECT pair_id, n_shared,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos <= n_shared), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > n_shared), '') AS chosen,
  coalesce(string_agg((stop - length(body)) || '-' || stop, ';' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > n_shared AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > n_shared), '') AS rejected,
  coalesce(string_agg((stop - length(body)) || '-' || stop, ';' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > n_shared AND role = 'assistant'), '') AS rejected_spans
FROM y GROUP BY pair_id, n_shared
"""
