"""Preference formatting of conversations.

Chosen and rejected conversations of a pair are joined by turn; the first turn at which they differ (in role or text, or
because one side lacks it) ends their longest common prefix. Prefix turns are emitted once, as ``prompt``; the others as
``chosen`` and ``rejected``, rendered, with ``loss`` true where a model is trained on the turn (completion turns of the
assistant). The result has a row per turn, in the order of ``turn``, so that no conversation, however long, has
to fit into one row or task; the join and the minimum per pair are pre-aggregated and split by the planner if skewed. ``assemble`` makes a training
row per pair of these (which a pair's conversation has to fit into): prompt, both completions, and the stretches of each that are trained on.

Defined results: rows with a null pair or turn take no part; null role or text count as empty; of rows that repeat a
turn the smallest (role, text) is kept; a pair that lacks one side is not a pair and is left out; equal sides give a
prompt alone, which ``assemble`` gives empty completions; a very long turn is a row like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import write_once


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _turns(rows: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    x = F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    r = rows.filter(F.col(pair).isNotNull() & F.col(turn).isNotNull()).select(F.col(pair).alias("pair_id"), F.col(turn).alias("turn"), x.alias("x"))
    return r.groupBy("pair_id", "turn").agg(F.min("x").alias("x"))


def preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(pair_id, part, turn, role, rendered, loss) of all pairs that both tables hold."""
    a = _turns(chosen, pair, turn, role, text).withColumnRenamed("x", "a")
    b = _turns(rejected, pair, turn, role, text).withColumnRenamed("x", "b")
    both = a.join(b, ["pair_id", "turn"], "full")
    differ = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))
    ends = both.groupBy(F.col("pair_id").alias("p")).agg(F.min(F.when(differ, F.col("turn"))).alias("first"), F.max(F.col("a").isNotNull()).alias("has_a"), F.max(F.col("b").isNotNull()).alias("has_b"))
    rows = both.join(ends.filter("has_a AND has_b"), F.col("pair_id") == F.col("p"))
    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    prompt = F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("x")))
    split = F.array(F.struct(F.lit("chosen").alias("part"), F.col("a").alias("x")), F.struct(F.lit("rejected").alias("part"), F.col("b").alias("x")))
    out = rows.select("pair_id", "turn", F.explode(F.when(common, prompt).otherwise(F.filter(split, lambda s: s["x"].isNotNull()))).alias("s"))
    role_of = F.col("s.x.role")
    return out.select("pair_id", F.col("s.part").alias("part"), "turn", role_of.alias("role"), render(role_of, F.col("s.x.text")).alias("rendered"), ((F.col("s.part") != "prompt") & (role_of == trained)).alias("loss"))


def assemble(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_trained, rejected_trained) of rows as ``preferences`` returns them: a row per pair, which holds
    the pair's conversation as a training example does; trained stretches are (start, end) in characters of the completion."""
    part = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("turn", "rendered", "loss"))))
    g = turns.groupBy("pair_id").agg(*[part(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(held, x):
        end = held["at"] + F.length(x["rendered"])
        span = F.array(F.struct(held["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    spans = lambda p: F.aggregate(p, none, step, lambda held: held["spans"])
    return g.select("pair_id", *[text(p).alias(p) for p in ("prompt", "chosen", "rejected")], spans("chosen").alias("chosen_trained"), spans("rejected").alias("rejected_trained"))


def other_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected): every conversation with an answer, and the same with its last answer taken from its neighbour (2n and 2n + 1 are neighbours);
    without a neighbour's answer, that turn is missing."""
    t = _turns(conversations, "conv_id", "turn", "role", "text").select(F.col("pair_id"), "turn", "x.role", "x.text")
    last = t.groupBy(F.col("pair_id").alias("l_id")).agg(F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("last")).filter("last IS NOT NULL")
    last = write_once(last.select("l_id", F.col("last.turn").alias("l_turn"), F.col("last.text").alias("l_text")), "answers")
    mate = last.select(F.when(F.pmod("l_id", F.lit(2)) == 0, F.col("l_id") + 1).otherwise(F.col("l_id") - 1).alias("m_id"), F.col("l_text").alias("m_text"))
    both = write_once(last.join(mate, F.col("l_id") == F.col("m_id"), "left").select("l_id", "l_turn", "m_text"), "answers")
    rows = t.join(both, F.col("pair_id") == F.col("l_id"))
    here = F.col("turn") == F.col("l_turn")
    rejected = rows.filter(~here | F.col("m_text").isNotNull()).select("pair_id", "turn", "role", F.when(here, F.col("m_text")).otherwise(F.col("text")).alias("text"))
    return rows.select("pair_id", "turn", "role", "text"), rejected


def answer_turns(conversations: DataFrame) -> DataFrame:
    """Preferences for a conversation's own last answer over its neighbour's, a row per turn."""
    return preferences(*other_answers(conversations))


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """op6: the same as training rows, one per pair: the prompt, both completions, and the stretches of each that are trained on, as ``start:end`` joined by commas."""
    a = assemble(answer_turns(conversations))
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return a.select("pair_id", "prompt", "chosen", "rejected", mask("chosen_trained").alias("chosen_mask"), mask("rejected_trained").alias("rejected_mask"))


TURNS_SQL = r"""
WITH t AS (SELECT conv_id, turn, min(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))) AS x FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
l AS (SELECT conv_id, max(struct_pack(turn := turn, t := x.t)) AS last FROM t WHERE x.r = 'assistant' GROUP BY conv_id),
m AS (SELECT l.conv_id, l.last.turn AS pos, o.last.t AS other FROM l LEFT JOIN l o ON o.conv_id = CASE WHEN l.conv_id % 2 = 0 THEN l.conv_id + 1 ELSE l.conv_id - 1 END),
a AS (SELECT t.conv_id AS pair_id, turn, x FROM t JOIN m ON t.conv_id = m.conv_id),
z AS (SELECT t.conv_id AS pair_id, turn, CASE WHEN turn = pos THEN struct_pack(r := x.r, t := other) ELSE x END AS x
  FROM t JOIN m ON t.conv_id = m.conv_id WHERE turn <> pos OR other IS NOT NULL),
b AS (SELECT coalesce(a.pair_id, z.pair_id) AS pair_id, coalesce(a.turn, z.turn) AS turn, a.x AS a, z.x AS z
  FROM a FULL JOIN z ON a.pair_id = z.pair_id AND a.turn = z.turn),
e AS (SELECT *, min(CASE WHEN a IS NULL OR z IS NULL OR a <> z THEN turn END) OVER p AS first, count(a) OVER p AS na, count(z) OVER p AS nz
  FROM b WINDOW p AS (PARTITION BY pair_id)),
o AS (SELECT pair_id, turn, 'prompt' AS part, a AS x FROM e WHERE na > 0 AND nz > 0 AND (first IS NULL OR turn < first)
  UNION ALL SELECT pair_id, turn, 'chosen', a FROM e WHERE na > 0 AND nz > 0 AND turn >= first AND a IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', z FROM e WHERE na > 0 AND nz > 0 AND turn >= first AND z IS NOT NULL)
SELECT pair_id, part, turn, x.r AS role, '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10) AS rendered, part <> 'prompt' AND x.r = 'assistant' AS loss FROM o
"""

PAIRS_SQL = f"""
WITH r AS ({TURNS_SQL.strip()}),
p AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn) AS till FROM r)
SELECT pair_id, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg((till - length(rendered)) || ':' || till, ',' ORDER BY turn) FILTER (part = 'chosen' AND loss), '') AS chosen_mask,
  coalesce(string_agg((till - length(rendered)) || ':' || till, ',' ORDER BY turn) FILTER (part = 'rejected' AND loss), '') AS rejected_mask
FROM p GROUP BY pair_id
"""
