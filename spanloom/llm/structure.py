"""Repair of the structure of conversations by A* on an edit lattice.

A conversation should read as an optional system turn and then user and assistant in turn, ``(s?(ua)+)?`` over the initials of roles. Edits are
Keep (0), Rerole to user or assistant (3), Delete (4; required for blank and duplicate rows) and Insert of an empty user or assistant turn (3); a row that is cut
off and stays costs 3 more. The cheapest edits are wanted, of equally cheap ones those with the least string of initials (the audit).

States of the lattice are (rows consumed, what may come next). A* keys its queue by (cost so far plus heuristic, audit); the heuristic is the suffix sum of
mandatory deletions and of the charge of 3 that every row cut off costs at least, kept or deleted. It never overestimates and is consistent, so that
the first path to reach a state is its best one.

No conversation has to fit into a task: rows are put in order by ranges, numbered, and cut into blocks of at most 2^BLOCK_BITS consecutive rows. A block is solved
from every state that it may be entered in; what is left of it is a matrix (entry, exit) of costs and ranks of audits. Audits of one entry that consume the
same rows are never prefixes of each other, so their ranks are enough to order the joined audits of many blocks. Matrices are joined in groups, level by level, and the
states at block ends are then handed down again. Rows that repeat a turn, role and text are counted before anything else.

Defined results: null conversations are one conversation; null roles and texts are one space; null turns come first; rows of a turn are ordered by role and
text; a role that starts with neither s, u nor a can't be kept; a conversation of which nothing stays has an empty text; long texts are rows like others, Python sees a letter
a row; an empty table gives an empty result; other columns are ignored. Only the audit and the hash of a whole conversation (a chain by definition, read as a
stream) are a conversation wide.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.runtime import discard, write_once

BLOCK_BITS, LEVEL_BITS = 8, 10
SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a row that is cut off and stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. What may follow is (initial, next state).
FOLLOWS = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
#: Insertions that end a conversation from each state, as (edit, initial) pairs.
TAIL = ("", "IuIa", "Ia", "")
LEGAL = {"su", "ua", "au"}


def _solve(kinds: str, entry: int) -> dict[int, tuple[int, str]]:
    """state -> (cost, edits as (edit, initial) pairs) of the best way through the rows. A row is ``x`` (has to go), or its role's initial, a
    capital if it is cut off; insertions stand before the row that follows them."""
    n, charge = len(kinds), [0] * (len(kinds) + 1)
    for i in range(n - 1, -1, -1):
        charge[i] = charge[i + 1] + (DELETE if kinds[i] == "x" else CUT if kinds[i].isupper() else 0)
    queue, closed, found = [(charge[0], "", 0, entry, 0)], set(), {}
    while queue:
        _, done, i, state, cost = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            found[state] = (cost, done)
            continue
        kind, ways = kinds[i].lower(), [(DELETE, "D-", i + 1, state)]
        more = CUT if kinds[i].isupper() else 0
        for initial, to in FOLLOWS[state]:
            if kind == initial:
                ways.append((more, "K" + initial, i + 1, to))
            if initial != "s":
                ways.append((INSERT, "I" + initial, i, to))
                if kind != "x":
                    ways.append((REROLE + more, "R" + initial, i + 1, to))
        for c, edit, j, to in ways:
            if (j, to) not in closed:
                heapq.heappush(queue, (cost + c + charge[j], done + edit, j, to, cost + c))
    return found


@lru_cache(maxsize=4096)
def _block(kinds: str, initials: str, first: bool) -> tuple[list[int], list[str | None]]:
    """(costs and ranks of each entry and exit, then first initial, last initial and illegal neighbours; edits of each entry and exit) of a block of rows."""
    matrix, edits = [-1] * 32, [None] * 16
    for entry in (0,) if first else range(4):
        found = _solve(kinds, entry)
        for rank, state in enumerate(sorted(found, key=lambda s: found[s][1])):
            at = entry * 4 + state
            matrix[2 * at : 2 * at + 2] = found[state][0], rank
            edits[at] = found[state][1]
    illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
    return [*matrix, ord(initials[0]), ord(initials[-1]), illegal], edits


def _joined(parts: list[np.ndarray]) -> tuple[list[int], list[str | None]]:
    """(matrix of consecutive parts, the states after each part for each entry and exit)."""
    matrix, via = [-1] * 32, [None] * 16
    for entry in range(4):
        now = {entry: (0, 0, "")}
        for p in parts:
            best: dict[int, tuple] = {}
            for a, (cost, rank, way) in now.items():
                for b in range(4):
                    c, r = int(p[8 * a + 2 * b]), int(p[8 * a + 2 * b + 1])
                    if c >= 0 and (b not in best or (cost + c, rank, r) < best[b][:3]):
                        best[b] = (cost + c, rank, r, way + str(b))
            order = sorted(best, key=lambda b: best[b][1:3])
            now = {b: (best[b][0], k, best[b][3]) for k, b in enumerate(order)}
        for b, (cost, rank, way) in now.items():
            at = entry * 4 + b
            matrix[2 * at : 2 * at + 2], via[at] = (cost, rank), way
    illegal = sum(int(p[34]) for p in parts) + sum(chr(a[33]) + chr(b[32]) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    return [*matrix, int(parts[0][32]), int(parts[-1][33]), illegal], via


def _fields(texts: str) -> T.StructType:
    return T.StructType().add("matrix", T.ArrayType(T.LongType())).add(texts, T.ArrayType(T.StringType()))


@F.pandas_udf(_fields("edits"))
def _solved(kinds: pd.Series, initials: pd.Series, first: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_block(k, i, bool(f)) for k, i, f in zip(kinds, initials, first, strict=True)], columns=["matrix", "edits"])


@F.pandas_udf(_fields("via"))
def _composed(parts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_joined(list(p)) for p in parts], columns=["matrix", "via"])


@dataclass
class Repair:
    """Written tables: ``runs`` (conv, m: place in the order of all rows, block, turn, role, text, n: times it is repeated, blank, duplicate, cut), ``blocks`` (conv, block,
    ms, ns, edits: one item a run: its insertions and its own edit, as (edit, initial) pairs), ``ends`` (conv, cost without repeats, tail, illegal)."""

    runs: DataFrame
    blocks: DataFrame
    ends: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: (conv_id, m, at, role, text, edit), in the order of m and at; deleted rows are left out."""
        e = self.blocks.select(F.explode(F.arrays_zip("ms", "edits")).alias("e")).select(F.col("e.ms").alias("e_m"), F.col("e.edits").alias("e_edit"))
        r = self.runs.join(e, F.col("m") == F.col("e_m"))
        put = F.transform(F.regexp_extract_all("e_edit", F.lit("I(.)"), F.lit(1)), lambda x: F.struct(_role(x).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
        own = F.substring("e_edit", -2, 1)
        role = F.when(own == "K", F.col("role")).otherwise(_role(F.substring("e_edit", -1, 1)))
        kept = F.when(own == "D", F.array()).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"), own.alias("edit"))))
        out = r.select("conv", "m", "block", F.posexplode(F.concat(put, kept)).alias("at", "x")).select("conv", "m", "block", "at", "x.*")
        tail = F.transform(F.regexp_extract_all("tail", F.lit("I(.)"), F.lit(1)), lambda x: F.struct(_role(x).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
        last = self.ends.select("conv", F.lit((1 << 63) - 1).alias("m"), F.lit((1 << 63) - 1).alias("block"), F.posexplode(tail).alias("at", "x")).select("conv", "m", "block", "at", "x.*")
        return out.unionByName(last).withColumnRenamed("conv", "conv_id")


def _role(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def _runs(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    r = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    r = r.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    short = F.when(F.length("role") <= 64, F.substring("text", 1, 64))  # ranges by bounded keys
    r = r.repartitionByRange(F.col("conv"), F.col("turn"), F.substring("role", 1, 64), short).sortWithinPartitions("conv", "turn", "role", "text")
    r = r.withColumn("m", F.monotonically_increasing_id())
    bare = F.rtrim("text", F.lit(SPACE))
    r = r.select("conv", "m", F.shiftright("m", BLOCK_BITS).alias("block"), "turn", "role", "text", "n", (F.ltrim("text", F.lit(SPACE)) == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit("\n"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    r = write_once(r.withColumn("key", key), "turnruns")
    first = r.filter("NOT blank").groupBy(F.col("key").alias("f_key")).agg(F.min("m").alias("f_m"))
    j = r.join(first, F.col("key") == F.col("f_key"), "left")
    again = ~F.col("blank") & (F.col("m") > F.col("f_m"))
    out = j.select("conv", "m", "block", "turn", "role", "text", "n", "blank", again.alias("duplicate"), (~F.col("blank") & ~again & F.col("cut")).alias("cut"))
    out = write_once(out, "turnruns")
    discard(r)
    return out


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation in ``rows``."""
    runs = _runs(rows, conv, turn, role, text)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    kind = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    item = F.struct("m", kind.alias("kind"), initial.alias("initial"), "n")
    b = runs.groupBy("conv", "block").agg(F.array_sort(F.collect_list(item)).alias("r"))  # at most 2^BLOCK_BITS small items
    first = runs.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    b = b.alias("b").join(first.alias("f"), F.col("b.conv").eqNullSafe(F.col("f.conv"))).select("b.conv", "block", "r", (F.col("block") == F.col("first")).alias("first"), (F.col("first") == F.col("last")).alias("lone"))
    letters = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "")
    b = b.select("conv", "block", "lone", F.transform("r", lambda x: x["m"]).alias("ms"), F.transform("r", lambda x: x["n"]).alias("ns"), _solved(letters("kind"), letters("initial"), "first").alias("s"))
    b = write_once(b.select("conv", "block", "lone", "ms", "ns", "s.matrix", "s.edits"), "turnblocks")

    # Conversations of several blocks: join their matrices level by level, then hand the states down.
    levels, top = [], b.filter("NOT lone").select("conv", F.col("block").alias("g"), "matrix")
    while top.groupBy("conv").count().filter("count > 1").limit(1).count():
        part = F.array_sort(F.collect_list(F.struct("g", "matrix")))
        up = top.groupBy("conv", F.shiftright("g", LEVEL_BITS).alias("g_up")).agg(part.alias("p"))
        up = up.select("conv", "g_up", F.transform("p", lambda x: x["g"]).alias("parts"), _composed(F.transform("p", lambda x: x["matrix"])).alias("c"))
        levels.append(write_once(up.select("conv", F.col("g_up").alias("g"), "parts", "c.matrix", "c.via"), "turnlevel"))
        top = levels[-1].select("conv", "g", "matrix")
    whole = b.filter("lone").select("conv", F.col("block").alias("g"), "matrix").unionByName(top)
    ways = F.array(*[F.struct((F.col("matrix")[2 * s] + len(TAIL[s]) // 2 * INSERT).alias("cost"), F.col("matrix")[2 * s + 1].alias("rank"), F.lit(s).alias("exit"), F.lit(TAIL[s]).alias("tail")) for s in range(4)])
    best = F.array_min(F.filter(ways, lambda w: w["rank"] >= 0))
    ends = write_once(whole.select("conv", "g", best.alias("best"), F.col("matrix")[34].alias("illegal")).select("conv", "g", "best.cost", "best.exit", "best.tail", "illegal"), "turnends")
    state = ends.select("conv", "g", F.lit(0).alias("entry"), "exit")
    lone = state.join(b.filter("lone").select(F.col("conv").alias("b_conv"), F.col("block").alias("b_g")), F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("g") == F.col("b_g")), "left_semi")
    down = state.join(lone.select(F.col("conv").alias("b_conv"), F.col("g").alias("b_g")), F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("g") == F.col("b_g")), "left_anti")
    for level in reversed(levels):
        l = level.select(F.col("conv").alias("l_conv"), F.col("g").alias("l_g"), "parts", "via")  # noqa: E741
        j = down.join(l, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("g") == F.col("l_g")))
        way = F.col("via")[F.col("entry") * 4 + F.col("exit")]
        j = j.select("conv", F.posexplode("parts").alias("k", "part"), way.alias("way"), "entry")
        digit = lambda k: F.substr("way", k, F.lit(1)).cast("int")
        down = write_once(j.select("conv", F.col("part").alias("g"), F.when(F.col("k") == 0, F.col("entry")).otherwise(digit(F.col("k"))).alias("entry"), digit(F.col("k") + 1).alias("exit")), "turnstates")
    state = lone.unionByName(down).select(F.col("conv").alias("s_conv"), F.col("g").alias("s_g"), "entry", "exit")
    chosen = b.join(state, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_g")))
    edits = F.regexp_extract_all(F.col("edits")[F.col("entry") * 4 + F.col("exit")], F.lit("(?:I.)*+[DKR]."), F.lit(0))
    blocks = write_once(chosen.select("conv", "block", "ms", "ns", edits.alias("edits")), "turnedits")
    discard(b)
    return Repair(runs, blocks, ends.select("conv", "cost", "tail", "illegal"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha256) of sorted (conv, text) rows, joined by newlines; a conversation is read as a stream."""
    now = held = None
    for batch in batches:
        out = []
        for conv, text in zip(batch.column("conv"), batch.column("text"), strict=True):
            c = conv.as_py()
            if held is None or c != now:
                if held is not None:
                    out.append((now, held.hexdigest()))
                now, held = c, hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(text.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("conv").type), pa.array([x[1] for x in out])], ["conv", "sha"])
        kind = batch.schema.field("conv").type
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([held.hexdigest()])], ["conv", "sha"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """op11: a row per conversation of ``conversations``: the faults of ``rows`` and their cheapest repair."""
    r = repair(rows)
    turns = r.runs.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    count = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long")
    blank = F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).cast("long")
    duplicate = F.sum(F.when(F.col("duplicate"), F.col("n")).when(~F.col("blank"), F.col("n") - 1).otherwise(0)).cast("long")
    faults = r.runs.groupBy("conv").agg(blank.alias("blank"), duplicate.alias("duplicate"), count("cut").alias("truncated"), (F.sum(F.col("n") - 1)).cast("long").alias("extra"))
    letters = F.zip_with("edits", "ns", lambda e, n: F.concat(F.regexp_replace(e, "(.).", "$1"), F.repeat(F.lit("D"), (n - 1).cast("int"))))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.array_join(letters, "").alias("a")))), lambda x: x["a"]), "")
    audits = r.blocks.groupBy("conv").agg(audit.alias("audit"))
    line = F.concat("role", F.lit(":"), "text")
    texts = r.rows().groupBy(F.col("conv_id").alias("conv"), "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "at", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    shas = texts.repartition("conv").sortWithinPartitions("conv", "block").select("conv", "text")
    kind = dict(shas.dtypes)["conv"]
    shas = shas.mapInArrow(_digests, f"conv {kind}, sha string")
    out = conversations.select(F.col("conv_id").alias("id")).distinct()
    for k, t in enumerate((turns, faults, audits, r.ends, shas)):
        out = out.join(t.withColumnRenamed("conv", f"c{k}"), F.col("id").eqNullSafe(F.col(f"c{k}")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    cost = (F.coalesce(F.col("cost"), F.lit(0)) + DELETE * F.coalesce(F.col("extra"), F.lit(0))).cast("long")
    illegal = (F.coalesce(F.col("illegal"), F.lit(0)) + F.coalesce(F.col("extra"), F.lit(0))).cast("long")
    whole = F.concat(F.coalesce("audit", F.lit("")), F.coalesce(F.regexp_replace("tail", "(.).", "$1"), F.lit("")))
    return out.select(F.col("id").alias("conv_id"), zero("gaps").alias("gaps"), zero("blank").alias("blank"), zero("duplicate").alias("duplicate"), zero("truncated").alias("truncated"), illegal.alias("illegal"), cost.alias("cost"), whole.alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: of twenty rows (by a checksum of their ids) one is dropped, one emptied, one loses its stops, one is repeated, one is given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")
    d = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(key) % 20).alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def damaged_report(conversations: DataFrame) -> DataFrame:
    return report(conversations, damaged(conversations))


REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations),
h AS (SELECT * EXCLUDE (bytes), xor(list_reduce(bytes, lambda s, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(s, x)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k FROM k),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS ini FROM n),
g AS (SELECT *, coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM f),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(bad) AS illegal, max(i) AS rows FROM g GROUP BY conv_id),
step(q, ini, to_q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(q, to_q, cost, audit, roles) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'u'), (0, 3, 6, 'II', 'ua'), (1, 2, 3, 'I', 'u'), (1, 3, 6, 'II', 'ua'),
    (2, 3, 3, 'I', 'a'), (2, 2, 6, 'II', 'au'), (3, 2, 3, 'I', 'u'), (3, 3, 6, 'II', 'ua')),
edit AS (SELECT g.conv_id, g.i, x.q, x.to_q, x.cost, x.audit, x.roles FROM g, LATERAL (
    SELECT q, q AS to_q, 4 AS cost, 'D' AS audit, '-' AS roles FROM (VALUES (0), (1), (2), (3)) z(q)
    UNION ALL SELECT q, to_q, CASE WHEN g.fault = 'truncated' THEN 3 ELSE 0 END, 'K', ini FROM step WHERE ini = g.ini AND g.fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT q, to_q, CASE WHEN g.fault = 'truncated' THEN 6 ELSE 3 END, 'R', ini FROM step WHERE ini <> 's' AND g.fault NOT IN ('blank', 'duplicate')) x),
way AS (SELECT e.conv_id, e.i, p.q, e.to_q, min(struct_pack(c := p.cost + e.cost, a := p.audit || e.audit, r := p.roles || e.roles)) AS w FROM put p JOIN edit e ON p.to_q = e.q GROUP BY ALL),
t AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, struct_pack(c := 0, a := '', r := '') AS w FROM s
    UNION ALL SELECT t.conv_id, t.i + 1, y.to_q, min(struct_pack(c := t.w.c + y.w.c, a := t.w.a || y.w.a, r := t.w.r || y.w.r))
    FROM t JOIN way y ON t.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = t.i + 1 AND y.q = t.q GROUP BY t.conv_id, t.i, y.to_q),
best AS (SELECT t.conv_id, min(struct_pack(c := t.w.c + p.cost, a := t.w.a || p.audit, r := t.w.r || p.roles)) AS w
    FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.rows JOIN put p ON p.q = t.q AND (p.to_q = 3 OR p.q = 0 AND p.to_q = 0) GROUP BY t.conv_id),
l AS (SELECT conv_id, unnest(range(1, length(w.a) + 1)) AS pos, w FROM best),
m AS (SELECT conv_id, pos, substr(w.a, pos, 1) AS e, substr(w.r, pos, 1) AS r, length(replace(substr(w.a, 1, pos), 'I', '')) AS i FROM l),
o AS (SELECT m.conv_id, string_agg(CASE WHEN e = 'K' THEN g.role || ':' || g.text WHEN r = 'u' THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'R' THEN g.text ELSE '' END, chr(10) ORDER BY pos) AS text
    FROM m LEFT JOIN g ON e <> 'I' AND m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.i = g.i WHERE e <> 'D' GROUP BY m.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(best.w.c, 0) AS BIGINT) AS cost, coalesce(best.w.a, '') AS audit, sha256(coalesce(o.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN o ON a.conv_id IS NOT DISTINCT FROM o.conv_id
"""
