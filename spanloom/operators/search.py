"""Full-text search, reranking, planning, expansion and packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.classify import extension_weight
from spanloom.functions.text import bigrams, jaccard, once, plan_tokens, presence, tokens
from spanloom.runtime import spread, write_once

#: Rerank weights; weights of a plan's fields.
RERANK = {"bm25": 0.55, "uni": 0.18, "bi": 0.12, "path": 0.07, "lit": 0.02, "ext": 0.06}
PLAN = {"symbol": 3.0, "path": 2.5, "summary": 1.8, "inputs": 1.5, "outputs": 1.2, "side_effects": 1.0, "pitfalls": 0.9, "usage": 0.6}


def normalize_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Missing weights are filled in, negative ones are 0, and all sum to 1; defaults if none is left."""
    w = {k: max(0.0, float((weights or RERANK).get(k, v))) for k, v in RERANK.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if weights and total > 0 else dict(RERANK)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, len)"""
    t = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).select("id", tokens(F.col("t")).alias("t"))
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def index_for(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """((term, id, tf, len) of the queries' terms only, written; n_docs and avg_len of the collection), from one pass over the texts."""
    terms = queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    few = [r["term"] for r in terms.limit(FEW + 1).collect()]
    t = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).select("id", tokens(F.col("t")).alias("t"))
    asked = F.filter("t", lambda w: w.isin(*few)) if len(few) <= FEW else F.col("t")  # else a row a word, of which the join leaves a few
    rows = t.select("id", F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), asked)).alias("term"))  # a row without a term counts a text
    if len(few) > FEW:
        rows = rows.join(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi")
    index = write_once(rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "postings")
    r = index.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("a")).first()
    return index.filter("term <> ''"), {"n_docs": r["n"] or 0, "avg_len": r["a"] or 1.0}


def bm25(index: DataFrame, queries: DataFrame, n_docs: int, avg_len: float, k1: float = 1.2, b: float = 0.75, every: bool = True) -> DataFrame:
    """(query_id, id, score_pos, bm25): documents with all terms (or, without ``every``, with one). bm25 is negated: lower is better.

    ``queries``: (query_id, text). The document frequencies of the queries' terms only are computed.
    """
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
    q = q.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    hits = index.join(q, "term")
    df = index.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    s = hits.join(df, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score_pos"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
    return s.filter((F.col("n") == F.col("n_terms")) if every else F.lit(True)).select("query_id", "id", "score_pos", (-F.col("score_pos")).alias("bm25"))


def normalize_bm25(raw, corrected: bool = False):
    """1 / (1 + raw) with negatives and non-numbers as 0; corrected: larger for better (more negative) scores."""
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    r = F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), raw))
    return F.when(bad, 0.0).otherwise(F.abs(raw) / (1 + F.abs(raw))) if corrected else 1.0 / (1.0 + r)


def _signals(h: DataFrame, w: dict[str, float], corrected: bool) -> DataFrame:
    """Adds ``rerank`` to rows with bm25, path and what ``_of_query`` and ``_of_text`` make."""
    score = (
        w["bm25"] * normalize_bm25(F.col("bm25"), corrected) + w["uni"] * jaccard(F.col("_q"), F.col("_h")) + w["bi"] * jaccard(F.col("_qb"), F.col("_hb"))
        + w["path"] * jaccard(F.col("_q"), F.col("_p")) + w["lit"] * presence(F.array_join("_q", " "), F.col("_t")) + w["ext"] * extension_weight(F.col("path"))
    )
    return h.withColumn("rerank", score).drop("_q", "_qb", "_h", "_hb", "_p", "_t")


def _of_query(rows: DataFrame, query: str) -> DataFrame:
    return rows.withColumn("_q", tokens(F.col(query))).withColumn("_qb", bigrams(F.col("_q")))


def _of_text(rows: DataFrame) -> DataFrame:
    t = F.substring("text", 1, 1500)
    return rows.withColumn("_t", t).withColumn("_h", tokens(t)).withColumn("_hb", bigrams(F.col("_h"))).withColumn("_p", tokens(F.col("path")))


def rerank(hits: DataFrame, weights: dict[str, float] | None = None, corrected: bool = False) -> DataFrame:
    """Adds ``rerank`` to (query, path, text, bm25): six signals over the first 1500 characters."""
    return _signals(_of_text(_of_query(hits, "query")), normalize_weights(weights), corrected)


def rerank_hits(hits: DataFrame, docs: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None, corrected: bool = False) -> DataFrame:
    """(query_id, id, path, rerank) of hits (query_id, id, bm25) of documents (id, path, text) for queries (query_id, text). Each query and each document that is hit
    is tokenised once, however often it is hit, and written, so that no expression is evaluated again in a signal."""
    d = docs.join(hits.select("id").distinct(), "id", "left_semi").select("id", "path", F.substring("text", 1, 1500).alias("text"))
    d = write_once(_of_text(d).drop("text"), "hitdocs")
    q = write_once(_of_query(queries, "text").drop("text"), "hitqueries")
    return _signals(hits.join(d, "id").join(q, "query_id"), normalize_weights(weights), corrected).select("query_id", "id", "path", "rerank")


def top(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", n).filter(F.col("rank") <= k)


def contained(values: DataFrame, needles: DataFrame, value: str, needle: str, size: int = 3) -> DataFrame:
    """(value, needle) of the distinct values that contain a needle: an equality on a needle's first characters and a value's runs of as many, then a test."""
    keyed = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct().withColumn("_k", F.substring("needle", 1, size))
    v = values.select(F.col(value).alias("value")).filter("value <> ''").distinct()
    runs = lambda n: F.regexp_extract_all("value", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    lengths = [r["n"] for r in keyed.select(F.length("_k").alias("n")).distinct().collect()]  # 1 to size
    if not lengths:
        return v.select("value", F.col("value").alias("needle")).limit(0)
    grams = v.select("value", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in lengths])))).alias("_k"))
    return grams.join(keyed, "_k").filter(F.contains("value", "needle")).select("value", "needle").distinct()


def rows_with(rows: DataFrame, needles: DataFrame, key: str, text: str, needle: str, size: int = 3) -> DataFrame:
    """(key, needle) of the rows whose text contains a needle. Only keys are shuffled, and texts once, to their own keys.

    A needle of ``size`` characters or more is looked up by the rarest of its runs of that many characters, among the runs that any needle has; a shorter one by itself.
    A run that many needles or texts share is thus used only by needles that have no other. Up to QUERY_BLOCK needles (this is checked) are looked for where texts are read, and no text is cut into runs or shuffled.
    """
    keyed = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    keyed = write_once(keyed, "needles")  # a caller's needles may be what a search left over
    few = [r["needle"] for r in keyed.limit(QUERY_BLOCK + 1).collect()]
    if 0 < len(few) <= QUERY_BLOCK:
        held = once(F.col(text), lambda t: F.filter(F.array(*map(F.lit, few)), lambda x: F.contains(t, x)))
        return spread(rows.select(key, text)).select(key, F.explode(held).alias("needle")).distinct()
    runs = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    own = F.when(F.length("needle") < size, F.array("needle")).otherwise(F.array_distinct(runs("needle", size)))
    of = write_once(keyed.select("needle", F.explode(own).alias("run")), "needleruns")
    lengths = [r["n"] for r in of.select(F.length("run").alias("n")).distinct().collect()]  # 1 to size
    if not lengths:
        return rows.select(F.col(key).alias(key), F.lit("").alias("needle")).limit(0)
    r = rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[runs(text, n) for n in lengths])))).alias("run"))
    r = write_once(r.join(of.select("run").distinct(), "run", "left_semi"), "rowruns")
    often = r.groupBy("run").agg(F.count("*").alias("rows"))
    rarest = of.join(often, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "run")).alias("x")).select("needle", F.col("x.run").alias("run"))
    maybe = rarest.join(r, "run").select(key, "needle")
    return rows.select(key, F.col(text).alias("_text")).join(maybe, key).filter(F.contains("_text", "needle")).select(key, "needle").distinct()


QUERY_BLOCK, ROW_BLOCK = 256, 1 << 13
#: Blocks of queries and of rows that are dealt hold so many of these at most: all rows are sent once for each block of queries.
QUERY_BLOCKS, ROW_BLOCKS = 64, 8
#: Terms of queries that are picked out of a text's words where it is read.
FEW = 1 << 12


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, of equal ones those with the smallest ids; ``ids`` ascend."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, -k)[-k]
    over = np.flatnonzero(score > least)
    return np.concatenate([over, np.flatnonzero(score == least)[: k - len(over)]])


def _block_best(q: pa.Table, x: pa.Table, k: int, low: float, high: float, other: bool, grouped: bool) -> pa.Table:
    """(query_id, id, grp, bonus, score) of the k best rows of a block for each query (and group); nothing else of the block's products leaves it."""
    x = x.sort_by("id")
    qi, xi = q.column("id").to_numpy(), x.column("id").to_numpy()
    qv, xv = (np.stack(t.column("v").to_numpy()).astype(np.float64) for t in (q, x))
    qn, xn = np.sqrt((qv * qv).sum(axis=1)), np.sqrt((xv * xv).sum(axis=1))
    bonus, grp = x.column("bonus").to_numpy(), x.column("grp").to_numpy(zero_copy_only=False)
    kinds = [grp == g for g in np.unique(grp)] if grouped else [np.ones(len(xi), bool)]
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    kept: list[pa.Table] = []

    def made() -> pa.Table:
        flat = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.int64, np.float64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "id", "grp", "bonus", "score"), map(pa.array, flat), strict=True)))

    for n, i in enumerate(np.flatnonzero(qn > 0)):
        if n and n % QUERY_BLOCK == 0:
            kept.append(made())
            out = [[], [], [], [], []]
        live = (xn > 0) & (xi != qi[i]) if other else xn > 0
        cosine = np.divide(xv @ qv[i], xn * qn[i], out=np.zeros(len(xi)), where=xn > 0)
        rank = np.clip(np.floor(cosine * 1e6 + 0.5) / 1e6 + bonus, low, high)
        for kind in kinds:
            at = np.flatnonzero(live & kind)
            at = at[_best(rank[at], xi[at], k)]
            for column, value in zip(out, (np.full(len(at), qi[i]), xi[at], grp[at], bonus[at], cosine[at]), strict=True):
                column.append(value)
    return pa.concat_tables([*kept, made()])


def _plan_best(q: pa.Table, x: pa.Table, fields: list[str], k: int, least: float) -> pa.Table:
    """(query_id, id, score) of the k best candidates (id and lower-cased fields) of a block for each query (query_id, t: its tokens); a field's distinct values are looked through once."""
    words = q.column("t").to_pylist()
    place = {t: i for i, t in enumerate(sorted({t for ts in words for t in ts}))}
    lengths = sorted({len(t) for t in place})
    asks = np.zeros((len(place), q.num_rows), np.int32)
    for j, ts in enumerate(words):
        asks[[place[t] for t in ts], j] = 1
    x = x.sort_by("id")
    score = np.zeros((x.num_rows, q.num_rows))
    for f in fields:
        coded = x.column(f).combine_chunks().dictionary_encode()
        held = [sorted({place[v[i : i + n]] for n in lengths for i in range(len(v) - n + 1) if v[i : i + n] in place}) for v in coded.dictionary.to_pylist()]
        counts = np.zeros((len(held), q.num_rows), np.int32)
        for i, h in enumerate(held):
            if h:
                counts[i] = asks[h].sum(axis=0)
        score += PLAN[f] * counts[coded.indices.to_numpy()]
        if f == "summary":
            score += 0.5 * np.array([v != "" for v in coded.dictionary.to_pylist()])[coded.indices.to_numpy()][:, None]
    score = np.round(score, 3)
    at = [np.flatnonzero(score[:, j] >= least) for j in range(q.num_rows)]
    at = [a[_best(score[a, j], a, k)] for j, a in enumerate(at)]
    row, col = np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(q.num_rows), [len(a) for a in at])
    return pa.table({"query_id": q.column("query_id").take(pa.array(col)), "id": x.column("id").take(pa.array(row)), "score": pa.array(score[row, col])})


def plan_scores(candidates: DataFrame, queries: DataFrame, fields: list[str], k: int = 5, least: float = 0.4) -> DataFrame:
    """(query_id, id, score) of candidates (id and text fields) for queries (query_id, text): at least the k best of each query, of equal ones those with the smallest ids.

    A block of candidates meets a block of queries and gives k rows a query, so that what is shuffled grows with the queries, not with the pairs. Up to QUERY_BLOCK
    queries (this is checked) travel to all tasks; more are dealt with the candidates in blocks.
    """
    x = candidates.select("id", *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    q = queries.select("query_id", F.array_distinct(plan_tokens(F.col("text"))).alias("t"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {candidates.schema['id'].dataType.simpleString()}, score double"
    few = q.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:

        def scan(batches):
            if not few.num_rows:
                return
            for b in batches:
                for at in range(0, b.num_rows, ROW_BLOCK):
                    yield from _plan_best(few, pa.Table.from_batches([b.slice(at, ROW_BLOCK)]), fields, k, least).to_batches()

        found = x.mapInArrow(scan, schema)
    else:
        nq, nx = (max(1, -(-d.count() // n)) for d, n in ((q, QUERY_BLOCK), (x, ROW_BLOCK)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("a"), every(nx).alias("b"))
        x = x.select("*", every(nq).alias("a"), F.pmod(F.xxhash64("id", *fields), F.lit(nx)).cast("int").alias("b"))
        none = pa.table({"query_id": few.column("query_id").slice(0, 0), "id": candidates.select("id").limit(0).toArrow().column("id"), "score": pa.array([], pa.float64())})
        found = q.groupBy("a", "b").cogroup(x.groupBy("a", "b")).applyInArrow(lambda l, r: _plan_best(l, r, fields, k, least) if l.num_rows and r.num_rows else none, schema)  # noqa: E741
    return found.select("query_id", "id", F.round("score", 3).alias("score"))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, bonus: Column | None = None, low: float = -np.inf, high: float = np.inf, other: bool = False, group: Column | None = None) -> DataFrame:
    """(query_id, id, score) of each query's k best rows by cosine, exact: its score to six places plus the row's ``bonus``, within ``low`` and ``high``; equal ones by id.

    ``other`` leaves out the query's own row; with ``group`` (a long), k of each group, and a column grp. Vectors that are null or of norm 0 take no part. A block of rows meets a block of
    queries and gives k rows a query, so that what is shuffled grows with the queries, not with the pairs. Up to QUERY_BLOCK queries (this is checked) travel to all
    tasks, and rows are not moved at all; more queries are dealt with the rows in blocks, large ones, as each block of one side meets a copy of the other side. Vectors of floats travel as such.
    """
    vec = lambda d: (F.col(vec_col) if dict(d.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")).alias("v")
    pick = lambda d: d.select(F.col(id_col).cast("long").alias("id"), vec(d), (F.lit(0.0) if bonus is None else bonus.cast("double")).alias("bonus"), (F.lit(0) if group is None else group).cast("long").alias("grp")).filter("id IS NOT NULL AND v IS NOT NULL")
    x, q = pick(rows), queries.select(F.col(id_col).cast("long").alias("id"), vec(queries)).filter("id IS NOT NULL AND v IS NOT NULL")
    args = (k, low, high, other, group is not None)
    schema = "query_id long, id long, grp long, bonus double, score double"
    few = q.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:

        def scan(batches):
            if not few.num_rows:
                return
            for b in batches:
                for at in range(0, b.num_rows, ROW_BLOCK):
                    yield from _block_best(few, pa.Table.from_batches([b.slice(at, ROW_BLOCK)]), *args).to_batches()

        found = x.mapInArrow(scan, schema)
    else:
        n_rows, tasks = x.count(), 2 * rows.sparkSession.sparkContext.defaultParallelism
        nq = max(1, -(-q.count() // (QUERY_BLOCK * QUERY_BLOCKS)))
        nx = max(1, -(-n_rows // (ROW_BLOCK * ROW_BLOCKS)), min(-(-tasks // nq), -(-4 * n_rows // ROW_BLOCK)))  # of few blocks, as many as there are tasks
        at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = q.select("*", at(nq).alias("a"), every(nx).alias("b"))
        x = x.select("*", every(nq).alias("a"), at(nx).alias("b"))
        empty = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("grp", pa.int64()), ("bonus", pa.float64()), ("score", pa.float64())]).empty_table()
        found = q.groupBy("a", "b").cogroup(x.groupBy("a", "b")).applyInArrow(lambda l, r: _block_best(l, r, *args) if l.num_rows and r.num_rows else empty, schema)  # noqa: E741
    rank = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round("score", 6) + F.col("bonus")))
    keys = ["query_id", "grp"] if group is not None else ["query_id"]
    best = top(found.withColumn("_rank", rank), keys, k, F.desc("_rank"), F.col("id"))
    return best.select(*keys, "id", "score")


def of_key(queries: DataFrame, rows: DataFrame, key: str, block: int = 1 << 10) -> DataFrame:
    """Queries (query_id, key), each with all rows (id, key) of its key. A key may have any number of rows: they are dealt in blocks, and a query meets each."""
    n = max(1, -(-rows.count() // block))
    q = queries.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return q.join(rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), [key, "_b"]).drop("_b")


def expand(hits: DataFrame, index: DataFrame, top_n: int = 5, per: int = 3, hub: int = 50, decay: float = 0.4) -> DataFrame:
    """Hits (query_id, rank, path, symbol, score) and the graph neighbours (files) of the best of them; hubs are not expanded."""
    c = hits.filter((F.col("rank") <= top_n) & F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    n = c.select("query_id", "rank", "symbol", "score").join(index.select(F.col("key").alias("symbol"), F.col("path").alias("file")).distinct(), "symbol")
    w = W.partitionBy("query_id", "rank")
    n = n.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("file"))).filter((F.col("_n") <= hub) & (F.col("_i") <= per))
    n = n.join(hits.select("query_id", F.col("path").alias("file")).distinct(), ["query_id", "file"], "left_anti")
    first = n.groupBy("query_id", "file").agg(F.min(F.struct("rank", "score")).alias("x"))
    new = first.select("query_id", F.col("x.rank").alias("rank"), F.col("file").alias("path"), (F.col("x.score") * decay).alias("score"), F.lit("neighbour").alias("origin"))
    return hits.select("query_id", "rank", "path", "score", F.lit("hit").alias("origin")).unionByName(new)


def setwise(hits: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): positions that a model's answer (a JSON array) names come first, in its order; the rest follow."""
    a = responses.select("query_id", F.posexplode(F.array_distinct(F.coalesce(F.from_json("response", "array<string>"), F.array().cast("array<string>")))).alias("sel", "p"))
    a = a.select("query_id", "sel", F.expr("try_cast(p AS int)").alias("rank")).filter("rank IS NOT NULL")
    h = hits.join(a, ["query_id", "rank"], "left").select("query_id", "id", F.coalesce("sel", F.col("rank") + 1_000_000).alias("_o"))
    return h.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_o"))).filter(F.col("rank") <= k).select("query_id", "id", "rank")


def mmr(rows: DataFrame, query: str = "query_id", lam: float = 0.7) -> DataFrame:
    """(query, id, pick) of candidates (query, id, relevance, text): greedy maximal marginal relevance, per query, over its candidate set.

    The greedy choice is sequential; a candidate set is what a search returned, so it fits one task.
    """
    import pandas as pd

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["relevance", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        words = [set(t.lower().split()) for t in d.text.fillna("")]

        def sim(a: int, b: int) -> float:
            x, y = words[a], words[b]
            return len(x & y) / len(x | y) if x and y else 0.0

        order, left, near = [0], list(range(1, len(d))), {}
        near = {i: sim(i, 0) for i in left}
        while left:
            best = max(left, key=lambda i: (lam * d.relevance[i] - (1 - lam) * near[i], -i))
            order.append(best)
            left.remove(best)
            for i in left:
                near[i] = max(near[i], sim(i, best))
        return pd.DataFrame({query: d[query].iloc[order].to_numpy(), "id": d["id"].iloc[order].to_numpy(), "pick": range(1, len(order) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, id {kinds['id']}, pick int")
