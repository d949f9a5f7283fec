"""Quality classifier: an interpolated modified Kneser-Ney model of character 4-grams, trained on trusted text.

Texts are words joined by single spaces, digits folded, a word equal to the one before it (with its space) replaced by one symbol; so
repetition, foreign separators and odd casing all become rare 4-grams. Words are compared before digits are folded: different numbers repeat
nothing. A text is judged with the probability of an unknown symbol for each repeat that follows a repeat: a run gains nothing from runs in trusted texts.

1. Texts are packed once: a row per slice of about 16 MB holds ids, the normalised texts (compressed) and the distinct 4-grams.
2. The slices' trusted texts give 4-gram counts, which are summed by 4-gram. Continuation counts of lower orders are aggregations of that table; all
   orders are one table of n-grams, whose counts of counts (a row per order) give the discounts.
3. A table of facts, sharded by n-gram and context, holds what each n-gram has of its own and what each context leaves to the order below.
   The 4-grams that occur in any text look up their tails and contexts there, once per distinct 4-gram, in one join.
4. (slice, 4-gram) pairs are joined with the log probabilities and meet their slice again, which gives each text's perplexity.
5. Texts fall into two folds by hash, and the tables hold, beside the model of all trusted texts, one for each fold that leaves its texts out. A trusted
   text is judged by the model that leaves its fold out, any other text by the model of all: no text by one that was trained on it.
6. A language's threshold is a quantile of these perplexities of its trusted texts (from counts by steps of half a percent), averaged with
   that of all trusted texts, which weighs as much as ``PRIOR`` texts. Texts above it are rejected.

All counts cover all trusted text, thresholds all of their perplexities, and every text is scored whole.

Defined results: null and empty texts have no symbols, perplexity null and are kept (there is nothing to judge); a null language is a
language of its own; several trusted rows of an id count once; rows with equal ids share trust, and each gets its own
result; without trusted text every perplexity is 1 and nothing is rejected, nor if all trusted texts are in one fold, which leaves none to judge them by; a
text longer than a slice is a slice of its own, scored in steps of its texts; of code points beyond the first plane the last eleven bits
tell symbols apart; an empty table gives an empty result; other columns are kept by ``keep``, whatever their names.
"""

from __future__ import annotations

import bz2
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import text_slices
from spanloom.runtime import TEXT_BATCH, discard, spread, write_once

SLICE, STEP = 1 << 24, 1 << 21
ORDER = 4
QUANTILE = 0.995
#: Texts of all languages that a language's own threshold is weighed against.
PRIOR = 30
#: Parts of the trusted texts, each scored by a model of the others.
FOLDS = 2
MODELS = range(FOLDS + 1)
#: Steps of log perplexity, per unit, in which thresholds are found.
FINE = 200
START, SAME = "\x02\x02\x02", "\x01"
_DIGITS = str.maketrans("123456789", "000000000")


def normal(text: str) -> str:
    words = text.split()
    return " ".join([SAME if a == b else b for a, b in zip([None, *words[:-1]], words, strict=True)]).replace(" " + SAME, SAME).translate(_DIGITS) if words else ""


def folds(texts: list[str]) -> np.ndarray:
    """The fold of each text: equal texts share one."""
    return np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts), np.int64, len(texts))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 4-grams packed into 64 bits, index of each position's 4-gram, number of positions of each text)."""
    c = np.frombuffer((START + START.join(texts)).encode("utf-16-le", "surrogatepass"), dtype=np.uint16)  # code points over U+FFFF are two symbols
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(c) > int(size.sum()) + 3 * max(1, len(texts)):
        size = np.fromiter((len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts), np.int64, len(texts))
    end = np.cumsum(size + 3)
    inside = np.ones(len(c), bool)
    for k in range(3):
        inside[end - size - 3 + k] = False
    seen = np.zeros(1 << 16, np.int32)
    seen[c] = 1
    letters = np.flatnonzero(seen)
    seen[letters] = np.arange(len(letters))
    a = len(letters)
    if a * a <= 1 << 22:  # dense tables of pairs, then of pairs of pairs; arrays of positions hold 32 bits, and no more of them than needed
        pair = seen[c]
        pair = pair[:-1] * np.int32(a) + pair[1:]
        mark = np.zeros(a * a, np.int32)
        mark[pair] = 1
        pairs = np.flatnonzero(mark)
        mark[pairs] = np.arange(len(pairs))
        if len(pairs) ** 2 <= 1 << 24:
            pair = mark[pair]
            quad = (pair[:-2] * np.int32(len(pairs)) + pair[2:])[inside[3:]]  # the first three positions are a start's
            del pair
            where = np.zeros(len(pairs) ** 2, np.int32)
            where[quad] = 1
            quads = np.flatnonzero(where)
            where[quads] = np.arange(len(quads), dtype=np.int32)
            left, right = pairs[quads // max(1, len(pairs))], pairs[quads % max(1, len(pairs))]
            key = (letters[left // a] << 48) | (letters[left % a] << 32) | (letters[right // a] << 16) | letters[right % a]
            return key, where[quad], size
    at = np.flatnonzero(inside)
    key = c[at - 3].astype(np.int64)
    for k in (2, 1, 0):
        key = key << 16 | c[at - k]
    key, index = np.unique(key, return_inverse=True)
    return key, index, size


def _steps(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= STEP:
            yield held
            held, n = [], 0
    if held:
        yield held


def pack(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(slice, ids, langs, texts: compressed, grams) per slice of texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = itertools.count(TaskContext.get().partitionId() << 32)
        ids: list[pa.Array] = []
        langs: list[pa.Array] = []
        parts: list[bytes] = []
        grams = np.empty(0, np.int64)
        held = 0

        def row() -> pa.RecordBatch:
            one = lambda arrays: pa.ListArray.from_arrays([0, sum(map(len, arrays))], pa.concat_arrays(arrays))
            out = [pa.array([next(name)], pa.int64()), one(ids), one(langs), pa.array([parts], pa.list_(pa.binary())), pa.array([grams], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(out, names=["slice", "ids", "langs", "texts", "grams"])

        for b in text_slices(batches, "text", STEP):
            texts = [normal(t) for t in b.column("text").to_pylist()]
            ids.append(b.column("id"))
            langs.append(b.column("lang"))
            parts.append(bz2.compress("\n".join(texts).encode()))
            grams = np.union1d(grams, codes(texts)[0])
            held += sum(map(len, texts)) + 100 * len(texts)
            if held >= SLICE:
                yield row()
                ids, langs, parts, grams, held = [], [], [], np.empty(0, np.int64), 0
        if ids:
            yield row()

    return spread(rows).mapInArrow(run, f"slice long, ids array<{kind}>, langs array<string>, texts array<binary>, grams array<long>")


def _texts(parts: list[bytes]) -> Iterator[list[str]]:
    for p in parts:
        yield bz2.decompress(p).decode().split("\n")


def count_grams(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """(g, f0, f1, ...): counts of 4-grams over the trusted texts of the slices, by fold."""
    place = packed.select("slice", F.posexplode("ids").alias("at", "id")).join(trusted.select(F.col(trusted.columns[0]).alias("id")).distinct(), "id")
    place = place.groupBy("slice").agg(F.collect_list("at").alias("places"))  # bounded by a slice
    rows = packed.select("slice", "texts").join(place, "slice").select("texts", "places")
    names = [f"f{j}" for j in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts, places in zip(b.column("texts"), b.column("places").to_pylist(), strict=True):
                want, at, grams, counts = set(places), 0, [], []
                for texts in _texts(parts.as_py()):
                    mine = [t for i, t in enumerate(texts, at) if i in want]
                    at += len(texts)
                    if mine:
                        g, index, size = codes(mine)
                        grams.append(g)
                        counts.append(np.bincount(index * FOLDS + np.repeat(folds(mine), size), minlength=len(g) * FOLDS).reshape(-1, FOLDS))
                if grams and len(g := np.concatenate(grams)):
                    order = np.argsort(g, kind="stable")
                    key, first = np.unique(g[order], return_index=True)
                    total = np.add.reduceat(np.concatenate(counts)[order], first)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(total[:, j].astype(np.int64)) for j in range(FOLDS)]], names=["g", *names])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["g", *names])).groupBy("g").agg(*[F.sum(c).alias(c) for c in names])


def _tail(g: Column, order: int) -> Column:
    """The last ``order`` symbols of a packed n-gram."""
    return g if order == 4 else g.bitwiseAND(F.lit((1 << (16 * order)) - 1))


def _head(g: Column) -> Column:
    """All symbols but the last."""
    return F.shiftrightunsigned(g, 16)


def ngrams(counts: DataFrame) -> DataFrame:
    """(k, g, n_0, n_1, ...): the distinct n-grams of every order k with their counts by model; those of lower orders are the numbers of distinct
    symbols before them. Model j < FOLDS leaves fold j out, the last one has all."""
    every = sum((F.col(f"f{j}") for j in range(1, FOLDS)), F.col("f0"))
    at = counts.select(F.lit(ORDER).alias("k"), "g", *[(every - F.col(f"f{j}") if j < FOLDS else every).alias(f"n_{j}") for j in MODELS])
    out = at
    for k in range(ORDER - 1, 0, -1):
        at = at.groupBy(_tail(F.col("g"), k).alias("g")).agg(*[F.count_if(F.col(f"n_{j}") > 0).alias(f"n_{j}") for j in MODELS])
        at = at.select(F.lit(k).alias("k"), "g", *[f"n_{j}" for j in MODELS])
        out = out.unionByName(at)
    return out


def discounts(nodes: DataFrame) -> tuple[list[list[list[float]]], list[float | None], list[float]]:
    """What is one number per order and model: the three discounts [model][order - 1][i], and by model the probability of an unknown symbol
    (None without texts) and the total of single symbols. They come from counts of counts, a row per order."""
    n = lambda j: F.col(f"n_{j}")
    rows = nodes.groupBy("k").agg(*[x for j in MODELS for x in (F.sum(n(j)).alias(f"t_{j}"), F.count_if(n(j) > 0).alias(f"a_{j}"), *[F.count_if(n(j) == i).alias(f"c{i}_{j}") for i in (1, 2, 3, 4)])])
    by = {r["k"]: r for r in rows.collect()}
    less, unknown, totals = [], [], []
    for j in MODELS:
        less.append([])
        for k in range(1, ORDER + 1):
            c = [0, *(by[k][f"c{i}_{j}"] for i in (1, 2, 3, 4))] if k in by else [0] * 5
            y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
            less[-1].append([max(0.05, min(i - 0.05, i - (i + 1) * y * c[i + 1] / c[i])) if c[i] else 0.5 * i for i in (1, 2, 3)])
        total, kinds = (by[1][f"t_{j}"], by[1][f"a_{j}"]) if 1 in by else (0, 0)
        one, two = (by[1][f"c1_{j}"], by[1][f"c2_{j}"]) if 1 in by else (0, 0)
        d = less[-1][0]
        unknown.append((d[0] * one + d[1] * two + d[2] * (kinds - one - two)) / total / (kinds + 1) if total else None)
        totals.append(float(total))
    return less, unknown, totals


def facts(nodes: DataFrame, less: list[list[list[float]]], totals: list[float]) -> DataFrame:
    """(slot, key, v_0, v_1, ...): in slot k - 1 what an n-gram of order k has of its own, in slot ORDER + k - 2 what a context of order k leaves to the
    order below. A model that has not seen the context has null."""
    by_order = lambda j, i: F.element_at(F.array(*[F.lit(float(d[i])) for d in less[j]]), F.col("k"))
    n = lambda j: F.col(f"n_{j}")
    sums = lambda j: [F.sum(n(j)).cast("double").alias(f"total_{j}"), F.count_if(n(j) == 1).alias(f"one_{j}"), F.count_if(n(j) == 2).alias(f"two_{j}"), F.count_if(n(j) > 2).alias(f"more_{j}")]
    ctx = nodes.filter("k > 1").groupBy("k", _head(F.col("g")).alias("ctx")).agg(*[x for j in MODELS for x in sums(j)])
    left = lambda j: (by_order(j, 0) * F.col(f"one_{j}") + by_order(j, 1) * F.col(f"two_{j}") + by_order(j, 2) * F.col(f"more_{j}")) / F.col(f"total_{j}")
    gamma = ctx.select((F.col("k") + ORDER - 2).alias("slot"), F.col("ctx").alias("key"), *[F.when(F.col(f"total_{j}") > 0, left(j)).alias(f"v_{j}") for j in MODELS])
    own = lambda j, total: F.when(total > 0, F.greatest(n(j) - F.when(n(j) == 1, by_order(j, 0)).when(n(j) == 2, by_order(j, 1)).otherwise(by_order(j, 2)), F.lit(0.0)) / total).alias(f"v_{j}")
    high = nodes.filter("k > 1").withColumn("ctx", _head(F.col("g"))).join(ctx.select("k", "ctx", *[f"total_{j}" for j in MODELS]), ["k", "ctx"])
    high = high.select((F.col("k") - 1).alias("slot"), F.col("g").alias("key"), *[own(j, F.col(f"total_{j}")) for j in MODELS])
    low = nodes.filter("k = 1").select((F.col("k") - 1).alias("slot"), F.col("g").alias("key"), *[own(j, F.lit(totals[j])) for j in MODELS])
    return gamma.unionByName(high).unionByName(low)


def log_probabilities(grams: DataFrame, table: DataFrame, unknown: list[float | None]) -> DataFrame:
    """(g, lp, h0, h1, ...) for distinct 4-grams, seen or not: of the model of all, and of those that leave a fold out (NaN without texts).

    A 4-gram looks up its own tails and their contexts, all in one join; what is not found adds nothing and leaves all to the order below.
    """
    g = F.col("g")
    slots = [(k - 1, _tail(g, k)) for k in range(1, ORDER + 1)] + [(ORDER + k - 2, _head(_tail(g, k))) for k in range(2, ORDER + 1)]
    asked = grams.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), key.alias("key")) for i, key in slots])).alias("x")).select("g", "x.slot", "x.key")
    found = asked.join(table, ["slot", "key"], "left").groupBy("g").agg(*[F.max(F.when(F.col("slot") == i, F.col(f"v_{j}"))).alias(f"v{i}_{j}") for j in MODELS for i, _ in slots])

    def p(j: int) -> Column:
        x = F.coalesce(f"v0_{j}", F.lit(0.0)) + F.lit(unknown[j] if unknown[j] is not None else 1.0)
        for k in range(2, ORDER + 1):
            x = F.coalesce(f"v{k - 1}_{j}", F.lit(0.0)) + F.coalesce(f"v{ORDER + k - 2}_{j}", F.lit(1.0)) * x
        return x

    held = [F.log(p(j)).cast("float").alias(f"h{j}") if unknown[j] is not None else F.lit(float("nan")).cast("float").alias(f"h{j}") for j in range(FOLDS)]
    return found.select("g", F.log(p(FOLDS)).alias("lp"), *held)


def _score(packed: DataFrame, scored: DataFrame, unknown: list[float | None]) -> DataFrame:
    """(id, lang, n_symbols, log_prob, judged, held) of every row: the log probability by the model of all, the same with repeats after repeats as
    unknown symbols, and that by the model that leaves the text's fold out."""
    floor = [math.log(p) if p else 0.0 for p in unknown]
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    names = [f"h{j}" for j in range(FOLDS)]
    pairs = packed.select("slice", F.explode("grams").alias("g")).join(scored, "g").select("slice", "g", "lp", *names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"id": pa.array([], left.column("ids").type.value_type), "lang": pa.array([], pa.string()), "n_symbols": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64()), "judged": pa.array([], pa.float64()), "held": pa.array([], pa.float64())})
        g = right.column("g").to_numpy()
        order = np.argsort(g)
        g, lp = g[order], right.column("lp").to_numpy()[order]
        h = np.stack([right.column(c).to_numpy()[order] for c in names])
        none = np.isnan(h).any(axis=1)
        h[none] = 0
        n, total, judged, held = [], [], [], []
        run_on = (g & 0xFFFFFFFF) == (ord(SAME) << 16 | ord(SAME))
        bound = np.where(run_on, np.minimum(lp, floor[-1]), lp)
        h[:, run_on] = np.minimum(h[:, run_on], np.array(floor[:-1], h.dtype)[:, None])
        for texts in _texts(left.column("texts")[0].as_py()):
            key, index, size = codes(texts)
            end, fold, at = np.cumsum(size), folds(texts), np.searchsorted(g, key)
            sums = lambda each, end=end, size=size: (s := np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)]))[end] - s[end - size]
            n.append(size)
            total.append(sums(lp[at][index]))
            judged.append(sums(bound[at][index]))
            held.append(np.where(none[fold], np.nan, sums(h[:, at][np.repeat(fold, size), index])))
        return pa.table({"id": left.column("ids")[0].values, "lang": left.column("langs")[0].values, "n_symbols": np.concatenate(n), "log_prob": np.concatenate(total), "judged": np.concatenate(judged), "held": pa.array(np.concatenate(held), from_pandas=True)})

    again = packed.sparkSession.read.schema(packed.schema).parquet(packed._spanloom_path)  # a cogroup takes no table that joins itself
    both = again.select("slice", "ids", "langs", "texts").groupBy("slice").cogroup(pairs.groupBy("slice"))
    return both.applyInArrow(run, f"id {kind}, lang string, n_symbols long, log_prob double, judged double, held double")


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, log_prob, judged, held, perplexity, judged_perplexity, held_perplexity), materialised. ``trusted``: ids of trusted texts, in the first column."""
    packed = write_once(pack(docs, id_col, text_col, lang_col), "lmslices", TEXT_BATCH)
    counts = write_once(count_grams(packed, trusted), "lmcounts", TEXT_BATCH)
    nodes = write_once(ngrams(counts), "lmngrams")
    less, unknown, totals = discounts(nodes)
    table = write_once(facts(nodes, less, totals), "lmfacts")
    grams = packed.select(F.explode("grams").alias("g")).distinct()
    scored = write_once(log_probabilities(grams, table, unknown), "lmlogp")
    for t in (counts, nodes, table):
        discard(t)
    s = _score(packed, scored, unknown)
    each = lambda c: F.when(F.col("n_symbols") > 0, F.exp(-F.col(c) / F.col("n_symbols")))
    out = write_once(s.select("*", each("log_prob").alias("perplexity"), each("judged").alias("judged_perplexity"), each("held").alias("held_perplexity")), "lmscores")
    discard(packed)
    discard(scored)
    return out


def thresholds(own: DataFrame, quantile: float, prior: float) -> tuple[DataFrame, float | None]:
    """((q_lang, threshold) of each language of the (lang, perplexity) rows, that of a language without rows).

    Perplexities are counted by steps of half a percent. A language's quantile is the upper end of the step that holds it; its logarithm is averaged with that
    of all rows, which weighs ``prior`` rows against the language's own.
    """
    step = own.groupBy(F.col("lang").alias("q_lang"), F.floor(F.log("perplexity") * FINE).alias("step")).agg(F.count("*").alias("n"))
    step = write_once(step, "lmsteps")  # a language has some thousand steps at most

    def at(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys)
        s = rows.withColumn("all", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("step")))
        return s.filter(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*keys, "all").agg(((F.min("step") + 1) / FINE).alias("log"))

    every = at(step.groupBy("step").agg(F.sum("n").alias("n")), []).first()
    if every is None:
        return step.select("q_lang", F.lit(None).cast("double").alias("threshold")).limit(0), None
    by = at(step, ["q_lang"])
    return by.select("q_lang", F.exp((F.col("all") * F.col("log") + prior * every["log"]) / (F.col("all") + prior)).alias("threshold")), math.exp(every["log"])


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, perplexity, threshold, keep) of every row; a trusted text's perplexity is that of the model without its fold."""
    s = perplexities(docs, trusted, id_col, text_col, lang_col)
    s = s.join(trusted.select(F.col(trusted.columns[0]).alias("id"), F.lit(True).alias("trusted")).distinct(), "id", "left")
    s = s.withColumn("perplexity", F.when(F.col("trusted"), F.coalesce("held_perplexity", "judged_perplexity")).otherwise(F.col("judged_perplexity")))
    by, every = thresholds(s.filter("n_symbols > 0 AND trusted AND held IS NOT NULL"), quantile, prior)
    r = s.join(by, F.col("lang").eqNullSafe(F.col("q_lang")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return r.select(F.col("id").alias(id_col), "lang", "n_symbols", "perplexity", "threshold", keep.alias("keep"))


def keep(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected. Rows that share an id are rejected if all of them are."""
    r = classify(docs, trusted, quantile, id_col=id_col, text_col=text_col, lang_col=lang_col)
    bad = r.groupBy(F.col(id_col).alias("q_id")).agg(F.max("keep").alias("k")).filter("NOT k")
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("q_id")), "left_anti")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids with quality 1 that are not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
