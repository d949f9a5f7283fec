import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality

SF = "/root/testdata/sf0.01"


class Plain:
    """Interpolated modified Kneser-Ney over strings, as published."""

    def __init__(self, texts, order=4):
        self.order = order
        c = {order: Counter()}
        for t in texts:
            s = "\x02" * 3 + t
            c[order].update(s[i - 3 : i + 1] for i in range(3, len(s)))
        for k in range(order - 1, 0, -1):
            c[k] = Counter(g[1:] for g in c[k + 1])
        self.c, self.d, self.ctx = c, {}, {}
        for k in c:
            n = Counter(c[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            self.d[k] = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
            self.ctx[k] = defaultdict(lambda: [0, 0, 0, 0, 0])
            for g, x in c[k].items():
                s = self.ctx[k][g[:-1]]
                s[0] += x
                s[min(x, 3)] += 1
                s[4] += 1

    def p(self, g):
        k = len(g)
        s = self.ctx[k].get(g[:-1])
        if s is None:
            return self.p(g[1:])
        d = self.d[k]
        gamma = sum(d[i] * s[i + 1] for i in range(3)) / s[0]
        below = self.p(g[1:]) if k > 1 else 1 / (s[4] + 1)
        x = self.c[k][g]
        return max(x - d[min(x, 3) - 1] if x else 0, 0) / s[0] + gamma * below

    def log_prob(self, t):
        s = "\x02" * 3 + t
        return sum(math.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s)))


def units(text):
    """The symbols of the model: code units of 16 bits."""
    return "".join(map(chr, np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)))


def test_against_plain_model(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    t = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    extra = spark.createDataFrame([(-5, "a very long text of many words 🙂 " * 100_000, "en"), (-1, "日本語 not seen 🙂 " * 3, "en"), (-2, None, "en"), (-3, "", None), (-4, "a a a a a a", None), (-4, "the of and", None)], "doc_id long, text string, lang string")
    docs = d.select("doc_id", "text", "lang").unionByName(extra)
    texts, ids = docs.collect(), {r.doc_id for r in t.collect()}
    assert len(ids) > 100
    plain = Plain([units(quality.normal(r.text or "")) for r in texts if r.doc_id in ids])
    got = {(r.id, r.n_symbols): r for r in quality.perplexities(docs, t).collect()}
    assert len(got) == len(texts)
    for r in texts[::9] + texts[-5:]:
        n = units(quality.normal(r.text or ""))
        x = got[r.doc_id, len(n)]
        assert x.log_prob == pytest.approx(plain.log_prob(n), rel=1e-6, abs=1e-6)
        assert (x.perplexity is None) == (not n)


def test_probabilities_sum_to_one():
    m = Plain(["abab cab", "bca bb", "cab"])
    symbols = [g for g in m.c[1]]
    assert sum(m.p("abc"[:3] + w) for w in symbols) + m.p("abc\x00") == pytest.approx(1)


def test_codes_agree_with_sorting():
    texts = ["", "abc", "", "x" * 50, "日本 é", "".join(map(chr, range(300, 9000))), "🙂🙃🙂 𠀀", ""]
    key, index, size = quality.codes(texts)
    want = []
    for t in texts:
        s = [2, 2, 2, *map(ord, units(t))]
        want += [sum(c << (16 * (3 - j)) for j, c in enumerate(s[i - 3 : i + 1])) for i in range(3, len(s))]
    assert key[index].astype(np.uint64).tolist() == want and size.tolist() == [len(units(t)) for t in texts]
    key, index, size = quality.codes([""])
    assert len(key) == len(index) == 0
    assert set(quality.codes(["\U0001f600" * 9])[0]) != set(quality.codes(["\U0001fe00" * 9])[0])  # no two texts are taken for one


def test_keeps_clean_rejects_junk(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    r = quality.classify(d, quality.trusted_ids(lab)).join(lab, "doc_id").groupBy("quality").agg({"*": "count"}).collect()
    kept = quality.keep(d, quality.trusted_ids(lab))
    assert kept.columns == d.columns
    k = {x.quality: x["count"] for x in kept.join(lab, "doc_id").groupBy("quality").count().collect()}
    n = {x.quality: x["count(1)"] for x in r}
    assert k[1] > 0.98 * n[1] and k.get(0, 0) < 0.1 * n[0]


def test_no_trusted_and_empty(spark):
    d = spark.createDataFrame([(1, "some text", "en", 1), (None, None, None, 2)], "doc_id long, text string, lang string, keep int")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.keep(d, none).count() == 2 and quality.keep(d.limit(0), none).collect() == []
    assert quality.keep(d, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")).count() == 2


def test_thresholds_are_quantiles(spark):
    d, lab = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    t = quality.trusted_ids(lab)
    r = quality.classify(d, t, quantile=0.9, prior=60).collect()
    ids = {x.doc_id for x in t.collect()}
    own = defaultdict(list)
    for x in r:
        if x.doc_id in ids:
            own[x.lang].append(x.perplexity)
    at = lambda v: (math.floor(math.log(sorted(v)[math.ceil(0.9 * len(v)) - 1]) * 200) + 1) / 200
    every = at(sum(own.values(), []))
    for x in r:
        n = len(own[x.lang])
        want = math.exp((n * at(own[x.lang]) + 60 * every) / (n + 60))
        assert x.threshold == pytest.approx(want, rel=1e-9) and x.keep == (x.perplexity <= x.threshold)
    assert len({x.threshold for x in r}) > 1


def test_trusted_texts_are_judged_by_models_without_them(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    t = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    texts, ids = {r.doc_id: quality.normal(r.text or "") for r in d.collect()}, {r.doc_id for r in t.collect()}
    fold = dict(zip(texts, quality.folds(list(texts.values())), strict=True))
    got = {r.doc_id: r.perplexity for r in quality.classify(d, t).collect()}
    for j in range(quality.FOLDS):
        plain = Plain([texts[i] for i in ids if fold[i] != j])
        for i in [i for i in sorted(ids) if fold[i] == j and texts[i]][:12]:
            t = "\x02" * 3 + texts[i]
            each = [plain.p("\0") if t[k - 1 : k + 1] == quality.SAME * 2 else plain.p(t[k - 3 : k + 1]) for k in range(3, len(t))]
            assert got[i] == pytest.approx(math.exp(-sum(map(math.log, each)) / len(each)), rel=1e-5)


def test_clean_texts_that_were_not_trained_on_stay(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    d, t = d.join(lab, "doc_id", "left_semi"), quality.trusted_ids(lab).withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 10)
    r = quality.classify(d, t.filter("part = 0").select("doc_id")).join(t.filter("part <> 0"), "doc_id").groupBy("keep").count().collect()
    n = {x.keep: x["count"] for x in r}
    assert n.get(False, 0) < 0.04 * sum(n.values())


def test_one_trusted_text_rejects_nothing(spark):
    d = spark.createDataFrame([(1, "some text", "en"), (2, "zq xk", "en")], "doc_id long, text string, lang string")
    assert quality.keep(d, spark.createDataFrame([(1,)], "doc_id long")).count() == 2


def test_runs_of_a_word_gain_nothing_from_trusted_runs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    t = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    extra = [(-i, f"some words {w * 40}", "xx") for i, w in enumerate(("der ", "oft ", "und "), 1)]
    r = {x.doc_id: x for x in quality.classify(d.unionByName(spark.createDataFrame(extra, d.schema)), t.union(spark.createDataFrame([(-1,)], "doc_id long"))).filter("doc_id < 0").collect()}
    assert not r[-2].keep and not r[-3].keep and r[-2].perplexity > 100


def test_different_numbers_are_no_repeats():
    assert quality.normal("a 12 13 14 14 b b") == f"a 00 00 00{quality.SAME} b{quality.SAME}"
    assert quality.normal("1 2 3") == "0 0 0"


def test_codes_of_a_step_hold_little_memory():
    import tracemalloc

    rnd = np.random.default_rng(3)
    texts = ["".join(map(chr, rnd.integers(97, 123, 1 << 12))) for _ in range(1 << 9)]
    tracemalloc.start()
    key, index, size = quality.codes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # 64-bit arrays of all positions held twice as much
    for some in (texts[:3], ["a", "", "b\U0001f600c"], [""], ["".join(map(chr, range(0x4E00, 0x4E00 + 3000)))]):
        key, index, size = quality.codes(some)
        want = []
        for t in some:
            c = [2, 2, 2, *np.frombuffer(t.encode("utf-16-le"), np.uint16).tolist()]
            want += [c[i - 3] << 48 | c[i - 2] << 32 | c[i - 1] << 16 | c[i] for i in range(3, len(c))]
        assert key[index].tolist() == want and key.tolist() == sorted(set(want))
        assert size.tolist() == [len(t.encode("utf-16-le")) // 2 for t in some]
