import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import neardup
from spanloom.runtime import BATCH, TEXT_BATCH, write_once


def shingles(t):
    w = neardup._WORD.findall((t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(texts):
    """The class of every text, by comparing all pairs."""
    s, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (texts[a] or "") == (texts[b] or "") or s[a] and s[b] and similarity(s[a], s[b]) >= 0.8:
            root[find(b)] = find(a)
    return [find(i) for i in range(len(texts))]


def partition(labels):
    by = {}
    for i, x in enumerate(labels):
        by.setdefault(x, set()).add(i)
    return {frozenset(v) for v in by.values()}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = [None, "", "", " ,;! ", "one two", "One, two!", "a b c d e", "A b c d e.", "the " * 40, "the " * 41, "the " * 80]
    for size, copies, edits in ((60, 40, 1), (200, 60, 6), (300, 150, 9), (30, 20, 1), (3000, 6, 60)):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(size)] = word()
            texts.append(" ".join(w))
    chain = [word() for _ in range(150)]
    for _ in range(30):  # neighbours are similar, ends are not
        texts.append(" ".join(chain))
        for _ in range(4):
            chain[r.randrange(150)] = word()
    return texts + [" ".join(word() for _ in range(80)) for _ in range(100)] + ["copied " * 3 + "text of some words"] * 50


@pytest.mark.parametrize("block", [2048, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 node", "2 root", "'x' id").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.classes(d).collect()}
    want = brute(texts)
    assert partition([got[i] for i in range(len(texts))]) == partition(want)
    assert all(v == min(k for k in got if got[k] == v) for v in set(got.values()))
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {min(c) for c in partition(want)} and kept.count() == len(partition(want))


def test_signatures_estimate_weighted_similarity():
    r = random.Random(1)
    base = [str(r.random()) for _ in range(400)]
    for change in (5, 20, 60):
        other = list(base)
        for i in r.sample(range(400), change):
            other[i] = str(r.random())
        texts = [" ".join(base), " ".join(other), " ".join(base * 2)]
        sig = neardup.darts(neardup.regions(*neardup.shingles(texts)), 3, k=4000)
        s = [shingles(t) for t in texts]
        for a, b in ((0, 1), (0, 2)):
            assert (sig[a] == sig[b]).mean() == pytest.approx(similarity(s[a], s[b]), abs=0.04)


def test_real_weights():
    g = np.random.default_rng(4)
    element = neardup.mix(np.arange(60, dtype=np.uint64))
    a, b = g.uniform(0.1, 40, 60), g.uniform(0.1, 40, 60)
    b[:40] = a[:40] * g.uniform(0.9, 1.1, 40)
    areas = neardup.regions(np.repeat([0, 1], 60), np.tile(element, 2), np.concatenate([a, b]))
    sig = neardup.darts(areas, 2, k=4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    one = neardup.regions(np.zeros(1, np.int64), element[:1], np.array([1e6]))
    assert len(one[0]) == 21 and (one[2] + one[3])[-1] >= 1e6 > one[2][-1]


def test_stars_are_components():
    chain = np.arange(5000)
    u, v = neardup.stars(np.random.default_rng(0).permutation(4999) + 1, np.zeros(4999, np.int64))
    assert sorted(u) == list(range(1, 5000)) and set(v) == {0}
    u, v = neardup.stars(chain[1:], chain[:-1])
    assert sorted(u) == list(range(1, 5000)) and set(v) == {0}


def test_near_copies_that_are_similar_are_found(spark):
    """Of pairs of 0.8 to 0.82, one in 200 may share no band: nearly all are found."""
    r, texts, pairs = random.Random(9), [], 0
    for i in range(300):
        base = [f"w{i}x{r.randrange(10**9)}" for _ in range(200)]
        other = list(base)
        for at in r.sample(range(5, 195), 4) + [199]:
            other[at] = f"o{i}x{r.randrange(10**9)}"
        if similarity(shingles(" ".join(base)), shingles(" ".join(other))) >= 0.8:
            texts += [" ".join(base), " ".join(other)]
            pairs += 1
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert pairs > 30 and got.filter("class_size = 2").count() >= 2 * pairs - 4


def test_signature_does_not_depend_on_neighbours():
    texts = corpus()[4:40]
    all_ = neardup.darts(neardup.regions(*neardup.shingles(texts)), len(texts))
    for i in (0, 3, 20):
        assert (neardup.darts(neardup.regions(*neardup.shingles([texts[i]])), 1)[0] == all_[i]).all()
    assert len(np.unique(neardup.bands(all_)[0])) == neardup.BANDS


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).collect() == []
    spread = neardup.components(spark.createDataFrame(pairs, "a long, b long").repartition(40)).collect()
    assert {x.node: x.root for x in spread} == got


def test_ids_and_empty(spark):
    d = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "X y, z"), (5, "X y, z"), (1, "q"), (1, "r"), (None, None)], "doc_id long, text string")
    got = sorted(neardup.classes(d).collect(), key=str)
    assert sorted((r.class_id or -1, r.class_size) for r in got) == [(-1, 1), (1, 1), (1, 1), (5, 4), (5, 4), (5, 4), (5, 4)]
    assert sorted(r.text or "" for r in neardup.keep_one(d).collect()) == ["", "X y, z", "q", "r"]
    assert neardup.classes(d.limit(0)).collect() == [] and neardup.keep_one(d.limit(0)).collect() == []


def test_a_task_has_one_python_worker_and_small_batches(spark, monkeypatch):
    """A stage with two steps in Python holds two workers a core, which are kept and grow from then on."""
    plans, limits, write = [], {}, neardup.write_once

    def watched(df, tag="t", *args):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        limits[tag] = args
        return write(df, tag, *args)

    monkeypatch.setattr(neardup, "write_once", watched)
    d = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    assert neardup.node_classes(d).count()
    assert {"dartsig", "cells", "star", "comps"} <= limits.keys()
    for tag, plan in plans:
        assert len(re.findall("MapInArrow", plan.split("Initial Plan")[0])) <= 1, tag
    assert limits["cells"] == (TEXT_BATCH,)


def test_text_batches_are_bounded(spark):
    before = spark.conf.get(BATCH)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(9000).repartition(1).selectExpr("repeat('abcdefgh', 256) t").mapInArrow(run, "n long")
    assert max(r.n for r in write_once(rows).collect()) > 2 * TEXT_BATCH
    sizes = [r.n for r in write_once(rows, "t", TEXT_BATCH).collect()]
    assert max(sizes) <= TEXT_BATCH and sum(sizes) > 9000 * 2048
    assert spark.conf.get(BATCH) == before
