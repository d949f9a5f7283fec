import math
import re
from collections import defaultdict

import pytest

from spanloom.llm import mixing


def water(sizes):
    """Targets by the plain rule: share, cap, share again what is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t
        capped |= set(over)


def check(docs, rows, near=None):
    sizes, taken = defaultdict(int), defaultdict(int)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs]
    for d, n in zip(docs, size, strict=True):
        sizes[d[2]] += n
    want = water(sizes)
    source = {d[0]: d[2] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        most = max(n for d, n in zip(docs, size, strict=True) if d[2] == s)
        assert abs(taken[s] - t) <= most / 2 + 1e-6, s


def test_against_plain_rule(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in d.collect()]
    rows = mixing.allocate(d).collect()
    check(docs, rows)
    assert sorted(rows) == sorted(mixing.allocate(d.repartition(5)).collect())
    assert len({round(r.taken / r.size) for r in rows}) > 1


def test_edge_cases(spark):
    docs = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, " \t\n", "y"), (5, "w " * 5000, "z"), (6, "one", None), (7, "a b", "y")] + [(10 + i, "same words here", "hot") for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 m_size", "'k' m_source", "2 size")
    check(docs, mixing.allocate(d).collect())
    m = mixing.mix(d)
    assert m.columns == d.columns
    copies = {r.doc_id: r.copies for r in mixing.allocate(d).collect()}
    got = defaultdict(int)
    for r in m.collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == dict(got)
    twice = spark.createDataFrame([(None, "t u", "x"), (None, "t u", "x"), (1, "t u", "x")], "doc_id long, text string, source string")
    assert mixing.allocate(twice).count() == 3
    assert mixing.allocate(d.limit(0)).collect() == [] and mixing.mix(d.limit(0)).collect() == []


def test_repeated_rows_are_taken_one_by_one(spark):
    docs = [(1, "five words in every row", "hot")] * 4000 + [(2 + i, "another few words " * (i % 7 + 1), "hot") for i in range(400)] + [(9000 + i, "w " * 30, f"s{i % 5}") for i in range(900)] + [(None, None, None)] * 3
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, source string, n int").repartition(7)
    rows = mixing.allocate(d).collect()
    size = lambda t: len((t or "").split())
    source = {r[0]: r[2] for r in docs}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r[2]] += size(r[1])
    for r in rows:
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs)
    for s, t in water(sizes).items():
        assert abs(taken[s] - t) <= max(size(r[1]) for r in docs if r[2] == s) / 2 + 1e-6, s
    assert sorted(rows, key=str) == sorted(mixing.allocate(d.repartition(3)).collect(), key=str)
    assert len({r.copies for r in rows if r.doc_id == 1}) == 2
    mixed = mixing.mix(d).collect()
    assert sum(size(r.text) for r in mixed) == sum(taken.values()) and len({r.n for r in mixed if r.doc_id == 1}) == sum(r.copies > 0 for r in rows if r.doc_id == 1)


def test_inclusion_and_pareto_order(spark):
    """Of a source, those with the smallest odds ratios are taken, until the words wanted are reached."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, sized, plan, cut = mixing._plan(d, 7, 3, (1, 2, 3), ("doc_id", "text", "source"))
    p = {r.m_source: r for r in plan.collect()}
    by = defaultdict(list)
    for r in sized.collect():
        s = p[r.m_source]
        e = min(max(s.m_f * (1 + s.m_slope * (math.log1p(r.m_size) - s.m_mean)), 0), 3)
        by[r.m_source].append((r.m_id, r.m_size, math.floor(e), e - math.floor(e), r.m_u))
    want = {}
    for s, rows in by.items():
        assert sum(n * (w + q) for _, n, w, q, _ in rows) == pytest.approx(p[s].m_target)
        left = p[s].m_target - sum(n * w for _, n, w, _, _ in rows)
        for i, n, w, q, u in sorted(rows, key=lambda r: (r[4] / (1 - r[4])) * ((1 - r[3]) / r[3]) if r[3] and r[1] else math.inf):
            want[i] = w + (q > 0 and n > 0 and left >= n / 2)
            left -= n if want[i] > w else left + n
    assert {r.doc_id: r.copies for r in mixing.allocate(d).collect()} == want
