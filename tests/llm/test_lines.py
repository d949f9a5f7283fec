from collections import defaultdict

from spanloom.llm import lines


def brute(docs, sites=3, least=5):
    where, first = defaultdict(set), {}
    for i, t, s in docs:
        for x in (t or "").split("\n"):
            if len(x.strip(" ")) >= least:
                where[x.strip(" ")] |= {s} - {None}
                first[x.strip(" ")] = min(first.get(x.strip(" "), (True, 0, 0)), (i is None, i or 0, t), key=lambda k: k[:2])
    bad = {x for x, s in where.items() if len(s) >= sites}
    out = []
    for i, t, _ in docs:
        if t is None:
            out.append((i, None))
            continue
        stays = lambda x, i=i, t=t: x not in bad or first[x][:2] == (i is None, i or 0) and first[x][2] == t
        out.append((i, "\n".join(x for x in t.split("\n") if stays(x.strip(" ")))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    body = lambda i: f"own words of document {i}, several of them so that it is long\nand another line of {i}"
    docs = [(i, f"{body(i)}\n boilerplate line \nshared by two sites\nabc", f"s{i % 5}") for i in range(60)]
    docs = [(i, t.replace("shared by two sites", "x" if i % 5 > 1 else "shared by two sites"), s) for i, t, s in docs]
    docs += [(100, None, "s1"), (101, "", "s2"), (102, "boilerplate line", "s3"), (103, "boilerplate line\n" + body(9), None), (None, body(7) + "\nboilerplate line", "s0"), (1, body(8) + "\nboilerplate line", "s0"), (1, body(8) + "\nboilerplate line", "s0")]
    docs += [(200 + i, "copied text of a copied document\nwith two lines", f"s{i % 5}") for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "9L n_chars", "1 h", "2 id", "3 l_key", "4 l_lines", "5 at", "6 first")
    got = lines.strip(d, sites=3, least_chars=5)
    assert got.columns == d.columns
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == brute(docs)
    assert any("boilerplate" not in (r.text or "boilerplate") for r in rows)
    assert all(r.n_chars in (9, len(r.text or "")) for r in rows)
    assert lines.strip(d.limit(0)).collect() == []
    first = next(r for r in rows if r.doc_id == 0)
    assert "boilerplate line" in first.text and sum("boilerplate line" in (r.text or "") for r in rows) == 1
    assert sum("copied text" in (r.text or "") for r in rows) == 1 and next(r for r in rows if r.doc_id == 102).text == ""


def test_very_long_text_of_repeated_lines(spark):
    long = "\n".join(["common"] * 30_000 + [f"own {i}" for i in range(30_000)])
    docs = [(i, "common\nx", f"s{i}") for i in range(12)] + [(100, long, "s1"), (101, long, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(((r.doc_id, r.text) for r in lines.strip(d, sites=10).collect()), key=str) == brute(docs, sites=10, least=1)


def test_repeated_and_null_ids(spark):
    docs = [(None, f"shared\nown {i}", f"s{i}") for i in range(40)] + [(7, "shared\nseven", "s1"), (7, "shared\nseven", "s1")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(((r.doc_id, r.text) for r in lines.strip(d, sites=10).collect()), key=str) == brute(docs, sites=10, least=1)


def test_many_sites_near_and_far(spark):
    docs = [(i * 1000 + j, f"line seen on {n} sites\nown {i} {j} text that is much longer than the line above it", f"site{j}") for i, n in enumerate((5, 98, 99, 100, 101, 102, 300)) for j in range(n)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {(r.doc_id, r.text) for r in lines.strip(d, sites=100, least_chars=5).collect()}
    assert got == set(brute(docs, sites=100))
