from pyspark.sql import functions as F

from spanloom.llm import urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[h:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:h]), path


def verdict(h, p, rules):
    fit = [(len(rh + rp), len(rh), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return max(fit)[2:] if fit else (None, None)


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/",
    "http://x.com/fr/", "http://com/de/a", "HTTP://WWW.É.com/de", "http://x.org?q=/a", "http://x.org#f/", "a://b://c/d", "http://h.net/p/", "http://www.h.net/p//?u", "http://h.net/p/q\nr?s", "http://h.net/" + "long/" * 200_000 + "?x",
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://h.net/p"), (14, "http://h.net/p/")], "page_id long, url string")
    names = spark.createDataFrame([("h.net/p",), (None,), ("h.net/p",), ("other.net/",)], "name string")
    for blocks in (1, 1 << 16):  # one block: nearly all URLs pass the filter, and the join decides
        rows = urls.judge(pages, urls.RULES, names, "name", blocks=blocks).collect()
        assert len(rows) == len(URLS) + 2
        for r in rows:
            u = "http://h.net/p" if r.page_id is None else URLS[r.page_id]
            h, p = plain(u)
            rule, v = verdict(h, p, urls.RULES)
            assert (r.host, r.path, r.rule) == (h, p, rule), u
            hit = h.removeprefix("www.") == "h.net" and p.rstrip("/") == "/p"
            assert r.listed == hit and r.verdict == (v or ("block" if hit else "allow"))


def test_filter_has_no_false_negatives(spark):
    names = spark.range(3000).select(F.concat(F.lit("h"), F.col("id")).alias("name"))
    probe = spark.range(6000).select(F.concat(F.lit("h"), F.col("id")).alias("k"), F.lit(1).alias("w0"), F.lit(2).alias("block"), F.lit(3).alias("l_block"), F.lit(4).alias("l_key"))
    got = urls.listed(probe, "k", names, "name", blocks=64)
    assert got.columns == [*probe.columns, "listed"] and got.filter("w0 = 1 AND block = 2 AND l_key = 4").count() == 6000
    assert got.filter("listed").count() == 3000 and got.count() == 6000
    assert urls.bloom(names, "name", 64).count() == 64


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.page_verdicts(pages).collect() == []


def test_input_has_the_columns_of_the_result(spark):
    rows = spark.createDataFrame([(1, "a", True, "x", "y", 5), (2, "b", None, "x", "y", 6)], "id long, k string, listed boolean, l_row string, l_key string, l_at int")
    got = urls.listed(rows, "k", spark.createDataFrame([("b",)], "name string"), "name", blocks=4)
    assert sorted(got.columns) == sorted(rows.columns)
    assert sorted((r.id, r.listed, r.l_row, r.l_key, r.l_at) for r in got.collect()) == [(1, False, "x", "y", 5), (2, True, "x", "y", 6)]
    other = urls.listed(rows, "k", spark.createDataFrame([("a",)], "name string"), "name", blocks=4, flag="bad")
    assert sorted((r.id, r.listed, r.bad) for r in other.collect()) == [(1, True, True), (2, None, False)]


def test_urls_that_repeat_are_listed(spark):
    urls_of = ["http://a.net/x", "http://www.a.net/x/", "http://b.net/x", "http://spam-farm.net/q"]
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
    assert {r.page_id: (r.listed, r.verdict) for r in urls.page_verdicts(pages).collect()} == {0: (True, "block"), 1: (True, "block"), 2: (False, "allow"), 3: (True, "block")}
