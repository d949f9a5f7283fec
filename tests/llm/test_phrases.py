import random

import duckdb
import pytest

from spanloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, word string, part int, n int"


def against_sql(spark, rows, **options):
    df = spark.createDataFrame([(i, t, g, "p", "w", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, phrases.collocations(df, **options).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(phrases.COLLOCATIONS_SQL).fetchall())
    return got


def odd_rows(seed, n=300):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "straße", "İstanbul", "x y", "a", "b", "c", "the", "'s", "\U0001f600"]
    gaps = [" "] * 8 + ["\t", "  ", ", ", ".", "\r\n", "\x0b", ";", "!?"]
    text = lambda k: "".join(w + g for w, g in zip(rnd.choices(words, [4, 4, 3, 2, 1, 1, 5, 5, 3, 9, 2, 1], k=k), rnd.choices(gaps, k=k), strict=True))
    return [(text(rnd.randrange(60)), rnd.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_and_languages(spark, monkeypatch, small):
    if small:  # many slices, parts and hot pairs
        for name, value in (("SLICE_BYTES", 300), ("PART", 50), ("HOT", 500), ("SALTS", 3), ("FEW", 4), ("FREQUENT", 1000)):
            monkeypatch.setattr(phrases, name, value)
    rows = odd_rows(1)
    got = against_sql(spark, [*rows, *rows[:50], (None, "en"), ("", None), (" \t.\n", "en"), (None, None)])
    assert {r[0] for r in got} == {"", "de", "en", "und"}


def test_a_hot_pair_and_a_very_long_text(spark):
    rnd = random.Random(4)
    long = " ".join(f"hot pair w{rnd.randrange(400)}" for _ in range(60_000))
    got = against_sql(spark, [(long, "en"), ("hot pair " * 5000, "en"), *odd_rows(5, 50)])
    assert any(r[2] == "hot pair" for r in got)


def test_ties_and_limits(spark):
    rows = [(f"l{i} r{i}. m{i} s{i} t{i}", "en") for i in range(700) for _ in range(10)]
    got = against_sql(spark, rows)
    assert len(got) == 1400 and [r[2] for r in got][:2] == ["l0 r0", "l1 r1"]
    assert against_sql(spark, []) == []


def test_partial_pairs_are_added_up(spark):
    """A pair below the least count in each of its parts."""
    texts = [f"hot pair z{i}" for i in range(12)] * 1 + ["hot pair"] * 2
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    f, totals = phrases.frequent(df)
    assert {(r.phrase, r.n) for r in f.collect()} == {("hot", 14), ("pair", 14), ("hot pair", 14)}
    assert [tuple(r) for r in totals.collect()] == [("en", 40)]


def test_longer_phrases(spark):
    df = spark.createDataFrame([("a b c d e", "en")] * 11 + [("a b c", "en")] * 3, "text string, lang string")
    got = {(r.phrase, r.a) for r in phrases.collocations(df, longest=5).collect()}
    assert got == {("a b c d e", 11)}
