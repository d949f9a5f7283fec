import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(d.filter(langid.fold(F.col("doc_id")) != 2), per_lang=300)


def test_held_out_accuracy(spark, model):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter(langid.fold(F.col("doc_id")) == 2)
    r = langid.label(d, model).join(d, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("x"), "score").agg(F.avg("x"), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[3] > 2000 and r[0] > 0.97 and 0 <= r[1] <= r[2] <= 1


def test_viterbi_is_the_best_path(model):
    m = langid.Labeller(model, penalty=6.0)
    texts = [["the", "der"], ["of", "que", "los", "ist", "der", "and", "the"], ["une", "est"], ["x"]]
    got = m.labels(texts)
    for words, lab in zip(texts, got, strict=True):
        s = np.array([m.scores[m.known[w]] for w in words], float)
        cost = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 6.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(map(cost, itertools.product(range(s.shape[1]), repeat=len(words))))
        assert cost(lab.tolist()) == pytest.approx(best, abs=1e-3)


def test_mixed_text_and_edges(spark, model):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 400")
    en, de = (d.filter(F.col("lang") == x).orderBy("doc_id").first().text[:300] for x in ("en", "de"))
    texts = [None, "", "123 !!", en + "\n" + de, "日本語", en, en, "é"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, de, "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in langid.label(rows, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].spans == [] and got[0].score == 0
    assert {s.lang for s in got[3].spans} >= {"en", "de"} and 0.3 < got[3].score < 0.8
    for i in (3, 5):
        for s in got[i].spans:
            t = texts[i][s.start : s.end]
            assert t[0].isalpha() and t[-1].isalpha()
    assert got[4].lang_pred in model["langs"] and got[None].lang_pred == "de" and got[5].lang_pred == "en"


def test_script_narrows(spark):
    rows = spark.createDataFrame([("привет мир это слова", "ru"), ("hello world these are words", "en"), ("слова и мир", "ru"), ("words and world", "en")], "text string, lang string")
    m = langid.fit(rows)
    assert langid.script("мир") == "cyrillic" and langid.script("ĉ") == "latin" and langid.script("漢") == "han"
    got = langid.Labeller(m)(["незнакомое zzz zzz zzz zzz"])[0]
    assert [s["lang"] for s in got[2]] == ["ru", "en"]


def test_no_training_rows(spark):
    d = spark.createDataFrame([(1, "text", None, "x")], "doc_id long, text string, lang string, score string")
    r = langid.predict(d).collect()
    assert [(x.lang_pred, x.score) for x in r] == [("und", 0.0)] and langid.predict(d.limit(0)).collect() == []


def test_counts_label_and_score_by_hand(spark):
    learned = [("ana banana ana", "aa"), ("zug zog zug", "zz"), ("ana zug", "zz"), (None, "aa"), ("lost", None)]
    m = langid.fit(spark.createDataFrame(learned, "text string, lang string"))
    c = {x: {} for x in m["langs"]}
    for t, lang in learned:
        for w in (t or "").split() if lang else ():
            for g in langid.grams(w):
                c[lang][g] = c[lang].get(g, 0) + 1
    features = set(c["aa"]) | set(c["zz"])
    assert set(m["row"]) == features
    total = {x: sum(c[x].values()) for x in c}
    p = lambda g, x: np.log((c[x].get(g, 0) + 0.5) / (total[x] + 0.5 * len(features)))
    for g, i in m["row"].items():
        held = m["unseen"].copy()
        part = slice(m["starts"][i], m["starts"][i + 1])
        held[m["lang"][part]] += m["more"][part]
        assert held.tolist() == pytest.approx([p(g, x) for x in m["langs"]], rel=1e-5)
    words = ["ana", "banana", "zug", "ana", "zog", "zog", "zug", "zug"]
    score = lambda w, x: sum(p(g, x) for g in langid.grams(w))
    cost = lambda path: sum(score(w, x) for w, x in zip(words, path, strict=True)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    path = max(itertools.product(m["langs"], repeat=len(words)), key=cost)
    letters = {x: sum(len(w) for w, y in zip(words, path, strict=True) if y == x) for x in m["langs"]}
    lang, share, spans = langid.Labeller(m, penalty=2.0)([" ".join(words)])[0]
    assert lang == max(letters, key=letters.get) and share == pytest.approx(max(letters.values()) / sum(letters.values()))
    assert [s["lang"] for s in spans] == [k for k, _ in itertools.groupby(path)]


def test_no_language_is_dropped_and_copies_do_not_crowd_out(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 3
    rows = [(f"{word(i)} {word(i)}", f"l{i:03}") for i in range(300)] + [("copied copied", "l000")] * 3000 + [(f"other{word(i)}", "l000") for i in range(20)]
    m = langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_lang=10)
    assert len(m["langs"]) == 300
    got = langid.Labeller(m)([f"{word(i)} {word(i)} {word(i)}" for i in range(1, 300)])
    assert [g[0] for g in got] == m["langs"][1:]
    assert len(m["unseen"]) == 300 and len(m["more"]) < 3 * len(m["row"]) and sum(g.startswith("=_other") for g in m["row"]) > 2


def test_very_long_text(spark, model):
    d = spark.createDataFrame([(1, "der die und das ist nicht " * 60_000)], "doc_id long, text string")
    assert langid.label(d, model).first().lang_pred == "de"
