import hashlib
import random
import re

from spanloom.llm import private


def check_digit(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    out = []
    for kind, pattern in private.BASE.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and check_digit(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "r", "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, span string, start int")


def compare_base(spark, texts):
    got = {}
    for r in private.base_spans(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect():
        got.setdefault(r.row, set()).add((r.kind, r.start, r.end))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == set(base(t)), t[:100]


def test_base_equals_the_rules_on_odd_strings(spark):
    rnd = random.Random(1)
    pick = lambda letters, n: "".join(rnd.choices(letters, k=rnd.randrange(n)))
    texts = [pick("ab.@@-%_ 1é\U0001f600", 40) for _ in range(1500)] + [pick("12.5 .-0", 40) for _ in range(1000)] + [pick("123456789- ", 50) for _ in range(500)] + [pick("+1 (2)-.x", 30) for _ in range(800)]
    compare_base(spark, [*texts, "", "a@b.c%d@e.f", "a@b.c..x@y.zz.", "1.2.3.4.5.6.7.8 001.002.003.0000255", "+12345678\n9", "a@b..c d@e.f-"])


def test_very_long_texts(spark):
    shapes = lambda n: ["1" * n, "1 " * n, "1." * n, "a" * n + "@" + "b." * n + "c", "+" + "1-" * n + "1", "x.34@mail.example.com " * (n // 10)]
    compare_base(spark, shapes(3000))  # the plain rules take quadratic time
    got = {}
    for r in private.base_spans(spark.createDataFrame(list(enumerate(shapes(300_000))), "row long, text string")).collect():
        got.setdefault(r.row, []).append((r.kind, r.end - r.start))
    assert sorted(got) == [2, 3, 5] and set(got[2]) == {("ip", 7)} and len(got[2]) == 75_000
    assert got[3] == [("email", 900_002)] and got[5] == [("email", 21)] * 30_000


def corpus():
    rnd = random.Random(3)
    words = lambda: " ".join(rnd.choices(["the", "of", "on", "we", "and"], k=6))

    def card():
        d = "".join(rnd.choices("0123456789", k=15))
        return next(d + c for c in "0123456789" if check_digit(d + c))

    phone = lambda: f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}"
    texts = [f"{words()} {x()} {words()}" for _ in range(150) for x in (card, phone)]
    texts += [f"{words()} {rnd.randrange(10**15, 10**16)} {words()} version 2.{rnd.randrange(9)}.1" for _ in range(150)]
    texts += [t for t in (f"{words()} {rnd.randrange(10**11)} {words()}" for _ in range(100))]
    return texts, [f"{words()} {a} {b} {words()}" for a, b in [(phone(), card()) for _ in range(12)] + [(card(), card()) for _ in range(12)]]


def test_trees_add_what_ran_into_a_neighbour(spark):
    texts, pairs = corpus()
    everything = [*texts, *pairs, None, ""]
    got = {r.doc_id: r for r in private.report(frame(spark, everything)).collect()}
    assert len(got) == len(everything)
    for i, t in enumerate(everything):
        want = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[0] == k for x in want) for k in private.KINDS]
        assert not want or set(listed(want).split(",")) <= set(got[i].spans.split(","))
    found = 0
    for i, t in enumerate(pairs, len(texts)):
        spans = {x for x in got[i].spans.split(",") if x}
        for kind, pattern in (("phone", r"\+1 \(\d+\) 555-\d{4}"), ("card", r"(?<!\d)\d{16}(?!\d)")):
            found += sum(f"{kind}:{m.start()}:{m.end()}" in spans for m in re.finditer(pattern, t))
    assert found >= 44  # of 48
    wrong = [t for i, t in enumerate(texts) if not base(t) and got[i].spans and not any(check_digit(d) for d in re.findall(r"\d{13,19}", t))]
    assert wrong == []


def test_redact_and_no_data(spark):
    df = spark.createDataFrame([(1, "Mail a.b@c.de or 1.2.3.4, now.", "k"), (2, None, None), (3, "é x@y.zz", "k")], "doc_id long, text string, kind string")
    got = {r.doc_id: (r.text, r.kind) for r in private.redact(df).collect()}
    assert got == {1: ("Mail [email] or [ip], now.", "k"), 2: (None, None), 3: ("é [email]", "k")}
    assert private.report(df.limit(0)).collect() == []
    repeated = private.report(df.union(df)).collect()
    assert sorted(r.doc_id for r in repeated) == [1, 1, 2, 2, 3, 3] and [r.spans for r in repeated if r.doc_id == 3] == ["email:2:8"] * 2
