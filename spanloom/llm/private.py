"""Personal data by boosted trees over candidate spans; DataFrame functions only.

Rules of fixed form find base spans (e-mail, IP address, card, phone), which always stay. Generators of high recall propose further spans, which may overlap each other and
base spans: numbers of card length on their own or in groups, phones with bounded groups of digits, with and without a country code, quads of octets, bounded e-mails.
What a rule loses because its neighbours ran into it (a phone with a card behind it) is among them.

Gradient-boosted trees score candidates by format (length, digits, groups, check digit, octets) and context (the characters next to them, words before
and after them). They learn from the corpus itself: candidates that lie in a base span of their kind are known to be personal data, the others are taken for unlabelled
(digits near a candidate are no feature: they are why a rule fails, not a sign of what the candidate is). Equal feature
vectors are counted first and weigh as often as they occur; at most FIT_VECTORS distinct ones (by hash) are learned from, all candidates are scored. Two models learn from
one half of the vectors each (by hash of the span) and score the other half, so that no candidate is scored by what it taught. A generator's threshold is calibrated on the
scores of its known spans: all but a share LOSS of these pass, and none below LEAST passes; generators that have no known spans add none. Of accepted candidates that overlap each other the best stays; those that
overlap a base span of their kind are part of it.

Base rules are stated so that Java's matcher needs no recursion and no second look: a separator or dot that can't be inside a match is first replaced by another character of
one code point, runs of plain classes are then matched. That is equal to the rules as they are written in BASE, in linear time.

Positions come from the pieces between matches, summed by a window over one text's matches. Texts without a digit or an at sign take no part; of the others,
those that are equal are scanned once. Spans carry a few characters of context, texts don't travel with them.

Defined results: null text is empty and has no spans; spans are in code points, the end excluded; equal spans of a kind are one; rows that repeat an id are judged by
their texts (which are known by 128 bits of their hash); a text of any length is scanned whole; an empty table gives an empty result, a corpus without known spans adds none; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import write_once

KINDS = ("email", "ip", "card", "phone")
#: The rules as they are written (fixed values).
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same for a matcher that must not recurse: (what is replaced, by what, what is matched then).
PLAIN = {
    "email": (r"\.(?![A-Za-z0-9-])", "%", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"),
    "ip": ("", "", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "#", r"[0-9][0-9\x20-]++"),
    "phone": ("", "", BASE["phone"]),
}
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Generators of candidates: (kind, pattern).
GENERATORS = {
    "email_plain": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    "ip_quad": ("ip", rf"(?<![0-9]){OCTET}(?:\.{OCTET}){{3}}(?![0-9])"),
    "card_run": ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "card_groups": ("card", r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])"),
    "phone_plus": ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])"),
    "phone_nanp": ("phone", r"(?:\+[0-9]{1,3}[\x20.-]?)?+\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "phone_dashes": ("phone", r"(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
}
BEFORE, AFTER = 32, 16
#: Words that speak for or against a kind, looked for before and after a span.
CUES = {
    "mail": "mail|write|contact|schreib|courriel|correo",
    "net": "ip|host|server|addr|client|login",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay|konto",
    "phone": "phone|tel|call|fax|mobil|cell|anruf|appel|llam",
    "other": "version|licen[sc]e|release|isbn|issn|order|sku|token|hash|serial|build|page|section|chapter",
}
FIT_VECTORS, TREES, DEPTH, LOSS, LEAST = 20_000, 8, 3, 0.01, 0.5


def _found(texts: DataFrame, name: str, kind: str, text: Column, pattern: str) -> DataFrame:
    """(row, gen, kind, i, gap, before, after, span): matches of a pattern with the length of the piece before each and its context."""
    pieces, spans = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    t = texts.filter(text.rlike(pattern)).select("row", pieces.alias("p"), spans.alias("s"))
    item = F.transform("s", lambda s, i: F.struct(F.length(F.get("p", i)).alias("gap"), F.right(F.get("p", i), F.lit(BEFORE)).alias("before"), F.left(F.get("p", i + 1), F.lit(AFTER)).alias("after"), s.alias("span")))
    return t.select("row", F.lit(name).alias("gen"), F.lit(kind).alias("kind"), F.posexplode(item).alias("i", "x")).select("row", "gen", "kind", "i", "x.*")


def _placed(found: DataFrame) -> DataFrame:
    """With start and end in place of i and gap. A window holds one pattern's matches in one text."""
    w = Window.partitionBy("row", "gen").orderBy("i")
    end = F.sum((F.col("gap") + F.length("span")).cast("long")).over(w)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("span")).drop("i", "gap")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    d = F.split(F.reverse(digits), "")
    add = lambda s, x: s + x
    doubled = lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), doubled), F.lit(0), add) % 10 == 0


def _octets(span: Column) -> Column:
    """Whether all numbers between dots are at most 255."""
    return F.forall(F.split(span, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))


def _valid(kind: Column, span: Column) -> Column:
    n = F.length(_digits(span))
    return F.when(kind == "ip", _octets(span)).when(kind == "card", F.when(n.between(16, 19), luhn(_digits(span))).otherwise(False)).when(kind == "phone", n.between(8, 15)).otherwise(True)


def base_spans(texts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of (row, text): leftmost matches of the rules that hold as a whole."""
    text = F.col("text")
    parts = [_found(texts, k, k, F.regexp_replace(text, old, new) if old else text, pattern) for k, (old, new, pattern) in PLAIN.items()]
    p = _placed(reduce(DataFrame.unionByName, parts))
    # a mark stands where a character was that can't be part of a match: digits, dots and blanks of the span itself are as in the text
    return p.filter(_valid(F.col("kind"), F.col("span"))).select("row", "kind", "start", "end")


def candidates(texts: DataFrame) -> DataFrame:
    """(row, gen, kind, before, after, span, start, end) of all generators."""
    return _placed(reduce(DataFrame.unionByName, [_found(texts, g, kind, F.col("text"), pattern) for g, (kind, pattern) in GENERATORS.items()]))


def _beside(c: Column) -> Column:
    """The class of a character next to a span: 0 none, 1 blank, 2 digit, 3 letter, 4 stop, 5 other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).when(c.rlike("[.,;:!?]"), 4).otherwise(5)


def _features(gen: Column, span: Column, before: Column, after: Column) -> dict[str, Column]:
    d = _digits(span)
    n, groups = F.length(d), F.size(F.filter(F.split(span, "[^0-9]"), lambda x: x != ""))
    cue = lambda side, words: side.rlike(f"(?i)({words})").cast("int")
    f = {f"is_{g}": (gen == g).cast("int") for g in GENERATORS}
    f |= {"chars": F.least(F.length(span), F.lit(40)), "digits": F.least(n, F.lit(24)), "groups": F.least(groups, F.lit(8)), "letters": F.least(F.length(F.regexp_replace(span, r"[^\p{L}]", "")), F.lit(20))}
    f |= {"checked": F.when(n.between(13, 19), luhn(d)).otherwise(False).cast("int"), "octets": F.when(span.rlike(r"^[0-9.]+$"), _octets(span)).otherwise(False).cast("int")}
    f |= {"kinds": F.size(F.array_distinct(F.split(d, ""))), "beside_before": _beside(F.right(before, F.lit(1))), "beside_after": _beside(F.left(after, F.lit(1)))}
    return f | {f"before_{k}": cue(before, w) for k, w in CUES.items()} | {f"after_{k}": cue(after, w) for k, w in CUES.items()}



def scored(known: DataFrame) -> DataFrame:
    """``known`` (candidates with ``label``, 1: known to be personal data) with ``score``: boosted trees of the other half of the vectors."""
    features = _features(F.col("gen"), F.col("span"), F.col("before"), F.col("after"))
    names = [f"f_{k}" for k in features]
    k = known.select("*", *[F.coalesce(c, F.lit(0)).cast("double").alias(f"f_{n}") for n, c in features.items()], (F.pmod(F.xxhash64("span"), F.lit(2))).cast("int").alias("half"))
    k = write_once(k, "spans")
    vectors = k.groupBy(*names, "half", "label").agg(F.count("*").cast("double").alias("times"))
    vectors = write_once(vectors.withColumn("h", F.xxhash64(*names, "half", "label")).orderBy("h").limit(FIT_VECTORS).drop("h"), "vectors")
    put = VectorAssembler(inputCols=names, outputCol="vector")
    out = None
    for half in (0, 1):
        fit = put.transform(vectors.filter(F.col("half") != half))
        mine = put.transform(k.filter(F.col("half") == half))
        if fit.select("label").distinct().count() < 2:  # nothing to tell apart: known spans say all there is to say
            rate = fit.agg(F.avg("label")).first()[0] or 0.0
            part = mine.withColumn("score", F.lit(float(rate)))
        else:
            model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="times", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(fit)
            part = model.transform(mine).withColumn("score", vector_to_array("probability")[1])
        part = part.select("row", "gen", "kind", "span", "start", "end", "label", "score")
        out = part if out is None else out.unionByName(part)
    return out


def redactions(scores: DataFrame) -> DataFrame:
    """(row, kind, start, end, score) of scored candidates over their generator's threshold, without known spans."""
    passed = scores.filter("label = 1").groupBy(F.col("gen").alias("t_gen")).agg(F.percentile("score", LOSS).alias("threshold"))
    s = scores.filter("label = 0").join(passed, F.col("gen") == F.col("t_gen"))
    s = s.filter(F.col("score") >= F.greatest("threshold", F.lit(LEAST))).select("row", "kind", "start", "end", "score").groupBy("row", "kind", "start", "end").agg(F.max("score").alias("score"))
    # stretches of spans that overlap, and the best of each
    w = Window.partitionBy("row", "kind").orderBy("start", "end")
    s = s.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("stretch", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(w))
    best = Window.partitionBy("row", "kind", "stretch").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start")
    return s.withColumn("place", F.row_number().over(best)).filter("place = 1").select("row", "kind", "start", "end", "score")


def _looked_at(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9@]"), F.lit(False))


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row: hash of a text, kind, start, end, base) of the texts of ``docs``; ``base`` tells the rules' spans from those that the trees add."""
    text = F.col(text_col)
    t = write_once(docs.filter(_looked_at(text)).select(F.md5(text).alias("row"), text.alias("text")).dropDuplicates(["row"]), "texts")
    base = write_once(base_spans(t), "basespans")
    # The base span that begins last before a candidate's end is the only one to look at: those of a kind don't overlap.
    none = F.lit(None).cast("string")
    c = candidates(t).select("row", "kind", "start", "end", "gen", "before", "after", "span", F.lit(None).cast("struct<s:bigint,e:bigint>").alias("b"), F.col("end").alias("at"))
    marks = base.select("row", "kind", "start", "end", none.alias("gen"), none.alias("before"), none.alias("after"), none.alias("span"), F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("b"), (F.col("start") + 1).alias("at"))
    w = Window.partitionBy("row", "kind").orderBy("at", F.col("gen").isNotNull())
    m = c.unionByName(marks).withColumn("last", F.last("b", ignorenulls=True).over(w)).filter("gen IS NOT NULL")
    over = F.coalesce(F.col("last.e") > F.col("start"), F.lit(False))
    inside = over & (F.col("last.s") <= F.col("start")) & (F.col("last.e") >= F.col("end"))
    known = m.filter(inside | ~over).select("row", "gen", "kind", "before", "after", "span", "start", "end", inside.cast("double").alias("label"))
    added = redactions(scored(known))
    return base.withColumn("base", F.lit(True)).unionByName(added.select("row", "kind", "start", "end").withColumn("base", F.lit(False)))


def report(docs: DataFrame) -> DataFrame:
    """op13: a row per document: counts and a hash of its base spans, and all spans."""
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F)
    s = spans(docs).select("row", order.alias("o"), "start", "end", "kind", "base")
    item = F.struct("o", "start", "end", F.concat_ws(":", "kind", "start", "end").alias("x"))
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, item))), lambda x: x["x"]), ",")
    count = lambda k: F.sum(F.when(F.col("base") & (F.col("kind") == k), 1).otherwise(0)).cast("long").alias(f"n_{k}")
    g = s.groupBy(F.col("row").alias("g_row")).agg(*[count(k) for k in KINDS], listed(F.col("base")).alias("base_list"), listed(F.lit(True)).alias("spans"))
    looked = docs.filter(_looked_at(F.col("text"))).select("doc_id", F.md5("text").alias("row")).join(g, F.col("row") == F.col("g_row"), "left")
    nothing = [F.lit(None).cast("long").alias(f"n_{k}") for k in KINDS]
    rest = docs.filter(~_looked_at(F.col("text"))).select("doc_id", *nothing, F.lit(None).cast("string").alias("base_list"), F.lit(None).cast("string").alias("spans"))
    j = looked.select(*rest.columns).unionByName(rest)
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return j.select("doc_id", *zero, F.sha2(F.coalesce("base_list", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets (spans that overlap, by the first one's); all other columns as they are."""
    w = Window.partitionBy("row").orderBy("start", F.desc("end"))
    s = spans(docs, text_col).withColumn("reach", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.select("row", F.struct("start", "end", "reach", "kind").alias("x"))
    g = s.groupBy(F.col("row").alias("r_row")).agg(F.array_sort(F.collect_list("x")).alias("r_spans"), F.max("x.end").alias("r_end"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r_held"), F.md5(text_col).alias("r_key"), F.col(text_col).alias("r_text"))
    j = held.join(g, F.col("r_key") == F.col("r_row"), "left")
    text = F.col("r_text")
    sub = lambda a, b: F.substr(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    cut = F.transform("r_spans", lambda x: F.when(x["start"] < x["reach"], "").otherwise(F.concat(sub(x["reach"], x["start"]), F.lit("["), x["kind"], F.lit("]"))))
    new = F.when(F.col("r_spans").isNull(), text).otherwise(F.concat(F.array_join(cut, ""), sub(F.col("r_end"), F.length(text))))
    return j.select(*[new.alias(c) if c == text_col else F.col("r_held")[c].alias(c) for c in docs.columns])
