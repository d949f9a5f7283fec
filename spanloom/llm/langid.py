"""Language identification of mixed-language text.

Words are runs of letters. The script of a word (by code point ranges) narrows its candidate languages to those that use the
script; each candidate gets the word's log likelihood under smoothed counts of its character trigrams and of the word
itself. Viterbi decoding over a text's words, with a penalty for switching, labels spans. A text's language is
the one with most letters; its score is that language's share of the letters.

The model is learned from a bounded sample: about ``PER_LANG`` distinct texts of every language (chosen by hash, read whole), however often they repeat. All
features of the sample are kept, sparsely: a feature holds the languages that it was seen in, all others get what a feature not seen is worth in them. The model is
no larger than the sample's features, in proportion to the number of languages, so it is broadcast. Prediction reads texts alone, all of them, whole.

Decoding runs over all texts of a slice at once, word by word, so that its cost per word is a few vector operations.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no spans; without training rows every text
is ``und``; repeated rows and ids give a row each; a very long text is decoded alone, with a byte or two a word and language; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_slices
from spanloom.runtime import discard, spread, write_once

PER_LANG = 1500
PENALTY, FAR = 12.0, -40.0
CACHE = 200_000

#: First and last code points of scripts (from the Unicode blocks).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
]
_STARTS = np.array([s[1] for s in SCRIPTS])


def script(word: str) -> str:
    c = ord(word[0])
    i = int(np.searchsorted(_STARTS, c, side="right")) - 1
    return SCRIPTS[i][0] if i >= 0 and c <= SCRIPTS[i][2] else "other"


def _find():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word: str) -> list[str]:
    """The word's trigrams with marked ends, and the word itself."""
    w = f"_{word.lower()}_"
    return [w[i : i + 3] for i in range(len(w) - 2)] + [f"={w}"]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> dict:
    """A model from rows with a non-null language; what reaches the driver is the features of the bounded sample."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    mark = F.xxhash64(F.lit(11), "text")
    langs = rows.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("n")).orderBy("lang").collect()
    if not langs:
        return {"langs": []}
    share = F.element_at(F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(1.0, per_lang / r["n"]))]), F.col("lang"))
    draw = F.pmod(mark, F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < share).groupBy("lang", mark.alias("m")).agg(F.first("text").alias("text"))
    kind = "lang string, kind string, gram string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _find().findall
        for b in text_slices(batches, "text", 1 << 22):
            words: dict[str, Counter] = defaultdict(Counter)
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words[lang].update(find(t))
            out = []
            for lang, c in words.items():
                g, s = Counter(), Counter()
                for w, n in c.items():
                    s[script(w)] += n
                    for x in grams(w):
                        g[x] += n
                out += [(lang, "gram", x, n) for x, n in g.items()] + [(lang, "script", x, n) for x, n in s.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["lang", "kind", "gram", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, kind).groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = write_once(counts, "langcounts")
    grams_of = counts.filter("kind = 'gram'").select("gram", "lang", "n").orderBy("gram", "lang").toArrow()
    scripts_of = counts.filter("kind = 'script'").select("gram", "lang", "n").collect()  # scripts times languages
    discard(counts)
    names = [r["lang"] for r in langs]
    at = {x: i for i, x in enumerate(names)}
    coded = grams_of.column("gram").combine_chunks().dictionary_encode()
    row = {g: i for i, g in enumerate(coded.dictionary.to_pylist())}
    feature, n = coded.indices.to_numpy(zero_copy_only=False), grams_of.column("n").to_numpy().astype(np.float64)
    lang = np.fromiter((at[x] for x in grams_of.column("lang").to_pylist()), np.int64, len(n))
    total, v = np.bincount(lang, n, len(names)), max(1, len(row))
    unseen = np.log(0.5 / (total + 0.5 * v))
    per_script: dict[str, dict] = defaultdict(dict)
    words: Counter = Counter()
    for r in scripts_of:
        per_script[r["gram"]][r["lang"]] = r["n"]
        words[r["lang"]] += r["n"]
    allowed = {s: np.array([by.get(x, 0) >= 0.005 * words[x] and x in by for x in names]) for s, by in sorted(per_script.items())}
    return {
        "langs": names, "row": row, "scripts": {s: a for s, a in allowed.items() if a.any()}, "unseen": unseen,
        "starts": np.searchsorted(feature, np.arange(len(row) + 1)), "lang": lang, "more": np.log((n + 0.5) / (total + 0.5 * v)[lang]) - unseen[lang],
    }


class Labeller:
    def __init__(self, model: dict, penalty: float = PENALTY, cache: int = CACHE):
        self.m, self.penalty, self.cache, self.find = model, penalty, cache, _find()
        self.known: dict[str, int] = {}
        self.scores = np.empty((1 << 12, len(model["langs"])), np.float32)  # grows by doubling
        self.kind = np.min_scalar_type(max(1, len(model["langs"]) - 1))

    def _score(self, words: list[str]) -> np.ndarray:
        row, nl, flat, size = self.m["row"], len(self.m["langs"]), [], []
        for w in words:
            g = grams(w)
            size.append(len(g))
            flat += [row.get(x, -1) for x in g]
        size, flat = np.array(size), np.array(flat)
        word = np.repeat(np.arange(len(words)), size)[flat >= 0]
        first = self.m["starts"][flat[flat >= 0]]
        many = self.m["starts"][flat[flat >= 0] + 1] - first
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)  # places of all languages of all features
        seen = np.bincount(np.repeat(word, many) * nl + self.m["lang"][at], self.m["more"][at], len(words) * nl)
        out = size[:, None] * self.m["unseen"] + seen.reshape(len(words), nl)
        any_script = np.ones(out.shape[1], bool)
        may = np.array([self.m["scripts"].get(script(w), any_script) for w in words])
        best = np.where(may, out, -np.inf).max(axis=1, keepdims=True)
        return np.where(may, out, np.minimum(out, best + FAR)).astype(np.float32)

    def _index(self, texts: list[list[str]]) -> np.ndarray:
        new = list(set().union(*texts).difference(self.known))
        if len(self.known) + len(new) > self.cache:
            self.known = {}
            new = list(set().union(*texts))
        if new:
            at, to = len(self.known), len(self.known) + len(new)
            if to > len(self.scores):
                held = self.scores
                self.scores = np.empty((max(to, 2 * len(held)), held.shape[1]), np.float32)
                self.scores[:at] = held[:at]
            self.known.update(zip(new, range(at, to), strict=True))
            self.scores[at:to] = self._score(new)
        get = self.known.__getitem__
        return np.fromiter((get(w) for t in texts for w in t), np.int64)

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language index of every word, by Viterbi decoding of all texts in step."""
        if not texts:
            return []
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        words = self._index(texts)
        nl = self.scores.shape[1]
        order = np.argsort(-size, kind="stable")
        begin, length = start[order], size[order]
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
        back = np.zeros((len(words), nl), self.kind)
        value = np.zeros((len(texts), nl), np.float32)
        for t in range(steps):
            a = active[t]
            at, v = begin[:a] + t, value[:a]
            if t:
                lead = v.argmax(axis=1)
                jump = v[np.arange(a), lead][:, None] - self.penalty
                back[at] = np.where(v < jump, lead[:, None], np.arange(nl)[None])
                np.maximum(v, jump, out=v)
            v += self.scores[words[at]]
        out, now = np.zeros(len(words), self.kind), value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            at = begin[: active[t]] + t
            cur = now[: active[t]]
            out[at] = cur
            if t:
                now[: active[t]] = back[at, cur]
        return np.split(out, np.cumsum(size)[:-1])

    def __call__(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        words = [self.find.findall(t) for t in texts]
        has = [i for i, w in enumerate(words) if w] if self.m["langs"] else []
        out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
        for i, lab in zip(has, self.labels([words[i] for i in has]), strict=True):
            w, letters = words[i], np.zeros(len(self.m["langs"]), np.int64)
            np.add.at(letters, lab, np.fromiter(map(len, w), np.int64, len(w)))
            turn = np.flatnonzero(np.diff(lab)) + 1
            if len(turn):
                where = [(x.start(), x.end()) for x in self.find.finditer(texts[i])]
                edge = [0, *turn.tolist(), len(w)]
                spans = [(where[a][0], where[b - 1][1], int(lab[a])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            else:
                spans = [(self.find.search(texts[i]).start(), texts[i].rfind(w[-1]) + len(w[-1]), int(lab[0]))]
            best = int(letters.argmax())
            out[i] = (self.m["langs"][best], float(letters[best] / letters.sum()), [{"start": a, "end": b, "lang": self.m["langs"][x]} for a, b, x in spans])
        return out


def label(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(id, lang_pred, score, spans: array of (start, end, lang) in characters) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1 << 18, (1 << 24) // max(4, len(model["langs"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in text_slices(batches, "text", most):
            lang, score, spans = zip(*labeller(b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], names=[id_col, "lang_pred", "score", "spans"])

    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def predict(docs: DataFrame) -> DataFrame:
    """op3: learned from the rows outside fold 2, applied to all."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 2))
    out = label(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
