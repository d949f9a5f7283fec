"""Collocations by contiguous pattern growth over projected occurrences.

Texts are cut into pieces and pieces into words. Every word is a prefix; its projected database has a pointer for each of its occurrences, with the words that follow
it within its piece (as many as a phrase may have). A task takes one prefix at a time and grows it to the right, depth first: it sorts the
pointers that it holds by the next word, counts each run, and goes on with the runs that are frequent. Phrases that can't be frequent are never looked at further.

Before the shuffle, pointers of a slice of texts that have the same words after them become one with a count. A prefix's database is split by a hash of
the next word into parts of some PART occurrences, so that no prefix, however frequent, is one task's; a phrase of two words is then still whole in its
part. Words that are split are listed for all tasks: they hold more than 1/FREQUENT of all occurrences, so there are FREQUENT at most. Only pairs that hold more than a 32nd of all occurrences are split by the third word too, and their partial counts are added up afterwards: a pair like that holds more
than a 64th of some slices, slices report such pairs, and by their sums at most 64 can be held for hot, whatever the size of the corpus.

A candidate's score is that of its weakest cut; the parts of a cut are at least as frequent as the phrase, so their counts are at hand. Products are exact decimals
of 38 digits (an overflow, at 10^14 occurrences of a phrase, raises an error). A phrase that lies in a longer one with half its occurrences is
dropped. The best of each language are found by limits within tasks first, so that a language with most rows is not one task's.

Defined results: null text is empty and has no words; null language is ``und``; ties go to more occurrences, then to the phrase that comes first in byte order; texts of any length are
cut at bytes, in linear time; repeated rows count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import text_slices
from spanloom.runtime import spread, write_once

STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LEAST, SHARE, BEST = 10, 50, 2000
SLICE_BYTES, PART, FREQUENT = 8 << 20, 1 << 22, 1 << 16
#: Pointers of a prefix below which plain counting is faster than arrays.
FEW = 2000
#: A pair is hot if it holds more than 1/HOT of all occurrences; salts that it is then dealt by.
HOT, SALTS = 32, 64
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(STOPS)] = 1, 2


def _joined(*columns: pa.Array) -> pa.Array:
    """The fields of each row with blanks between them and a line end."""
    wide = [c.cast(pa.large_string()) for c in columns]
    text = lambda x: pa.scalar(x, pa.large_string())
    line = pc.binary_join_element_wise(*wide, text(" ")) if len(wide) > 1 else wide[0]
    return pc.binary_join_element_wise(line, text(""), text("\n"))


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a new array of large strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[: offsets[-1]], offsets


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray] | None:
    """(the words of all texts in order, whether a piece begins at each)."""
    data, _ = _flat(_joined(pc.ascii_lower(texts)))
    kind = _KIND[data]
    word = np.concatenate([[False], kind == 0, [False]])
    turn = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])])
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return words, np.concatenate([[True], piece[1:] != piece[:-1]])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(language, its distinct words, codes of all words in order, beginnings of pieces) of slices of texts."""
    for batch in batches:
        for part in text_slices(iter([batch]), "text", SLICE_BYTES):
            langs = part.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                found = _words(part.column("text").filter(pc.equal(langs.indices, k)))
                if found:
                    d = found[0].dictionary_encode()
                    yield lang, d.dictionary, d.indices.to_numpy().astype(np.int64), found[1]


def _pairs(codes: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The code of every word and the one after it in its piece (0: none), as a number."""
    after = np.where(begins[1:], 0, codes[1:] + 1)
    return codes * (size + 1) + np.concatenate([after, [0]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, first, second, n): the words of slices (without second), and the pairs that hold more than 1/(2 HOT) of one."""
    for lang, words, codes, begins in _coded(batches):
        n = np.bincount(codes, minlength=len(words))
        pairs, c = np.unique(_pairs(codes, begins, len(words)), return_counts=True)
        much = (c * 2 * HOT > len(codes)) & (pairs % (len(words) + 1) > 0)
        a, b = pairs[much] // (len(words) + 1), pairs[much] % (len(words) + 1) - 1
        first = pa.concat_arrays([words, words.take(pa.array(a))])
        second = pa.concat_arrays([pa.nulls(len(words), pa.large_string()), words.take(pa.array(b))])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), first.cast(pa.string()), second.cast(pa.string()), pa.array(np.concatenate([n, c[much]]))], ["lang", "first", "second", "n"])


def _hash(words: pa.Array) -> np.ndarray:
    """A number of each word, the same in every slice."""
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words.to_pylist()), np.int64, len(words))


def _distinct(codes: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pointer, times that it occurs), in order."""
    key, top = codes, size
    for a in after:
        if top > (1 << 62) // (size + 1):
            key = np.unique(key, return_inverse=True)[1]
            top = len(codes)
        key, top = key * (size + 1) + a, top * (size + 1)
    return np.unique(key, return_index=True, return_counts=True)[1:]


def _projector(longest: int, parts: dict[tuple[str, str], int], hot: set[tuple[str, str, str]]) -> Callable:
    """Makes (lang, word, part, split, n, body): a prefix's pointers in a slice, distinct by the words that follow, a line each."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, begins in _coded(batches):
            size, n = len(words), len(codes)
            piece = np.cumsum(begins)
            after = np.zeros((longest - 1, n), np.int64)  # 0: the piece ends before
            for k in range(1, min(longest, n)):
                after[k - 1, : n - k] = np.where(piece[k:] == piece[: n - k], codes[k:] + 1, 0)
            rows, times = _distinct(codes, after, size)
            codes, after = codes[rows], after[:, rows]
            part, split = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            if any(x == lang for x, _ in parts) or any(x == lang for x, _, _ in hot):
                names = words.to_pylist()
                of = np.array([parts.get((lang, w), 1) for w in names])
                digests = np.concatenate([[0], _hash(words)])
                part = digests[after[0]] % of[codes]
                at = {w: i for i, w in enumerate(names)} if longest > 2 else {}
                wanted = [at[a] * (size + 1) + at[b] + 1 for x, a, b in hot if x == lang and a in at and b in at]
                if wanted:
                    split = np.isin(codes * (size + 1) + after[0], wanted)
                    part = np.where(split, digests[after[1]] % SALTS, part)
                order = np.lexsort((split, part, codes))
                codes, part, split, after, times = codes[order], part[order], split[order], after[:, order], times[order]
            table = np.vstack([codes, part, split, after])
            group = np.flatnonzero(np.concatenate([[True], (table[:3, 1:] != table[:3, :-1]).any(axis=0)]))
            texts = pa.concat_arrays([pa.array([""], pa.large_string()), words])
            data, offsets = _flat(_joined(*[texts.take(pa.array(x)) for x in table[3:]], pa.array(times)))
            bodies = pa.Array.from_buffers(pa.large_binary(), len(group), [None, pa.py_buffer(offsets[np.append(group, len(times))]), pa.py_buffer(data)])
            sums = np.add.reduceat(times, group)
            head = table[:3, group]
            cols = [pa.array([lang] * len(group), pa.string()), words.take(pa.array(head[0])).cast(pa.string()), pa.array(head[1].astype(np.int32)), pa.array(head[2].astype(bool)), pa.array(sums), bodies.cast(pa.binary())]
            out = pa.RecordBatch.from_arrays(cols, ["lang", "word", "part", "split", "n", "body"])
            for at in range(0, len(group), 1 << 14):
                yield out.slice(at, 1 << 14)

    return project


def _grow(phrase: str, rows: np.ndarray, depth: int, after: list[np.ndarray], names: list[pa.Array], times: np.ndarray, least: int, out: list[tuple[str, int, int]], whole: bool) -> None:
    """Extends ``phrase``, of which ``rows`` are the pointers, by every next word that is frequent, and goes on with each. Where the first extension is not ``whole``
    in this part, it is counted and extended whatever its count."""
    codes = after[depth][rows]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sums = np.add.reduceat(times[rows], begins)
    ends = np.append(begins[1:], len(rows))
    for b, e, n in zip(begins, ends, sums, strict=True):
        if n < least and whole:
            continue
        word = names[depth][int(codes[b])].as_py()
        if not word:
            continue
        longer = f"{phrase} {word}"
        out.append((longer, depth + 2, int(n)))
        if depth + 1 < len(after):
            _grow(longer, rows[b:e], depth + 1, after, names, times, least, out, True)


def _grower(longest: int, least: int) -> Callable:
    """Grows each prefix part of a sorted partition: (lang, phrase, words, n)."""
    width = longest  # fields of a line: the words that follow, and a count

    def fields(bodies: list[bytes]) -> tuple[list[np.ndarray], list[pa.Array], np.ndarray]:
        data = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        keep = data[(data != 32) & (data != 10)]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(keep)])
        column = lambda k: flat.take(pa.array(np.arange(k, len(ends), width)))
        coded = [column(k).dictionary_encode() for k in range(width - 1)]
        return [d.indices.to_numpy() for d in coded], [d.dictionary for d in coded], column(width - 1).cast(pa.int64()).to_numpy()

    def counted(phrase: str, pointers: list[tuple[list[str], int]], depth: int, out: list[tuple[str, int, int]], whole: bool) -> None:
        """What _grow does, for few pointers."""
        runs: dict[str, list[tuple[list[str], int]]] = {}
        for p in pointers:
            if p[0][depth]:
                runs.setdefault(p[0][depth], []).append(p)
        for word, run in runs.items():
            n = sum(t for _, t in run)
            if n >= least or not whole:
                out.append((f"{phrase} {word}", depth + 2, n))
                if depth + 2 < width:
                    counted(f"{phrase} {word}", run, depth + 1, out, True)

    def grown(key: tuple, held: list[bytes]) -> list[tuple[str, str, int, int]]:
        lang, word, _, split = key
        few = b"".join(held)
        if few.count(b"\n") < FEW:
            out = []
            counted(word, [(f, int(f[-1])) for f in (x.split(" ") for x in few.decode().split("\n")[:-1])], 0, out, not split)
            return [(lang, *x) for x in out]
        after, names, times = fields(held)
        out: list[tuple[str, int, int]] = []
        _grow(word, np.arange(len(times)), 0, after, names, times, least, out, not split)
        return [(lang, *x) for x in out]

    def compact(held: list[bytes]) -> list[bytes]:
        """The same pointers, those with equal words after them as one."""
        after, names, times = fields(held)
        key = np.zeros(len(times), np.int64)
        for codes, names_k in zip(after, names, strict=True):
            key = np.unique(key * len(names_k) + codes, return_inverse=True)[1]
        first = np.unique(key, return_index=True)[1]
        sums = np.bincount(key, weights=times).astype(np.int64)
        cols = [n.take(pa.array(c[first])) for c, n in zip(after, names, strict=True)]
        return [_flat(_joined(*cols, pa.array(sums)))[0].tobytes()]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, total, size, limit, out = None, [], 0, 0, 64 << 20, []
        empty = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), empty, strict=True)], schema=empty)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for head, n, body in zip(zip(*columns[:4], strict=True), columns[4], columns[5], strict=True):
                if head != key:
                    if held and (total >= least or key[3]):
                        out += grown(key, held)
                    key, held, total, size, limit = head, [], 0, 0, 64 << 20
                held.append(body)
                total, size = total + n, size + len(body)
                if size > limit:
                    held = compact(held)
                    size = len(held[0])
                    limit = max(limit, 2 * size)
            if len(out) > 10_000:
                yield pack(out)
                out = []
        if held and (total >= least or key[3]):
            out += grown(key, held)
        if out:
            yield pack(out)

    return grow


def frequent(docs: DataFrame, longest: int = 3, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all words and phrases of up to ``longest`` words that occur ``least`` times, (lang, n) of all words)."""
    d = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''")
    d = spread(d)
    c = d.mapInArrow(_counts, "lang string, first string, second string, n long").groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))
    c = write_once(c.filter((F.col("n") >= least) | F.col("second").isNull()), "words")
    words = c.filter("second IS NULL")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    n = words.agg(F.sum("n")).first()[0] or 0
    hot = {tuple(r) for r in c.filter(F.col("second").isNotNull() & (F.col("n") * 2 * HOT > n)).select("lang", "first", "second").limit(2 * HOT).collect()}
    split = words.filter(F.col("n") > max(PART, n // FREQUENT)).select("lang", "first", "n").collect()  # at most FREQUENT
    parts = {(r["lang"], r["first"]): math.ceil(r["n"] / PART) for r in split}
    schema = "lang string, word string, part int, split boolean, n long, body binary"
    p = d.mapInArrow(_projector(longest, parts, hot), schema)
    keys = ["lang", "word", "part", "split"]
    p = p.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    g = p.mapInArrow(_grower(longest, least), "lang string, phrase string, words int, n long")
    g = g.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    one = words.filter(F.col("n") >= least).select("lang", F.col("first").alias("phrase"), F.lit(1).alias("words"), "n")
    return write_once(one.unionByName(g), "phrases"), totals


def collocations(docs: DataFrame, longest: int = 3, least: int = LEAST, share: int = SHARE, best: int | None = BEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """op12: (lang, rank, phrase, a, l, r, n, score) of each language's ``best`` phrases (all, if None)."""
    f, totals = frequent(docs, longest, least, text_col, lang_col)
    c = f.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: part(i, k))))
    longer = c.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = c.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share)).drop("most")
    cut = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    counts = f.select("lang", "phrase", "n")
    j = cut.join(counts.withColumnsRenamed({"phrase": "left", "n": "l"}), ["lang", "left"]).join(counts.withColumnsRenamed({"phrase": "right", "n": "r"}), ["lang", "right"])
    wide = "cast({} as decimal(14,0))".format
    j = j.withColumn("score", F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0))) div ({wide('l')} * {wide('r')})"))
    weakest = j.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    s = weakest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if best is not None:
        s = s.filter(F.col("rank") <= best)
    return s.join(totals.withColumnsRenamed({"lang": "t_lang"}), F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, ws[i] AS phrase, 1 AS words FROM i UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1], 2 FROM i WHERE i < len(ws)
    UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], 3 FROM i WHERE i + 1 < len(ws)),
f AS (SELECT lang, phrase, words, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10),
b AS (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3),
m AS (SELECT lang, phrase, max(a) AS most FROM b GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR most * 100 < a * 50),
u AS (SELECT lang, phrase, a, 1 AS k, w[1] AS lhs, array_to_string(w[2:], ' ') AS rhs FROM k UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM k WHERE words = 3),
s AS (SELECT u.lang, u.phrase, u.a, u.k, x.n AS l, y.n AS r, CAST(u.a AS HUGEINT) * u.a * 1000000 // (CAST(x.n AS HUGEINT) * y.n) AS score
    FROM u JOIN f x ON u.lang = x.lang AND u.lhs = x.phrase JOIN f y ON u.lang = y.lang AND u.rhs = y.phrase),
t AS (SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS z FROM s GROUP BY ALL),
n AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY z.score DESC, a DESC, phrase) AS rank FROM t)
SELECT o.lang, CAST(rank AS INTEGER) AS rank, phrase, a, z.l AS l, z.r AS r, CAST(n.n AS BIGINT) AS n, CAST(z.score AS BIGINT) AS score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""
