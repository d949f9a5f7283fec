"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its shingles of five words (lower-cased runs of letters and digits; a shorter text is one shingle); a shingle
weighs as many as its occurrences. The weight axis of an element is cut into regions at 1, 2, 4, ...; darts fall on a region at hashed times, at a rate
in proportion to its width, each at a hashed weight and a hashed coordinate; a dart beyond the element's weight misses the text. A text throws only
the darts that arrive before a time at which its coordinates are all but certainly hit (and later ones, if one was missed), and keeps the earliest
per coordinate. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity. ``regions`` and ``darts`` take any real weights.

Bands of coordinates are join keys. Exact copies are one node. No bucket is expanded into all pairs:

A. The smallest node of a bucket is its hub; each (hub, member) pair whose signatures allow it is verified on the shingles, and
   nodes are joined by these links. A hub's pairs are dealt in parts of bounded size.
B. In buckets with several components, members away from the bucket's largest component are compared with the members of other components, on
   signatures, in blocks of bounded size. The nodes of pairs that agree form loose groups (an edge a node leaves a block, not one a pair). In each loose
   group, the members away from its largest component are compared with the others once, and what agrees is verified, in blocks again.

So every pair that shares a bucket and agrees is either verified or joined already: no link is lost, and a tight group of any size
costs a number of comparisons proportional to its size; only members that no band has joined to the bulk of their bucket are compared with all of it.
Components are found by local contraction and alternating stars, whose largest groups are only aggregated (minimum) and joined.

A pair of similarity 0.8 shares one of the 24 bands of 6 with probability 0.9993.

Defined results: exact copies share a class, null texts too; texts without a word are only copies of equal texts; class ids
are the smallest id of the class, null if all are null; rows with equal ids are judged by their texts; a very long text is one slice of its own and is
compared whole; an empty table gives an empty result; other columns are kept by ``keep_one``, whatever their names. Nodes are 64-bit hashes of texts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_slices
from spanloom.runtime import TEXT_BATCH, discard, spread, write_once

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
COORDINATES = BANDS * ROWS
BLOCK = 2048
#: Signatures must agree in as many coordinates as five standard deviations below the similarity.
AGREE = int((SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5) * COORDINATES)
_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hash, number of occurrences) of each text's distinct shingles, sorted by text and hash."""
    import xxhash

    words = [_WORD.findall(t.lower()) for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for t in words for w in t), np.uint64, int(size.sum()))
    n = np.where(size > 0, np.maximum(size - WORDS + 1, 1), 0)
    start = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), n)
    at = start[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    s = np.zeros(len(doc), np.uint64)
    last = (start + size)[doc]
    for k in range(WORDS):
        here = at + k < last
        s = mix(s * _A + np.where(here, h[np.minimum(at + k, max(0, len(h) - 1))], np.uint64(0)) + np.uint64(k + 1))
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], np.diff(np.append(first, len(s)))


def occurrences(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every occurrence: as sets, these have the weighted Jaccard similarity of the counts."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), mix(np.repeat(shingle, count) + nth.astype(np.uint64) * _A)


def regions(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, low, width, weight) of the regions of weighted elements: the weight axis is cut at 1, 2, 4, ... so that an element of weight w has
    about log2(w) regions, which it shares with every text in which it weighs as much. The last one reaches beyond the weight."""
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    return doc[at], mix(element[at] + level.astype(np.uint64) * _A), low, np.where(level > 0, low, 1.0), weight[at].astype(np.float64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(areas: tuple[np.ndarray, ...], n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate: an (n_docs, k) table of hashes; rows of texts without regions are 0.

    A region's darts arrive at rate k times its width, each at a hashed weight and coordinate; those at a weight beyond the text's miss it.
    """
    doc, cell, low, width, weight = areas
    total = np.bincount(doc, weights=np.minimum(low + width, weight) - low, minlength=n_docs)
    out = np.zeros((n_docs, k), np.uint64)
    todo = np.flatnonzero(total)
    until = np.zeros(n_docs)
    until[todo] = (np.log(k) + 2.5) / total[todo]
    while len(todo):
        mine = np.isin(doc, todo) if len(todo) < n_docs else np.ones(len(doc), bool)
        d, c, lo, wi, we = doc[mine], cell[mine], low[mine], width[mine], weight[mine]
        time = np.zeros(len(d))
        keys, times, ids = [], [], []
        j = 0
        while len(d):
            j += 1
            h = mix(c + np.uint64(j * int(_C) % (1 << 64)))
            time = time - np.log(_uniform(h)) / (k * wi)
            on = time < until[d]
            d, c, lo, wi, we, time, h = d[on], c[on], lo[on], wi[on], we[on], time[on], mix(h[on] + _A)
            hit = (we >= lo + wi) | (lo + wi * _uniform(mix(h + _B)) < we)
            keys.append((d * k + (h % np.uint64(k)).astype(np.int64))[hit])
            times.append(time[hit])
            ids.append(h[hit])
        key, when, ident = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
        order = np.argsort(when)[::-1]
        flat = np.zeros(n_docs * k, np.uint64)
        flat[key[order]] = ident[order] | np.uint64(1)  # written from the latest to the earliest
        sig = flat.reshape(n_docs, k)
        full = (sig[todo] != 0).all(axis=1)
        out[todo[full]] = sig[todo[full]]
        todo = todo[~full]
        until[todo] *= 2
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sig), BANDS), np.uint64)
    rows = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        x = mix(x * _A + rows[:, :, r])
    return mix(x + np.arange(BANDS, dtype=np.uint64)[None]).astype(np.int64)


def _nodes(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def signatures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, sig: a byte per coordinate, bands) of texts that have words; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in text_slices(batches, "text"):
            pick = {n: i for i, n in enumerate(b.column("node").to_pylist()) if n not in seen}
            seen |= pick.keys()
            if len(seen) > 1 << 20:
                seen.clear()
            if not pick:
                continue
            b = b.take(pa.array(list(pick.values())))
            sig = darts(regions(*shingles(b.column("text").to_pylist())), b.num_rows)
            has = np.flatnonzero(sig.any(axis=1))
            if len(has):
                byte = (sig[has] >> np.uint64(40)).astype(np.uint8)
                names = bands(sig[has])
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").take(pa.array(has)), pa.array([x.tobytes() for x in byte], pa.binary()), pa.array(list(names), pa.list_(pa.int64()))], names=["node", "sig", "bands"]
                )

    return spread(_nodes(docs, text_col)).mapInArrow(run, "node long, sig binary, bands array<long>")


def _cells(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, cells): the sorted occurrences of the wanted nodes' shingles; copies are dropped where they are read, before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            doc, cell = occurrences(*shingles(b.column("text").to_pylist()))
            cell = cell.astype(np.int64)
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            cells = [np.sort(cell[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(cells, pa.list_(pa.int64()))], names=["node", "cells"])

    rows = _nodes(docs, text_col).dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi")
    return rows.mapInArrow(run, "node long, cells array<long>")


def _judged(pairs: DataFrame, sigs: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, similar) of the pairs whose signatures agree enough: whether the weighted Jaccard similarity is at least SIMILARITY.

    Pairs of an ``a`` with many ``b`` are dealt in parts of about BLOCK pairs, each with its own copy of what is known of ``a``.
    """
    parts = write_once(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "parts")  # written, so that a skewed join can be split
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64(F.lit(3), "b"), "parts").cast("int").alias("part"), "b")
    copies = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    s, c = sigs.select("node", "sig"), cells.select("node", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb")]
            keep = (x[0] == x[1]).sum(axis=1) >= AGREE
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "part", "b")], names=["a", "part", "b"])

    rows = dealt.join(copies.join(s.toDF("a", "sa"), "a"), ["a", "part"]).join(s.toDF("b", "sb"), "b").select("a", "part", "b", "sa", "sb")
    near = rows.mapInArrow(run, "a long, part int, b long")
    rows = near.join(copies.join(c.toDF("a", "ca"), "a"), ["a", "part"]).join(c.toDF("b", "cb"), "b")
    both = F.size(F.array_intersect("ca", "cb"))
    return rows.select("a", "b", (both >= SIMILARITY * (F.size("ca") + F.size("cb") - both)).alias("similar"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component among the edges given), for nodes that are not the smallest themselves."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            on = label != np.arange(len(names))
            return names[on], names[label[on]]
        label = new


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one v, and no v is a u."""
    x = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return x.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node of its connected component.

    Edges become stars where they are read, in chunks of bounded size; alternating large and small stars join these.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append((b.column("a").to_numpy(), b.column("b").to_numpy()))
                n += b.num_rows
            if held and (b is None or n > 1 << 20):
                u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                held, n = [], 0

    e = write_once(links.filter("a <> b").select("a", "b").mapInArrow(contract, "u long, v long"), "star")
    for _ in range(most):
        if _settled(e):
            break
        # each step is written, so that plans stay small and joins on a node with many neighbours can be split
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_once(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = write_once(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = write_once(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = write_once(small, "star")
        for t in (e, low, large, least):
            discard(t)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _blocks(m: DataFrame, group: str, facts: list[DataFrame]) -> DataFrame:
    """Rows (group, i, j, left, node, root, and the columns of ``facts`` by node): members away against all members, in pairs of
    blocks. Facts, which are large, are joined by node and dealt by block, never by group."""
    extra = ["node", "root"]
    for f in facts:
        m = m.join(f, "node")
        extra += [c for c in f.columns if c != "node"]
    block = lambda k: F.pmod(F.xxhash64(F.lit(5), "node"), k).cast("int")
    left = m.filter("away").select(group, block(F.col("ri")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("left"), *extra)
    right = m.select(group, F.explode(F.sequence(F.lit(0), F.col("ri") - 1)).alias("i"), block(F.col("nj")).alias("j"), F.lit(False).alias("left"), *extra)
    return left.unionByName(right).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], done) -> Iterator[pa.RecordBatch]:
    """Calls ``done`` with the rows of each key, which are neighbours, as a dict of arrays."""
    held = None

    def each(x: dict) -> Iterator[pa.RecordBatch]:
        key = np.stack([x[c] for c in keys])
        cut = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
        for s, t in zip([0, *cut], [*cut, key.shape[1]], strict=True):
            out = done({c: v[s:t] for c, v in x.items()}) if t - s > 1 else None
            if out is not None and len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "sig"}
        x["sig"] = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        x["left"] = x["left"].astype(bool)
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in x}
        tail = np.logical_and.reduce([x[c] == x[c][-1] for c in keys])
        held = {c: v[tail] for c, v in x.items()}
        if not tail.all():
            yield from each({c: v[~tail] for c, v in x.items()})
    if held is not None:
        yield from each(held)


def _agreements(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, coordinates that agree) of the pairs of different components that agree enough."""
    a, b = np.flatnonzero(x["left"]), np.flatnonzero(~x["left"])
    out = []
    for k in range(0, len(a), 64):
        part = a[k : k + 64]
        same = np.zeros((len(part), len(b)), np.int32)
        for c in range(0, COORDINATES, 16):
            same += (x["sig"][part][:, None, c : c + 16] == x["sig"][b][None, :, c : c + 16]).sum(axis=2, dtype=np.int32)
        p, q = np.nonzero((same >= AGREE) & (x["root"][part][:, None] != x["root"][b][None]))
        out.append((part[p], b[q], same[p, q]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _away(m: DataFrame, group: str, block: int) -> DataFrame:
    """Members (group, node, root) of groups with several components, with ``away``: not in the group's largest component, and the numbers of blocks of
    members away (ri) and of all (nj)."""
    size = m.groupBy(group, "root").agg(F.count("*").alias("n"))
    main = size.groupBy(group).agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n")).filter("n > x.n")
    blocks = lambda n: F.ceil(n / block).cast("int")
    main = write_once(main.select(group, F.col("x.root").alias("main"), blocks(F.col("n") - F.col("x.n")).alias("ri"), blocks(F.col("n")).alias("nj")), "groups")
    return m.join(main, group).withColumn("away", F.col("root") != F.col("main"))


def _loose(buckets: DataFrame, comps: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges (a, b) that join, per block of a bucket, all nodes of pairs that agree: one edge a node, not one a pair."""
    m = buckets.join(comps.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = _blocks(_away(m, "bucket", BLOCK), "bucket", [sigs.select("node", "sig")])

    def done(x: dict) -> tuple[np.ndarray, np.ndarray] | None:
        p, q, _ = _agreements(x)
        return stars(x["node"][p], x["node"][q]) if len(p) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _groups(batches, ["bucket", "i", "j"], done)

    return rows.mapInArrow(run, "a long, b long")


def _rest(loose: DataFrame, comps: DataFrame, sigs: DataFrame, cells: DataFrame) -> DataFrame:
    """The verified links (a, b) of phase B that join components; within a block, pairs that are joined already are skipped."""
    m = loose.select("node", F.col("root").alias("grp")).join(comps.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = _blocks(_away(m, "grp", BLOCK // 4), "grp", [sigs.select("node", "sig"), cells])

    def done(x: dict) -> tuple[np.ndarray, np.ndarray] | None:
        p, q, n = _agreements(x)
        order = np.argsort(-n, kind="stable")
        root: dict[int, int] = {}

        def find(r: int) -> int:
            while root.get(r, r) != r:
                r = root[r]
            return r

        out = []
        for i, j in zip(p[order].tolist(), q[order].tolist(), strict=True):
            a, b = find(int(x["root"][i])), find(int(x["root"][j]))
            if a != b:
                ca, cb = x["cells"][i], x["cells"][j]
                if min(len(ca), len(cb)) < SIMILARITY * max(len(ca), len(cb)):
                    continue
                both = len(np.intersect1d(ca, cb, assume_unique=True))
                if both >= SIMILARITY * (len(ca) + len(cb) - both):
                    root[max(a, b)] = min(a, b)
                    out.append((x["node"][i], x["node"][j]))
        return tuple(np.array(z, np.int64) for z in zip(*out, strict=True)) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _groups((y for b in batches for y in (b.slice(k, 512) for k in range(0, b.num_rows, 512))), ["grp", "i", "j"], done)

    return rows.mapInArrow(run, "a long, b long")


def node_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root) of the nodes that have a near duplicate of another text."""
    sigs = write_once(signatures(docs, text_col), "dartsig", TEXT_BATCH)
    b = sigs.select("node", F.explode("bands").alias("bucket")).distinct()
    hubs = b.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("bucket", "hub")
    hubs = write_once(hubs, "hubs")
    buckets = write_once(b.join(hubs, "bucket").select("bucket", "node", "hub"), "bucket")
    members = buckets.select("node").distinct()
    known = write_once(sigs.join(members, "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig")), "dartsig")
    discard(sigs)
    cells = write_once(_cells(docs, members, text_col), "cells", TEXT_BATCH)
    first = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = write_once(_judged(first, known, cells), "pairs")
    links = pairs.filter("similar").select("a", "b")
    found = components(links)
    # written before their components are found: two steps in Python of one stage are two workers a core, which live on and take turns from then on
    agree = write_once(_loose(buckets.select("bucket", "node"), found, known), "agree")
    loose = components(pairs.select("a", "b").unionByName(agree))
    rest = write_once(_rest(loose, found, known, cells), "rest", TEXT_BATCH)
    out = write_once(components(links.unionByName(rest)), "comps")
    for t in (known, hubs, buckets, pairs, cells, agree, rest):
        discard(t)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, class_id, class_size) of every distinct text. Groups of copies, and then classes, are counted before they are joined: what is joined
    are written tables, so that a class or text with a large share of all rows is split."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
    nodes = rows.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    nodes = write_once(nodes.join(node_classes(docs, text_col), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low", "n"), "nodes")
    size = write_once(nodes.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size")), "classes")
    return write_once(nodes.select("node", "root").join(size, "root").select("node", "class_id", "class_size"), "nodeclass")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
    return rows.join(_classes(docs, id_col, text_col), "node").select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id (null ids last, then by text hash), with the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("n_row"), F.col(id_col).alias("n_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("n_id").isNull().alias("no"), "n_id")).alias("low"))
    nodes = nodes.join(node_classes(docs, text_col), "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("low.no", "low.n_id", "node").alias("x"))
    best = write_once(nodes.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.n_id").alias("k_id"), F.col("x.node").alias("k_node")), "keep")
    kept = rows.join(best, (F.col("node") == F.col("k_node")) & F.col("n_id").eqNullSafe(F.col("k_id")), "left_semi")
    return kept.dropDuplicates(["node"]).select("n_row.*")
