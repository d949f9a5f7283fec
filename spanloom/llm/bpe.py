"""Byte-level BPE encoding and decoding.

Pieces are the matches of a pre-tokenizer pattern. The pieces that a slice of texts holds are encoded together,
in a forest: one segment tree per piece, over its byte positions. A leaf holds ``rank * width + position`` of the
pair that starts there, so that a root holds the leftmost pair of minimum rank. One step takes the root of every
tree that still has a pair, merges it, and updates the leaves of the merged token, of its removed right half and
of its left neighbour: three point updates of logarithmic cost. Finished trees leave the forest.

The vocabulary is bounded (its file), so its tables are broadcast. Memory per task is bounded by the slice size, the
cache bound and the longest text.

Defined results: null text counts as empty; an empty text has no ids; rows are never merged, so repeated rows and
ids give one result row each; null ids pass through; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_slices
from spanloom.runtime import spread

INF = np.int64(1) << 62
#: Bytes of pieces and ids that a worker remembers. Only speed depends on it.
CACHE = 1 << 25
_MUL = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Vocabulary:
    """Token bytes by rank, and an open-addressing table (left id, right id) -> merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the single bytes {missing[:5]}")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, out = [], [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(r)
        keys = (np.array(left, dtype=np.int64) << 31) | np.array(right, dtype=np.int64)
        bits = max(4, int(len(out) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        todo, slot, values = keys, self._slot(keys), np.array(out, dtype=np.int64)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.values[slot[free]] = todo[free], values[free]
            lost = self.keys[slot] != todo  # slot taken, by an older key or in this round
            todo, values, slot = todo[lost], values[lost], (slot[lost] + 1) & self.mask
            # a winner of this round may have written values of a loser: both arrays are written in the same order

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A file with a base64 token and its rank per line."""
        return cls(read_ranks(path))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MUL) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, -1 where the pair has none."""
        keys = (left << 31) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left_over = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[left_over]
        while len(left_over):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[left_over]
            out[left_over[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            left_over, slot = left_over[on], slot[on]
        return out


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece as little-endian uint32."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = v.ranks.get(p)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif p:
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
    for width, where in by_width.items():
        step = max(1, (1 << 19) // width)
        for k in range(0, len(where), step):
            part = where[k : k + step]
            for i, ids in zip(part, _forest(v, [pieces[i] for i in part], width), strict=True):
                out[i] = ids
    return out


def _forest(v: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    n, levels = len(pieces), width.bit_length() - 1
    size = np.fromiter(map(len, pieces), np.int64, n)
    ids = v.byte[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)]
    column = np.tile(np.arange(width, dtype=np.int64), n)
    end = np.repeat(size, width)
    live = column < end
    after, before = np.where(column + 1 < end, column + 1, width), column - 1
    tree = np.full((n, 2 * width), INF, dtype=np.int64)
    starts = np.flatnonzero(column + 1 < end)
    first = v.pairs(ids[starts], ids[starts + 1])
    leaf = np.full(n * width, INF, dtype=np.int64)
    leaf[starts] = np.where(first >= 0, first * width + column[starts], INF)
    tree[:, width:] = leaf.reshape(n, width)
    for level in range(levels - 1, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    tree = tree.reshape(-1)
    rows = np.arange(n, dtype=np.int64)
    while True:
        root = tree[rows * (2 * width) + 1]
        on = root < INF
        rows, root = rows[on], root[on]
        if not len(rows):
            break
        at, merged = root & (width - 1), root >> levels
        flat, top = rows * width, rows * (2 * width)
        right = after[flat + at]
        beyond, left = after[flat + right], before[flat + at]
        ids[flat + at] = merged
        after[flat + at] = beyond
        live[flat + right] = False
        tree[top + width + right] = INF
        tree[top + width + at] = INF
        has = np.flatnonzero(beyond < width)
        before[flat[has] + beyond[has]] = at[has]
        found = v.pairs(merged[has], ids[flat[has] + beyond[has]])
        tree[top[has] + width + at[has]] = np.where(found >= 0, found * width + at[has], INF)
        has = np.flatnonzero(left >= 0)
        found = v.pairs(ids[flat[has] + left[has]], merged[has])
        tree[top[has] + width + left[has]] = np.where(found >= 0, found * width + left[has], INF)
        tops = np.concatenate([top, top, top[has]])
        node = np.concatenate([at, right, left[has]]) + width
        for _ in range(levels):
            node >>= 1
            tree[tops + node] = np.minimum(tree[tops + 2 * node], tree[tops + 2 * node + 1])
    counts = np.add.reduceat(live.astype(np.int64), np.arange(0, n * width, width))
    packed = ids[live].astype("<u4").tobytes()
    ends = (np.cumsum(counts) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode_ids(v: Vocabulary, ids: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(v.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Encoder:
    def __init__(self, v: Vocabulary, pattern: str, cache: int = CACHE):
        import regex

        self.v, self.find, self.most, self.known = v, regex.compile(pattern).findall, cache, {}
        self.held = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces = [self.find(t) for t in texts]
        new = list(set().union(*pieces).difference(self.known))
        if self.held > self.most:
            self.known.clear()
            self.held, new = 0, list(set().union(*pieces))
        ids = encode_pieces(self.v, [x.encode() for x in new])
        self.known.update(zip(new, ids, strict=True))
        self.held += sum(map(len, new)) + sum(map(len, ids)) + 100 * len(new)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


_WORKER: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    key = id(shared.value)  # a worker process builds the tables once
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Vocabulary(shared.value)
    return _WORKER[key]


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary of little-endian uint32) for every row; with ``decode`` also ``decoded`` binary,
    which is made from the ids alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))  # bounded by the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        encoder = Encoder(v, pattern)
        for b in text_slices(batches, "text"):
            ids = encoder(b.column("text").to_pylist())
            cols = [b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = [id_col, "n_tokens", "ids"]
            if decode:
                cols.append(pa.array([decode_ids(v, x) for x in ids], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of packed ids; ids that end within a character give U+FFFD there."""
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for b in text_slices(batches, "ids"):
            text = [decode_ids(v, x).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(text, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")


def digest(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """op2: what a document's ids and their decoding hash to."""
    e = encode(docs, vocabulary_path, pattern, decode=True)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
