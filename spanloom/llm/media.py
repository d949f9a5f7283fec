"""Media columns: content-defined payload chunking.

A text's payload is stored as an 8-bit mono WAV file. The payload is cut where the high bits of a rolling gear hash (of the
last 64 bytes) are zero. Media are described by an ordered list of chunk digests; the chunks are deduplicated by digest, within map tasks first and
then by a join; lists are deduplicated by the medium's digest, so copies of a text are one list. Joining lists with the
chunk store, by digest, and gathering chunks in order, by medium, gives the media back; each is verified against its
digest before anything is computed from the samples that it holds. A digest that many media hold is stored in as many copies as there are
parts of ``PART`` references, so that no part of a join is larger.

Chunks travel compressed (by block sorting, which suits short texts). A task holds a slice of texts, or the chunks of one medium. Texts are cut twice, for the
lists and for the store: that costs less than a written store, which would pass the payload through the disk once more.

Defined results: null text counts as empty; an empty payload is one block of spaces; repeated rows and ids give a row each;
a very long text is one medium, put together in one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_slices
from spanloom.runtime import spread, write_once

BLOCK, RATE = 192, 8000
LEAST, MOST, BITS = 2048, 65536, 13
PART = 4096


def _gear() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], dtype=np.uint64)


GEAR = _gear()


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def header(size: int) -> bytes:
    """Of a WAV file with ``size`` samples of 8 bits, one channel."""
    return b"RIFF" + struct.pack("<I", 36 + size & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size & 0xFFFFFFFF)


def samples(media: bytes) -> bytes:
    """Reads the samples of a WAV file back."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this kind")
    return media[44:]


def cuts(payload: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS, step: int = 1 << 20) -> list[int]:
    """Ends of the chunks."""
    found = []
    for a in range(0, len(payload), step):
        at = max(0, a - 63)
        h = GEAR[np.frombuffer(payload[at : a + step], dtype=np.uint8)]
        for k in (1, 2, 4, 8, 16, 32):
            h[k:] += h[:-k] << np.uint64(k)
        found += (np.flatnonzero(h[a - at :] >> np.uint64(64 - bits) == 0) + a + 1).tolist()
    ends, last = [], 0
    for e in [*found, len(payload)]:
        while e - last > most:
            last += most
            ends.append(last)
        if e - last >= least or e == len(payload) and e > last:
            last = e
            ends.append(e)
    return ends


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def feature(media: bytes) -> str:
    """Mean level of sixteen equal stretches, peak and level crossings, in whole numbers."""
    s = np.frombuffer(samples(media), dtype=np.uint8)
    edges = np.linspace(0, len(s), 17).astype(np.int64)
    means = [int(s[a:b].sum(dtype=np.int64)) // int(b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return f"{bytes(means).hex()}:{int(s.max())}:{int(np.count_nonzero((s[1:] >= 128) != (s[:-1] >= 128)))}"


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary: SHA-256 of the medium, parts: ordered chunk digests) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            n, media, parts = [], [], []
            for t in b.column("text").to_pylist():
                p = payload_of(t)
                n.append(len(t.encode()))
                media.append(hashlib.sha256(header(len(p)) + p).digest())
                parts.append([digest(c) for c in chunks(p)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(parts, pa.list_(pa.binary()))], names=["id", "n_bytes", "media", "parts"])

    return spread(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary, parts array<binary>")


def chunk_store(docs: DataFrame, shared: DataFrame, text_col: str = "text", remember: int = 1 << 18) -> DataFrame:
    """(digest, copy, data): each distinct chunk, compressed, once, or in all copies that ``shared`` (digest, copies) asks for."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in text_slices(batches, "text"):
            out = {}
            for t in b.column("text").to_pylist():
                for c in chunks(payload_of(t)):
                    d = digest(c)
                    if d not in seen:
                        seen.add(d)
                        out[d] = bz2.compress(c, 1)
            if len(seen) > remember:  # what a task sees again after that is deduplicated by the shuffle
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["digest", "data"])

    c = spread(rows).mapInArrow(run, "digest binary, data binary").join(shared, "digest", "left")
    c = c.select("digest", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), "data")
    return c.repartition("digest", "copy").dropDuplicates(["digest", "copy"])


def _facts(media: bytes) -> tuple:
    p = samples(media)
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), feature(media)


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def shared_chunks(lists: DataFrame, part: int = PART) -> DataFrame:
    """(digest, copies) of the digests that more than ``part`` media hold."""
    n = lists.select(F.explode("parts").alias("digest")).groupBy("digest").agg(F.ceil(F.count("*") / part).cast("int").alias("copies"))
    return write_once(n.filter("copies > 1"), "mediashared")


def restore(lists: DataFrame, store: DataFrame, shared: DataFrame, each: Callable[[bytes], tuple] | None = None, columns: str = "file binary") -> DataFrame:
    """(media, file) of (media, parts) rows: the media, put together from the store and verified. With ``each``, instead of the file, the ``columns``
    that it computes from it, in the same task."""
    parts = lists.dropDuplicates(["media"]).select("media", F.posexplode("parts").alias("at", "digest")).join(shared, "digest", "left")
    parts = parts.withColumn("copy", F.pmod(F.xxhash64("media"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    rows = parts.join(store, ["digest", "copy"]).select("media", "at", "data").repartition("media").sortWithinPartitions("media", "at")
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[c.strip().split(" ")[1]] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: bytes, held: list[bytes]) -> tuple:
            p = b"".join(held)
            media = header(len(p)) + p
            if hashlib.sha256(media).digest() != key:
                raise ValueError(f"medium {key.hex()} was not put together as it was stored")
            return (key, *(each(media) if each else (media,)))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.binary(), *types], strict=True)], names=["media", *names])

        key, held, out, size = None, [], [], 0
        for b in text_slices(batches, "data"):
            for k, d in zip(b.column("media").to_pylist(), b.column("data").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        size += sum(map(len, held))
                        out.append(done(key, held))
                    key, held = k, []
                    if len(out) >= 1000 or size > 1 << 24 and not each:
                        yield batch(out)
                        out, size = [], 0
                held.append(bz2.decompress(d))
        if key is not None:
            out.append(done(key, held))
        if out:
            yield batch(out)

    return rows.mapInArrow(run, f"media binary, {columns}")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """op7: store, read back, verify and describe the media of all rows."""
    d = write_once(describe(docs, id_col, text_col), "medialist")
    lists = d.select("media", "parts")
    shared = shared_chunks(lists)
    m = restore(lists, chunk_store(docs, shared, text_col), shared, _facts, FACTS)
    out = d.select(F.col("id").alias(id_col), "n_bytes", "media").join(m, "media")
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
