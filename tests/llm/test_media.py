import hashlib
import random
import zlib

import pytest

from spanloom.llm import media

RND = random.Random(5)
TEXTS = [None, "", "x", "é" * 96, "a" * 192, "b" * 193, " ".join(f"w{RND.getrandbits(20)}" for i in range(60_000)), "same", "same", " "]


def test_values(spark):
    docs = spark.createDataFrame([(i, t, b"x", "y") for i, t in enumerate(TEXTS)] + [(None, "same", b"x", "y"), (7, "same", b"x", "y")], "doc_id long, text string, media binary, id string")
    rows = media.media_features(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        raw = ("same" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        m = media.header(len(p)) + p
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(p), len(m))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.media_sha256 == hashlib.sha256(m).hexdigest()
        assert r.tail_crc32 == zlib.crc32(p[-16:]) and r.feature == media.feature(m)
    assert media.media_features(docs.limit(0)).collect() == []


def test_cuts_follow_content():
    text = TEXTS[6].encode()
    a, b = media.chunks(text), media.chunks(b"inserted at the front " + text)
    assert b"".join(a) == text and len(a) > 5
    assert len(set(a) & set(b)) >= len(a) - 2
    assert all(len(c) <= media.MOST for c in a) and all(len(c) >= media.LEAST for c in a[:-1])
    assert media.cuts(text) == media.cuts(text, step=4096)


def test_gear_hash_is_the_rolling_one():
    data = bytes(i * i % 251 for i in range(5000))
    h, ends = 0, []
    for i, c in enumerate(data):
        h = ((h << 1) + int(media.GEAR[c])) % (1 << 64)
        if h >> 57 == 0:
            ends.append(i + 1)
    want, last = [], 0
    for e in [*ends, len(data)]:
        if e - last >= 64 or e == len(data) and e > last:
            want.append(e)
            last = e
    assert media.cuts(data, least=64, most=1 << 20, bits=7, step=1000) == want


def test_broken_store_is_noticed(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    lists = media.describe(docs).selectExpr("unhex(repeat('00', 32)) media", "parts")
    with pytest.raises(Exception, match="not put together"):
        shared = media.shared_chunks(lists)
        media.restore(lists, media.chunk_store(docs, shared), shared).collect()


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_files_come_back(spark, part):
    base = TEXTS[6]
    texts = [f"{i} {base}" for i in range(9)] + TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d = media.describe(docs)
    lists = d.select("media", "parts")
    shared = media.shared_chunks(lists, part)
    assert (shared.count() > 0) == (part < 9)
    files = {bytes(r.media): bytes(r.file) for r in media.restore(lists, media.chunk_store(docs, shared), shared).collect()}
    for r in d.collect():
        p = media.payload_of(texts[r.id] or "")
        assert files[bytes(r.media)] == media.header(len(p)) + p
    assert len(files) == len({media.payload_of(t or "") for t in texts})
