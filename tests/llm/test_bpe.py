import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spanloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "Hello world, it's 1234 o'clock!", "éàü ñandú 日本語 🙂🙂", "\r\n\t  x  y\x1cz", "a" * 3000,
    "".join(map(chr, range(32, 900))), "<|endoftext|> the the", "abc" * 700 + " " * 50 + "\n" * 9, "é" * 40,
]


@pytest.fixture(scope="module")
def reference():
    v = bpe.Vocabulary.load(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_ids_and_round_trip(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "x")], "doc_id long, text string, ids string")
    got = bpe.encode(docs, PATH, PATTERN, decode=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = reference.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == text.encode()
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert sorted(r.text for r in back if r.doc_id is not None and r.doc_id > 3) == sorted(TEXTS[4:])


def test_digest_equals_library(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digest(docs, PATH, PATTERN).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_small_cache_changes_nothing(reference):
    v = bpe.Vocabulary.load(PATH)
    e = bpe.Encoder(v, PATTERN, cache=3)
    for t in ("one two three four five", "five six seven", "one"):
        assert np.frombuffer(e([t])[0], "<u4").tolist() == reference.encode_ordinary(t)
