import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline as p
from spanloom.llm import bpe
from tests.llm import test_lines, test_mixing, test_neardup

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    rows = {0: docs.collect()}
    for i, (name, stage) in enumerate(p.STAGES):
        docs = p.write_once(stage(spark, docs, SF), "t")
        assert i == 4 or docs.columns == columns, name
        rows[i + 1] = docs.collect()
    good = [r for r in rows[0] if labels.get(r.doc_id) == 1]
    kept = {r.doc_id for r in rows[1]}
    assert sum(r.doc_id in kept for r in good) > 0.95 * len(good) and len(kept) < len(rows[0])
    want = test_lines.brute([(r.doc_id, r.text, r.source) for r in rows[1]], sites=10, least=1)
    assert sorted(((r.doc_id, r.text) for r in rows[2]), key=str) == want
    root = test_neardup.brute([r.text for r in rows[2]])
    first = defaultdict(list)
    for r, x in zip(rows[2], root, strict=True):
        first[x].append(r.doc_id)
    assert sorted(r.doc_id for r in rows[3]) == sorted(map(min, first.values()))
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows[3]}
    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r.source] += size[r.doc_id]
    for r in rows[4]:
        taken[r.source] += size[r.doc_id]
    for s, t in test_mixing.water(sizes).items():
        assert abs(taken[s] - t) <= max(size[r.doc_id] for r in rows[3] if r.source == s) / 2 + 1e-6
    text = {r.doc_id: r.text for r in rows[4]}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert r.n_tokens == len(enc.encode_ordinary(text[r.doc_id])) == len(r.ids) // 4
    assert Counter(map(str, p.run(spark, SF).select("doc_id", "n_tokens").collect())) == Counter(str(r) for r in spark.createDataFrame(rows[5]).select("doc_id", "n_tokens").collect())


def test_edge_cases_pass_every_stage(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing columns; and an empty table."""
    base = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 node", "2 l_key", "3 m_row", "4 slice", "5 id", "6 ids")
    kinds = base.schema
    odd = [(None, "a text without id " * 9, "en", "s1"), (9001, None, "en", "s1"), (9002, "", None, None), (9003, "twice the same row of text", "de", "s2"), (9003, "twice the same row of text", "de", "s2"), (9003, "another text of the same id", None, "s3"), (9004, "the long text is of many words " * 20_000, "en", "s1"), (9005, " \n\n ", "en", "s1")]
    docs = base.unionByName(spark.createDataFrame([(*r, None, 1, 2, 3, 4, 5, 6) for r in odd], kinds))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    d, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(p.STAGES):
        d = p.write_once(stage(spark, d, str(tmp_path)), "t")
        assert i == 4 or d.columns == docs.columns, name
        counts.append(d.count())
        ids = [r.doc_id for r in d.select("doc_id").collect()]
        if i == 0:
            assert ids.count(9001) == ids.count(9002) == ids.count(9005) == 1
        if i == 2:
            assert ids.count(9003) <= 2 and ids.count(9001) + ids.count(9002) == 1
        if i == 3:
            assert 9001 not in ids and 9002 not in ids and 9005 not in ids
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4] == p.run(spark, str(tmp_path)).count()
    empty = tmp_path / "empty"
    base.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert p.run(spark, str(empty)).collect() == []
