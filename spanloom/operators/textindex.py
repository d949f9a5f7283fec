"""A maintained inverted index of text fields, kept in a shared folder; no text is read to answer a query.

The index is a list of segments, the manifest names them. A segment holds postings in blocks (a term's documents of one class of impact, about BLOCK at a time, with the greatest
frequency and the least length in the block), the lengths of its documents, and tombstones: ids that it replaces or removes. A posting is live if no later segment
has a tombstone for its document. ``update`` adds a segment that holds changed documents only; ``merge`` writes the live postings as one. Manifests are numbered and never
overwritten, so that a writer that lost a race fails, and readers see one state.

Postings lie in folders by a hash of the term, so that a query reads the folders of its terms. The k best are found with the blocks' bounds: documents in the
best blocks of all of a query's terms give a score that the k-th best reaches at least, and blocks that can't reach it are never opened.

A term that all documents hold is dealt by blocks, not sorted by one task. Null and empty fields have no terms; null ids are left out; rows of a batch that repeat an id are one
document with the words of all, as long as the longest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import counts, tokens
from spanloom.operators.versions import Versioned
from spanloom.runtime import spread, write_once

BLOCK, BUCKETS = 128, 16
#: Postings that a task of a segment makes blocks of.
SLICE = 1 << 19
K1, B = 1.2, 0.75


def _part(tf: Column, length: Column, avg: Column) -> Column:
    """A term's share of bm25 without its idf; grows with ``tf`` and falls with ``length``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


class TextIndex(Versioned):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {"segments": [], "figures": {}, "buckets": BUCKETS, "note": ""})

    def _read(self, what: str) -> DataFrame | None:
        """A table of all segments, with the segment's number as ``seq``."""
        out = None
        for seq, name in self.manifest["segments"]:
            t = self.spark.read.parquet(f"{self.path}/{name}/{what}").withColumn("seq", F.lit(seq))
            out = t if out is None else out.unionByName(t)
        return out

    def tombstones(self) -> DataFrame:
        """(id, until): postings of segments before ``until`` are dead."""
        return self._read("gone").groupBy(F.col("id").alias("g_id")).agg(F.max("seq").alias("until"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, seq) that are live; the tombstones grow with what has changed since the last merge."""
        if len(self.manifest["segments"]) < 2:
            return rows
        j = rows.join(self.tombstones(), F.col("id") == F.col("g_id"), "left")
        return j.filter(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("g_id", "until")

    def documents(self) -> DataFrame:
        """(id, field, len) of the live documents."""
        return self._live(self._read("lengths")).drop("seq")

    def update(self, docs: DataFrame | None, fields: list[str], gone: DataFrame | None = None, id_col: str = "id", note: str = "") -> None:
        """Documents of ``docs`` (id and fields) come in or replace those with their ids; documents of ``gone`` (id) go."""
        spark, first = self.spark, not self.manifest["segments"]
        seq, name = self.version + 1, f"segment-{uuid.uuid4().hex[:12]}"
        empty = spark.createDataFrame([], "id long")
        d = docs.select(F.col(id_col).cast("long").alias("id"), *fields).filter("id IS NOT NULL") if docs is not None else None
        ids = (d.select("id") if d is not None else empty).unionByName(gone.select(F.col(id_col).cast("long").alias("id")) if gone is not None else empty)
        if first:
            ids = empty
        ids.distinct().write.parquet(f"{self.path}/{name}/gone")
        out = spark.read.parquet(f"{self.path}/{name}/gone")
        if d is None:
            d = spark.createDataFrame([], "id long, " + ", ".join(f"{f} string" for f in fields))
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields])).alias("x")
        t = spread(d).select("id", each).select("id", "x.field", tokens(F.col("x.text")).alias("t"))
        empty_term = F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf")))  # the empty term stands for the document
        counted = t.select("id", "field", F.size("t").cast("int").alias("len"), F.inline(F.concat(empty_term, counts(F.col("t"))))).select("field", "term", "id", "tf", "len")
        again = write_once(d.groupBy("id").count().filter("count > 1").select("id"), "again")  # words are counted within a row; only rows that repeat an id are put together
        if again.limit(1).count():
            both = counted.join(again, "id", "left_semi").groupBy("field", "term", "id").agg(F.sum("tf").cast("int").alias("tf"), F.max("len").alias("len"))
            counted = counted.join(again, "id", "left_anti").select("field", "term", "id", "tf", "len").unionByName(both)
        counted = write_once(counted, "counted")
        counted.filter("term = ''").select("id", "field", "len").write.parquet(f"{self.path}/{name}/lengths")
        impact = F.least(F.lit(24), F.floor(F.log2(F.col("tf") * 64 / (F.col("len") + 64)) * 2 + 12)).cast("int")  # a class of documents of like impact
        c = counted.filter("term <> ''").withColumn("impact", impact)
        c = c.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.manifest["buckets"])).cast("int"))
        self._write(c, f"{self.path}/{name}/postings")
        figures = dict(self.manifest["figures"])
        added = spark.read.parquet(f"{self.path}/{name}/lengths").groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()  # a row a field
        lost = [] if first else self.documents().join(out, "id", "left_semi").groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()
        for rows, sign in ((added, 1), (lost, -1)):
            for r in rows:
                n, total = figures.get(r["field"], (0, 0))
                figures[r["field"]] = [n + sign * r["n"], total + sign * (r["len"] or 0)]
        self.commit({**self.manifest, "segments": [*self.manifest["segments"], [seq, name]], "figures": figures, "note": note or self.manifest["note"]})

    def _write(self, c: DataFrame, path: str) -> None:
        """Written rows (bucket, field, term, impact, id, tf, len) as blocks, in tasks of about SLICE postings, however many there are."""
        many = c.groupBy("field", "term", "impact").agg(F.ceil(F.count("*") / BLOCK).alias("chunks")).filter("chunks > 1")
        c = c.join(write_once(many, "many"), ["field", "term", "impact"], "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))))
        slices = max(1, -(-c.count() // (SLICE * self.manifest["buckets"])))
        c = c.withColumn("slice", F.pmod(F.xxhash64("field", "term", "impact", "chunk"), F.lit(slices))).repartition(slices * self.manifest["buckets"], "bucket", "slice")
        item = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))  # about BLOCK items
        blocks = c.groupBy("bucket", "slice", "field", "term", "impact", "chunk").agg(item.alias("postings"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.count("*").alias("n"))
        blocks.drop("slice").sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(path)

    def merge(self) -> None:
        """All live postings and documents as one segment without tombstones; what it replaces stays for readers that began before."""
        name, seq = f"segment-{uuid.uuid4().hex[:12]}", self.version + 1
        p = self._read("postings").select("bucket", "field", "term", "impact", "chunk", "seq", F.explode("postings").alias("p")).select("bucket", "field", "term", "impact", "seq", "p.*")
        p = self._live(p).drop("seq")
        self._write(write_once(p, "live"), f"{self.path}/{name}/postings")
        self.documents().write.parquet(f"{self.path}/{name}/lengths")
        self.spark.createDataFrame([], "id long").write.parquet(f"{self.path}/{name}/gone")
        self.commit({**self.manifest, "segments": [[seq, name]]})

    def hits(self, queries: DataFrame, weights: dict[str, float], k: int | None = None, every: bool = True) -> DataFrame:
        """(query_id, id, score_pos, bm25): documents with all terms of a query (query_id, text), each in one of the fields (or, without ``every``, with one term). The
        score sums bm25 over fields and terms, by the fields' weights; with ``k``, at least each query's k best come out, by bounds."""
        spark = self.spark
        terms = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
        terms = terms.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.manifest["buckets"])).cast("int"))
        known = {f: w for f, w in weights.items() if f in self.manifest["figures"]}
        fields = spark.createDataFrame([(f, float(w), self.manifest["figures"][f][0], self.manifest["figures"][f][1] / max(1, self.manifest["figures"][f][0])) for f, w in known.items()], "field string, weight double, docs long, avg double")
        buckets = [r[0] for r in terms.select("bucket").distinct().collect()]  # at most as many as there are folders
        p = self._read("postings").filter(F.col("bucket").isin(buckets) & F.col("field").isin(list(known)))
        mine = p.join(terms.select("term").distinct(), "term", "left_semi")
        part = _part(F.col("max_tf"), F.col("min_len"), F.col("avg"))
        facts = mine.join(F.broadcast(fields), "field").groupBy("term", "field", "weight", "docs", "avg").agg(F.sum("n").alias("df"), F.max(part).alias("most"))  # a row a field
        if len(self.manifest["segments"]) > 1:  # bounds hold for dead postings too; counts don't
            flat = self._live(mine.select("term", "field", "seq", F.explode("postings").alias("p")).select("term", "field", "seq", F.col("p.id").alias("id")))
            facts = facts.drop("df").join(flat.groupBy("term", "field").agg(F.count("*").alias("df")), ["term", "field"])
        idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("weight")
        facts = write_once(facts.select("term", "field", idf.alias("idf"), "avg", (idf * F.col("most")).alias("most")), "facts")  # a row a query term and field
        q = terms.drop("bucket").join(facts, "term")
        q = write_once(q.withColumn("others", F.sum("most").over(W.partitionBy("query_id")) - F.col("most")).drop("most"), "terms")  # a query's terms
        asked = mine.select("term", "field", "seq", "impact", "chunk", "max_tf", "min_len", "postings").join(q, ["term", "field"]).withColumn("bound", F.col("idf") * part)
        if k is not None:
            block = ["query_id", "term", "field", "seq", "impact", "chunk"]
            best = W.partitionBy("query_id", "term", "field").orderBy(F.desc("bound"), "seq", "impact", "chunk")
            seeds = asked.select(*block, "bound").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= -(-k // BLOCK) + 1)  # without their postings
            seed = asked.join(write_once(seeds.select(*block), "seeds"), block, "left_semi")
            least = self._scores(seed, every).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score_pos")))).filter(F.col("place") == k)
            least = least.select(F.col("query_id").alias("l_id"), F.col("score_pos").alias("least"))
            least = write_once(least, "least")
            asked = asked.join(least, F.col("query_id") == F.col("l_id"), "left")
            asked = asked.filter(F.col("least").isNull() | (F.col("bound") + F.col("others") >= F.col("least") - 1e-4))
        return self._scores(asked, every).select("query_id", "id", "score_pos", (-F.col("score_pos")).alias("bm25"))

    def _scores(self, asked: DataFrame, every: bool) -> DataFrame:
        """(query_id, id, score_pos) of the live postings of opened blocks."""
        x = asked.select("query_id", "n_terms", "term", "idf", "avg", "seq", F.explode("postings").alias("p"))
        x = self._live(x.select("query_id", "n_terms", "term", "idf", "avg", "seq", "p.*"))
        part = F.col("idf") * _part(F.col("tf"), F.col("len"), F.col("avg"))
        t = x.groupBy("query_id", "n_terms", "id", "term").agg(F.sum(part).alias("part"))
        s = t.groupBy("query_id", "n_terms", "id").agg(F.sum("part").alias("score_pos"), F.count("*").alias("n"))
        return s.filter(F.col("n") == F.col("n_terms")) if every else s


def index_of(docs: DataFrame, path: str, fields: list[str], id_col: str = "id", note: str = "") -> TextIndex:
    """The index at ``path``, written from ``docs`` if there is none, or if it was made from something else than ``note`` says."""
    index = TextIndex(docs.sparkSession, path)
    if not index.version or note and index.manifest["note"] != note:
        index.manifest = {**index.manifest, "segments": [], "figures": {}}
        index.update(docs, fields, id_col=id_col, note=note)
    return index
