"""The tool surface: an engine over a set of tables, whose tools return DataFrames, and the ingest cycle as one driver program."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.classify import match_order, route, summary_quality
from spanloom.operators import chunking, embed, enrich, graph, search
from spanloom.plans.base import span_hash
from spanloom.runtime import write_once


@dataclass
class Engine:
    """files (id, path, lang, text), spans (id, path, symbol, kind, start_line, end_line, span_hash, text), enrichments (span_hash, summary),
    nodes (id, name, kind, path), edges (src, dst, type), vectors (id, vector)."""

    spark: SparkSession
    files: DataFrame
    spans: DataFrame
    enrichments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id int, text string")

    def rag_search(self, query: str, limit: int = 10) -> DataFrame:
        """Full-text hits, reranked: (id, path, symbol, score, rank)."""
        s = self.spans.join(self.enrichments.select("span_hash", "summary"), "span_hash", "left")
        d = s.select("id", F.concat_ws(" ", "symbol", "summary", "path", "text").alias("text"))
        st = d.select(F.size(search.tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("c"), F.avg("n").alias("a")).first()
        h = search.bm25(search.postings(d), self._query(query), st["c"], st["a"] or 1.0).select("id", "bm25")
        r = search.rerank(h.join(self.spans.select("id", "path", "symbol", "text"), "id").withColumn("query", F.lit(query)))
        return search.top(r.withColumn("q", F.lit(0)), ["q"], limit, F.desc("rerank"), F.col("id")).select("id", "path", "symbol", F.col("rerank").alias("score"), "rank")

    def rag_query(self, vector: list[float], limit: int = 10) -> DataFrame:
        """Nearest vectors by cosine: (id, score)."""
        from spanloom.functions.vectors import cosine

        q = F.array(*[F.lit(float(x)) for x in vector])
        return self.vectors.select("id", cosine(F.col("vector"), q).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    def rag_search_enriched(self, query: str, limit: int = 10) -> DataFrame:
        """Hits with their summaries and graph neighbours."""
        h = self.rag_search(query, limit).withColumn("query_id", F.lit(0))
        x = search.expand(h.select("query_id", "rank", "path", "symbol", "score"), graph.user_files(self.nodes, self.edges, self.types()))
        s = self.spans.join(self.enrichments, "span_hash").groupBy("path").agg(F.min("summary").alias("summary"))
        return x.drop("query_id").join(s, "path", "left")

    def types(self) -> list[str]:
        return ["CALLS", "USES", "READS", "WRITES", "EXTENDS", "IMPORTS"]

    def rag_where_used(self, symbol: str, limit: int = 50) -> DataFrame:
        return graph.where_used(graph.user_files(self.nodes, self.edges, self.types()), self.spark.createDataFrame([(symbol,)], "symbol string"), limit)

    def rag_lineage(self, symbol: str, downstream: bool = True, limit: int = 50) -> DataFrame:
        return graph.where_used(graph.user_files(self.nodes, self.edges, self.types(), callee=downstream), self.spark.createDataFrame([(symbol,)], "symbol string"), limit)

    def inspect(self, symbol: str, limit: int = 5) -> DataFrame:
        """Best matching nodes and how many edges go in and out."""
        i, o = (self.edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(n)) for c, n in (("dst", "n_in"), ("src", "n_out")))
        m = match_order(self.nodes, symbol).limit(limit)
        return match_order(m.drop("score").join(i, "id", "left").join(o, "id", "left").fillna(0, ["n_in", "n_out"]), symbol)

    def read_symbol(self, symbol: str) -> DataFrame:
        """(path, symbol, source): the lines of the spans of a symbol."""
        from spanloom.sources.grep import snippet

        s = self.spans.filter(F.col("symbol") == symbol).select("path", "symbol", "start_line", "end_line")
        return s.join(self.files.select("path", "text"), "path").select("path", "symbol", snippet(F.col("text"), F.col("start_line"), F.col("end_line")).alias("source"))

    def rag_stats(self) -> DataFrame:
        n = lambda d, name: d.agg(F.count("*").alias(name))
        return n(self.files, "files").crossJoin(n(self.spans, "spans")).crossJoin(n(self.enrichments, "enrichments")).crossJoin(n(self.nodes, "nodes")).crossJoin(n(self.edges, "edges"))  # one row each

    def rag_plan(self, query: str, limit: int = 5) -> DataFrame:
        s = self.spans.join(self.enrichments.select("span_hash", "summary"), "span_hash", "left")
        p = search.plan_scores(s.select("id", "symbol", "path", "summary"), self._query(query), ["symbol", "path", "summary"], limit)
        return search.top(p, ["query_id"], limit, F.desc("score"), F.col("id")).drop("query_id")

    def route(self, query: str) -> DataFrame:
        r = route(F.col("text"))
        return self._query(query).select(r["route"].alias("route"), r["confidence"].alias("confidence"))

    def register(self) -> None:
        """The tables as SQL views, and a table function over span extraction."""
        for name in ("files", "spans", "enrichments", "nodes", "edges"):
            getattr(self, name).createOrReplaceTempView(name)
        from pyspark.sql.functions import udtf

        @udtf(returnType="symbol string, kind string, start_line int, end_line int")
        class ExtractSpans:
            def eval(self, text: str):
                for s, k, a, b, _ in chunking.python_spans(text or ""):
                    yield s, k, a, b

        self.spark.udtf.register("extract_spans", ExtractSpans)


def store_result(df: DataFrame) -> str:
    """A handle for a result, which is kept in the shared folder."""
    name = f"result_{uuid.uuid4().hex[:12]}"
    write_once(df, name).createOrReplaceTempView(name)
    return name


def load_result(spark: SparkSession, handle: str, order: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return spark.table(handle).orderBy(order).offset(offset).limit(limit)


def cycle(spark: SparkSession, files: DataFrame, language: Callable, model: Callable[[], list] | None = None) -> tuple[Engine, DataFrame]:
    """Sync, enrich, embed, check and graph of files (id, path, text), each step from the written result of the last; (engine, health)."""
    f = files.withColumn("lang", language(F.col("path")))
    s = chunking.spans(f.withColumn("lang", F.coalesce("lang", F.lit("text"))), "path")
    s = s.join(f.select("path", "lang", F.split("text", "\n").alias("lines")), "path")
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    s = s.select("path", "symbol", "kind", "start_line", "end_line", body.alias("text"), span_hash(F.coalesce("lang", F.lit("text")), body).alias("span_hash"))
    s = write_once(s.withColumn("id", F.xxhash64("path", "start_line", "symbol")), "spans")
    e = write_once(enrich.cascade(s.dropDuplicates(["span_hash"]), model or (lambda: [("offline", enrich.offline)])).filter("summary IS NOT NULL").select("span_hash", "summary"), "enriched")
    v = write_once(embed.hash_vectors(s, "id", 64), "vectors")
    modules = f.filter("lang = 'python'").withColumn("module", F.replace(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit("/"), F.lit(".")))
    g = write_once(chunking.schema_graph(modules).join(modules.select("module", "path"), "module"), "graph")
    nodes = g.filter("what = 'entity'").select(F.col("a").alias("id"), F.regexp_replace("a", "^[a-z]+:", "").alias("name"), F.col("edge").alias("kind"), "path")
    edges = g.filter("what = 'relation'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("edge").alias("type"))
    health = e.groupBy(summary_quality(F.col("summary")).alias("quality")).agg(F.count("*").alias("n"))
    return Engine(spark, f, s, e, nodes, edges, v), health
