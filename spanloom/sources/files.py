"""JSON, JSONL, TSV, YAML and CSV sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "nodes array<map<string,string>>, vertices array<map<string,string>>, entities string, edges array<map<string,string>>, links array<map<string,string>>, relations array<map<string,string>>, schema_graph string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; corrupt lines are in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, doc_id, grade) of a graded set with judgments."""
    q = spark.read.schema("queries array<struct<query_id:string,text:string,judgments:array<struct<doc_id:string,score:double>>>>, query_id string, text string, judgments array<struct<doc_id:string,score:double>>").option("multiLine", True).json(path)
    q = q.select(F.explode(F.coalesce("queries", F.array(F.struct("query_id", "text", "judgments")))).alias("q"))
    return q.select("q.query_id", "q.text", F.explode_outer("q.judgments").alias("j")).select("query_id", "text", "j.doc_id", F.col("j.score").alias("grade"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, value) of a two-level YAML mapping of scalars; read on the driver, as it is configuration."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows, name = [], None
    for line in text.splitlines():
        if m := re.match(r"^(\S[^:#]*):\s*$", line):
            name = m[1].strip()
        elif name and (m := re.match(r"^\s+([^:#]+):\s*(.*?)\s*$", line)):
            rows.append((name, m[1].strip(), m[2].strip("\"'")))
    return spark.createDataFrame(rows, "name string, key string, value string")


def graph_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind, path) and edges (src, dst, type) of a graph file: nodes, vertices or entities; edges, links or relations; wrapped or not."""
    g = spark.read.schema(GRAPH).option("multiLine", multi_line).json(path)
    inner = F.from_json("schema_graph", GRAPH)
    names = [c.strip().split(" ")[0] for c in GRAPH.replace("map<string,string>", "m").split(",")]
    g = g.select(*[F.coalesce(inner[n], F.col(n)).alias(n) if n != "schema_graph" else F.lit(None).alias(n) for n in names])
    as_map, as_list = F.from_json("entities", "map<string,map<string,string>>"), F.from_json("entities", "array<map<string,string>>")
    listed = F.transform(F.map_entries(as_map), lambda e: F.map_concat(F.map_filter(e["value"], lambda k, _: k != "id"), F.create_map(F.lit("id"), e["key"])))
    n = g.select(F.explode(F.coalesce("nodes", "vertices", as_list, listed)).alias("n"))
    e = g.select(F.explode(F.coalesce("edges", "links", "relations")).alias("e"))
    one = lambda m, *ks: F.coalesce(*[F.col(m)[k] for k in ks])
    ident = one("n", "id", "name", "symbol")
    nodes = n.select(ident.alias("id"), one("n", "name", "label", "id").alias("name"), F.coalesce(one("n", "kind", "type"), F.lit("unknown")).alias("kind"), one("n", "file_path", "path", "file").alias("path"))
    edges = e.select(one("e", "src", "source", "from").alias("src"), one("e", "dst", "target", "to").alias("dst"), F.upper(F.coalesce(one("e", "edge", "type", "relation"), F.lit("RELATED"))).alias("type"))
    return nodes, edges.filter("src IS NOT NULL AND dst IS NOT NULL")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def training_examples(rows: DataFrame, *columns: str) -> DataFrame:
    """(value): a JSON object per row, for ``write.text``."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def ontology(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(ontology, code, term) of JSON dictionaries code -> term."""
    out = None
    for n in names:
        t = spark.read.text(f"{folder}/{n}.json", wholetext=True).select(F.lit(n).alias("ontology"), F.explode(F.from_json("value", "map<string,string>")).alias("code", "term"))
        out = t if out is None else out.unionByName(t)
    return out
