"""The tool surface in SQL: table functions over the engine's tables.

``where_used``, ``lineage``, ``neighbours`` and ``rag_stats`` are SQL functions: the planner puts them into the query that calls them, so that a call with ``LATERAL`` over a table of
symbols is one join. ``first_of`` and ``take_budget`` are functions of a table: they ask for the partitioning and order they need, and stop reading a partition when they are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from spanloom.operators import graph

EDGE_TYPES = ["CALLS", "USES", "READS", "WRITES", "EXTENDS", "IMPORTS"]

_FIRST = """CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked STRING, n INT) RETURNS TABLE (path STRING, rank INT) RETURN
SELECT path, r FROM (SELECT u.path, row_number() OVER (PARTITION BY u.key ORDER BY u.path) AS r FROM {view} u WHERE u.key = asked) WHERE r <= n"""

_NEIGHBOURS = """CREATE OR REPLACE TEMPORARY FUNCTION neighbours(asked STRING, n INT) RETURNS TABLE (direction STRING, type STRING, id STRING, rank INT) RETURN
SELECT direction, type, id, r FROM (
  SELECT 'in' AS direction, e.type, e.src AS id, row_number() OVER (PARTITION BY e.dst ORDER BY e.src, e.type) AS r FROM {edges} e WHERE e.dst = asked
  UNION ALL
  SELECT 'out' AS direction, e.type, e.dst AS id, row_number() OVER (PARTITION BY e.src ORDER BY e.dst, e.type) AS r FROM {edges} e WHERE e.src = asked)
WHERE r <= n"""

_STATS = """CREATE OR REPLACE TEMPORARY FUNCTION rag_stats() RETURNS TABLE (what STRING, n BIGINT) RETURN
SELECT 'nodes' AS what, count(*) AS n FROM {nodes} UNION ALL SELECT 'edges', count(*) FROM {edges} UNION ALL SELECT e.type, count(*) FROM {edges} e GROUP BY e.type"""


def register(spark: SparkSession, nodes: DataFrame, edges: DataFrame, prefix: str = "rag", types: list[str] = EDGE_TYPES) -> None:
    """The functions over nodes (id, name, kind, path) and edges (src, dst, type), which become views named by the prefix.

    A null or unknown symbol has no rows; ties are by name; a symbol that is asked twice is answered twice.
    """
    views = {"nodes": nodes, "edges": edges, "used_by": graph.user_files(nodes, edges, types), "made_of": graph.user_files(nodes, edges, types, callee=True)}
    name = {k: f"{prefix}_{k}" for k in views}
    for k, v in views.items():
        v.createOrReplaceTempView(name[k])
    spark.sql(_FIRST.format(name="where_used", view=name["used_by"]))
    spark.sql(_FIRST.format(name="lineage", view=name["made_of"]))
    spark.sql(_NEIGHBOURS.format(**name))
    spark.sql(_STATS.format(**name))
    spark.udtf.register("first_of", udtf(FirstOf))
    spark.udtf.register("take_budget", udtf(TakeBudget))


def _table(arg: AnalyzeArgument, *names: str | None) -> StructType:
    if not arg.isTable:
        raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ...)")
    missing = [n for n in names if n not in arg.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(map(str, missing))}")
    return arg.dataType


def _literal(arg: AnalyzeArgument, what: str):
    if not arg.isConstantExpression or arg.value is None:
        raise ValueError(f"{what} is a literal that is not null")
    return arg.value


class FirstOf:
    """``first_of(TABLE(t), key, sorted_by, n)``: the first n rows of every key, and their rank. It partitions and sorts by itself; only n rows of a key are read."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, sorted_by: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        k, s = _literal(key, "key"), _literal(sorted_by, "sorted_by")
        if _literal(n, "n") < 1:
            raise ValueError("n is at least 1")
        schema = StructType(list(_table(rows, k, s).fields)).add("rank", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(k)], orderBy=[OrderingColumn(s)])

    def __init__(self) -> None:
        self.seen = 0

    def eval(self, rows, key, sorted_by, n):
        self.seen += 1
        if self.seen > n:
            raise SkipRestOfInputTableException("enough rows")
        yield (*rows, self.seen)


class TakeBudget:
    """``take_budget(TABLE(t) PARTITION BY ... ORDER BY ..., cost, budget)``: rows of a partition, in order, until a column's sum would pass the budget, and the sum so far. A null cost counts as 0."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, cost: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        _literal(budget, "budget")
        return AnalyzeResult(StructType(list(_table(rows, _literal(cost, "cost")).fields)).add("spent", LongType()))

    def __init__(self) -> None:
        self.spent = 0

    def eval(self, rows, cost, budget):
        self.spent += rows[cost] or 0
        if self.spent > budget:
            raise SkipRestOfInputTableException("the budget is spent")
        yield (*rows, self.spent)
