"""Lines of texts as a source, and snippets around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grep(files: DataFrame, pattern: str, text: str = "text", keep: bool = False) -> DataFrame:
    """(other columns, line_no from 1, line) of the lines that match; with ``keep`` also the text itself."""
    rest = [c for c in files.columns if keep or c != text]
    lines = files.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "line"))
    return lines.filter(F.col("line").rlike(pattern)).withColumn("line_no", F.col("_pos") + 1).drop("_pos")


def snippet(text: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines [start - context, end + context] of a text, clamped."""
    lines = F.split(text, "\n")
    a = F.greatest(start - context, F.lit(1))
    b = F.least(end + context, F.size(lines))
    return F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")
