"""Operators on clinical and personal text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import phi
from spanloom.runtime import row_batches, small, spread

# Relations as (expression, type, base confidence).
RELATIONS = [
    (r"(?i)(\w+(?: \w+)*) (?:is treated with|can be treated with|treated by|managed with) (\w+(?: \w+)*)", "TREATED_BY", 0.9),
    (r"(?i)(\w+(?: \w+)*) (?:treatment includes|therapy includes) (\w+(?: \w+)*)", "TREATED_BY", 0.8),
    (r"(?i)(\w+(?: \w+)*) (?:responds to|improves with) (\w+(?: \w+)*)", "TREATED_BY", 0.7),
    (r"(?i)(\w+(?: \w+)*) (?:is monitored with|monitored by|followed with) (\w+(?: \w+)*)", "MONITORED_BY", 0.9),
    (r"(?i)(\w+(?: \w+)*) (?:requires monitoring with|monitoring includes) (\w+(?: \w+)*)", "MONITORED_BY", 0.8),
    (r"(?i)(\w+(?: \w+)*) (?:tracked with|assessed with) (\w+(?: \w+)*)", "MONITORED_BY", 0.7),
    (r"(?i)(\w+(?: \w+)*) (?:is contraindicated in|contraindicated for|should not be used in) (\w+(?: \w+)*)", "CONTRAINDICATES", 0.9),
    (r"(?i)(\w+(?: \w+)*) (?:is not recommended for|avoid in) (\w+(?: \w+)*)", "CONTRAINDICATES", 0.8),
    (r"(?i)(\w+(?: \w+)*) (?:may worsen|can exacerbate) (\w+(?: \w+)*)", "CONTRAINDICATES", 0.7),
    (r"(?i)(\w+(?: \w+)*) (?:causes|may cause|can cause) (\w+(?: \w+)*)", "ADVERSE_EVENT", 0.9),
    (r"(?i)(\w+(?: \w+)*) (?:side effects include|adverse effects include) (\w+(?: \w+)*)", "ADVERSE_EVENT", 0.8),
    (r"(?i)(\w+(?: \w+)*) (?:is associated with|linked to) (\w+(?: \w+)*) (?:as side effect|as adverse event)", "ADVERSE_EVENT", 0.7),
]


def _rows(rows: DataFrame, text: str, each, schema: str) -> DataFrame:
    """Batches through ``each(text)``, which yields rows; null and empty texts give none."""
    key = [c for c in rows.columns if c != text][0]
    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, {schema}"
    return spread(rows.select(key, text)).mapInArrow(row_batches(key, text, each, kinds), kinds)


def findings(rows: DataFrame, text: str = "text") -> DataFrame:
    """(key, start, end, kind, value) of personal data."""
    return _rows(rows, text, lambda t: [(a, b, k, t[a:b]) for a, b, k in phi.find(t)], "start int, end int, kind string, value string")


def redacted(rows: DataFrame, text: str = "text", patient: str | None = None, redact: tuple[str, ...] = (), shift: bool = True, surrogates: bool = True) -> DataFrame:
    """(key, redacted) of every row; a null text stays null, an empty one empty."""
    some = frozenset(redact)
    key = [c for c in rows.columns if c != text][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, text):
            new = [t and phi.redact(t, patient, some, shift, surrogates) for t in (x.as_py() for x in b.column(text))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(new, pa.string())], names=[key, "redacted"])

    return spread(rows.select(key, text)).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, redacted string")


def relations(rows: DataFrame, text: str = "text", least: float = 0.7) -> DataFrame:
    """(key, source, target, type, confidence, context): confidence is .1 higher for matches of over five words and lower under three.

    An expression matches word characters and spaces only, so it is tried on each run of these that holds one of its phrases, which are found in one pass, and not from every place of the text.
    """
    phrases = lambda p: [re.compile("(?i)" + x) for x in re.findall(r"\(\?:([^?)]*)\)(?!\*)", p)]
    compiled = [(kind, base, re.compile(p), phrases(p)) for p, kind, base in RELATIONS]
    runs = re.compile(r"[\w ]+")

    def each(t: str):
        parts = runs.findall(t)
        for kind, base, p, held in compiled:
            for m in (m for x in parts if all(h.search(x) for h in held) for m in p.finditer(x)):
                n = len(m[0].split())
                c = min(1.0, max(0.0, base + (0.1 if n > 5 else -0.1 if n < 3 else 0.0)))
                if c >= least:
                    yield m[1].strip(), m[2].strip(), kind, c, m[0]

    return _rows(rows, text, each, "source string, target string, type string, confidence double, context string")


def sections(notes: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, section, start_line, end_line, content): a line that is a known header, with a colon or in short capitals, starts a section."""
    lines = notes.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    t = F.trim("line")
    name = phi.section_of(t)
    capital = (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) < 40)
    header = F.when((t.endswith(":") | capital) & name.isNotNull(), name)
    w = W.partitionBy(key).orderBy("n")
    x = lines.withColumn("_h", header).withColumn("_s", F.count("_h").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = x.groupBy(key, "_s").agg(
        F.coalesce(F.max("_h"), F.lit("unknown")).alias("section"), F.min("n").alias("start_line"), F.max("n").alias("end_line"),
        F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct("n", "line")))).alias("_l"),
    )
    return g.filter(F.size("_l") > 0).select(key, "section", "start_line", "end_line", F.array_join(F.transform("_l", lambda r: r["line"]), "\n").alias("content"))


def items(notes: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, section, kind, name, value): medications, labs and diagnoses of the sections that list them."""
    s = sections(notes, key, text).filter(F.col("section").isin("medications", "labs", "assessment", "impression"))
    line = s.select(key, "section", F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.trim("line")).filter("line <> ''")
    lab = r"^([A-Za-z]+)[:\s]+(\d+(?:\.\d+)?)(?:\s+([A-Za-z/%]+))?$"
    kind = F.when((F.col("section") == "medications") & F.col("line").rlike(r"\S\s+\S"), "medication").when((F.col("section") == "labs") & F.col("line").rlike(lab) & ~F.lower(F.regexp_extract("line", lab, 1)).isin("am", "pm"), "lab").when(F.col("section").isin("assessment", "impression"), "diagnosis")
    name = F.when(kind == "medication", F.regexp_extract("line", r"^(\S+)", 1)).when(kind == "lab", F.regexp_extract("line", lab, 1)).otherwise(F.regexp_replace("line", r"^[- ]+|[- ]+$", ""))
    value = F.when(kind == "lab", F.expr("try_cast(regexp_extract(line, '(\\\\d+(?:\\\\.\\\\d+)?)', 1) AS double)"))
    return line.select(key, "section", kind.alias("kind"), name.alias("name"), value.alias("value")).filter("kind IS NOT NULL AND name <> ''")


def two_stage(docs: DataFrame, parts: DataFrame, top_docs: int = 50, tail_docs: int = 3, k: int = 10) -> DataFrame:
    """(query_id, doc, part, score): best sections of the best documents, and the assessment and plan of the very best ones in any case."""
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    d = docs.withColumn("_d", n).filter(F.col("_d") <= top_docs).select("query_id", "doc", "_d")
    s = parts.join(d, ["query_id", "doc"])
    m = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc", "part"))
    best = s.withColumn("_m", m).filter((F.col("_m") <= k) | (F.col("section").isin("assessment", "plan") & (F.col("_d") <= tail_docs)))
    return best.select("query_id", "doc", "part", "score")
