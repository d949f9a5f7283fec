"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by (partial) aggregation, so a
line that is everywhere costs a sketch per map task. Lines whose estimate is clearly above the threshold are
boilerplate; lines near it get an exact distinct count, over their occurrences only; lines below are kept. All documents then
lose their boilerplate lines, but for one: each such line stays where it occurs first (in the document with the smallest id), so that
no content leaves the corpus, not that of a document which many sites copy either.

What comes back to a document is the positions of its boilerplate lines, by the hash of its text: copies of a text share them, and
repeated or null ids are harmless. Lines are then picked by position, in time linear in the text.

Defined results: null text stays null and has no lines; lines are compared without spaces at their ends; lines shorter
than ``least_chars`` (empty ones, by default) are never boilerplate; a null site is no site, but a document without one may keep a line; of equal ids the
smallest text hash comes first, null ids come last; rows that repeat id and text keep or lose a line together; a text of which nothing stays is
empty; an empty table gives an empty result; other columns are kept, whatever their names. A line is known by its 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import discard, write_once

SITES, LEAST_CHARS = 10, 1


def _lines(docs: DataFrame, least_chars: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.xxhash64(text_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    return d.filter(F.length(F.trim("line")) >= least_chars).select("id", "site", "doc", "at", F.xxhash64(F.trim("line")).alias("h"))


def boilerplate(docs: DataFrame, sites: int = SITES, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", log2k: int = 12) -> DataFrame:
    """(h, first): hashes of the lines that occur on at least ``sites`` distinct sites, and (no: without id, id, doc: hash of the text) of their first document."""
    lines = _lines(docs, least_chars, id_col, text_col, site_col)
    error = 4 * 1.04 / (2 ** (log2k / 2))  # four standard errors of the sketch
    low, high = sites * (1 - error) - 1, sites * (1 + error) + 1
    s = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(log2k)).alias("s"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "doc")).alias("first"))
    s = write_once(s.select("h", F.hll_sketch_estimate("s").alias("n"), "first").filter(F.col("n") >= low), "linehll")
    near = s.filter(F.col("n") <= high).select("h")
    exact = lines.filter("site IS NOT NULL").select("h", "site").join(near, "h").groupBy("h").agg(F.count_distinct("site").alias("n")).filter(F.col("n") >= sites)
    flagged = write_once(s.filter(F.col("n") > high).select("h", "first").unionByName(s.join(exact.select("h"), "h").select("h", "first")), "lineset")
    discard(s)
    return flagged


def _marked(docs: DataFrame, sites: int, least_chars: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(l_row: all columns but the text, l_lines, l_hits: positions of boilerplate lines, l_gone: of those that go, l_new: the text that stays)."""
    flagged = boilerplate(docs, sites, least_chars, id_col, text_col, site_col)
    found = _lines(docs, least_chars, id_col, text_col, site_col).join(flagged, "h")
    mine = F.when((F.col("doc") == F.col("first.doc")) & F.col("id").eqNullSafe(F.col("first.id")), F.struct("id", "at"))
    hits = found.groupBy(F.col("doc").alias("h_doc")).agg(F.collect_set("at").alias("h_all"), F.collect_set(mine).alias("h_first"))  # bounded by a text's lines
    hits = write_once(hits, "linehits")
    discard(flagged)
    others = F.struct(F.lit(None).cast("string").alias("l_none"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    row = docs.select(others.alias("l_row"), F.col(id_col).alias("l_key"), F.xxhash64(text_col).alias("l_doc"), F.split(F.col(text_col), "\n").alias("l_lines"))
    d = row.join(hits.hint("merge"), (F.col("l_doc") == F.col("h_doc")) & F.col("l_lines").isNotNull(), "left")  # hits grow with the documents: no broadcast at any size
    first = F.transform(F.filter("h_first", lambda x: x["id"].eqNullSafe(F.col("l_key"))), lambda x: x["at"])
    d = d.select("l_row", "l_key", "l_lines", F.coalesce("h_all", F.array().cast("array<int>")).alias("l_hits"), F.array_except(F.coalesce("h_all", F.array().cast("array<int>")), F.coalesce(first, F.array().cast("array<int>"))).alias("l_gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("l_lines") - 1), "l_gone")
    new = F.when(F.size("l_gone") > 0, F.array_join(F.transform(stay, lambda i: F.col("l_lines")[i]), "\n")).otherwise(F.array_join("l_lines", "\n"))
    return d.withColumn("l_new", new)


def strip(docs: DataFrame, sites: int = SITES, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents without boilerplate lines; columns as in ``docs``, with n_chars, if there is one, of the new text."""
    d = _marked(docs, sites, least_chars, id_col, text_col, site_col)
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            x = F.col("l_new")
        elif c == "n_chars":
            x = F.when(F.size("l_gone") > 0, F.length("l_new").cast(kind)).otherwise(F.col("l_row")[c])
        else:
            x = F.col("l_row")[c]
        cols.append(x.alias(c))
    return d.select(*cols)


def report(docs: DataFrame, sites: int = SITES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """op8: a row per document: its lines, those that are boilerplate, whether it lost any, and what is left."""
    d = _marked(docs, sites, least_chars, "doc_id", "text", "source")
    return d.select(F.col("l_key").alias("doc_id"), F.coalesce(F.size("l_lines"), F.lit(0)).alias("n_lines"), F.size("l_hits").alias("n_boilerplate"), (F.size("l_gone") > 0).alias("stripped"), F.coalesce(F.length("l_new"), F.lit(0)).alias("n_left"), F.md5("l_new").alias("left_md5"))


REPORT_SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
f AS (SELECT trim(line) AS t, min(doc_id) AS holder FROM l WHERE length(trim(line)) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.*, f.t IS NOT NULL AS common, coalesce(f.holder <> l.doc_id, false) AS gone FROM l LEFT JOIN f ON trim(l.line) = f.t),
g AS (SELECT doc_id, count_if(common) AS n, bool_or(gone) AS cut, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(g.n, 0) AS INTEGER) AS n_boilerplate, coalesce(g.cut, false) AS stripped,
  CAST(coalesce(length(CASE WHEN d.text IS NOT NULL THEN g.kept END), 0) AS INTEGER) AS n_left, md5(CASE WHEN d.text IS NOT NULL THEN g.kept END) AS left_md5
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
