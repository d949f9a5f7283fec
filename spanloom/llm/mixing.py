"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its weight's share of all words, but at most ``most`` times its own words; what is above is
shared among the others by weight until none is above. Within a source, a document's expected copies are
``target / source size``, tilted towards longer documents by at most ``tilt`` so that the expected words still equal
the target. Whole expected copies are certain. For the rest, with inclusion odds ``p / (1 - p)``, documents are ranked
by ``random odds / inclusion odds`` (Pareto order) and taken in that order until the words still wanted are
reached; the last one is taken if that comes nearer. The random number is a hash of seed, id and text, so reruns agree.

The cut in a source's order is found without sorting the source: words are summed by 4096 steps of rank, then by 4096 steps of the step that
holds the cut; only what is in that one is sorted. What meets in one task is a row per step, or a 16-millionth of a source, and a row per source.

Defined results: null text counts zero words and takes none; a null source is a source, ordered last; null ids are
allowed; rows that agree in id, text and source are numbered, so that each has its own random number (which of them has which doesn't matter); a
very long text is one document and may move its source's words by half its size; an empty table gives an empty result. Other
columns are kept by ``mix`` as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.runtime import write_once

STEPS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _facts(id_col: str, text_col: str, source_col: str) -> list[Column]:
    same = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col), F.col(source_col).isNull(), F.col(source_col))
    return [F.col(source_col).alias("m_source"), n_words(F.col(text_col)).alias("m_size"), same.alias("m_same")]


def _repeated(docs: DataFrame, cols: tuple[str, str, str]) -> DataFrame:
    """(r_same) of the rows that agree with another in id, text and source."""
    rows = docs.select(_facts(*cols)[2])
    return write_once(rows.groupBy(F.col("m_same").alias("r_same")).agg(F.count("*").alias("n")).filter("n > 1").select("r_same"), "mixsame")


def _random(rows: DataFrame, repeated: DataFrame, seed: int) -> DataFrame:
    """Adds m_u, a number in (0, 1) from the seed, m_same and, of rows that repeat, their place among their equals.

    Places are counted within the tasks that read the rows, then a task's places start where the ones before it end: however often a row repeats, no window is
    larger than what one task has read.
    """
    u = lambda nth: ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "m_same", nth), 11).cast("double") + 0.5) / float(1 << 53)).alias("m_u")
    same = F.col("m_same") == F.col("r_same")
    once = rows.join(repeated, same, "left_anti").select("*", u(F.lit(0).cast("long")))
    more = write_once(rows.withColumn("m_task", F.spark_partition_id()).join(repeated, same, "left_semi"), "mixmore")
    task = more.groupBy("m_same", "m_task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("m_same").orderBy("m_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    task = task.select(F.col("m_same").alias("t_same"), F.col("m_task").alias("t_task"), before.alias("before"))
    nth = more.withColumn("m_nth", F.row_number().over(W.partitionBy("m_same", "m_task").orderBy("m_size")) - 1)
    nth = nth.join(task, (F.col("m_same") == F.col("t_same")) & (F.col("m_task") == F.col("t_task")))
    return once.unionByName(nth.select(*rows.columns, u((F.col("before") + F.col("m_nth")).cast("long"))))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, tilt: float = 0.25) -> DataFrame:
    """A row per source of (m_source, m_size, m_u): its weight, size and target, and how expected copies depend on size."""
    g = F.log1p("m_size")
    s = sized.groupBy("m_source").agg(
        F.sum("m_size").alias("m_source_size"), F.sum(g * F.col("m_size")).alias("gs"), F.min(F.when(F.col("m_size") > 0, g)).alias("g0"), F.max(F.when(F.col("m_size") > 0, g)).alias("g1")
    )
    # from here on there is one row per source
    rank = F.row_number().over(W.orderBy(F.col("m_source").asc_nulls_last()))
    s = s.withColumn("m_weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (most * F.col("m_source_size")).cast("double")).withColumn("all", F.sum("m_source_size").over(W.partitionBy()).cast("double"))
    fill = W.orderBy(F.col("cap") / F.col("m_weight"), F.col("m_source").asc_nulls_last())
    less = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", (F.col("all") - less) / F.sum("m_weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("full", F.col("cap") <= F.col("m_weight") * F.col("level"))
    s = s.withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = s.withColumn("m_target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("m_weight") * F.col("level"))))
    f = F.when(F.col("m_source_size") > 0, F.col("m_target") / F.col("m_source_size")).otherwise(0.0)
    mean = F.when(F.col("m_source_size") > 0, F.col("gs") / F.col("m_source_size")).otherwise(0.0)
    s = s.withColumn("m_f", f).withColumn("m_mean", mean)
    spread = F.greatest(F.col("g1") - F.col("m_mean"), F.col("m_mean") - F.col("g0"), F.lit(0.0))
    slope = F.when((spread > 1e-9) & (F.col("m_f") > 0), F.least(F.lit(tilt), most / F.col("m_f") - 1) / spread).otherwise(0.0)
    return s.withColumn("m_slope", slope).select("m_source", "m_weight", "m_source_size", "m_target", "m_f", "m_mean", "m_slope")


def _expected(most: int) -> Column:
    e = F.col("m_f") * (1 + F.col("m_slope") * (F.log1p("m_size") - F.col("m_mean")))
    return F.least(F.greatest(e, F.lit(0.0)), F.lit(float(most)))


def _ranked(sized: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Adds m_whole (certain copies), m_q (Pareto rank, null without a chance of one more copy), m_step and m_fine, the step within it."""
    d = sized.join(plan.withColumnRenamed("m_source", "p_source"), F.col("m_source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    e = _expected(most)
    d = d.withColumn("m_whole", F.floor(e)).withColumn("m_p", e - F.floor(e))
    q = (F.col("m_u") / (1 - F.col("m_u"))) * ((1 - F.col("m_p")) / F.col("m_p"))
    d = d.withColumn("m_q", F.when((F.col("m_p") > 0) & (F.col("m_size") > 0), q))
    at = F.col("m_q") / (1 + F.col("m_q")) * STEPS
    return d.withColumn("m_step", F.floor(at)).withColumn("m_fine", F.floor((at - F.floor(at)) * STEPS))


def cuts(sized: DataFrame, plan: DataFrame, most: int = 3) -> DataFrame:
    """A row per source: the last step, step within it and rank that are taken beyond certain copies."""
    d = _ranked(sized, plan, most)
    source, by = "m_source", W.partitionBy("m_source")
    at = lambda s, step: s.filter("before < want").groupBy(source).agg(F.max(F.struct(step, "before", "want")).alias("x"))
    same = lambda: F.col(source).eqNullSafe(F.col("c_source"))
    steps = d.groupBy(source, "m_step").agg(F.sum("m_size").alias("words"), F.sum(F.col("m_whole") * F.col("m_size")).alias("whole"), F.first("m_target").alias("target"))
    steps = steps.withColumn("want", F.col("target") - F.sum("whole").over(by)).filter("m_step IS NOT NULL")
    steps = steps.withColumn("before", F.sum("words").over(by.orderBy("m_step")) - F.col("words"))
    coarse = write_once(at(steps, "m_step").select(F.col(source).alias("c_source"), F.col("x.m_step").alias("c_step"), F.col("x.before").alias("base"), F.col("x.want").alias("want")), "mixcut")
    fine = d.join(coarse, same() & (F.col("m_step") == F.col("c_step"))).groupBy(source, "m_fine", "base", "want").agg(F.sum("m_size").alias("words"))
    fine = fine.withColumn("before", F.col("base") + F.sum("words").over(by.orderBy("m_fine")) - F.col("words"))
    fine = at(fine, "m_fine").select(F.col(source).alias("f_source"), F.col("x.m_fine").alias("c_fine"), F.col("x.before").alias("before"))
    cut = write_once(coarse.join(fine, F.col("c_source").eqNullSafe(F.col("f_source"))).select("c_source", "c_step", "c_fine", "before", "want"), "mixcut")
    edge = d.select(source, "m_step", "m_fine", "m_q", "m_size").join(cut, same() & (F.col("m_step") == F.col("c_step")) & (F.col("m_fine") == F.col("c_fine")))
    run = F.sum("m_size").over(W.partitionBy("c_source").orderBy("m_q", "m_size").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("mid", F.col("before") + run - F.col("m_size") / 2).filter("mid <= want")
    last = edge.groupBy(F.col("c_source").alias("l_source")).agg(F.max("m_q").alias("c_q"))
    return cut.join(last, F.col("c_source").eqNullSafe(F.col("l_source")), "left").select("c_source", "c_step", "c_fine", F.coalesce("c_q", F.lit(-1.0)).alias("c_q"))


def _decided(sized: DataFrame, plan: DataFrame, cut: DataFrame, most: int) -> DataFrame:
    d = _ranked(sized, plan, most).join(cut, F.col("m_source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    step, fine = (F.col("m_step") == F.col("c_step")), (F.col("m_fine") == F.col("c_fine"))
    more = (F.col("m_step") < F.col("c_step")) | (step & (F.col("m_fine") < F.col("c_fine"))) | (step & fine & (F.col("m_q") <= F.col("c_q")))
    return d.withColumn("m_copies", (F.col("m_whole") + F.when(more, 1).otherwise(0)).cast("long"))


def _plan(docs: DataFrame, seed: int, most: int, weights: tuple[int, ...], cols: tuple[str, str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    repeated = _repeated(docs, cols)
    sized = write_once(_random(docs.select(F.col(cols[0]).alias("m_id"), *_facts(*cols)), repeated, seed), "mixsize")
    plan = write_once(targets(sized, weights, most), "mixplan")
    return repeated, sized, plan, write_once(cuts(sized, plan, most), "mixcuts")


def allocate(docs: DataFrame, seed: int = 7, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document: its size, its source's size and target, and the words that the mix takes of it."""
    _, sized, plan, cut = _plan(docs, seed, most, weights, (id_col, text_col, source_col))
    d = _decided(sized, plan, cut, most)
    return d.select(F.col("m_id").alias(id_col), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_copies") * F.col("m_size")).alias("taken"), F.col("m_copies").alias("copies"))


def mix(docs: DataFrame, seed: int = 7, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each copy."""
    repeated, _, plan, cut = _plan(docs, seed, most, weights, (id_col, text_col, source_col))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"), *_facts(id_col, text_col, source_col))
    d = _decided(_random(row, repeated, seed), plan, cut, most).filter("m_copies > 0")
    return d.select("m_row", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int")))).select("m_row.*")
