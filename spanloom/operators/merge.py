"""Writes as DataFrame transformations: each takes snapshots and returns the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (a total order makes it deterministic)."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_groups(old: DataFrame, new: DataFrame, group: str, key: str) -> DataFrame:
    """What replacing each group's keys does: (group, key, action) with keep, insert or delete.

    A group for which ``new`` has no rows is left alone, as an empty extraction is more likely an error.
    """
    o, n = old.select(group, key).distinct().withColumn("_o", F.lit(True)), new.select(group, key).distinct().withColumn("_n", F.lit(True))
    touched = n.select(group).distinct().withColumn("_t", F.lit(True))
    both = o.join(n, [group, key], "full").join(touched, group, "left")
    action = F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), "keep").when(F.col("_n").isNotNull(), "insert").when(F.col("_t").isNotNull(), "delete").otherwise("keep")
    return both.select(group, key, action.alias("action"))


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, children: list[tuple[DataFrame, str]], parent_id: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Parents without ``gone`` (by ``key``), and each (child, foreign key to ``parent_id``) table without the rows of removed parents."""
    kept = parents.join(gone.select(key), key, "left_anti")
    ids = kept.select(F.col(parent_id or key).alias("_k"))
    return kept, [c.join(ids, F.col(fk) == F.col("_k"), "left_semi") for c, fk in children]


def changes(cached: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """(path, status, hash): added, changed or deleted. Equal size and mtime within a millisecond reuse the cached hash.

    ``current`` has a lazily computed ``hash``; both have size and mtime.
    """
    a, b = cached.select(key, F.col("hash").alias("h0"), F.col("size").alias("s0"), F.col("mtime").alias("m0")), current.select(key, F.col("hash").alias("h1"), F.col("size").alias("s1"), F.col("mtime").alias("m1"))
    j = a.join(b, key, "full")
    same = (F.abs(F.col("m0") - F.col("m1")) < 0.001) & (F.col("s0") == F.col("s1"))
    h = F.when(same, F.col("h0")).otherwise(F.col("h1"))
    status = F.when(F.col("h0").isNull(), "added").when(F.col("m1").isNull(), "deleted").when(h != F.col("h0"), "changed").otherwise("same")
    return j.select(key, status.alias("status"), F.coalesce(h, "h0").alias("hash"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def patch_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with metadata merged (the patch wins), edges whose endpoints exist, and the conflicts (id, key)."""
    n, p = nodes.select("id", F.col("meta").alias("m0")), new_nodes.select("id", F.col("meta").alias("m1"))
    none = F.create_map().cast("map<string,string>")
    j = n.join(p, "id", "full").withColumn("m0", F.coalesce("m0", none)).withColumn("m1", F.coalesce("m1", none))
    merged = F.map_concat(F.map_filter("m0", lambda k, _: ~F.array_contains(F.map_keys("m1"), k)), "m1")
    out = j.select("id", merged.alias("meta"))
    differ = F.filter(F.map_keys("m1"), lambda k: F.array_contains(F.map_keys("m0"), k) & (F.element_at("m0", k) != F.element_at("m1", k)))
    conflicts = j.select("id", F.explode(differ).alias("key"))
    ids = out.select("id")
    e = edges.unionByName(new_edges).distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    return out, e, conflicts


def increment(meta: DataFrame, owners: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Meta rows (keys, key, value) with the counter ``name`` of every owner one higher; a missing one becomes 1."""
    old = meta.filter(F.col("key") == name).select(*keys, F.col("value").alias("_old"))
    new = owners.select(*keys).distinct().join(old, keys, "left").select(*keys, F.lit(name).alias("key"), (F.coalesce(F.col("_old").cast("long"), F.lit(0)) + 1).cast("string").alias("value"))
    return new.unionByName(meta.join(new.select(*keys, "key"), [*keys, "key"], "left_anti").select(*keys, "key", "value"))
