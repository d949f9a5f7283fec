"""Stores that are kept up to date by streams of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.plans.base import FILES, files
from spanloom.plans.catalog import register
from spanloom.runtime import scratch_dir, table, write_once
from spanloom.streaming import leases, state, sync
from spanloom.streaming.sources import parquet_stream


def line_spans(texts):
    """(path, pos, span_hash): a span per line of (path, text)."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("path", "pos", F.concat(F.lit("sha256:"), F.sha2("line", 256)).alias("span_hash"))


@register("stream_sync", "T-3 T-4 M16 T-1", f"""WITH {FILES},
f AS (SELECT path, CASE WHEN id % 3 = 0 THEN 'changed' || chr(10) || text ELSE text END AS text FROM files WHERE id % 7 <> 1),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM f)
SELECT path, CAST(pos AS INTEGER) AS pos, 'sha256:' || sha256(line) AS span_hash FROM l""")
def stream_sync(spark, sf):
    """A stream of changes in two batches: all files, then every third with a new text, every seventh gone, and others as they were; the second batch is played twice."""
    base = f"{scratch_dir(spark)}/sync-{uuid.uuid4().hex[:12]}"
    f = files(spark, sf).select("id", "path", "text")
    changed = F.when(F.col("id") % 3 == 0, F.concat(F.lit("changed\n"), "text")).otherwise(F.col("text"))
    second = f.filter("id % 3 = 0 OR id % 7 = 1 OR id % 2 = 0").select("path", F.lit(2).alias("seq"), F.when(F.col("id") % 7 != 1, changed).alias("text"))
    store = sync.SpanStore(spark, f"{base}/store", line_spans, 16)
    f.select("path", F.lit(1).alias("seq"), "text").write.parquet(f"{base}/changes/part=1")
    read = lambda: spark.readStream.schema("path string, seq int, text string").parquet(f"{base}/changes/part=*")
    sync.follow(read(), store, f"{base}/checkpoint")
    second.write.parquet(f"{base}/changes/part=2")
    sync.follow(read(), store, f"{base}/checkpoint")
    store.apply(second.withColumn("text", F.lit("never seen")), store.manifest["batch"])  # a batch that was applied
    return write_once(store.spans(), "synced")


@register("stream_leases", "T-9 T-10", """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS item, 'w' || (event_id % 4) AS worker, ts,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, 'w' || (event_id % 4)) AS later FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT item, worker, ts + INTERVAL 2 DAY AS released_at FROM b, m WHERE later > ts + INTERVAL 2 DAY OR later IS NULL AND ts + INTERVAL 2 DAY < mark""")
def stream_leases(spark, sf):
    """Items are users, their events the heartbeats of four workers; a lease lasts two days."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.PROVIDER)
    beats = parquet_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema).select("user_id", F.concat(F.lit("w"), F.col("event_id") % 4).alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    try:
        r = state.run_once(leases.releases(beats, "user_id", "worker", "ts", 2 * 86_400, "1 hour"), "append")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return r.select("item", "worker", F.col("released_at").cast("timestamp_ntz").alias("released_at"))
