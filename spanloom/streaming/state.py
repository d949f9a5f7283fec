"""Streaming and stateful operators. Each takes a streaming or a batch DataFrame where the engine allows both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, ts: str, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """(key, start, ready, n): a burst of events per key, ready after ``quiet`` without another."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(key, F.session_window(ts, quiet)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("ready"), "n")


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window start, keys, n, total) of tumbling or sliding windows."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def push(queue: DataFrame, keys: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """The first item of each key: of a batch, or of a stream within its watermark."""
    if queue.isStreaming:
        return queue.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return queue.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(ts or keys[0]))).filter("_n = 1").drop("_n")


def escalation(failures: DataFrame, keys: list[str], max_tier: int = 1, per_tier: int = 3) -> DataFrame:
    """(keys, failures, tier, attempts, permanent): per_tier attempts at each tier, then the next; permanent after the last."""
    n = failures.groupBy(*keys).agg(F.count("*").alias("failures"))
    dead = F.col("failures") >= per_tier * (max_tier + 1)
    return n.select(*keys, "failures", F.least(F.floor(F.col("failures") / per_tier), F.lit(max_tier)).cast("int").alias("tier"), F.when(dead, per_tier).otherwise(F.col("failures") % per_tier).cast("int").alias("attempts"), dead.alias("permanent"))


def escalation_stream(failures: DataFrame, key: str, max_tier: int = 1, per_tier: int = 3) -> DataFrame:
    """The same per key as state: (key, failures, tier, attempts, permanent) after each micro-batch."""
    kind = failures.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        dead = n >= per_tier * (max_tier + 1)
        yield pd.DataFrame({key: [k[0]], "failures": [n], "tier": [min(n // per_tier, max_tier)], "attempts": [per_tier if dead else n % per_tier], "permanent": [dead]})

    return failures.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, failures long, tier int, attempts int, permanent boolean", "n long", "update", "NoTimeout")


def claim(queue: DataFrame, worker: str, limit: int) -> DataFrame:
    """The first unclaimed items by priority and time, claimed. Claims are serial: call it once a trigger, on the driver."""
    return queue.filter("claimed_by IS NULL").orderBy("priority", "created", "id").limit(limit).withColumn("claimed_by", F.lit(worker))


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Items without those (id, worker) that their claimant has completed; others' claims are not touched."""
    return queue.join(done.select("id", F.col("worker").alias("claimed_by")), ["id", "claimed_by"], "left_anti")


def orphans(beats: DataFrame, keys: list[str], ts: str, now: str, timeout: str = "600 seconds") -> DataFrame:
    """(keys, last): claims whose last heartbeat is older than the timeout."""
    return beats.groupBy(*keys).agg(F.max(ts).alias("last")).filter(F.col("last") < F.expr(f"timestamp '{now}' - interval {timeout}"))


def sliding_rate(events: DataFrame, keys: list[str], ts: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Adds requests and tokens of each key's last ``seconds``.

    Rows are first counted by second, so that a window's work does not grow with the rows of a second, and joined with their second's figures at the end. Seconds are dealt by
    stretches of twice the time, so that a window holds two stretches at most, not a key; a second also goes to the next stretch if it counts there. Rows without a time are
    each other's peers.
    """
    e = events.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp")))
    s = e.groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.sum(tokens).alias("_t")).withColumn("_b", F.floor(F.col("_s") / (2 * seconds)))
    late = F.pmod("_s", F.lit(2 * seconds)) >= seconds
    s = s.withColumn("_at", F.explode(F.when(late, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))))
    w = W.partitionBy(*keys, "_at").orderBy(F.col("_s")).rangeBetween(-seconds, 0)
    s = s.withColumn("requests", F.sum("_n").over(w)).withColumn("used", F.sum("_t").over(w)).filter(F.col("_at").eqNullSafe(F.col("_b")))
    s = s.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_second"), "requests", "used")
    on = e["_s"].eqNullSafe(s["_second"])
    for i, k in enumerate(keys):
        on = on & e[k].eqNullSafe(s[f"_k{i}"])
    return e.join(s, on).select(*events.columns, "requests", "used")


def failure_runs(events: DataFrame, key: str, order: list[str], ok: str, threshold: int, stretch: Column | None = None) -> DataFrame:
    """Adds ``streak`` (failures in a row up to here) and ``open`` (whether the breaker would be). A null outcome neither counts nor ends a run.

    With a ``stretch``, a column that never falls as the first order column rises (an hour of a time, say), no key has to fit into a task: runs are counted within
    a key's stretches, and what a stretch begins with is found from one row per stretch.
    """
    e = events.withColumn("_k", F.struct(F.col(key).alias("key"), (F.lit(None) if stretch is None else stretch).alias("at")))
    up = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("_g", F.coalesce(F.sum(F.col(ok).cast("int")).over(up(W.partitionBy("_k").orderBy(*order))), F.lit(0)))
    e = e.withColumn("_r", F.coalesce(F.sum((~F.col(ok)).cast("int")).over(up(W.partitionBy("_k", "_g").orderBy(*order))), F.lit(0)))
    if stretch is None:
        return e.withColumn("streak", F.col("_r")).withColumn("open", F.col("_r") >= threshold).drop("_k", "_g", "_r")
    last = e.groupBy("_k").agg(F.max_by("_r", F.struct(*order)).alias("_end"), (F.max("_g") > 0).cast("int").alias("_ends"))
    whole = W.partitionBy("_k.key").orderBy("_k.at")
    last = last.withColumn("_n", F.sum("_ends").over(up(whole))).withColumn("_out", F.sum("_end").over(up(W.partitionBy("_k.key", "_n").orderBy("_k.at"))))
    last = last.select("_k", F.coalesce(F.lag("_out").over(whole), F.lit(0)).alias("_in"))
    r = e.join(last, "_k").withColumn("streak", F.col("_r") + F.when(F.col("_g") == 0, F.col("_in")).otherwise(0))
    return r.withColumn("open", F.col("streak") >= threshold).select(*events.columns, "streak", "open")


def eligible(repos: DataFrame, now: str, min_interval: str, max_failures: int) -> DataFrame:
    """(…, eligible) of (running, failures, next_at, last_at)."""
    t = F.expr(f"timestamp '{now}'")
    fine = ~F.col("running") & (F.col("failures") < max_failures) & (F.col("next_at").isNull() | (F.col("next_at") <= t)) & (F.col("last_at").isNull() | (F.col("last_at") <= F.expr(f"timestamp '{now}' - interval {min_interval}")))
    return repos.withColumn("eligible", fine)


def run_once(stream: DataFrame, mode: str = "complete", name: str = "out") -> DataFrame:
    """Drains a stream into a table in the shared scratch folder (each micro-batch replaces or adds to it) and reads that."""
    import uuid

    from spanloom.runtime import scratch_dir

    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/data")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def sync(changes: DataFrame, apply_batch) -> DataFrame:
    """A change stream through ``foreachBatch``: ``apply_batch(changed rows of the batch, latest per key)``."""
    return changes.writeStream.foreachBatch(lambda b, n: apply_batch(b)).trigger(availableNow=True)
