"""Incremental sync of files and their spans into a versioned store that a stream of changes writes to.

The store is dealt into buckets by a hash of the path. A version's manifest names, for each bucket, the version that wrote it; a batch writes new files for the buckets of
paths that really changed and leaves all others alone. Files whose hash is as it was are skipped before anything is extracted from them. The manifest of
a version carries the id of the batch it came from, and batches up to that id do nothing when they are played again, as a stream does after a failure: a
batch takes effect once. Manifests are numbered and never overwritten; a writer that died before its manifest leaves files that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.versions import Versioned
from spanloom.runtime import discard, write_once

FILES = "path string, hash string"


class SpanStore(Versioned):
    """Tables ``files`` (path, hash) and ``spans`` (path and what ``extract`` makes of (path, text)), in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], buckets: int = 64):
        super().__init__(spark, path, {"batch": -1, "at": {}, "buckets": buckets})
        self.extract = extract

    def _bucket(self, path: str = "path"):
        return F.pmod(F.xxhash64(path), F.lit(self.manifest["buckets"])).cast("int")

    def _table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table of the current version (of some buckets): the folders that hold it, nothing else is listed or read."""
        by: dict[str, list[int]] = {}
        for b, folder in self.manifest["at"].items():
            if buckets is None or int(b) in buckets:
                by.setdefault(folder, []).append(int(b))
        out = None
        for folder, held in sorted(by.items()):
            t = self.spark.read.parquet(f"{self.path}/{folder}/{name}").filter(F.col("bucket").isin(held))
            out = t if out is None else out.unionByName(t)
        return out

    def files(self) -> DataFrame:
        t = self._table("files")
        return t.drop("bucket") if t is not None else self.spark.createDataFrame([], FILES)

    def spans(self) -> DataFrame | None:
        t = self._table("spans")
        return t.drop("bucket") if t is not None else None

    def apply(self, changes: DataFrame, batch: int, full: bool = False) -> dict[str, int]:
        """Applies (path, seq, text; null text: the file is gone), the last of each path, and returns what was done. With ``full``, files that the batch doesn't name are gone too."""
        if batch <= self.manifest["batch"]:
            return {"skipped": 1, "changed": 0, "deleted": 0, "buckets": 0}
        last = changes.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("seq", "text")).alias("x")).select("path", F.col("x.text").alias("text"))
        now = last.withColumn("hash", F.sha2("text", 256))
        old = self.files().select("path", F.col("hash").alias("was"))
        j = now.join(old, "path", "full" if full else "left").withColumn("bucket", self._bucket())
        moved = j.filter(~F.col("hash").eqNullSafe(F.col("was"))).select("path", "text", "hash", "bucket", F.col("was").isNotNull().alias("known"))
        moved = write_once(moved, "changes")
        done = moved.agg(F.sum(F.col("hash").isNotNull().cast("int")).alias("changed"), F.sum(F.col("hash").isNull().cast("int")).alias("deleted")).first()
        touched = sorted(r[0] for r in moved.select("bucket").distinct().collect())  # at most as many as there are buckets
        at = dict(self.manifest["at"])
        if touched:
            folder = f"version-{self.version + 1:08d}-{uuid.uuid4().hex[:8]}"
            fresh = moved.filter("hash IS NOT NULL")
            for name, rows in (("files", fresh.select("path", "hash", "bucket")), ("spans", self.extract(fresh.select("path", "text")).withColumn("bucket", self._bucket()))):
                kept = self._table(name, touched)
                if kept is not None:
                    rows = kept.join(moved.select("path"), "path", "left_anti").unionByName(rows)
                # a bucket is dealt by path, so that no bucket is one task's
                rows.repartition("bucket", F.pmod(F.xxhash64("path", F.lit(1)), F.lit(4))).sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{name}")
            held = {r[0] for r in self.spark.read.parquet(f"{self.path}/{folder}/files").select("bucket").distinct().collect()} if self._any(folder) else set()
            for b in touched:
                at.pop(str(b), None)
                if b in held:
                    at[str(b)] = folder
        discard(moved)
        self.commit({**self.manifest, "batch": batch, "at": at})
        return {"skipped": 0, "changed": done["changed"] or 0, "deleted": done["deleted"] or 0, "buckets": len(touched)}

    def _any(self, folder: str) -> bool:
        fs, p = self._fs(f"{self.path}/{folder}/files")
        return any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p))


def follow(changes: DataFrame, store: SpanStore, checkpoint: str) -> None:
    """Applies what a stream of (path, seq, text) holds by now; what it has applied before is known by the checkpoint, and by the store."""
    q = changes.writeStream.foreachBatch(lambda rows, batch: store.apply(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
