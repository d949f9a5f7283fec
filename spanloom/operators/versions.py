"""Numbered manifests of a folder: one state for all readers, and one winner among writers."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Versioned:
    """A folder whose state is its last manifest, a small JSON document that names the files that count. Manifests are never overwritten: of two
    writers that began from one version, the second fails, and what it wrote is never named."""

    def __init__(self, spark: SparkSession, path: str, empty: dict):
        self.spark, self.path, self.version, self.manifest = spark, path.rstrip("/"), 0, empty
        fs, folder = self._fs(self.path)
        if fs.exists(folder):
            names = [s.getPath().getName() for s in fs.listStatus(folder)]
            self.version = max([int(n[9:-5]) for n in names if n.startswith("manifest-")], default=0)
        if self.version:
            self.manifest = json.loads(spark.read.text(self._name(self.version), wholetext=True).first()[0])

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}.json"

    def commit(self, manifest: dict) -> None:
        fs, p = self._fs(self._name(self.version + 1))
        out = fs.create(p, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self.version, self.manifest = self.version + 1, manifest
