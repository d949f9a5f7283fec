"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet file, or of the files of a Parquet folder, ``name`` in ``folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    is_folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(f"{folder}/{name}") if is_folder else r.option("pathGlobFilter", name).parquet(folder)


def file_changes(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of new files of a tree, as they appear."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
