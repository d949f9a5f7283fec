"""Session set-up and the one way this library cuts lineage.

Intermediate tables go to ``spark.checkpoint.dir`` (shared by the driver and all executors), never to
a machine-local folder, so that a lost executor costs a retry and not the job.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit for an Arrow batch, and what steps that read whole texts in Python set it to: JVM and Python hold a batch or two a task.
BATCH, TEXT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def session(name: str = "spanloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, bring your own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; removed when the driver ends."""
    sc = spark.sparkContext
    held = getattr(sc, "_spanloom_scratch", None)
    if held is None:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:  # only in local tests, where driver and executors are one process
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        held = sc._spanloom_scratch = f"{base.rstrip('/')}/spanloom-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, held)
    return held


@contextlib.contextmanager
def _shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Drop a job's shuffle files when it ends, not when the driver next collects garbage."""
    old = spark.conf.get(CLEANUP, None)
    if old is None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


@contextlib.contextmanager
def _batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Arrow batches of at most about ``most`` bytes, a row at least; a smaller limit of the session stays."""
    old = spark.conf.get(BATCH)
    if most is None or 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old) <= most:
        yield
        return
    spark.conf.set(BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH, old)


def write_once(df: DataFrame, tag: str = "t", batch: int | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared scratch folder and read it back (a lineage cut). ``batch``: bytes of an Arrow batch that Python gets."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    with _shuffle_cleanup(spark), _batches(spark, batch):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``write_once`` wrote, once nothing reads it any more."""
    path = getattr(df, "_spanloom_path", None)
    if path:
        _drop(df.sparkSession, path)


#: Bytes a core, below which a table may be dealt anew.
SMALL = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores, for work in Python that costs more than the move: a file of one row group is one task otherwise.

    A table of more than SMALL bytes a core, or than a file split a core, has tasks enough, and stays as it is.
    """
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < min(SMALL, split) * cores else rows


#: Bytes of text that Python holds at once, a longer text apart, and rows that it gives at once.
TEXT_BYTES, ROWS_OUT = 1 << 20, 1 << 12


def small(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about TEXT_BYTES of text each, a row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if i > first and held + n > TEXT_BYTES:
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if len(sizes) > first:
            yield b.slice(first)


def row_batches(key: str, text: str, each, schema: str, extra: str | None = None):
    """For mapInArrow: batches of (key, *row) for the rows that ``each(text)``, or ``each(text, extra)``, yields; texts are taken one by one, and no more than ROWS_OUT rows are
    held. Null and empty texts give none."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(text)[i].as_py()
                if not t:
                    continue
                k = b.column(key)[i].as_py()
                for r in each(t, b.column(extra)[i].as_py()) if extra else each(t):
                    out.append((k, *r))
                    if len(out) >= ROWS_OUT:
                        yield made()
                        out.clear()
        if out:
            yield made()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
