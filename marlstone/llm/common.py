"""What the training-data operators share: folders, batches, text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch handed to Python.  Whole texts travel in these
#: batches; one text may be longer than the bytes, and is then a batch of its own.
ARROW_ROWS, ARROW_BYTES = 64, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for very long texts, and let Python
    workers started from here find this package (a cluster gets it by --py-files).

    The settings are the same for every operator: a frame that runs later, or
    beside another, meets the batches it was built for."""
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(x for x in (home, known) if x)
    # Workers live on between stages: what they free should go back to the system.
    spark.sparkContext.environment.update(ARROW_DEFAULT_MEMORY_POOL="system", MALLOC_ARENA_MAX="1", MALLOC_TRIM_THRESHOLD_="131072")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    # What a finished step has shuffled is not read again: stored() keeps its result.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one and runs on this machine alone (tests), a
    temporary folder is made and noted in the session; a cluster must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_table(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(frame: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = frame.sparkSession
    path = new_table(spark, label)
    writer = frame.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    read = spark.read.schema(frame.schema).parquet(path).select(*frame.columns)
    read.stored_at = path
    return read


def discard(frame: DataFrame, part: str = "") -> None:
    """Remove a stored table, or one of its partitions, that nothing reads any more."""
    spark = frame.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{frame.stored_at}/{part}" if part else frame.stored_at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CACHE: dict = {}


def worker_cache(name: str, make: Callable):
    """A cache that lives as long as the Python worker, or until another is asked
    for: a worker that serves several operators holds one of them at a time."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts_as_str(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def byte_lengths(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0)


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)
