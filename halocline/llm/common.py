"""Shared helpers of the training-data operators: scratch tables, byte views, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have at most; a larger side is joined by shuffle.
MAX_BROADCAST_ROWS = 2_000_000
#: Bytes of text a vectorised kernel takes at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where the session names none and runs in a single JVM."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = found.get() if found.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="halocline-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them must itself be staged."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if df has few enough rows, else df as it is (Spark then shuffles)."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


#: Rows of an Arrow batch.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of long texts fits a worker; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (all bytes, n+1 offsets), nulls as empty; no copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or column.type == large
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` bytes, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def source_key(column: Column) -> Column:
    """A sort key that puts null last and keeps UTF-8 byte order, which is code-point order."""
    return F.struct(column.isNull().cast("int").alias("missing"), F.coalesce(column, F.lit("")).alias("name"))
