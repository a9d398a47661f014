"""Token ids in ORC files.

ORC stores integers run-length encoded in stripes, with an index every 10,000 rows and, here, Bloom filters on doc_id.
Files hold ascending ranges of doc_id, so a reader of some documents skips files and stripes by their statistics, and
row groups by the filters; whole reads go stripe by stripe in parallel.

Cases: null and empty texts have the end id alone; equal documents keep a row each (equal doc_ids stand side by side);
an empty table gives no rows; extra columns of the input are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder

END_ID = 1
STRIPE_BYTES = 16 << 20


def write_orc(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Encodes docs (doc_id, text) and writes (doc_id, n_tokens, ids) under path in ascending order of doc_id."""

    def encode(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            parts = [coder.encode(x.as_py()) + b"\1\0\0\0" for x in batch.column(1)]
            ends = np.cumsum([0] + [len(x) // 4 for x in parts], dtype=np.int64)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)], ["doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    # Ranges of ids first, then encoding: what is shuffled are the texts, which are smaller than their ids.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")
    encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", 10_000).option("compression", "zstd").orc(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids); filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of stored documents. start sums up files first, then the rows within a file."""

    def check(batches):
        for batch in batches:
            ids = batch.column(2)
            first, at = ids.offsets.to_numpy(), ids.flatten()
            data = at.buffers()[1]
            raw = np.frombuffer(data, "<i4")[at.offset : at.offset + len(at)].tobytes() if data is not None and len(at) else b""
            first = (first - first[0]) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first) // 4, pa.int64()), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])

    small_batches(stored.sparkSession)
    rows = stored.select(F.col("_metadata.file_path").alias("file"), "doc_id", "ids").mapInArrow(check, "file string, doc_id long, n_tokens long, ids_crc32 long")
    light = stored.select(F.col("_metadata.file_path").alias("file"), "doc_id", "n_tokens")  # no ids are read for this
    files = light.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("tokens"))
    files = files.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    within = Window.partitionBy("file").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(files.select("file", "before"), "file").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")
