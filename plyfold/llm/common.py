"""What the operators of this subpackage share: where intermediate tables go, and how inputs are read."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, materialize, shared_dir

BATCH_BYTES = 8 << 20  # Arrow batches that go to Python hold about so many bytes, so that long texts fit with their copies
READER_ROWS = 512  # rows that Spark's Parquet reader holds at once: their texts are one array


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits on the bytes of an Arrow batch and on the rows of a Parquet reader's batch, where they are higher.

    The defaults are for narrow rows; with long texts they make arrays of tens of MB for each task, in Python and in the JVM.
    """
    arrow, reader = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(arrow, f"{64 << 20}")) > BATCH_BYTES:
        spark.conf.set(arrow, str(BATCH_BYTES))
    if int(spark.conf.get(reader, "4096")) > READER_ROWS:
        spark.conf.set(reader, str(READER_ROWS))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns go, a null text becomes empty. The session's Arrow batches are bounded from here on."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def as_bytes(df: DataFrame) -> DataFrame:
    """texts() with the text as UTF-8 bytes, so that Python gets no decoded strings."""
    return df.withColumn("text", F.col("text").cast("binary"))


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column without nulls, not copied."""
    import pyarrow as pa

    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offs


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about `most` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's batches are bounded from here on."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

__all__ = ["as_bytes", "binary_parts", "bounded_batches", "discard", "materialize", "partitions", "shared_dir", "spans", "table", "texts"]
