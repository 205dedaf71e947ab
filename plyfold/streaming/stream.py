"""Documents in and out of Structured Streaming: each micro-batch is a block of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.document import Options, Plan, decode, encode


def stream_encode(stream: DataFrame, order_by: list[str] | str, path: str, checkpoint: str, level: int = 2, **trigger) -> StreamingQuery:
    """Write every micro-batch as documents under path/batch=N: Parquet of (block, ord, line), the plan in each header.

    A batch that is repeated after a failure overwrites its own folder, so each is there once. An empty batch writes nothing.
    """

    def write(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        encode(batch, order_by, Options(level=level)).lines.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_decode(spark: SparkSession, path: str) -> DataFrame:
    """The table of all batches under path. Each batch follows its own plan."""
    lines = spark.read.parquet(path)
    out = None
    for r in lines.filter("ord < 0 and line like '#plan %'").groupBy("batch").agg(F.first("line").alias("line")).orderBy("batch").collect():  # a row for each batch
        part = decode(lines.filter(F.col("batch") == r.batch).select("block", "ord", "line"), Plan.from_json(r.line[6:]))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no batch has been written")
    return out


def stream_restore(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 1_000, **trigger) -> StreamingQuery:
    """Decode what stream_encode() writes under path, as it comes: the rows go to out/batch=N, as Parquet.

    A micro-batch takes up to `files` new files; each encoded batch in it follows its own plan, so a plan's size does not grow with
    the stream. Batches must be complete when they are listed, as those of stream_encode() are: their folder appears at commit.
    """

    def write(lines: DataFrame, _: int) -> None:
        for r in lines.select("batch").distinct().collect():  # at most `files` rows
            whole = spark.read.parquet(f"{path}/batch={r.batch}")
            decode(whole).write.mode("overwrite").parquet(f"{out}/batch={r.batch}")

    kind = "block long, ord long, line string, batch int"
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(path)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
