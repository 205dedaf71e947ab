"""A total order without a single-partition window: global ordinals and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize


def with_ordinal(df: DataFrame, order_by: list[str], block_rows: int | None = None, name: str = "__ord") -> DataFrame:
    """df with `name` (0, 1, … in the given order) and `__block` (ordinal div block_rows; 0 without blocks).

    Rows are dealt into ranges of the key and sorted there; the counts of the ranges, one number for each partition, give the
    offsets. Range bounds are sampled, so a lost task could come back with other rows: the sorted rows are written to the shared
    folder before they are counted. Ties come in an unspecified order, which stays as it was written.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    dealt = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = materialize(dealt, "ordered")
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())  # a number for each partition
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("__part")) if starts else F.lit(0)
    out = dealt.withColumn(name, (offset + F.col("__row")).cast("long")).drop("__part", "__row")
    out = out.withColumn("__block", F.floor(F.col(name) / block_rows).cast("long") if block_rows else F.lit(0).cast("long"))
    out._plyfold_path = dealt._plyfold_path  # for tables.discard()
    return out
