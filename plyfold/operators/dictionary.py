"""Whole-value dictionary: global frequencies, a cost rule, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import MAX_REFS, ref
from ..functions.tokens import dictionary_tokens


def frequencies(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """(value, frequency, first): non-null strings of all columns together; first is their least (order, column)."""
    at = F.col(order) if order else F.lit(0)
    cells = F.array(*[F.struct(F.col(f"`{c}`").alias("value"), F.struct(at.cast("long").alias("ord"), F.lit(i).alias("col")).alias("first")) for i, c in enumerate(columns)])
    return df.select(F.inline(cells)).filter("value is not null").groupBy("value").agg(F.count("*").alias("frequency"), F.min("first").alias("first"))


def profitable(found: DataFrame, max_size: int = 1024, min_length: int = 2, min_frequency: int = 2) -> DataFrame:
    """(value, frequency, savings, first) of the values that a dictionary pays for, the best max_size by frequency * savings.

    A value of t tokens that occurs f times saves (t - 1) * f and costs t + 1 in the header. The best are taken before the
    losing ones go, so those can use up places.
    """
    t = dictionary_tokens(F.col("value"))
    rated = found.filter((F.col("frequency") >= min_frequency) & (F.length("value") >= min_length)).withColumn("tokens", t).withColumn("savings", t - 1)
    best = rated.orderBy(F.desc(F.col("frequency") * F.col("savings")), "first", "value").limit(min(max_size, MAX_REFS))
    return best.filter("savings * frequency >= tokens + 1").select("value", "frequency", "savings", "first")


def numbered(entries: DataFrame) -> DataFrame:
    """(value, idx, ref), best first; MAX_REFS rows at most, so one task."""
    order = Window.orderBy(F.desc(F.col("frequency") * F.col("savings")), "first", "value")
    n = entries.select("value", (F.row_number().over(order) - 1).cast("long").alias("idx"))
    return n.select("value", "idx", ref(F.col("idx")).alias("ref"))


def lookup(column: Column, refs: list[str]) -> Column:
    """The reference of a value, or null: a literal map, for few entries. references() is the table to join for more."""
    if not refs:
        return F.lit(None).cast("string")
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, refs)), F.transform(F.sequence(F.lit(0), F.lit(len(refs) - 1)), ref)), column)


def references(spark: SparkSession, refs: list[str], name: str) -> DataFrame:
    """(__value, name): every entry and its reference, MAX_REFS rows at most, to broadcast."""
    rows = spark.createDataFrame(list(enumerate(refs)), "i long, __value string")
    return F.broadcast(rows.select("__value", ref(F.col("i")).alias(name)))


def encode(df: DataFrame, column: str, entries: DataFrame, out: str = "cell") -> DataFrame:
    """df with `out`: the reference of column's value, or the value. entries has MAX_REFS rows at most and is broadcast."""
    small = F.broadcast(entries.select(F.col("value").alias("__v"), F.col("ref").alias("__r")))
    return df.join(small, F.col(column) == F.col("__v"), "left").withColumn(out, F.coalesce("__r", F.col(column))).drop("__v", "__r")


def decode(df: DataFrame, cell: str, entries: DataFrame, out: str) -> DataFrame:
    small = F.broadcast(entries.select(F.col("value").alias("__v"), F.col("ref").alias("__r")))
    return df.join(small, F.col(cell) == F.col("__r"), "left").withColumn(out, F.coalesce("__v", F.col(cell))).drop("__v", "__r")
