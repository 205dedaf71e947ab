"""Checksums, cardinality and depth guards, routing of message content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 64


def crc_hex(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")


def cardinality(df: DataFrame, declared: int) -> DataFrame:
    """(declared, actual, ok)."""
    return df.agg(F.count("*").alias("actual")).select(F.lit(declared).cast("long").alias("declared"), "actual", (F.col("actual") == declared).alias("ok"))


def schema_depth(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 1 + max((schema_depth(f.dataType) for f in kind.fields), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + schema_depth(kind.elementType)
    if isinstance(kind, T.MapType):
        return 1 + schema_depth(kind.valueType)
    return 0


def check_depth(kind: T.DataType, most: int = MAX_DEPTH) -> None:
    if schema_depth(kind) > most:
        raise ValueError(f"deeper than {most}")


def text_depth(text: Column) -> Column:
    """Deepest nesting of brackets in a text, outside double quotes."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.regexp_extract_all(bare, F.lit(r"[\[\](){}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s: Column, c: Column) -> Column:
        d = s["d"] + F.when(c.isin("[", "(", "{"), 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(steps, start, step, lambda s: s["m"])


def is_json(text: Column) -> Column:
    """A text that begins with { or [ after white space and is valid JSON."""
    return F.coalesce(F.regexp_replace(text, r"^\s+", "").rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull(), F.lit(False))


def route(df: DataFrame, text: str, out: str = "action") -> DataFrame:
    """df with is_json and `out`: compress JSON content, pass the rest through."""
    return df.withColumn("is_json", is_json(F.col(text))).withColumn(out, F.when(F.col("is_json"), "compress").otherwise("pass"))
