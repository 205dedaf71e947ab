"""Column templates: the longest common prefix and suffix of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SAVED = 4


def common_length(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two strings; of a whole column if they are its least and greatest."""
    n = F.least(F.length(lo), F.length(hi))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda t, i: F.when((t == i - 1) & (i <= n) & (F.substring(lo, i, F.lit(1)) == F.substring(hi, i, F.lit(1))), i).otherwise(t)), F.lit(0))


def detect(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, prefix, suffix, saved) of the columns for which a template pays, from one aggregation over all of them.

    A column with a null, an empty value or one that begins with $, + or ~, or is a dash, has none; nor has a constant one. The
    suffix never reaches into the prefix of the shortest value. A template must save four characters a row and more than its
    header in all.
    """
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        v, r = F.col(f"`{c}`"), F.reverse(F.col(f"`{c}`"))
        bad = v.isNull() | v.rlike(r"^($|[$+~]|-$)")
        aggs += [F.max(bad).alias(f"bad{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.min(r).alias(f"rlo{i}"), F.max(r).alias(f"rhi{i}"), F.min(F.length(v)).alias(f"len{i}")]
    one = df.agg(*aggs)
    pick = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(i).alias("pos"), F.col("n"), *[F.col(f"{x}{i}").alias(x) for x in ("bad", "lo", "hi", "rlo", "rhi", "len")]) for i, c in enumerate(columns)])
    rows = one.select(F.inline(pick)).filter("n >= 2 and not bad and lo <> hi")
    rows = rows.withColumn("p", common_length(F.col("lo"), F.col("hi")).cast("int"))
    rows = rows.withColumn("s", F.least(common_length(F.col("rlo"), F.col("rhi")), F.col("len") - F.col("p")).cast("int"))
    rows = rows.select("col", "pos", "n", F.substring("lo", F.lit(1), F.col("p")).alias("prefix"), F.expr("right(lo, s)").alias("suffix"), (F.col("p") + F.col("s")).cast("long").alias("saved"))
    header = F.length(F.concat(F.lit("@T "), F.col("pos").cast("string"), F.lit(": "), "prefix", F.lit("{}"), "suffix")) + 1
    return rows.filter((F.col("saved") >= MIN_SAVED) & (F.col("saved") * F.col("n") > header)).select("col", "prefix", "suffix", "saved")


def strip(value: Column, prefix: str, suffix: str) -> Column:
    return F.substring(value, F.lit(len(prefix) + 1), F.length(value) - len(prefix) - len(suffix))


def expand(rest: Column, prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), rest, F.lit(suffix))
