"""Delta and repeat: differences to the row before, and their inverses as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over(order: str, *block: str):
    return Window.partitionBy(*block).orderBy(order) if block else Window.orderBy(order)


def eligibility(df: DataFrame, columns: dict[str, str], order: str, block: str, min_rows: int = 3, across: bool = False) -> DataFrame:
    """(col, kind, is_const, eligible) of numeric (or whole-microsecond temporal) columns {name: kind}.

    A column is worth it if its differences are constant, or on average under half the size of its values; it must have no
    null and min_rows rows. All columns are measured in one pass, in parallel over blocks. Differences restart in each block, or
    go on `across` blocks: then the step into a block comes from the first and last rows of the blocks, a row for each.
    """
    w = over(order, block)
    steps = df.select(F.lit(1).alias("own"), *[F.col(c).cast("decimal(38,6)").alias(c) for c in columns], *[(F.col(c).cast("decimal(38,6)") - F.lag(F.col(c).cast("decimal(38,6)")).over(w)).alias(f"d_{c}") for c in columns])
    if across:
        value = lambda c: F.col(c).cast("decimal(38,6)")
        ends = df.groupBy(block).agg(*[x for c in columns for x in (F.min_by(value(c), order).alias(f"f_{c}"), F.max_by(value(c), order).alias(f"l_{c}"))])
        into = Window.orderBy(block)
        steps = steps.unionByName(ends.select(*[(F.col(f"f_{c}") - F.lag(f"l_{c}").over(into)).alias(f"d_{c}") for c in columns]), allowMissingColumns=True)
    stats = []
    for c in columns:
        d = F.col(f"d_{c}")
        stats += [F.count(c).alias(f"n_{c}"), F.min(d).alias(f"lo_{c}"), F.max(d).alias(f"hi_{c}"), F.sum(F.abs(d).cast("double")).alias(f"ad_{c}"), F.count(d).alias(f"nd_{c}"), F.sum(F.abs(F.col(c)).cast("double")).alias(f"av_{c}")]
    one = steps.agg(F.count("own").alias("rows"), *stats)
    pick = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(k).alias("kind"), "rows", *[F.col(f"{x}_{c}").alias(x) for x in ("n", "lo", "hi", "ad", "nd", "av")]) for c, k in columns.items()])
    rows = one.select(F.inline(pick))
    const = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    small = F.coalesce(F.col("ad") / F.col("nd") < 0.5 * F.col("av") / F.col("n"), F.lit(False))
    return rows.select("col", "kind", const.alias("is_const"), ((F.col("rows") >= min_rows) & (F.col("n") == F.col("rows")) & (const | small)).alias("eligible"))


def signed(d: Column) -> Column:
    return F.concat(F.when(d < 0, "").otherwise("+"), d.cast("string"))


def delta(value: Column, window, suffix: str = "") -> Column:
    """The value in the first row of a window's partition, then signed differences (exact types only)."""
    d = value - F.lag(value).over(window)
    return F.when(F.row_number().over(window) == 1, value.cast("string")).otherwise(F.concat(signed(d), F.lit(suffix)))


def undelta(cell: Column, window, kind: str = "long", suffix: str = "") -> Column:
    """Inverse of delta(): a running sum."""
    number = F.replace(cell, F.lit(suffix), F.lit("")) if suffix else cell
    return F.sum(number.cast(kind)).over(window.rowsBetween(Window.unboundedPreceding, 0)).cast(kind)


def repeat(cell: Column, window) -> Column:
    """~ where a cell equals the one before."""
    return F.when(cell == F.lag(cell).over(window), "~").otherwise(cell)


def unrepeat(cell: Column, window) -> Column:
    """Inverse of repeat(): the last cell that is not ~."""
    return F.last(F.when(cell != "~", cell), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))

