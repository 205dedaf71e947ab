"""Substring dictionary: frequent fragments of cells, mined with a grouping, chosen greedily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialize

# Bounds of the search and number of fragments.
SHORTEST, LONGEST, MIN_FREQUENCY, MOST = 6, 50, 3, 32


def eligible(cell: Column) -> Column:
    return cell.isNotNull() & (F.length(cell) >= SHORTEST) & ~cell.rlike(r"^(\$|\+|~$|-$|-\d)")


def ngrams(df: DataFrame, columns: list[str]) -> DataFrame:
    """(fragment, frequency, savings): substrings of 6 to 50 characters in three cells at least, each counted once for a cell.

    Cells are grouped first, so a value that repeats is cut once however often it occurs; partial counts add up before the
    shuffle. The work is 45 fragments for each character of the distinct values.
    """
    cells = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("cell")).filter(eligible(F.col("cell"))).groupBy("cell").count()
    starts = F.sequence(F.lit(1), F.length("cell") - SHORTEST + 1)
    of = lambda i: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("cell") - i + 1)), lambda n: F.substring(F.col("cell"), i, n))
    pieces = cells.select("count", F.explode(F.array_distinct(F.flatten(F.transform(starts, of)))).alias("fragment"))
    counted = pieces.groupBy("fragment").agg(F.sum("count").alias("frequency")).filter(F.col("frequency") >= MIN_FREQUENCY)
    return counted.withColumn("savings", (F.length("fragment") - 3) * F.col("frequency"))


def choose(found: DataFrame, page: int = 2_000) -> list[str]:
    """At most 32 fragments, by savings; one that holds a chosen one or is held by it is passed over, as is one that doesn't pay.

    The best `page` candidates come to the driver at once. While the list is not full, the best of those that no chosen fragment
    rules out are asked for: each time one at least is chosen, so MOST requests are enough, however many candidates there are.
    """
    order = [F.desc("savings"), F.desc(F.length("fragment")), F.asc("fragment")]
    found = materialize(found.filter(F.col("savings") > F.length("fragment") + 4), "fragments")
    chosen: list[str] = []
    left = found
    while len(chosen) < MOST:
        rows = left.orderBy(*order).limit(page).collect()
        for r in rows:
            if len(chosen) < MOST and not any(r.fragment in c or c in r.fragment for c in chosen):
                chosen.append(r.fragment)
        if len(rows) < page:
            break
        holds = F.exists(F.array(*map(F.lit, chosen)), lambda c: F.contains(F.col("fragment"), c) | F.contains(c, F.col("fragment")))
        left = found.filter(~holds)
    discard(found)
    return chosen


def apply(cell: Column, fragments: list[str]) -> Column:
    """cell with % doubled and its longest fragment's first occurrence written %n;."""
    text = F.replace(cell, F.lit("%"), F.lit("%%"))
    out = F.when(F.lit(False), text)
    for i in sorted(range(len(fragments)), key=lambda i: (-len(fragments[i]), i)):
        f = F.lit(fragments[i].replace("%", "%%"))
        at = F.position(f, text)
        out = out.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(f"%{i};"), F.substring(text, at + F.length(f), F.length(text))))
    return out.otherwise(text)


def expand(cell: Column, fragments: list[str]) -> Column:
    """Inverse of apply(). Cut at doubled %, which never overlap a %n;, a cell has one %n; at most, in one of the parts."""
    held = F.array(*map(F.lit, fragments)) if fragments else F.array().cast("array<string>")

    def put_back(part: Column) -> Column:
        n = F.regexp_extract(part, r"%(\d+);", 1)
        return F.when(n == "", part).otherwise(F.call_function("array_join", F.split(part, r"%\d+;", -1), F.get(held, n.cast("int"))))

    return F.when(F.contains(cell, F.lit("%")), F.array_join(F.transform(F.split(cell, "%%", -1), put_back), "%")).otherwise(cell)
