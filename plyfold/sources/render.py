"""Renderings of a table in the formats to compare with, as lines: JSON, indented JSON, two compact tables, YAML-like text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import quoted, text_of
from ..functions.tokens import estimate_tokens

FORMATS = ("json", "json_pretty", "toon", "tron", "yaml")


def _scalar(name: str, kind: T.DataType, text: bool = True) -> Column:
    v = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(quoted(v) if text else _json_string(v), F.lit("null"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(v), F.lit("null"))
    out = text_of(v, kind)
    if not text and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType)):
        out = F.concat(F.lit('"'), out, F.lit('"'))
    return F.coalesce(out, F.lit("null"))


def _json_string(v: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def lines(df: DataFrame, fmt: str) -> tuple[list[str], DataFrame, str, list[str]]:
    """(lines before, one `line` for each row, what stands between rows, lines after)."""
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    keys = [n for n, _ in fields]
    if fmt == "json":
        parts = [F.concat(F.lit(f'"{n}":'), _scalar(n, k, False)) for n, k in fields]
        return ["["], df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line")), ",", ["]"]
    if fmt == "json_pretty":
        parts = [F.concat(F.lit(f'    "{n}": '), _scalar(n, k, False)) for n, k in fields]
        return ["[\n"], df.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *parts), F.lit("\n  }")).alias("line")), ",\n", ["\n]"]
    if fmt == "toon":
        body = df.select(F.concat(F.lit("  "), F.concat_ws(", ", *[_scalar(n, k) for n, k in fields])).alias("line"))
        return [f"[{{n}}]:\n  - {', '.join(keys)}\n"], body, "\n", []
    if fmt == "tron":
        return [f"class A: {', '.join(keys)}\n"], df.select(F.concat(F.lit("A "), F.concat_ws(", ", *[_scalar(n, k) for n, k in fields])).alias("line")), "\n", []
    if fmt == "yaml":
        parts = [F.concat(F.lit(("- " if i == 0 else "  ") + n + ": "), _scalar(n, k)) for i, (n, k) in enumerate(fields)]
        return [], df.select(F.concat_ws("\n", *parts).alias("line")), "\n", ["\n"]
    raise ValueError(f"unknown format {fmt!r}")


def measure(df: DataFrame, fmt: str) -> DataFrame:
    """(format, chars, tokens) of a rendering, summed over the rows without putting it together."""
    before, body, between, after = lines(df, fmt)
    fixed = "".join(before + after)
    total = body.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("c"), F.coalesce(F.sum(estimate_tokens(F.col("line"))), F.lit(0)).alias("t"))
    head = F.replace(F.lit(fixed), F.lit("{n}"), F.col("n").cast("string"))
    gaps = F.greatest(F.col("n") - 1, F.lit(0))
    return total.select(F.lit(fmt).alias("format"), (F.col("c") + gaps * len(between) + F.length(head)).cast("long").alias("chars"), (F.col("t") + gaps * len(between) + estimate_tokens(head)).cast("long").alias("tokens"))


def against(rows: DataFrame, baseline: str) -> DataFrame:
    """(format, chars, tokens) with pct, tokens against the baseline in per cent, and share, against the largest; few rows."""
    base = F.max(F.when(F.col("format") == baseline, F.col("tokens")))
    most = rows.agg(base.alias("base"), F.max("tokens").alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("format", "chars", "tokens", ((F.col("tokens") - F.col("base")) * 100.0 / F.col("base")).alias("pct"), (F.col("tokens") / F.col("most")).alias("share"))


def compare(df: DataFrame, formats: tuple[str, ...] = FORMATS, baseline: str = "json") -> DataFrame:
    """(format, chars, tokens, pct, share) of the renderings."""
    rows = measure(df, formats[0])
    for f in formats[1:]:
        rows = rows.unionByName(measure(df, f))
    return against(rows, baseline)
