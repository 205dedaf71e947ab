"""What a table would gain at each level, and which level to take: one profile row, then a decision tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dictionary
from ..sources.render import FORMATS, against, lines, measure
from ..tables import materialize
from .document import Options, encode

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def profile(df: DataFrame, order_by: str, table: str = "table") -> DataFrame:
    """One row: table, json_size, n_rows, n_shapes, key_overhead, dict_savings, delta_columns, l1, l2, l3.

    key_overhead is what repeated keys cost in JSON, dict_savings what the dictionary takes off, delta_columns how many of the
    first 20 rows' columns change by a constant; l1 to l3 are the estimated reductions in per cent.
    """
    before, body, between, after = lines(df, "json")
    size = body.agg(F.count("*").alias("n_rows"), (F.coalesce(F.sum(F.length("line")), F.lit(0)) + F.greatest(F.count("*") - 1, F.lit(0)) * len(between) + len("".join(before + after))).cast("long").alias("json_size"))
    keys = sum(len(f.name) + 4 for f in df.schema.fields)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if strings:
        saved = F.greatest(F.lit(0), (F.length("value") - (2 + F.length(F.col("savings").cast("string")))) * F.col("frequency"))
        found = dictionary.profitable(dictionary.frequencies(df, strings, order_by)).agg(F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("dict_savings"), F.count("*").alias("dict_entries"))
    else:
        found = size.select(F.lit(0).cast("long").alias("dict_savings"), F.lit(0).cast("long").alias("dict_entries"))
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    head = df.orderBy(order_by).limit(20).agg(F.sort_array(F.collect_list(F.struct(order_by, *[F.col(f"`{c}`").alias(f"n{i}") for i, c in enumerate(numbers)]))).alias("rows"), F.count("*").alias("k"))

    def constant(i: int) -> Column:
        d = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda r: F.get("rows", r.cast("int"))[f"n{i}"] - F.get("rows", (r - 1).cast("int"))[f"n{i}"])
        return F.when((F.col("k") >= 3) & F.forall(d, lambda x: x.isNotNull() & (x == F.get(d, F.lit(0)))), 1).otherwise(0)

    moving = head.select((sum((constant(i) for i in range(len(numbers))), F.lit(0))).cast("long").alias("delta_columns"))
    one = size.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(moving))  # one row each
    over = F.lit(keys) * F.greatest(F.col("n_rows") - 1, F.lit(0))
    one = one.withColumn("key_overhead", over.cast("long")).withColumn("n_shapes", F.when((F.col("n_rows") >= 2) & F.lit(len(df.columns) >= 2), 1).otherwise(0).cast("long"))
    delta = F.when(F.col("n_rows") >= 3, 2 * F.col("n_rows") * F.col("delta_columns")).otherwise(0)

    def pct(x: Column, cap: int) -> Column:
        return F.least(F.lit(cap), F.floor(100 * x / F.col("json_size") + 0.5)).cast("long")

    one = one.withColumn("l1", pct(over, 80)).withColumn("l2", pct(over + F.col("dict_savings"), 80)).withColumn("l3", pct(over + F.col("dict_savings") + delta, 85))
    return one.select(F.lit(table).alias("table"), "json_size", "n_rows", "n_shapes", "key_overhead", "dict_entries", "dict_savings", "delta_columns", "l1", "l2", "l3")


def recommend(df: DataFrame, order_by: str, table: str = "table", min_compress_size: int = 0) -> DataFrame:
    """(table, level, will_compress, caveats): the level the profile speaks for, without encoding."""
    p = profile(df, order_by, table)
    d, t, m = F.col("dict_entries") > 0, F.col("delta_columns") > 0, min_compress_size
    level = (
        F.when((F.lit(m) > 0) & (F.col("json_size") < m), 1)
        .when((F.lit(m) == 0) & (F.col("json_size") < 150), 1)
        .when(F.col("n_shapes") == 0, 1)
        .when(~d & t & (F.col("l3") - F.col("l1") >= 3), 3)
        .when(~d & (F.col("l2") - F.col("l1") < 3), 1)
        .when(~t | (F.col("l3") - F.col("l2") < 3), 2)
        .otherwise(3)
    )
    notes = F.array_compact(F.array(F.when(F.col("json_size") < 150, "small"), F.when(F.col("n_shapes") == 0, "no repeating shape"), F.when(~d, "no dictionary"), F.when(~t, "no constant steps")))
    return p.select("table", level.alias("level"), (~((F.lit(m) > 0) & (F.col("json_size") < m))).alias("will_compress"), notes.alias("caveats"))


def level_sizes(df: DataFrame, order_by: str) -> DataFrame:
    """(level, chars, tokens, n_dict, n_delta) of JSON (level 0) and the documents of levels 1 to 3, checksum line included."""
    from ..functions.tokens import estimate_tokens

    out = measure(df, "json").select(F.lit(0).alias("level"), "chars", "tokens", F.lit(0).alias("n_dict"), F.lit(0).alias("n_delta"))
    for level in (1, 2, 3):
        e = encode(df, order_by, Options(level=level, embed_plan=False))
        total = e.lines.agg((F.sum(F.length("line")) + F.count("*") - 1).cast("long").alias("chars"), (F.sum(estimate_tokens(F.col("line"))) + F.count("*") - 1).cast("long").alias("tokens"))
        n_delta = sum(c in ("delta", "micros", "days") for c in e.plan.codecs.values())
        out = out.unionByName(total.select(F.lit(level).alias("level"), "chars", "tokens", F.lit(len(e.plan.dictionary)).alias("n_dict"), F.lit(n_delta).alias("n_delta")))
    return out


def compare_all(df: DataFrame, order_by: str) -> DataFrame:
    """(format, chars, tokens, pct, share) of the renderings, the documents of levels 1 to 3, and auto, the shortest of these."""
    levels = level_sizes(df, order_by).filter("level > 0").select(F.concat(F.lit("level"), F.col("level").cast("string")).alias("format"), "chars", "tokens")
    levels = materialize(levels, "level-sizes")  # three rows
    best = levels.agg(F.min(F.struct("chars", "format", "tokens")).alias("b")).select(F.lit("auto").alias("format"), "b.chars", "b.tokens")
    rows = levels.unionByName(best)
    for f in FORMATS:
        rows = rows.unionByName(measure(df, f))
    return against(rows, "json")


def auto_level(df: DataFrame, order_by: str, table: str = "table") -> DataFrame:
    """(table, best, chars): the shortest of JSON (0) and levels 1 to 3; the lower wins a tie. JSON is out if a column holds numbers over 18 digits."""
    wide = any(isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18 for f in df.schema.fields)
    sizes = level_sizes(df, order_by)
    sizes = sizes.filter("level > 0") if wide else sizes
    return sizes.agg(F.min(F.struct("chars", "level")).alias("b")).select(F.lit(table).alias("table"), F.col("b.level").alias("best"), F.col("b.chars").alias("chars"))


def analyze(df: DataFrame, order_by: str, table: str = "table") -> DataFrame:
    """One row: tokens of JSON and of each level, reduction of the best against JSON in per cent, dictionary and delta counts at level 3."""
    s = level_sizes(df, order_by)
    t = lambda n: F.max(F.when(F.col("level") == n, F.col("tokens")))
    one = s.agg(t(0).alias("json_tokens"), t(1).alias("l1_tokens"), t(2).alias("l2_tokens"), t(3).alias("l3_tokens"), F.max("n_dict").alias("n_dict"), F.max("n_delta").alias("n_delta"))
    best = F.least("l1_tokens", "l2_tokens", "l3_tokens")
    return one.select(F.lit(table).alias("table"), "*", ((F.col("json_tokens") - best) * 100.0 / F.col("json_tokens")).alias("reduction"))
