"""Shapes of JSON values: signatures, names, field types, nesting, uniformity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import materialize
from .integrity import MAX_DEPTH


def signature(json: Column) -> Column:
    """The sorted keys of a JSON object, joined by commas; null for anything else."""
    return F.array_join(F.array_sort(F.json_object_keys(json)), ",")


def shapes(df: DataFrame, json: str = "j", path: str = "path") -> DataFrame:
    """(signature, n_keys, frequency, path): shapes with two keys and two occurrences at least; path is the least one."""
    seen = df.select(signature(F.col(json)).alias("signature"), F.size(F.json_object_keys(json)).alias("n_keys"), F.col(path).alias("path"))
    grouped = seen.filter("n_keys >= 2").groupBy("signature", "n_keys").agg(F.count("*").alias("frequency"), F.min("path").alias("path"))
    return grouped.filter("frequency >= 2").select("signature", F.col("n_keys").cast("long"), "frequency", "path")


def values(df: DataFrame, json: str = "j", path: str = "path", deepest: int = MAX_DEPTH) -> DataFrame:
    """(j, path) of the values of df and of every object inside them, at any depth: `.key` and `[place]` are added to the path.

    A level at a time, each written to the shared folder, until one holds no object; deeper than `deepest` raises ValueError.
    """
    level = df.select(F.col(json).alias("j"), F.col(path).alias("path"))
    out = level
    for _ in range(deepest):
        inside = level.select("path", F.explode(F.from_json(F.when(F.col("j").startswith("{"), F.col("j")), "map<string,string>")).alias("key", "j")).select("j", F.concat("path", F.lit("."), "key").alias("path"))
        listed = level.select("path", F.posexplode(F.from_json(F.when(F.col("j").startswith("["), F.col("j")), "array<string>")).alias("at", "j")).select("j", F.concat("path", F.lit("["), F.col("at").cast("string"), F.lit("]")).alias("path"))
        level = inside.unionByName(listed).filter(F.col("j").rlike(r"^[\[{]"))
        level = materialize(level, "nested-values")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {deepest}")


def instances(df: DataFrame, shape: str, json: str = "j") -> DataFrame:
    """The rows whose value is an object of the shape (a signature)."""
    return df.filter(signature(F.col(json)) == shape)


def matched(df: DataFrame, found: DataFrame, json: str = "j") -> DataFrame:
    """df with the short and full name of each value's shape, from named(); null where it has none. Shapes are few and broadcast."""
    small = F.broadcast(found.select("signature", "short_name", "full_name"))
    return df.withColumn("signature", signature(F.col(json))).join(small, "signature", "left")


def short_name(index: Column) -> Column:
    """A to Z, then A0 to Z0, A1 and so on."""
    return F.concat(F.char(65 + index % 26), F.when(index < 26, "").otherwise(((index - 26) / 26).cast("int").cast("string")))


def full_name(path: Column, sig: Column) -> Column:
    """From the property that holds the shape (an array's loses its plural s), else from well-known keys, else Item."""
    prop = F.regexp_extract(path, r"([A-Za-z0-9_]+)(\[\d*\])?$", 1)
    single = F.when(path.rlike(r"\]$"), F.regexp_replace(prop, "s$", "")).otherwise(prop)
    has = lambda *keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(F.split(sig, ","), k))
    # Key pairs and the names they suggest.
    guess = F.when(has("id", "name"), "Entity").when(has("lat", "lng"), "Location").when(has("street", "city"), "Address").when(has("width", "height"), "Size").otherwise("Item")
    return F.when(single != "", F.concat(F.upper(F.substring(single, 1, 1)), F.substring(single, F.lit(2), F.length(single)))).otherwise(guess)


def named(found: DataFrame) -> DataFrame:
    """shapes() with rank (frequency, then number of keys, both falling, then path and signature), short and full names. One row per shape: few."""
    order = Window.orderBy(F.desc("frequency"), F.desc("n_keys"), "path", "signature")
    ranked = found.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return ranked.select("signature", "rank", short_name(F.col("rank")).alias("short_name"), full_name(F.col("path"), F.col("signature")).alias("full_name"))


def field_types(df: DataFrame, json: str = "j") -> DataFrame:
    """(signature, field, type): null, boolean, number, string, array, object, or mixed; null joins any other type.

    The type comes from the value's own JSON text, one row for each field and document before the grouping.
    """
    keys = df.select(signature(F.col(json)).alias("signature"), F.explode(F.from_json(F.col(json), "map<string,string>")).alias("field", "value"), F.col(json).alias("j"))
    raw = F.expr("schema_of_variant(variant_get(parse_json(j), concat('$.', field), 'variant'))")
    kind = F.when(raw.isNull() | (raw == "VOID"), "null").when(raw == "BOOLEAN", "boolean").when(raw == "STRING", "string").when(raw.startswith("ARRAY"), "array").when(raw.startswith("OBJECT"), "object").otherwise("number")
    kinds = keys.groupBy("signature", "field").agg(F.collect_set(F.when(kind != "null", kind)).alias("kinds"))
    return kinds.select("signature", "field", F.when(F.size("kinds") == 0, "null").when(F.size("kinds") > 1, "mixed").otherwise(F.get("kinds", F.lit(0))).alias("type"))


def schemas(df: DataFrame, json: str = "j", path: str = "path") -> DataFrame:
    """(signature, n_keys, frequency, path, rank, short_name, full_name, fields array<struct<field, type>>) of all shapes at any depth."""
    met = materialize(values(df, json, path), "values")
    found = materialize(shapes(met), "shapes")
    fields = field_types(met).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("field", "type"))).alias("fields"))
    return found.join(named(found), "signature").join(fields, "signature")


def nested(df: DataFrame, json: str = "j") -> DataFrame:
    """(parent, field, nested): fields that hold an object of one and the same shape in every instance of the parent's shape."""
    keys = df.select(signature(F.col(json)).alias("parent"), F.explode(F.from_json(F.col(json), "map<string,string>")).alias("field", "value"))
    inner = F.when(F.col("value").startswith("{"), signature(F.col("value")))
    one = keys.groupBy("parent", "field").agg(F.count("*").alias("n"), F.count(inner).alias("held"), F.min(inner).alias("lo"), F.max(inner).alias("hi"))
    return one.filter("n = held and lo = hi and instr(lo, ',') > 0").select("parent", "field", F.col("lo").alias("nested"))


def is_table(df: DataFrame, json: str = "j") -> DataFrame:
    """(n_rows, is_table): all values are objects of one shape with two keys and two occurrences at least."""
    sig = signature(F.col(json))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce((F.count(sig) == F.count("*")) & (F.min(sig) == F.max(sig)) & (F.count("*") >= 2) & F.min(sig).contains(","), F.lit(False)).alias("is_table"))


def is_matrix(df: DataFrame, array: str) -> DataFrame:
    """(n_rows, n_cols, is_matrix): two rows at least, all of one length over zero."""
    size = F.size(array)
    return df.agg(F.count("*").alias("n_rows"), F.max(size).cast("long").alias("n_cols"), F.coalesce((F.min(size) == F.max(size)) & (F.min(size) > 0) & (F.count("*") >= 2), F.lit(False)).alias("is_matrix"))
