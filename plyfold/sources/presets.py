"""Deterministic example tables, generated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Word lists of the examples.
DEPARTMENTS = ("Engineering", "Sales", "Marketing", "Support", "Finance")
STATUS = ("ok", "warn", "error")
CITIES = (("Paris", "FR", 48.86, 2.35), ("Berlin", "DE", 52.52, 13.4), ("Madrid", "ES", 40.42, -3.7))
CATEGORIES = ("tools", "toys", "books", "garden", "food")


def _pick(words: tuple[str, ...], i=None):
    i = F.col("id") if i is None else i
    return F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))


def _day(start: str):
    return F.date_format(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")


def people(spark: SparkSession, n: int) -> DataFrame:
    k = (F.col("id") + 1).cast("string")
    return spark.range(n).select((F.col("id") + 1).alias("id"), F.concat(F.lit("Employee "), k).alias("name"), F.concat(F.lit("emp"), k, F.lit("@company.com")).alias("email"), _pick(DEPARTMENTS).alias("department"), (F.col("id") % 3 != 0).alias("active"), (50_000 + F.col("id") * 1_000).alias("salary"), _day("2020-01-01").alias("joinDate"))


def iot(spark: SparkSession, n: int = 200) -> DataFrame:
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(n).select(at.alias("timestamp"), F.concat(F.lit("sensor-"), (F.col("id") % 10).cast("string")).alias("sensorId"), (20 + F.col("id") % 50 / 4).alias("temperature"), (40 + F.col("id") % 40 / 2).alias("humidity"), _pick(STATUS).alias("status"), (F.col("id") % 7 == 0).alias("alert"))


def weather(spark: SparkSession, n: int = 30) -> DataFrame:
    i = (F.col("id") % len(CITIES) + 1).cast("int")
    part = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CITIES]), i)
    low = 5 + F.col("id") % 10
    place = F.struct(part(0).alias("city"), part(1).alias("country"), part(2).alias("lat"), part(3).alias("lon"))
    temp = F.struct(low.alias("min"), (low + 8).alias("max"), (low + 4).alias("avg"), F.lit("C").alias("unit"))
    return spark.range(n).select(_day("2024-03-01").alias("date"), place.alias("location"), temp.alias("temperature"), (50 + F.col("id") % 30).alias("humidity"), (F.col("id") % 25).alias("windSpeed"), _pick(("sunny", "cloudy", "rain")).alias("conditions"))


def products(spark: SparkSession, n: int = 25) -> DataFrame:
    k = F.lpad((F.col("id") + 1).cast("string"), 4, "0")
    tags = F.array(_pick(CATEGORIES), _pick(("new", "sale")))
    specs = F.struct((F.col("id") % 9 + 1).alias("weight"), F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("x2")).alias("dimensions"))
    rating = F.struct((3 + F.col("id") % 4 / 2).alias("average"), (F.col("id") * 3).alias("count"))
    return spark.range(n).select(F.concat(F.lit("P-"), k).alias("id"), F.concat(F.lit("Product "), k).alias("name"), _pick(CATEGORIES).alias("category"), (F.col("id") + 0.5).alias("price"), (F.col("id") % 4 != 0).alias("inStock"), tags.alias("tags"), specs.alias("specs"), rating.alias("rating"))


def tiny(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit("Ada").alias("name"))


def config(spark: SparkSession) -> DataFrame:
    sub = [F.struct(F.lit(name).alias("name"), F.lit(i).alias("port")).alias(name) for i, name in enumerate(("server", "database", "cache", "queue", "auth", "logging"))]
    return spark.range(1).select(*sub)


def rag(spark: SparkSession, n: int = 5) -> DataFrame:
    k = F.col("id").cast("string")
    meta = F.struct((F.col("id") / 8).alias("score"), (F.col("id") * 10).alias("page"))
    return spark.range(n).select(F.concat(F.lit("chunk-"), k).alias("id"), F.concat(F.lit("docs/"), k, F.lit(".md")).alias("source"), F.concat(F.lit("Passage number "), k, F.lit(" of the manual.")).alias("content"), meta.alias("metadata"))


def mixed(spark: SparkSession) -> DataFrame:
    """Values of five shapes, as JSON text."""
    return spark.createDataFrame([(0, "1"), (1, '"two"'), (2, "[3]"), (3, '{"four":4}'), (4, "null")], "id long, j string")


PRESETS = {
    "employees_500": lambda s: people(s, 500), "people_100": lambda s: people(s, 100), "iot_sensors": iot, "weather": weather,
    "products": products, "tiny_object": tiny, "config": config, "rag": rag, "mixed_array": mixed,
}
