"""A corpus pipeline of five stages; each takes what its predecessor kept, as Parquet, and hands on the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyfold.llm import decontaminate, packing, pii, quality, simhash
from plyfold.llm.common import discard, materialize, table
from plyfold.llm.queries import PII_KEY

THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with no look at their labels once it is trained."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=docs.columns).filter(F.col("score") >= THRESHOLD).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs and a column __hash; rows with one doc_id (or none) and one __hash are equal."""
    return docs.withColumn("__hash", F.xxhash64(*docs.columns))


def without(rows: DataFrame, gone: DataFrame, how: str = "left_anti", many: bool = False) -> DataFrame:
    """Rows of keyed() whose (doc_id, __hash) is not in `gone`, null ids being equal; `many` keys are joined by sorting at any size."""
    keys = gone.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h")).distinct()
    keys = keys.hint("merge") if many else keys
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), how)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id, null last; equal ids are told apart by a hash of the row.

    Near duplicates agree in 0.8 of 128 SimHash bits of five-word shingles. Repeated rows and rows without doc_id are grouped like
    all others, and so are rows without words. Only keys are moved to find the groups; texts are moved once, to leave out those that
    go: their keys grow with the table, so they are never broadcast.
    """
    rows = keyed(docs)
    met = simhash.copy_groups(rows, ["doc_id", "__hash"]).groupBy("__group", "doc_id", "__hash").agg(F.count("*").alias("n"))
    met = materialize(met, "group-keys")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"))
    first = met.groupBy("__group").agg(F.min(order).alias("first")).select("first.__id", "first.__h", F.lit(True).alias("stays"))
    # joined by row key and not by group, as one group may hold a great share of all rows
    marked = met.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    marked = marked.select("doc_id", "__hash", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    marked = materialize(marked.filter("not stays or n > 1"), "group-marks")
    left, twice = without(rows, marked.filter("not stays"), many=True), marked.filter("stays")
    if not twice.isEmpty():  # equal rows: one of them
        left = without(left, twice).unionByName(without(left, twice, "left_semi").dropDuplicates(["doc_id", "__hash"]))
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, with a doc_id or without."""
    rows = keyed(docs)
    leaks = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), keys=["doc_id", "__hash"])
    return without(rows, leaks).select(*docs.columns)


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return pii.pseudonymize(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document: its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("pii", pseudonymized),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
