"""Documents as a Spark data source: spark.read.format("plyfold").load(path), df.write.format("plyfold").save(path).

A path holds documents as text files, each with its plan in the header. read_documents() goes through Spark's own reader; the
registered format opens each file on an executor, by the file systems that pyarrow knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.document import Options, Plan, decode, encode
from ..plans.header import read_header


def write_documents(df: DataFrame, order_by: list[str] | str, path: str, level: int = 2, block_rows: int | None = 65_536) -> None:
    """One text file for each block, its lines joined; a block must fit in a row."""
    lines = encode(df, order_by, Options(level=level, block_rows=block_rows)).lines
    docs = lines.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n").alias("value"))
    docs.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def documents(raw: DataFrame) -> DataFrame:
    """(block, ord, line) of a column `value` of whole documents."""
    parts = raw.select(F.xxhash64("value").alias("block"), F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("lines"))
    rows = parts.select("block", "lines", F.posexplode("lines").alias("pos", "line"))
    head = F.expr("array_position(transform(lines, x -> x rlike '^@[NA] ?[0-9]'), true)")
    return rows.select("block", (F.col("pos") - head).cast("long").alias("ord"), "line")


def read_documents(spark: SparkSession, path: str, plan: Plan | None = None, strict: bool = True) -> DataFrame:
    """The table of all documents under a path; they share one plan."""
    raw = spark.read.text(path, wholetext=True).filter("value <> ''")
    if plan is None:
        first = raw.select(F.substring_index("value", "\n@N", 1).alias("head")).first()
        if first is None:
            raise ValueError(f"no document under {path}")
        header, _ = read_header(first.head.split("\n"))
        plan = Plan.from_json(header.plan or "null")
    return decode(documents(raw), plan, strict)


def register(spark: SparkSession) -> None:
    """Make the format known to spark.read and spark.readStream under the name plyfold: lines of documents with their places."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    def opened(where: str):
        """(file system, path in it) of a path or URI."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)

    class Reader(DataSourceReader):
        def __init__(self, where: str):
            self.where = where

        def partitions(self):
            """A partition for each file: names only, no text comes to the driver."""
            from pyarrow import fs

            system, path = opened(self.where)
            if system.get_file_info(path).type == fs.FileType.Directory:
                names = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.startswith("part-"))
            else:
                names = [path]
            return [InputPartition((i, name)) for i, name in enumerate(names)]

        def read(self, partition):
            block, name = partition.value
            system, _ = opened(self.where)
            with system.open_input_stream(name) as f:
                lines = f.read().decode().rstrip("\n").split("\n")
            _, n = read_header(lines)
            yield from ((block, i - n, x) for i, x in enumerate(lines))

    class Documents(DataSource):
        @classmethod
        def name(cls):
            return "plyfold"

        def schema(self):
            return "block long, ord long, line string"

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Documents)
