"""Tables of equally long arrays as documents: @A with rows and columns, then the cells; and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import inline
from ..operators.deltas import unrepeat
from ..operators.ordering import with_ordinal
from ..operators.shapes import is_matrix
from .document import split_row


def encode_matrix(df: DataFrame, array: str, order_by: list[str] | str, level: int = 2, block_rows: int | None = 65_536) -> DataFrame:
    """(block, ord, line) of an array column in the order of `order_by`; each block is a document, header lines have negative ord.

    At level 3 a cell equal to the one above is ~. Raises ValueError if the rows are not a matrix (two rows at least, one length
    over zero, no null row); null elements come back as nulls.
    """
    kind = df.schema[array].dataType.elementType
    shape = is_matrix(df, array).first()
    if not shape.is_matrix or not inline.supported(kind):
        raise ValueError("not a matrix")
    ordered = with_ordinal(df, [order_by] if isinstance(order_by, str) else order_by, block_rows)
    cells = F.transform(F.col(f"`{array}`"), lambda v: inline.written(v, kind))
    rows = ordered.select(F.col("__block").alias("block"), F.col("__ord").alias("ord"), cells.alias("cells"))
    if level == 3:
        above = F.lag("cells").over(Window.partitionBy("block").orderBy("ord"))
        rows = rows.withColumn("above", above).select("block", "ord", F.when(F.col("above").isNull(), F.col("cells")).otherwise(F.zip_with("cells", "above", lambda a, b: F.when(a == b, "~").otherwise(a))).alias("cells"))
    body = rows.select("block", "ord", F.array_join("cells", "\t" if level == 3 else ", ").alias("line"))
    sized = F.concat(F.lit("@A "), F.col("n").cast("string"), F.lit(f" {shape.n_cols}"))
    head = body.groupBy("block").agg(F.count("*").alias("n")).select("block", F.inline(F.array(F.struct(F.lit(-2).cast("long").alias("ord"), F.lit(f"@v{level}").alias("line")), F.struct(F.lit(-1).cast("long").alias("ord"), sized.alias("line")))))
    return head.unionByName(body)


def decode_matrix(lines: DataFrame, kind: T.DataType) -> DataFrame:
    """(block, ord, row array<kind>) of encode_matrix()'s lines. Raises ValueError if a block's row count is not the declared one."""
    head = {r.line[:2]: r.line for r in lines.filter("ord < 0").groupBy(F.substring("line", 1, 2).alias("k")).agg(F.min("line").alias("line")).collect()}
    level, n_cols = int(head["@v"][2:]), int(head["@A"].split()[2])
    if lines.groupBy("block").agg(F.max(F.when(F.col("ord") < 0, F.regexp_extract("line", r"^@A (\d+) ", 1).try_cast("long"))).alias("n"), F.count(F.when(F.col("ord") >= 0, 1)).alias("is_n")).filter("n is null or n <> is_n").limit(1).count():
        raise ValueError("rows declared and found differ")
    cells = lines.filter("ord >= 0").select("block", "ord", split_row(F.col("line"), "\t" if level == 3 else ", ").alias("cells"))
    w = Window.partitionBy("block").orderBy("ord")
    if level == 3:
        cells = cells.select("block", "ord", F.array(*[unrepeat(F.get("cells", F.lit(i)), w) for i in range(n_cols)]).alias("cells"))
    joined = F.concat(F.lit("["), F.array_join("cells", ", "), F.lit("]"))
    return cells.select("block", "ord", inline.read(joined, T.ArrayType(kind)).alias("row"))
