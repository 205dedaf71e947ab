"""python -m plyfold compress | decompress | analyze [FILE] [-o FILE] [--key COLUMN] [--level N]"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import inline
from ..functions.tokens import exact_count
from ..plans.advisor import analyze, auto_level
from ..plans.document import decode_text, encode_text
from ..plans.foreign import document_json
from ..plans.header import read_header

POSITION = "__position"


def read_input(path: str | None) -> str:
    if path:
        return Path(path).read_text()
    if sys.stdin.isatty():
        raise SystemExit("give a file, or data on standard input")
    return sys.stdin.read()


def table(spark: SparkSession, text: str):
    """A JSON array of objects as a table with a column for its order; JSON of one object is a table of one row."""
    data = json.loads(text)
    rows = data if isinstance(data, list) else [data]
    lines = [json.dumps(r) for r in rows]
    numbered = spark.createDataFrame(list(enumerate(lines)), f"{POSITION} long, j string")
    kind = spark.read.json(spark.sparkContext.parallelize(lines, 1)).schema
    return numbered.select(POSITION, F.from_json("j", kind).alias("r")).select(POSITION, "r.*")


def compressed(spark: SparkSession, text: str, level: str) -> str:
    """The document of a JSON text, or its JSON without spaces where no document gives the same value back or, with auto, none is shorter.

    One object is an inline value. A list goes without its plan if the header alone tells how to read it.
    """
    data = json.loads(text)
    plain = json.dumps(data, ensure_ascii=False, separators=(",", ":"))
    df, found = table(spark, text), None
    if isinstance(data, dict):
        row = df.drop(POSITION)
        found = "@v1\n" + row.select(inline.written(F.struct("*"), row.schema).alias("line")).first().line
    elif df.columns != [POSITION]:
        n = auto_level(df, POSITION).first().best if level == "auto" else int(level)
        if n:
            short = encode_text(df, POSITION, level=n, embed_plan=False, order_hidden=True)
            found = short if same(spark, short, data) else encode_text(df, POSITION, level=n)
    if found is None or level == "auto" and len(found) >= len(plain) or not same(spark, found, data):
        return plain
    return found


def same(spark: SparkSession, text: str, data) -> bool:
    try:
        return decompressed(spark, text) == data
    except ValueError:
        return False


def decompressed(spark: SparkSession, text: str):
    """The value of a document, or of anything that document_json() reads."""
    text = text.rstrip("\n")
    header, _ = read_header(text.split("\n")) if text.startswith("@v") else (None, 0)
    if header is None or header.plan is None:
        found = document_json(text, strict=True)
        return None if found is None else json.loads(found)
    rows = decode_text(spark, text)
    order = [POSITION] if POSITION in rows.columns else []
    rows = rows.orderBy(*order).drop(POSITION) if order else rows
    return [json.loads(r.value) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator()]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plyfold", description=__doc__)
    p.add_argument("command", choices=("compress", "decompress", "analyze"))
    p.add_argument("file", nargs="?")
    p.add_argument("-o", "--output")
    p.add_argument("--level", choices=("auto", "1", "2", "3"), default="auto")
    p.add_argument("--exact-tokens", metavar="VOCABULARY", help="a tokenizer file: analyze counts its tokens besides the estimate")
    a = p.parse_args(args)
    text = read_input(a.file)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "decompress":
        out = json.dumps(decompressed(spark, text), indent=2, ensure_ascii=False)
    elif a.command == "compress":
        out = compressed(spark, text, a.level)
    else:
        r = analyze(table(spark, text), POSITION, a.file or "-").first().asDict()
        short = compressed(spark, text, a.level)
        size, new = len(text.encode()), len(short.encode())
        r |= {"bytes": size, "output_bytes": new, "byte_reduction": round(100 * (size - new) / max(1, size), 1)}
        if a.exact_tokens:
            r |= {"exact_tokens": exact_count(text, a.exact_tokens), "exact_output_tokens": exact_count(short, a.exact_tokens)}
        out = "\n".join(f"{k}: {v}" for k, v in r.items())
    if a.output:
        Path(a.output).write_text(out + "\n")
    else:
        print(out)
    return 0
