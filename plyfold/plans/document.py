"""Tables to documents and back.

encode() measures a table in one or two jobs, fixes a plan on the driver (which column has which codec; a column has exactly
one), and writes rows with Column expressions and windows. decode() follows the plan and never guesses from the text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import inline, scalars
from ..operators import deltas, dictionary, integrity, substrings, templates
from ..operators.ordering import with_ordinal
from ..tables import discard
from .header import Header, hint, read_header

# Which columns can take differences, and the limits of the options.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
FLAT = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType, *TEMPORAL)
MARKS = r'["\[{(]'


@dataclass
class Options:
    level: int = 2
    max_dict_size: int = 1024
    delta_threshold: int = 3
    min_dict_value_length: int = 2
    min_dict_frequency: int = 2
    name: str | None = None
    block_rows: int | None = 65_536
    checksum: bool = True
    embed_plan: bool = True
    order_hidden: bool = False  # the columns of the order are no part of the document


@dataclass
class Plan:
    """All that decode() needs besides the rows."""

    level: int
    schema: str  # JSON of the StructType
    codecs: dict[str, str]  # column -> text | uuid | bool | number | delta | micros | days | inline | json
    dictionary: list[str] = field(default_factory=list)
    templates: dict[str, list[str]] = field(default_factory=dict)  # column -> [prefix, suffix]
    fragments: list[str] = field(default_factory=list)
    repeat: bool = False
    name: str = "A"

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=True, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        return Plan(**json.loads(text))


@dataclass
class Encoded:
    """A document: `cells` (block, ord, an array of cells) and `lines` (block, ord, line), header lines with negative ord."""

    plan: Plan
    cells: DataFrame
    lines: DataFrame
    ordered: DataFrame | None = None  # the stored rows that cells and lines are made from

    def discard(self) -> None:
        """Delete the stored rows, once cells and lines are written somewhere."""
        if self.ordered is not None:
            discard(self.ordered)

    def text(self) -> str:
        """The lines of a small document (one block), joined; for documents that fit on the driver."""
        return "\n".join(r.line for r in self.lines.orderBy("block", "ord").collect())


def _numeric(value: Column, kind: T.DataType) -> Column:
    """A whole number for a column that takes differences."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp"))
    return value.cast("decimal(38,0)") if isinstance(kind, T.DecimalType) else value.cast("long")


def _can_delta(kind: T.DataType) -> bool:
    return isinstance(kind, (*EXACT, *TEMPORAL)) or isinstance(kind, T.DecimalType) and kind.scale == 0


def make_plan(ordered: DataFrame, struct: T.StructType, o: Options) -> tuple[Plan, int]:
    """(plan, number of rows) of a table with __ord and __block."""
    name = o.name or ("Entity" if {"id", "name"} <= set(struct.names) else "Item")
    codecs: dict[str, str] = {}
    for f in struct.fields:
        k = f.dataType
        codecs[f.name] = ("inline" if inline.supported(k) else "json") if not isinstance(k, FLAT) else "bool" if isinstance(k, T.BooleanType) else "text" if isinstance(k, (T.StringType, *TEMPORAL, T.BinaryType)) else "number"
    plan = Plan(o.level, struct.json(), codecs, name=name if o.level == 1 else "A")
    strings = [f.name for f in struct.fields if isinstance(f.dataType, T.StringType)]
    if o.level == 3 and strings:
        ids = ordered.agg(*[F.coalesce(F.min(F.col(f"`{c}`").rlike(scalars.UUID)), F.lit(False)).alias(f"u{i}") for i, c in enumerate(strings)]).first()
        codecs.update({c: "uuid" for i, c in enumerate(strings) if ids[i]})
        strings = [c for c in strings if codecs[c] != "uuid"]
    moving = {f.name: "temporal" if isinstance(f.dataType, TEMPORAL) else "numeric" for f in struct.fields if _can_delta(f.dataType)} if o.level == 3 else {}
    if moving:
        seen = ordered.select("__ord", "__block", *[_numeric(F.col(f"`{c}`"), struct[c].dataType).alias(f"v{i}") for i, c in enumerate(moving)])
        stats = deltas.eligibility(seen, {f"v{i}": k for i, k in enumerate(moving.values())}, "__ord", "__block", o.delta_threshold)
        good = {r.col for r in stats.collect() if r.eligible}
        for i, (c, k) in enumerate(moving.items()):
            if f"v{i}" in good:
                codecs[c] = "delta" if k == "numeric" else "days" if isinstance(struct[c].dataType, T.DateType) else "micros"
    if o.level >= 2 and strings:
        entries = dictionary.profitable(dictionary.frequencies(ordered, strings, "__ord"), o.max_dict_size, o.min_dict_value_length, o.min_dict_frequency)
        plan.dictionary = [r.value for r in dictionary.numbered(entries).orderBy("idx").collect()]  # MAX_REFS rows at most
    plain = [c for c in strings]
    if o.level >= 2 and plain:
        marked = ordered.select(*[F.when(F.col(f"`{c}`").isin(plan.dictionary), "$").otherwise(F.col(f"`{c}`")).alias(c) for c in plain])
        plan.templates = {r.col: [r.prefix, r.suffix] for r in templates.detect(marked, plain).collect()}
    count = ordered.count()
    if o.level == 3 and strings and count >= substrings.MIN_FREQUENCY:
        rest = ordered.select(*[_stripped(F.col(f"`{c}`"), c, plan).alias(c) for c in strings])
        plan.fragments = substrings.choose(substrings.ngrams(rest, strings))
    plan.repeat = o.level == 3 and count >= o.delta_threshold
    return plan, count


def _stripped(value: Column, column: str, plan: Plan) -> Column:
    """What is left of a string after the dictionary (null) and its template."""
    if column in plan.templates:
        return templates.strip(value, *plan.templates[column])
    if plan.dictionary:
        return F.when(~value.isin(plan.dictionary), value)
    return value


def _cell(column: str, kind: T.DataType, plan: Plan) -> Column:
    """A column's cell without delta and repeat."""
    v, codec = F.col(f"`{column}`"), plan.codecs[column]
    null = "null" if plan.level == 1 else "-"
    if codec == "bool":
        out = v.cast("string") if plan.level == 1 else F.when(v, "1").otherwise("0")
    elif codec == "inline":
        out = inline.written(v, kind, inline.type_name(column))
    elif codec == "uuid":
        out = scalars.uuid_to_base62(v)
    elif codec == "json":
        out = scalars.quoted(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}))
    elif isinstance(kind, T.StringType):
        rest = templates.strip(v, *plan.templates[column]) if column in plan.templates else v
        text = scalars.quoted(substrings.apply(rest, plan.fragments) if plan.fragments else rest, column in plan.templates)
        out = text
        if plan.dictionary and column not in plan.templates:
            out = F.coalesce(F.col(f"`__ref_{column}`"), text)
    else:
        text = scalars.text_of(v, kind)
        out = scalars.compact_date(text) if plan.level >= 2 and isinstance(kind, TEMPORAL) else text
    return F.when(v.isNull(), null).otherwise(out)


def encode(df: DataFrame, order_by: list[str] | str, options: Options | None = None, **given) -> Encoded:
    """A table as a document, in the order of `order_by`.

    Every block of block_rows rows is a document of its own (its first row absolute, its own row count and checksum), so encoding
    and decoding run in parallel over blocks, and a block's lines fit in a row for the checksum. With None the whole table is one
    document that one task writes: for small tables. Types nested deeper than integrity.MAX_DEPTH raise ValueError. Null cells, any
    text, NaN and infinities come back as they were; nested columns are inline values, or cells of JSON where a type has no inline form. An empty table has no block.
    """
    o = options or Options(**given)
    keys = [order_by] if isinstance(order_by, str) else order_by
    struct = T.StructType([f for f in df.schema.fields if not (o.order_hidden and f.name in keys)])
    integrity.check_depth(struct)
    ordered = with_ordinal(df, keys, o.block_rows)
    plan, _ = make_plan(ordered, struct, o)
    w = Window.partitionBy("__block").orderBy("__ord")
    cells, held = [], ordered
    for f in struct.fields:
        if plan.dictionary and isinstance(f.dataType, T.StringType) and f.name not in plan.templates and plan.codecs[f.name] == "text":
            ordered = ordered.join(dictionary.references(df.sparkSession, plan.dictionary, f"__ref_{f.name}"), F.col(f"`{f.name}`") == F.col("__value"), "left").drop("__value")
    for f in struct.fields:
        codec = plan.codecs[f.name]
        if codec in ("delta", "micros", "days"):
            cell = deltas.delta(_numeric(F.col(f"`{f.name}`"), f.dataType), w)
        else:
            cell = _cell(f.name, f.dataType, plan)
            cell = deltas.repeat(cell, w) if plan.repeat else cell
        cells.append(cell)
    rows = ordered.select(F.col("__block").alias("block"), F.col("__ord").alias("ord"), F.array(*cells).alias("cells"))
    sep = "\t" if plan.level == 3 else ", "
    body = rows.select("block", "ord", F.array_join("cells", sep).alias("line"))
    header = Header(plan.level, plan.name, [(f.name, hint(f.dataType)) for f in struct.fields], plan.dictionary, {struct.names.index(c): tuple(t) for c, t in plan.templates.items()}, plan.fragments, plan=plan.to_json() if o.embed_plan else None)
    *fixed, _ = header.lines()
    sized = body.groupBy("block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("rows") if o.checksum else F.lit(None).alias("rows"))
    after = F.concat(F.lit("@N"), F.col("n").cast("string"), F.lit(f" {plan.name}"))
    whole = F.concat_ws("\n", F.lit("\n".join(fixed)), after, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    first = [F.struct(F.lit(-1000 + i).cast("long").alias("ord"), F.lit(x).alias("line")) for i, x in enumerate(fixed) if i == 0]
    if o.checksum:
        crc = F.lpad(F.lower(F.hex(F.crc32(whole.cast("binary")))), 8, "0")
        first.append(F.struct(F.lit(-999).cast("long").alias("ord"), F.concat(F.lit("@C "), crc).alias("line")))
    first += [F.struct(F.lit(-998 + i).cast("long").alias("ord"), F.lit(x).alias("line")) for i, x in enumerate(fixed[1:])]
    first.append(F.struct(F.lit(-1).cast("long").alias("ord"), after.alias("line")))
    head = sized.select("block", F.inline(F.array(*first)))
    return Encoded(plan, rows, head.unionByName(body), held)


def split_row(line: Column, sep: str, flat: bool = False) -> Column:
    """Cells of a line, cut at the separator outside double quotes and brackets; an escaped character never ends a quote.

    Lines without quotes and brackets are cut by split(). In a `flat` document brackets stand only in quotes, so quoted cells
    without escapes are cut by one pattern too. Only what is left goes to Python, and nothing at all if there is no such line.
    """
    quote_end = inline.quote_end

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(lines: pd.Series) -> pd.Series:
        def one(text: str) -> list[str]:
            out, i, start, depth = [], 0, 0, 0
            while i < len(text):
                c = text[i]
                if c == '"' and (depth or i == start):
                    i = quote_end(text, i) + 1
                elif not depth and text.startswith(sep, i):
                    out.append(text[start:i])
                    i = start = i + len(sep)
                else:
                    depth += (c in "[{(") - (c in ")}]")
                    i += 1
            return [*out, text[start:]]

        return lines.map(lambda x: None if x is None else one(x))

    plain = ~line.rlike('"' if flat else MARKS)
    easy = F.split(line, sep, -1)
    if flat:
        quoted = ~F.contains(line, F.lit("\\"))
        cells = F.regexp_extract_all(line, F.lit(rf'(?:^|{sep})("[^"]*+"|[^{sep[0]}"][^{sep[0]}]*+)'), F.lit(1))
        return F.when(plain, easy).when(quoted, cells).otherwise(cut(F.when(~plain & ~quoted, line)))
    return F.when(plain, easy).otherwise(cut(F.when(~plain, line)))


def decode_cells(cells: DataFrame, plan: Plan) -> DataFrame:
    """The table from (block, ord, cells) and its plan, with its columns and types."""
    w = Window.partitionBy("block").orderBy("ord")
    struct = plan.struct
    raw = cells.select("block", "ord", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(struct.fields))])
    out = []
    for i, f in enumerate(struct.fields):
        c, codec, kind = F.col(f"c{i}"), plan.codecs[f.name], f.dataType
        if codec in ("delta", "micros", "days"):
            n = deltas.undelta(c, w, "decimal(38,0)" if isinstance(kind, T.DecimalType) else "long")
            v = F.timestamp_micros(n) if codec == "micros" else F.date_from_unix_date(n.cast("int")) if codec == "days" else n
            out.append(v.cast(kind).alias(f.name))
            continue
        c = deltas.unrepeat(c, w) if plan.repeat else c
        null = "null" if plan.level == 1 else "-"
        if codec == "bool":
            v = c == ("true" if plan.level == 1 else "1")
        elif codec == "inline":
            v = inline.read(F.when(c != null, c), kind)
        elif codec == "uuid":
            v = scalars.base62_to_uuid(c)
        elif codec == "json":
            v = F.from_json(scalars.unquoted(c), T.StructType([T.StructField("v", kind)]))["v"]
        elif isinstance(kind, T.StringType):
            text = scalars.unquoted(c)
            text = substrings.expand(text, plan.fragments) if plan.fragments else text
            v = templates.expand(text, *plan.templates[f.name]) if f.name in plan.templates else text
            if plan.dictionary and f.name not in plan.templates:
                v = F.when(scalars.is_ref(c), F.get(F.array(*map(F.lit, plan.dictionary)), scalars.ref_index(c))).otherwise(v)
        else:
            v = scalars.value_of(scalars.expand_date(c) if plan.level >= 2 and isinstance(kind, TEMPORAL) else c, kind)
        v = F.when(c != null, v)
        out.append((v if codec in ("inline", "json") else v.cast(kind)).alias(f.name))  # nested values have their type, but for what can't be null
    return raw.select(*out)


def decode(lines: DataFrame, plan: Plan | None = None, strict: bool = True) -> DataFrame:
    """The table from (block, ord, line). Without a plan, the one in the header of the first block is taken.

    The checksum and the row count of every block are compared; with `strict` a difference fails the job, else its block is kept.
    """
    if plan is None:
        found = lines.filter("ord < 0 and line like '#plan %'").limit(1).collect()
        if not found:
            raise ValueError("the document holds no plan; give one")
        plan = Plan.from_json(found[0].line[6:])
    body = lines.filter("ord >= 0")
    if strict:
        said = lines.filter("ord < 0").groupBy("block").agg(F.max(F.when(F.col("line").startswith("@C "), F.substring("line", 4, 8))).alias("crc"), F.max(F.regexp_extract("line", r"^@N(\d+) ", 1)).alias("n"))
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("line").startswith("@C ") | (F.col("ord") >= 0), F.struct("ord", "line")))), lambda r: r["line"]), "\n")
        now = lines.groupBy("block").agg(F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0").alias("is_crc"), F.count(F.when(F.col("ord") >= 0, 1)).alias("is_n"))
        bad = said.join(now, "block").filter("(crc is not null and crc <> is_crc) or cast(n as bigint) <> is_n")
        wrong = bad.select("block").limit(5).collect()
        if wrong:
            raise ValueError(f"checksum or row count differs in blocks {[r.block for r in wrong]}")
    sep, flat = "\t" if plan.level == 3 else ", ", "inline" not in plan.codecs.values()
    return decode_cells(body.select("block", "ord", split_row(F.col("line"), sep, flat).alias("cells")), plan)


def encode_text(df: DataFrame, order_by: list[str] | str, **options) -> str:
    """The document of a small table as one text."""
    return encode(df, order_by, **{"block_rows": None} | options).text()


def verify_text(text: str, strict: bool = True) -> Header:
    """The header of a document whose checksum and row count are right; else ValueError, or a warning without `strict`."""
    import warnings

    lines = text.split("\n")
    header, n = read_header(lines)
    problems = []
    if header.checksum is not None:
        rest = "\n".join(x for i, x in enumerate(lines) if not (i < n and x.startswith("@C ")))
        if f"{zlib.crc32(rest.encode()):08x}" != header.checksum:
            problems.append("checksum differs")
    if n and lines[n - 1].startswith(("@N", "@A")) and len(lines) - n != header.rows:
        problems.append(f"{header.rows} rows declared, {len(lines) - n} found")
    if problems and strict:
        raise ValueError("; ".join(problems))
    for p in problems:
        warnings.warn(p, stacklevel=2)
    return header


def decode_text(spark: SparkSession, text: str, plan: Plan | None = None, strict: bool = True) -> DataFrame:
    """The table of a document given as one text. Without a plan, given or in the header, foreign.read_any() reads it."""
    from .foreign import read_any

    lines = text.split("\n")
    header, n = read_header(lines) if text.startswith("@v") else (Header(), 0)
    if plan is None and header.plan is None:
        return read_any(spark, text, strict)
    header = verify_text(text, strict)
    plan = plan or Plan.from_json(header.plan)
    rows = [(0, i, x) for i, x in enumerate(lines[n:])]
    return decode(spark.createDataFrame(rows, "block long, ord long, line string"), plan, strict=False)


def blocks_of(texts: Iterator[str]) -> Iterator[tuple[int, int, str]]:
    """(block, ord, line) of whole documents, one block each; header lines get negative places."""
    for block, text in enumerate(texts):
        lines = text.split("\n")
        _, n = read_header(lines)
        yield from ((block, i - n, x) for i, x in enumerate(lines))
