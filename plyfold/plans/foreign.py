"""Documents of other writers: JSON of any document text, from its header lines alone.

One Arrow-batched function for a column of whole documents. Large tables of our own writing go through decode(), line by line.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import inline, scalars
from .header import Header, read_header

# A number alone in a document, a step in a cell, and seconds in the units of steps of time.
ALONE = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
STEP = re.compile(r"[+-]\d+(\.\d+)?(us|s)?")
DATE = re.compile(scalars.COMPACT)
QUOTED = re.compile(scalars.QUOTED)
MARKS = re.compile(r'["()\[\]{}]')


def depth(text: str) -> int:
    """Deepest nesting of brackets outside double quotes."""
    at = most = 0
    for c in re.findall(r"[()\[\]{}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S)):
        at += 1 if c in "([{" else -1
        most = max(most, at)
    return most


def cut(line: str, sep: str) -> list[str]:
    """Cells of a line, cut at the separator outside quotes and brackets."""
    if not MARKS.search(line):
        return [x.strip() for x in line.split(sep)]
    out, i, start, level = [], 0, 0, 0
    while i < len(line):
        if line[i] == '"' and (level or not line[start:i].strip()):
            i = inline.quote_end(line, i) + 1
        elif not level and line.startswith(sep, i):
            out.append(line[start:i].strip())
            i = start = i + len(sep)
        else:
            level += (line[i] in "[{(") - (line[i] in ")}]")
            i += 1
    return [*out, line[start:].strip()]


def iso_date(text: str) -> str:
    """A compact date with its separators; any other text as it is."""
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(?:(\d\d)(\.\d+)?)?(Z?))?", text)
    if not m:
        return text
    y, mo, d, h, mi, s, frac, z = m.groups()
    return f"{y}-{mo}-{d}" + (f"T{h}:{mi}" + (f":{s}{frac or ''}" if s else "") + z if h else "")


def summed(cells: list[str]) -> list[str]:
    """A column of steps as values: whole numbers and decimals exactly, steps of time from an ISO or compact date."""
    import datetime as dt
    from decimal import Decimal

    first, unit = cells[0], next((m[2] for c in cells[1:] if (m := STEP.fullmatch(c)) and m[2]), None)
    if unit:
        text = iso_date(first)
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        out = []
        for k, c in enumerate(cells):
            if k:
                n = int(re.match(r"[+-]\d+", c)[0])
                at += dt.timedelta(microseconds=n) if unit == "us" else dt.timedelta(seconds=n)
            if len(text) == 10:
                out.append(f"{at:%Y-%m-%d}")
            else:
                out.append(at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + ("Z" if text.endswith("Z") else ""))
        return [json.dumps(x) for x in out]
    out, at = [first], Decimal(first)
    for c in cells[1:]:
        at = at + Decimal(c) if c[0] in "+-" else Decimal(c)
        out.append(f"{at:f}")
    return out


def cell_json(cell: str, h: Header, hint: str = "", column: int | None = None) -> str:
    """JSON of one cell. Marks and hints decide; other words are numbers if they read as such, else strings."""
    if column in h.templates:
        a, b = h.templates[column]
        return json.dumps(a + expanded(unquoted(cell), h.fragments) + b)
    if cell[:1] == '"':
        return json.dumps(expanded(unquoted(cell), h.fragments))
    if h.dictionary and re.fullmatch(r"\$[0-9a-zA-Z]{1,2}", cell):
        d = [scalars.REF_DIGITS.index(c) for c in cell[1:]]
        k = d[0] if len(d) == 1 else 62 + d[0] * 62 + d[1]
        return json.dumps(h.dictionary[k]) if k < len(h.dictionary) else json.dumps(cell)
    if cell in ("", "null") or cell == "-":
        return "null"
    if hint == "?b":
        return "true" if cell in ("1", "true") else "false" if cell in ("0", "false") else json.dumps(cell)
    if hint == "?d" or h.level >= 2 and not ALONE.fullmatch(cell) and DATE.fullmatch(cell):
        return json.dumps(iso_date(cell))
    if h.level >= 2 and re.fullmatch(r"\^[0-9A-Za-z]{1,22}", cell):
        return json.dumps(scalars.uuid_text(cell))
    if cell[0] in "[{" or cell.endswith(")") and inline.CALL.match(cell):
        return inline.to_json(cell, names={n: [f for f, _ in fields] for n, fields in h.schemas.items()})
    if ALONE.fullmatch(cell) or cell in ("true", "false"):
        return inline.scalar_json(cell)
    return json.dumps(expanded(cell, h.fragments))


def unquoted(cell: str) -> str:
    return inline.plain(cell[1:-1]) if cell[:1] == '"' else cell


def expanded(text: str, fragments: list[str]) -> str:
    """Fragments back in their places; a doubled % is one."""
    if not fragments:
        return text
    return re.sub(r"%%|%(\d+);", lambda m: "%" if m[1] is None else fragments[int(m[1])] if int(m[1]) < len(fragments) else m[0], text)


def rows_json(h: Header, lines: list[str], matrix: bool) -> str:
    """JSON of the lines below @N (objects) or @A (arrays)."""
    sep = "\t" if any("\t" in x for x in lines) else ", "
    fields = [] if matrix else h.schemas[h.name]
    rows = [cut(x, sep) for x in lines]
    n = max(map(len, rows), default=0) if matrix else len(fields)
    columns = []
    for i in range(n):
        cells = [r[i] if i < len(r) else "" for r in rows]
        hint = "" if matrix else fields[i][1]
        for k in range(1, len(cells)) if h.level == 3 else ():
            if cells[k] == "~":
                cells[k] = cells[k - 1]
        moving = not matrix and h.level == 3 and len(cells) > 1 and any(c[:1] == "+" for c in cells[1:]) and all(STEP.fullmatch(c) for c in cells[1:]) and i not in h.templates
        if moving:
            columns.append(summed(cells))
        else:
            known = {c: cell_json(c, h, hint, None if matrix else i) for c in set(cells)}
            columns.append([known[c] for c in cells])
    if matrix:
        return "[" + ",".join("[" + ",".join(c) + "]" for c in zip(*columns)) + "]"
    keys = [json.dumps(f) for f, _ in fields]
    return "[" + ",".join("{" + ",".join(f"{k}:{v}" for k, v in zip(keys, r)) + "}" for r in zip(*columns)) + "]"


def document_json(text: str, strict: bool = False, deepest: int = inline.MAX_DEPTH) -> str | None:
    """JSON of a document, of JSON itself, of a lone value, or of `key: value` lines; None for blank text.

    With `strict` a wrong checksum or row count raises ValueError, as unknown names of rows and nesting over `deepest` always do.
    """
    if depth(text) > deepest:
        raise ValueError(f"deeper than {deepest}")
    text = text.strip()
    if not text:
        return None
    if not text.startswith("@v"):
        if text in ("null", "-"):
            return "null"
        if text in ("true", "false") or ALONE.fullmatch(text):
            return inline.scalar_json(text)
        if len(text) > 1 and text[0] == text[-1] == '"':
            return json.dumps(inline.plain(text[1:-1]))
        if text[0] in "[{":
            try:
                json.loads(text)
                return text
            except json.JSONDecodeError:
                pass
        return json.dumps(text) if "\n" not in text and ":" not in text and text[0] not in "[{" else inline.to_json(text) if text[0] in "[{" else inline.block_json(text)
    lines = text.split("\n")
    h, n = read_header(lines)
    if strict:
        from .document import verify_text

        verify_text(text)
    body = [x for x in lines[n:] if x.strip()]
    head = lines[n - 1] if n else ""
    if head.startswith(("@N", "@A")):
        if strict and len(body) != h.rows:
            raise ValueError(f"{h.rows} rows declared, {len(body)} found")
        if head.startswith("@N") and h.name not in h.schemas:
            raise ValueError(f"rows of an unknown name {h.name!r}")
        return rows_json(h, body, head.startswith("@A"))
    rest = "\n".join(body)
    if not rest:
        return "null"
    names = {k: [f for f, _ in fields] for k, fields in h.schemas.items()}
    if rest[0] in "[{" or inline.CALL.match(rest):
        return inline.to_json(" ".join(x.strip() for x in body), names=names)
    return inline.block_json(rest)


def inline_text(value) -> str:
    """A JSON value as an inline value."""
    if value is None or isinstance(value, (bool, int, float)):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False) if QUOTED.search(value) else value
    if isinstance(value, list):
        return "[" + ", ".join(map(inline_text, value)) + "]"
    return "{" + ", ".join(f"{inline_text(k)}: {inline_text(v)}" for k, v in value.items()) + "}"


def json_document(text: str) -> str:
    """The document of a JSON text of one message, or the text itself where no shorter one comes back as the same value.

    Objects of one shape become rows below one line of names; anything else is an inline value.
    """
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return text
    keys = list(value[0]) if isinstance(value, list) and value and isinstance(value[0], dict) else []
    if len(keys) > 1 and len(value) > 1 and all(isinstance(v, dict) and list(v) == keys for v in value):
        head = Header(1, "A", [(k, "") for k in keys], rows=len(value)).lines()
        out = "\n".join([*head, *(", ".join(inline_text(v[k]) for k in keys) for v in value)])
    else:
        out = "@v1\n" + inline_text(value)
    try:
        same = len(out) < len(text) and json.loads(document_json(out) or "null") == value
    except ValueError:
        same = False
    return out if same else text


def json_documents(text: Column) -> Column:
    """json_document() of a column of messages."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else json_document(s))

    return run(text)


def documents_json(text: Column, strict: bool = False) -> Column:
    """document_json() of a column."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else document_json(s, strict))

    return run(text)


def read_any(spark: SparkSession, text: str, strict: bool = False) -> DataFrame:
    """The table of a document without a plan: a row for each object of a list, with types as spark.read.json finds them; other values in a column `value`."""
    j = document_json(text, strict)
    values = json.loads(j) if j is not None else []
    values = values if isinstance(values, list) else [values]
    if not all(isinstance(v, dict) for v in values):
        values = [{"value": v} for v in values]
    if not values:
        return spark.createDataFrame([], "value string")
    lines = spark.createDataFrame([(json.dumps(v),) for v in values], "j string")
    found = lines.agg(F.schema_of_variant_agg(F.parse_json("j")).alias("s")).first().s
    kind = re.sub(r"\bOBJECT<", "STRUCT<", found).replace("VOID", "STRING")
    return lines.select(F.from_json("j", kind).alias("r")).select("r.*")
