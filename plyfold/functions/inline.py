"""Nested values in one line: [a, b], {key: value} and Name(a, b); and blocks of indented `key: value` lines.

Written by Column expressions. Read by one Arrow-batched function, which turns the text to JSON for from_json or parse_json.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars

# How deep values may nest, numbers as JSON has them, and the characters after a backslash.
MAX_DEPTH = 100
NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}
CALL = re.compile(r"(\w+)\(")
LEAVES = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def supported(kind: T.DataType) -> bool:
    """Whether every part of a type has an inline form: others, such as variants and maps with keys that are no strings, have none."""
    if isinstance(kind, T.ArrayType):
        return supported(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and supported(kind.valueType)
    if isinstance(kind, T.StructType):
        return len(set(kind.names)) == len(kind.names) > 0 and all(supported(f.dataType) for f in kind.fields)
    return isinstance(kind, LEAVES)


def type_name(column: str) -> str:
    """The name before the parentheses: the column's, capitalised."""
    name = re.sub(r"\W", "", column)
    return name[:1].upper() + name[1:] if name else "Item"


def written(value: Column, kind: T.DataType, name: str | None = None) -> Column:
    """A value as inline text; a struct with a name is Name(fields in order), one without is {field: value}. Nulls are `null`."""
    if isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: written(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(scalars.quoted(e["key"]), F.lit(": "), written(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), pair), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        cells = [written(value.getField(f.name), f.dataType, name and type_name(f.name)) for f in kind.fields]
        if name:
            out = F.concat(F.lit(f"{name}("), F.concat_ws(", ", *cells), F.lit(")"))
        else:
            out = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(scalars.quoted(F.lit(f.name)), F.lit(": "), c) for f, c in zip(kind.fields, cells)]), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = scalars.quoted(value)
    elif isinstance(kind, T.BinaryType):
        out = scalars.escape(F.base64(value))
    else:
        out = scalars.text_of(value, kind)
    return F.when(value.isNull(), "null").otherwise(out)


def quote_end(text: str, i: int) -> int:
    """The place of the quote that closes the one at i; the text's length if none does."""
    i += 1
    while i < len(text) and text[i] != '"':
        i += 2 if text[i] == "\\" else 1
    return min(i, len(text))


def plain(text: str) -> str:
    """What stands between two quotes, unescaped; an unknown escape stays as it is."""
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text, flags=re.S)


def scalar_json(word: str) -> str:
    """JSON of a bare word: numbers keep their digits, `-` and nothing at all are null."""
    if word in ("", "-", "null"):
        return "null"
    return word if word in ("true", "false") or NUMBER.fullmatch(word) else json.dumps(word)


def to_json(text: str, kind: T.DataType | None = None, names: dict[str, list[str]] | None = None) -> str:
    """JSON of an inline value. Name(a, b) becomes an object if its type or the fields of its name are known, else an array.

    Raises ValueError where a bracket has no end, text is left over, or the nesting is deeper than MAX_DEPTH.
    """

    def skip(i: int) -> int:
        while i < len(text) and text[i].isspace():
            i += 1
        return i

    def bare(i: int, stop: str) -> tuple[str, int]:
        j = i
        while j < len(text) and text[j] not in stop:
            j += 1
        return text[i:j].strip(), j

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] == '"':
            end = quote_end(text, i)
            name, i = plain(text[i + 1 : end]), skip(end + 1)
        else:
            name, i = bare(i, ":,}")
        if text[i : i + 1] != ":":
            raise ValueError(f"a key without a colon at {i}")
        return json.dumps(name), skip(i + 1)

    def parts(i: int, close: str, depth: int, types) -> tuple[list[str], int]:
        """Values, or `key: value` where close is a brace, from i to the closing character."""
        out: list[str] = []
        i = skip(i)
        while text[i : i + 1] != close:
            name = None
            if close == "}":
                name, i = key(i)
            item, i = value(i, depth + 1, types(len(out), name))
            out.append(item if name is None else f"{name}:{item}")
            i = skip(i)
            if text[i : i + 1] == ",":
                i = skip(i + 1)
            elif text[i : i + 1] != close:
                raise ValueError(f"{close} expected at {i}")
        return out, i + 1

    def value(i: int, depth: int, kind) -> tuple[str, int]:
        if depth > MAX_DEPTH:
            raise ValueError(f"deeper than {MAX_DEPTH}")
        i = skip(i)
        c = text[i : i + 1]
        if c == '"':
            end = quote_end(text, i)
            return json.dumps(plain(text[i + 1 : end])), end + 1
        if c == "[":
            out, i = parts(i + 1, "]", depth, lambda n, _: getattr(kind, "elementType", None))
            return f"[{','.join(out)}]", i
        if c == "{":
            fields = {json.dumps(f.name): f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
            out, i = parts(i + 1, "}", depth, lambda _, name: fields.get(name, getattr(kind, "valueType", None)))
            return f"{{{','.join(out)}}}", i
        called = CALL.match(text, i)
        if called:
            known = kind.fields if isinstance(kind, T.StructType) else []
            out, i = parts(called.end(), ")", depth, lambda n, _: known[n].dataType if n < len(known) else None)
            fields = (names or {}).get(called[1])
            if fields and not known:
                return "{" + ",".join(f"{json.dumps(f)}:{v}" for f, v in zip(fields, out)) + "}", i
            if known:
                return "{" + ",".join(f"{json.dumps(f.name)}:{v}" for f, v in zip(known, out)) + "}", i
            return f"[{','.join(out)}]", i
        word, i = bare(i, ",[]{}()" if depth else "")
        return scalar_json(word), i

    out, i = value(0, 0, kind)
    if skip(i) < len(text):
        raise ValueError(f"text after the value at {i}")
    return out


def read(cell: Column, kind: T.DataType) -> Column:
    """The value of an inline text, by its type."""
    @F.pandas_udf(T.StringType())
    def as_json(cells: pd.Series) -> pd.Series:
        return cells.map(lambda s: None if s is None else '{"v":' + to_json(s, kind) + "}")

    return F.from_json(as_json(cell), T.StructType([T.StructField("v", kind)]))["v"]


def inline_json(cell: Column) -> Column:
    """JSON of inline values of any type, for parse_json."""

    @F.pandas_udf(T.StringType())
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda s: None if s is None else to_json(s))

    return run(cell)


def block_json(text: str) -> str:
    """JSON of indented `key: value` lines: deeper lines below a key without a value are its object, or its list if they begin with [.

    Empty lines, # comments and lines without a colon are skipped; a key with neither value nor deeper lines is left out; of equal
    keys the last counts.
    """
    lines = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    depth = [len(x) - len(x.lstrip()) for x in lines]
    top: dict[str, object] = {}
    open_: list[tuple[int, dict]] = [(-1, top)]
    i = 0
    while i < len(lines):
        line, at = lines[i].strip(), depth[i]
        i += 1
        colon = line.find(":", quote_end(line, 0)) if line.startswith('"') else line.find(":")
        if colon <= 0:
            continue
        while open_[-1][0] >= at:
            open_.pop()
        raw, said = line[:colon].strip(), line[colon + 1 :].strip()
        name = plain(raw[1:-1]) if raw.startswith('"') else raw
        below = i
        while below < len(lines) and depth[below] > at:
            below += 1
        if said:
            open_[-1][1][name] = to_json(said)
        elif below > i and lines[i].strip().startswith("["):
            open_[-1][1][name] = to_json(" ".join(x.strip() for x in lines[i:below]))
            i = below
        elif below > i:
            if len(open_) > MAX_DEPTH:
                raise ValueError(f"deeper than {MAX_DEPTH}")
            inner: dict[str, object] = {}
            open_[-1][1][name] = inner
            open_.append((at, inner))
    dump = lambda x: x if isinstance(x, str) else "{" + ",".join(f"{json.dumps(k)}:{dump(v)}" for k, v in x.items()) + "}"
    return dump(top)


def key_value_json(block: Column) -> Column:
    """JSON of texts of indented `key: value` lines."""

    @F.pandas_udf(T.StringType())
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda s: None if s is None else block_json(s))

    return run(block)
