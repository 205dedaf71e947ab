"""Scalar codecs as Column expressions; Python only where 128-bit numbers need it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Alphabets of dictionary references and of UUIDs, and the forms of dates and UUIDs.
REF_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
UUID_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?$"
COMPACT = r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(T\d{4}(\d{2}(\.\d+)?)?Z?)?$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# A string is quoted if it is empty, holds a separator, quote or bracket, begins or ends with white space, begins
# with a mark, reads as a number or a reserved word.
QUOTED_PART = r"^$|[,\n\r\t\"()\[\]{}\\:]|^\s|\s$|^[@$%+*~^#-]"
QUOTED = QUOTED_PART + r"|^-?\d+(\.\d+)?([eE][+-]?\d+)?$|^(true|false|null|NaN|Infinity|1|0)$"
MAX_REFS = 62 + 62 * 62


def needs_quoting(text: Column) -> Column:
    return text.rlike(QUOTED)


def escape(text: Column) -> Column:
    """text in double quotes, with backslash, quote, line feed, return and tab written as two characters."""
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return F.concat(F.lit('"'), text, F.lit('"'))


def quoted(text: Column, part: bool = False) -> Column:
    """text, in quotes if it needs them; the rest of a templated value (`part`) may look like a number or a word."""
    return F.when(text.rlike(QUOTED_PART if part else QUOTED), escape(text)).otherwise(text)


def unescaped(body: Column) -> Column:
    """Text whose escapes of two characters are put back. It is cut at doubled backslashes, so that no other escape spans a cut."""
    parts = F.split(body, r"\\\\", -1)

    def put_back(part: Column) -> Column:
        for raw, written in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            part = F.replace(part, F.lit(written), F.lit(raw))
        return part

    return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(parts, put_back), "\\")).otherwise(body)


def unquoted(cell: Column) -> Column:
    """Inverse of quoted()."""
    return F.when(cell.startswith('"'), unescaped(F.substring(cell, F.lit(2), F.length(cell) - 2))).otherwise(cell)


def ref(index: Column) -> Column:
    """$ and one or two base-62 digits: one below 62, then two."""
    digit = lambda i: F.substring(F.lit(REF_DIGITS), i.cast("int") + 1, F.lit(1))
    rest = index - 62
    return F.concat(F.lit("$"), F.when(index < 62, digit(index)).otherwise(F.concat(digit(F.floor(rest / 62)), digit(rest % 62))))


def ref_index(cell: Column) -> Column:
    """Inverse of ref()."""
    place = lambda i: F.position(F.substring(cell, i, 1), F.lit(REF_DIGITS)) - 1
    return F.when(F.length(cell) == 2, place(2)).otherwise(62 + place(2) * 62 + place(3)).cast("int")


def is_ref(cell: Column) -> Column:
    return cell.rlike(r"^\$[0-9a-zA-Z]{1,2}$")


def compact_date(text: Column) -> Column:
    return F.regexp_replace(text, "[-:]", "")


def is_compact_date(text: Column) -> Column:
    return text.rlike(COMPACT)


def expand_date(text: Column) -> Column:
    """Inverse of compact_date() for texts of the ISO form."""
    day = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    minutes = F.regexp_replace(day, r"T(\d{2})(\d{2})", "T$1:$2")
    return F.regexp_replace(minutes, r"(T\d{2}:\d{2})(\d{2})", "$1:$2")


def js_number(value: Column) -> Column:
    """Shortest decimal text of a double as JavaScript prints it: no .0, plain from 1e-7 to 1e21."""
    s = value.cast("double").cast("string")
    digits = F.regexp_replace(F.regexp_extract(s, r"^-?([\d.]+)", 1), r"\.0$", "")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1).cast("int")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    mantissa = F.replace(digits, F.lit("."), F.lit(""))
    whole = power + 1
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), mantissa))
        .when(F.length(mantissa) <= whole, F.rpad(mantissa, whole, "0"))
        .otherwise(F.concat(F.substring(mantissa, F.lit(1), whole), F.lit("."), F.substring(mantissa, whole + 1, F.length(mantissa))))
    )
    far = F.concat(digits, F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    return (
        F.when(value == 0, "0")
        .when(F.isnan(value) | F.abs(value).eqNullSafe(float("inf")), s)
        .when(~s.contains("E"), F.concat(sign, digits))
        .otherwise(F.concat(sign, F.when((power >= 21) | (power < -6), far).otherwise(plain)))
    )


def text_of(value: Column, kind: T.DataType) -> Column:
    """Text of a value that cast() gives back exactly."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return js_number(value) if isinstance(kind, T.DoubleType) else js_number(value.cast("string").cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        iso = F.regexp_replace(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        iso = F.when(iso.rlike(r"T\d\d:\d\d:\d\d"), iso).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"))
        return F.concat(iso, F.lit("Z")) if isinstance(kind, T.TimestampType) else iso
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def value_of(text: Column, kind: T.DataType) -> Column:
    """Inverse of text_of()."""
    if isinstance(kind, T.BinaryType):
        return F.unbase64(text)
    return text.cast(kind)


def to_base62(number: int) -> str:
    out = ""
    while number:
        number, r = divmod(number, 62)
        out = UUID_DIGITS[r] + out
    return out or "0"


def from_base62(text: str) -> int:
    out = 0
    for c in text:
        out = out * 62 + UUID_DIGITS.index(c)
    return out


def uuid_text(cell: str) -> str:
    """Inverse of ^ and base 62: a lower-case UUID."""
    h = f"{from_base62(cell[1:]):032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def uuid_to_base62(ids: Column) -> Column:
    """^ and the 128-bit number of a lower-case UUID in base 62; 64-bit built-ins can't hold it."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else "^" + to_base62(int(s.replace("-", ""), 16)))

    return run(ids)


def base62_to_uuid(cells: Column) -> Column:
    """Inverse of uuid_to_base62(), always in lower case with all 32 digits."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else uuid_text(s))

    return run(cells)
