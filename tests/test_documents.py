import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import plyfold
from plyfold.plans.document import Plan, encode, decode, verify_text
from plyfold.plans.header import Header, quote_value, read_header, split_values

USERS = [(1, "Alice", "alice@example.com", True), (2, "Bob", "bob@example.com", False), (3, "Carol", "carol@example.com", True)]


@pytest.mark.parametrize("level,crc", [(1, "8863be2f"), (2, "59c35b6a"), (3, "41ee6b63")])
def test_golden_users(spark, level, crc):
    df = spark.createDataFrame(USERS, "id long, name string, email string, active boolean")
    assert plyfold.encode_text(df, "id", level=level, embed_plan=False).split("\n")[1] == f"@C {crc}"


def test_golden_sequence_and_dictionary(spark):
    k = (F.col("id") + 1).cast("string")
    df = spark.range(5).select((F.col("id") + 1).alias("id"), F.concat(F.lit("User"), k).alias("name"), F.concat(F.lit("user"), k, F.lit("@example.com")).alias("email"), ((F.col("id") + 1) * 10).alias("score"))
    assert "@C 2792fe3e" in plyfold.encode_text(df, "id", level=3, embed_plan=False)
    df = spark.createDataFrame([(1, "Alice", "Sales"), (2, "Bob", "Sales"), (3, "Carol", "Sales")], "id long, name string, dept string")
    assert "@C fcce1bb1" in plyfold.encode_text(df, "id", level=2, embed_plan=False)


NASTY = ["", "-", "~", "null", "true", "1", "0", "42", "-3.5e7", "$0", "$zz", "+1", "%", "x%y", "100% done", "%0;", "^abc", "@N3", "#plan", "a, b", "a\tb", "a\nb", "a\\nb", "\\", '"', 'say "hi"', " lead", "trail ", "[x", "(y", "{z}", "A(b)", "k:v", "naïve", "😀", "prefix-one", "prefix-two", "10000", "100000", "1000000", "\r", "NaN", "a, \ufdd0b", "abc\ufdd1def", "\\\\n\\\"", "%%0;%", *(f"x{chr(i)}y" for i in range(1, 32)), "\x7f", "\ufffe"]


@pytest.mark.parametrize("level", [1, 2, 3])
@pytest.mark.parametrize("block_rows", [None, 7])
def test_round_trip_of_hard_values(spark, level, block_rows):
    n = len(NASTY)
    rows = [
        (
            i, NASTY[i % n], NASTY[(i * 7) % n] if i % 3 else None, i % 2 == 0 if i % 5 else None, [1.5, -0.1, 1e21, 1e-7, float("nan"), float("inf"), 3.0][i % 7], Decimal(10**20 + i * 3), 20260401 - i * i,
            dt.datetime(2026, 4, 1, 14, 30, 0, i % 3 * 250_000, dt.timezone.utc) + dt.timedelta(minutes=i), dt.date(2024, 1, 1) + dt.timedelta(days=i), bytes([i % 256, 0]), ([i, None], "x, y") if i % 4 else None, "2026-04-01T10:00:00.5-05:00", "a longer value that repeats",
        )
        for i in range(2 * n)
    ]
    kind = "id long, a string, b string, flag boolean, x double, big decimal(38,0), num long, ts timestamp, day date, bin binary, nest struct<v:array<int>,w:string>, iso string, same string"
    df = spark.createDataFrame(rows, kind)
    e = encode(df, "id", level=level, block_rows=block_rows)
    back = decode(e.lines, Plan.from_json(e.plan.to_json()))
    assert back.schema.simpleString() == df.schema.simpleString()
    text = lambda d: sorted(map(repr, d.collect()))
    assert text(back) == text(df)


def test_over_62_dictionary_entries(spark):
    df = spark.range(300).select("id", F.concat(F.lit("a longer value number "), (F.col("id") % 100).cast("string"), F.lit(" x")).alias("v"), F.element_at(F.array(*[F.lit(f"word number {i} of many") for i in range(100)]), (F.col("id") % 100 + 1).cast("int")).alias("w"))
    e = encode(df, "id", level=2)
    assert len(e.plan.dictionary) > 62
    assert decode(e.lines).exceptAll(df).count() == 0


def test_empty_and_single_row(spark):
    df = spark.createDataFrame([], "id long, a string")
    assert decode(encode(df, "id", level=3).lines, encode(df, "id", level=3).plan).count() == 0
    one = spark.createDataFrame([(1, None)], "id long, a string")
    assert decode(encode(one, "id", level=3).lines).collect() == one.collect()


def test_corruption_is_found(spark):
    df = spark.createDataFrame(USERS, "id long, name string, email string, active boolean")
    text = plyfold.encode_text(df, "id", level=2)
    assert verify_text(text).rows == 3
    with pytest.raises(ValueError, match="checksum"):
        verify_text(text.replace("Carol", "Karol"))
    with pytest.raises(ValueError, match="rows declared"):
        verify_text("\n".join(text.split("\n")[:-1]))
    with pytest.warns(UserWarning):
        verify_text(text.replace("Carol", "Karol"), strict=False)
    bad = encode(df, "id", level=2).lines.withColumn("line", F.replace("line", F.lit("Carol"), F.lit("Karol")))
    with pytest.raises(ValueError, match="blocks"):
        decode(bad)
    assert plyfold.decode_text(spark, text).collect() == df.collect()


def test_header_round_trip():
    h = Header(3, "A", [("id", ""), ("first-name", "?b"), ("a, b", "?d")], ["New York, NY", 'He said "x"', " pad ", "line\nend", "plain"], {1: ("pre{}fix\\", "tail")}, ["frag, one", "%x"], 7)
    got, n = read_header([*h.lines(), "row"])
    assert n == len(h.lines())
    assert (got.fields, got.dictionary, got.templates, got.fragments, got.rows) == (h.fields, h.dictionary, h.templates, h.fragments, h.rows)
    values = ["", "a", ",", '"', "\\", "\t"]
    assert split_values(", ".join(map(quote_value, values))) == values


def test_any_text_comes_back(spark):
    """Quotes and fragments: random texts of the characters that they give a meaning, and of non-characters."""
    from plyfold.functions import scalars
    from plyfold.operators import substrings

    r = random.Random(4)
    texts = ["".join(r.choice('ab%01;\\"nrt\n\t ,\ufdd0\ufdd1') for _ in range(r.randrange(1, 24))) for _ in range(3000)] + ["\ufdd0%1;", "a, \ufdd0b"]
    fragments = ["%1;ab", "\ufdd1a%", '\\"n', "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cell = substrings.apply(F.col("t"), fragments)
    same = substrings.expand(cell, fragments) == F.col("t"), scalars.unquoted(scalars.quoted(F.col("t"))) == F.col("t"), substrings.expand(scalars.unquoted(scalars.quoted(cell)), fragments) == F.col("t")
    assert df.filter(~(same[0] & same[1] & same[2])).collect() == []


def test_lines_are_cut_alike(spark):
    """The patterns for flat lines cut as the scanner does."""
    from plyfold.plans.document import split_row

    for sep in (", ", "\t"):
        cells = [["a", "b"], ['""', "x"], ['"a, b"', "-", '"c\td"'], ["a"], ['"q\\"x, y"', "z"], ["x y", '"[a, b"', "w"], ["~", "~"], ['"a"', '"b"']]
        df = spark.createDataFrame([(sep.join(c),) for c in cells], "line string")
        for flat in (True, False):
            assert [list(r.c) for r in df.select(split_row(F.col("line"), sep, flat).alias("c")).collect()] == cells


def test_queries_of_one_session(spark, sf):
    """Functions that have run before don't stand in the way of later ones."""
    from plyfold.queries import QUERIES

    for name in ("uuid_base62", "key_value_read", "inline_roundtrip", "matrix_roundtrip", "stream_roundtrip", *(f"roundtrip_l{i}_customer" for i in (1, 2, 3))):
        assert QUERIES[name](spark, sf).count() > 0
