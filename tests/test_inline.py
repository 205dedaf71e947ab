import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import plyfold
from plyfold.functions import inline
from plyfold.plans.document import decode, encode


def test_reader():
    read = lambda s: json.loads(inline.to_json(s))
    assert read('[1, -2.5e3, true, null, -, "a, b", x y, [], {}]') == [1, -2500.0, True, None, None, "a, b", "x y", [], {}]
    assert read('{a: 1, "b: c": {d: [1, {e: "x\\"}"}]}, t: 10:30}') == {"a": 1, "b: c": {"d": [1, {"e": 'x"}'}]}, "t": "10:30"}
    assert read("Point(1, [2, 3])") == [1, [2, 3]]
    assert read(r'"a\q\\n\n"') == "a\\q\\n\n"
    assert inline.to_json("12345678901234567890.10") == "12345678901234567890.10"
    kind = T.StructType().add("x", T.IntegerType()).add("p", T.StructType().add("y", T.StringType()))
    assert json.loads(inline.to_json("Point(1, P(up))", kind)) == {"x": 1, "p": {"y": "up"}}
    assert len(read("[" * 90 + "]" * 90)) == 1
    for bad in ("[1, 2", "{a 1}", "[1] 2", "[" * 200 + "]" * 200):
        with pytest.raises(ValueError):
            inline.to_json(bad)


def test_blocks():
    text = "# settings\nname: Ada\n\nhome:\n  city: Paris\n  geo:\n    lat: 1.5\n  zip: \"75001\"\ntags: [a, 2]\nmore:\n  [\n  1,\n  2\n  ]\nnone:\nlast: -"
    assert json.loads(inline.block_json(text)) == {"name": "Ada", "home": {"city": "Paris", "geo": {"lat": 1.5}, "zip": "75001"}, "tags": ["a", 2], "more": [1, 2], "last": None}
    assert inline.block_json("") == "{}"


HARD = ["", "-", "null", "true", "42", "a, b", 'q"q', "\\", "a\nb\tc", "]", "{x: 1}", "A(b)", "k: v", " pad ", "naïve 😀", "~", None]


@pytest.mark.parametrize("level", [1, 2, 3])
def test_nested_round_trip(spark, level):
    kind = "id long, home struct<city:string,`odd key, x`:int,geo:struct<lat:double,on:boolean>>, tags array<string>, m map<string,array<decimal(30,4)>>, deep array<struct<a:string,t:timestamp>>, bin array<binary>"
    rows = []
    for i, s in enumerate(HARD * 2):
        geo = None if i % 5 == 0 else ([0.1, float("nan"), float("-inf"), 1e21][i % 4], i % 2 == 0)
        rows.append((i, None if i % 7 == 3 else (s, i, geo), [s, "x", None] if i % 3 else [], {s or "k": None, "z:": [Decimal("12345678901234567890.5")]} if i % 4 else None, [(s, None), None], [bytes([i, 255]), b"", None]))
    df = spark.createDataFrame(rows, kind)
    e = encode(df, "id", level=level)
    assert set(e.plan.codecs.values()) >= {"inline"} and "json" not in e.plan.codecs.values()
    text = lambda d: sorted(map(repr, d.collect()))
    assert text(decode(e.lines)) == text(df)
    assert any("Home(" in r.line and "Geo(" in r.line for r in e.lines.filter("ord >= 0").collect())


@pytest.mark.parametrize("level,kind,rows", [(2, "long", [[1, 2, 3], [1, 5, 3], [1, 5, None]]), (3, "string", [["a, b", "~"], ["a, b", None], ["a, b", "x"]]), (3, "struct<a:array<int>>", [[([1],)], [([1],)], [None]])])
def test_matrix(spark, level, kind, rows):
    df = spark.createDataFrame(list(enumerate(rows)), f"i long, v array<{kind}>")
    lines = plyfold.encode_matrix(df, "v", "i", level)
    assert lines.filter("ord = -1").first().line == f"@A {len(rows)} {len(rows[0])}"
    back = plyfold.decode_matrix(lines, df.schema["v"].dataType.elementType)
    assert [r.row for r in back.orderBy("ord").collect()] == [r.v for r in df.orderBy("i").collect()]
    with pytest.raises(ValueError):
        plyfold.decode_matrix(lines.filter("ord <> 1"), df.schema["v"].dataType.elementType)
    with pytest.raises(ValueError):
        plyfold.encode_matrix(df.union(spark.createDataFrame([(9, [])], df.schema)), "v", "i", level)


def test_block_column(spark):
    df = spark.createDataFrame([("a: 1",), (None,)], "t string").select(inline.key_value_json(F.col("t")).alias("j"), inline.inline_json(F.lit("[1, a]")).alias("k"))
    assert [tuple(r) for r in df.collect()] == [('{"a":1}', '[1,"a"]'), (None, '[1,"a"]')]
