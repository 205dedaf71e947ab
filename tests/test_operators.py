import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plyfold.functions import scalars, tokens
from plyfold.operators import deltas, integrity, shapes, substrings, templates
from plyfold.operators.ordering import with_ordinal


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")


def mapped(spark, values, f, kind="string"):
    return [r.o for r in column(spark, values, kind).select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_quoting(spark):
    yes = ["", "hello, world", "a\nb", "42", "-3.14", "true", "null", "$0", "+1", "~", "@header", "^x", "k:v", "a(b"]
    assert all(mapped(spark, yes, scalars.needs_quoting))
    assert not any(mapped(spark, ["hello", "hello world", "a-b", "x1"], scalars.needs_quoting))
    hard = [*yes, "\\n", '\\"', "\\\\", "a\\", 'b"c', "\r\t\n"]
    assert mapped(spark, hard, lambda v: scalars.unquoted(scalars.quoted(v))) == hard


def test_references(spark):
    assert mapped(spark, [0, 9, 10, 35, 36, 61, 62, 3905], scalars.ref, "long") == ["$0", "$9", "$a", "$z", "$A", "$Z", "$00", "$ZZ"]
    assert mapped(spark, ["$0", "$a", "$Z", "$aB", "hello", "$", "$abc"], scalars.is_ref) == [True] * 4 + [False] * 3


def test_dates_and_uuids(spark):
    iso = ["2026-04-01", "2026-04-01T14:30:00Z", "2026-04-01T14:30", "2026-04-01T14:30:00.5Z"]
    short = ["20260401", "20260401T143000Z", "20260401T1430", "20260401T143000.5Z"]
    assert mapped(spark, iso, scalars.compact_date) == short
    assert mapped(spark, short, scalars.expand_date) == iso
    assert all(mapped(spark, short, scalars.is_compact_date)) and not any(mapped(spark, ["18000101", "20261301", "abc"], scalars.is_compact_date))
    ids = ["00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff", "550e8400-e29b-41d4-a716-446655440000"]
    assert mapped(spark, ids, lambda v: scalars.base62_to_uuid(scalars.uuid_to_base62(v))) == ids


def test_numbers_as_javascript_prints_them(spark):
    pairs = [(1.0, "1"), (1e7, "10000000"), (1e21, "1e+21"), (1e-7, "1e-7"), (1.5e-6, "0.0000015"), (-123456789.25, "-123456789.25"), (0.1, "0.1"), (1.5e23, "1.5e+23"), (0.0, "0")]
    assert mapped(spark, [a for a, _ in pairs], scalars.js_number, "double") == [b for _, b in pairs]


def test_tokens(spark):
    assert mapped(spark, ["", None, "hello", "hello world", "123456", "a1", "..", "\n"], tokens.estimate_tokens) == [0, 0, 1, 2, 2, 2, 2, 1]


def test_crc_and_json(spark):
    assert mapped(spark, ["", "hello"], integrity.crc_hex) == ["00000000", "3610a686"]
    assert mapped(spark, ['{"a":1}', " [1]", "{bad", "3", None], integrity.is_json) == [True, True, False, False, False]
    assert mapped(spark, ["", "[[1]]", '{"a": "[[["}', "[(){}]"], integrity.text_depth) == [0, 2, 1, 2]


def test_template_never_overlaps(spark):
    df = column(spark, ["10000", "100000", "1000000"])
    t = templates.detect(df, ["v"]).first()
    assert len(t.prefix) + len(t.suffix) <= 5
    assert mapped(spark, ["10000", "1000000"], lambda v: templates.expand(templates.strip(v, t.prefix, t.suffix), t.prefix, t.suffix)) == ["10000", "1000000"]
    for values in (["same-x", "same-x"], ["pre-a", None, "pre-b"], ["$pre-a", "$pre-b"], [], ["ab", "cd"]):
        assert templates.detect(column(spark, values), ["v"]).count() == 0


def test_fragments(spark):
    cells = ["https://example.com/a", "https://example.com/b?x=10%", "x https://example.com/ %0; y", "", "-", "100%"]
    found = substrings.choose(substrings.ngrams(column(spark, cells), ["v"]))
    assert found
    assert mapped(spark, cells, lambda v: substrings.expand(substrings.apply(v, found), found)) == cells


@pytest.mark.parametrize("values", [[5, -3, 7, 7], [1, 2, 3], [10**17, -(10**17)], [0]])
def test_delta_and_repeat(spark, values):
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    df = column(spark, values, "long").select("i", deltas.delta(F.col("v"), w).alias("c"), deltas.repeat(F.col("v").cast("string"), w).alias("r"))
    got = df.select("i", deltas.undelta(F.col("c"), w).alias("v"), deltas.unrepeat(F.col("r"), w).alias("s")).orderBy("i").collect()
    assert [r.v for r in got] == values and [r.s for r in got] == list(map(str, values))


def test_eligibility(spark):
    rows = [(i, 0, i * 5, (-1) ** i * 100, None if i == 2 else i) for i in range(6)]
    df = spark.createDataFrame(rows, "o long, b long, steady long, wild long, holed long")
    got = {r.col: (r.is_const, r.eligible) for r in deltas.eligibility(df, {"steady": "numeric", "wild": "numeric", "holed": "numeric"}, "o", "b").collect()}
    assert got["steady"] == (True, True) and got["wild"] == (False, False) and not got["holed"][1]


def test_shapes(spark):
    rows = ['{"b":1,"a":true}', '{"a":null,"b":2.5}', '{"a":1}', "[1]", "oops", None]
    df = spark.createDataFrame([(j, ".users[0]") for j in rows], "j string, path string")
    found = shapes.shapes(df).collect()
    assert [(r.signature, r.n_keys, r.frequency) for r in found] == [("a,b", 2, 2)]
    assert shapes.named(shapes.shapes(df)).first().full_name == "User"
    kinds = {(r.signature, r.field): r.type for r in shapes.field_types(df.filter("j like '{%'")).collect()}
    assert kinds[("a,b", "a")] == "boolean" and kinds[("a,b", "b")] == "number"
    names = mapped(spark, [0, 25, 26, 51, 52], shapes.short_name, "long")
    assert names == ["A", "Z", "A0", "Z0", "A1"]


def test_ordinal_without_single_partition(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    t = with_ordinal(df, ["k"], 100)
    assert t.filter("__ord <> k or __block <> k div 100").count() == 0
    assert "SinglePartition" not in t._jdf.queryExecution().executedPlan().toString()


def test_stream_and_files(spark, tmp_path):
    from plyfold.sources.datasource import read_documents, write_documents
    from plyfold.streaming.stream import stream_decode, stream_encode

    rows = [(i, f"user {i % 3}", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, name string, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream_encode(src, "id", str(tmp_path / "out"), str(tmp_path / "check"), level=3).awaitTermination()
    assert stream_decode(spark, str(tmp_path / "out")).exceptAll(df).count() == 0
    write_documents(df, "id", str(tmp_path / "docs"), level=3, block_rows=10)
    back = read_documents(spark, str(tmp_path / "docs"))
    assert back.count() == 40 and back.exceptAll(df).count() == 0
