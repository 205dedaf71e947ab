import json

import pytest
from pyspark.sql import functions as F

import plyfold
from plyfold.operators import shapes
from plyfold.plans.foreign import depth, document_json, json_document
from plyfold.sources import cli

# documents as other writers make them, and the values they hold
DOCUMENTS = [
    ("", None),
    ("  \n", None),
    ("null", None),
    ("-", None),
    ("true", True),
    ("-12", -12),
    ("1.5e3", 1500.0),
    ("12345678901234567890", 12345678901234567890),
    ('"a \\"b\\" \\n c"', 'a "b" \n c'),
    ("plain words", "plain words"),
    ('{"a": [1, {"b": null}]}', {"a": [1, {"b": None}]}),
    ("[1, 2]", [1, 2]),
    ("{a: 1, b: [x, true]}", {"a": 1, "b": ["x", True]}),
    ("name: Ada\nage: 36\nhome:\n  city: Paris\n", {"name": "Ada", "age": 36, "home": {"city": "Paris"}}),
    ("@v1\n[]", []),
    ("@v1\n{}", {}),
    ("@v1\n[1, a, -]", [1, "a", None]),
    ("@v1\n@S P: x, y\nP(1, P(2, z))", {"x": 1, "y": {"x": 2, "y": "z"}}),
    ("@v1\nname: Ada\nn: 2", {"name": "Ada", "n": 2}),
    ("@v2\n@A 2 3\n1, 2, a\n4, -, \"6\"", [[1, 2, "a"], [4, None, "6"]]),
    ("@v3\n@A 2 2\n1\t2\n~\t3", [[1, 2], [1, 3]]),
    ("@v1\n# note\n@S U: id, name, ok?b\n@N2 U\n1, Ada, true\n2, \"B, b\", false", [{"id": 1, "name": "Ada", "ok": True}, {"id": 2, "name": "B, b", "ok": False}]),
    ("@v2\n@S A: id, dept, ok?b\n@D: Sales, \"New York, NY\"\n@N3 A\n1, $0, 1\n2, $1, 0\n3, \"$0\", -", [{"id": 1, "dept": "Sales", "ok": True}, {"id": 2, "dept": "New York, NY", "ok": False}, {"id": 3, "dept": "$0", "ok": None}]),
    ("@v2\n@S A: id, mail\n@T 1: user{}@x.com\n@N2 A\n1, 1\n2, 2", [{"id": 1, "mail": "user1@x.com"}, {"id": 2, "mail": "user2@x.com"}]),
    ("@v3\n@S A: id, v, t\n@P: long part, 100%\n@N3 A\n5\ta%0;b\t20240101T000000Z\n+1\t~\t+60s\n-3\t%%x %1;\t+3600s", [{"id": 5, "v": "along partb", "t": "2024-01-01T00:00:00Z"}, {"id": 6, "v": "along partb", "t": "2024-01-01T00:01:00Z"}, {"id": 3, "v": "%x 100%", "t": "2024-01-01T01:01:00Z"}]),
    ("@v3\n@S A: n?i, d, day?d, u\n@N2 A\n123456789012345678901\t0.1\t20240229\t^7n42DGM5Tflk9n8mt7Fhc7\n+1\t+0.2\t20240301\t-", [{"n": 123456789012345678901, "d": 0.1, "day": "2024-02-29", "u": "ffffffff-ffff-ffff-ffff-ffffffffffff"}, {"n": 123456789012345678902, "d": 0.3, "day": "2024-03-01", "u": None}]),
    ("@v1\n@S P: x, y\n@S Q: p, q\n@N2 Q\nP(1, 2), [a, P(3, 4)]\n-, {k: v}", [{"p": {"x": 1, "y": 2}, "q": ["a", {"x": 3, "y": 4}]}, {"p": None, "q": {"k": "v"}}]),
]


@pytest.mark.parametrize("text,value", DOCUMENTS)
def test_documents_without_a_plan(text, value):
    got = document_json(text)
    assert (json.loads(got) if got is not None else None) == value


def test_a_column_of_documents(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DOCUMENTS)] + [(99, None)], "id long, t string")
    got = {r.id: r.j for r in df.select("id", plyfold.documents_json(F.col("t")).alias("j")).collect()}
    assert got[99] is None and all((json.loads(got[i]) if got[i] is not None else None) == v for i, (_, v) in enumerate(DOCUMENTS))


def test_bad_documents():
    with pytest.raises(ValueError, match="deeper"):
        document_json("[" * 200 + "]" * 200)
    with pytest.raises(ValueError, match="rows declared"):
        document_json("@v1\n@S U: id\n@N3 U\n1", strict=True)
    with pytest.raises(ValueError, match="checksum"):
        document_json("@v1\n@C 00000000\n@S U: id\n@N1 U\n1", strict=True)
    with pytest.raises(ValueError, match="unknown name"):
        document_json("@v1\n@S U: id\n@N1 V\n1")
    assert document_json("@v1\n@C 00000000\n@S U: id\n@N3 U\n1") == '[{"id":1}]'
    assert depth('"[[[" [({})]') == 3


@pytest.mark.parametrize("level", [1, 2, 3])
def test_own_documents_without_their_plan(spark, level):
    """What a plan says can be read off the header for strings, numbers, flags and dates."""
    rows = [(i, f"user{i}@example.com", "a department" if i % 2 else 'an "other", department', i % 3 == 0, None if i == 2 else i * 0.5) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, mail string, dept string, ok boolean, x double")
    back = plyfold.decode_text(spark, plyfold.encode_text(df, "id", level=level, embed_plan=False)).select("id", "mail", "dept", "ok", F.col("x").cast("double"))
    assert sorted(map(tuple, back.collect())) == rows


def test_read_any(spark):
    assert [r.asDict() for r in plyfold.read_any(spark, "@v1\n@S U: id, name\n@N2 U\n1, a\n2, -").collect()] == [{"id": 1, "name": "a"}, {"id": 2, "name": None}]
    assert [r.value for r in plyfold.read_any(spark, "7").collect()] == [7]
    assert plyfold.read_any(spark, "").count() == 0


@pytest.mark.parametrize("value", [[{"id": i, "n": f"name {i}", "x": [1, None, "a, b"], "y": {"k": 1.5, "z z": True}} for i in range(5)], {"a": "1", "b": "-", "c": "", "d": [[], {}], "e": "x\ty"}, [1, "1", None], "text", [{"a": 1, "b": "$0"}, {"a": 2, "b": "~"}, {"a": 3, "b": "^x"}]])
def test_messages_come_back(value):
    text = json.dumps(value, indent=2)
    sent = json_document(text)
    assert json.loads(document_json(sent)) == value and len(sent) <= len(text)
    assert json_document("no json") == "no json"


def test_messages_of_many_rows(spark, tmp_path):
    """No row read back carries the message it came in, or a message of n rows would be measured n times; and each is written and read once."""
    from plyfold.queries import QUERIES

    odd = ['Ann, "A"', "a (b) [c] {d}", "tab\tline\n", "true", "-", "", "12", "\u00e9\\", None, " x ", "~", "$0"]
    rows = [(i, f"Customer#{i:09d}", i % 2, "BUILDING") for i in range(4000)] + [(5000 + i, x, 2, "MACHINERY") for i, x in enumerate(odd)] + [(6000, "Ada", None, "x")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    df = QUERIES["message_compress"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "length(" not in above and "length(" in below and plan.count("ArrowEvalPython") == 2
    got = df.collect()
    assert sorted((r.id, r.name, r.nation, r.segment) for r in got) == rows and all(r.shorter for r in got if r.nation in (0, 1))


def test_cut_and_depth_by_characters():
    import random

    from plyfold.functions import inline
    from plyfold.plans.foreign import cut

    def plain_cut(line, sep):
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

    def plain_depth(text):
        at = most = i = 0
        while i < len(text):
            end = inline.quote_end(text, i) if text[i] == '"' else i
            i = end if end < len(text) else i  # a quote without an end is passed over
            at += (text[i] in "([{") - (text[i] in ")]}")
            most, i = max(most, at), i + 1
        return most

    r = random.Random(7)
    for k in range(4000):
        line = "".join(r.choices('ab ,,\t' if k % 2 else 'a ,"[](){}\t', k=r.randrange(25)))
        assert cut(line, ", ") == plain_cut(line, ", ") and cut(line, "\t") == plain_cut(line, "\t") and depth(line) == plain_depth(line)


# command line
@pytest.mark.parametrize("level", ["auto", "1", "2", "3"])
@pytest.mark.parametrize("data", [[{"id": i, "name": f"user {i}", "dept": "Sales", "ok": i % 2 == 0} for i in range(12)], {"id": 1, "name": "Ada", "tags": ["x", "y"], "home": {"city": "Paris", "n": None}}, [{"a": 1}]])
def test_command_line_round_trip(spark, tmp_path, level, data):
    source, short, back = tmp_path / "in.json", tmp_path / "short", tmp_path / "out.json"
    source.write_text(json.dumps(data))
    assert cli.main(["compress", str(source), "-o", str(short), "--level", level]) == 0
    assert cli.main(["decompress", str(short), "-o", str(back)]) == 0
    assert json.loads(back.read_text()) == data
    if level == "auto":
        assert len(short.read_text()) <= len(json.dumps(data, separators=(",", ":"))) + 1


def test_command_line_analyze(spark, tmp_path, capsys):
    source = tmp_path / "in.json"
    source.write_text(json.dumps([{"id": i, "dept": "a department"} for i in range(30)]))
    assert cli.main(["analyze", str(source)]) == 0
    said = dict(x.split(": ", 1) for x in capsys.readouterr().out.strip().split("\n"))
    assert int(said["bytes"]) > int(said["output_bytes"]) and float(said["byte_reduction"]) > 50
    with pytest.raises(SystemExit):
        cli.main(["unknown", str(source)])


# shapes at all levels
def test_values_at_all_levels(spark):
    docs = [{"a": {"b": {"x": 1, "y": 2}}, "l": [{"x": 3, "y": 4}, [{"x": 5, "y": 6}], 7]}, {"a": {"b": None}, "l": []}, [1]]
    df = spark.createDataFrame([(json.dumps(d), "") for d in docs], "j string, path string")
    paths = sorted(r.path for r in shapes.values(df).collect())
    assert paths == sorted(["", "", "", ".a", ".a", ".a.b", ".l", ".l", ".l[0]", ".l[1]", ".l[1][0]"])
    found = {r.signature: r.frequency for r in shapes.shapes(shapes.values(df)).collect()}
    assert found == {"a,l": 2, "x,y": 3}
    assert shapes.instances(df, "a,l").count() == 2
    names = shapes.named(shapes.shapes(shapes.values(df)))
    assert {r.signature: r.short_name for r in shapes.matched(df, names).collect()} == {"a,l": "B", None: None}
    with pytest.raises(ValueError, match="deeper"):
        shapes.values(df, deepest=1)


# sources and streams
def test_data_source_reads_each_file_on_an_executor(spark, tmp_path):
    from plyfold.sources import datasource

    df = spark.range(40).select("id", F.concat(F.lit("some text "), F.col("id").cast("string")).alias("t"))
    where = str(tmp_path / "docs")
    datasource.write_documents(df, "id", where, block_rows=7)
    assert datasource.read_documents(spark, where).exceptAll(df).count() == 0
    datasource.register(spark)
    lines = spark.read.format("plyfold").load(where)
    assert plyfold.decode(lines).exceptAll(df).count() == 0 and lines.select("block").distinct().count() == 6


def test_stream_there_and_back(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("string").alias("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    plyfold.stream_encode(source, "id", str(tmp_path / "docs"), str(tmp_path / "c1"), level=3).awaitTermination()
    plyfold.stream_restore(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert back.count() == 300 and back.exceptAll(df).count() == 0


def test_exact_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from plyfold.functions.tokens import exact_count, exact_tokens

    path = public.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(exact_tokens(F.col("t"), path).alias("n")).collect()] == [exact_count("hello world", path), 0, 0]
