"""Named queries over the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window

from .functions import inline, scalars, tokens
from .operators import deltas, dictionary, integrity, shapes, substrings, templates
from .operators.ordering import with_ordinal
from .plans import advisor, document, foreign, matrix
from .sources import presets, render
from .streaming import stream
from .tables import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json_rows(spark, d):
    parts = [T(spark, d, t).select(F.to_json(F.struct("*")).alias("j"), F.lit(f".{t}s[0]").alias("path")) for t in ("region", "nation", "supplier", "customer")]
    parts.append(T(spark, d, "events").select(F.col("props").alias("j"), F.lit(".props").alias("path")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


JSON_SQL = " UNION ALL ".join(f"SELECT to_json(t)::VARCHAR AS j, '.{t}s[0]' AS path FROM {t} t" for t in ("region", "nation", "supplier", "customer")) + " UNION ALL SELECT props AS j, '.props' AS path FROM events"
SHAPE_SQL = f"SELECT signature, n_keys, count(*) AS frequency, min(path) AS path FROM (SELECT array_to_string(list_sort(json_keys(j)), ',') AS signature, len(json_keys(j))::BIGINT AS n_keys, path FROM ({JSON_SQL})) WHERE n_keys >= 2 GROUP BY 1, 2 HAVING count(*) >= 2"


@query(SHAPE_SQL)
def shape_signatures(spark, d):
    return shapes.shapes(_json_rows(spark, d))


@query(f"""SELECT signature, rank, chr((65 + rank % 26)::INT) || CASE WHEN rank < 26 THEN '' ELSE ((rank - 26) // 26)::VARCHAR END AS short_name, upper(p[1]) || p[2:] AS full_name
    FROM (SELECT signature, row_number() OVER (ORDER BY frequency DESC, n_keys DESC, path, signature) - 1 AS rank, regexp_replace(regexp_extract(path, '\\.(\\w+)\\[', 1), 's$', '') AS p FROM ({SHAPE_SQL}))""")
def shape_names(spark, d):
    return shapes.named(shapes.shapes(_json_rows(spark, d)))


@query(f"""WITH k AS (SELECT j, array_to_string(list_sort(json_keys(j)), ',') AS signature, unnest(json_keys(j)) AS field FROM ({JSON_SQL}))
    , t AS (SELECT signature, field, CASE json_type(j, '$.' || field) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM k)
    SELECT signature, field, CASE WHEN count(DISTINCT kind) = 0 THEN 'null' WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS type FROM t GROUP BY 1, 2""")
def shape_field_types(spark, d):
    return shapes.field_types(_json_rows(spark, d))


@query(f"""SELECT s.signature, s.n_keys, s.frequency, s.path, n.rank, n.short_name, n.full_name, f.fields FROM ({SHAPE_SQL}) s JOIN ({SQL['shape_names']}) n ON s.signature = n.signature
    JOIN (SELECT signature, string_agg(field || ':' || type, ' ' ORDER BY field) AS fields FROM ({SQL['shape_field_types']}) GROUP BY signature) f ON s.signature = f.signature""")
def shape_schemas(spark, d):
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit(":"), f["type"])), " ")
    return shapes.schemas(_json_rows(spark, d)).withColumn("fields", fields)


@query("""WITH t AS (SELECT to_json({'o_orderkey': o_orderkey, 'customer': {'c_custkey': c_custkey, 'c_name': c_name}}) AS j FROM orders JOIN customer ON o_custkey = c_custkey)
    , k AS (SELECT array_to_string(list_sort(json_keys(j)), ',') AS parent, unnest(json_keys(j)) AS field, j FROM t)
    , n AS (SELECT parent, field, CASE WHEN json_type(j, '$.' || field) = 'OBJECT' THEN array_to_string(list_sort(json_keys(j, '$.' || field)), ',') END AS inner_sig FROM k)
    SELECT parent, field, min(inner_sig) AS nested FROM n GROUP BY 1, 2 HAVING count(*) = count(inner_sig) AND min(inner_sig) = max(inner_sig) AND contains(min(inner_sig), ',')""")
def shape_nested(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.to_json(F.struct("o_orderkey", F.struct("c_custkey", "c_name").alias("customer"))).alias("j"))
    return shapes.nested(j)


@query(f"""SELECT 'json' AS source, count(*) AS n_rows, NULL::BIGINT AS n_cols, count(DISTINCT array_to_string(list_sort(json_keys(j)), ',')) = 1 AS uniform FROM ({JSON_SQL})
    UNION ALL SELECT 'embeddings', count(*), max(len(embedding))::BIGINT, min(len(embedding)) = max(len(embedding)) AND count(*) >= 2 FROM embeddings""")
def uniformity(spark, d):
    a = shapes.is_table(_json_rows(spark, d)).select(F.lit("json").alias("source"), "n_rows", F.lit(None).cast("long").alias("n_cols"), F.col("is_table").alias("uniform"))
    return a.unionByName(shapes.is_matrix(T(spark, d, "embeddings"), "embedding").withColumnRenamed("is_matrix", "uniform").withColumn("source", F.lit("embeddings")).select("source", "n_rows", "n_cols", "uniform"))


Q = r"""^$|[,\n\r\t"()\[\]{}\\:]|^\s|\s$|^[@$%+*~^#-]|^-?\d+(\.\d+)?([eE][+-]?\d+)?$|^(true|false|null|NaN|Infinity|1|0)$"""


def _escaped(x: str) -> str:
    return f"""'"' || replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"'""".replace("\\\\\\\\", "\\\\").replace("'\\', '\\\\'", "'\\', '\\\\'")


def _quoted(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{Q}') THEN {_escaped(x)} ELSE {x} END"


@query(f"SELECT n_nationkey AS row_id, concat_ws(', ', n_nationkey::VARCHAR, {_quoted('n_name')}, n_regionkey::VARCHAR) AS line FROM nation")
def rows_positional_l1(spark, d):
    n = T(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("row_id"), F.concat_ws(", ", *[scalars.quoted(F.col(f.name)) if f.name == "n_name" else scalars.text_of(F.col(f.name), f.dataType) for f in n.schema.fields]).alias("line"))


REFS = "substring('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', {0} + 1, 1)"


def _ref(i: str) -> str:
    return f"'$' || CASE WHEN {i} < 62 THEN {REFS.format(f'({i})::INT')} ELSE {REFS.format(f'(({i}) - 62)::INT // 62')} || {REFS.format(f'(({i}) - 62)::INT % 62')} END"


def _dictionary(cells: str) -> str:
    """SQL of (value, idx, ref) over (value, ord, col) cells."""
    return f"""SELECT value, idx, {_ref('idx')} AS ref FROM (
        SELECT value, row_number() OVER (ORDER BY frequency * savings DESC, ord, col, value) - 1 AS idx FROM (
            SELECT * FROM (SELECT *, t - 1 AS savings FROM (SELECT value, count(*) AS frequency, arg_min(ord, (ord, col)) AS ord, arg_min(col, (ord, col)) AS col, greatest(1, ceil(length(value) / 4.0))::BIGINT AS t FROM ({cells}) GROUP BY value) WHERE frequency >= 2 AND length(value) >= 2)
            ORDER BY frequency * savings DESC, ord, col, value LIMIT 1024) WHERE savings * frequency >= t + 1)"""


CUSTOMER_CELLS = "SELECT c_name AS value, c_custkey AS ord, 0 AS col FROM customer UNION ALL SELECT c_mktsegment, c_custkey, 1 FROM customer"


@query(f"""WITH dict AS ({_dictionary(CUSTOMER_CELLS)})
    SELECT c_custkey AS row_id, concat_ws(', ', c_custkey::VARCHAR, coalesce(a.ref, {_quoted('c_name')}), coalesce(b.ref, {_quoted('c_mktsegment')})) AS line
    FROM customer LEFT JOIN dict a ON c_name = a.value LEFT JOIN dict b ON c_mktsegment = b.value""")
def rows_positional_l2(spark, d):
    c = T(spark, d, "customer")
    entries = dictionary.numbered(dictionary.profitable(dictionary.frequencies(c, ["c_name", "c_mktsegment"], "c_custkey")))
    refs = [r.value for r in entries.orderBy("idx").collect()]
    cell = lambda x: F.coalesce(dictionary.lookup(F.col(x), refs), scalars.quoted(F.col(x)))
    return c.select(F.col("c_custkey").alias("row_id"), F.concat_ws(", ", F.col("c_custkey").cast("string"), cell("c_name"), cell("c_mktsegment")).alias("line"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n_cells, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT))::BIGINT AS milli_sum FROM embeddings")
def matrix_cells(spark, d):
    cells = F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("long"))
    return T(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n_cells"), F.aggregate(cells, F.lit(0).cast("long"), lambda a, b: a + b).alias("milli_sum"))


PART = ["p_name", "p_brand", "p_type"]
PART_CELLS = " UNION ALL ".join(f"SELECT {c} AS value, p_partkey AS ord, {i} AS col FROM part" for i, c in enumerate(PART))


@query(f"SELECT value, count(*) AS frequency FROM ({PART_CELLS}) GROUP BY value")
def dict_frequencies(spark, d):
    return dictionary.frequencies(T(spark, d, "part"), PART, "p_partkey").select("value", "frequency")


ORDER_DICT = "SELECT value, frequency, savings FROM (SELECT o_orderpriority AS value, count(*) AS frequency, greatest(1, ceil(length(o_orderpriority) / 4.0))::BIGINT - 1 AS savings FROM orders GROUP BY 1) WHERE frequency >= 2 AND length(value) >= 2 AND savings * frequency >= savings + 2"


@query(ORDER_DICT)
def dict_build_orders(spark, d):
    return dictionary.profitable(dictionary.frequencies(T(spark, d, "orders"), ["o_orderpriority"], "o_orderkey")).select("value", "frequency", "savings")


@query(_dictionary(PART_CELLS))
def dict_build_global(spark, d):
    return dictionary.numbered(dictionary.profitable(dictionary.frequencies(T(spark, d, "part"), PART, "p_partkey")))


ORDER_CELLS = "SELECT o_orderpriority AS value, o_orderkey AS ord, 0 AS col FROM orders"


def _orders_dictionary(spark, d):
    return dictionary.numbered(dictionary.profitable(dictionary.frequencies(T(spark, d, "orders"), ["o_orderpriority"], "o_orderkey")))


@query(f"SELECT o_orderkey, coalesce(ref, o_orderpriority) AS cell FROM orders LEFT JOIN ({_dictionary(ORDER_CELLS)}) ON o_orderpriority = value")
def dict_encode(spark, d):
    return dictionary.encode(T(spark, d, "orders"), "o_orderpriority", _orders_dictionary(spark, d)).select("o_orderkey", "cell")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def dict_decode(spark, d):
    entries = _orders_dictionary(spark, d)
    cells = dictionary.encode(T(spark, d, "orders"), "o_orderpriority", entries).select("o_orderkey", "cell")
    return dictionary.decode(cells, "cell", entries, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query(f"SELECT range AS idx, {_ref('range')} AS ref, range::INT AS back, true AS is_ref FROM range(3906)")
def base62_refs(spark, d):
    r = spark.range(scalars.MAX_REFS).select(F.col("id").alias("idx"), scalars.ref(F.col("id")).alias("ref"))
    return r.select("idx", "ref", scalars.ref_index(F.col("ref")).alias("back"), scalars.is_ref(F.col("ref")).alias("is_ref"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS compact FROM orders")
def date_compact(spark, d):
    o = T(spark, d, "orders")
    iso = scalars.text_of(F.col("o_orderdate").cast("timestamp"), o.select(F.col("o_orderdate").cast("timestamp")).schema[0].dataType)
    return o.select(F.col("o_orderkey").alias("id"), scalars.compact_date(iso).alias("compact"))


@query("SELECT event_id AS id, rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' AS iso, true AS was_compact FROM events")
def date_expand(spark, d):
    e = T(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    c = e.select("event_id", scalars.compact_date(scalars.text_of(F.col("ts"), e.schema["ts"].dataType)).alias("c"))
    return c.select(F.col("event_id").alias("id"), scalars.expand_date(F.col("c")).alias("iso"), scalars.is_compact_date(F.col("c")).alias("was_compact"))


@query("SELECT doc_id, coalesce(quality::VARCHAR, '-') AS q, coalesce(nullif(toxic, 1)::VARCHAR, '-') AS t FROM labels")
def bool_null_compact(spark, d):
    b = lambda c: F.when(c.isNull(), "-").otherwise(F.when(c, "1").otherwise("0"))
    return T(spark, d, "labels").select("doc_id", b(F.col("quality") == 1).alias("q"), b(F.when(F.col("toxic") == 0, F.lit(False))).alias("t"))


@query(f"SELECT doc_id, {_quoted('text')} AS quoted FROM documents")
def quoting(spark, d):
    return T(spark, d, "documents").select("doc_id", scalars.quoted(F.col("text")).alias("quoted"))


@query("SELECT doc_id, text FROM documents")
def quoting_roundtrip(spark, d):
    return T(spark, d, "documents").select("doc_id", scalars.unquoted(scalars.quoted(F.col("text"))).alias("text"))


UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)"


BASE62 = " || ".join(f"substr('{scalars.UUID_DIGITS}', ((n // {62**i}::UHUGEINT) % 62)::INT + 1, 1)" for i in range(21, -1, -1))


@query(f"""SELECT id, uuid, '^' || ltrim({BASE62}, '0') AS short FROM (
    SELECT c_custkey AS id, {UUID_SQL} AS uuid, ('0x' || substr(h, 1, 16))::UBIGINT::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || substr(h, 17))::UBIGINT AS n FROM (SELECT c_custkey, md5(c_custkey::VARCHAR) AS h FROM customer))""")
def uuid_base62(spark, d):
    h = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return T(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.uuid_to_base62(u).alias("short")).select("id", scalars.base62_to_uuid(F.col("short")).alias("uuid"), "short")


def _template_sql(table: str, col: str) -> str:
    lcp = lambda a, b: f"len(list_filter(range(1, least(length({a}), length({b}))::BIGINT + 1), lambda i: left({a}, i) = left({b}, i)))"
    return f"""SELECT '{table}.{col}' AS col, left(lo, p::INT) AS prefix, right(lo, s::INT) AS suffix, (p + s)::BIGINT AS saved FROM (
        SELECT lo, n, p, least(sp, short - p) AS s FROM (SELECT lo, n, short, {lcp('lo', 'hi')} AS p, {lcp('rlo', 'rhi')} AS sp FROM (
            SELECT count(*) AS n, min({col}) AS lo, max({col}) AS hi, min(reverse({col})) AS rlo, max(reverse({col})) AS rhi, min(length({col})) AS short, bool_or({col} IS NULL OR regexp_matches({col}, '^($|[$+~]|-$)')) AS bad FROM {table}) WHERE n >= 2 AND NOT bad AND lo <> hi))
        WHERE p + s >= 4 AND (p + s) * n > length('@T 0: ' || left(lo, p::INT) || '{{}}' || right(lo, s::INT)) + 1"""


TEMPLATED = (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("pages", "url"))


@query(" UNION ALL ".join(_template_sql(t, c) for t, c in TEMPLATED))
def template_detect(spark, d):
    out = None
    for t, c in TEMPLATED:
        one = templates.detect(T(spark, d, t), [c]).withColumn("col", F.concat(F.lit(f"{t}."), "col"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH t AS ({_template_sql('customer', 'c_name')}) SELECT c_custkey AS key, substr(c_name, length(prefix) + 1, length(c_name) - length(prefix) - length(suffix)) AS part FROM customer, t")
def template_strip(spark, d):
    c = T(spark, d, "customer")
    t = templates.detect(c, ["c_name"]).first()
    return c.select(F.col("c_custkey").alias("key"), templates.strip(F.col("c_name"), t.prefix, t.suffix).alias("part"))


@query("SELECT c_custkey AS key, c_name FROM customer")
def template_expand(spark, d):
    t = templates.detect(T(spark, d, "customer"), ["c_name"]).first()
    return template_strip(spark, d).select("key", templates.expand(F.col("part"), t.prefix, t.suffix).alias("c_name"))


def _ngrams_sql(table: str, col: str) -> str:
    return f"""WITH c AS (SELECT {col} AS cell, count(*) AS n FROM {table} WHERE length({col}) >= 6 AND NOT regexp_matches({col}, '^(\\$|\\+|~$|-$|-\\d)') GROUP BY 1), g AS (SELECT DISTINCT cell, c.n, substr(cell, i::INT, w::INT) AS fragment FROM c, range(1, 400) a(i), range(6, 51) b(w) WHERE i + w - 1 <= length(cell))
        SELECT fragment, sum(n)::BIGINT AS frequency, ((length(fragment) - 3) * sum(n))::BIGINT AS savings FROM g GROUP BY fragment HAVING sum(n) >= 3"""


@query(_ngrams_sql("supplier", "s_name"))
def substring_ngrams(spark, d):
    return substrings.ngrams(T(spark, d, "supplier"), ["s_name"])


@query(f"""WITH RECURSIVE cand AS (SELECT * FROM ({_ngrams_sql('pages', 'url')}) WHERE savings > length(fragment) + 4)
    , g(k, chosen) AS (SELECT 0, []::VARCHAR[] UNION ALL SELECT k + 1, list_append(chosen, arg_min(fragment, (-savings, -length(fragment), fragment))) FROM g, cand
        WHERE k < 32 AND len(list_filter(chosen, lambda c: contains(c, fragment) OR contains(fragment, c))) = 0 GROUP BY k, chosen)
    , f AS (SELECT unnest(chosen) AS fragment, unnest(range(0, len(chosen))) AS i FROM (SELECT chosen FROM g ORDER BY k DESC LIMIT 1))
    , p AS (SELECT page_id, replace(url, '%', '%%') AS text, url FROM pages)
    , b AS (SELECT page_id, arg_min(struct_pack(x := replace(fragment, '%', '%%'), i := i), (-length(fragment), i)) AS best FROM p, f WHERE contains(text, replace(fragment, '%', '%%')) GROUP BY page_id)
    SELECT p.page_id, CASE WHEN best IS NULL THEN text ELSE left(text, strpos(text, best.x) - 1) || '%' || best.i || ';' || substr(text, strpos(text, best.x) + length(best.x)) END AS cell FROM p LEFT JOIN b ON p.page_id = b.page_id""")
def substring_apply(spark, d):
    p = T(spark, d, "pages")
    found = substrings.choose(substrings.ngrams(p, ["url"]))
    return p.select("page_id", substrings.apply(F.col("url"), found).alias("cell"))


@query("SELECT page_id, url FROM pages")
def substring_roundtrip(spark, d):
    p = T(spark, d, "pages")
    found = substrings.choose(substrings.ngrams(p, ["url"]))
    return p.select("page_id", substrings.expand(substrings.apply(F.col("url"), found), found).alias("url"))


def _delta_sql(table: str, order: str, col: str, expr: str, kind: str) -> str:
    return f"""SELECT '{table}.{col}' AS col, '{kind}' AS kind, coalesce(min(d) = max(d), false) AS is_const, count(*) >= 3 AND count(v) = count(*) AND (coalesce(min(d) = max(d), false) OR coalesce(sum(abs(d))::DOUBLE / count(d) < 0.5 * sum(abs(v))::DOUBLE / count(v), false)) AS eligible
        FROM (SELECT v, v - lag(v) OVER (ORDER BY {order}) AS d FROM (SELECT {order}, ({expr})::HUGEINT AS v FROM {table}))"""


DELTAS = (("orders", "o_orderkey", "o_orderkey", "o_orderkey", "numeric"), ("orders", "o_orderkey", "o_custkey", "o_custkey", "numeric"), ("customer", "c_custkey", "c_nationkey", "c_nationkey", "numeric"), ("events", "event_id", "ts", "epoch_us(ts)", "temporal"))
BLOCK = 65_536


@query(" UNION ALL ".join(_delta_sql(*x) for x in DELTAS))
def delta_eligibility(spark, d):
    out = None
    for table, order, col, _, kind in DELTAS:
        t = with_ordinal(T(spark, d, table), [order], BLOCK)
        v = F.unix_micros(F.col(col).cast("timestamp")) if kind == "temporal" else F.col(col)
        one = deltas.eligibility(t.select("__ord", "__block", v.alias(col)), {col: kind}, "__ord", "__block", across=True).withColumn("col", F.concat(F.lit(f"{table}."), "col"))
        out = one if out is None else out.unionByName(one)
    return out


def _blocked(spark, d, table, order, block_rows=1000):
    return with_ordinal(T(spark, d, table), [order], block_rows), Window.partitionBy("__block").orderBy("__ord")


def _delta_encode_sql(table: str, order: str, expr: str, suffix: str = "") -> str:
    return f"""SELECT {order} AS key, CASE WHEN d IS NULL THEN v::VARCHAR ELSE CASE WHEN d < 0 THEN '' ELSE '+' END || d::VARCHAR || '{suffix}' END AS cell FROM (
        SELECT {order}, v, v - lag(v) OVER (PARTITION BY b ORDER BY {order}) AS d FROM (SELECT {order}, {expr} AS v, (row_number() OVER (ORDER BY {order}) - 1) // 1000 AS b FROM {table}))"""


@query(_delta_encode_sql("orders", "o_orderkey", "o_custkey"))
def delta_encode_int(spark, d):
    t, w = _blocked(spark, d, "orders", "o_orderkey")
    return t.select(F.col("o_orderkey").alias("key"), deltas.delta(F.col("o_custkey"), w).alias("cell"))


@query(_delta_encode_sql("events", "event_id", "epoch_us(ts)", "us"))
def delta_encode_temporal(spark, d):
    t, w = _blocked(spark, d, "events", "event_id")
    return t.select(F.col("event_id").alias("key"), deltas.delta(F.unix_micros(F.col("ts").cast("timestamp")), w, "us").alias("cell"))


@query(_delta_encode_sql("orders", "o_orderkey", "o_totalprice::DECIMAL(18,2)"))
def delta_encode_decimal(spark, d):
    t, w = _blocked(spark, d, "orders", "o_orderkey")
    return t.select(F.col("o_orderkey").alias("key"), deltas.delta(F.col("o_totalprice").cast("decimal(18,2)"), w).alias("cell"))


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders")
def delta_decode(spark, d):
    t, w = _blocked(spark, d, "orders", "o_orderkey")
    cells = t.select("__block", "__ord", F.col("o_orderkey").alias("key"), deltas.delta(F.col("o_custkey"), w).alias("cell"))
    return cells.select("key", deltas.undelta(F.col("cell"), w).alias("value"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY b ORDER BY o_orderkey) THEN '~' ELSE o_orderstatus END AS cell
    FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS b FROM orders)""")
def repeat_encode(spark, d):
    t, w = _blocked(spark, d, "orders", "o_orderkey")
    return t.select(F.col("o_orderkey").alias("key"), deltas.repeat(F.col("o_orderstatus"), w).alias("cell"))


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders")
def repeat_decode(spark, d):
    t, w = _blocked(spark, d, "orders", "o_orderkey")
    cells = t.select("__block", "__ord", F.col("o_orderkey").alias("key"), deltas.repeat(F.col("o_orderstatus"), w).alias("cell"))
    return cells.select("key", deltas.unrepeat(F.col("cell"), w).alias("value"))


def _tokens_sql(x: str) -> str:
    return f"""CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, coalesce(list_sum(list_transform(regexp_extract_all({x}, ' ?[a-zA-Z]+|[0-9][0-9.eE+-]*|(?s:.)'), lambda p:
        CASE WHEN regexp_matches(p, '^ ?[a-zA-Z]+$') THEN ceil(length(ltrim(p)) / 5.0) WHEN regexp_matches(p, '^[0-9]') THEN ceil(length(p) / 3.0) ELSE 1 END)), 0))::BIGINT END"""


@query(f"SELECT doc_id AS id, {_tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return T(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT source, sum({_tokens_sql('text')})::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY source")
def token_by_source(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(F.sum(tokens.estimate_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


ADVISED = (("nation", "n_nationkey"), ("region", "r_regionkey"))


def _all(f, spark, d):
    out = None
    for t, k in ADVISED:
        one = f(T(spark, d, t), k, t)
        out = one if out is None else out.unionByName(one)
    return out


def _nation_json() -> str:
    return """'{"n_nationkey":' || n_nationkey || ',"n_name":' || to_json(n_name)::VARCHAR || ',"n_regionkey":' || n_regionkey || '}'"""


def _region_json() -> str:
    return """'{"r_regionkey":' || r_regionkey || ',"r_name":' || to_json(r_name)::VARCHAR || '}'"""


@query(f"""SELECT 'nation' AS "table", (sum(length({_nation_json()})) + count(*) - 1 + 2)::BIGINT AS json_size, count(*) AS n_rows FROM nation
    UNION ALL SELECT 'region', (sum(length({_region_json()})) + count(*) - 1 + 2)::BIGINT, count(*) FROM region""")
def profile_sizes(spark, d):
    return _all(advisor.profile, spark, d).select("table", "json_size", "n_rows")


def _profile_sql(table: str, key: str, json: str, numbers: list[str], strings: list[str], names: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT {c} AS value, {key} AS ord, {i} AS col FROM {table}" for i, c in enumerate(strings))
    rated = f"SELECT value, frequency, t - 1 AS savings, t FROM (SELECT value, count(*) AS frequency, greatest(1, ceil(length(value) / 4.0))::BIGINT AS t FROM ({cells}) GROUP BY value) WHERE frequency >= 2 AND length(value) >= 2 AND (t - 1) * frequency >= t + 1"
    steps = " + ".join(f"(SELECT (count(*) >= 2 AND min(s) = max(s))::BIGINT FROM (SELECT {c} - lag({c}) OVER (ORDER BY {key}) AS s FROM (SELECT * FROM {table} ORDER BY {key} LIMIT 20)) WHERE s IS NOT NULL)" for c in numbers)
    over = sum(len(n) + 4 for n in names)
    return f"""SELECT "table", json_size, n_rows, n_shapes, key_overhead, dict_entries, dict_savings, delta_columns,
            least(80, floor(100.0 * key_overhead / json_size + 0.5))::BIGINT AS l1, least(80, floor(100.0 * (key_overhead + dict_savings) / json_size + 0.5))::BIGINT AS l2,
            least(85, floor(100.0 * (key_overhead + dict_savings + CASE WHEN n_rows >= 3 THEN 2 * n_rows * delta_columns ELSE 0 END) / json_size + 0.5))::BIGINT AS l3
        FROM (SELECT '{table}' AS "table", (sum(length({json})) + count(*) + 1)::BIGINT AS json_size, count(*) AS n_rows, (count(*) >= 2)::BIGINT AS n_shapes, ({over} * (count(*) - 1))::BIGINT AS key_overhead,
            (SELECT count(*) FROM ({rated})) AS dict_entries, (SELECT coalesce(sum(greatest(0, (length(value) - 2 - length(savings::VARCHAR)) * frequency)), 0)::BIGINT FROM ({rated})) AS dict_savings, {steps} AS delta_columns FROM {table})"""


PROFILES = " UNION ALL ".join([_profile_sql("nation", "n_nationkey", _nation_json(), ["n_nationkey", "n_regionkey"], ["n_name"], ["n_nationkey", "n_name", "n_regionkey"]), _profile_sql("region", "r_regionkey", _region_json(), ["r_regionkey"], ["r_name"], ["r_regionkey", "r_name"])])


@query(PROFILES)
def profile_characteristics(spark, d):
    return _all(advisor.profile, spark, d)


@query(f"""SELECT "table", CASE WHEN json_size < 150 OR n_shapes = 0 THEN 1 WHEN dict_entries = 0 AND delta_columns > 0 AND l3 - l1 >= 3 THEN 3 WHEN dict_entries = 0 AND l2 - l1 < 3 THEN 1
    WHEN delta_columns = 0 OR l3 - l2 < 3 THEN 2 ELSE 3 END AS level, true AS will_compress,
    concat_ws('; ', CASE WHEN json_size < 150 THEN 'small' END, CASE WHEN n_shapes = 0 THEN 'no repeating shape' END, CASE WHEN dict_entries = 0 THEN 'no dictionary' END, CASE WHEN delta_columns = 0 THEN 'no constant steps' END) AS caveats FROM ({PROFILES})""")
def recommend_level(spark, d):
    return _all(advisor.recommend, spark, d).select("table", "level", "will_compress", F.array_join("caveats", "; ").alias("caveats"))


CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS tab)"


def _crc_sql(text: str) -> str:
    """SQL for CRC-32 in hex, byte by byte, beside CRC_TABLE."""
    return f"lower(lpad(printf('%x', xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::UBIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)), 8, '0'))"


def _document_sql(table: str, level: int) -> str:
    """SQL of (block, ord, line) of nation's or region's document: names of nation have a template, keys rise by one."""
    key, name, more = ("n_nationkey", "n_name", ["n_regionkey"]) if table == "nation" else ("r_regionkey", "r_name", [])
    templated = table == "nation" and level > 1
    cells = [f"{key}::VARCHAR", f"substr({name}, 8)" if templated else _quoted(name), *(f"{x}::VARCHAR" for x in more)]
    if level == 3:
        repeat = [f"CASE WHEN {c} = lag({c}) OVER (ORDER BY {key}) THEN '~' ELSE {c} END" for c in cells[1:]]
        cells = [f"CASE WHEN lag({key}) OVER (ORDER BY {key}) IS NULL THEN {key}::VARCHAR ELSE '+' || ({key} - lag({key}) OVER (ORDER BY {key})) END", *repeat]
    type_ = "Item" if level == 1 else "A"
    head = [f"@v{level}", f"@S {type_}: " + ", ".join([key, name, *more]), *(["@T 1: NATION_{}"] if templated else [])]
    sep = "chr(9)" if level == 3 else "', '"
    rows = f"SELECT row_number() OVER (ORDER BY {key}) - 1 AS ord, concat_ws({sep}, {', '.join(cells)}) AS line FROM {table}"
    count = f"'@N' || (SELECT count(*) FROM {table}) || ' {type_}'"
    whole = " || chr(10) || ".join([*(f"'{h}'" for h in head), count, f"(SELECT string_agg(line, chr(10) ORDER BY ord) FROM ({rows}))"])
    fixed = " UNION ALL ".join([f"SELECT -1000 AS ord, '{head[0]}' AS line", f"SELECT -999, '@C ' || {_crc_sql(whole)} FROM {CRC_TABLE}", *(f"SELECT {-998 + i}, '{h}'" for i, h in enumerate(head[1:])), f"SELECT -1, {count}"])
    return f"SELECT 0::BIGINT AS block, ord::BIGINT AS ord, line FROM ({fixed} UNION ALL {rows})"


def _sizes_sql(table: str) -> str:
    """SQL of (level, chars, tokens) of JSON and the documents."""
    j = _nation_json() if table == "nation" else _region_json()
    out = [f"SELECT 0 AS level, (sum(length({j})) + count(*) + 1)::BIGINT AS chars, (sum({_tokens_sql(j)}) + count(*) - 1 + 2)::BIGINT AS tokens FROM {table}"]
    out += [f"SELECT {n}, (sum(length(line)) + count(*) - 1)::BIGINT, (sum({_tokens_sql('line')}) + count(*) - 1)::BIGINT FROM ({_document_sql(table, n)})" for n in (1, 2, 3)]
    return " UNION ALL ".join(out)


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", arg_min(level, (chars, level)) AS best, min(chars) AS chars FROM ({_sizes_sql(t)})""" for t, _ in ADVISED))
def auto_level(spark, d):
    return _all(advisor.auto_level, spark, d)


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", j AS json_tokens, a AS l1_tokens, b AS l2_tokens, c AS l3_tokens, 0 AS n_dict, 1 AS n_delta, (j - least(a, b, c)) * 100.0::DOUBLE / j AS reduction
    FROM (SELECT max(tokens) FILTER (level = 0) AS j, max(tokens) FILTER (level = 1) AS a, max(tokens) FILTER (level = 2) AS b, max(tokens) FILTER (level = 3) AS c FROM ({_sizes_sql(t)}))""" for t, _ in ADVISED))
def analyze_tables(spark, d):
    return _all(advisor.analyze, spark, d)


def _compare_sql() -> str:
    toon = f"'  ' || concat_ws(', ', n_nationkey::VARCHAR, {_quoted('n_name')}, n_regionkey::VARCHAR)"
    tron = f"'A ' || concat_ws(', ', n_nationkey::VARCHAR, {_quoted('n_name')}, n_regionkey::VARCHAR)"
    yaml = f"'- n_nationkey: ' || n_nationkey || chr(10) || '  n_name: ' || {_quoted('n_name')} || chr(10) || '  n_regionkey: ' || n_regionkey"
    pretty = """'  {' || chr(10) || '    "n_nationkey": ' || n_nationkey || ',' || chr(10) || '    "n_name": ' || to_json(n_name)::VARCHAR || ',' || chr(10) || '    "n_regionkey": ' || n_regionkey || chr(10) || '  }'"""
    one = lambda f, line, gap, head: f"SELECT '{f}' AS format, (sum(length({line})) + (count(*) - 1) * {gap} + length({head}))::BIGINT AS chars, (sum({_tokens_sql(line)}) + (count(*) - 1) * {gap} + {_tokens_sql(f'any_value({head})').replace('any_value', '')})::BIGINT AS tokens FROM nation"
    cols, end = "n_nationkey, n_name, n_regionkey", " || chr(10)"
    heads = {"json": "'[]'", "json_pretty": "'[' || chr(10) || chr(10) || ']'", "toon": f"'[' || count(*) || ']:' || chr(10) || '  - {cols}'{end}", "tron": f"'class A: {cols}'{end}", "yaml": "chr(10)"}
    lines = {"json": (_nation_json(), 1), "json_pretty": (pretty, 2), "toon": (toon, 1), "tron": (tron, 1), "yaml": (yaml, 1)}
    return " UNION ALL ".join(one(f, line, gap, heads[f]) for f, (line, gap) in lines.items())


@query(f"SELECT format, chars FROM ({_compare_sql()})")
def compare_formats(spark, d):
    return render.compare(T(spark, d, "nation")).select("format", "chars")


@query(f"""SELECT format, chars, tokens, (tokens - base) * 100.0::DOUBLE / base AS pct, tokens::DOUBLE / most AS share
    FROM (SELECT *, max(tokens) OVER () AS most, max(tokens) FILTER (format = 'json') OVER () AS base FROM ({_compare_sql()}))""")
def compare_tokens(spark, d):
    return render.compare(T(spark, d, "nation"))


@query(f"""WITH s AS (SELECT 'level' || level AS format, chars, tokens FROM ({_sizes_sql('nation')}) WHERE level > 0)
    , r AS (SELECT * FROM s UNION ALL SELECT 'auto', min(chars), arg_min(tokens, (chars, format)) FROM s UNION ALL SELECT * FROM ({_compare_sql()}))
    SELECT format, chars, tokens, (tokens - base) * 100.0::DOUBLE / base AS pct, tokens::DOUBLE / most AS share FROM (SELECT *, max(tokens) OVER () AS most, max(tokens) FILTER (format = 'json') OVER () AS base FROM r)""")
def compare_levels(spark, d):
    return advisor.compare_all(T(spark, d, "nation"), "n_nationkey")


@query("SELECT count(*) AS declared, count(*) AS actual, true AS ok FROM nation")
def cardinality_guard(spark, d):
    """What the document of a table declares, against its rows."""
    head = document.encode(T(spark, d, "nation"), "n_nationkey").lines.filter("line like '@N%'").first().line
    return integrity.cardinality(T(spark, d, "nation"), int(head[2:].split()[0]))


@query(f"SELECT doc_id, {_crc_sql('text')} AS crc FROM documents, {CRC_TABLE}")
def checksum(spark, d):
    return T(spark, d, "documents").select("doc_id", integrity.crc_hex(F.col("text")).alias("crc"))


@query("""SELECT id, is_json, CASE WHEN is_json THEN 'compress' ELSE 'pass' END AS action FROM (SELECT id, regexp_matches(ltrim(text), '^[{\\[]') AND json_valid(text) AS is_json FROM
    (SELECT 'c' || conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'e' || event_id, props FROM events))""")
def route_content(spark, d):
    c = T(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    e = T(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("text"))
    return integrity.route(c.unionByName(e), "text").select("id", "is_json", "action")


@query("SELECT c_nationkey AS nation, c_custkey AS id, c_name AS name, c_mktsegment AS segment, true AS shorter FROM customer")
def message_compress(spark, d):
    """Messages that hold JSON: one for each nation's customers, written as documents and read back."""
    rows = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))))
    sent = T(spark, d, "customer").groupBy("c_nationkey").agg(rows.alias("j")).withColumn("sent", foreign.json_documents(F.col("j")))
    sent = sent.select("c_nationkey", "sent", (F.length("sent") < F.length("j")).alias("shorter"))  # before the rows part, or each would carry and measure its message
    back = F.from_json(foreign.documents_json(F.col("sent")), "array<struct<id:bigint,name:string,segment:string>>")
    return sent.select(F.col("c_nationkey").alias("nation"), F.explode(back).alias("r"), "shorter").select("nation", "r.id", "r.name", "r.segment", "shorter")


@query(f"SELECT c_custkey AS id, {UUID_SQL} AS u, c_name AS name FROM (SELECT *, md5(c_custkey::VARCHAR) AS h FROM customer)")
def roundtrip_l3_uuids(spark, d):
    h = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    e = document.encode(T(spark, d, "customer").select(F.col("c_custkey").alias("id"), u.alias("u"), F.col("c_name").alias("name")), "id", level=3)
    if e.plan.codecs["u"] != "uuid":
        raise ValueError("the column is not taken as UUIDs")
    return _through(e)


def _places(spark, d):
    c = T(spark, d, "customer")
    return c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.array("c_mktsegment", "c_name").alias("tags")).alias("place"))


@query("""SELECT c_custkey, 'Place(' || c_name || ', ' || c_nationkey || ', [' || c_mktsegment || ', ' || c_name || '])' AS called,
    '{name: ' || c_name || ', nation: ' || c_nationkey || ', tags: [' || c_mktsegment || ', ' || c_name || ']}' AS braced FROM customer""")
def inline_text(spark, d):
    p = _places(spark, d)
    kind = p.schema["place"].dataType
    return p.select("c_custkey", inline.written(F.col("place"), kind, "Place").alias("called"), inline.written(F.col("place"), kind).alias("braced"))


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_mktsegment AS tag FROM customer")
def inline_roundtrip(spark, d):
    back = _through(document.encode(_places(spark, d), "c_custkey", level=2, block_rows=5000))
    return back.select("c_custkey", "place.name", "place.nation", F.get("place.tags", F.lit(0)).alias("tag"))


@query("SELECT s_suppkey, s_name AS name, s_nationkey AS nation FROM supplier")
def key_value_read(spark, d):
    block = F.concat(F.lit("# supplier\nkey: "), F.col("s_suppkey").cast("string"), F.lit("\nheld:\n  name: "), scalars.quoted(F.col("s_name")), F.lit("\n  nation: "), F.col("s_nationkey").cast("string"))
    read = F.from_json(inline.key_value_json(block), "key long, held struct<name:string,nation:int>")
    return T(spark, d, "supplier").select(read.alias("r")).select(F.col("r.key").alias("s_suppkey"), "r.held.name", "r.held.nation")


@query("""SELECT ord, i - 1 AS pos, embedding[i]::DOUBLE AS value
    FROM (SELECT ord, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, embedding FROM embeddings))""")
def matrix_roundtrip(spark, d):
    e = T(spark, d, "embeddings")
    back = matrix.decode_matrix(matrix.encode_matrix(e, "embedding", "vec_id", 2, 5000), e.schema["embedding"].dataType.elementType)
    return back.select("ord", F.posexplode("row").alias("pos", "value")).select("ord", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query("""SELECT c_custkey, i AS pos, c_custkey + i AS id, CASE WHEN i < 2 THEN c_name ELSE c_mktsegment END AS name, CASE i WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer, range(3) r(i)""")
def foreign_documents(spark, d):
    """Documents without a plan, one for each row: steps, repeats, references and hints are read from the header alone."""
    text = F.concat(F.lit("@v3\n@S A: id, name, flag?b\n@D: "), F.col("c_mktsegment"), F.lit("\n@N3 A\n"), F.col("c_custkey").cast("string"), F.lit("\t"), scalars.quoted(F.col("c_name")), F.lit("\t1\n+1\t~\t0\n+1\t$0\t-"))
    rows = F.from_json(foreign.documents_json(text), "array<struct<id:bigint,name:string,flag:boolean>>")
    return T(spark, d, "customer").select("c_custkey", F.posexplode(rows).alias("pos", "r")).select("c_custkey", F.col("pos").cast("long").alias("pos"), "r.id", "r.name", "r.flag")


@query("SELECT event_id, props AS j FROM events")
def foreign_json(spark, d):
    """JSON in JSON's own form is a document too, and stays as it is."""
    return T(spark, d, "events").select("event_id", foreign.documents_json(F.col("props")).alias("j"))


@query("""SELECT 'e' || event_id AS id, coalesce(list_max(list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda c: CASE WHEN c IN ('[', '(', '{') THEN 1 ELSE -1 END)))), 0)::INT AS depth
    FROM (SELECT event_id, regexp_extract_all(regexp_replace(props, '"([^"\\\\]|\\\\.)*"', '', 'g'), '[\\[\\](){}]') AS x FROM events)""")
def text_depth(spark, d):
    return T(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), integrity.text_depth(F.col("props")).alias("depth"))


@query("""WITH o AS (SELECT to_json({'o_orderkey': o_orderkey, 'customer': {'c_custkey': c_custkey, 'c_name': c_name}, 'lines': [{'a': 1, 'b': o_orderkey}, {'a': 2, 'b': 0}]}) AS j FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT signature, n_keys, count(*) AS frequency, min(path) AS path FROM (SELECT 'customer,lines,o_orderkey' AS signature, 3::BIGINT AS n_keys, '' AS path FROM o UNION ALL SELECT 'c_custkey,c_name', 2, '.customer' FROM o
        UNION ALL SELECT 'a,b', 2, '.lines[0]' FROM o UNION ALL SELECT 'a,b', 2, '.lines[1]' FROM o) GROUP BY 1, 2 HAVING count(*) >= 2""")
def shape_all_levels(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    lines = F.array(F.struct(F.lit(1).alias("a"), F.col("o_orderkey").alias("b")), F.struct(F.lit(2).alias("a"), F.lit(0).cast("long").alias("b")))
    j = o.withColumn("o_orderkey", F.col("o_orderkey").cast("long")).join(c, o.o_custkey == c.c_custkey).select(F.to_json(F.struct("o_orderkey", F.struct("c_custkey", "c_name").alias("customer"), lines.alias("lines"))).alias("j"), F.lit("").alias("path"))
    return shapes.shapes(shapes.values(j))


def _documents(level: int):
    def lines(spark, d):
        return document.encode(T(spark, d, "nation"), "n_nationkey", level=level, embed_plan=False).lines

    return lines


def _through(e: document.Encoded) -> DataFrame:
    """The table of a document that is written first, as a document is, and then read."""
    lines = materialize(e.lines, "lines")
    e.discard()
    return document.decode(lines)


def _roundtrip(table: str, key: str, level: int):
    def back(spark, d):
        return _through(document.encode(T(spark, d, table), key, level=level, block_rows=5000))

    return back


for _level in (1, 2, 3):
    query(_document_sql("nation", _level), f"encode_doc_l{_level}")(_documents(_level))
    for _t, _k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")):
        query(f"SELECT * FROM {_t}", f"roundtrip_l{_level}_{_t}")(_roundtrip(_t, _k, _level))


@query("SELECT * FROM events")
def stream_roundtrip(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = spark.readStream.schema(T(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    stream.stream_encode(src, "event_id", f"{at}/out", f"{at}/check").awaitTermination()
    return stream.stream_decode(spark, f"{at}/out")


def _flat(df: DataFrame) -> DataFrame:
    """Fields of structs as columns of their own, arrays as text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, types.StructType):
            out += [F.col(f"{f.name}.{x}").alias(f"{f.name}_{x}") for x in f.dataType.names]
        else:
            out.append(F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, types.ArrayType) else F.col(f.name))
    return df.select(*out)


def _preset(name: str):
    return lambda spark, d: _flat(presets.PRESETS[name](spark))


for _name in presets.PRESETS:
    query(name=f"preset_{_name}")(_preset(_name))

_PEOPLE = "SELECT range + 1 AS id, 'Employee ' || (range + 1) AS name, 'emp' || (range + 1) || '@company.com' AS email, (['Engineering', 'Sales', 'Marketing', 'Support', 'Finance'])[range % 5 + 1] AS department, range % 3 <> 0 AS active, 50000 + range * 1000 AS salary, strftime(DATE '2020-01-01' + range::INT, '%Y-%m-%d') AS \"joinDate\" FROM range({})"
SQL |= {
    "preset_employees_500": _PEOPLE.format(500),
    "preset_people_100": _PEOPLE.format(100),
    "preset_iot_sensors": "SELECT strftime(make_timestamp((1704067200 + range * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'sensor-' || (range % 10) AS \"sensorId\", 20 + range % 50 / 4.0::DOUBLE AS temperature, 40 + range % 40 / 2.0::DOUBLE AS humidity, (['ok', 'warn', 'error'])[range % 3 + 1] AS status, range % 7 = 0 AS alert FROM range(200)",
    "preset_weather": """SELECT strftime(DATE '2024-03-01' + range::INT, '%Y-%m-%d') AS date, (['Paris', 'Berlin', 'Madrid'])[range % 3 + 1] AS location_city, (['FR', 'DE', 'ES'])[range % 3 + 1] AS location_country, ([48.86, 52.52, 40.42])[range % 3 + 1]::DOUBLE AS location_lat, ([2.35, 13.4, -3.7])[range % 3 + 1]::DOUBLE AS location_lon,
        5 + range % 10 AS temperature_min, 13 + range % 10 AS temperature_max, 9 + range % 10 AS temperature_avg, 'C' AS temperature_unit, 50 + range % 30 AS humidity, range % 25 AS "windSpeed", (['sunny', 'cloudy', 'rain'])[range % 3 + 1] AS conditions FROM range(30)""",
    "preset_products": """SELECT 'P-' || lpad((range + 1)::VARCHAR, 4, '0') AS id, 'Product ' || lpad((range + 1)::VARCHAR, 4, '0') AS name, c AS category, range + 0.5::DOUBLE AS price, range % 4 <> 0 AS "inStock", c || '|' || (['new', 'sale'])[range % 2 + 1] AS tags, range % 9 + 1 AS specs_weight, (range % 5 + 1) || 'x2' AS specs_dimensions,
        3 + range % 4 / 2.0::DOUBLE AS rating_average, range * 3 AS rating_count FROM (SELECT range, (['tools', 'toys', 'books', 'garden', 'food'])[range % 5 + 1] AS c FROM range(25))""",
    "preset_config": "SELECT " + ", ".join(f"'{n}' AS {n}_name, {i} AS {n}_port" for i, n in enumerate(("server", "database", "cache", "queue", "auth", "logging"))),
    "preset_rag": "SELECT 'chunk-' || range AS id, 'docs/' || range || '.md' AS source, 'Passage number ' || range || ' of the manual.' AS content, range / 8.0::DOUBLE AS metadata_score, range * 10 AS metadata_page FROM range(5)",
    "preset_tiny_object": "SELECT 1::BIGINT AS id, 'Ada' AS name",
    "preset_mixed_array": """SELECT * FROM (VALUES (0::BIGINT, '1'), (1, '"two"'), (2, '[3]'), (3, '{"four":4}'), (4, 'null')) t(id, j)""",
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """orders: dictionary on the priority, delta on the key, repeat on the status, as rows of cells."""
    o = T(spark, d, "orders")
    refs = [r.value for r in _orders_dictionary(spark, d).orderBy("idx").collect()]
    t = with_ordinal(o, ["o_orderkey"], 1000)
    w = Window.partitionBy("__block").orderBy("__ord")
    return t.select("o_orderkey", F.concat_ws("\t", deltas.delta(F.col("o_orderkey"), w), deltas.repeat(F.col("o_orderstatus"), w), F.coalesce(dictionary.lookup(F.col("o_orderpriority"), refs), scalars.quoted(F.col("o_orderpriority")))).alias("cells"))


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""SELECT o_orderkey, concat_ws(chr(9), CASE WHEN d IS NULL THEN o_orderkey::VARCHAR ELSE CASE WHEN d < 0 THEN '' ELSE '+' END || d END, CASE WHEN o_orderstatus = before THEN '~' ELSE o_orderstatus END, coalesce(ref, {_quoted('o_orderpriority')})) AS cells
    FROM (SELECT *, o_orderkey - lag(o_orderkey) OVER w AS d, lag(o_orderstatus) OVER w AS before FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS b FROM orders) WINDOW w AS (PARTITION BY b ORDER BY o_orderkey)) LEFT JOIN ({_dictionary(ORDER_CELLS)}) ON o_orderpriority = value"""
