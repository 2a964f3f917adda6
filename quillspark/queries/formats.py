"""Queries that write text formats and read them again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators.formats import passes
from quillspark.plans import parse_transform
from quillspark.queries.sources import table
from quillspark.session import fresh_folder, prepare
from quillspark.sources import readers as R
from quillspark.sources import writers as W
from quillspark.streaming.transforms import segments, windowed_totals

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str):
    def add(query):
        ENTRIES[name] = (query, sql)
        return query

    return add


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_size", "p_retailprice")


@entry("io_csv", "SELECT p_partkey AS k, p_name, p_brand || ',\"x\"' AS p_brand, CAST(p_size AS BIGINT) AS p_size FROM part")
def io_csv(spark, d):
    p = parts(spark, d).withColumn("p_brand", F.concat("p_brand", F.lit(',"x"'))).drop("p_retailprice")
    back = R.csv_table(W.csv_lines(p, ["p_name", "p_brand", "p_size"]), "line", ["p_name", "p_brand", "p_size"])
    return back.withColumn("p_size", F.col("p_size").cast("bigint"))


@entry("io_csv_text", "SELECT p_partkey AS k, p_name || ',\"' || p_brand || ',\"\"x\"\"\"' AS line FROM part")
def io_csv_text(spark, d):
    p = parts(spark, d).select("k", "p_name", F.concat("p_brand", F.lit(',"x"')).alias("p_brand"))
    return W.csv_lines(p, ["p_name", "p_brand"])


@entry("io_json", "SELECT p_partkey AS k, '{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' AS line FROM part")
def io_json(spark, d):
    return W.json_lines(parts(spark, d).select("k", "p_name", "p_size"), ["p_name", "p_size"])


@entry("io_xml", "SELECT p_partkey AS k, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def io_xml(spark, d):
    text = W.xml_lines(parts(spark, d).select("k", "p_name", F.col("p_size").alias("@size")), ["p_name", "@size"], "part")
    back = text.select("k", F.from_xml("line", "p_name string, `@size` string", {"attributePrefix": "@", "rowTag": "part"}).alias("x"))
    return back.select("k", "x.p_name", F.col("x.`@size`").cast("bigint").alias("p_size"))


@entry("io_flat", "SELECT p_partkey AS doc_id, 'p_name' AS path, 'string' AS type, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_size', 'integer', CAST(p_size AS VARCHAR) FROM part")
def io_flat(spark, d):
    text = W.flat_text(D.from_table(parts(spark, d).select("k", "p_name", "p_size"), "k"))
    return R.flat_paths(text, "doc_id", "text").select("doc_id", "path", "type", "value")


@entry("io_flat_text", "SELECT p_partkey AS doc_id, 'p_name=' || p_name || chr(10) || 'p_size=' || p_size || chr(10) AS text FROM part")
def io_flat_text(spark, d):
    return W.flat_text(D.from_table(parts(spark, d).select("k", "p_name", "p_size"), "k"))


@entry("io_fixed_width", "SELECT p_partkey AS k, rpad(p_brand, 10, ' ') || lpad(CAST(p_size AS VARCHAR), 4, '0') || '      ' AS line FROM part")
def io_fixed_width(spark, d):
    return W.fixed_lines(parts(spark, d).select("k", "p_brand", "p_size"), [W.Place("p_brand", 0, 10), W.Place("p_size", 10, 4, "0", False)], 20)


@entry("io_fixed_width_back", "SELECT p_partkey AS k, p_brand AS brand, CAST(p_size AS BIGINT) AS size, round(p_size / 100.0, 6) AS share FROM part")
def io_fixed_width_back(spark, d):
    lines = io_fixed_width(spark, d)
    out = R.fixed_width(lines, "line", [R.Field("brand", 0, 10), R.Field("size", 10, 4, "integer"), R.Field("share", 10, 4, "number", 2)])
    return out.withColumn("share", F.round("share", 6))


@entry("io_yaml", "SELECT p_partkey AS doc_id, 'p_name' AS path, 'string' AS type, p_name AS value FROM part UNION ALL SELECT p_partkey, 'x.size', 'integer', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'tags[0]', 'string', p_brand FROM part UNION ALL SELECT p_partkey, 'tags[1]', 'string', 'b: c' FROM part")
def io_yaml(spark, d):
    p = parts(spark, d).select("k", "p_name", F.struct(F.col("p_size").alias("size")).alias("x"), F.array("p_brand", F.lit("b: c")).alias("tags"))
    return R.yaml_paths(W.yaml_text(p, ["p_name", "x", "tags"]), "k", "text").select("doc_id", "path", "type", "value")


@entry("io_notation", "SELECT p_partkey AS doc_id, 'p_name' AS path, 'string' AS type, p_name || '\"' AS value FROM part UNION ALL SELECT p_partkey, 'p_size', 'integer', CAST(p_size AS VARCHAR) FROM part")
def io_notation(spark, d):
    p = parts(spark, d).select("k", F.concat("p_name", F.lit('"')).alias("p_name"), "p_size")
    return R.notation_paths(W.notation_text(D.from_table(p, "k")), "doc_id", "text").select("doc_id", "path", "type", "value")


@entry("io_records", "SELECT 'H' AS record_type, count(*) AS n, sum(n_nationkey) AS s FROM nation UNION ALL SELECT 'D', count(*), sum(p_partkey) FROM part")
def io_records(spark, d):
    heads = table(spark, d, "nation").select(F.concat(F.lit("H"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0")).alias("line"))
    lines = heads.unionByName(parts(spark, d).select(F.concat(F.lit("D"), F.lpad(F.col("k").cast("string"), 8, "0")).alias("line")))
    lines = lines.unionByName(spark.sql("SELECT 'X00000001' AS line"))
    by_type, _ = R.route(lines, R.discriminator("line", "position"), ["H", "D"])
    out = [R.fixed_width(df, "line", [R.Field("id", 1, 8, "integer")]).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")) for df in by_type.values()]
    return out[0].unionByName(out[1])


@entry("io_infer", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' ELSE 'null' END AS type FROM part")
def io_infer(spark, d):
    k = F.col("k")
    text = F.when(k % 4 == 0, F.lit("12")).when(k % 4 == 1, F.lit("1.5e3")).when(k % 4 == 2, F.lit("TRUE")).otherwise(F.lit(""))
    return parts(spark, d).select("k", R.inferred(text)["type"].alias("type"))


_FORMATS = {
    "email": ["a@b.co", "ab.co"], "url": ["https://x", "ftp://x"], "ipv4": ["10.0.255.1", "10.01.2.3"], "ipv6": ["fe80::1", "1::2::3"], "date": ["2024-02-30", "24-02-03"],
    "time": ["23:59:59.5Z", "24:00:00"], "hostname": ["a-b.com", "-a.com"], "phone": ["+1 (555) 010-99", "12x"], "zip": ["12345-6789", "1234"], "vin": ["1HGCM82633A004352", "1HGCM82633A00435O"],
    "creditcard": ["4111 1111 1111 1111", "4111111111111112"], "currency-code": ["EUR", "XXQ"], "state-us": ["CA", "ZZ"], "ssn": ["123-45-6789", "000-45-6789"], "isin": ["US0378331005", "U10378331005"], "uuid": ["123e4567-e89b-12d3-a456-426614174000", "123e4567"],
}


@entry("val_formats", " UNION ALL ".join(f"SELECT '{n}' AS name, true AS good, false AS bad" for n in _FORMATS))
def val_formats(spark, d):
    rows = spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, '{a}' AS a, '{b}' AS b" for n, (a, b) in _FORMATS.items()))
    good = bad = F.lit(None).cast("boolean")
    for n in _FORMATS:
        good, bad = F.when(F.col("name") == n, passes(F.col("a"), n)).otherwise(good), F.when(F.col("name") == n, passes(F.col("b"), n)).otherwise(bad)
    return rows.select("name", good.alias("good"), bad.alias("bad"))


def _padded(n: int, head: str = "", fill: str = "0") -> str:
    return f"concat('{head}', lpad(s, {n}, '{fill}'))"


def _among(*values: str) -> str:
    return f"element_at(array({', '.join(map(repr, values))}), i)"


_STAMP = ("concat('2024-02-03T', h, ':00:00Z')", "concat('2024-02-03 ', h, ':00:00Z')")
_DAY = ("concat('2024-01-', h)", "concat('24-01-', h)")
_CARD = (_among("4111 1111 1111 1111", "5500005555555559", "4012888888881881"), _among("4111111111111112", "5500005555555558", "123"))
_BANK = ("concat('DEUTDEFF', if(i = 1, '', lpad(i, 3, '0')))", "concat('DEUTDE', i)")
#: By format: what passes and what doesn't, over a key as s, its last two digits as h (00 to 23) and its rest by three as i.
_MADE = {
    "email": ("concat('u', s, '@b.co')", "concat('u', s, 'b.co')"), "url": ("concat('https://x/', s)", "concat('ftp://x/', s)"), "uuid": (_padded(12, "123e4567-e89b-12d3-a456-"), _padded(12, "123e4567-e89b-02d3-a456-")),
    "ipv4": ("concat('10.0.', h + 0, '.1')", "concat('10.0.', 256 + h, '.1')"), "ipv6": ("concat('fe80::', i)", "concat('1::', i, '::3')"), "date": _DAY, "date-iso": _DAY, "time": ("concat(h, ':59:59.5Z')", "concat(24 + h, ':00:00')"),
    "timestamp": _STAMP, "datetime": _STAMP, "date-time": _STAMP, "hostname": ("concat('h', s, '.com')", "concat('-h', s, '.com')"), "regex": ("concat('a{', s, '}')", "concat('(a', s)"), "phone": (_padded(7, "+1 (555) "), "concat('x', s)"),
    "zip": ("lpad(right(s, 5), 5, '0')", "concat('12', i)"), "naic": ("lpad(right(s, 5), 5, '0')", "concat('12', i)"), "fein": (_padded(7, "12-"), _padded(6, "123-")), "vin": (_padded(6, "1HGCM82633A"), _padded(6, "1HGCM82633O")),
    "currency-code": (_among("EUR", "USD", "JPY"), "concat('XX', s)"), "country-alpha2": (_among("US", "DE", "FR"), _among("XX", "us", "USA")), "country-alpha3": (_among("USA", "DEU", "FRA"), _among("XXX", "usa", "US")), "state-us": (_among("CA", "NY", "TX"), _among("ZZ", "ca", "CAL")),
    "creditcard": _CARD, "credit-card": _CARD, "uri": ("concat('urn:x:', s)", "concat('1urn', s)"), "iban": (_padded(18, "DE12"), _padded(18, "D212")), "bic": _BANK, "swift": _BANK, "routing": (_padded(9), _padded(8)), "cusip": (_padded(8, "A"), _padded(9, "A")),
    "isin": (_padded(10, "US"), _padded(10, "U1")), "lei": (_padded(20, fill="A"), _padded(19, fill="A")), "npi": (_padded(10, fill="1"), _padded(9, fill="1")), "dea": (_padded(7, "AB"), _padded(8, "A")), "imei": (_padded(15), _padded(14)), "iccid": (_padded(19), _padded(18)),
    "ssn": ("concat('123-45-00', h)", "concat('000-45-00', h)"),
}


@entry("val_formats_all", "SELECT p_partkey AS k, name, p_partkey % 2 = 0 AS ok FROM part, (VALUES " + ", ".join(f"('{n}')" for n in _MADE) + ") AS f(name)")
def val_formats_all(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS k", "cast(p_partkey AS string) AS s", "lpad(cast(p_partkey % 23 + 1 AS string), 2, '0') AS h", "cast(p_partkey % 3 + 1 AS int) AS i")
    texts = p.select("k", *(F.expr(f"if(k % 2 = 0, {good}, {bad})").alias(n) for n, (good, bad) in _MADE.items()))
    told = F.array(*(F.struct(F.lit(n).alias("name"), passes(F.col(f"`{n}`"), n).alias("ok")) for n in _MADE))
    return texts.select("k", F.explode(told).alias("x")).select("k", "x.name", "x.ok")


@entry(
    "io_xml_elements",
    """SELECT p_partkey AS k, '<p:part xmlns:p="urn:p" xmlns="urn:x" id="' || p_partkey || '"><p_name>' || p_name || ' &amp; &lt;' || '</p_name><note><![CDATA[a<b & ' || p_brand || ']]></note><size type="integer">' || p_size || '</size>' ||
    CASE WHEN p_size > 25 THEN '<tag>x</tag><tag>' || p_type || '</tag>' ELSE '' END || '</p:part>' AS line FROM part""",
)
def io_xml_elements(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("@id"), F.concat("p_name", F.lit(" & <")).alias("p_name"), F.concat(F.lit("a<b & "), "p_brand").alias("note"), F.col("p_size").alias("size"), F.when(F.col("p_size") > 25, F.array(F.lit("x"), "p_type")).alias("tag"))
    return W.xml_elements(p, ["@id", "p_name", "note", "size", "tag"], "p:part", namespaces={"p": "urn:p", "": "urn:x"}, cdata=["note"], hint="type")


@entry("io_xml_file", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def io_xml_file(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("@id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_partkey") % 4).alias("g"))
    folder = _documents(spark, W.xml_lines(p, ["@id", "name", "size"], "part"), "<rows>", "", "</rows>")
    back = R.read_xml(spark, folder, "part", "`@id` string, name string, size string")
    return back.select(F.col("@id").alias("id"), "name", "size")


def _documents(spark, lines, begin, between, end):
    """Lines by group as one document a file; the folder's path."""
    folder = fresh_folder(spark, "documents")
    whole = lines.groupBy("g").agg(F.concat(F.lit(begin), F.array_join(F.collect_list("line"), between), F.lit(end)).alias("text"))
    whole.write.partitionBy("g").text(folder)
    return folder


@entry("io_json_file", "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def io_json_file(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_partkey") % 4).alias("g"))
    folder = _documents(spark, W.json_lines(p, ["id", "name", "size"], pretty=True), "[", ",", "]")
    return R.read_json(spark, folder, "id bigint, name string, size int").select("id", "name", "size")


@entry("io_csv_file", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ',\"q\"' AS name, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def io_csv_file(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(',"q"')).alias("name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    folder = fresh_folder(spark, "csv")
    W.write_csv(p, folder)
    return R.read_csv(spark, folder)


@entry("io_dump", "SELECT 'n_name' AS path, 'string' AS type, n_name AS value FROM nation UNION ALL SELECT 'n_regionkey', 'integer', CAST(n_regionkey AS VARCHAR) FROM nation")
def io_dump(spark, d):
    folder = fresh_folder(spark, "notation")
    W.dump(D.from_table(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey"), folder)
    return R.notation_paths(R.read_texts(spark, f"{folder}/*"), "doc_id", "text").select("path", "type", "value")


def _streamed(spark, d, name, query):
    """What a query gives over a table read as a stream to its end, through files."""
    path = f"{d}/{name}.parquet"
    # As a pattern, since a stream's path that is no pattern must be a folder, and the table may be a file.
    stream = prepare(spark).readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/{name}.parque[t]")
    folder = fresh_folder(spark, "stream")
    job = query(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@entry("stream_plan", "SELECT event_id, upper(event_type) AS kind, value * 2 AS twice FROM events WHERE value > 50")
def stream_plan(spark, d):
    plan = parse_transform('{out}\n_if = "@value > 50"\nkind = %upper @event_type\ntwice = %multiply @value ##2\n')
    return _streamed(spark, d, "events", lambda stream: segments(plan, stream, "event_id")["out"])


@entry(
    "stream_windows",
    "SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, CAST(sum(event_id) AS DOUBLE) AS sum, count(*) AS count, CAST(min(event_id) AS DOUBLE) AS min, CAST(max(event_id) AS DOUBLE) AS max FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def stream_windows(spark, d):
    return _streamed(spark, d, "events", lambda stream: windowed_totals(stream, "ts", "1 day", "1 hour", ["event_type"], "event_id").drop("end"))


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items()}
