"""Queries that go through the text form of transforms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans import Stream, parse_transform, run, run_records
from quillspark.queries.sources import table

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str):
    def add(query):
        ENTRIES[name] = (query, sql)
        return query

    return add


def nested(spark, d):
    """A document for each customer: orders, each with its lines, in order; made for loops, not for size."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("lines"))
    orders = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice", "lines"))).alias("orders")
    )
    c = table(spark, d, "customer")
    return c.join(orders, c.c_custkey == orders.o_custkey, "left").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "orders")


def segment(plan: str, source, key: str, name: str):
    return run(parse_transform(plan), source, key).segments[name]


HEAD = '{$}\ndirection = "json->json"\n'


@entry("op_project", "SELECT o_orderkey, o_orderkey AS Id, lower(o_orderstatus) AS Status, o_totalprice AS Price, 'order ' || o_orderkey || '!' AS Label FROM orders")
def op_project(spark, d):
    plan = HEAD + '{out}\nId = @o_orderkey\nStatus = %lower @o_orderstatus\nPrice = @o_totalprice\nLabel = "order ${@o_orderkey}!"\n'
    return segment(plan, table(spark, d, "orders"), "o_orderkey", "out")


@entry("op_where_pred", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 200000")
def op_where(spark, d):
    return segment(HEAD + '{big}\n_if = "@o_totalprice > 200000"\nprice = @o_totalprice\n', table(spark, d, "orders"), "o_orderkey", "big")


@entry(
    "op_if_elif_else",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_totalprice > 150000 THEN 'large' ELSE 'other' END AS band FROM orders",
)
def op_chain(spark, d):
    plan = HEAD + '{a :if %eq @o_orderstatus "F"}\nband = "final"\n{b :elif %gt @o_totalprice ##150000}\nband = "large"\n{c :else}\nband = "other"\n'
    found = run(parse_transform(plan), table(spark, d, "orders"), "o_orderkey").segments
    return found["a"].unionByName(found["b"]).unionByName(found["c"])


@entry("op_nested_verbs", "SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice + p_size END, 6) AS v FROM part")
def op_nested(spark, d):
    plan = HEAD + "{out}\nv = %ifElse %gt @p_size ##25 %multiply @p_retailprice ##2 %add @p_retailprice @p_size\n"
    return segment(plan, table(spark, d, "part"), "p_partkey", "out").select("p_partkey", F.round("v", 6).alias("v"))


@entry("op_expr", "SELECT p_partkey, round(-pow(p_size, 2) + (p_retailprice - 3) / 2 * 4, 4) AS v FROM part")
def op_expr(spark, d):
    return segment(HEAD + '{out}\nv = %expr "-p_size ^ 2 + (p_retailprice - 3) / 2 * 4"\n', table(spark, d, "part"), "p_partkey", "out").select("p_partkey", F.round("v", 4).alias("v"))


_RANKS = '{$table.RANK[code, name, rank]}\n"1-URGENT", "urgent", ##1\n"2-HIGH", "high", ##2\n"3-MEDIUM", "medium", ##3\n'


@entry("op_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' END AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END AS rank FROM orders")
def op_lookup(spark, d):
    plan = HEAD + _RANKS + "{out}\nname = %lookup RANK.name @o_orderpriority\nrank = %lookupDefault RANK.rank @o_orderpriority ##9\n"
    return segment(plan, table(spark, d, "orders"), "o_orderkey", "out")


@entry("op_lookup_reverse", "SELECT k, CASE k % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '3-MEDIUM' END AS code FROM (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region)")
def op_lookup_reverse(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.element_at(F.array(F.lit("urgent"), F.lit("high"), F.lit("medium")), (F.col("r_regionkey") % 3 + 1).cast("int")).alias("n"))
    return segment(HEAD + _RANKS + '{out}\ncode = %lookup RANK.code "name" @n\n', r, "k", "out")


@entry("op_constants_types", "SELECT c_custkey, 1.5 AS rate, CAST(floor(c_acctbal) AS BIGINT) AS whole, upper(left(c_mktsegment, 4)) AS seg, CAST(round_even(c_acctbal, 1) AS DOUBLE) AS bal FROM customer")
def op_constants(spark, d):
    plan = HEAD + "const.rate = #1.5\n{out}\nrate = @$const.rate\nwhole = @c_acctbal :type integer\nseg = @c_mktsegment :upper :maxLen 4\nbal = @c_acctbal :type number :decimals 1\n"
    return segment(plan, table(spark, d, "customer"), "c_custkey", "out")


@entry("op_default_when", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders")
def op_default(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return segment(HEAD + '{out}\nstatus = @s :default "none"\nprice = @o_totalprice :if o_totalprice > 100000\n', o, "o_orderkey", "out")


@entry("op_confidential_mask", "SELECT c_custkey, repeat('*', length(c_name)) AS name, CAST(NULL AS DOUBLE) AS bal FROM customer")
def op_mask(spark, d):
    plan = '{$}\nenforceConfidential = "mask"\n{out}\nname = *@c_name\nbal = @c_acctbal :confidential\n'
    return segment(plan, table(spark, d, "customer"), "c_custkey", "out")


@entry("op_loop", "SELECT o_custkey AS c_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey AS id, o_totalprice AS price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def op_loop(spark, d):
    return segment(HEAD + '{rows[]}\n_loop = "@orders"\ni = @_index\nn = @_length\nid = @.o_orderkey\nprice = @.o_totalprice\n', nested(spark, d), "c_custkey", "rows").drop("_at0")


@entry("op_nested_loop", "SELECT o_custkey AS c_custkey, o_orderkey AS id, l_partkey AS part, round(l_quantity * l_extendedprice, 4) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def op_nested_loop(spark, d):
    plan = HEAD + '{rows[]}\n:loop orders :as o\n:loop .lines :as l\nid = "@o.o_orderkey"\npart = "@l.l_partkey"\nv = %multiply @l.l_quantity @l.l_extendedprice\n'
    return segment(plan, nested(spark, d), "c_custkey", "rows").select("c_custkey", "id", "part", F.round("v", 4).alias("v"))


@entry("op_counter", "SELECT o_custkey AS c_custkey, o_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def op_counter(spark, d):
    plan = HEAD + '{rows[]}\n:loop orders :as o\n:loop .lines :as l\n:counter n\nid = "@o.o_orderkey"\ni = @n\n'
    return segment(plan, nested(spark, d), "c_custkey", "rows").select("c_custkey", "id", "i")


@entry("op_loop_aggregate", "SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def op_loop_aggregate(spark, d):
    plan = HEAD + "{out}\ntotal = %sum %map @orders o_totalprice\nn = %length @orders\n"
    return segment(plan, nested(spark, d), "c_custkey", "out").select("c_custkey", F.round("total", 2).alias("total"), "n")


@entry("op_accumulate", "SELECT o_custkey AS c_custkey, o_orderkey AS id, round(100 + sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def op_accumulate(spark, d):
    plan = HEAD + "{$accumulator}\ntotal = ##100\n{rows[]}\n_loop = \"@orders\"\nid = @.o_orderkey\nrunning = %accumulate total @.o_totalprice\n"
    return segment(plan, nested(spark, d), "c_custkey", "rows").select("c_custkey", "id", F.round("running", 2).alias("running"))


@entry("op_accumulate_final", "SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total, CAST(count(o_orderkey) AS DOUBLE) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def op_accumulate_final(spark, d):
    plan = (
        HEAD + "{$accumulator}\ntotal = ##0\ntotal._persist = true\ncount = ##0\ncount._persist = true\nlast = ~\nlast._persist = true\n"
        '{lines[]}\n_loop = "@orders"\n_ = %accumulate total @.o_totalprice\n_n = %accumulate count "count" ##1\n_l = %set last @.o_orderstatus\n'
        '{out}\ntotal = "@$accumulator.total"\nn = "@$accumulator.count"\nlast = "@$accumulator.last"\n'
    )
    return segment(plan, nested(spark, d), "c_custkey", "out").select("c_custkey", F.round("total", 2).alias("total"), F.col("n").cast("double").alias("n"), "last")


@entry("op_two_pass", "SELECT o_custkey AS c_custkey, o_orderkey AS id, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def op_two_pass(spark, d):
    plan = (
        HEAD + "{$accumulator}\ntotal = ##0\ntotal._persist = true\n"
        '{shares[]}\n_pass = ##2\n_loop = "@orders"\nid = @.o_orderkey\nshare = %divide @.o_totalprice @$accumulator.total\n'
        '{_totals[]}\n_pass = ##1\n_loop = "@orders"\n_ = %accumulate total @.o_totalprice\n'
    )
    return segment(plan, nested(spark, d), "c_custkey", "shares").select("c_custkey", "id", F.round("share", 6).alias("share"))


@entry("op_errors", "SELECT code, path, count(*) AS n FROM (SELECT 'SOURCE_MISSING' AS code, 'status' AS path FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'T013', 'price' FROM orders WHERE o_totalprice > 300000 OR o_totalprice < 1000 UNION ALL SELECT 'T013', 'prio' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) GROUP BY 1, 2")
def op_errors(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    plan = HEAD + '{out}\nstatus = @s :required\nprice = @o_totalprice :range 1000..300000\nprio = @o_orderpriority :enum "1-URGENT,2-HIGH"\n'
    errors = run(parse_transform(plan), o, "o_orderkey").errors
    return errors.groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))


@entry("op_object", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS v FROM nation")
def op_object(spark, d):
    return segment(HEAD + "{out}\nv = :object {name = @n_name, region = @n_regionkey}\n", table(spark, d, "nation"), "n_nationkey", "out").select("n_nationkey", F.to_json("v").alias("v"))


@entry("op_documents", "SELECT c_custkey, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def op_documents(spark, d):
    source = nested(spark, d)
    plan = HEAD + '{head}\nname = @c_name\n{rows[]}\n_loop = "@orders"\nid = @.o_orderkey\n'
    docs = run(parse_transform(plan), source, "c_custkey").documents(source, "c_custkey")
    return docs.select("c_custkey", F.col("head.name").alias("name"), F.coalesce(F.size("rows"), F.lit(0)).cast("bigint").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


def _counts(*found):
    """Errors and warnings by code and path."""
    rows = None
    for what, df in found:
        if df is not None:
            some = df.groupBy("code", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
            rows = some if rows is None else rows.unionByName(some)
    return rows


@entry(
    "op_on_error",
    """SELECT 'error' AS what, 'T005' AS code, 'gone' AS path, count(*) AS n FROM orders UNION ALL SELECT 'error', 'T005', 'must', count(*) FROM orders UNION ALL SELECT 'error', 'SOURCE_MISSING', 'status', count(*) FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'warning', 'T013', 'price', count(*) FROM orders WHERE o_totalprice > 200000 OR o_totalprice < 1000 UNION ALL SELECT 'warning', 'T001', 'odd', count(*) FROM orders""",
)
def op_on_error(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    plan = '{$target}\nonError = "warn"\nonMissing = "fail"\nonValidation = "warn"\n{out}\ngone = @nowhere\nmust = @nowhere :required\nstatus = @s :required\nprice = @o_totalprice :range 1000..200000\nodd = %noverb @s\n'
    found = run(parse_transform(plan), o, "o_orderkey")
    return _counts(("error", found.errors), ("warning", found.warnings))


@entry("op_on_validation_skip", "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 200000 THEN o_totalprice END AS price, CASE WHEN regexp_matches(o_orderpriority, '^[1-3]') THEN o_orderpriority END AS prio FROM orders")
def op_on_validation(spark, d):
    return segment('{$target}\nonValidation = "skip"\n{out}\nprice = @o_totalprice :range 1000..200000\nprio = @o_orderpriority :validate "^[1-3]"\n', table(spark, d, "orders"), "o_orderkey", "out")


@entry(
    "op_directives",
    """SELECT o_orderkey, hex(encode(o_orderstatus)) AS bin, o_custkey * 2 AS twice, CAST(round_even(o_totalprice, 2) AS DECIMAL(38, 2)) AS price, 'USD' AS code, CAST(o_custkey AS VARCHAR) AS ref, 'P' || o_custkey || 'D' AS dur, strftime(o_orderdate, '%H:%M:%S') AS at,
    substr(o_orderpriority, 3, 4) AS part, 'b' || o_custkey AS cell FROM orders""",
)
def op_directives(spark, d):
    key = F.col("o_custkey").cast("string")
    o = table(spark, d, "orders").withColumns({"b": F.base64(F.col("o_orderstatus").cast("binary")), "j": F.concat(F.lit('{"a": ['), key, F.lit(", "), (F.col("o_custkey") * 2).cast("string"), F.lit("]}")), "p": F.concat(F.lit("P"), key, F.lit("D")), "t": F.date_format("o_orderdate", "HH:mm:ss"), "row": F.concat(F.lit("a,b"), key, F.lit(",c"))})
    plan = HEAD + "{out}\nbin = @b :binary\nraw = @j :raw\nprice = @o_totalprice :type currency :currencyCode usd\nref = @o_custkey :reference\ndur = @p :duration\nat = @t :time\npart = @o_orderpriority :pos 2 :len 4\ncell = @row :field 1\n"
    out = segment(plan, o, "o_orderkey", "out")
    code = out.schema["price"].metadata["currency_code"]
    return out.select("o_orderkey", F.hex("bin").alias("bin"), F.expr("try_variant_get(raw, '$.a[1]', 'bigint')").alias("twice"), "price", F.lit(code).alias("code"), "ref", "dur", "at", "part", "cell")


_EVENTS_STREAM = '{$accumulator}\ntotal = ##100\nn = ##0\nmost = ~\nlast = ~\n{rows[]}\nrunning = %accumulate total @user_id\n_n = %accumulate n "count" @user_id\n_m = %accumulate most "max" @user_id\n_l = %set last @event_type :if @user_id != 7\n'


@entry(
    "op_record_accumulate",
    """SELECT event_id, CAST(100 + sum(user_id) OVER w AS DOUBLE) AS running, CAST(count(*) OVER w AS DOUBLE) AS n, CAST(max(user_id) OVER w AS DOUBLE) AS most, last_value(CASE WHEN user_id <> 7 THEN event_type END IGNORE NULLS) OVER w AS last
    FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def op_record_accumulate(spark, d):
    plan = _EVENTS_STREAM + '{seen[]}\nrunning = "@$accumulator.total"\nn = "@$accumulator.n"\nmost = "@$accumulator.most"\nlast = "@$accumulator.last"\n'
    return run(parse_transform(plan), table(spark, d, "events"), "event_id", Stream(("event_id",))).segments["seen"].select("event_id", "running", "n", "most", "last")


@entry("op_record_accumulate_by", "SELECT event_id, CAST(100 + sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM events")
def op_record_accumulate_by(spark, d):
    plan = "{$accumulator}\ntotal = ##100\n{rows}\nrunning = %accumulate total @event_id\n"
    return run(parse_transform(plan), table(spark, d, "events"), "event_id", Stream(("event_id",), ("user_id",))).segments["rows"]


@entry("op_record_state", "SELECT user_id, CAST(100 + sum(event_id) AS DOUBLE) AS total FROM events GROUP BY 1")
def op_record_state(spark, d):
    plan = "{$accumulator}\ntotal = ##100\n{rows}\n_t = %accumulate total @event_id\nid = @event_id\n"
    return run(parse_transform(plan), table(spark, d, "events"), "event_id", Stream(("event_id",), ("user_id",))).state


@entry("op_records", "SELECT record, CAST(sum(id) AS BIGINT) AS ids, count(*) AS n FROM (SELECT 'head' AS record, n_nationkey AS id FROM nation UNION ALL SELECT 'rows', p_partkey FROM part) GROUP BY 1 UNION ALL SELECT 'UNKNOWN_RECORD_TYPE', NULL, count(*) FROM region")
def op_records(spark, d):
    line = lambda kind, name, key: table(spark, d, name).select(F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("k"), F.concat(F.lit(f"{kind},"), F.col(key).cast("string")).alias("line"))
    lines = line("H", "nation", "n_nationkey").unionByName(line("D", "part", "p_partkey")).unionByName(line("X", "region", "r_regionkey"))
    found = run_records(parse_transform('{$}\nsource.discriminator = ":field 0"\n{head}\n_type = "H"\nid = @1 :type integer\n{rows[]}\n_type = "D"\nid = @1 :type integer\n'), lines, "k", "line")
    sums = [df.agg(F.sum("id").alias("ids"), F.count(F.lit(1)).alias("n")).withColumn("record", F.lit(n)) for n, df in found.segments.items()]
    lost = found.errors.groupBy(F.col("code").alias("record")).agg(F.count(F.lit(1)).alias("n")).withColumn("ids", F.lit(None).cast("bigint"))
    return sums[0].unionByName(sums[1]).unionByName(lost)


@entry("op_imports", "SELECT p_partkey, p_size * 3 AS v, CASE p_size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS name FROM part")
def op_imports(spark, d):
    files = {"shared": 'const.times = ##2\nconst.more = ##7\n{$table.PARITY[code, name]}\n"0", "even"\n"1", "odd"\n{extra}\nx = ##1\n'}
    plan = parse_transform(HEAD + "@import shared as s\n@import missing\nconst.times = ##3\n{out}\nv = %multiply @p_size @$const.times\nname = %lookup PARITY.name @parity\n", files.get)
    return run(plan, table(spark, d, "part").withColumn("parity", F.col("p_size") % 2), "p_partkey").segments["out"].withColumn("v", F.col("v").cast("bigint"))


@entry("op_literal_block", "SELECT o_custkey AS c_custkey, unnest(['order ' || o_orderkey, 'status ' || o_orderstatus]) AS line FROM orders")
def op_literal(spark, d):
    plan = HEAD + '{text[]}\n:loop orders :as o\n:literal\n"""\norder ${@o.o_orderkey}\nstatus ${@o.o_orderstatus}\n"""\n'
    return segment(plan, nested(spark, d), "c_custkey", "text").select("c_custkey", "line")


@entry("op_indexed_segments", "SELECT n_nationkey, n_name || '|' || n_regionkey AS v FROM nation")
def op_indexed(spark, d):
    n = table(spark, d, "nation")
    docs = run(parse_transform(HEAD + "{v[1]}\nx = %coerceString @n_regionkey\n{v[0]}\nx = @n_name\n"), n, "n_nationkey").documents(n, "n_nationkey")
    return docs.select("n_nationkey", F.array_join("v.x", "|").alias("v"))


@entry("op_value_rows", "SELECT o_custkey AS c_custkey, o_totalprice * 2 AS value FROM orders")
def op_value_rows(spark, d):
    return segment(HEAD + '{rows[]}\n_loop = "@orders"\n_ = %multiply @.o_totalprice ##2\n', nested(spark, d), "c_custkey", "rows").select("c_custkey", "value")


@entry("op_strict_types", "SELECT p_partkey, CAST(p_size + 1 AS DOUBLE) AS v FROM part")
def op_strict(spark, d):
    return segment("{$}\nstrictTypes = true\n{out}\nv = %add @p_size ##1\n", table(spark, d, "part"), "p_partkey", "out").withColumn("v", F.col("v").cast("double"))


@entry("op_independent_arrays", "SELECT n_nationkey, a.x AS x, b.y AS y FROM nation, (VALUES (1), (2)) AS a(x), (VALUES ('p'), ('q'), ('r')) AS b(y)")
def op_independent(spark, d):
    n = table(spark, d, "nation").withColumns({"xs": F.array(F.struct(F.lit(1).alias("x")), F.struct(F.lit(2).alias("x"))), "ys": F.array(*(F.struct(F.lit(c).alias("y")) for c in "pqr"))})
    return segment(HEAD + '{rows[]}\n:loop xs :as a\n:loop ys :as b\nx = "@a.x"\ny = "@b.y"\n', n, "n_nationkey", "rows").select("n_nationkey", "x", "y")


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items()}
