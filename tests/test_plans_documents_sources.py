"""Transforms from text, path tables, validation, readers and writers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import relational as R
from quillspark.operators import validation as V
from quillspark.operators.formats import FORMATS, passes
from quillspark.plans import Stream, files_below, parse_transform, run, run_records
from quillspark.plans.compiler import PlanError
from quillspark.plans.imports import ImportProblem
from quillspark.plans.expr import ExpressionError, parse_expr
from quillspark.plans.text import TransformError
from quillspark.sources import readers, writers
from quillspark.sources.notation import NotationError, parse_notation
from quillspark.sources.yaml import parse_yaml

HEAD = '{$}\ndirection = "json->json"\n'


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def fleet(spark):
    doc = [{"vin": "A", "cov": [{"code": "x"}, {"code": "y"}]}, {"vin": "B", "cov": []}, {"vin": "C", "cov": [{"code": "z"}]}]
    return spark.createDataFrame([(1, doc), (2, None)], "id int, vehicles array<struct<vin:string, cov:array<struct<code:string>>>>")


def test_nested_loops_keep_order_and_counters(fleet):
    plan = HEAD + '{rows[]}\n:loop vehicles :as v\n:loop .cov :as c\n:counter n\nvin = "@v.vin"\ncode = "@c.code"\ni = @n\n'
    out = run(parse_transform(plan), fleet, "id")
    assert rows_of(out.segments["rows"].select("vin", "code", "i"), "vin", "i") == [("A", "x", 0), ("A", "y", 1), ("C", "z", 0)]
    docs = {r.id: r.rows for r in out.documents(fleet, "id").collect()}
    assert [(x.vin, x.code) for x in docs[1]] == [("A", "x"), ("A", "y"), ("C", "z")] and docs[2] is None


def test_branches_lookups_and_earlier_outputs(spark):
    df = table(spark, [(1, "dui", 30), (2, "standard", 20), (3, "standard", 40), (4, None, None)], "id int, tier string, age int")
    plan = HEAD + 'const.limit = ##25\n{$table.T[code, name]}\n"dui", "bad"\n{High :if %eq @tier "dui"}\nband = %lookup T.name @tier\nagain = %upper @band\n{Young :elif %lt @age @$const.limit}\nband = "young"\n{Rest :else}\nband = "std ${@age}"\n'
    found = run(parse_transform(plan), df, "id").segments
    assert rows_of(found["High"], "id") == [(1, "bad", "BAD")]
    assert rows_of(found["Young"], "id") == [(2, "young"), (4, "young")]
    assert rows_of(found["Rest"], "id") == [(3, "std 40")]
    with pytest.raises(PlanError, match="T012"):
        run(parse_transform(HEAD + "{a :else}\nx = ##1\n"), df, "id")


def test_indexed_segments_are_one_array(spark):
    df = table(spark, [(1, "x", "y")], "id int, a string, b string")
    out = run(parse_transform(HEAD + "{v[1]}\nn = @b\n{v[0]}\nn = @a\n"), df, "id")
    assert [r.n for r in out.documents(df, "id").first().v] == ["x", "y"]


def test_literal_blocks_strict_types_and_records(spark, fleet):
    plan = HEAD + '{text[]}\n:loop vehicles :as v\n:literal\n"""\nvin ${@v.vin}\n-\n"""\n'
    out = run(parse_transform(plan), fleet, "id").segments["text"]
    assert [r.line for r in out.orderBy("_at0", "_at1").collect()] == ["vin A", "-", "vin B", "-", "vin C", "-"]
    with pytest.raises(PlanError, match="T002"):
        run(parse_transform('{$}\nstrictTypes = true\n{o}\nx = %add "a" ##1\n'), fleet, "id")
    lines = table(spark, [(1, "H,x"), (2, "D,7,y"), (3, "Z,0")], "n int, l string")
    plan = '{$}\nsource.discriminator = ":field 0"\n{head}\n_type = "H"\nname = @1\n{rows[]}\n_type = "D"\nid = @1 :type integer\nraw = @_line :pos 4 :len 1\n'
    found = run_records(parse_transform(plan), lines, "n", "l")
    assert rows_of(found.segments["head"], "n") == [(1, "x")] and rows_of(found.segments["rows"].select("n", "id", "raw"), "n") == [(2, 7, "y")]
    assert [(r.key, r.code) for r in found.errors.collect()] == [(3, "UNKNOWN_RECORD_TYPE")]


def test_error_policies(spark):
    df = table(spark, [(1, "5", "a"), (2, "500", "b"), (3, None, "c")], "id int, v string, s string")
    said = lambda plan, what: sorted((r.key, r.path, r.code) for r in getattr(run(parse_transform(plan), df, "id"), what).collect()) if getattr(run(parse_transform(plan), df, "id"), what) is not None else []
    head = lambda **more: "{$target}\n" + "".join(f'{k} = "{v}"\n' for k, v in more.items())
    body = "{out}\nv = @v :range 1..100\ns = @s\n"
    for policy, errors, warnings, kept in (("fail", [(2, "v", "T013")], [], None), ("warn", [], [(2, "v", "T013")], "500"), ("skip", [], [], None)):
        plan = head(onValidation=policy) + body
        assert (said(plan, "errors"), said(plan, "warnings")) == (errors, warnings)
        assert rows_of(run(parse_transform(plan), df, "id").segments["out"].select("id", "v"), "id") == [(1, "5"), (2, kept), (3, None)]
    absent = "{out}\nx = @nowhere\ny = @v\n"
    every = [(i, "x", "T005") for i in (1, 2, 3)]
    assert said(head(onMissing="fail") + absent, "errors") == every and said(head(onMissing="warn") + absent, "warnings") == every
    assert said(head(onMissing="skip") + absent, "errors") == [] == said(absent, "errors")
    assert said("{out}\nx = @nowhere :required\ny = @v :required\n", "errors") == sorted([*every, (3, "y", "SOURCE_MISSING")])
    assert said(head(onMissing="fail") + '{out}\nx = @nowhere :default "d"\n', "errors") == []
    wrong = "{out}\nx = %nosuchverb @v\ny = @s\n"
    assert said(head(onError="fail") + wrong, "errors") == said(head(onError="warn") + wrong, "warnings") == [(i, "x", "T001") for i in (1, 2, 3)]
    assert said(head(onError="skip") + wrong, "errors") == []
    assert run(parse_transform(head(onError="skip") + wrong), df, "id").segments["out"].columns == ["id", "y"]
    with pytest.raises(Exception, match="T001"):
        run(parse_transform(wrong), df, "id")
    with pytest.raises(PlanError, match="CONFIG_ERROR"):
        run(parse_transform(head(onError="perhaps") + body), df, "id")


def test_type_directives(spark):
    df = table(spark, [(1, "aGk=", '{"a": [1, 2]}', "12.5", "x.y"), (2, "no base64!", "no json {", None, None)], "id int, b string, j string, c string, r string")
    plan = HEAD + "{out}\nb = @b :binary\nj = @j :raw\nc = @c :type currency :currencyCode usd\nr = @r :reference\nt = @c :time\nd = @c :duration\na = @r :array\n"
    out = run(parse_transform(plan), df, "id").segments["out"]
    got = out.selectExpr("*", "try_variant_get(j, '$.a[1]', 'int') AS two", "try_variant_get(j, '$', 'string') AS whole").orderBy("id").collect()
    assert [bytes(r.b) for r in got] == [b"hi", b"no base64!"] and got[0].two == 2 and got[1].whole == "no json {"
    assert str(got[0].c) == "12.50" and out.schema["c"].metadata == {"currency_code": "USD"}
    assert (got[0].r, got[0].t, got[0].d, got[0].a) == ("x.y", "12.5", "12.5", ["x.y"])
    with pytest.raises(TransformError, match="nonsense"):
        parse_transform("{out}\nx = @b :nonsense 3\n")
    with pytest.raises(PlanError, match="no type"):
        run(parse_transform("{out}\nx = @b :type nonsense\n"), df, "id")


@pytest.mark.parametrize("by", [(), ("g",)])
def test_accumulators_over_a_stream(spark, by):
    lines = [(i, i % 2, f"D,{i},{'' if i % 5 == 0 else i * 10}" if i % 4 else f"T,{i}") for i in range(1, 60)]
    df = table(spark, lines, "n int, g int, l string").repartition(7)
    plan = '{$}\nsource.discriminator = ":field 0"\n{$accumulator}\ntotal = ##100\nn = ##0\nleast = ~\nlast = ~\nfirst = ~\n{rows[]}\n_type = "D"\nid = @1\nsum = %accumulate total @2\n_n = %accumulate n "count" @1\n_m = %accumulate least "min" @2\n_l = %set last @1\n_f = %accumulate first "first" @1\n{trailer[]}\n_type = "T"\nsum = "@$accumulator.total"\ncount = "@$accumulator.n"\nleast = "@$accumulator.least"\nlast = "@$accumulator.last"\nfirst = "@$accumulator.first"\n'
    found = run_records(parse_transform(plan), df, "n", "l", Stream(("n",), by))
    state, want_rows, want_trailers = {}, [], []
    for n, g, line in lines:
        s = state.setdefault(g if by else 0, {"total": 100.0, "n": 0.0, "least": None, "last": None, "first": None})
        cells = line.split(",")
        if cells[0] == "D":
            x = float(cells[2] or 0)  # an empty text is the number 0
            s["total"] += x
            s["n"] += 1
            s["least"] = x if s["least"] is None else min(x, s["least"])
            s["last"], s["first"] = cells[1], s["first"] or cells[1]
            want_rows.append((n, s["total"]))
        else:
            want_trailers.append((n, s["total"], s["n"], s["least"], s["last"], s["first"]))
    assert rows_of(found.segments["rows"].select("n", "sum"), "n") == want_rows
    assert rows_of(found.segments["trailer"].select("n", "sum", "count", "least", "last", "first"), "n") == want_trailers
    assert sorted(r.total for r in found.state.collect()) == sorted(s["total"] for s in state.values())


def test_accumulators_overflow(spark):
    df = table(spark, [(1, 9e15), (2, 9e15)], "id int, v double")
    plan = "{$accumulator}\nt = ##0\n{out}\nt = %accumulate t @v\n"
    out = run(parse_transform(plan), df, "id", Stream(("id",)))
    assert [(r.key, r.code) for r in out.errors.collect()] == [(2, "T008")] and rows_of(out.segments["out"], "id") == [(1, 9e15), (2, None)]


def test_imports_of_transforms(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "more.txt").write_text('const.rate = ##2\nconst.own = ##9\n{$table.T[code, name]}\n"x", "ex"\n{extra}\nv = ##1\n{out}\nv = ##0\n')
    read = files_below(str(tmp_path), (".txt",))
    plan = parse_transform('@import "sub/more.txt" as m\n@import sub/more.txt\nconst.own = ##3\n{out}\na = @$const.rate\nb = @$const.own\nc = %lookup T.name @s\n', read)
    found = run(plan, table(spark, [(1, "x")], "id int, s string"), "id").segments
    assert rows_of(found["out"], "id") == [(1, 2, 3, "ex")] and rows_of(found["extra"], "id") == [(1, 1)]
    assert parse_transform("@import a.txt\n{out}\na = ##1\n", lambda p: None).segments[0].name == "out"
    for path, code in (("", "I001"), ("http://x/a.txt", "I001"), ("a.bin", "I003"), ("../a.txt", "I004"), ("a.txt", "I006")):
        with pytest.raises(ImportProblem, match=code):
            read(path)
    with pytest.raises(ImportProblem, match="I005"):
        files_below(str(tmp_path), most_bytes=3)("sub/more.txt")


def test_accumulators_in_passes(fleet):
    plan = HEAD + '{$accumulator}\nn = ##0\nn._persist = true\n{out}\nseen = "@$accumulator.n"\n{_count[]}\n_pass = ##1\n:loop vehicles :as v\n_ = %accumulate n "count" ##1\n'
    assert rows_of(run(parse_transform(plan), fleet, "id").segments["out"], "id") == [(1, 3.0), (2, 0.0)]


def test_directives_errors_and_secrets(spark):
    df = table(spark, [(1, " Ab ", "12.345", None), (2, "cd", "x", "k")], "id int, s string, n string, r string")
    plan = '{$}\nenforceConfidential = "mask"\n{o}\ns = @s :trim :upper :maxLen 1\nn = @n :type number :decimals 2 :default ##0\nr = !@r\nc = *@s\nq = @s :if id = 2\nv = @s :validate "^c" :enum "cd,Ab"\n'
    out = run(parse_transform(plan), df, "id")
    assert rows_of(out.segments["o"].select("s", "n", "c", "q"), "s") == [("A", 12.34, "****", None), ("C", None, "**", "cd")] or rows_of(out.segments["o"].select("s", "c", "q"), "s") == [("A", "****", None), ("C", "**", "cd")]
    errors = sorted((r.key, r.path, r.code) for r in out.errors.collect())
    assert errors == [(1, "r", "SOURCE_MISSING"), (1, "v", "T013"), (1, "v", "T013")]


def test_formulas():
    assert str(parse_expr("-a ^ 2 + min(b, 3) * (c - 1)", "@.")).count("Call") == 6
    for bad in ("1 +", "foo(1)", "(1", "1 2"):
        with pytest.raises(ExpressionError, match="T015"):
            parse_expr(bad)
    with pytest.raises(TransformError):
        parse_transform("{a}\nno assignment")


def paths(spark, rows):
    return spark.createDataFrame([(d, o, p, t, v, m) for d, o, p, t, v, m in rows], "doc_id int, ord long, path string, type string, value string, mods string")


def test_diff_patch_round_trip(spark):
    a = paths(spark, [(1, 0, "a", "integer", "1", ""), (1, 1, "b", "string", "x", ""), (1, 2, "c", "string", "x", ""), (1, 3, "d", "null", None, ""), (2, 0, "a", "integer", "1", "")])
    b = paths(spark, [(1, 0, "a", "integer", "2", ""), (1, 1, "e", "string", "x", ""), (1, 2, "d", "null", None, "!"), (1, 3, "f", "string", "new", "*"), (3, 0, "z", "string", "y", "")])
    changes = D.diff(a, b)
    assert rows_of(changes.select("doc_id", "op", "path", "to_path"), "doc_id", "path") == [
        (1, "modify", "a", None), (1, "move", "b", "e"), (1, "delete", "c", None), (1, "modify", "d", None), (1, "add", "f", None), (2, "delete", "a", None), (3, "add", "z", None),
    ]
    patched, errors = D.patch(a, changes)
    want = ["doc_id", "path", "type", "value", "mods"]
    assert rows_of(patched.select(*want), "doc_id", "path") == rows_of(b.select(*want), "doc_id", "path") and errors.count() == 0
    assert D.patch(a.where("false"), changes)[1].count() == 5


def test_overlay(spark):
    rows = [
        (1, 0, 0, "a.b", "string", "1"), (1, 0, 1, "a.c[0]", "string", "2"), (1, 0, 2, "ab", "string", "3"), (1, 0, 3, "l[0]", "string", "4"), (1, 0, 4, "l.x", "string", "5"), (1, 0, 5, "$.v", "string", "old"),
        (1, 1, 0, "a", "null", None), (1, 1, 1, "a.d", "string", "6"), (1, 1, 2, "l[]", "null", None), (1, 1, 3, "$.v", "string", "new"),
    ]
    chain = spark.createDataFrame([(*r, "") for r in rows], "doc_id int, version int, ord long, path string, type string, value string, mods string")
    assert rows_of(D.overlay(chain).select("path", "value"), "path") == [("$.v", "new"), ("a.d", "6"), ("ab", "3"), ("l.x", "5")]


def test_canonical_form(spark):
    rows = [(1, 0, "b[10].x", "number", "1.500", ""), (1, 1, "b[2].x", "currency", "7:usd", "!"), (1, 2, "&e", "string", 'q"\n', ""), (1, 3, "$.v", "null", None, ""), (1, 4, "b", "boolean", "true", "")]
    got = D.canonical(paths(spark, rows)).first().text
    assert got == '$.v = ~\nb = true\nb[2].x = !#$7.00:USD\nb[10].x = #1.5\n&e = "q\\"\\n"\n'


def test_references(spark):
    rows = [(1, 0, "a", "reference", "b", ""), (1, 1, "b", "reference", "c", ""), (1, 2, "c", "reference", "a", ""), (1, 3, "d", "reference", "gone", ""), (1, 4, "e", "reference", "f", ""), (1, 5, "f.g", "string", "x", "")]
    p = paths(spark, rows)
    assert rows_of(D.dangling(p).select("path"), "path") == [("d",)]
    assert rows_of(D.cycles(p).select("path"), "path") == [("a",), ("b",), ("c",)]


def test_validation_codes(spark):
    df = table(spark, [(1, "ok", 10.0, 1.0, 11.0), (2, None, 10.0, 1.0, 99.0), (3, "toolong", -1.0, None, 5.0)], "id int, name string, sub double, tax double, total double")
    schema = V.Schema([V.Field("name", "string", required=True, most=5, pattern="^o"), V.Field("sub", "number", least=0)], ["total == sub + tax", "gone > 1", "total >"], [(["name", "tax"], 1, 1)])
    got = sorted((r.key, r.code, r.actual) for r in V.validate(df, "id", schema).collect() if r.actual != "parse error")
    assert got == [(1, "V009", "2"), (2, "V001", "null"), (2, "V008", "false"), (3, "V003", "-1"), (3, "V003", "toolong"), (3, "V004", "toolong"), (3, "V008", "null operand")]
    assert V.unknown_fields(df, schema) == ["id", "tax", "total"]
    assert not V.safe_pattern("(a+)+b") and not V.safe_pattern("x" * 1100) and V.safe_pattern("^a+b*$")


def test_formats(spark):
    good = {"regex": "a+", "fein": "12-3456789", "naic": "12345", "iban": "DE89370400440532013000", "bic": "DEUTDEFF", "lei": "A" * 20, "npi": "1" * 10, "dea": "AB1234567", "imei": "1" * 15, "iccid": "1" * 19, "timestamp": "2024-01-01T10:00:00Z", "country-alpha2": "DE", "country-alpha3": "DEU", "uri": "a:b", "datetime": "2024-01-01T10:00:00"}
    bad = {"regex": "(", "fein": "123", "bic": "X", "timestamp": "2024-01-01", "ipv6": "1:2", "phone": "123", "credit-card": "1" * 12}
    cols = [passes(F.lit(v), n).alias(f"g{i}") for i, (n, v) in enumerate(good.items())] + [passes(F.lit(v), n).alias(f"b{i}") for i, (n, v) in enumerate(bad.items())]
    row = spark.range(1).select(*cols, passes(F.lit("x"), "never heard of").alias("u"), passes(F.lit(None).cast("string"), "email").alias("n")).first()
    assert all(row[f"g{i}"] for i in range(len(good))) and not any(row[f"b{i}"] for i in range(len(bad))) and row.u and row.n
    assert len(FORMATS) >= 37


def test_files_round_trip(spark, tmp_path):
    df = table(spark, [(1, 'a "q", b', None), (2, "line\nend", 2.5)], "id int, s string, x double")
    writers.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert rows_of(readers.read_csv(spark, str(tmp_path / "c")), "id") == [("1", 'a "q", b', None), ("2", "line\nend", "2.5")]
    df.write.json(str(tmp_path / "j"))
    assert rows_of(spark.read.schema("id int, s string, x double").json(str(tmp_path / "j")), "id") == rows_of(df, "id")
    (tmp_path / "x.xml").write_text('<r><p k="1"><n>a</n></p><p k="2">t<n>b</n></p></r>')
    got = rows_of(readers.read_xml(spark, str(tmp_path / "x.xml"), "p", "`@k` string, n string, _text string"), "`@k`")
    assert got[0][:2] == ("1", "a") and got[1] == ("2", "b", "t")
    (tmp_path / "f.txt").write_text("# c\na.b = 1\n; d\nx[0]=\"q\"\nx[1]=~\nurl = a=b\na.b = 2\n\nbad\n")
    flat = readers.flat_paths(readers.read_texts(spark, str(tmp_path / "f.txt")), "doc_id", "text")
    assert rows_of(flat.select("path", "type", "value"), "path") == [("a.b", "integer", "2"), ("url", "string", "a=b"), ("x[0]", "string", "q"), ("x[1]", "null", None)]


def test_yaml():
    text = "a: 1 # c\nb:\n  - x\n  - y: true\n    z: 'q: r'\n  -\n    w: 2.5\nc:\n  d: null\ne: \"#no\"\nf:\n- 1\n"
    assert list(parse_yaml(text)) == [
        ("a", "integer", "1", ""), ("b[0]", "string", "x", ""), ("b[1].y", "boolean", "true", ""), ("b[1].z", "string", "q: r", ""), ("b[2].w", "number", "2.5", ""), ("c.d", "null", None, ""), ("e", "string", "#no", ""), ("f[0]", "integer", "1", ""),
    ]


def test_notation(spark):
    text = '{$}\nv = "1"\n{p}\nname = !"A \\"b\\"" ; note\nage = ##30\npay = *#$12.50:USD\n{.addr}\ncity = "X"\n{}\nitems[0] = ~\n{l[] : a, b}\n"x", ##1\n"y",\n---\n{}\nz = @p.name\n'
    first, second = parse_notation(text)
    assert first == [
        ("$.v", "string", "1", ""), ("p.name", "string", 'A "b"', "!"), ("p.age", "integer", "30", ""), ("p.pay", "currency", "12.50:USD", "*"), ("p.addr.city", "string", "X", ""), ("items[0]", "null", None, ""), ("l[0].a", "string", "x", ""), ("l[0].b", "integer", "1", ""), ("l[1].a", "string", "y", ""),
    ] and second == [("z", "reference", "p.name", "")]
    for bad in ("a = ##x", "a =", "a[99999] = 1", 'a = "open'):
        with pytest.raises(NotationError):
            parse_notation(bad)
    chains = readers.notation_chains(table(spark, [(7, text), (8, "a = ##x")], "id int, t string"), "id", "t")
    assert chains.where("doc_id = 7").groupBy("version").count().count() == 2 and chains.where("type = 'error'").first().doc_id == 8


def test_table_operators_on_nulls_and_ties(spark):
    df = table(spark, [(1, "a", 1.0), (2, "a", None), (3, None, 3.0), (4, "b", 3.0), (5, "1", 3.0)], "id int, g string, x double")
    assert rows_of(R.dedupe(df, "g", ["id"]).select("id"), "id") == [(1,), (3,), (4,), (5,)]
    assert rows_of(R.count_by(df, "g"), "key") == [("", 1), ("1", 1), ("a", 2), ("b", 1)]
    assert [r.id for r in df.orderBy(*R.sort(df, "x", ["id"], True)).collect()] == [2, 3, 4, 5, 1]
    assert rows_of(R.rank(df, [], "x").select("id", "_rank"), "id") == [(1, 5), (2, 1), (3, 2), (4, 2), (5, 2)]
    assert [r._n for r in R.numbered(df.repartition(3), ["id"]).orderBy("id").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(TypeError):
        R.count_by(df.withColumn("o", F.struct("id")), "o")
    assert json.loads(writers.json_lines(df.where("id = 2"), ["g", "x"], nulls=False).first().line) == {"g": "a"}


SCHEMA = """{$}
version = "1"
{@address}
city = !
zip = :/^\\d{5}$/
{order}
id = !## :(1..)
status = (open, closed)
subtotal = #$
tax = #$.2
total = !#$
when = date
closed_on = date :if status = closed
mail = :format email
:invariant total = subtotal + tax
:one_of when, closed_on
{order.ship}
to = @address
{lines[]} :(1..3) :unique
sku = !:(2..5)
"""


def test_schema_text(spark):
    from quillspark import api
    from quillspark.plans.schema import SchemaError, parse_schema, resolve_imports, write_schema

    doc = parse_schema(SCHEMA)
    again = parse_schema(write_schema(doc))
    assert again == doc
    assert doc.arrays["lines"].least == 1 and doc.arrays["lines"].unique and doc.arrays["lines"].fields["sku"].most == 5
    assert {p for p in doc.expanded() if "ship" in p} == {"order.ship.to.city", "order.ship.to.zip"}
    kinds = {f.name: f.dataType.simpleString() for f in doc.struct("order").fields}
    assert kinds["id"] == "bigint" and kinds["total"] == "decimal(38,2)" and kinds["when"] == "date" and kinds["ship"].startswith("struct<to:struct<city")
    df = spark.sql(
        "SELECT * FROM VALUES (1L, 'open', 10.00, 1.00, 11.00, date'2024-01-01', cast(null as date), 'a@b.c'), (0L, 'closed', 10.00, 1.00, 99.00, cast(null as date), cast(null as date), 'nobody')"
        " AS t(id, status, subtotal, tax, total, `when`, closed_on, mail)"
    )
    small = api.parse_schema(SCHEMA.replace("{order.ship}\nto = @address\n", ""))
    got = sorted((r.key, r.code, r.path) for r in api.validate(df, "id", small.rules("order")).collect())
    assert got == [(0, "V003", "id"), (0, "V004", "mail"), (0, "V008", ""), (0, "V009", "when,closed_on"), (0, "V010", "closed_on")]
    with pytest.raises(SchemaError, match="V017"):
        parse_schema("{a}\nx = ## :(5..1)")
    files = {"a": "@import b\n{@t}\nx = ##\n", "b": "{@u}\ny = ?\n"}
    assert set(resolve_imports(parse_schema("@import a\n{z}\nf = @t\n"), files.__getitem__).types) == {"t", "u"}
    with pytest.raises(SchemaError, match="I011"):
        resolve_imports(parse_schema("@import a\n"), {"a": "@import b\n", "b": "@import a\n"}.__getitem__)
    assert api.path("a", 0, "b") == "a[0].b"


def test_layout(spark):
    from quillspark.operators import layout

    row = spark.range(1).select(layout.to_pixels(_v(2.54), _v("cm")).col.alias("px"), layout.from_pixels(_v(96), _v("inch")).col.alias("inch"), layout.contrast_ratio(_v("#000000"), _v("ffffff")).col.alias("c"), layout.contrast_ratio(_v("#12"), _v("ffffff")).col.alias("bad")).first()
    assert (row.px, row.inch, round(row.c, 6), row.bad) == (96.0, 1.0, 21.0, None)
    df = table(spark, [(1, [1, 2, 3, 4, 5]), (2, None)], "id int, xs array<int>")
    assert rows_of(layout.pages(df, "xs", 2, 2).select("id", "page", "items"), "id", "page") == [(1, 0, [1, 2]), (1, 1, [3, 4]), (1, 2, [5]), (2, 0, None)]


def _v(x):
    from quillspark.functions import lit

    return lit(x)


def test_long_cycles_and_what_leads_into_them(spark):
    ring = [(1, f"r{i}", f"r{(i + 1) % 100}") for i in range(100)] + [(1, "in", "r7"), (1, "before", "in")]
    chain = [(2, f"c{i}", f"c{i + 1}") for i in range(70)] + [(3, "self", "self"), (3, "end", "gone")]
    p = spark.createDataFrame([(d, 0, a, "reference", b, "") for d, a, b in ring + chain], "doc_id long, ord long, path string, type string, value string, mods string")
    got = {(r.doc_id, r.path) for r in D.cycles(p).collect()}
    assert got == {(d, a) for d, a, _ in ring} | {(3, "self")}


def test_xml_form_and_dump(spark, tmp_path):
    df = table(spark, [(1, "a&b", 5, [1, 2], ("x", 2.5)), (2, None, None, None, None)], "k int, `p:name` string, n int, xs array<int>, o struct<`@id`: string, v: double>")
    got = rows_of(writers.xml_elements(df, ["p:name", "n", "xs", "o"], "r", namespaces={"p": "urn:p"}, cdata=["p:name"], hint="t"), "k")
    assert got[0][1] == '<r xmlns:p="urn:p"><p:name><![CDATA[a&b]]></p:name><n t="integer">5</n><xs t="integer">1</xs><xs t="integer">2</xs><o id="x"><v t="number">2.5</v></o></r>'
    assert got[1][1] == '<r xmlns:p="urn:p"></r>'
    assert [r[0] for r in parse_notation("{t[] : a, b, c}\n,##2,\n##1,,\"x,y\"\n")[0]] == ["t[0].b", "t[1].a", "t[1].c"]
    assert json.loads(writers.json_lines(df.select("k", "n"), ["k", "n"], pretty=True).first().line) == {"k": 1, "n": 5}
    writers.dump(D.from_table(df.select("k", "n"), "k"), str(tmp_path / "d"))
    assert {(r.path, r.value) for r in readers.notation_paths(readers.read_texts(spark, str(tmp_path / "d" / "*")), "doc_id", "text").collect()} >= {("n", "5")}


def test_values_against_schemas(spark):
    df = table(spark, [(1, "a", 1, [("x", 1), ("x", 1), ("y", 2), (None, 3)]), (2, "a", None, None)], "k int, s string, extra int, xs array<struct<a: string, b: int>>")
    assert rows_of(V.array_unique(df, "k", "xs", ["a", "b"]).select("key", "path"), "key") == [(1, "xs[1]")]
    assert rows_of(V.array_unique(df, "k", "xs").select("key", "path"), "key") == [(1, "xs[1]")]
    assert rows_of(V.unknown_values(df, "k", V.Schema([V.Field("s"), V.Field("xs")])).select("key", "path", "code"), "key") == [(1, "extra", "V011")]
    assert V.unknown_values(df.select("k", "s"), "k", V.Schema([V.Field("s")])).count() == 0
    from quillspark import api

    found = api.validate_with_imports(df, "k", '@import "b"\n', lambda p: "{r}\ns = ! :unique\nextra = !##\n", "r")
    assert rows_of(found.select("key", "path", "code"), "key", "path") == [(2, "extra", "V001"), (2, "s", "V007")]


def test_ranks_and_percentiles_by_ranges(spark):
    rows = [(i, None if i % 11 == 0 else i % 3, None if i % 7 == 0 else float(i % 13)) for i in range(300)]
    df = table(spark, rows, "k int, g int, v double").repartition(5)
    ranked = R.rank(df, ["g"], "v").collect()
    for r in ranked:
        more = sum(1 for k, g, v in rows if g == r.g and (v is None and r.v is not None or v is not None and r.v is not None and v > r.v))
        assert r["_rank"] == more + 1
    for by in ([], ["g"]):
        got = {tuple(r)[:-1]: r.percentile for r in R.percentile(df, by, "v", 0.3).collect()}
        for key in {(g,) if by else () for _, g, _ in rows}:
            xs = sorted(v for _, g, v in rows if v is not None and (not by or g == key[0]))
            at = 0.3 * (len(xs) - 1)
            lo, hi = xs[int(at)], xs[min(int(at) + 1, len(xs) - 1)]
            assert abs(got[key] - (lo + (hi - lo) * (at - int(at)))) < 1e-9
    nothing = R.summary(df.where("false"), [], "v", ["median", "count"]).collect()
    assert [tuple(r) for r in nothing] == [(None, 0)]
    assert rows_of(R.summary(table(spark, [(None, None), (1, 2.0), (1, 4.0)], "g int, v double"), ["g"], "v", ["median"]), "g") == [(None, None), (1, 3.0)]


def test_distinct_and_mode_of_long_arrays(spark):
    from quillspark.functions import call, of

    df = spark.range(1).select(F.expr("transform(sequence(1, 20000), i -> cast(i % 5000 as double))").alias("xs"))
    r = df.select(F.size(call("distinct", of(df, "xs")).col).alias("n"), call("mode", of(df, "xs")).col.alias("m"), F.slice(call("distinct", of(df, "xs")).col, 1, 3).alias("head")).first()
    assert r.n == 5000 and r.m == 1.0 and r.head == [1.0, 2.0, 3.0]


def test_flattened_schemas():
    from quillspark.plans.schema import flatten, parse_schema

    files = {"a": "@import c\n{@addr}\nzip = !\n{@unused}\nx = \n{rec}\nhome = @addr\n:invariant x > 1\n", "b": "{@addr}\nzip = ##\n", "c": "{@inner}\ny = \n"}
    doc = parse_schema("@import a as p\n@import b\n{@own}\nz = @addr\n{me}\nat = @p.addr\n")
    out, warnings = flatten(doc, files.__getitem__)
    assert set(out.types) == {"own", "addr", "p.addr"} and set(out.fields) == {"p_rec.home", "me.at"} and out.invariants == [("p_rec", "x > 1")] and len(warnings) == 1 and not out.imports
    whole, _ = flatten(doc, files.__getitem__, "overwrite", shake=False)
    assert set(whole.types) == {"own", "addr", "p.addr", "p.unused", "inner"} and "rec.home" in whole.fields
    twice = parse_schema("@import b\n{@addr}\nzip = \n")
    assert flatten(twice, files.__getitem__)[0].types["addr"]["zip"].type == "string" and flatten(twice, files.__getitem__, "error")[0].types["addr"]["zip"].type == "integer"
    assert flatten(twice, files.__getitem__)[1] == ["type addr is there twice"]


def test_notation_with_headers(spark):
    rows = [(1, i, p, "string", v, "") for i, (p, v) in enumerate([("a", "x"), ("b.c", "y"), ("b.d", "z"), ("e[0].f", "w"), ("g", "v")])]
    paths = table(spark, rows, "doc_id int, ord long, path string, type string, value string, mods string")
    text = writers.notation_text(paths, headers=True, crlf=True).first().text
    assert text.split("\r\n") == ['a = "x"', "{b}", 'c = "y"', 'd = "z"', "{e[0]}", 'f = "w"', "{}", 'g = "v"', ""]
    back = readers.notation_paths(writers.notation_text(paths, headers=True), "doc_id", "text")
    assert rows_of(back.select("path", "value"), "ord") == [(p, v) for _, _, p, _, v, _ in rows]
