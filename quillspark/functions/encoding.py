"""Encodings, digests, JSON and URLs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import LONG, STRING, S, Value, constant, field, shown, text
from quillspark.functions.registry import null, verb


def _simple(name: str, build):
    @verb(name)
    def make(v, *_):
        return text(build(shown(v)))


def _base64(s):
    return F.base64(F.encode(s, "UTF-8"))


def _from_base64(s):
    bare = F.regexp_replace(F.translate(s, "-_", "+/"), "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    return F.when(bare.rlike("^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1), F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def percent(s):
    """Percent-encoding with space as %20; letters, digits and ``_.-~`` stay."""
    x = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(x, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _form(s):
    """Form encoding: as percent-encoding, with space as +."""
    return F.replace(percent(s), F.lit("%20"), F.lit("+"))


_simple("base64Encode", _base64)
_simple("base64Decode", _from_base64)
_simple("base64urlEncode", lambda s: F.regexp_replace(F.translate(_base64(s), "+/", "-_"), "=+$", ""))
_simple("base64urlDecode", _from_base64)
_simple("urlEncode", percent)
_simple("urlDecode", lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
_simple("hexEncode", lambda s: F.lower(F.hex(F.encode(s, "UTF-8"))))
_simple("hexDecode", lambda s: F.when(s.rlike("^(?:[0-9a-fA-F]{2})*$"), F.try_validate_utf8(F.unhex(s).cast("string"))))
_simple("sha256", lambda s: F.sha2(F.encode(s, "UTF-8"), 256))
_simple("sha512", lambda s: F.sha2(F.encode(s, "UTF-8"), 512))
_simple("sha1", lambda s: F.sha1(F.encode(s, "UTF-8")))
_simple("md5", lambda s: F.md5(F.encode(s, "UTF-8")))
_simple("crc32", lambda s: F.lower(F.lpad(F.hex(F.crc32(F.encode(s, "UTF-8"))), 8, "0")))


@verb("hmac", least=2)
def hmac(message, key, algorithm=None):
    """A keyed digest, composed of two plain ones over the padded key."""
    name = str(constant(algorithm, "sha256")).lower() if algorithm is not None else "sha256"
    plain = {"sha256": (64, lambda b: F.sha2(b, 256)), "sha512": (128, lambda b: F.sha2(b, 512)), "sha1": (64, F.sha1), "md5": (64, F.md5)}.get(name)
    if plain is None:
        return null()
    size, digest = plain
    raw = F.encode(S(key), "UTF-8")
    short = F.when(F.length(raw) > size, F.unhex(digest(raw))).otherwise(raw)
    padded = F.rpad(F.hex(short), 2 * size, "0")

    def masked(byte: int):
        pairs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substr(padded, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
        return F.unhex(F.array_join(F.transform(pairs, lambda b: F.lpad(F.hex(b.bitwiseXOR(F.lit(byte))), 2, "0")), ""))

    inner = F.unhex(digest(F.concat(masked(0x36), F.encode(S(message), "UTF-8"))))
    return text(F.when(message.col.isNotNull(), digest(F.concat(masked(0x5C), inner))))


def to_json(v: Value):
    """A value as compact JSON, keys in their order, nulls written."""
    if v.is_array or v.is_object:
        return F.to_json(v.col, {"ignoreNullFields": "false"})
    if isinstance(v.type, T.VariantType):
        return F.to_json(v.col)
    if v.is_string or v.is_temporal:
        quoted = F.to_json(F.array(shown(v)), {"ignoreNullFields": "false"})
        return F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return F.coalesce(shown(v), F.lit("null"))


@verb("jsonEncode")
def json_encode(v):
    whole = to_json(v)
    if v.is_string:
        return text(F.substr(whole, F.lit(2), F.length(whole) - 2))
    return text(whole)


@verb("jsonDecode")
def json_decode(v):
    s = F.trim(S(v))
    quoted = F.concat(F.lit('"'), S(v), F.lit('"'))
    return Value(F.when(s.rlike(r"^(?s)[\[{].*[\]}]$"), F.try_parse_json(s)).otherwise(F.coalesce(F.try_parse_json(quoted), F.try_parse_json(to_json(v)))), T.VariantType())


@verb("jsonPath", least=2)
def json_path(v, path):
    p = str(constant(path, ""))
    steps = re.findall(r"\.?([^.\[\]$]+)|\[(\d+)\]", p)
    if v.is_string:
        at = "$" + "".join(f"[{i}]" if i else f"['{n}']" for n, i in steps)
        return text(F.get_json_object(v.col, at))
    for name, i in steps:
        v = Value(F.get(v.col, F.lit(int(i))), v.item) if i and v.is_array else field(v, name) if name else null()
    return v


_URL = T.StructType([T.StructField(n, T.StringType() if n != "port" else LONG) if n != "query" else T.StructField(n, T.MapType(STRING, STRING)) for n in ("scheme", "host", "port", "path", "query", "fragment")])


def _query_map(raw):
    """Names to values, decoded; the last of a name wins, names in order."""
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.when(p.contains("="), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).otherwise(F.lit(""))).alias("value")))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_from_entries(pairs))))


@verb("parseUrl")
def parse_url(v):
    s = shown(v)
    part = lambda i: F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i)
    port = F.nullif(part(3), F.lit("")).try_cast("bigint")
    return Value(
        F.when(
            (part(1) != "") & (part(2) != "") & F.coalesce(port <= 65535, F.lit(True)),
            F.struct(F.lower(part(1)).alias("scheme"), F.lower(F.translate(part(2), "[]", "")).alias("host"), port.alias("port"), part(4).alias("path"), _query_map(part(5)).alias("query"), part(6).alias("fragment")),
        ),
        _URL,
    )


@verb("parseQuery")
def parse_query(v):
    s = shown(v)
    return Value(_query_map(F.when(s.startswith("?"), F.substr(s, F.lit(2))).otherwise(s)), T.MapType(STRING, STRING))


@verb("buildQuery")
def build_query(v):
    if isinstance(v.type, T.MapType):
        kind = v.type.valueType
        entries = F.array_sort(F.map_entries(F.map_filter(v.col, lambda _, x: x.isNotNull())))
        return text(F.array_join(F.transform(entries, lambda e: F.concat(_form(e["key"]), F.lit("="), _form(S(Value(e["value"], kind))))), "&"))
    if isinstance(v.type, T.StructType):
        parts = [F.when(f.col.isNotNull(), F.concat(_form(F.lit(n)), F.lit("="), _form(S(f)))) for n, f in sorted((n, field(v, n)) for n in v.type.fieldNames())] if v.type.fields else []
        return text(F.when(v.col.isNotNull(), F.concat_ws("&", *parts)))
    return null()


@verb("buildUrl")
def build_url(v):
    if not v.is_object:
        return null()
    get = lambda n: S(field(v, n))
    path = get("path")
    out = F.concat(get("scheme"), F.lit("://"), get("host"), F.when(get("port") != "", F.concat(F.lit(":"), get("port"))).otherwise(F.lit("")), F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit("")), path)
    query = field(v, "query")
    if query.is_object:
        q = S(build_query(query))
        out = F.concat(out, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    out = F.concat(out, F.when(get("fragment") != "", F.concat(F.lit("#"), get("fragment"))).otherwise(F.lit("")))
    return text(F.when((get("scheme") != "") & (get("host") != ""), out))


def stable_json(v: Value):
    """JSON with sorted keys, at every depth."""
    if isinstance(v.type, T.StructType):
        parts = []
        for n in sorted(v.type.fieldNames()):
            parts += [F.lit(("," if parts else "") + '"' + n.replace("\\", "\\\\").replace('"', '\\"') + '":'), F.coalesce(stable_json(field(v, n)), F.lit("null"))]
        return F.coalesce(F.when(v.col.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}"))), F.lit("null"))
    if isinstance(v.type, T.MapType):
        kind = v.type.valueType
        body = F.array_join(F.transform(F.array_sort(F.map_keys(v.col)), lambda k: F.concat(to_json(Value(k, STRING)), F.lit(":"), stable_json(Value(F.try_element_at(v.col, k), kind)))), ",")
        return F.coalesce(F.concat(F.lit("{"), body, F.lit("}")), F.lit("null"))
    if v.is_array:
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: stable_json(Value(x, v.item))), ","), F.lit("]")), F.lit("null"))
    if v.is_string or v.is_temporal:
        return F.when(v.col.isNull(), F.lit("null")).otherwise(to_json(v))
    return F.coalesce(shown(v), F.lit("null"))


@verb("stableStringify")
def stable_stringify(v):
    return text(stable_json(v))


@verb("canonicalHash")
def canonical_hash(v):
    return text(F.sha2(F.encode(stable_json(v), "UTF-8"), 256))
