"""String verbs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import STRING, N, S, Value, array, boolean, constant, field, integer, shown, text, whole
from quillspark.functions.registry import null, verb

SPACE = r"(?U)\s"  # all white space of Unicode, as the trimming verbs take it
MOST_REPEATS, LONGEST_DISTANCE, LONGEST_PATTERN, LONGEST_MATCHED = 10_000, 1_000, 256, 100_000


def _simple(name: str, build):
    @verb(name)
    def make(v, *_):
        return text(build(shown(v)))


_simple("upper", F.upper)
_simple("lower", F.lower)
_simple("trim", lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
_simple("trimLeft", lambda s: F.regexp_replace(s, rf"^{SPACE}+", ""))
_simple("trimRight", lambda s: F.regexp_replace(s, rf"{SPACE}+$", ""))
_simple("capitalize", lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2)))))
_simple("titleCase", lambda s: F.array_join(F.transform(F.split(F.regexp_replace(s, rf"{SPACE}+", " "), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " "))
_simple("reverseString", F.reverse)
_simple("normalizeSpace", lambda s: F.trim(F.regexp_replace(s, rf"{SPACE}+", " ")))
_simple("stripTags", lambda s: F.regexp_replace(s, "<[^>]*>", ""))
_simple("clean", lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), "\u00a0", " "), rf"{SPACE}+", " ")))


def _replaced(s, pairs):
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


_simple("escapeHtml", lambda s: _replaced(s, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))))
_simple("escapeXml", lambda s: _replaced(s, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))))


@verb("contains", least=2)
def contains(s, sub):
    return boolean(S(s).contains(S(sub)))


@verb("startsWith", least=2)
def starts_with(s, p):
    return boolean(S(s).startswith(S(p)))


@verb("endsWith", least=2)
def ends_with(s, p):
    return boolean(S(s).endswith(S(p)))


@verb("replace", least=3)
def replace(s, old, new):
    x = shown(s)
    if old.is_const and old.const not in (None, ""):
        return text(F.replace(x, S(old), S(new)))
    # Between all characters and at both ends, where the old text is empty.
    between = F.concat(S(new), F.array_join(F.transform(F.split(x, ""), lambda c: F.concat(c, S(new))), ""))
    return text(F.when(S(old) == "", F.when(x == "", S(new)).otherwise(between)).otherwise(F.replace(x, S(old), S(new))))


def java_pattern(pattern: str) -> str | None:
    """The pattern in Java's dialect; None if it is too long or no pattern."""
    if len(pattern) > LONGEST_PATTERN:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


@verb("replaceRegex", least=3)
def replace_regex(s, pattern, new):
    p = java_pattern(str(constant(pattern, "")))
    if p is None:
        return null()
    to = re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: "$" + (f"{{{m[1]}}}" if m[1] and not m[1].isdigit() else m[1] or m[2]), str(constant(new, "")).replace("$", r"\$"))
    x = shown(s)
    return text(F.when(F.length(x) <= LONGEST_MATCHED, F.regexp_replace(x, F.lit(p), F.lit(to))))


@verb("match", "matches", least=2)
def match(s, pattern):
    p = java_pattern(str(constant(pattern, "")))
    if p is None:
        return null(T.BooleanType())
    return boolean(F.when(F.length(S(s)) <= LONGEST_MATCHED, S(s).rlike(p)))


@verb("extract", least=2)
def extract(s, pattern, group=None):
    p, g = java_pattern(str(constant(pattern, ""))), int(constant(group, 0)) if group is not None else 0
    if p is None or g > re.compile(str(constant(pattern, ""))).groups or g < 0:
        return null()
    x = S(s)
    # A group that took no part is null, one that matched nothing is empty: Java gives empty for both, so the former are told by the array of matches.
    return text(F.when((F.length(x) <= LONGEST_MATCHED) & x.rlike(p), F.regexp_extract(x, p, g)))


def _pad_char(pad) -> str:
    c = str(constant(pad, "")) if pad is not None else " "
    return c[:1] or " "


def _padding(s, width, pad):
    return F.repeat(F.lit(_pad_char(pad)), F.greatest(whole(width) - F.length(s), F.lit(0)))


@verb("padLeft", least=2)
def pad_left(s, width, pad=None):
    return text(F.concat(_padding(shown(s), width, pad), shown(s)))


@verb("padRight", least=2)
def pad_right(s, width, pad=None):
    return text(F.concat(shown(s), _padding(shown(s), width, pad)))


@verb("pad", least=3)
def pad(s, width, pad):
    return text(F.concat(S(s), _padding(S(s), width, pad)))


@verb("center", least=2)
def center(s, width, pad=None):
    x, n = shown(s), F.floor(N(width)).cast("int")
    room = F.greatest(n - F.length(x), F.lit(0))
    left, c = F.floor(room / 2).cast("int"), F.lit(_pad_char(pad))
    return text(F.when(n > 0, F.concat(F.repeat(c, left), x, F.repeat(c, room - left))))


@verb("truncate", least=2)
def truncate(s, width, ellipsis=None):
    x, n = shown(s), whole(width)
    e = S(ellipsis) if ellipsis is not None else F.lit("")
    cut = F.when(n < 0, F.left(x, F.greatest(F.length(x) + n, F.lit(0)))).otherwise(F.left(x, n))
    return text(F.when(F.length(x) <= n, x).when((F.length(e) > 0) & (n > F.length(e)), F.concat(F.left(x, n - F.length(e)), e)).otherwise(cut))


def _parts(s, delimiter):
    d = S(delimiter)
    return F.when(d == "", F.array(s)).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1))


@verb("split", least=2)
def split(s, delimiter, index=None):
    parts = _parts(shown(s), delimiter)
    if index is None:
        return array(parts, STRING)
    i = whole(index)
    return text(F.try_element_at(parts, F.when(i >= 0, i + 1).otherwise(i)))


def item_texts(arr: Value):
    """Each item's text, null as empty."""
    return F.transform(arr.col, lambda x: S(Value(x, arr.item)))


@verb("join", least=2)
def join(arr, delimiter):
    if arr.is_array:
        return text(F.when(arr.col.isNotNull(), F.array_join(item_texts(arr), constant(delimiter, "")) if delimiter.is_const else F.array_join(item_texts(arr), S(delimiter))))
    return arr if arr.is_string else null()


@verb("mask", least=2)
def mask(s, pattern):
    x, out, used = shown(s), [], 0
    for c in str(constant(pattern, "")):
        if c in "#A*":
            used += 1
            out.append(F.when(F.length(x) >= used, F.substring(x, used, 1)).otherwise(F.lit("")))
        else:
            out.append(F.when(F.length(x) > used, F.lit(c)).otherwise(F.lit("")))
    return text(F.when(x.isNotNull(), F.concat(F.lit(""), *out)))


@verb("repeat", least=2)
def repeat(s, n):
    k = whole(n)
    return text(F.when(k >= 0, F.repeat(shown(s), F.least(k, F.lit(MOST_REPEATS)))))


@verb("substring")
def substring(s, start=None, length=None):
    x = shown(s)
    at = F.greatest(F.coalesce(whole(start), F.lit(0)), F.lit(0)) if start is not None else F.lit(0)
    if length is None:
        return text(F.substr(x, at + 1))
    n = whole(length)
    end = at + n
    end = F.when(end < 0, F.greatest(F.length(x) + end, F.lit(0))).otherwise(end)
    return text(F.when(n.isNull(), F.substr(x, at + 1)).otherwise(F.substr(x, at + 1, F.greatest(end - at, F.lit(0)))))


@verb("length", least=0)
def length(v=None):
    if v is None:
        return integer(F.lit(0))
    if v.is_array or isinstance(v.type, T.MapType):
        return integer(F.when(v.col.isNull(), F.lit(0)).otherwise(F.size(v.col)))
    if isinstance(v.type, T.StructType):
        return integer(F.when(v.col.isNull(), F.lit(0)).otherwise(F.lit(len(v.type.fields))))
    return integer(F.length(S(v)))


def _words(s):
    """Words by delimiters, by small letters before capitals, and by capitals before a word."""
    s = F.regexp_replace(s, r"(?U)[-_\s]+", " ")
    s = F.regexp_replace(s, r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def _capital(w):
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))


_simple("camelCase", lambda s: F.array_join(F.transform(_words(s), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), ""))
_simple("pascalCase", lambda s: F.array_join(F.transform(_words(s), _capital), ""))
_simple("snakeCase", lambda s: F.array_join(F.transform(_words(s), F.lower), "_"))
_simple("kebabCase", lambda s: F.array_join(F.transform(_words(s), F.lower), "-"))
_simple("slugify", lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^A-Za-z0-9_\s-]", ""), r"[\s_]+", "-"), "-+", "-"), "^-|-$", ""))

#: By country the prefix that is dropped, the lengths allowed, and the layout.
PHONES = {
    "GB": ("44", (10, 11), "+44 ", ((0, 4), " ", (4, None))),
    "DE": ("49", (10, 11), "+49 ", ((0, 4), " ", (4, None))),
    "FR": ("33", (9, 9), "+33 ", ((0, 1), " ", (1, 3), " ", (3, 5), " ", (5, 7), " ", (7, None))),
    "AU": ("61", (9, 9), "+61 ", ((0, 1), " ", (1, 5), " ", (5, None))),
    "JP": ("81", (10, 11), "+81 ", ((0, 2), "-", (2, 6), "-", (6, None))),
}


@verb("formatPhone", least=2)
def format_phone(s, country):
    raw = S(s)
    digits = F.regexp_replace(raw, r"(?U)\D", "")

    def laid_out(d, lead, layout):
        return F.concat(F.lit(lead), *(F.lit(p) if isinstance(p, str) else F.substr(d, F.lit(p[0] + 1), F.lit(99 if p[1] is None else p[1] - p[0])) for p in layout))

    us = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2))).otherwise(digits)
    named = F.upper(S(country))
    out = F.when(named.isin("US", "CA"), F.when(F.length(us) == 10, laid_out(us, "(", ((0, 3), ") ", (3, 6), "-", (6, None)))).otherwise(raw))
    for code, (prefix, (lo, hi), lead, layout) in PHONES.items():
        d = F.when(digits.startswith(prefix), F.substr(digits, F.lit(len(prefix) + 1))).otherwise(digits)
        out = out.when(named == code, F.when(F.length(d).between(lo, hi), laid_out(d, lead, layout)).otherwise(raw))
    return text(out.otherwise(raw))


@verb("leftOf", least=2)
def left_of(s, d):
    x, at = shown(s), F.locate(d.const, shown(s)) if d.is_const and d.const else F.position(S(d), shown(s))
    return text(F.when(at > 0, F.left(x, at - 1)).otherwise(x))


@verb("rightOf", least=2)
def right_of(s, d):
    x, at = shown(s), F.position(S(d), shown(s))
    return text(F.when(x.isNull(), F.lit(None)).when(at > 0, F.substr(x, at + F.length(S(d)))).otherwise(F.lit("")))


@verb("wrap", least=2)
def wrap(s, width):
    x, n = shown(s), whole(width)
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc, w):
        fits = F.length(acc["line"]) + 1 + F.length(w) <= n
        return (
            F.when(acc["line"] == "", F.struct(acc["lines"].alias("lines"), w.alias("line")))
            .when(fits, F.struct(acc["lines"].alias("lines"), F.concat(acc["line"], F.lit(" "), w).alias("line")))
            .otherwise(F.struct(F.array_append(acc["lines"], acc["line"]).alias("lines"), w.alias("line")))
        )

    lines = F.aggregate(F.split(x, rf"{SPACE}+"), empty, add, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])))
    return text(F.when(n <= 0, F.lit(None)).when(F.length(x) <= n, x).otherwise(F.array_join(lines, "\n")))


def _accents() -> tuple[str, str]:
    """Letters that lose a mark, and what is left of each: those whose canonical form is one base and marks."""
    come, go = [], []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if bare != c and len(bare) == 1:
            come.append(c)
            go.append(bare)
    return "".join(come), "".join(go)


_simple("stripAccents", lambda s: F.regexp_replace(F.translate(s, *_accents()), r"\p{Mn}+", ""))


@verb("wordCount", least=0)
def word_count(s=None):
    if s is None:
        return integer(F.lit(0))
    return integer(F.size(F.filter(F.split(S(s), rf"{SPACE}+"), lambda w: w != "")))


@verb("tokenize", least=0)
def tokenize(s=None, delimiter=None):
    if s is None:
        return array(F.array().cast("array<string>"), STRING)
    x = shown(s)
    parts = F.split(x, rf"{SPACE}+") if delimiter is None or delimiter.is_null else _parts(x, delimiter)
    trimmed = F.transform(parts, lambda w: F.regexp_replace(w, rf"^{SPACE}+|{SPACE}+$", ""))
    return array(F.coalesce(F.filter(trimmed, lambda w: w != ""), F.array().cast("array<string>")), STRING)


@verb("levenshtein", least=2)
def levenshtein(a, b):
    x, y = S(a), S(b)
    return integer(F.when((F.length(x) <= LONGEST_DISTANCE) & (F.length(y) <= LONGEST_DISTANCE), F.levenshtein(x, y)))


@verb("soundex")
def soundex(s):
    letters = F.regexp_replace(shown(s), "[^A-Za-z]", "")
    return text(F.when(letters != "", F.soundex(letters)))


@verb("unescapeHtml")
def unescape_html(s):
    x = _replaced(shown(s), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")))

    def references(x, pattern, number):
        # Pieces between references, each but the first begun by a reference's number.
        pieces = F.split(F.regexp_replace(x, pattern, "\u0000$1;"), "\u0000")
        at = lambda p: F.substring_index(p, ";", 1)
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(_code_point(number(at(p))), F.substr(p, F.length(at(p)) + 2)))), "")

    x = references(x, "&#(\\d{1,7});", lambda n: n.cast("bigint"))
    x = references(x, "&#[xX]([0-9a-fA-F]{1,6});", lambda n: F.conv(n, 16, 10).cast("bigint"))
    return text(F.replace(x, F.lit("&amp;"), F.lit("&")))


def _code_point(n):
    """The character of a code point: its bytes in UTF-32, decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


@verb("template", least=2)
def template(pattern, data):
    out, at, p = [F.lit("")], 0, str(constant(pattern, ""))
    for m in re.finditer(r"\{([^{}]+)\}", p):
        out += [F.lit(p[at : m.start()]), S(field(data, m[1]))]
        at = m.end()
    return text(F.concat(*out, F.lit(p[at:])))
