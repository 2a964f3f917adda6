"""Date and time verbs.  Dates are ISO texts, timestamps ISO texts with milliseconds and Z; typed columns are taken as well."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import LONG, N, S, boolean, constant, integer, ordinal, text, whole
from quillspark.functions.registry import null, verb


def when(v):
    """A value as a timestamp, null where it reads as none: ISO dates, and ISO timestamps with or without a zone."""
    if v.is_temporal:
        return v.col.cast("timestamp")
    s = S(v)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$)"), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def day(v):
    return when(v).cast("date")


def iso_day(d):
    return text(F.date_format(d, "yyyy-MM-dd"))


def iso_time(t):
    return text(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def formatted(t, pattern: str):
    """The pattern with its tokens replaced one kind after the other: YYYY MM DD HH hh mm ss SSS A.

    An ``ss`` is taken wherever it stands, also out of SSS, and every A is the half of the day.
    """
    tokens = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss", "SSS": "SSS", "A": "a"}
    pieces: list[str | None] = [pattern]
    kinds: list[str] = [""]
    for token in tokens:
        new, new_kinds = [], []
        for p, k in zip(pieces, kinds):
            if k:
                new.append(p)
                new_kinds.append(k)
                continue
            parts = p.split(token)
            for i, part in enumerate(parts):
                if i:
                    new.append(token)
                    new_kinds.append(token)
                new.append(part)
                new_kinds.append("")
        pieces, kinds = new, new_kinds
    cols = [F.date_format(t, tokens[k]) if k else F.lit(p) for p, k in zip(pieces, kinds) if k or p]
    return F.when(t.isNotNull(), F.concat(F.lit(""), *cols))


def parsed(s, pattern: str):
    """A timestamp by the places of the pattern's tokens; month and day default to 1."""

    def at(token: str, size: int):
        p = pattern.find(token)
        if p < 0:
            return F.lit(0)
        piece = F.substring(s, p + 1, size)
        return F.when(F.length(s) >= p + size, F.trim(piece).try_cast("int")).otherwise(F.lit(0))

    y, mo, d, h, mi, se = at("YYYY", 4), at("MM", 2), at("DD", 2), at("HH", 2), at("mm", 2), at("ss", 2)
    first = lambda x: F.when(x == 0, F.lit(1)).otherwise(x)
    shown = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, first(mo), first(d), h, mi, se)
    known = y.isNotNull() & mo.isNotNull() & d.isNotNull() & h.isNotNull() & mi.isNotNull() & se.isNotNull()
    return F.when(known & ((y != 0) | (mo != 0) | (d != 0)) & (y > 0), shown.try_cast("timestamp"))


@verb("today", least=0)
def today(*_):
    return iso_day(F.current_date())


@verb("now", least=0)
def now(*_):
    return iso_time(F.current_timestamp())


@verb("formatDate", least=2)
def format_date(v, pattern):
    return text(formatted(when(v), str(constant(pattern, ""))))


@verb("formatTime")
def format_time(v, pattern=None):
    return text(formatted(when(v), str(constant(pattern, "HH:mm:ss")) if pattern is not None else "HH:mm:ss"))


@verb("formatTimestamp")
def format_timestamp(v, pattern=None):
    if pattern is None or pattern.is_null:
        return iso_time(when(v))
    return text(formatted(when(v), str(constant(pattern))))


@verb("parseDate")
def parse_date(v, pattern=None):
    p = str(constant(pattern, "YYYY-MM-DD")) if pattern is not None else "YYYY-MM-DD"
    return iso_day(F.coalesce(parsed(S(v), p), when(v)))


@verb("parseTimestamp", least=2)
def parse_timestamp(v, pattern):
    return text(F.date_format(F.coalesce(parsed(S(v), str(constant(pattern, ""))), when(v)), "yyyy-MM-dd'T'HH:mm:ss"))


@verb("addDays", least=2)
def add_days(v, n):
    return iso_day(F.date_add(day(v), whole(n)))


@verb("addMonths", least=2)
def add_months(v, n):
    return iso_day(F.add_months(day(v), whole(n)))


@verb("addYears", least=2)
def add_years(v, n):
    return iso_day(F.add_months(day(v), whole(n) * 12))


@verb("dateDiff", least=2)
def date_diff(a, b, unit=None):
    u = str(constant(unit, "days") or "days").lower() if unit is not None else "days"
    x, y = day(a), day(b)
    if u in ("days", "day"):
        return integer(F.datediff(y, x))
    if u in ("months", "month"):
        return integer((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x))
    if u in ("years", "year"):
        return integer(_full_years(x, y))
    return null(LONG)


def _full_years(x, y):
    early = F.month(y) * 100 + F.dayofmonth(y) < F.month(x) * 100 + F.dayofmonth(x)
    return F.year(y) - F.year(x) - F.when(early, 1).otherwise(0)


def _shift(name: str, seconds: int):
    @verb(name, least=2)
    def build(v, n):
        micros = F.rint(N(n) * float(seconds) * 1e6).cast("bigint")
        return iso_time(F.timestamp_micros(F.unix_micros(when(v)) + micros))


for _name, _seconds in (("addHours", 3600), ("addMinutes", 60), ("addSeconds", 1)):
    _shift(_name, _seconds)


@verb("startOfDay")
def start_of_day(v):
    return iso_time(F.date_trunc("DAY", when(v)))


@verb("endOfDay")
def end_of_day(v):
    return iso_time(F.timestamp_micros(F.unix_micros(F.date_trunc("DAY", when(v))) + 86399999000))


def _of_day(name: str, build):
    @verb(name)
    def make(v, *_):
        return build(day(v))


_of_day("startOfMonth", lambda d: iso_day(F.trunc(d, "MM")))
_of_day("endOfMonth", lambda d: iso_day(F.last_day(d)))
_of_day("startOfYear", lambda d: iso_day(F.trunc(d, "YEAR")))
_of_day("endOfYear", lambda d: iso_day(F.make_date(F.year(d), F.lit(12), F.lit(31))))
_of_day("dayOfWeek", lambda d: integer(F.weekday(d) + 1))
_of_day("dayOfMonth", lambda d: integer(F.dayofmonth(d)))
_of_day("dayOfYear", lambda d: integer(F.dayofyear(d)))
_of_day("monthName", lambda d: text(F.date_format(d, "MMMM")))
_of_day("weekOfYear", lambda d: integer(F.weekofyear(d)))
_of_day("quarter", lambda d: integer(F.quarter(d)))
_of_day("nextBusinessDay", lambda d: iso_day(F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))))


@verb("isLeapYear")
def is_leap_year(v):
    n = ordinal(v) if v.is_string else N(v)
    y = F.when(n > 100, F.floor(n).cast("int")).otherwise(F.year(when(v)) if not v.is_number else F.lit(None).cast("int"))
    return boolean(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0))


@verb("isBefore", least=2)
def is_before(a, b):
    return boolean(when(a) < when(b))


@verb("isAfter", least=2)
def is_after(a, b):
    return boolean(when(a) > when(b))


@verb("isBetween", least=3)
def is_between(v, lo, hi):
    x, a, b = when(v), when(lo), when(hi)
    return boolean(F.when(x.isNotNull() & a.isNotNull() & b.isNotNull(), x.between(a, b)))


@verb("toUnix")
def to_unix(v):
    return integer(F.unix_seconds(when(v)))


@verb("fromUnix")
def from_unix(n):
    x = N(n)
    t = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return iso_time(F.timestamp_seconds(F.when(F.abs(t) > 100_000_000_000, F.floor(t / 1000)).otherwise(t)))


@verb("daysBetweenDates", least=2)
def days_between(a, b):
    return integer(F.datediff(day(b), day(a)))


@verb("ageFromDate")
def age_from_date(birth, as_of=None):
    age = _full_years(day(birth), day(as_of) if as_of is not None else F.current_date())
    return integer(F.when(age >= 0, age))


@verb("isValidDate", least=0)
def is_valid_date(v=None, pattern=None):
    if v is None:
        return boolean(F.lit(False))
    s = S(v) if not v.is_temporal else F.date_format(v.col, "yyyy-MM-dd")
    good = F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(s, F.lit(10)).try_cast("date").isNotNull()), F.lit(False))
    if pattern is not None and not pattern.is_null:
        good = good | parsed(s, str(constant(pattern))).isNotNull()
    return boolean(good)


@verb("formatLocaleDate")
def format_locale_date(v, locale=None, pattern=None):
    if pattern is not None and constant(pattern, ""):
        return text(formatted(when(v), str(constant(pattern))))
    return iso_day(day(v))


@verb("businessDays", least=2)
def business_days(v, n):
    """So many weekdays on (or back); a weekend counts outward."""
    d, k = day(v), whole(n)
    size = F.abs(k)
    weeks, rest = F.floor(size / 5).cast("int"), (size % 5).cast("int")
    on = F.date_add(d, weeks * 7)
    w = F.weekday(on)
    ahead = F.when(rest == 0, F.lit(0)).when(w == 5, rest + 1).when(w == 6, rest).when(w + rest > 4, rest + 2).otherwise(rest)
    back = F.date_sub(d, weeks * 7)
    u = F.weekday(back)
    behind = F.when(rest == 0, F.lit(0)).when(u == 5, rest).when(u == 6, rest + 1).when(u - rest < 0, rest + 2).otherwise(rest)
    return iso_day(F.when(k >= 0, F.date_add(on, ahead.cast("int"))).otherwise(F.date_sub(back, behind.cast("int"))))


@verb("formatDuration")
def format_duration(v):
    """Seconds, or an ISO duration, in words."""
    iso = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    s = S(v)
    total = N(v) if v.is_number else F.when(s.rlike(r"^\d+(?:\.\d+)?$"), s.try_cast("double"))
    good = total.isNotNull() & (total >= 0) & (total < float("inf")) if v.is_number else s.rlike(iso) | total.isNotNull()
    part = lambda i: F.coalesce(F.regexp_extract(s, iso, i).try_cast("double"), F.lit(0.0)) if not v.is_number else F.lit(0.0)
    d = F.floor(total / 86400)
    h = F.floor((total - d * 86400) / 3600)
    m = F.floor((total - d * 86400 - h * 3600) / 60)
    sec = total - d * 86400 - h * 3600 - m * 60
    numbers = [part(1), part(2), F.coalesce(d.cast("double"), part(3)), F.coalesce(h.cast("double"), part(4)), F.coalesce(m.cast("double"), part(5)), F.coalesce(sec, part(6))]
    words = []
    for name, x in zip(("year", "month", "day", "hour", "minute", "second"), numbers):
        shown = x.cast("bigint").cast("string")
        if name == "second":
            shown = F.when(x == F.floor(x), shown).otherwise(F.format_string("%.1f", x))
        words.append(F.when(x > 0, F.concat(shown, F.when(x == 1, F.lit(f" {name}")).otherwise(F.lit(f" {name}s")))))
    said = F.concat_ws(", ", *words)
    return text(F.when(good, F.when(said == "", F.lit("0 seconds")).otherwise(said)))
