"""Numeric verbs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import DOUBLE, N, S, Value, Z, boolean, constant, double, integer, let, ordinal, rounded_result, shown, text, whole
from quillspark.functions.registry import null, verb


def _places(v, default: int) -> int:
    x = constant(v, None) if v is not None else None
    try:
        return default if x is None else max(0, int(float(x)))
    except ValueError:
        return default


def fixed(x, places: int):
    """A double with so many digits after the point, by its exact binary value, a tie to the even digit; a negative zero keeps its sign."""
    size = F.abs(x)
    digits = _digits(size, places)
    if places <= 9:
        near = size < 2.0**63
        digits = F.when(near if places <= 2 else near & ((size >= 2.0**-10) | (size == 0)), _near_digits(size, places)).otherwise(digits)
    digits = F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.lit("inf")).otherwise(digits)
    minus = F.when(x < 0, F.lit("-")).when(x > 0, F.lit("")).otherwise(F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")))
    return F.when(x.isNotNull(), F.concat(minus, digits))


def _near_digits(size, places: int):
    """The digits of doubles below 2**63, to nine places at most, in whole numbers.

    From 2**-10 on, what is after the point is a whole number of 2**-62; smaller doubles
    are cut to one, which two places don't show.  Its product with 10**places is taken in
    two halves of 31 bits, for the digits and the 62 bits that round them.
    """
    ten, bits = 10**places, F.lit(2**31 - 1)
    whole = F.floor(size)
    part = F.floor((size - whole) * 2.0**62)
    low = part.bitwiseAND(bits) * ten
    high = F.shiftright(part, 31) * ten + F.shiftright(low, 31)
    cut = F.shiftright(high, 31)
    rest = F.shiftleft(high.bitwiseAND(bits), 31) + low.bitwiseAND(bits)
    rounded = cut + F.shiftright(rest + F.lit(2**61 - 1) + (cut if places else whole).bitwiseAND(F.lit(1)), 62)
    number = (whole + F.when(rounded == ten, F.lit(1)).otherwise(F.lit(0))).cast("string")
    return F.concat(number, F.lit("."), F.lpad((rounded % ten).cast("string"), places, "0")) if places else number


def _digits(size, places: int):
    """The digits of any finite double from 0: all of its decimal digits, in limbs of nine, then cut and rounded as text."""
    power = F.coalesce(F.floor(F.log2(size)) - 53, F.lit(0)).cast("int")
    return let(F.struct(size.alias("size"), power.alias("power")), lambda v: _rounded(_all_digits(v["size"], v["power"]), F.greatest(-v["power"], F.lit(0)), places))


def _all_digits(size, power):
    """A double's digits as a whole number, which below the point has as many places as ``power`` is below 0: m / 2**k is m * 5**k / 10**k."""
    half = F.floor(power / 2).cast("int")
    mantissa = (size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power)).cast("bigint")
    base, step = F.when(power < 0, F.lit(5.0)).otherwise(F.lit(2.0)), F.when(power < 0, F.lit(12)).otherwise(F.lit(29))
    first, others = F.pow(base, F.abs(power) % step), F.array_repeat(F.pow(base, step).cast("bigint"), F.floor(F.abs(power) / step).cast("int"))
    limbs = F.aggregate(F.concat(F.array(first.cast("bigint")), others), F.array(*_limb(mantissa)), _multiplied)
    return F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")


def _rounded(digits, after, places: int):
    """Digits, of which so many are after the point, with ``places`` of them there."""
    full = F.concat(F.repeat(F.lit("0"), after + 1), digits, F.repeat(F.lit("0"), F.lit(places)))

    def cut(v):
        head, rest = v["head"], v["rest"]
        plain = F.rtrim(head, F.lit("9"))
        raised = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), (F.substring(plain, -1, 1).cast("int") + 1).cast("string"), F.repeat(F.lit("0"), F.length(head) - F.length(plain)))
        return F.when((rest > "5") | (rest == "5") & F.substring(head, -1, 1).isin(*"13579"), raised).otherwise(head)

    parts = let(full, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - after).alias("head"), F.rtrim(F.substring(x, F.length(x) - after + 1, after), F.lit("0")).alias("rest")))
    number = let(parts, cut)
    return F.regexp_replace(number, rf"^0*(\d+)(\d{{{places}}})$", "$1.$2") if places else F.regexp_replace(number, r"^0+(?=\d)", "")


def _limb(x):
    """A whole number's last nine digits and what is before them, without loss below 2**61."""
    low = x % 10**9
    return low, ((x - low) / 10**9).cast("bigint")


def _multiplied(limbs, factor):
    """Limbs of nine digits, the lowest first, times a factor of nine digits."""

    def step(done, limb):
        low, high = _limb(limb * factor + done["carry"])
        return F.struct(F.concat(done["limbs"], F.array(low)).alias("limbs"), high.alias("carry"))

    start = F.struct(F.array().cast("array<bigint>").alias("limbs"), F.lit(0).cast("bigint").alias("carry"))
    return F.aggregate(limbs, start, step, lambda done: F.concat(done["limbs"], F.array(done["carry"])))


@verb("formatNumber", least=2)
def format_number(n, places):
    return text(fixed(N(n), _places(places, 0)))


@verb("formatInteger")
def format_integer(n):
    return text(F.floor(N(n)).cast("string"))


@verb("formatCurrency")
def format_currency(n, places=None):
    return text(fixed(N(n), _places(places, 2)))


@verb("formatPercent")
def format_percent(n, places=None):
    p = _places(places, 0)
    scaled = N(n) * 100.0 * 10.0**p
    away = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)) / 10.0**p
    return text(F.concat(fixed(away, p), F.lit("%")))


def _is_money(*values) -> bool:
    return any(isinstance(v.type, T.DecimalType) and v.type.scale for v in values)


def _sum(name: str, of):
    @verb(name, least=2)
    def build(a, b):
        if a.is_number and b.is_number and _is_money(a, b) and not any(isinstance(v.type, (T.DoubleType, T.FloatType)) for v in (a, b)):
            zero = F.lit(0).cast("decimal(1,0)")
            exact = of(F.coalesce(a.col, zero), F.coalesce(b.col, zero))
            return Value(exact.cast("decimal(38,10)"), T.DecimalType(38, 10))
        return double(of(Z(a), Z(b)))


_sum("add", lambda a, b: a + b)
_sum("subtract", lambda a, b: a - b)
_sum("multiply", lambda a, b: a * b)


@verb("divide", least=2)
def divide(a, b):
    return double(F.try_divide(Z(a), Z(b)))


@verb("mod", least=2)
def mod(a, b):
    y = Z(b)
    return double(F.try_mod(Z(a), y))


@verb("abs")
def abs_(a):
    return double(F.abs(Z(a)))


@verb("floor")
def floor(a):
    return integer(F.floor(Z(a)))


@verb("ceil")
def ceil(a):
    return integer(F.ceil(Z(a)))


@verb("round")
def round_(a, places=None):
    """Half to even, by the shortest decimal text."""
    p = _places(places, 0)
    return double(F.bround(N(a).try_cast("decimal(38,18)"), p) if p < 18 else N(a))


@verb("negate")
def negate(a):
    return double(-Z(a))


@verb("sign")
def sign(a):
    return integer(F.signum(Z(a)))


@verb("trunc")
def trunc(a):
    x = Z(a)
    return integer(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def mulberry(seed: int) -> float:
    """The seeded generator's first number, 0 to 1, for a constant seed."""
    s = (seed + 0x6D2B79F5) & 0xFFFFFFFF
    t = (s ^ s >> 15) * (s | 1) & 0xFFFFFFFF
    t ^= (t + ((t ^ t >> 7) * (t | 61))) & 0xFFFFFFFF
    return ((t ^ t >> 14) & 0xFFFFFFFF) / 2**32


_LOW = 0xFFFFFFFF


def _times(a, b):
    """The low 32 bits of a product of two 32-bit numbers, in 64-bit parts that don't overflow."""
    high, low = F.shiftright(b, 16), b.bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16) + (a * low)).bitwiseAND(F.lit(_LOW))


def mulberry_column(seed):
    """:func:`mulberry` over a column of 32-bit seeds (bigint)."""
    s = (seed + F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_LOW))
    t = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    u = _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))
    t = t.bitwiseXOR((t + u).bitwiseAND(F.lit(_LOW)))
    return t.bitwiseXOR(F.shiftright(t, 14)).bitwiseAND(F.lit(_LOW)).cast("double") / F.lit(float(2**32))


def text_seed(s, start: int, minus: bool):
    """A 32-bit hash of a text: each code point is added to 31 (or 33) times what there is."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint"))
    factor = 31 if minus else 33
    return F.aggregate(codes, F.lit(start).cast("bigint"), lambda h, c: (h * factor + c).bitwiseAND(F.lit(_LOW)))


@verb("random", least=0)
def random(*args):
    if len(args) == 1 and args[0].is_string:
        return double(mulberry_column(text_seed(S(args[0]), 0, True)))
    if len(args) >= 3 and args[2].is_string:
        lo, hi = F.floor(N(args[0])), F.floor(N(args[1]))
        x = mulberry_column(text_seed(S(args[2]), 0, True))
        return integer(F.when(N(args[0]) <= N(args[1]), F.floor(x * (hi - lo + 1)) + lo))
    if len(args) >= 2:
        lo, hi = N(args[0]), N(args[1])
        return double(F.when(lo.isNull() | hi.isNull(), F.rand()).when(lo <= hi, lo + F.rand() * (hi - lo)))
    return double(F.rand())


def _finite(v):
    return rounded_result(ordinal(v) if v.is_string else N(v))


def _extreme(name: str, across, within):
    @verb(name)
    def build(*args):
        if len(args) == 1 and args[0].is_array:
            return double(within(F.transform(args[0].col, lambda x: _finite(Value(x, args[0].item)))))
        cols = [_finite(a) for a in args]
        return double(across(*cols) if len(cols) > 1 else cols[0])


_extreme("minOf", F.least, F.array_min)
_extreme("maxOf", F.greatest, F.array_max)


@verb("parseInt")
def parse_int(v, radix=None):
    base = int(constant(radix, 10)) if radix is not None else 10
    if base == 10:
        return integer(F.floor(N(v)))
    if not 2 <= base <= 36:
        return null(T.LongType())
    s = F.lower(F.trim(S(v)))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    prefix = {16: "(?:0x)?", 2: "(?:0b)?", 8: "(?:0o)?"}.get(base, "")
    bare = F.regexp_replace(s, rf"^([+-]?){prefix}", "$1")
    good = s.rlike(rf"^[+-]?{prefix}[{digits}]+$")
    magnitude = F.conv(F.regexp_replace(bare, "^[+-]", ""), base, 10).try_cast("bigint")
    return integer(F.when(good, F.when(s.startswith("-"), -magnitude).otherwise(magnitude)))


@verb("safeDivide", least=2)
def safe_divide(a, b, default=None):
    x, y = N(a), N(b)
    bad = x.isNull() | y.isNull() | (y == 0) | F.isnan(y) | (F.abs(y) == float("inf"))
    other = N(default) if default is not None else F.lit(None).cast("double")
    return double(F.when(bad, other).otherwise(F.try_divide(x, y)))


#: Separators of thousands and decimals by locale.
SEPARATORS = {"en-us": (",", "."), "en-gb": (",", "."), "de-de": (".", ","), "fr-fr": (" ", ",")}


@verb("formatLocaleNumber")
def format_locale_number(n, locale=None, places=None):
    x = rounded_result(N(n))
    group, point = SEPARATORS.get(str(constant(locale, "en-US")).lower() if locale is not None else "en-us", (",", "."))
    p = _places(places, -1)
    if p >= 0:
        base = _grouped(fixed(x, p))
    else:
        base = F.when(x == F.floor(x), _grouped(F.floor(x).cast("string"))).otherwise(F.regexp_replace(_grouped(fixed(x, 3)), r"\.?0+$", ""))
    return text(F.translate(base, ",.", group + point))


def _grouped(s):
    return F.regexp_replace(s, r"(?<=\d)(?=(?:\d{3})+(?:\.|$))(?<!\.\d{0,17})", ",")


@verb("log")
def log(n, base=None):
    x = N(n)
    if base is None:
        return double(F.when(x > 0, F.ln(x)))
    b = N(base)
    return double(F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b)))


@verb("ln")
def ln(n):
    return double(F.when(N(n) > 0, F.ln(N(n))))


@verb("log10")
def log10(n):
    return double(F.when(N(n) > 0, F.log10(N(n))))


@verb("exp")
def exp(n):
    return double(F.exp(N(n)))


@verb("pow", least=2)
def pow_(a, b):
    return double(F.pow(N(a), N(b)))


@verb("sqrt")
def sqrt(n):
    return double(F.when(N(n) >= 0, F.sqrt(N(n))))


@verb("clamp", least=3)
def clamp(n, lo, hi):
    x, a, b = N(n), N(lo), N(hi)
    return double(F.when(x.isNotNull() & a.isNotNull() & b.isNotNull(), F.greatest(a, F.least(b, x))))


@verb("pi", least=0)
def pi(*_):
    return double(F.lit(math.pi))


@verb("e", least=0)
def e(*_):
    return double(F.lit(math.e))


#: By family each unit's size in the family's first unit.
UNITS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lb": 453.59237, "oz": 28.3495, "ton": 907185.0, "tonne": 1000000.0},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588, "floz": 0.0295735},
    "speed": {"m/s": 1.0, "km/h": 0.277778, "mph": 0.44704, "knot": 0.514444, "ft/s": 0.3048},
    "area": {"m2": 1.0, "km2": 1000000.0, "cm2": 0.0001, "ha": 10000.0, "acre": 4046.86, "ft2": 0.092903, "in2": 0.00064516, "mi2": 2589988.0},
    "data": {"B": 1.0, "KB": 1024.0, "MB": 1048576.0, "GB": 1073741824.0, "TB": 1099511627776.0},
    "time": {"s": 1.0, "ms": 0.001, "min": 60.0, "h": 3600.0, "d": 86400.0, "wk": 604800.0},
}


@verb("convertUnit", least=3)
def convert_unit(n, come, go):
    x, a, b = N(n), str(constant(come, "")), str(constant(go, ""))
    if a in "CFK" and b in "CFK" and a and b:
        celsius = {"C": x, "F": (x - 32) * 5 / 9, "K": x - 273.15}[a]
        out = {"C": celsius, "F": celsius * 9 / 5 + 32, "K": celsius + 273.15}[b]
    else:
        family = next((f for f in UNITS.values() if a in f and b in f), None)
        if family is None:
            return null(DOUBLE)
        out = x * family[a] / family[b]
    return double(F.rint(out * 1000000.0) / 1000000.0)


@verb("gcd", least=2)
def gcd(a, b):
    return integer(_gcd(a, b))


def _gcd(a, b):
    x, y = F.abs(whole(a).cast("bigint")), F.abs(whole(b).cast("bigint"))
    # Euclid's remainders halve every two steps, so 96 steps do for 63 bits.
    start = F.struct(x.alias("a"), y.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step, lambda s: s["a"])


@verb("lcm", least=2)
def lcm(a, b):
    x, y = F.abs(whole(a).cast("bigint")), F.abs(whole(b).cast("bigint"))
    return integer(F.when((x == 0) | (y == 0), F.lit(0)).otherwise(F.floor(F.try_divide(x, _gcd(a, b))).cast("bigint") * y))


@verb("factorial")
def factorial(n):
    x = N(n)
    return integer(F.when((x >= 0) & (x <= 18) & (x == F.floor(x)), F.factorial(x.try_cast("int"))))
