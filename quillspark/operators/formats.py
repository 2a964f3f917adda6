"""Named formats of texts, as boolean columns.  Null and unknown formats pass."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that the formats know.
CURRENCIES = """AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY
COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS
INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU
MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK
SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD
XOF XPF YER ZAR ZMW ZWL""".split()
COUNTRIES_2 = """AE AR AT AU BD BE BG BH BR CA CH CL CN CO CY CZ DE DK EG ES FI FR GB GH GR HK HR HU ID IE IL IN IS IT JO JP KE KR KW LB
MA MX MY NG NL NO NZ OM PE PH PK PL PT QA RO RU SA SE SG TH TR TW TZ UA UG US VN ZA""".split()
COUNTRIES_3 = """ARE ARG AUS AUT BEL BGD BGR BHR BRA CAN CHE CHL CHN COL CYP CZE DEU DNK EGY ESP FIN FRA GBR GHA GRC HKG HRV HUN IDN IND
IRL ISL ISR ITA JOR JPN KEN KOR KWT LBN MAR MEX MYS NGA NLD NOR NZL OMN PAK PER PHL POL PRT QAT ROU RUS SAU SGP SWE THA
TUR TWN TZA UGA UKR USA VNM ZAF""".split()
STATES = """AK AL AR AS AZ CA CO CT DC DE FL GA GU HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK
OR PA PR RI SC SD TN TX UT VA VI VT WA WI WV WY""".split()

_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.[^Z+\-]*)?)?(?:Z|[+-]\S*)?"
_GROUP = "[0-9a-fA-F]{1,4}"


def _ipv6(s: Column) -> Column:
    halves = F.split(s, "::", -1)
    count = lambda h: F.when(h == "", F.lit(0)).otherwise(F.size(F.split(h, ":", -1)))
    good = lambda h: (h == "") | h.rlike(f"^{_GROUP}(?::{_GROUP})*$")
    a, b = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    compressed = (F.size(halves) == 2) & good(a) & good(b) & (count(a) + count(b) <= 8)
    return F.when(s.contains("::"), F.coalesce(compressed, F.lit(False))).otherwise(s.rlike(f"^{_GROUP}(?::{_GROUP}){{7}}$"))


def _luhn(s: Column) -> Column:
    digits = F.reverse(F.filter(F.split(F.regexp_replace(s, "[ -]", ""), ""), lambda c: c != ""))
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 1, double(c.try_cast("int"))).otherwise(c.try_cast("int"))), F.lit(0), lambda a, x: a + x)
    return s.rlike(r"^[0-9 -]*$") & F.size(digits).between(13, 19) & (total % 10 == 0)


def _like(pattern: str):
    return lambda s: s.rlike(pattern)


def _valid_pattern(s: Column) -> Column:
    """Whether each text is a pattern; patterns are compiled in Python, as there is no expression for it."""
    @F.pandas_udf("boolean")
    def compiles(texts: pd.Series) -> pd.Series:
        def good(x) -> bool:
            try:
                re.compile(x or "")
                return True
            except re.error:
                return False

        return texts.map(good)

    return compiles(s)


FORMATS = {
    "email": _like(r"(?s)^[^@]+@[^@.][^@]*\.[^@]*$"),
    "url": _like(r"^https?://"),
    "uuid": _like(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    "ipv4": _like(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.|$)){4}(?<!\.)$"),
    "ipv6": _ipv6,
    "date": _like(f"^{_DATE}$"),
    "date-iso": _like(f"^{_DATE}$"),
    "time": _like(f"^{_TIME}$"),
    "timestamp": _like(f"^{_DATE}T{_TIME}$"),
    "hostname": lambda s: s.rlike(r"^(?!-)[a-zA-Z0-9-]{1,63}(?<!-)(?:\.[a-zA-Z0-9-]{1,63})*$") & (F.length(s) <= 253),
    "regex": _valid_pattern,
    "phone": lambda s: s.rlike(r"^[0-9+\-() .]*$") & (F.length(F.regexp_replace(s, r"\D", "")) >= 7),
    "zip": _like(r"^\d{5}(?:-\d{4})?$"),
    "naic": _like(r"^\d{5}$"),
    "fein": _like(r"^\d{2}-\d{7}$"),
    "vin": _like(r"^[A-HJ-NPR-Za-hj-npr-z0-9]{17}$"),
    "currency-code": lambda s: s.isin(*CURRENCIES),
    "country-alpha2": lambda s: s.isin(*COUNTRIES_2),
    "country-alpha3": lambda s: s.isin(*COUNTRIES_3),
    "state-us": lambda s: s.isin(*STATES),
    "creditcard": _luhn,
    "credit-card": _luhn,
    "uri": _like(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:\S*$"),
    "datetime": _like(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    "date-time": _like(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    "iban": _like(r"^(?i)[A-Z]{2}\d{2}[A-Z0-9]{4,30}$"),
    "bic": _like(r"^(?i)[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"),
    "swift": _like(r"^(?i)[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"),
    "routing": _like(r"^\d{9}$"),
    "cusip": _like(r"^(?i)[A-Z0-9]{9}$"),
    "isin": _like(r"^(?i)[A-Z]{2}[A-Z0-9]{9}\d$"),
    "lei": _like(r"^(?i)[A-Z0-9]{20}$"),
    "npi": _like(r"^\d{10}$"),
    "dea": _like(r"^(?i)[A-Z]{2}\d{7}$"),
    "imei": _like(r"^\d{15}$"),
    "iccid": _like(r"^\d{19,20}$"),
    "ssn": lambda s: s.rlike(r"^(?:\d{9}|\d{3}-\d{2}-\d{4})$") & ~s.startswith("000"),
}


def passes(s: Column, name: str) -> Column:
    test = FORMATS.get(name)
    return F.lit(True) if test is None else F.coalesce(test(s), F.lit(True))
