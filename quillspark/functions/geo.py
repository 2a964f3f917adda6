"""Verbs of places on the globe."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import DOUBLE, N, Value, boolean, constant, double
from quillspark.functions.registry import null, verb

#: The globe's radius.
RADIUS = {"km": 6371.0, "mi": 3959.0, "miles": 3959.0}


def _good(lat1, lon1, lat2, lon2):
    return lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180)


@verb("distance", least=4)
def distance(lat1, lon1, lat2, lon2, unit=None):
    r = RADIUS.get(str(constant(unit, "km")).lower() if unit is not None else "km")
    if r is None:
        return null(DOUBLE)
    a1, o1, a2, o2 = N(lat1), N(lon1), N(lat2), N(lon2)
    half = lambda x: F.sin(F.radians(x) / 2)
    a = half(a2 - a1) * half(a2 - a1) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * half(o2 - o1) * half(o2 - o1)
    return double(F.when(_good(a1, o1, a2, o2), 2 * r * F.atan2(F.sqrt(a), F.sqrt(1 - a))))


@verb("inBoundingBox", least=6)
def in_bounding_box(lat, lon, south, west, north, east):
    values = [N(v) for v in (lat, lon, south, west, north, east)]
    y, x, s, w, n, e = values
    known = y.isNotNull()
    for v in values[1:]:
        known = known & v.isNotNull()
    return boolean(F.when(known, y.between(s, n) & x.between(w, e)))


@verb("toRadians")
def to_radians(v):
    return double(F.radians(N(v)))


@verb("toDegrees")
def to_degrees(v):
    return double(F.degrees(N(v)))


@verb("bearing", least=4)
def bearing(lat1, lon1, lat2, lon2):
    a1, o1, a2, o2 = N(lat1), N(lon1), N(lat2), N(lon2)
    p, q, d = F.radians(a1), F.radians(a2), F.radians(o2 - o1)
    y = F.sin(d) * F.cos(q)
    x = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return double(F.when(_good(a1, o1, a2, o2), F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))))


@verb("midpoint", least=4)
def midpoint(lat1, lon1, lat2, lon2):
    a1, o1, a2, o2 = N(lat1), N(lon1), N(lat2), N(lon2)
    p, q, d = F.radians(a1), F.radians(a2), F.radians(o2 - o1)
    x, y = F.cos(q) * F.cos(d), F.cos(q) * F.sin(d)
    lat = F.atan2(F.sin(p) + F.sin(q), F.sqrt((F.cos(p) + x) * (F.cos(p) + x) + y * y))
    lon = F.radians(o1) + F.atan2(y, F.cos(p) + x)
    kind = T.StructType([T.StructField("lat", DOUBLE), T.StructField("lon", DOUBLE)])
    return Value(F.when(_good(a1, o1, a2, o2), F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))), kind)
