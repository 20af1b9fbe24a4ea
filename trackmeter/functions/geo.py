"""Geodesy as column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmeter.functions.columns import settled

#: mean Earth radius in metres
EARTH_RADIUS_M = 6371008.8
#: metres in a degree of latitude, as used for coordinate grain
METRES_PER_DEGREE = 111320.0


def _c(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def solid(*args: Column) -> tuple[Column, list[Column]]:
    """Whether no argument is NULL, and the arguments with 0 in place of NULL."""
    known = reduce(lambda a, b: a & b, [a.isNotNull() for a in args])
    return known, [F.coalesce(a, F.lit(0.0)) for a in args]


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres; NULL if any argument is NULL (the clamp alone would turn NULL into 0).

    The arithmetic runs on values that can't be null, with one test in front. With a null check at every
    step three distances would make a method too long for the JVM to compile.
    """
    known, (lat1, lon1, lat2, lon2) = solid(*map(_c, (lat1, lon1, lat2, lon2)))
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    d = 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))
    return F.when(known, d)


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Equirectangular metres east and north of (lat0, lon0)."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    x = F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0))
    return x, F.radians(lat - lat0) * EARTH_RADIUS_M


def wrap_180(deg: Column) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(deg + 180, F.lit(360.0)) - 180


def wrap_360(deg: Column) -> Column:
    """A direction in [0, 360)."""
    return F.pmod(deg, F.lit(360.0))


def heading_deg(east, north) -> Column:
    """Direction of a velocity, degrees clockwise from north."""
    return wrap_360(F.degrees(F.atan2(_c(east), _c(north))))


def _utm_steps(central_meridian: float, south: bool):
    """The projection (series in the third flattening) in three steps, each a function of the step before."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    e = 2 * n**0.5 / (1 + n)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)

    def conformal(lat: Column, lon: Column) -> dict[str, Column]:
        known, (lat, lon) = solid(lat, lon)
        s = F.sin(F.radians(lat))
        holds = known & (F.abs(lat) <= 84) & (F.abs(lon - central_meridian) <= 80)
        return {"_t": F.sinh(F.atanh(s) - e * F.atanh(e * s)), "_l": F.radians(lon - central_meridian), "_holds": holds}

    def sphere(t: Column, lam: Column) -> dict[str, Column]:
        return {"_xi": F.atan2(t, F.cos(lam)), "_eta": F.atanh(F.sin(lam) / F.sqrt(1 + t * t))}

    def plane(xi: Column, eta: Column, holds: Column) -> tuple[Column, Column]:
        east, north = eta, xi
        for j, al in enumerate(alpha, 1):
            east = east + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.when(holds, 500000.0 + k0 * big_a * east), F.when(holds, (10_000_000.0 if south else 0.0) + k0 * big_a * north)

    return conformal, sphere, plane


def utm(lat, lon, central_meridian: float = 15.0, south: bool = True) -> tuple[Column, Column]:
    """WGS84 to transverse Mercator easting and northing.

    NULL where the projection does not hold: beyond 84 degrees of latitude, or 80 from the meridian.
    For tables see ``with_utm``, which computes the steps once.
    """
    conformal, sphere, plane = _utm_steps(central_meridian, south)
    first = conformal(_c(lat), _c(lon))
    second = sphere(first["_t"], first["_l"])
    return plane(second["_xi"], second["_eta"], first["_holds"])


def with_utm(df: DataFrame, central_meridian: float = 15.0, south: bool = True, east: str = "e", north: str = "n") -> DataFrame:
    """Adds the easting and northing of ``lat, lon``, as ``utm``."""
    conformal, sphere, plane = _utm_steps(central_meridian, south)
    d = settled(df, conformal(F.col("lat"), F.col("lon")))
    d = settled(d, sphere(F.col("_t"), F.col("_l")))
    x, y = plane(F.col("_xi"), F.col("_eta"), F.col("_holds"))
    return settled(d, {east: x, north: y}).drop("_t", "_l", "_xi", "_eta", "_holds")
