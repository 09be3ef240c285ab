"""Geometry on polylines stored as ``array<array<double>>`` of ``[lat, lon(, z)]``.

Lengths use the haversine formula on a sphere of radius 6 371 008.8 m and
angles a local equirectangular frame; both are plain column arithmetic, so no
per-row Python or projection library is involved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from railspark.functions.scalar import col_of

__all__ = ["EARTH_RADIUS_M", "lat_of", "lon_of", "z_of", "haversine_m", "point_distance_m",
           "path_length_m", "turning_angle", "point_key", "make_point", "flip_point"]

EARTH_RADIUS_M = 6_371_008.8


def lat_of(p) -> Column:
    return F.get(col_of(p), 0)


def lon_of(p) -> Column:
    return F.get(col_of(p), 1)


def z_of(p) -> Column:
    return F.get(col_of(p), 2)


def make_point(lat, lon, z=None) -> Column:
    parts = [col_of(lat).cast("double"), col_of(lon).cast("double")]
    if z is not None:
        parts.append(col_of(z).cast("double"))
    return F.array(*parts)


def flip_point(p, n: int | None = 6) -> Column:
    """``[a, b(, z)]`` -> ``[b, a(, z)]``, optionally rounded to ``n`` decimals."""
    p = col_of(p)
    a, b, z = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    if n is not None:
        a, b, z = F.round(a, n), F.round(b, n), F.round(z, n)
    return F.when(F.size(p) > 2, F.array(b, a, z)).otherwise(F.array(b, a))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col_of(c)) for c in (lat1, lon1, lat2, lon2))
    h = (F.pow(F.sin((lat2 - lat1) / 2), 2)
         + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def point_distance_m(p, q) -> Column:
    return haversine_m(lat_of(p), lon_of(p), lat_of(q), lon_of(q))


def path_length_m(path) -> Column:
    """Sum of the haversine lengths of consecutive points; 0 for fewer than 2 points."""
    path = col_of(path)
    n = F.size(path)
    return F.when(n < 2, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0),
                    lambda acc, i: acc + point_distance_m(F.get(path, i - 1), F.get(path, i))))


def _local_xy(p, ref_lat: Column):
    k = F.lit(math.pi / 180.0 * EARTH_RADIUS_M)
    return lon_of(p) * F.cos(F.radians(ref_lat)) * k, lat_of(p) * k


def turning_angle(prev, cur, nxt) -> Column:
    """Deviation angle in degrees at ``cur`` (0 = straight on); NULL when a side has zero length."""
    ref = lat_of(cur)
    x0, y0 = _local_xy(prev, ref)
    x1, y1 = _local_xy(cur, ref)
    x2, y2 = _local_xy(nxt, ref)
    ax, ay, bx, by = x1 - x0, y1 - y0, x2 - x1, y2 - y1
    na, nb = F.hypot(ax, ay), F.hypot(bx, by)
    cosv = (ax * bx + ay * by) / (na * nb)
    return F.when((na > 0) & (nb > 0),
                  F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosv)))))


def point_key(p, n: int = 6) -> Column:
    """Exact join key for a point: coordinates scaled to integers (never raw doubles)."""
    p = col_of(p)
    scale = F.lit(float(10 ** n))
    return F.struct(F.round(lat_of(p) * scale).cast("long").alias("klat"),
                    F.round(lon_of(p) * scale).cast("long").alias("klon"),
                    F.round(F.coalesce(z_of(p), F.lit(0.0)) * F.lit(100.0)).cast("long").alias("kz"))
