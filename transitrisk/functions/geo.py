"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius used for distances, and the
# web-mercator sphere radius, both in metres.
EARTH_RADIUS_M = 6371000.0
MERCATOR_RADIUS_M = 6378137.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    la1, lo1, la2, lo2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((la2 - la1) / 2), 2)
         + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def walk_seconds(metres, speed_mps: float = 1.0) -> Column:
    """Walking time in whole seconds (rounded up) at ``speed_mps``."""
    return F.ceil(_c(metres) / F.lit(float(speed_mps))).cast("int")


def mercator_x(lon) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(_c(lon))


def mercator_y(lat) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))


def isochrone_radius_m(t_end, t_arr, speed_mps: float = 1.0) -> Column:
    """Metres still walkable between arrival and the deadline (whole seconds)."""
    return (_c(t_end) - _c(t_arr)).cast("double") * F.lit(float(speed_mps))


def grid_shape(radius_m: float, max_abs_lat: float) -> tuple[float, int]:
    """Cell height in degrees and number of cells around a circle of latitude,
    so that any pair within ``radius_m`` lies in the same or a neighbouring
    cell (columns wrap at the antimeridian), valid up to ``max_abs_lat``.
    Near a pole one column goes around."""
    lat_deg = math.degrees(radius_m / EARTH_RADIUS_M)
    edge = abs(max_abs_lat) + lat_deg
    if edge >= 90.0:
        return lat_deg, 1
    return lat_deg, max(1, int(360.0 * math.cos(math.radians(edge)) / lat_deg))
