"""Boxes, areas and the closed-form projections, as expressions and plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadBox, OutOfRange, need

#: Fixed value: mean radius of the Earth in metres, for spherical formulas.
EARTH = 6371008.8


def validate_box(box) -> tuple[float, float, float, float]:
    """Corners in order (xmin, ymin, xmax, ymax), in degrees; raises ``BadBox``."""
    need(len(box) == 4 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in box), BadBox, "a box is four numbers")
    x0, y0, x1, y1 = map(float, box)
    need(x0 != x1 and y0 != y1, BadBox, "the box has no area")
    out = (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))
    need(-180 <= out[0] and out[2] <= 180 and -90 <= out[1] and out[3] <= 90, BadBox, "longitudes or latitudes are out of range")
    return out


def ordered_box(box: Column) -> Column:
    """An array column of corners in order (xmin, ymin, xmax, ymax); NULL where ``validate_box`` would raise."""
    x0, y0, x1, y1 = (F.get(box, i).cast("double") for i in range(4))
    out = F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    fits = (F.size(box) == 4) & (x0 != x1) & (y0 != y1) & (F.get(out, 0) >= -180) & (F.get(out, 2) <= 180) & (F.get(out, 1) >= -90) & (F.get(out, 3) <= 90)
    return F.when(fits, out)


def extend_box(box, dx: float = 0.0, dy: float = 0.0) -> tuple[float, float, float, float]:
    return (box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy)


def box_wkt(box: Column) -> Column:
    """POLYGON text of an (xmin, ymin, xmax, ymax) array."""
    x0, y0, x1, y1 = (F.get(box, i).cast("string") for i in range(4))
    corner = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    points = F.concat_ws(", ", *(F.concat_ws(" ", a, b) for a, b in corner))
    return F.concat(F.lit("POLYGON (("), points, F.lit("))"))


def sphere_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a longitude-latitude rectangle on the unit sphere; 0 where it is empty."""
    width = F.greatest(F.radians(x1) - F.radians(x0), F.lit(0.0))
    return width * F.greatest(F.sin(F.radians(y1)) - F.sin(F.radians(y0)), F.lit(0.0))


def coverage(box: Column, other) -> Column:
    """Share of the fixed box ``other`` that the array column ``box`` covers."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in other)
    b = [F.get(box, i) for i in range(4)]
    both = sphere_area(F.greatest(b[0], x0), F.greatest(b[1], y0), F.least(b[2], x1), F.least(b[3], y1))
    return both / sphere_area(x0, y0, x1, y1)


def utm_zone(lon: float, rounded: bool = False) -> int:
    """UTM zone of a longitude; ``rounded`` gives the nearest-boundary variant kept for compatibility."""
    need(-180 <= lon <= 180, OutOfRange, "longitude out of range")
    zone = round((180 + lon) / 6) if rounded else int((lon + 180) // 6) + 1
    return min(max(zone, 1), 60)


def projection_for(box, kind: str = "laea", ellps: str = "WGS84", rounded_zone: bool = False, specific: str | None = None) -> str:
    """A projection string centred on the box (laea, aeqd, utm, pconic or eqdc), or a ``specific`` one as it is given.

    The conic ones touch the box's upper and lower edge.
    """
    if specific is not None:
        need("+proj=longlat" not in specific and "+proj=latlong" not in specific and specific.strip().upper() != "EPSG:4326", OutOfRange, "not a projected system")
        return specific
    x0, y0, x1, y1 = validate_box(box)
    lon, lat = (x0 + x1) / 2, (y0 + y1) / 2
    if kind in ("laea", "aeqd"):
        return f"+proj={kind} +lon_0={lon:.12g} +lat_0={lat:.12g} +ellps={ellps} +no_defs"
    if kind == "utm":
        return f"+proj=utm +zone={utm_zone(lon, rounded_zone)}{' +south' if lat < 0 else ''} +ellps={ellps} +no_defs"
    if kind in ("pconic", "eqdc"):
        low, high = y1, y0
        return f"+proj={kind} +lon_0={lon:.12g} +lat_0={lat:.12g} +lat_1={low:.12g} +lat_2={high:.12g} +ellps={ellps} +no_defs"
    raise OutOfRange(f"unknown projection {kind}")


def laea(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area coordinates in metres."""
    p, l, p0 = F.radians(lat), F.radians(lon - lon0), math.radians(lat0)
    k = F.sqrt(2 / (1 + math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(l)))
    x = EARTH * k * F.cos(p) * F.sin(l)
    y = EARTH * k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(l))
    return x, y


def aeqd(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Spherical azimuthal equidistant coordinates in metres."""
    p, l, p0 = F.radians(lat), F.radians(lon - lon0), math.radians(lat0)
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(l))))
    k = F.when(c == 0, F.lit(1.0)).otherwise(c / F.sin(c))
    x = EARTH * k * F.cos(p) * F.sin(l)
    y = EARTH * k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(l))
    return x, y


def laea_inverse(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Longitude and latitude of spherical Lambert azimuthal equal-area coordinates; NULL beyond the globe."""
    p0 = math.radians(lat0)
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(F.when(rho <= 2 * EARTH, rho / (2 * EARTH)))
    return _azimuthal_inverse(x, y, rho, c, lon0, p0)


def aeqd_inverse(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Longitude and latitude of spherical azimuthal equidistant coordinates; NULL beyond the globe."""
    rho = F.sqrt(x * x + y * y)
    return _azimuthal_inverse(x, y, rho, F.when(rho <= math.pi * EARTH, rho / EARTH), lon0, math.radians(lat0))


def _azimuthal_inverse(x: Column, y: Column, rho: Column, c: Column, lon0: float, p0: float) -> tuple[Column, Column]:
    near = rho == 0
    lat = F.when(near, F.lit(math.degrees(p0))).otherwise(F.degrees(F.asin(F.cos(c) * math.sin(p0) + F.try_divide(y * F.sin(c) * math.cos(p0), rho))))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), rho * math.cos(p0) * F.cos(c) - y * math.sin(p0) * F.sin(c)))
    return F.when(c.isNotNull(), lon), F.when(c.isNotNull(), lat)


FORWARD, INVERSE = {"laea": laea, "aeqd": aeqd}, {"laea": laea_inverse, "aeqd": aeqd_inverse}


def projected_box(box: Column, kind: str, lon0: float, lat0: float, edge: int = 21) -> Column:
    """Extent of a longitude-latitude box (an array column) in a projection, from points along its edges, as an array."""
    need(kind in FORWARD and edge >= 2, OutOfRange, f"a projection is one of {sorted(FORWARD)}, with two points on an edge at least")
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    shares = [i / (edge - 1) for i in range(edge)]
    points = [(x0 + (x1 - x0) * s, y) for s in shares for y in (y0, y1)] + [(x, y0 + (y1 - y0) * s) for s in shares[1:-1] for x in (x0, x1)]
    placed = [FORWARD[kind](lon, lat, lon0, lat0) for lon, lat in points]
    xs, ys = (F.array(*(p[k] for p in placed)) for k in (0, 1))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
