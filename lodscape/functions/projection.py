"""Map projections and small geometry, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours of a point and of the background, and the widths of a map tile.
POINT_RGB, BACKGROUND_RGB = (0, 0, 255), (221, 221, 221)
TILE, WORLD_TILE = 256, 512


def dbl(v: float) -> Column:
    return F.lit(float(v))


def lng_x(lng: Column) -> Column:
    """Longitude -> x in the unit square."""
    return lng / dbl(360) + dbl(0.5)


def lat_y(lat: Column) -> Column:
    """Latitude -> y in the unit square, downwards; the poles are its edges."""
    s = F.sin(F.radians(lat))
    y = dbl(0.5) - dbl(0.25) * F.ln((1 + s) / (1 - s)) / dbl(math.pi)
    inner = F.when((s < 1) & (s > -1), F.least(dbl(1), F.greatest(dbl(0), y)))
    return F.when(lat.isNull(), F.lit(None).cast("double")).when((lat >= 90) | (s >= 1), dbl(0)).when((lat <= -90) | (s <= -1), dbl(1)).otherwise(inner)


def x_lng(x: Column) -> Column:
    return (x - dbl(0.5)) * dbl(360)


def y_lat(y: Column) -> Column:
    return dbl(360) * F.atan(F.exp((dbl(180) - dbl(360) * y) * dbl(math.pi / 180))) / dbl(math.pi) - dbl(90)


def wrap_lng(lng: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lng + dbl(180), dbl(360)) - dbl(180)


def clamp_lat(lat: Column) -> Column:
    return F.least(dbl(90), F.greatest(dbl(-90), lat))


def lng_x_of(lng: float) -> float:
    return lng / 360 + 0.5


def lat_y_of(lat: float) -> float:
    if abs(lat) >= 90:
        return 0.0 if lat > 0 else 1.0
    s = math.sin(math.radians(lat))
    return min(1.0, max(0.0, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi))


def with_mercator(points: DataFrame) -> DataFrame:
    """``points`` plus ``mx, my``; rows without a place are dropped."""
    return points.where("lng is not null and lat is not null").withColumns({"mx": lng_x(F.col("lng")), "my": lat_y(F.col("lat"))})


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def left_below(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax < bx) & (ay < by)


def right_above(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax > bx) & (ay > by)


def cell(v: Column, level: int | Column) -> Column:
    """Index of the quadtree cell at a level that holds a coordinate of the unit square."""
    scale = F.shiftleft(F.lit(1).cast("long"), level) if isinstance(level, int) else F.expr("1").cast("long") * F.pow(F.lit(2.0), level).cast("long")
    return F.floor(v * scale.cast("double")).cast("long")


def smooth_step(edge0: Column, edge1: Column, x: Column) -> Column:
    t = F.least(dbl(1), F.greatest(dbl(0), (x - edge0) / (edge1 - edge0)))
    return F.when(x <= edge0, dbl(0)).when(x >= edge1, dbl(1)).otherwise(t * t * (dbl(3) - dbl(2) * t))


def smooth_edge(edge: Column, x: Column) -> Column:
    """How much of a pixel at distance ``edge`` a disc of radius ``x`` covers: the edge is one pixel wide."""
    return smooth_step(edge - dbl(0.5), edge + dbl(0.5), x)


def blend(source: Column, alpha: Column, target: Column) -> Column:
    return (source * alpha + target * (dbl(1) - alpha)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    return (dbl(0.3) * r + dbl(0.59) * g + dbl(0.11) * b).cast("int")


def node_resolution(zoom: int, level: Column) -> Column:
    """Pixels along a side of a node at a zoom; 1 at level 9 + zoom, by ties rounded up, and 0 below."""
    return F.floor(F.pow(dbl(2), F.lit(8 + zoom) - level) + dbl(0.5)).cast("long")


def world(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Pixel coordinates of the whole world on one 512-pixel tile, y upwards; null outside its range."""
    ok = (lng >= -180) & (lng <= 180) & (lat >= -90) & (lat <= 90)
    x = dbl(WORLD_TILE) * (F.radians(lng) + dbl(math.pi)) / dbl(2 * math.pi)
    y = dbl(WORLD_TILE) * (dbl(math.pi) + F.ln(F.tan(dbl(math.pi / 4) + F.radians(lat) / 2))) / dbl(2 * math.pi)
    return F.when(ok, x), F.when(ok, y)


def id_rgb(point_id: Column) -> tuple[Column, Column, Column]:
    """A point's id as a colour for picking; ids up to 2^24 - 1."""
    return F.shiftright(point_id, 16).bitwiseAND(F.lit(255)), F.shiftright(point_id, 8).bitwiseAND(F.lit(255)), point_id.bitwiseAND(F.lit(255))


def rgb_id(r: Column, g: Column, b: Column) -> Column:
    return r * 65536 + g * 256 + b
