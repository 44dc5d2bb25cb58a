"""Reducers that need no search: raw points, pixels, grid cells and first arrivals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import cell_meets, in_viewport
from ..functions.projection import dbl, with_mercator, x_lng, y_lat
from ..functions.viewport import Viewport
from .pyramid import DEEP, SHALLOW, quadtree


def raw_points(points: DataFrame, v: Viewport) -> DataFrame:
    """``(point_id, lng, lat)`` of every point strictly inside the wrapped viewport."""
    p = with_mercator(points)
    return p.where(in_viewport(p["mx"], p["my"], v)).select("point_id", "lng", "lat")


def pixel(x: Column, y: Column, v: Viewport) -> tuple[Column, Column]:
    """Pixel column and row in a viewport's rectangle, rows downwards from its north."""
    x0, y0, x1, y1 = v.mercator
    return F.floor((x - dbl(x0)) * v.res_x / dbl(x1 - x0)).cast("long"), F.floor((y - dbl(y0)) * v.res_y / dbl(y1 - y0)).cast("long")


def snapped(points: DataFrame, v: Viewport) -> DataFrame:
    """``points`` on the screen, with their pixel ``(i, j)``."""
    p = with_mercator(points)
    i, j = pixel(p["mx"], p["my"], v)
    return p.where(in_viewport(p["mx"], p["my"], v)).withColumns({"i": i, "j": j}).where(F.col("i").between(0, v.res_x - 1) & F.col("j").between(0, v.res_y - 1))


def pixel_points(points: DataFrame, v: Viewport) -> DataFrame:
    """``(i, j, point_id, lng, lat)``: the first point of each occupied pixel."""
    first = snapped(points, v).groupBy("i", "j").agg(F.min(F.struct("point_id", "lng", "lat")).alias("p"))
    return first.select("i", "j", "p.*")


def pixel_bitmap(points: DataFrame, v: Viewport) -> DataFrame:
    """``(i, j)`` of the occupied pixels."""
    return snapped(points, v).select("i", "j").distinct()


def centre_pixel(x: Column, y: Column, left: float, top: float, length: float) -> tuple[Column, Column]:
    """Pixel of a place in a node with a corner and a pixel's length, cut towards zero."""
    return ((x - dbl(left)) / dbl(length)).cast("int"), ((y - dbl(top)) / dbl(length)).cast("int")


def grid_level(v: Viewport) -> int:
    """The first level whose cells are no wider than a pixel."""
    return max(0, math.ceil(-math.log2(v.cell_scale)))


def frontier(nodes: DataFrame, v: Viewport, level: int) -> DataFrame:
    """Where a descent in a tree to ``level`` ends: leaves on the way, and cells of that level; only those that meet the viewport."""
    ends = nodes.where((F.col("level") == level) | ((F.col("level") < level) & F.col("is_leaf")))
    return ends.where(cell_meets(F.col("level"), F.col("ci"), F.col("cj"), v))


def grid_points(points: DataFrame, v: Viewport, depth: int = DEEP) -> DataFrame:
    """``(level, ci, cj, cnt, x, y)``: a lone point as itself, a crowded cell of the pixel's size as its centre."""
    return grid_of(quadtree(points, depth, min(grid_level(v), depth)), v, depth)


def grid_of(nodes: DataFrame, v: Viewport, depth: int = DEEP) -> DataFrame:
    """:func:`grid_points` from a tree of at least its depth."""
    w = F.pow(dbl(0.5), F.col("level"))
    single = F.col("is_leaf")
    x, y = F.when(single, F.col("first.mx")).otherwise((F.col("ci") + 0.5) * w), F.when(single, F.col("first.my")).otherwise((F.col("cj") + 0.5) * w)
    return frontier(nodes, v, min(grid_level(v), depth)).select("level", "ci", "cj", "cnt", x.alias("x"), y.alias("y"))


def grid_bitmap(points: DataFrame, v: Viewport, depth: int = DEEP) -> DataFrame:
    """``(i, j)`` of the pixels that :func:`grid_points` fall into."""
    g = grid_points(points, v, depth)
    i, j = pixel(g["x"], g["y"], v)
    return g.select(i.alias("i"), j.alias("j")).where(F.col("i").between(0, v.res_x - 1) & F.col("j").between(0, v.res_y - 1)).distinct()


def first_arrivals(points: DataFrame, v: Viewport, depth: int = SHALLOW) -> DataFrame:
    """``(level, ci, cj, cnt, point_id, x, y)``: the first point of every cell of the pixel's level, and lone points above it."""
    return arrivals_of(quadtree(points, depth, min(8 + v.zoom, depth)), v, depth)


def arrivals_of(nodes: DataFrame, v: Viewport, depth: int = SHALLOW) -> DataFrame:
    """:func:`first_arrivals` from a tree of at least its depth."""
    ends = frontier(nodes, v, min(8 + v.zoom, depth))
    return ends.select("level", "ci", "cj", "cnt", F.col("first.point_id").alias("point_id"), F.col("first.mx").alias("x"), F.col("first.my").alias("y"))


def stop_levels(points: DataFrame, v: Viewport, depth: int = SHALLOW) -> DataFrame:
    """``(level, nodes, points)``: where a query's descents end."""
    return first_arrivals(points, v, depth).groupBy("level").agg(F.count("*").alias("nodes"), F.sum("cnt").alias("points"))


def heatmap(points: DataFrame, v: Viewport, radius: int = 25, weight: float = 10.0, max_zoom: int = 18, most: float = 1.0) -> DataFrame:
    """``(gx, gy, x, y, w)``: weighted centres of half-radius squares of the screen, their weight capped."""
    size = radius / 2
    x0, y0, x1, y1 = v.mercator
    p = with_mercator(points)
    p = p.where(in_viewport(p["mx"], p["my"], v)).withColumns(
        {"sx": (F.col("mx") - dbl(x0)) * v.res_x / dbl(x1 - x0), "sy": (F.col("my") - dbl(y0)) * v.res_y / dbl(y1 - y0)}
    )
    each = dbl(weight * 2.0 ** -max(0, min(max_zoom - v.zoom, 12)))
    g = p.groupBy(F.floor(F.col("sx") / size).cast("long").alias("gx"), F.floor(F.col("sy") / size).cast("long").alias("gy"))
    return g.agg(F.avg("sx").alias("x"), F.avg("sy").alias("y"), F.least(F.count("*") * each, dbl(most)).alias("w"))


def to_degrees(reduced: DataFrame) -> DataFrame:
    """Unit-square ``x, y`` as ``lng, lat``."""
    return reduced.withColumns({"lng": x_lng(F.col("x")), "lat": y_lat(F.col("y"))})


def visual_error(full: DataFrame, reduced: DataFrame, v: Viewport) -> DataFrame:
    """``(pixels_full, pixels_reduced, error)``: pixels that are set in only one of two point sets' images."""
    a, b = pixel_bitmap(full, v).withColumn("a", F.lit(1)), pixel_bitmap(reduced, v).withColumn("b", F.lit(1))
    return a.join(b, ["i", "j"], "full").agg(
        F.count("a").alias("pixels_full"), F.count("b").alias("pixels_reduced"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("error")
    )
