"""Reducers that draw points one after the other and keep those that change the picture.

The order of drawing is the order of arrival (``point_id``); pictures of different cells or tiles
are independent, so each is folded by itself (:func:`~lodscape.operators.render.folded`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import cell_meets, in_viewport
from ..functions.projection import cell, dbl, with_mercator
from ..functions.viewport import Viewport
from .pyramid import SHALLOW, placed, quadtree
from .render import DiscRenderer, cell_picture, folded


def drawn_points(points: DataFrame, v: Viewport, tile: int = 64, radius: int = 1) -> DataFrame:
    """``(point_id, x, y)``: points inside the viewport that change its picture when drawn in turn.

    The screen is cut into tiles, each of which draws all discs that reach into it, so a tile's own
    pixels see just what the whole screen's would; a point stays if it changes any tile.
    """
    x0, y0, x1, y1 = v.mercator
    p = with_mercator(points).where(in_viewport(F.col("mx"), F.col("my"), v))
    p = p.select("point_id", "mx", "my", ((F.col("mx") - dbl(x0)) * v.res_x / dbl(x1 - x0)).alias("sx"), ((F.col("my") - dbl(y0)) * v.res_y / dbl(y1 - y0)).alias("sy"))
    reach = radius + 1
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile).cast("long"), F.floor((F.col(c) + reach) / tile).cast("long"))
    tiled = p.withColumn("ti", F.explode(span("sx"))).withColumn("tj", F.explode(span("sy")))

    def picture(key: tuple) -> Callable[[float, float], bool]:
        wide, disc = tile + 4 * reach, DiscRenderer(radius)
        image, low = disc.blank(wide), 2 * reach + radius + 1
        own = image[low : low + tile, low : low + tile]
        cx, cy = (key[0] + 0.5) * tile, (key[1] + 0.5) * tile

        def change(sx: float, sy: float) -> bool:
            before = own.copy()
            disc.draw(image, cx, cy, wide / 2, wide, sx, sy)
            return bool((before != own).any())

        return change

    return folded(tiled, ["ti", "tj"], picture, ("sx", "sy")).select("point_id", F.col("mx").alias("x"), F.col("my").alias("y")).distinct()


def cell_samples(points: DataFrame, level: int, *, draw_with: str = "disc", depth: int = SHALLOW) -> DataFrame:
    """``(point_id, x, y, ci, cj)``: for each cell of a level, the points that change its one-pixel picture; all of them at the deepest level."""
    p = placed(points).withColumns({"ci": cell(F.col("mx"), level), "cj": cell(F.col("my"), level)})
    w = 2.0**-level
    p = p.select("point_id", "mx", "my", "ci", "cj")
    kept = p if level == depth else folded(p, ["ci", "cj"], cell_picture(lambda k: ((k[0] + 0.5) * w, (k[1] + 0.5) * w, w / 2), draw_with))
    return kept.select("point_id", F.col("mx").alias("x"), F.col("my").alias("y"), "ci", "cj")


def rendered_cells(points: DataFrame, v: Viewport, *, draw_with: str = "disc", depth: int = SHALLOW, samples_from: int = 3) -> DataFrame:
    """``(point_id, x, y)``: the samples of the pixel-sized cells that meet the viewport, and lone points above them.

    A cell above level ``samples_from`` keeps its first point only, as no drawing adds to it there.
    """
    level = min(8 + v.zoom, depth)
    nodes = quadtree(points, depth, level)
    ends = nodes.where(F.col("is_leaf") | (F.col("level") == level)).where(cell_meets(F.col("level"), F.col("ci"), F.col("cj"), v))
    lone = ends.where("cnt = 1").select(F.col("first.point_id").alias("point_id"), F.col("first.mx").alias("x"), F.col("first.my").alias("y"))
    crowded = ends.where("cnt > 1")
    if level < samples_from:
        return lone.union(crowded.select("first.point_id", "first.mx", "first.my"))
    return lone.union(cell_samples(points, level, draw_with=draw_with, depth=depth).join(crowded.select("ci", "cj"), ["ci", "cj"]).select("point_id", "x", "y"))
