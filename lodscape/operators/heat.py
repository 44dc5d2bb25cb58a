"""A heat picture: weights of pixels, spread by a soft disc in two passes over a sparse grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.viewport import Viewport
from .reducers import snapped


def stencil(radius: int, blur: int) -> list[float]:
    """Weights by distance 0, 1, ... of one direction: a bell that is 1 in the middle and falls to an eighth at ``radius``, cut at
    ``radius + blur``. Its product in both directions is round."""
    fall = math.log(8) / radius**2
    return [math.exp(-fall * d * d) for d in range(radius + blur + 1)]


def spread(cells: DataFrame, along: str, across: str, weights: list[float], size: int) -> DataFrame:
    """``(along, across, w)``: each cell's weight given to its neighbours in one direction, those outside of ``0 .. size - 1`` left out."""
    reach = len(weights) - 1
    by_distance = F.array(*map(F.lit, weights))
    each = cells.select(along, across, "w", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
    given = each.select((F.col(along) + F.col("d")).alias(along), across, (F.col("w") * F.element_at(by_distance, F.abs("d") + 1)).alias("w"))
    return given.where(F.col(along).between(0, size - 1)).groupBy(along, across).agg(F.sum("w").alias("w"))


def heat_picture(points: DataFrame, v: Viewport, radius: int = 25, blur: int = 15, weight: float = 10.0, max_zoom: int = 18, most: float = 1.0) -> DataFrame:
    """``(i, j, heat)`` of the pixels that any point of the viewport warms, from 0 to 1.

    A pixel's points weigh ``weight`` each, halved for each zoom up to 12 below ``max_zoom``, together ``most`` at most. The soft disc
    is a product, so it is spread along columns first and rows then: a pixel meets 2 (radius + blur) + 1 neighbours twice and
    not their square. Heat adds up and is cut at ``most``. Rows grow with occupied pixels, so with the screen and not the points.
    """
    each = weight * 2.0 ** -max(0, min(max_zoom - v.zoom, 12))
    weights = stencil(radius, blur)
    pixels = snapped(points, v).groupBy("i", "j").agg(F.least(F.count("*") * F.lit(each), F.lit(most)).alias("w"))
    warm = spread(spread(pixels, "i", "j", weights, v.res_x), "j", "i", weights, v.res_y)
    return warm.select("i", "j", F.least(F.col("w"), F.lit(most)).alias("heat"))
