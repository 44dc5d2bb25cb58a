"""Discs on the ground as a tilted or turned view shows them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import dbl, smooth_edge, world

#: Less of a pixel than this is not drawn.
LEAST_ALPHA = 1e-6


def ground_matrices(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of :func:`viewport.pixel_matrix` what takes places on the ground to pixels, and its inverse."""
    there = matrix[np.ix_([0, 1, 3], [0, 1, 3])]
    return there, np.linalg.inv(there)


def through(m: np.ndarray, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """A place under a matrix of the plane, and what it was divided by: above 0 in front of the viewer."""
    row = lambda r: dbl(m[r, 0]) * x + dbl(m[r, 1]) * y + dbl(m[r, 2])
    return row(0) / row(2), row(1) / row(2), row(2)


def ground_xy(i: Column, j: Column, matrix: np.ndarray) -> tuple[Column, Column]:
    """The place on the ground, in world coordinates, that the centre of a pixel shows."""
    x, y, _ = through(ground_matrices(matrix)[1], i + 0.5, j + 0.5)
    return x, y


def disc_footprints(points: DataFrame, matrix: np.ndarray, zoom: float, width: int, height: int, radius: float = 1.0) -> DataFrame:
    """``(point_id, i, j, alpha)``: the pixels of a screen that show a disc of ``radius`` pixels of the zoom lying around each point.

    The square around a disc bounds its pixels; each of these is taken back to the ground, and how far it lies from the point
    there says how much of it is covered. So footprints turn into ellipses as the view tilts. Pixels off the screen, and
    points without a place, out of the world or behind the viewer, are left out. What a point gives is bounded by the screen.
    """
    there, back = ground_matrices(matrix)
    scale = 2.0**zoom
    x, y = world(F.col("lng"), F.col("lat"))
    reach = (radius + 0.5) / scale
    signs = F.array(*[F.struct(dbl(a * reach).alias("a"), dbl(b * reach).alias("b")) for a in (-1, 1) for b in (-1, 1)])
    corner = lambda o: F.struct(*[c.alias(n) for c, n in zip(through(there, F.col("wx") + o["a"], F.col("wy") + o["b"]), ("x", "y", "w"))])
    at = points.select("point_id", x.alias("wx"), y.alias("wy")).select("point_id", "wx", "wy", F.transform(signs, corner).alias("c"))
    ends = [f(F.col(f"c.{k}")).alias(n) for n, f, k in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"), ("w", F.array_min, "w"))]
    box = at.select("point_id", "wx", "wy", F.struct(*ends).alias("b"))
    span = lambda lo, hi, n: F.sequence(*[F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("int") for c in (lo, hi)])
    seen = F.expr(f"b.w > 0 and b.x1 >= 0 and b.x0 < {width} and b.y1 >= 0 and b.y0 < {height}")
    rows = box.select("point_id", "wx", "wy", "b", F.explode(F.when(seen, span(F.col("b.x0"), F.col("b.x1"), width))).alias("i"))
    pixels = rows.select("point_id", "wx", "wy", "i", F.explode(span(F.col("b.y0"), F.col("b.y1"), height)).alias("j"))
    gx, gy, _ = through(back, F.col("i") + 0.5, F.col("j") + 0.5)
    away = F.sqrt((gx - F.col("wx")) * (gx - F.col("wx")) + (gy - F.col("wy")) * (gy - F.col("wy"))) * scale
    drawn = pixels.select("point_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), smooth_edge(away, dbl(radius)).alias("alpha"))
    return drawn.where(F.col("alpha") > LEAST_ALPHA)
