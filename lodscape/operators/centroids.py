"""Quadtree nodes with centroids, their errors, and what expanding a node gains for its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import dbl
from .pyramid import DEEP, deep_cells, levels

#: The benefit of what is always expanded.
MOST = 1.7976931348623157e308


def centroid_nodes(points: DataFrame, depth: int = DEEP, bottom: int | None = None) -> DataFrame:
    """``(level, ci, cj, cnt, x, y, error, children, child_error, child_mean)`` for each non-empty cell.

    ``x, y``: mean of the deepest cells' first points, weighted by their counts. ``error``: sum of the
    children's counts times their distance from it, 0 without children; ``child_error`` and ``child_mean``:
    the children's errors, and errors over counts, summed. No iteration: means are sums,
    and a cell's error needs only its at most four children.
    """
    cells = deep_cells(points, depth).withColumns({"wx": F.col("cnt") * F.col("first.mx"), "wy": F.col("cnt") * F.col("first.my")})
    each = levels(cells, depth, 0, bottom, wx=F.sum("wx"), wy=F.sum("wy"))
    each = each.select("level", "ci", "cj", "cnt", (F.col("wx") / F.col("cnt")).alias("x"), (F.col("wy") / F.col("cnt")).alias("y"))
    up = lambda: [(F.col("level") - 1).alias("level"), F.shiftright("ci", 1).alias("ci"), F.shiftright("cj", 1).alias("cj")]
    families = each.where("level > 0").groupBy(*up()).agg(F.array_sort(F.collect_list(F.struct("ci", "cj", "cnt", "x", "y"))).alias("family"))
    with_family = each.join(families, ["level", "ci", "cj"], "left")
    far = F.aggregate(
        F.coalesce("family", F.expr("cast(array() as array<struct<ci:bigint,cj:bigint,cnt:bigint,x:double,y:double>>)")),
        dbl(0),
        lambda a, c: a + c["cnt"] * F.sqrt((c["x"] - F.col("x")) * (c["x"] - F.col("x")) + (c["y"] - F.col("y")) * (c["y"] - F.col("y"))),
    )
    own = with_family.select("level", "ci", "cj", "cnt", "x", "y", F.when(F.col("cnt") > 1, far).otherwise(dbl(0)).alias("error"), F.coalesce(F.size("family"), F.lit(0)).alias("children"))
    below = own.where("level > 0").groupBy(*up()).agg(F.sum("error").alias("child_error"), F.sum(F.col("error") / F.col("cnt")).alias("child_mean"))
    return own.join(below, ["level", "ci", "cj"], "left").withColumns({c: F.coalesce(c, dbl(0)) for c in ("child_error", "child_mean")})


def is_leaf(depth: int) -> Column:
    return (F.col("cnt") == 1) | (F.col("level") == depth)


def distance_benefit(depth: int = DEEP) -> Column:
    """Error lost for each sample more; leaves 0, the top eight levels and single-child nodes always first."""
    cost = F.col("children") - 1
    return (
        F.when(is_leaf(depth), dbl(0))
        .when((F.col("level") < 8) | (cost == 0), dbl(MOST))
        .otherwise((F.col("error") - F.col("child_error") / dbl(4)) / cost)
    )


def screen_benefit(zoom: int, depth: int = DEEP) -> Column:
    """As :func:`distance_benefit`, with mean errors in squared pixels of a zoom; nothing below the pixel's level."""
    cost = F.col("children") - 1
    r = F.greatest(F.pow(dbl(2), F.lit(zoom + 8) - F.col("level")), dbl(1))
    rc = F.greatest(F.floor(r / 2).cast("double"), dbl(1))
    own, below = F.col("error") / F.col("cnt"), F.col("child_mean")
    return (
        F.when(is_leaf(depth), dbl(0))
        .when(F.col("level") < 8, dbl(MOST))
        .when(F.col("level") >= zoom + 8, dbl(0))
        .when(cost == 0, dbl(MOST))
        .otherwise((own * r * r - below * rc * rc / dbl(4)) / cost)
    )


def error_benefit(zoom: int, depth: int = DEEP) -> Column:
    """Image error at a zoom, weighted by the logarithm of the count, for each sample more (needs ``errors``)."""
    cost = F.col("children") - 1
    return (
        F.when(is_leaf(depth), dbl(0))
        .when((F.col("level") < 8) | (cost == 0), dbl(MOST))
        .otherwise(F.element_at("errors", zoom + 1) * F.ln(F.col("cnt").cast("double")) / cost)
    )


def plain_error_benefit(zoom: int, depth: int = DEEP) -> Column:
    """Image error at a zoom for each sample more, without regard to counts (needs ``errors``)."""
    cost = F.col("children") - 1
    return F.when(is_leaf(depth), dbl(0)).when(cost == 0, dbl(MOST)).otherwise(F.element_at("errors", zoom + 1) / cost)
