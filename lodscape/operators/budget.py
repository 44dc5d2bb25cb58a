"""Samples of a wished size or share: per pixel cell, at random, or by how much detail a cell holds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import bernoulli, cell_meets
from ..functions.projection import cell, dbl
from ..functions.viewport import Viewport
from .best_first import DEFAULT_BUDGET
from .pyramid import SHALLOW, deep_cells, levels, placed
from .render import cell_picture, folded


def exact_level(v: Viewport) -> int:
    """The level whose cells are a pixel wide, 18 at most."""
    return min(math.ceil(math.log2(1 / v.pixel_scale)), 18)


def detail(points: DataFrame, level: int, depth: int = SHALLOW) -> DataFrame:
    """``(level, ci, cj, exact, first)`` of every cell down to a level; ``exact``: its non-empty cells of that level."""
    fine = levels(deep_cells(points, depth), depth, level, level).drop("level").withColumn("cnt", F.lit(1).cast("long"))
    return levels(fine, level).withColumnRenamed("cnt", "exact")


def topmost(cells: DataFrame, most: float) -> DataFrame:
    """The cells with ``exact`` up to a limit whose parents are beyond it: a cut through the tree."""
    fields = [c for c in cells.columns if c != "level"]
    families = (
        cells.where("level > 0")
        .groupBy((F.col("level") - 1).alias("up"), F.shiftright("ci", 1).alias("pi"), F.shiftright("cj", 1).alias("pj"))
        .agg(F.sum("exact").alias("above"), F.collect_list(F.struct(*fields)).alias("family"))
        .where(F.col("above") > most)
    )
    below = families.select((F.col("up") + 1).alias("level"), F.explode("family").alias("x")).select("level", "x.*")
    return below.unionByName(cells.where("level = 0").select("level", *fields)).where(F.col("exact") <= most)


def percentage_sample(points: DataFrame, v: Viewport, percent: int, depth: int = SHALLOW, seed: int = 7) -> DataFrame:
    """``(level, ci, cj, exact, point_id, x, y)``: about ``percent`` % (1 to 99) of what an exact answer shows.

    A descent stops at the first cell that holds so little detail that one sample is the wished share
    of it, and keeps that sample with the probability that makes the share right. A cell's fate depends
    on its own and its parent's detail alone, so no search is needed.
    """
    if not 1 <= percent <= 99:
        raise ValueError("a share of 1 to 99 percent")
    share = percent / 100
    ends = topmost(detail(points, exact_level(v), depth), 1 / share).where(cell_meets(F.col("level"), F.col("ci"), F.col("cj"), v))
    kept = ends.where(bernoulli(F.col("first.point_id"), dbl(share) * F.col("exact"), seed))
    return kept.select("level", "ci", "cj", "exact", F.col("first.point_id").alias("point_id"), F.col("first.mx").alias("x"), F.col("first.my").alias("y"))


def pixel_cells(points: DataFrame, v: Viewport) -> DataFrame:
    """``(ci, cj, point_id, x, y)``: points in the pixel-sized cells that meet the viewport."""
    level = min(8 + v.zoom, SHALLOW)
    p = placed(points).select(cell(F.col("mx"), level).alias("ci"), cell(F.col("my"), level).alias("cj"), "point_id", F.col("mx").alias("x"), F.col("my").alias("y"))
    return p.where(cell_meets(F.lit(level), F.col("ci"), F.col("cj"), v))


def stratified_sample(samples: DataFrame, budget: int, seed: int = 7) -> DataFrame:
    """Of ``(ci, cj, point_id, ...)`` about ``budget`` rows, some from every cell: all if they are few enough,
    at least one and in proportion for the rest, or one from a share of the cells if there are more cells than that."""
    n = samples.groupBy("ci", "cj").agg(F.count("*").alias("n"))
    total, strata = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if total <= budget:
        return samples
    order = F.row_number().over(Window.partitionBy("ci", "cj").orderBy("point_id"))
    if strata > budget:
        first = samples.groupBy("ci", "cj").agg(F.min("point_id").alias("point_id")).where(bernoulli(F.col("point_id"), budget / strata, seed))
        return samples.join(first, ["ci", "cj", "point_id"], "left_semi")
    quota = F.floor(dbl((budget - strata) / (total - strata)) * (F.col("n") - 1) + dbl(0.5)) + 1
    return samples.withColumn("_at", order).join(n, ["ci", "cj"]).where(F.col("_at") <= quota).drop("_at", "n")


def random_sample(samples: DataFrame, budget: int, seed: int = 7) -> DataFrame:
    """About ``budget`` of the rows, each with the same probability."""
    total = samples.count()
    return samples if total <= budget else samples.where(bernoulli(F.col("point_id"), budget / total, seed))


def traversal_sample(points: DataFrame, v: Viewport, percent: int, *, draw_with: str = "snap", depth: int = SHALLOW) -> DataFrame:
    """``(point_id, x, y)``: as :func:`percentage_sample` on lists of samples, of which a prefix is kept without chance.

    A cell's list holds the points that change its one-pixel picture. A descent stops where the list
    is the wished share of the cell's detail, or at pixel-sized cells and lone points.
    """
    share, level = percent / 100, exact_level(v)
    cells = detail(points, level, depth)
    each = placed(points).select("point_id", "mx", "my").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(level))))
    for c, m in (("ci", "mx"), ("cj", "my")):
        each = each.withColumn(c, F.floor(F.col(m) * F.pow(dbl(2), F.col("level"))).cast("long"))

    lists = folded(each, ["level", "ci", "cj"], cell_picture(lambda k: ((k[1] + 0.5) * 2.0 ** -k[0], (k[2] + 0.5) * 2.0 ** -k[0], 2.0 ** -k[0] / 2), draw_with))
    lists = lists.withColumn("at", F.row_number().over(Window.partitionBy("level", "ci", "cj").orderBy("point_id")))
    sized = lists.groupBy("level", "ci", "cj").agg(F.count("*").alias("n")).join(cells, ["level", "ci", "cj"])
    sized = sized.withColumn("share", F.least(F.col("n") / F.col("exact"), dbl(1)))
    final = (F.col("share") >= share) | (F.col("level") == level)
    # the first final cell on each path: every final cell names those below it
    below = sized.where(final).select("level", "ci", "cj", "n", "share")
    ups = below.select("*", F.explode(F.expr("filter(transform(sequence(0, level), u -> struct(u as l, shiftright(ci, level - u) as i, shiftright(cj, level - u) as j)), x -> x.l < level)")).alias("u"))
    shadowed = ups.join(below.select(F.col("level").alias("l"), F.col("ci").alias("i"), F.col("cj").alias("j")), (F.col("u.l") == F.col("l")) & (F.col("u.i") == F.col("i")) & (F.col("u.j") == F.col("j")), "left_semi")
    ends = below.join(shadowed.select("level", "ci", "cj").distinct(), ["level", "ci", "cj"], "left_anti").where(cell_meets(F.col("level"), F.col("ci"), F.col("cj"), v))
    quota = F.greatest(F.lit(1), F.floor(F.col("n") * share / F.greatest(F.col("share"), dbl(share))))
    return lists.join(ends, ["level", "ci", "cj"]).where(F.col("at") <= quota).select("point_id", F.col("mx").alias("x"), F.col("my").alias("y"))


def perfect_size(cells: DataFrame, v: Viewport) -> DataFrame:
    """``cells`` plus ``wanted``: a cell's detail times the share of it that the viewport shows, rounded."""
    x0, y0, x1, y1 = v.mercator
    w = F.pow(dbl(0.5), F.col("level"))
    shown = lambda c, lo, hi: F.greatest(dbl(0), F.least((F.col(c) + 1) * w, dbl(hi)) - F.greatest(F.col(c) * w, dbl(lo)))
    return cells.withColumn("wanted", F.floor(F.col("exact") * (shown("ci", x0, x1) * shown("cj", y0, y1) / (w * w)) + dbl(0.5)).cast("long"))


def proportional_size(part: Column, whole: Column, budget: int) -> Column:
    """A part's share of a budget, at least 1 unless it is empty."""
    return F.when(part == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.floor(part / whole * budget + dbl(0.5)), F.lit(1)).cast("long"))


def last_samples(samples: Column, k: Column) -> Column:
    """The last k of a list, null if it has fewer."""
    return F.when((F.size(samples) >= k) & (k > 0), F.slice(samples, F.size(samples) - k + 1, k))


def sampled(points: DataFrame, v: Viewport, *, budget: int = 0, percent: int = 0, method: str = "stratified", exact: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The sampling that a query asks for: a budget by a method, else a share, else everything an exact answer shows."""
    if budget > 0:
        own = pixel_cells(points, v)
        return random_sample(own, budget) if method == "random" else stratified_sample(own, budget)
    if 1 <= percent <= 99:
        return traversal_sample(points, v, percent)
    return exact() if exact else stratified_sample(pixel_cells(points, v), DEFAULT_BUDGET)
