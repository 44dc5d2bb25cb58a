"""The quadtree as a table: one row for each node that an incremental tree would have.

A cell of level l exists if l is 0 or its parent holds two points or more; it is a leaf if it holds
one point or lies at the deepest level. Points are summed in the deepest cells once, and every
coarser level is a roll-up of those, so raw rows are never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import cell, with_mercator

#: Deepest levels: of the error-driven trees and of the rendering trees.
DEEP, SHALLOW = 27, 19


def placed(points: DataFrame) -> DataFrame:
    """Points with a place in the unit square, half-open on its far sides."""
    return with_mercator(points).where("mx >= 0 and mx < 1 and my >= 0 and my < 1")


def deep_cells(points: DataFrame, depth: int = DEEP) -> DataFrame:
    """``(ci, cj, cnt, first)``: points in each deepest cell, and the one that came first."""
    p = placed(points)
    return p.groupBy(cell(F.col("mx"), depth).alias("ci"), cell(F.col("my"), depth).alias("cj")).agg(
        F.count("*").alias("cnt"), F.min(F.struct("point_id", "mx", "my")).alias("first")
    )


def levels(cells: DataFrame, depth: int, top: int = 0, bottom: int | None = None, **more: Column) -> DataFrame:
    """``(level, ci, cj, cnt, first, ...)`` for each non-empty cell of the levels top to bottom; ``more`` are further sums."""
    each = cells.withColumn("level", F.explode(F.sequence(F.lit(top), F.lit(depth if bottom is None else bottom))))
    keys = ["level", F.expr(f"shiftright(ci, {depth} - level)").alias("ci"), F.expr(f"shiftright(cj, {depth} - level)").alias("cj")]
    return each.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"), *[c.alias(k) for k, c in more.items()])


def real_nodes(all_levels: DataFrame, depth: int) -> DataFrame:
    """Those of ``all_levels`` (from level 0 on) that are nodes of the tree, with ``is_leaf``.

    A parent's count is the sum over its at most four children, so one grouping by parent decides.
    """
    fields = [c for c in all_levels.columns if c != "level"]
    families = (
        all_levels.where("level > 0")
        .groupBy((F.col("level") - 1).alias("up"), F.shiftright("ci", 1).alias("pi"), F.shiftright("cj", 1).alias("pj"))
        .agg(F.sum("cnt").alias("parent_cnt"), F.collect_list(F.struct(*fields)).alias("family"))
        .where("parent_cnt >= 2")
    )
    below = families.select((F.col("up") + 1).alias("level"), F.explode("family").alias("x")).select("level", "x.*")
    nodes = below.unionByName(all_levels.where("level = 0").select("level", *fields))
    return nodes.withColumn("is_leaf", (F.col("cnt") == 1) | (F.col("level") == depth))


def quadtree(points: DataFrame, depth: int = DEEP, bottom: int | None = None) -> DataFrame:
    """``(level, ci, cj, cnt, first, is_leaf)``: all nodes down to level ``bottom``."""
    return real_nodes(levels(deep_cells(points, depth), depth, 0, bottom), depth)


def load_statistics(points: DataFrame, depth: int = DEEP) -> DataFrame:
    """``(total, stored, skipped)``: all points, those kept, and those that found their deepest cell taken."""
    cells = deep_cells(points, depth)
    return cells.agg(F.sum("cnt").alias("total"), F.count("*").alias("stored")).select("total", "stored", (F.col("total") - F.col("stored")).alias("skipped"))


def level_counts(points: DataFrame, at: int, level: int, depth: int = SHALLOW) -> DataFrame:
    """``(ci, cj, samples)``: for each node of level ``at``, its non-empty cells of a deeper level."""
    fine = levels(deep_cells(points, depth), depth, level, level)
    return fine.groupBy(F.shiftright("ci", level - at).alias("ci"), F.shiftright("cj", level - at).alias("cj")).agg(F.count("*").alias("samples"))


def index_statistics(nodes: DataFrame) -> DataFrame:
    """``(level, nodes, points, least, most)`` for each level of a quadtree."""
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("cnt").alias("points"), F.min("cnt").alias("least"), F.max("cnt").alias("most"))


def index_histogram(nodes: DataFrame, width: int = 1, last: int = 100) -> DataFrame:
    """``(bucket, nodes)``: nodes by the number of their points, in buckets of a width; the last is open."""
    return nodes.groupBy(F.least(F.floor(F.col("cnt") / width), F.lit(last)).cast("long").alias("bucket")).agg(F.count("*").alias("nodes"))


def morton(ci: Column, cj: Column, bits: int = DEEP) -> Column:
    """Position along the Z-order curve: north-west, north-east, south-west, south-east."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        one = F.lit(1).cast("long")
        out = out + F.shiftleft(F.shiftright(ci, b).bitwiseAND(one), 2 * b) + F.shiftleft(F.shiftright(cj, b).bitwiseAND(one), 2 * b + 1)
    return out


def clustered(points: DataFrame, partitions: int, level: int = 16) -> DataFrame:
    """Points laid out by Z-order, so that files and row groups cover small rectangles and scans prune by ``mx, my``."""
    p = placed(points).withColumn("z", morton(cell(F.col("mx"), level), cell(F.col("my"), level), level))
    return p.repartitionByRange(partitions, "z").sortWithinPartitions("z")
