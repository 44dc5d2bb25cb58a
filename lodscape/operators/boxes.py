"""A quadtree of boxes whose cells split when they hold too many, as a table.

A box belongs to the smallest cell that holds it, as long as that cell is there: a cell splits if more boxes than its
capacity lie within it and it isn't at the deepest level. So a box stays at the first cell on its way down
that doesn't split, or whose children would cut it. Which cells split are counts by cell, no insertion in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boxes that a cell holds before it splits, and the deepest level.
CAPACITY, DEPTH = 6, 6


def _cell_of(low: Column, high: Column, level: Column) -> Column:
    """The index of the level's cell that holds an interval of the unit square as a whole, null if none does. Both its edges
    belong to a cell, but an interval that begins at an edge looks for its place in the cell before it."""
    n = F.pow(F.lit(2.0), level)
    first = F.greatest(F.ceil(low * n) - 1, F.lit(0)).cast("long")
    return F.when((low >= 0) & (high <= 1) & (high * n <= first + 1), first)


def box_tree(boxes: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """``boxes`` ``(x0, y0, x1, y1, ...)`` in the unit square with the cell ``(level, ci, cj)`` that keeps each.

    Boxes that reach out of the square stay at the root, as do all while there are no more than its capacity; boxes with a
    null side are left out. Boxes on a boundary between two cells stay at their parent.
    """
    known = [c for c in boxes.columns if c not in ("level", "ci", "cj")]
    held = boxes.select(*known).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").withColumn("_id", F.monotonically_increasing_id())
    path = F.transform(
        F.sequence(F.lit(0), F.lit(depth)),
        lambda u: F.struct(u.alias("level"), F.when(u == 0, F.lit(0)).otherwise(_cell_of(F.col("x0"), F.col("x1"), u)).cast("long").alias("ci"), F.when(u == 0, F.lit(0)).otherwise(_cell_of(F.col("y0"), F.col("y1"), u)).cast("long").alias("cj")),
    )
    fits = F.filter(path, lambda p: p["ci"].isNotNull() & p["cj"].isNotNull())
    # cells that hold a box are those of levels 0 to its deepest one, so the deepest tells all
    deepest = held.withColumn("_fit", F.element_at(fits, -1)).select("*", F.col("_fit.level").alias("_level"), F.col("_fit.ci").alias("_ci"), F.col("_fit.cj").alias("_cj")).drop("_fit")
    counts = deepest.groupBy("_level", "_ci", "_cj").agg(F.count("*").alias("n"))
    ups = counts.select("n", F.explode(F.expr("transform(sequence(0, _level), u -> named_struct('level', u, 'ci', shiftright(_ci, _level - u), 'cj', shiftright(_cj, _level - u)))")).alias("c")).select("n", "c.*")
    split = ups.groupBy("level", "ci", "cj").agg(F.sum("n").alias("n")).where((F.col("n") > capacity) & (F.col("level") < depth)).select("level", "ci", "cj")
    # a cell is there if all cells above it split; as they hold all its boxes, they do if its parent does
    last = split.select((F.col("level") + 1).alias("level"), F.explode(F.array(*[F.struct((F.col("ci") * 2 + a).alias("ci"), (F.col("cj") * 2 + b).alias("cj")) for a in (0, 1) for b in (0, 1)])).alias("c")).select("level", "c.*")
    ways = counts.select("_level", "_ci", "_cj", F.explode(F.expr("transform(sequence(1, greatest(_level, 1)), u -> named_struct('level', u, 'ci', shiftright(_ci, greatest(_level - u, 0)), 'cj', shiftright(_cj, greatest(_level - u, 0))))")).alias("c")).where("c.level <= _level").select("_level", "_ci", "_cj", "c.*")
    kept = ways.join(last, ["level", "ci", "cj"], "left_semi").groupBy("_level", "_ci", "_cj").agg(F.max("level").alias("level"))
    placed = deepest.join(kept, ["_level", "_ci", "_cj"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    up = lambda c: F.expr(f"shiftright({c}, _level - level)")
    return placed.withColumns({"ci": up("_ci"), "cj": up("_cj")}).select(*known, "level", "ci", "cj")


def candidates(tree: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes of cells that a closed rectangle touches, from the root down: those that may overlap it."""
    w = F.pow(F.lit(0.5), F.col("level"))
    touch = (F.col("ci") * w <= x1) & ((F.col("ci") + 1) * w >= x0) & (F.col("cj") * w <= y1) & ((F.col("cj") + 1) * w >= y0)
    return tree.where((F.col("level") == 0) | touch)


def overlapping(tree: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes that overlap a closed rectangle; touching counts."""
    return candidates(tree, x0, y0, x1, y1).where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
