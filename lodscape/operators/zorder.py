"""Rectangles as a few intervals of the Z-order curve, and tables that scans prune by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import in_viewport, rectangles
from ..functions.viewport import Viewport
from .pyramid import clustered

#: Intervals of a cover at most: each is a comparison in the scan's predicate.
MOST_INTERVALS = 64

Rectangle = tuple[float, float, float, float]


def z_of(ci: int, cj: int, bits: int) -> int:
    """Position of a cell along the Z-order curve, as :func:`pyramid.morton` gives it for columns."""
    return sum((ci >> b & 1) << 2 * b | (cj >> b & 1) << 2 * b + 1 for b in range(bits))


def cells_met(r: Rectangle, level: int) -> tuple[int, int, int, int]:
    """First and last column and row of a level's cells that a closed rectangle of the unit square touches."""
    n = 1 << level
    low, high = (lambda v: max(0, -(-v * n // 1) - 1)), (lambda v: min(n - 1, v * n // 1))
    return int(low(r[0])), int(low(r[1])), int(high(r[2])), int(high(r[3]))


def cover(rects: list[Rectangle], level: int, most: int | None = MOST_INTERVALS) -> list[tuple[int, int]]:
    """Sorted disjoint intervals (both ends included) of a level's Z-order positions that hold every cell a rectangle touches.

    Cells are split from the root down, as long as they lie partly outside and there are few enough pieces; then
    intervals with the smallest gaps between them are joined until there are ``most``. Without ``most`` no other cell is covered.
    """
    found: list[tuple[int, int]] = []
    for r in rects:
        i0, j0, i1, j1 = cells_met(r, level)
        if i0 > i1 or j0 > j1:
            continue
        partly = [(0, 0)]
        for depth in range(level + 1):
            side, rest = 1 << (level - depth), []
            for ci, cj in partly:
                left, top = ci * side, cj * side
                if left > i1 or top > j1 or left + side - 1 < i0 or top + side - 1 < j0:
                    continue
                whole = left >= i0 and top >= j0 and left + side - 1 <= i1 and top + side - 1 <= j1
                if whole or depth == level:
                    z = z_of(ci, cj, depth) * side * side
                    found.append((z, z + side * side - 1))
                else:
                    rest.append((ci, cj))
            if most is not None and len(found) + 4 * len(rest) > 4 * most:
                found += [(z, z + side * side - 1) for ci, cj in rest for z in [z_of(ci, cj, depth) * side * side]]
                break
            partly = [(2 * ci + a, 2 * cj + b) for ci, cj in rest for b in (0, 1) for a in (0, 1)]
    found.sort()
    joined: list[list[int]] = []
    for a, b in found:
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    if most is not None and len(joined) > most:
        gaps = sorted(range(1, len(joined)), key=lambda k: joined[k][0] - joined[k - 1][1])[: len(joined) - most]
        for k in sorted(gaps, reverse=True):
            joined[k - 1][1] = joined[k][1]
            del joined[k]
    return [(a, b) for a, b in joined]


def in_intervals(z: Column, intervals: list[tuple[int, int]]) -> Column:
    """A predicate of plain comparisons, so that scans prune by it."""
    if len(intervals) > 1:
        half = len(intervals) // 2
        return in_intervals(z, intervals[:half]) | in_intervals(z, intervals[half:])
    return F.lit(False) if not intervals else z == intervals[0][0] if intervals[0][0] == intervals[0][1] else z.between(*intervals[0])


def coarser(intervals: list[tuple[int, int]], levels: int) -> list[tuple[int, int]]:
    """Intervals of a level so much higher that hold the same places."""
    out: list[tuple[int, int]] = []
    for a, b in ((a >> 2 * levels, b >> 2 * levels) for a, b in intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class PointTable:
    """Points kept as Parquet along the Z-order curve of a level: a folder for each cell of the level ``prefix``, sorted
    within files. A viewport is read by folders first and row groups next, both from the intervals that cover it."""

    path: str
    level: int = 16
    prefix: int = 4

    def write(self, points: DataFrame, partitions: int) -> PointTable:
        """Ranges of the curve are tasks, so a crowded cell is dealt over several; each task writes few folders."""
        laid = clustered(points, partitions, self.level).withColumn("zp", F.shiftright("z", 2 * (self.level - self.prefix)))
        laid.write.mode("overwrite").partitionBy("zp").parquet(self.path)
        return self

    def read(self, spark: SparkSession, v: Viewport, most: int | None = MOST_INTERVALS) -> DataFrame:
        """All columns of the points strictly inside the wrapped viewport."""
        spans = cover(rectangles(v), self.level, most)
        table = spark.read.parquet(self.path)
        folders = in_intervals(table["zp"], coarser(spans, self.level - self.prefix))
        return table.where(folders & in_intervals(table["z"], spans) & in_viewport(table["mx"], table["my"], v)).drop("zp")


def covered_cells(cells: DataFrame, v: Viewport, level: int, most: int = MOST_INTERVALS) -> DataFrame:
    """Those of a level's ``(z, ci, cj, ...)`` that a viewport's rectangles touch: by the intervals that cover them, then exactly.
    ``z`` is best a stored column, which scans prune by."""
    rects = rectangles(v)
    exact = F.lit(False)
    for i0, j0, i1, j1 in (cells_met(r, level) for r in rects):
        exact = exact | (F.col("ci").between(i0, i1) & F.col("cj").between(j0, j1))
    return cells.where(in_intervals(F.col("z"), cover(rects, level, most)) & exact)
