"""One sample for each quadtree node, chosen among its children's by image error, and that error at every zoom."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .pyramid import DEEP, deep_cells, levels, morton
from .render import Pixels, metric, renderer

ZOOMS = 19


def resolution_at(zoom: int, level: int) -> int:
    return math.floor(2.0 ** (8 + zoom - level) + 0.5)


def choose_sample(cx: float, cy: float, half: float, samples: list[tuple[float, float]], kind: str = "disc", error: str = "l2") -> int:
    """Which of the children's samples (in order NW, NE, SW, SE) looks most like all of them at one pixel; the first of equals."""
    if len(samples) == 1:
        return 0
    draw, m = renderer(kind), metric(kind, error)
    truth = draw.blank(1)
    for x, y in samples:
        draw.draw(truth, cx, cy, half, 1, x, y)
    best, least = 0, math.inf
    for k, (x, y) in enumerate(samples):
        one = draw.blank(1)
        draw.draw(one, cx, cy, half, 1, x, y)
        e = m.dense(truth, one)
        if e < least:
            best, least = k, e
    return best


def zoom_errors(level: int, cx: float, cy: float, half: float, own: tuple[float, float], samples: list[tuple[float, float]], kind: str = "disc", error: str = "l2") -> list[float]:
    """The error of the node's sample against its children's at zooms 0 to 18; 0 where the node is less than half a pixel wide."""
    draw, m = renderer(kind), metric(kind, error)
    out = []
    for z in range(ZOOMS):
        r = resolution_at(z, level)
        if r == 0 or len(samples) == 1:
            out.append(0.0)
        elif r > 4:
            a: Pixels = {}
            b: Pixels = {}
            draw.draw_sparse(a, cx, cy, half, r, *own)
            for x, y in samples:
                draw.draw_sparse(b, cx, cy, half, r, x, y)
            out.append(m.sparse(b, a))
        else:
            a_, b_ = draw.blank(r), draw.blank(r)
            draw.draw(a_, cx, cy, half, r, *own)
            for x, y in samples:
                draw.draw(b_, cx, cy, half, r, x, y)
            out.append(m.dense(b_, a_))
    return out


def snap_samples(points: DataFrame, depth: int = DEEP, bottom: int | None = None) -> DataFrame:
    """``(level, ci, cj, cnt, point_id, x, y)`` with the snap renderer, for which the first child's sample is as
    good as any: a node's is that of its first deepest cell along the Z-order curve. No iteration."""
    cells = deep_cells(points, depth).withColumn("z", morton(F.col("ci"), F.col("cj"), depth))
    each = levels(cells, depth, 0, bottom, sample=F.min_by("first", "z"))
    return each.select("level", "ci", "cj", "cnt", F.col("sample.point_id").alias("point_id"), F.col("sample.mx").alias("x"), F.col("sample.my").alias("y"))


def _picked(level: int, kind: str, error: str):
    """Of batches of families (the children of a cell each), the cells of ``level`` with their samples and errors."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = 2.0**-level
        for b in batches:
            rows = []
            for pi, pj, family in zip(b["pi"], b["pj"], b["f"]):
                family = sorted(family, key=lambda c: (c["cj"], c["ci"]))
                cx, cy, half = (pi + 0.5) * w, (pj + 0.5) * w, w / 2
                places = [(c["x"], c["y"]) for c in family]
                k = choose_sample(cx, cy, half, places, kind, error)
                errors = zoom_errors(level, cx, cy, half, places[k], places, kind, error)
                rows.append((level, pi, pj, sum(c["cnt"] for c in family), family[k]["point_id"], *places[k], len(family), errors))
            yield pd.DataFrame(rows, columns=["level", "ci", "cj", "cnt", "point_id", "x", "y", "children", "errors"])

    return pick


_NODE = "level int, ci long, cj long, cnt long, point_id long, x double, y double, children int, errors array<double>"


def error_nodes(points: DataFrame, depth: int = DEEP, *, kind: str = "disc", error: str = "l2") -> DataFrame:
    """``(level, ci, cj, cnt, point_id, x, y, children, errors)`` for every non-empty cell, built upwards level by level.

    Below the deepest level at which any cell branches, all cells are chains over one deepest cell and
    follow from it at once. From there upwards a cell with one child takes its sample with error 0 by
    plain columns; only cells that branch are drawn, in Arrow batches of families of at most four.
    Every level is written once, as the next one and the result both read it.
    """
    zero = F.array(*[F.lit(0.0)] * ZOOMS)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deep = settled(deep_cells(points, depth), "deepest")
    up = lambda c, k: F.expr(f"shiftright({c}, {depth} - {k})")
    each = deep.select("ci", "cj", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")).select("level", up("ci", "level").alias("ci"), up("cj", "level").alias("cj")).distinct()
    branching = each.groupBy((F.col("level") - 1).alias("level"), F.shiftright("ci", 1).alias("ci"), F.shiftright("cj", 1).alias("cj")).agg(F.count("*").alias("n")).where("n > 1")
    last = branching.agg(F.max("level")).first()[0]
    top = depth if last is None else last + 1  # at this level and below it no cell branches
    own = deep.select("ci", "cj", "cnt", F.col("first.point_id").alias("point_id"), F.col("first.mx").alias("x"), F.col("first.my").alias("y"))
    fields = ["level", "ci", "cj", "cnt", "point_id", "x", "y", "children", "errors"]
    out = own.withColumn("level", F.explode(F.sequence(F.lit(0 if last is None else top), F.lit(depth)))).withColumns(
        {"ci": up("ci", "level"), "cj": up("cj", "level"), "children": (F.col("level") < depth).cast("int"), "errors": zero}
    ).select(*fields)
    at = out.where(F.col("level") == top)
    for level in range(top - 1, -1, -1) if last is not None else ():
        families = at.groupBy(F.shiftright("ci", 1).alias("pi"), F.shiftright("cj", 1).alias("pj")).agg(F.collect_list(F.struct("ci", "cj", "cnt", "point_id", "x", "y")).alias("f"))
        single = families.where("size(f) = 1").select(
            F.lit(level).alias("level"), F.col("pi").alias("ci"), F.col("pj").alias("cj"), F.col("f")[0]["cnt"].alias("cnt"), F.col("f")[0]["point_id"].alias("point_id"), F.col("f")[0]["x"].alias("x"), F.col("f")[0]["y"].alias("y"), F.lit(1).alias("children"), zero.alias("errors")
        )
        at = single.unionByName(families.where("size(f) > 1").repartition(tasks).mapInPandas(_picked(level, kind, error), _NODE))
        at = settled(at, f"level-{level}")
        out = out.unionByName(at)
    return out
