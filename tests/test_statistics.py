"""Boxes, heat and agreement, each against the slow way."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodscape.functions.viewport import Viewport, pixel_matrix
from lodscape.operators import agreement, boxes, heat, tilted
from lodscape.operators.reducers import snapped
from lodscape.plans.engine import Engine, Query
from lodscape.plans.replay import Action, Recorder, replayed
from lodscape.sources import messages
from lodscape.sources.index_store import TreeStore
from lodscape.sources.points import PointSource, event_points


class Cell:
    """A cell of a tree that boxes are put into one by one."""

    def __init__(self, level, ci, cj, capacity, depth):
        self.at, self.capacity, self.depth, self.kids, self.own, self.stuck = (level, ci, cj), capacity, depth, None, [], []

    def put(self, box):
        level, ci, cj = self.at
        if self.kids is None:
            self.own.append(box)
            if level < self.depth and len(self.own) > self.capacity:
                self.kids = [Cell(level + 1, 2 * ci + a, 2 * cj + b, self.capacity, self.depth) for b in (0, 1) for a in (0, 1)]
                waiting, self.own = self.own, []
                for x in waiting:
                    self.put(x)
            return
        _, x0, y0, x1, y1 = box
        w = 0.5 ** (level + 1)
        a, b = x0 > (2 * ci + 1) * w, y0 > (2 * cj + 1) * w
        left, top = (2 * ci + a) * w, (2 * cj + b) * w
        fits = x0 >= left and x1 <= left + w and y0 >= top and y1 <= top + w
        self.kids[2 * b + a].put(box) if fits else self.stuck.append(box)

    def all(self):
        yield from ((x[0], *self.at) for x in self.own + self.stuck)
        for k in self.kids or ():
            yield from k.all()


@pytest.mark.parametrize("n,capacity,depth", [(0, 6, 6), (5, 6, 6), (400, 6, 6), (300, 1, 4), (50, 2, 0)])
def test_box_tree_is_that_of_insertions(spark, n, capacity, depth):
    r = random.Random(n)
    side = lambda: r.choice([0.0, 0.25, 0.5, 0.75, 1.0, r.random(), -0.2])
    rows = [(k, x, y, x + r.choice([0, 0.25, r.random() / 20]), y + r.choice([0, 0.25, r.random() / 20])) for k in range(n) for x, y in [(side(), side())]]
    rows += rows[:3]
    root = Cell(0, 0, 0, capacity, depth)
    for x in rows:
        root.put(x)
    df = spark.createDataFrame([*[(*x, "clash") for x in rows], (None, None, 0.1, 0.2, 0.3, "clash")], "id long, x0 double, y0 double, x1 double, y1 double, level string")
    tree = boxes.box_tree(df, capacity, depth).cache()
    assert sorted((x["id"], x["level"], x["ci"], x["cj"]) for x in tree.collect()) == sorted(root.all())
    want = sorted(x[0] for x in rows if x[1] <= 0.5 and x[3] >= 0.2 and x[2] <= 0.75 and x[4] >= 0.5)
    assert sorted(x["id"] for x in boxes.overlapping(tree, 0.2, 0.5, 0.5, 0.75).collect()) == want


def test_heat_is_a_dense_convolution(spark, sf):
    v = Viewport(-110, 30, -80, 45, 5, 31, 17)
    points = event_points(spark, sf)
    k = heat.stencil(3, 2)
    grid = {(x["i"], x["j"]): min(x["n"] * 10 * 2.0**-12, 1.0) for x in snapped(points, v).groupBy("i", "j").agg(F.count("*").alias("n")).collect()}
    want = {}
    for i, j in itertools.product(range(31), range(17)):
        near = [w * k[abs(i - a)] * k[abs(j - b)] for (a, b), w in grid.items() if abs(i - a) < len(k) and abs(j - b) < len(k)]
        if near:
            want[i, j] = min(1.0, sum(near))
    got = {(x["i"], x["j"]): x["heat"] for x in heat.heat_picture(points, v, 3, 2).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    assert heat.heat_picture(points.limit(0), v).count() == 0
    hot = heat.heat_picture(points, v, 3, 2, weight=1e9).agg(F.max("heat")).first()[0]
    assert hot == 1.0


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_rand_index_counts_all_pairs(spark, n):
    r = random.Random(n)
    rows = [(r.choice("xyz"), r.randrange(4)) for _ in range(n)]
    got = agreement.rand_index(spark.createDataFrame([*rows, (None, 1), ("x", None)], "p string, q int"), "p", "q").first()
    pairs = list(itertools.combinations(rows, 2))
    together = sum(x[0] == y[0] and x[1] == y[1] for x, y in pairs)
    apart = sum(x[0] != y[0] and x[1] != y[1] for x, y in pairs)
    assert (got["n"], got["pairs"], got["together"], got["apart"]) == (n, len(pairs), together, apart)
    assert got["rand"] == pytest.approx((together + apart) / len(pairs) if pairs else 1.0)
    same = agreement.rand_index(spark.createDataFrame([*rows, ("x", 0), ("y", 1)], "p string, q int"), "p", "p").first()
    assert same["rand"] == same["adjusted"] == 1.0


def test_analysis_requests(spark, sf):
    engine = Engine(PointSource(event_points(spark, sf)))
    ask = lambda o, a: engine.handle({"type": "analysis", "analysis": {"objective": o, "arguments": a}})["value"]
    assert ask("distance", [0, 0, 3, 4]) == 5.0 and ask("rand-index", ["keyword", "keyword"]) == 1.0 and ask("other", []) == 0.0


@pytest.mark.parametrize("pitch,bearing", [(0, 0), (0, 40), (45, -20), (60, 100)])
def test_footprints_are_those_of_all_pixels(spark, sf, pitch, bearing):
    width, height, zoom, radius = 60, 40, 6, 2.5
    m = pixel_matrix(width, height, -98.0, 38.0, zoom, pitch, bearing)
    points = event_points(spark, sf).limit(1000)
    rows = [*[tuple(r) for r in points.select("point_id", "lng", "lat").collect()], (-1, None, 1.0), (-2, -98.0, 38.0), (-3, 400.0, 0.0), (-4, 82.0, -38.0)]
    got = {(r["point_id"], r["i"], r["j"]): r["alpha"] for r in tilted.disc_footprints(spark.createDataFrame(rows, "point_id long, lng double, lat double"), m, zoom, width, height, radius).collect()}
    back = tilted.ground_matrices(m)[1]
    i, j = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5, indexing="ij")
    g = np.tensordot(back, np.stack([i, j, np.ones_like(i)]), 1)
    gx, gy, w = g[0] / g[2], g[1] / g[2], 1 / g[2]
    want = {}
    for k, lng, lat in rows:
        if lng is None or abs(lng) > 180:
            continue
        x, y = 512 * (math.radians(lng) + math.pi) / (2 * math.pi), 512 * (math.pi + math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))) / (2 * math.pi)
        t = np.clip(radius - np.hypot(gx - x, gy - y) * 2.0**zoom + 0.5, 0, 1)
        alpha = np.where(w > 0, t * t * (3 - 2 * t), 0)
        want |= {(k, int(a), int(b)): alpha[a, b] for a, b in zip(*np.nonzero(alpha > tilted.LEAST_ALPHA))}
    assert len(want) > 20 and set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-6) for p in want)


def test_a_pixel_in_the_golden_view(spark):
    m = pixel_matrix(1920, 978, -96.328125, 39.50404070558415, 3)
    drawn = tilted.disc_footprints(spark.createDataFrame([(1, -118.26517425999998, 34.04450895999999)], "point_id long, lng double, lat double"), m, 3, 1920, 978, 1.0).collect()
    assert {(r["i"], r["j"]) for r in drawn} >= {(710, 566)} and all(abs(r["i"] + 0.5 - 710.4051284195557) < 2 and abs(r["j"] + 0.5 - 566.6119216363259) < 2 for r in drawn)
    x, y = tilted.ground_xy(F.lit(710.4051284195557 - 0.5), F.lit(566.6119216363259 - 0.5), m)
    back = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert back["x"] == pytest.approx(512 * (180 - 118.26517425999998) / 360, abs=1e-5)


def test_a_session_is_logged_and_replayed(spark, sf, tmp_path):
    points = event_points(spark, sf)
    recorder = Recorder()
    for zoom in (3, 4, 4):
        recorder.record(Action("click", -100.0, 40.0, zoom))
    recorder.write(spark, str(tmp_path / "log"))
    engine, base = Engine(PointSource(points), store=TreeStore(str(tmp_path), "d")), Query(algorithm="QuadTree", resX=300, resY=200)
    got = [r.asDict() for r in replayed(engine, spark.read.parquet(str(tmp_path / "log")), base).orderBy("action").collect()]
    assert [r["step"] for r in got] == ["built", "cached", "cached"] and all(r["run_seconds"] > 0 and r["used_mb"] > 1 for r in got)
    assert [r["rows"] for r in got] == [engine.query(a.query(base), "click").count() for a in recorder.actions]
    header, found = messages.decode_message(engine.message(recorder.actions[0].query(base), "click"))
    assert len(found) == got[0]["rows"] and 0 < header["aggregate"] <= header["total"] and header["tree"] <= header["total"]
