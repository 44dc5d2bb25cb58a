from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from lodscape.functions.projection import lat_y_of, lng_x_of
from lodscape.functions.viewport import VIEWPORTS, Viewport
from lodscape.operators import best_first, budget, centroids, folds, pyramid, reducers, samples
from lodscape.operators.render import DiscRenderer
from lodscape.plans.engine import ALGORITHMS, Engine, Query
from lodscape.sources.index_store import read_index, write_index
from lodscape.sources.points import PointSource, event_points
from lodscape.streaming import progressive

SCHEMA = "point_id long, ts timestamp_ntz, keyword string, lng double, lat double"


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(4)
    rows = [(k, None, "a", r.choice([-100.0, r.uniform(-120, -70)]), r.choice([40.0, r.uniform(26, 50)])) for k in range(300)]
    rows += [(300, None, "a", 180.0, 0.0), (301, None, "a", 0.0, -90.0), (302, None, "a", None, 1.0), (303, None, "a", rows[0][3], rows[0][4])]
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def inserted(rows, depth):
    """The nodes of a tree that points are inserted into one by one."""
    nodes = {}

    def insert(level, i, j, p):
        node = nodes.setdefault((level, i, j), {"cnt": 0, "first": None, "split": False})
        node["cnt"] += 1
        if node["first"] is None:
            node["first"] = p
            return
        if level == depth:
            return
        if not node["split"]:
            node["split"] = True
            down(level, node["first"])
        down(level, p)

    def down(level, p):
        insert(level + 1, int(p[1] * 2 ** (level + 1)), int(p[2] * 2 ** (level + 1)), p)

    for k, _, _, lng, lat in rows:
        if lng is not None and lat is not None:
            x, y = lng_x_of(lng), lat_y_of(lat)
            if 0 <= x < 1 and 0 <= y < 1:
                insert(0, 0, 0, (k, x, y))
    return {key: (n["cnt"], n["first"][0]) for key, n in nodes.items()}


def test_quadtree_is_the_tree_of_insertions(some):
    rows, points = some
    for depth in (3, 12):
        got = {(r["level"], r["ci"], r["cj"]): (r["cnt"], r["first"]["point_id"]) for r in pyramid.quadtree(points, depth).collect()}
        assert got == inserted(rows, depth)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pyramid.quadtree(empty, 5).count() == 0
    assert reducers.grid_points(empty, VIEWPORTS["region"]).count() == 0
    one = spark.createDataFrame([(7, None, "a", -100.0, 40.0)], SCHEMA)
    found = reducers.grid_points(one, VIEWPORTS["region"]).collect()
    assert [(r["level"], r["x"], r["y"]) for r in found] == [(0, lng_x_of(-100.0), lat_y_of(40.0))]


def test_pixel_points_have_no_visual_error(some):
    _, points = some
    reduced = reducers.pixel_points(points, VIEWPORTS["odd"])
    row = reducers.visual_error(points, reduced, VIEWPORTS["odd"]).first()
    assert row["error"] == 0 and row["pixels_full"] == row["pixels_reduced"] > 0


def searched(nodes, v, n):
    """Best-first search with a heap over all nodes."""
    x0, y0, x1, y1 = v.mercator
    by = {(r["level"], r["ci"], r["cj"]): r for r in nodes}

    def meets(k):
        w = 2.0 ** -k[0]
        return not (k[1] * w > x1 or (k[1] + 1) * w < x0 or k[2] * w > y1 or (k[2] + 1) * w < y0)

    heap, free, out = [(-by[0, 0, 0]["b"], (0, 0, 0))], n - 1, set()
    while heap:
        less, k = heapq.heappop(heap)
        if less >= 0 or free <= 0:
            out.add(k)
            continue
        kids = [(k[0] + 1, 2 * k[1] + a, 2 * k[2] + c) for a in (0, 1) for c in (0, 1)]
        kids = [c for c in kids if c in by and meets(c)]
        free += 1 - len(kids)
        for c in kids:
            heapq.heappush(heap, (-by[c]["b"], c))
    return out


@pytest.mark.parametrize("n", [1, 5, 40, 3000])
def test_best_first_is_the_heap_search(some, n):
    _, points = some
    v, depth = VIEWPORTS["region"], 14
    nodes = centroids.centroid_nodes(points, depth)
    rows = nodes.select("level", "ci", "cj", centroids.screen_benefit(v.zoom, depth).alias("b")).collect()
    got = best_first.best_first(nodes, centroids.screen_benefit(v.zoom, depth), v, n).collect()
    keys = [(r["level"], r["ci"], r["cj"]) for r in got]
    assert len(keys) == len(set(keys)) and set(keys) == searched(rows, v, n)
    assert len(keys) <= n + 2


@pytest.mark.parametrize("n,most", [(7, 1), (60, 1), (60, 3), (150, 10)])
def test_best_first_without_a_heap(some, monkeypatch, n, most):
    _, points = some
    monkeypatch.setattr(best_first, "HEAP_NODES", most)
    v, depth = VIEWPORTS["region"], 12
    nodes = centroids.centroid_nodes(points, depth).cache()
    for benefit in (centroids.screen_benefit(v.zoom, depth), (F.col("level") * 7 + F.col("ci") * 5 + F.col("cj") * 3) % 4 + 0.0):
        rows = nodes.select("level", "ci", "cj", benefit.alias("b")).collect()
        got = best_first.best_first(nodes, benefit, v, n).collect()
        assert {(r["level"], r["ci"], r["cj"]) for r in got} == searched(rows, v, n)


def test_drawn_points_are_those_of_one_big_picture(some):
    rows, points = some
    v = Viewport(-110, 30, -80, 45, 5, 101, 53)
    x0, y0, x1, y1 = v.mercator
    disc, wide = DiscRenderer(1), 128
    image, kept = disc.blank(wide), set()
    for k, _, _, lng, lat in rows:
        if lng is None or lat is None or not (v.west < lng < v.east and v.south < lat < v.north):
            continue
        sx, sy = (lng_x_of(lng) - x0) * v.res_x / (x1 - x0), (lat_y_of(lat) - y0) * v.res_y / (y1 - y0)
        if disc.draw(image, wide / 2, wide / 2, wide / 2, wide, sx, sy):
            kept.add(k)
    assert {r["point_id"] for r in folds.drawn_points(points, v, tile=32).collect()} == kept


def test_samples_choose_a_child(some):
    _, points = some
    by_snap = {(r["level"], r["ci"], r["cj"]): r["point_id"] for r in samples.snap_samples(points, 6).collect()}
    drawn = {(r["level"], r["ci"], r["cj"]): r["point_id"] for r in samples.error_nodes(points, 6, kind="snap", error="l1").collect()}
    assert by_snap == drawn
    for r in samples.error_nodes(points, 6).where("children > 1").collect():
        assert len(r["errors"]) == 19 and all(e >= 0 for e in r["errors"])


def test_samples_keep_to_their_budget(some):
    _, points = some
    cells = budget.pixel_cells(points, VIEWPORTS["country"])
    total, strata = cells.count(), cells.select("ci", "cj").distinct().count()
    assert budget.stratified_sample(cells, total).count() == total
    half = budget.stratified_sample(cells, (total + strata) // 2)
    assert half.select("ci", "cj").distinct().count() == strata and half.count() <= total
    assert budget.stratified_sample(cells, 20).count() <= strata
    share = [budget.percentage_sample(points, VIEWPORTS["country"], p).count() for p in (1, 30, 99)]
    assert share[0] <= share[1] <= share[2]
    with pytest.raises(ValueError):
        budget.percentage_sample(points, VIEWPORTS["country"], 100)
    assert budget.traversal_sample(points, VIEWPORTS["country"], 50).count() > 0


def test_rendered_cells_cover_each_cell(some):
    _, points = some
    first = {r["point_id"] for r in reducers.first_arrivals(points, VIEWPORTS["country"]).collect()}
    assert first <= {r["point_id"] for r in folds.rendered_cells(points, VIEWPORTS["country"]).collect()}


def test_index_round_trip(spark, some, tmp_path):
    _, points = some
    nodes = pyramid.quadtree(points, 6)
    assert read_index(spark, str(tmp_path), "d", "k") is None
    write_index(nodes, str(tmp_path), "d", "k")
    back = read_index(spark, str(tmp_path), "d", "k")
    assert sorted(map(repr, back.select(*nodes.columns).collect())) == sorted(map(repr, nodes.withColumn("level", F.col("level").cast("int")).collect()))


def test_progressive_ends_with_the_whole(spark, sf):
    points = event_points(spark, sf)
    answers = list(progressive.progressive(points, lambda p: reducers.pixel_bitmap(p, VIEWPORTS["odd"]), "2024-01-01 00:00:00", "2024-01-31 00:00:00", 10))
    assert [a[:2] for a in answers] == [(0, 33), (1, 66), (2, 100)]
    whole = reducers.pixel_bitmap(points, VIEWPORTS["odd"]).count()
    counts = [a[2].count() for a in answers]
    assert counts == sorted(counts) and counts[-1] == whole
    sent = progressive.deltas(points, "2024-01-01 00:00:00", "2024-01-31 00:00:00", 10)
    assert sent.count() == points.count() and sent.select("slice").distinct().count() == 3


def test_stream_equals_batch(spark, sf, tmp_path):
    points = event_points(spark, sf)
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    progressive.stream_answers(stream, 8, lambda k, df: seen.update({k: df.collect()}), str(tmp_path / "ck")).awaitTermination()
    assert len(seen) == 4
    batch = progressive.streamed_cells(points, 8)
    assert sorted(map(repr, seen[max(seen)])) == sorted(map(repr, batch.collect()))


def test_engine(spark, sf):
    engine = Engine(PointSource(event_points(spark, sf)), most_cached=1)
    raw = {"key": "click-qt", "zoom": 5, "bbox": [-110, 30, -80, 45], "resX": 101, "resY": 53, "sampleSize": 50, "other": 1}
    for name in ("de", "DA", "qt", "raqts", "raqtd", "raqtdv2", "gqt", "sampling"):
        reply = engine.handle({"type": "query", "keyword": "click", "query": raw | {"algorithm": name}})
        assert reply["status"] == "done" and reply["result"].columns == ["lng", "lat"]
        assert reply["result"].count() > 0
    assert len(ALGORITHMS) == 19
    with pytest.raises(ValueError):
        engine.query(Query(algorithm="none"))
    assert engine.handle({"type": "what"})["status"] == "unknown"
    assert engine.handle({"type": "cmd"})["status"] == "error"
    assert engine.handle({"type": "analysis", "analysis": {"objective": "distance", "arguments": ["0", "0", "3", "4"]}})["value"] == 5.0
    assert engine.handle({"type": "transfer", "keyword": "view"})["result"].count() > 0 and list(engine._cache) == ["view"]
    assert len(engine.message(Query.of(raw | {"algorithm": "da"}), "click", bitmap=True)) == 72 + 101 * 7
