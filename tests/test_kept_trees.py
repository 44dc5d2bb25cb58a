"""Tables pruned along the Z-order curve, stored trees, and trees that grow batch by batch."""

from __future__ import annotations

from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodscape.functions.predicates import rectangles
from lodscape.functions.viewport import VIEWPORTS, Viewport
from lodscape.operators import preorder, pyramid, reducers, zorder
from lodscape.plans.engine import Engine, Query
from lodscape.sources.index_store import TreeStore
from lodscape.sources.points import PointSource, event_points, event_points_of
from lodscape.streaming import progressive, tree_log

CITY, REGION, COUNTRY = (VIEWPORTS[k] for k in ("city", "region", "country"))
unit = st.floats(0, 1)


def files_read(df) -> int:
    """Files that the scans of an executed plan opened."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def bare(nodes):
    return rows(nodes.select("level", "ci", "cj", "cnt", "first.point_id", "is_leaf"))


@settings(max_examples=60, deadline=None)
@given(unit, unit, unit, unit, st.integers(0, 6), st.sampled_from([None, 1, 3, 16]))
def test_cover_holds_all_cells_a_rectangle_touches(a, b, c, d, level, most):
    r = (min(a, c), min(b, d), max(a, c), max(b, d))
    n = 2**level
    touched = {zorder.z_of(i, j, level) for i in range(n) for j in range(n) if not (i / n > r[2] or (i + 1) / n < r[0] or j / n > r[3] or (j + 1) / n < r[1])}
    spans = zorder.cover([r], level, most)
    held = {z for lo, hi in spans for z in range(lo, hi + 1)}
    assert touched <= held and (most is not None or touched == held)
    assert most is None or len(spans) <= most
    assert all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:])) and all(lo <= hi for lo, hi in spans)


def test_coarser_intervals():
    assert zorder.coarser([(0, 3), (5, 6), (16, 80)], 1) == [(0, 1), (4, 20)]
    assert zorder.coarser([(7, 7)], 0) == [(7, 7)]


def test_point_table_reads_less_for_less(spark, sf, tmp_path):
    points = event_points(spark, sf)
    table = zorder.PointTable(str(tmp_path / "t"), prefix=5).write(points, 4)
    everywhere = Viewport(-180, -85, 180, 85, 0, 100, 100)
    counts = []
    for v in (CITY, REGION, everywhere):
        found = table.read(spark, v)
        assert rows(found.select("point_id")) == rows(reducers.raw_points(points, v).select("point_id"))
        counts.append(files_read(found))
    assert counts[0] < counts[1] < counts[2]
    hot = event_points(spark, sf).withColumns({"lng": F.when(F.col("point_id") % 3 == 0, F.lit(-100.0)).otherwise(F.col("lng")), "lat": F.when(F.col("point_id") % 3 == 0, F.lit(40.0)).otherwise(F.col("lat"))})
    assert rows(zorder.PointTable(str(tmp_path / "h")).write(hot, 4).read(spark, REGION, 4).select("point_id")) == rows(reducers.raw_points(hot, REGION).select("point_id"))
    assert zorder.PointTable(str(tmp_path / "e")).write(points.limit(0), 4) is not None


def test_stored_tree_reads_levels_and_places_it_needs(spark, sf, tmp_path):
    nodes = pyramid.quadtree(event_points(spark, sf))
    store = TreeStore(str(tmp_path), "d")
    assert store.read(spark, "k") is None
    store.write(nodes, "k")
    assert bare(store.read(spark, "k")) == bare(nodes)
    small = replace(CITY, res_x=4, res_y=4)
    part = store.read(spark, "k", small, reducers.grid_level(small))
    assert rows(reducers.grid_of(part, small)) == rows(reducers.grid_points(event_points(spark, sf), small))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "zp" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "LessThanOrEqual(level,10)" in plan
    assert files_read(part) < files_read(store.read(spark, "k", REGION, 27)) <= files_read(store.read(spark, "k"))


@pytest.mark.parametrize("algorithm", ["QuadTree", "raqts", "raqtd", "raqtdv2"])
def test_engine_answers_from_kept_trees(spark, sf, tmp_path, algorithm):
    source, store = PointSource(event_points(spark, sf)), TreeStore(str(tmp_path), "d")
    q = Query(algorithm=algorithm, zoom=4, bbox=(-110, 30, -80, 45), resX=300, resY=200, sampleSize=40)
    plain, kept = Engine(source), Engine(source, store=store)
    want = rows(plain.query(q, "click"))
    assert want and plain.last_step == "built"
    assert rows(plain.query(q, "click")) == want and plain.last_step == "cached"
    for engine, step in ((kept, "built"), (kept, "cached"), (Engine(source, store=store), "stored")):
        assert rows(engine.query(q, "click")) == want and engine.last_step == step


def test_engine_forgets_trees_asked_least(spark, sf, tmp_path):
    engine = Engine(PointSource(event_points(spark, sf)), most_cached=1, store=TreeStore(str(tmp_path), "d"))
    q = Query(algorithm="qt", zoom=2)
    steps = []
    for keyword in ("click", "view/x", "click"):
        engine.query(q, keyword)
        steps.append(engine.last_step)
    assert steps == ["built", "built", "stored"] and len(engine._cache) == 1


def test_tree_log_grows_and_repeats_change_nothing(spark, sf, tmp_path):
    points = progressive.deltas(event_points(spark, sf), "2024-01-01 00:00:00", "2024-01-31 00:00:00", 7).cache()
    log, store = tree_log.TreeLog(spark, str(tmp_path / "log"), fold=2), TreeStore(str(tmp_path), "trees")
    assert log.version == -1 and log.nodes().count() == 0
    seen, answers = [], []
    slices = ((k, points.where(F.col("slice") == k)) for k in range(4))

    def answer(k, grown):
        answers.append(bare(grown.nodes()) == bare(pyramid.quadtree(points.where(F.col("slice") <= k))))
        part = reducers.frontier(grown.nodes(REGION, 11), REGION, 11)
        answers.append(bare(part) == bare(reducers.frontier(pyramid.quadtree(points.where(F.col("slice") <= k)), REGION, 11)))

    tree_log.grow(log, slices, answer, lambda grown: seen.append(grown.save(store, "counts")))
    assert answers == [True] * 8 and len(seen) == 1
    assert bare(store.read(spark, "counts")) == bare(pyramid.quadtree(points.where("slice < 4")))
    before = bare(log.nodes())
    assert not log.apply(points, 3) and not log.apply(points, 0)
    assert bare(log.nodes()) == before
    assert bare(log.nodes(upto=1)) == bare(pyramid.quadtree(points.where("slice <= 1")))
    added = spark.read.parquet(str(tmp_path / "log/cells/add-1"))  # a row for each cell the batch touches
    assert rows(added.select("level", "ci", "cj", "cnt")) == rows(pyramid.levels(pyramid.deep_cells(points.where("slice = 1")), 27).select("level", "ci", "cj", "cnt"))
    assert log.apply(points.limit(0), 9) and log.version == 9 and bare(log.nodes()) == before


def test_tree_from_a_stream_goes_on_where_it_was(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    stream = lambda: event_points_of(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    log, numbers, ends = tree_log.TreeLog(spark, str(tmp_path / "log")), [], []
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(folder)
        tree_log.grow_from_stream(log, stream(), str(tmp_path / "check"), lambda k, _: numbers.append(k), lambda _: ends.append(log.version))
    tree_log.grow_from_stream(log, stream(), str(tmp_path / "check"), lambda k, _: numbers.append(k))
    assert numbers == [0, 1] and ends == [0, 1]
    assert bare(log.nodes(bottom=12)) == bare(pyramid.quadtree(event_points(spark, sf)).where("level <= 12"))


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_lines_in_preorder_and_back(spark, sf, tmp_path, monkeypatch, part):
    monkeypatch.setattr(preorder, "PART", part)
    nodes = pyramid.quadtree(event_points(spark, sf)).select("level", "ci", "cj", "cnt").cache()
    want = {tuple(r) for r in nodes.collect()}
    lines = sorted((tuple(r) for r in preorder.preorder(nodes).select("n", "level", "ci", "cj", "cnt").collect()))
    assert [r[0] for r in lines] == list(range(len(want)))
    kids = {}
    for level, ci, cj, _ in want:
        kids.setdefault((level - 1, ci >> 1, cj >> 1), []).append((level, ci, cj))
    walked, todo = [], [(0, 0, 0)]
    while todo:
        node = todo.pop()
        walked.append(node)
        todo += sorted(kids.get(node, []), key=lambda c: (c[2], c[1]), reverse=True)
    assert [r[1:4] for r in lines] == walked
    preorder.write_lines(nodes, str(tmp_path / "lines"))
    assert {tuple(r) for r in preorder.read_lines(spark, str(tmp_path / "lines")).select("level", "ci", "cj", "cnt").collect()} == want
    assert preorder.cells_of(preorder.preorder(nodes.limit(0)).drop("ci", "cj")).count() == 0
