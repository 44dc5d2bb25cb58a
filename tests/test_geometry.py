from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodscape.functions import predicates as P
from lodscape.functions import projection as J
from lodscape.functions.viewport import VIEWPORTS, Viewport, pixel_matrix, screen_xy
from lodscape.operators.render import DiscRenderer, GrayError, SnapError, SnapRenderer
from lodscape.sources import messages
from lodscape.sources.points import PointSource, pairs_from_json


def test_mercator_extremes(spark):
    df = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0), (0.0, 0.0), (None, None)], "lng double, lat double")
    rows = [tuple(r) for r in df.select(J.lng_x(df["lng"]), J.lat_y(df["lat"])).collect()]
    assert rows[0] == (0.0, 0.0) and rows[1] == (1.0, 1.0) and rows[2] == (0.5, 0.5) and rows[3] == (None, None)
    assert J.with_mercator(df).count() == 3


def test_golden_screen_position(spark):
    m = pixel_matrix(1920, 978, -96.328125, 39.50404070558415, 3)
    df = spark.createDataFrame([(-118.26517425999998, 34.04450895999999)], "lng double, lat double")
    x, y, depth = df.select(*screen_xy(df["lng"], df["lat"], m)).first()
    assert x == pytest.approx(710.4051284195557, abs=1e-4)
    assert y == pytest.approx(566.6119216363259, abs=1e-4)


def test_disc_is_a_disc():
    disc, image = DiscRenderer(1), DiscRenderer(1).blank(64)
    assert disc.draw(image, 0.1796875, 0.3828125, 0.0078125, 64, 0.18738888888888888, 0.3833203873543357)
    changed = np.argwhere((image != np.array(J.BACKGROUND_RGB)).any(axis=2))
    assert 1 <= len(changed) <= 9
    length = 2 * 0.0078125 / 64
    left, top = 0.1796875 - 0.0078125 - 2 * length, 0.3828125 - 0.0078125 - 2 * length
    for i, j in changed:
        assert math.hypot(left + (i + 0.5) * length - 0.18738888888888888, top + (j + 0.5) * length - 0.3833203873543357) <= 1.5 * length


def test_dense_and_sparse_errors_agree():
    for draw, metric in ((DiscRenderer(1), GrayError(1)), (DiscRenderer(1), GrayError(2)), (SnapRenderer(), SnapError())):
        a, b, sa, sb = draw.blank(8), draw.blank(8), {}, {}
        for k, (x, y) in enumerate([(0.2, 0.3), (0.25, 0.31), (0.7, 0.9)]):
            draw.draw(a, 0.5, 0.5, 0.5, 8, x, y)
            draw.draw_sparse(sa, 0.5, 0.5, 0.5, 8, x, y)
            if k:
                draw.draw(b, 0.5, 0.5, 0.5, 8, x, y)
                draw.draw_sparse(sb, 0.5, 0.5, 0.5, 8, x, y)
        assert metric.dense(a, b) == metric.sparse(sa, sb) > 0
        assert metric.sparse({}, {}) == 0


def test_wrapped_viewport_is_the_union_of_its_halves(spark):
    df = spark.range(-180, 181).select(F.col("id").cast("double").alias("lng"), F.lit(10.0).alias("lat"))
    df = J.with_mercator(df)
    got = {r["lng"] for r in df.where(P.in_viewport(df["mx"], df["my"], VIEWPORTS["wrap"])).collect()}
    assert got == {float(x) for x in range(171, 180)} | {float(x) for x in range(-179, -170)}  # open on all sides
    everything = Viewport(-300, -60, 300, 60, 1, 10, 10)
    assert df.where(P.in_viewport(df["mx"], df["my"], everything)).count() == 359


@pytest.mark.parametrize(
    "query,expected",
    [("cat", [1, 3]), ("cat & dog", [3]), ("cat | bird", [1, 2, 3]), ("!cat", [2, 4]), ("big <-> dog", [3]), ("(cat | bird) & !dog", [1, 2]), ("the", []), ("cat &", []), ("(cat", []), ("", [])],
)
def test_text_queries(spark, query, expected):
    df = spark.createDataFrame([(1, "A cat."), (2, "The bird"), (3, "cat, big dog"), (4, None)], "id int, text string").fillna({"text": ""})
    assert sorted(r["id"] for r in df.where(P.text_matches(df["text"], query)).collect()) == expected


def test_bitmap_message_round_trip(spark):
    v = Viewport(-110, 30, -80, 45, 5, 101, 53)
    wanted = {(0, 0), (5, 7), (5, 8), (100, 52), (33, 51)}
    pixels = spark.createDataFrame(sorted(wanted), "i long, j long")
    message = messages.bitmap_message(pixels, v, messages.Header(42, 1.5, 0.5, 0.25))
    assert len(message) == 32 + 40 + 101 * 7
    head, image = messages.decode_message(message)
    assert head["progress"] == 42 and head["total"] == 1.5 and head["res_x"] == 101
    assert {tuple(p) for p in np.argwhere(image).tolist()} == wanted
    assert {(r["i"], r["j"]) for r in messages.decoded_bitmap(messages.bitmap_bytes(pixels), v).collect()} == wanted


def test_point_message_round_trip(spark):
    df = spark.createDataFrame([(10.5, -3.25), (0.0, 90.0)], "lng double, lat double")
    message = messages.point_message(df)
    assert len(message) == 32 + 16 * 2
    head, found = messages.decode_message(message)
    assert head["type"] == 0 and sorted(found) == [(-3.25, 10.5), (90.0, 0.0)]


def test_pairs_from_json(spark):
    lines = spark.createDataFrame([("[[1.5, 2.5], [3, 4], [null, 1]]",), (None,), ("not json",)], "value string")
    assert sorted((r["lng"], r["lat"]) for r in pairs_from_json(lines).collect()) == [(2.5, 1.5), (4.0, 3.0)]


def test_scans_drop_places_that_are_null(spark):
    df = spark.sql("select 1L point_id, timestamp_ntz'2024-01-01' ts, 'a' keyword, cast(null as double) lng, 1D lat union all select 2, timestamp_ntz'2024-01-02', 'a', 1D, 1D union all select 3, timestamp_ntz'2024-01-02', 'b', 1D, 1D")
    source = PointSource(df)
    assert [r["point_id"] for r in source.scan("a").collect()] == [2]
    assert source.scan("%", "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 0
    assert source.scan("%", "2024-01-01 00:00:00", "2024-01-02 00:00:00", closed=True).count() == 2
