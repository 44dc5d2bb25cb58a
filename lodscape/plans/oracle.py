"""SQL for the catalog's queries, on the same tables, for engines with ordinary SQL."""

from __future__ import annotations

import math

from ..functions.predicates import rectangles
from ..functions.viewport import Viewport
from ..operators.reducers import grid_level


def num(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


POINTS = """pts AS (
  SELECT event_id AS point_id, ts, event_type AS keyword,
         CAST(user_id * 37 % 59 - 125 AS DOUBLE) + CAST(event_id * 31 % 1000 AS DOUBLE) / CAST(250 AS DOUBLE) AS lng,
         CAST(user_id * 53 % 24 + 25 AS DOUBLE) + CAST(event_id * 17 % 1000 AS DOUBLE) / CAST(250 AS DOUBLE) AS lat
  FROM events)"""


def lng_x(c: str) -> str:
    return f"({c} / {num(360)} + {num(0.5)})"


def lat_y(c: str) -> str:
    s = f"sin(radians({c}))"
    return f"(CASE WHEN {c} >= 90 THEN {num(0)} WHEN {c} <= -90 THEN {num(1)} ELSE least({num(1)}, greatest({num(0)}, {num(0.5)} - {num(0.25)} * ln((1 + {s}) / (1 - {s})) / {num(math.pi)})) END)"


def x_lng(c: str) -> str:
    return f"(({c} - {num(0.5)}) * {num(360)})"


def y_lat(c: str) -> str:
    return f"({num(360)} * atan(exp(({num(180)} - {num(360)} * {c}) * {num(math.pi / 180)})) / {num(math.pi)} - {num(90)})"


def placed(where: str = "true") -> str:
    return f"{POINTS}, m AS (SELECT *, {lng_x('lng')} AS mx, {lat_y('lat')} AS my FROM pts WHERE {where})"


PLACED = placed()


def inside(v: Viewport, x: str = "mx", y: str = "my") -> str:
    each = [f"({x} > {num(a)} AND {x} < {num(c)} AND {y} > {num(b)} AND {y} < {num(d)})" for a, b, c, d in rectangles(v)]
    return f"({' OR '.join(each)})"


def pixels(v: Viewport) -> str:
    """With PLACED before it: px(point_id, ts, lng, lat, i, j)."""
    x0, y0, x1, y1 = v.mercator
    return f"""px AS (SELECT * FROM (
      SELECT *, CAST(floor((mx - {num(x0)}) * {v.res_x} / {num(x1 - x0)}) AS BIGINT) AS i, CAST(floor((my - {num(y0)}) * {v.res_y} / {num(y1 - y0)}) AS BIGINT) AS j
      FROM m WHERE {inside(v)}) WHERE i BETWEEN 0 AND {v.res_x - 1} AND j BETWEEN 0 AND {v.res_y - 1})"""


def tree(depth: int, bottom: int | None = None) -> str:
    """deep (deepest cells), lv (all cells of all levels) and nd (nodes of the tree, with is_leaf)."""
    bottom = depth if bottom is None else bottom
    return f"""deep AS MATERIALIZED (SELECT CAST(floor(mx * {2**depth}) AS BIGINT) AS ci, CAST(floor(my * {2**depth}) AS BIGINT) AS cj, count(*) AS cnt, min(point_id) AS first
      FROM m WHERE mx >= 0 AND mx < 1 AND my >= 0 AND my < 1 GROUP BY 1, 2),
    lev AS (SELECT CAST(unnest(generate_series(0, {bottom})) AS INT) AS level),
    lv AS MATERIALIZED (SELECT level, ci >> ({depth} - level) AS ci, cj >> ({depth} - level) AS cj, CAST(sum(cnt) AS BIGINT) AS cnt, min(first) AS first FROM deep, lev GROUP BY 1, 2, 3),
    nd AS (SELECT level, ci, cj, cnt, first, (cnt = 1 OR level = {depth}) AS is_leaf FROM (SELECT *, sum(cnt) OVER (PARTITION BY level, ci >> 1, cj >> 1) AS family FROM lv) WHERE level = 0 OR family >= 2)"""


def meets(v: Viewport, level: str = "level") -> str:
    x0, y0, x1, y1 = v.mercator
    w = f"pow({num(0.5)}, {level})"
    return f"NOT (ci * {w} > {num(x1)} OR (ci + 1) * {w} < {num(x0)} OR cj * {w} > {num(y1)} OR (cj + 1) * {w} < {num(y0)})"


def frontier(v: Viewport, level: int, depth: int) -> str:
    level = min(level, depth)
    return f"{tree(depth, level)}, fr AS (SELECT nd.*, m.mx AS fx, m.my AS fy FROM nd JOIN m ON m.point_id = nd.first WHERE (is_leaf OR level = {level}) AND {meets(v)})"


def grid(v: Viewport, depth: int) -> str:
    w = f"pow({num(0.5)}, level)"
    return f"""{frontier(v, grid_level(v), depth)}, g AS (SELECT level, ci, cj, cnt,
      CASE WHEN is_leaf THEN fx ELSE (ci + {num(0.5)}) * {w} END AS x, CASE WHEN is_leaf THEN fy ELSE (cj + {num(0.5)}) * {w} END AS y FROM fr)"""


def centroids(depth: int) -> str:
    """cn(level, ci, cj, cnt, x, y), fam (by parent), er (with error, children) and ce (with child_error, child_mean)."""
    return f"""{tree(depth)},
    wd AS (SELECT deep.ci, deep.cj, deep.cnt, deep.cnt * m.mx AS wx, deep.cnt * m.my AS wy FROM deep JOIN m ON m.point_id = deep.first),
    cn AS MATERIALIZED (SELECT level, ci >> ({depth} - level) AS ci, cj >> ({depth} - level) AS cj, CAST(sum(cnt) AS BIGINT) AS cnt, sum(wx) / sum(cnt) AS x, sum(wy) / sum(cnt) AS y FROM wd, lev GROUP BY 1, 2, 3),
    fam AS (SELECT p.level, p.ci, p.cj, CAST(count(*) AS INT) AS children, sum(c.cnt * sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))) AS far
      FROM cn p JOIN cn c ON c.level = p.level + 1 AND c.ci >> 1 = p.ci AND c.cj >> 1 = p.cj GROUP BY 1, 2, 3),
    er AS MATERIALIZED (SELECT cn.*, CASE WHEN cn.cnt > 1 THEN coalesce(far, 0) ELSE 0 END AS error, coalesce(children, 0) AS children FROM cn LEFT JOIN fam USING (level, ci, cj)),
    up AS (SELECT level - 1 AS level, ci >> 1 AS ci, cj >> 1 AS cj, sum(error) AS child_error, sum(error / cnt) AS child_mean FROM er WHERE level > 0 GROUP BY 1, 2, 3),
    ce AS (SELECT er.*, coalesce(child_error, 0) AS child_error, coalesce(child_mean, 0) AS child_mean FROM er LEFT JOIN up USING (level, ci, cj))"""


def hash_unit(key: str, seed: int = 7) -> str:
    h = f"(({key} * 48271 + {seed * 7919 + 12345}) % 2147483647)"
    return f"(CAST(({h} * 16807 + 97) % 2147483647 AS DOUBLE) / {num(2147483647)})"


def detail(level: int, depth: int) -> str:
    """dt(level, ci, cj, exact, first): for each cell down to a level, its non-empty cells of that level."""
    return f"""fine AS (SELECT CAST(floor(mx * {2**level}) AS BIGINT) AS ci, CAST(floor(my * {2**level}) AS BIGINT) AS cj, min(point_id) AS first
      FROM m WHERE mx >= 0 AND mx < 1 AND my >= 0 AND my < 1 GROUP BY 1, 2),
    lev AS (SELECT CAST(unnest(generate_series(0, {level})) AS INT) AS level),
    dt AS (SELECT level, ci >> ({level} - level) AS ci, cj >> ({level} - level) AS cj, count(*) AS exact, min(first) AS first FROM fine, lev GROUP BY 1, 2, 3)"""
