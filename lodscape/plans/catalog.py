"""Named queries over the fixture tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import projection as J
from ..functions.projection import dbl
from ..functions.viewport import VIEWPORTS, pixel_matrix, screen_xy
from ..operators import agreement, best_first, boxes, budget, centroids, folds, heat, preorder, pyramid, reducers, render, samples, tilted, zorder
from ..sources import messages
from ..sources.index_store import TreeStore
from ..sources.points import PointSource, event_points, event_points_of, pairs_from_json
from ..sources.scratch import new_folder, settled
from ..streaming import progressive, tree_log
from . import oracle as O
from .engine import Engine
from .engine import Query as EngineQuery
from .replay import replayed
from .oracle import num

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
COUNTRY, REGION, CITY, WRAP, WORLD, ODD = (VIEWPORTS[k] for k in ("country", "region", "city", "wrap", "world", "odd"))
#: The depth of the trees in all queries: the operators' own.
DEPTH = NODES = pyramid.DEEP


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + dbl(0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(spark, sf_dir)


def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_mercator(points(spark, sf_dir))


def _r(c: str, alias: str) -> str:
    return f"round({c}, 6) + 0 AS {alias}"


# --- sources and encodings ---------------------------------------------------------------------


@query(f"WITH {O.POINTS} SELECT point_id, {_r('lng', 'lng')}, {_r('lat', 'lat')} FROM pts WHERE keyword = 'click'")
def op_a1_keyword_scan(spark, sf_dir):
    return PointSource(points(spark, sf_dir)).scan("click").select("point_id", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(f"WITH {O.POINTS} SELECT point_id, {_r('lng', 'lng')}, {_r('lat', 'lat')} FROM pts WHERE keyword = 'click' AND ts BETWEEN '2024-01-05' AND '2024-01-15'")
def op_a2_keyword_time_scan(spark, sf_dir):
    found = PointSource(points(spark, sf_dir)).scan("click", "2024-01-05 00:00:00", "2024-01-15 00:00:00", closed=True)
    return found.select("point_id", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(f"WITH {O.POINTS} SELECT point_id, {_r('lng', 'lng')}, {_r('lat', 'lat')} FROM pts WHERE ts >= '2024-01-05' AND ts < '2024-01-15'")
def op_a3_time_scan(spark, sf_dir):
    return PointSource(points(spark, sf_dir)).scan("%", "2024-01-05 00:00:00", "2024-01-15 00:00:00").select("point_id", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(f"WITH {O.PLACED} SELECT {_r('lng', 'lng')}, {_r('lat', 'lat')} FROM m WHERE {O.inside(REGION)}")
def op_a9_point_blocks(spark, sf_dir):
    blocks = messages.point_blocks(reducers.raw_points(points(spark, sf_dir), REGION))
    return messages.points_of_blocks(blocks).select(r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(f"WITH {O.PLACED}, {O.pixels(ODD)} SELECT i, j // 8 AS byte_no, CAST(bit_or(1 << CAST(7 - j % 8 AS INT)) AS BIGINT) AS byte FROM (SELECT DISTINCT i, j FROM px) GROUP BY 1, 2")
def op_a10_bitmap_bytes(spark, sf_dir):
    return messages.bitmap_bytes(reducers.pixel_bitmap(points(spark, sf_dir), ODD))


def _centres(v, digits: int = 6) -> str:
    x0, y0, x1, y1 = v.mercator
    x, y = f"((i + {num(0.5)}) * {num((x1 - x0) / v.res_x)} + {num(x0)})", f"((j + {num(0.5)}) * {num((y1 - y0) / v.res_y)} + {num(y0)})"
    return f"i, j, {_r(O.x_lng(x), 'lng')}, {_r(O.y_lat(y), 'lat')}"


@query(f"WITH {O.PLACED}, {O.pixels(ODD)} SELECT {_centres(ODD)} FROM (SELECT DISTINCT i, j FROM px)")
def op_a11_bitmap_decode(spark, sf_dir):
    packed = messages.bitmap_bytes(reducers.pixel_bitmap(points(spark, sf_dir), ODD))
    return messages.decoded_bitmap(packed, ODD).select("i", "j", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(
    f"""WITH {O.PLACED} SELECT point_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(CAST(round(lng * 1000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(lat * 1000) AS BIGINT) AS VARCHAR) || ']}}}}' AS feature
    FROM m WHERE {O.inside(CITY)}"""
)
def op_a12_geojson(spark, sf_dir):
    found = reducers.raw_points(points(spark, sf_dir), CITY)
    return messages.geojson_features(found.select("point_id", F.round(F.col("lng") * 1000).cast("long").alias("lng"), F.round(F.col("lat") * 1000).cast("long").alias("lat")))


@query(f"WITH {O.PLACED} SELECT point_id, {_r('lat', 'first')}, {_r('lng', 'second')}, CAST(100 AS INT) AS progress FROM m WHERE {O.inside(CITY)}")
def op_a13_pairs(spark, sf_dir):
    pairs = messages.latlng_pairs(reducers.raw_points(points(spark, sf_dir), CITY))
    return pairs.select("point_id", r6(F.col("pair")[0]).alias("first"), r6(F.col("pair")[1]).alias("second"), "progress")


@query(
    f"""WITH {O.POINTS}, o AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY lat, lng) - 1 AS k, lng, lat FROM pts JOIN events ON event_id = point_id)
    SELECT CAST(k AS BIGINT) AS point_id, count(*) AS n, {_r('min(lng)', 'west')}, {_r('max(lat)', 'north')} FROM o GROUP BY 1"""
)
def op_a14_json_pairs(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("point_id"), "user_id")
    files = points(spark, sf_dir).join(users, "point_id").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.array("lat", "lng")))).alias("value"))
    return pairs_from_json(files).groupBy("point_id").agg(F.count("*").alias("n"), r6(F.min("lng")).alias("west"), r6(F.max("lat")).alias("north"))


@query(
    f"""WITH {O.PLACED}, c AS (SELECT keyword, round(avg(lng)) AS a, round(avg(lat)) AS b FROM pts GROUP BY 1),
    l AS (SELECT CAST(row_number() OVER (ORDER BY keyword) - 1 AS INT) AS action, keyword, a - {num(15)} AS west, b - {num(7.5)} AS south, a + {num(15)} AS east, b + {num(7.5)} AS north FROM c)
    SELECT action, l.keyword, CAST(5 AS INT) AS zoom, count(*) AS rows FROM l JOIN m ON m.keyword = l.keyword
    AND mx > {O.lng_x('west')} AND mx < {O.lng_x('east')} AND my > {O.lat_y('north')} AND my < {O.lat_y('south')} GROUP BY 1, 2"""
)
def op_a15_replayed_actions(spark, sf_dir):
    p = points(spark, sf_dir)
    centres = p.groupBy("keyword").agg(F.round(F.avg("lng")).alias("lng"), F.round(F.avg("lat")).alias("lat"))
    log = centres.select((F.row_number().over(Window.orderBy("keyword")) - 1).alias("action"), "keyword", "lng", "lat", F.lit(5).alias("zoom"))
    # so many pixels are 30 by 15 degrees at zoom 5
    wide = 2 * 15 * 256 * 2**5 / 360
    return replayed(Engine(PointSource(p)), log, EngineQuery(algorithm="DataExplorer", resX=wide, resY=wide)).select("action", "keyword", "zoom", "rows")


# --- projections -------------------------------------------------------------------------------


@query(f"WITH {O.PLACED} SELECT point_id, round(mx, 9) AS mx, round(my, 9) AS my FROM m")
def op_b1_mercator(spark, sf_dir):
    return mercator(spark, sf_dir).select("point_id", F.round("mx", 9).alias("mx"), F.round("my", 9).alias("my"))


@query(f"WITH {O.PLACED} SELECT point_id, {_r(O.x_lng('mx'), 'lng')}, {_r(O.y_lat('my'), 'lat')} FROM m")
def op_b3_inverse(spark, sf_dir):
    return mercator(spark, sf_dir).select("point_id", r6(J.x_lng(F.col("mx"))).alias("lng"), r6(J.y_lat(F.col("my"))).alias("lat"))


@query(
    f"""WITH {O.POINTS}, w AS (SELECT point_id, lng * 5 AS a, lat * 3 AS b FROM pts)
    SELECT point_id, round((a + 180) - 360 * floor((a + 180) / 360) - 180, 6) + 0 AS lng, {_r('least(90, greatest(-90, b))', 'lat')} FROM w"""
)
def op_b6_wrap(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("point_id", r6(J.wrap_lng(p["lng"] * 5)).alias("lng"), r6(J.clamp_lat(p["lat"] * 3)).alias("lat"))


@query(
    f"""WITH {O.POINTS} SELECT point_id, {_r('sqrt((lng + 100) * (lng + 100) + (lat - 40) * (lat - 40))', 'distance')},
    lng < -100 AND lat < 40 AS left_below, lng > -100 AND lat > 40 AS right_above FROM pts"""
)
def op_b8_distance(spark, sf_dir):
    p = points(spark, sf_dir)
    a = (p["lng"], p["lat"], dbl(-100), dbl(40))
    return p.select("point_id", r6(J.distance(*a)).alias("distance"), J.left_below(*a).alias("left_below"), J.right_above(*a).alias("right_above"))


@query(f"WITH {O.PLACED}, {O.pixels(REGION)} SELECT point_id, i, j FROM px")
def op_b9_pixel(spark, sf_dir):
    return reducers.snapped(points(spark, sf_dir), REGION).select("point_id", "i", "j")


@query(
    f"""WITH {O.PLACED} SELECT point_id, CAST(trunc((mx - {num(0.125)}) / {num(2.0**-12)}) AS INT) AS i, CAST(trunc((my - {num(0.25)}) / {num(2.0**-12)}) AS INT) AS j
    FROM m WHERE mx >= 0.125 AND mx < 0.375 AND my >= 0.25 AND my < 0.5"""
)
def op_b10_node_pixel(spark, sf_dir):
    p = mercator(spark, sf_dir).where("mx >= 0.125 and mx < 0.375 and my >= 0.25 and my < 0.5")
    i, j = reducers.centre_pixel(p["mx"], p["my"], 0.125, 0.25, 2.0**-12)
    return p.select("point_id", i.alias("i"), j.alias("j"))


@query(f"WITH {O.PLACED} SELECT level, CAST(floor(mx * pow(2, level)) AS BIGINT) AS ci, CAST(floor(my * pow(2, level)) AS BIGINT) AS cj, point_id FROM m, (SELECT CAST(unnest([0, 5, 12]) AS INT) AS level)")
def op_b11_cells(spark, sf_dir):
    p = pyramid.placed(points(spark, sf_dir))
    each = [p.select(F.lit(k).alias("level"), J.cell(F.col("mx"), k).alias("ci"), J.cell(F.col("my"), k).alias("cj"), "point_id") for k in (0, 5, 12)]
    return each[0].union(each[1]).union(each[2])


@query(f"WITH {O.PLACED}, {O.tree(DEPTH, 9)} SELECT level, ci, cj, {O.meets(REGION)} AS meets FROM lv")
def op_b12_cell_meets(spark, sf_dir):
    cells = pyramid.levels(pyramid.deep_cells(points(spark, sf_dir), DEPTH), DEPTH, 0, 9)
    return cells.select("level", "ci", "cj", P.cell_meets(F.col("level"), F.col("ci"), F.col("cj"), REGION).alias("meets"))


_T = "least(1, greatest(0, value / 100 - 0.5))"


@query(
    f"""SELECT event_id, {_r(f'CASE WHEN value / 100 <= 0.5 THEN 0 WHEN value / 100 >= 1.5 THEN 1 ELSE {_T} * {_T} * (3 - 2 * {_T}) END', 'step')},
    CAST(trunc(255 * {num(0.25)} + (event_id % 256) * {num(0.75)}) AS INT) AS blended,
    CAST(trunc({num(0.3)} * (event_id % 256) + {num(0.59)} * (event_id * 7 % 256) + {num(0.11)} * (event_id * 13 % 256)) AS INT) AS gray FROM events"""
)
def op_b13_shading(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    return e.select(
        "event_id",
        r6(J.smooth_step(dbl(0.5), dbl(1.5), F.col("value") / 100)).alias("step"),
        J.blend(F.lit(255), dbl(0.25), n % 256).alias("blended"),
        J.gray(n % 256, n * 7 % 256, n * 13 % 256).alias("gray"),
    )


@query(
    f"""WITH {O.PLACED}, {O.tree(DEPTH)} SELECT zoom, level, CAST(floor(pow(2, 8 + zoom - level) + 0.5) AS BIGINT) AS resolution, count(*) AS nodes
    FROM nd, (SELECT CAST(unnest(generate_series(0, 18)) AS INT) AS zoom) GROUP BY 1, 2"""
)
def op_b16_node_resolution(spark, sf_dir):
    per_level = pyramid.quadtree(points(spark, sf_dir), DEPTH).groupBy("level").agg(F.count("*").alias("nodes"))
    by_zoom = F.array(*[F.struct(F.lit(z).alias("zoom"), J.node_resolution(z, F.col("level")).alias("resolution")) for z in range(19)])
    return per_level.select("level", "nodes", F.explode(by_zoom).alias("r")).select("r.zoom", "level", "r.resolution", "nodes")


_WX = f"({num(512)} * (radians(lng) + {num(J.math.pi)}) / {num(2 * J.math.pi)})"
_WY = f"({num(512)} * ({num(J.math.pi)} + ln(tan({num(J.math.pi / 4)} + radians(lat) / 2))) / {num(2 * J.math.pi)})"


@query(f"WITH {O.POINTS} SELECT point_id, {_r(_WX, 'wx')}, {_r(_WY, 'wy')} FROM pts")
def op_b17_world(spark, sf_dir):
    p = points(spark, sf_dir)
    x, y = J.world(p["lng"], p["lat"])
    return p.select("point_id", r6(x).alias("wx"), r6(y).alias("wy"))


_M = pixel_matrix(1920, 978, -96.328125, 39.50404070558415, 3)


@query(
    f"WITH {O.POINTS}, w AS (SELECT point_id, {_WX} AS x, {_WY} AS y FROM pts) SELECT point_id, "
    + ", ".join(f"round(({num(_M[r, 0])} * x + {num(_M[r, 1])} * y + {num(_M[r, 3])}) / ({num(_M[3, 0])} * x + {num(_M[3, 1])} * y + {num(_M[3, 3])}), 4) + 0 AS {n}" for r, n in ((0, "px"), (1, "py")))
    + " FROM w"
)
def op_b18_screen(spark, sf_dir):
    p = points(spark, sf_dir)
    x, y, _ = screen_xy(p["lng"], p["lat"], _M)
    return p.select("point_id", (F.round(x, 4) + dbl(0)).alias("px"), (F.round(y, 4) + dbl(0)).alias("py"))


@query("SELECT event_id, CAST((event_id >> 16) & 255 AS BIGINT) AS r, CAST((event_id >> 8) & 255 AS BIGINT) AS g, CAST(event_id & 255 AS BIGINT) AS b, event_id AS back FROM events")
def op_b23_id_colour(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r, g, b = J.id_rgb(F.col("event_id"))
    return e.select("event_id", r.alias("r"), g.alias("g"), b.alias("b"), J.rgb_id(r, g, b).alias("back"))


_SHOWN = pixel_matrix(1920, 978, -95.0, 37.5, 5, 30, 15)


@query(
    f"WITH {O.POINTS}, w AS (SELECT point_id, {_WX} AS x, {_WY} AS y FROM pts) SELECT point_id, "
    + ", ".join(f"round(({num(_SHOWN[r, 0])} * x + {num(_SHOWN[r, 1])} * y + {num(_SHOWN[r, 3])}) / ({num(_SHOWN[3, 0])} * x + {num(_SHOWN[3, 1])} * y + {num(_SHOWN[3, 3])}), 3) + 0 AS {n}" for r, n in ((0, "px"), (1, "py")))
    + " FROM w"
)
def op_b21_tilted_screen(spark, sf_dir):
    p = points(spark, sf_dir)
    x, y, _ = screen_xy(p["lng"], p["lat"], _SHOWN)
    return p.select("point_id", (F.round(x, 3) + dbl(0)).alias("px"), (F.round(y, 3) + dbl(0)).alias("py"))


@query(f"WITH {O.PLACED} SELECT point_id, {_r('mx * 256', 'px')}, {_r('my * 256', 'py')} FROM m")
def op_b22_tile_pixels(spark, sf_dir):
    return mercator(spark, sf_dir).select("point_id", r6(F.col("mx") * dbl(J.TILE)).alias("px"), r6(F.col("my") * dbl(J.TILE)).alias("py"))


# --- filters -----------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])worthless([^a-z0-9]|$)') OR regexp_matches(lower(text), '(^|[^a-z0-9])idiot([^a-z0-9]|$)')")
def op_c1_text_match(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(P.text_matches(docs["text"], "worthless | idiot")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])erin([^a-z0-9]|$)') AND NOT regexp_matches(lower(text), '(^|[^a-z0-9])worthless([^a-z0-9]|$)') OR regexp_matches(lower(text), '(^|[^a-z0-9])hes[^a-z0-9]+anti([^a-z0-9]|$)')")
def op_c1_text_phrase(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(P.text_matches(docs["text"], "(erin & !worthless) | hes <-> anti")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])worthless([^a-z0-9]|$)') OR regexp_matches(lower(text), '(^|[^a-z0-9])idiot(s|ic|ics|ed|ing)?([^a-z0-9]|$)')")
def op_c1_stemmed_match(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = PointSource(docs.select("doc_id", "text", *[F.lit(0.0).alias(c) for c in ("ts", "lng", "lat")]), point_id="doc_id", text="text")
    return source.scan("worthless | idiots").select(F.col("point_id").alias("doc_id"))


@query(f"WITH {O.POINTS} SELECT keyword, count(*) AS n FROM pts GROUP BY 1")
def op_c2_wildcard(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where(P.keyword_is(p["keyword"], "%")).groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"WITH {O.POINTS} SELECT keyword, count(*) AS n FROM pts WHERE ts BETWEEN '2024-01-05' AND '2024-01-10' GROUP BY 1")
def op_c3_closed_slice(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where(P.in_slice(p["ts"], "2024-01-05 00:00:00", "2024-01-10 00:00:00", closed=True)).groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"WITH {O.PLACED} SELECT point_id FROM m WHERE {O.inside(REGION)}")
def op_c4_rectangle(spark, sf_dir):
    p = mercator(spark, sf_dir)
    return p.where(P.strictly_within(p["mx"], p["my"], *REGION.mercator)).select("point_id")


_W = "WITH far AS (SELECT event_id, CAST(event_id * 37 % 360 - 180 AS DOUBLE) AS lng, CAST(event_id * 53 % 150 - 75 AS DOUBLE) AS lat FROM events)"


@query(f"{_W}, m AS (SELECT event_id, {O.lng_x('lng')} AS mx, {O.lat_y('lat')} AS my FROM far) SELECT event_id FROM m WHERE {O.inside(WRAP)}")
def op_c5_wrapped(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    far = e.select("event_id", (F.col("event_id") * 37 % 360 - 180).cast("double").alias("lng"), (F.col("event_id") * 53 % 150 - 75).cast("double").alias("lat"))
    far = J.with_mercator(far)
    return far.where(P.in_viewport(far["mx"], far["my"], WRAP)).select("event_id")


@query(f"WITH {O.PLACED} SELECT point_id FROM m WHERE (mx - {num(0.23)}) * (mx - {num(0.23)}) + (my - {num(0.38)}) * (my - {num(0.38)}) <= {num(0.02 * 0.02)}")
def op_c6_circle(spark, sf_dir):
    p = mercator(spark, sf_dir)
    return p.where(P.within_circle(p["mx"], p["my"], 0.23, 0.38, 0.02)).select("point_id")


@query(f"WITH {O.POINTS} SELECT point_id, round({O.hash_unit('point_id')}, 9) AS u FROM pts WHERE {O.hash_unit('point_id')} < {num(0.1)}")
def op_c9_bernoulli(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where(P.bernoulli(p["point_id"], 0.1)).select("point_id", F.round(P.hash_unit(p["point_id"]), 9).alias("u"))


@query(f"WITH {O.POINTS} SELECT point_id FROM pts WHERE lng BETWEEN -110 AND -80 AND lat BETWEEN 30 AND 45")
def op_c10_bounds(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where(P.in_bounds(p["lng"], p["lat"], -110, 30, -80, 45)).select("point_id")


@query(f"WITH {O.PLACED}, c AS (SELECT point_id, CAST(floor(mx * 512) AS BIGINT) AS ci, CAST(floor(my * 512) AS BIGINT) AS cj, 9 AS level FROM m) SELECT point_id FROM c WHERE {O.meets(CITY)}")
def op_c7_cell_filter(spark, sf_dir):
    p = pyramid.placed(points(spark, sf_dir)).select("point_id", J.cell(F.col("mx"), 9).alias("ci"), J.cell(F.col("my"), 9).alias("cj"))
    return p.where(P.cell_meets(F.lit(9), F.col("ci"), F.col("cj"), CITY)).select("point_id")


@query(
    """WITH b AS (SELECT event_id, CAST(event_id * 37 % 360 - 180 AS DOUBLE) AS w, CAST(event_id * 53 % 150 - 75 AS DOUBLE) AS s FROM events)
    SELECT event_id FROM b WHERE w <= -80 AND w + 5 >= -110 AND s <= 45 AND s + 5 >= 30"""
)
def op_c10_bounds_overlap(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    b = e.select("event_id", (F.col("event_id") * 37 % 360 - 180).cast("double").alias("w"), (F.col("event_id") * 53 % 150 - 75).cast("double").alias("s"))
    return b.where(P.bounds_overlap((b["w"], b["s"], b["w"] + 5, b["s"] + 5), -110, 30, -80, 45)).select("event_id")


# --- spatial index -----------------------------------------------------------------------------


@query(f"WITH {O.POINTS} SELECT a.point_id FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.lng = a.lng AND b.lat = a.lat AND b.keyword = 'click')")
def op_d2_delete(spark, sf_dir):
    p = points(spark, sf_dir)
    gone = p.where("keyword = 'click'").select("lng", "lat").distinct()
    return p.join(gone, ["lng", "lat"], "left_anti").select("point_id")


@query(f"WITH {O.PLACED} SELECT count(*) AS n, count(DISTINCT point_id) AS ids, min(point_id) AS first, max(point_id) AS last FROM m WHERE {O.inside(COUNTRY)}")
def op_d3_range(spark, sf_dir):
    found = reducers.raw_points(points(spark, sf_dir), COUNTRY)
    return found.agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("ids"), F.min("point_id").alias("first"), F.max("point_id").alias("last"))


@query(f"WITH {O.PLACED}, {O.tree(16, 0)}, z AS (SELECT {' + '.join(f'(((deep.ci >> {b}) & 1) << {2 * b}) + (((deep.cj >> {b}) & 1) << {2 * b + 1})' for b in range(16))} AS z, cnt FROM deep) SELECT z, CAST(sum(cnt) AS BIGINT) AS n FROM z GROUP BY 1")
def op_d1_clustered(spark, sf_dir):
    return pyramid.clustered(points(spark, sf_dir), 8).groupBy("z").agg(F.count("*").alias("n"))


@query(f"WITH {O.PLACED}, {O.pixels(REGION)} SELECT i, j, count(*) AS positions FROM (SELECT DISTINCT i, j, lng, lat FROM px) GROUP BY 1, 2")
def op_d4_distinct_positions(spark, sf_dir):
    return reducers.snapped(points(spark, sf_dir), REGION).select("i", "j", "lng", "lat").distinct().groupBy("i", "j").agg(F.count("*").alias("positions"))


@query(f"WITH {O.POINTS} SELECT {_r('lng', 'lng')}, {_r('lat', 'lat')}, count(*) AS n, min(point_id) AS first FROM pts GROUP BY lng, lat")
def op_d5_duplicates(spark, sf_dir):
    return points(spark, sf_dir).groupBy("lng", "lat").agg(F.count("*").alias("n"), F.min("point_id").alias("first")).select(r6("lng").alias("lng"), r6("lat").alias("lat"), "n", "first")


@query(f"WITH {O.PLACED}, {O.tree(12, 12)} SELECT ci, cj, cnt FROM lv WHERE level = 12 AND {O.meets(REGION)}")
def op_d1_z_cover(spark, sf_dir):
    cells = pyramid.deep_cells(points(spark, sf_dir), 12).withColumn("z", pyramid.morton(F.col("ci"), F.col("cj"), 12))
    cells = settled(cells.repartitionByRange(8, "z").sortWithinPartitions("z"), "z-cells")
    return zorder.covered_cells(cells, REGION, 12).select("ci", "cj", "cnt")


@query(f"WITH {O.PLACED} SELECT point_id, {_r('lng', 'lng')}, {_r('lat', 'lat')} FROM m WHERE {O.inside(REGION)}")
def op_d3_z_table(spark, sf_dir):
    table = zorder.PointTable(new_folder(spark, "z-table")).write(points(spark, sf_dir), 8)
    return table.read(spark, REGION).select("point_id", r6("lng").alias("lng"), r6("lat").alias("lat"))


def _far(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("point_id"), (F.col("event_id") * 37 % 360 - 180).cast("double").alias("lng"), (F.col("event_id") * 53 % 150 - 75).cast("double").alias("lat"))


@query(f"{_W}, m AS (SELECT event_id, {O.lng_x('lng')} AS mx, {O.lat_y('lat')} AS my FROM far) SELECT event_id AS point_id FROM m WHERE {O.inside(WRAP)}")
def op_c5_z_wrapped(spark, sf_dir):
    return zorder.PointTable(new_folder(spark, "z-table")).write(_far(spark, sf_dir), 8).read(spark, WRAP).select("point_id")


_BOXES = """b AS (SELECT event_id, CAST(event_id * 37 % 360 AS DOUBLE) / 360 AS x0, CAST(event_id * 53 % 150 AS DOUBLE) / 150 AS y0,
      CAST(event_id * 37 % 360 AS DOUBLE) / 360 + CAST(event_id % 13 AS DOUBLE) / 2000 AS x1, CAST(event_id * 53 % 150 AS DOUBLE) / 150 + CAST(event_id % 7 AS DOUBLE) / 1000 AS y1 FROM events)"""


def _boxes(spark, sf_dir) -> DataFrame:
    n, d = F.col("event_id"), lambda c: c.cast("double")
    x, y = d(n * 37 % 360) / dbl(360), d(n * 53 % 150) / dbl(150)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", x.alias("x0"), y.alias("y0"), (x + d(n % 13) / dbl(2000)).alias("x1"), (y + d(n % 7) / dbl(1000)).alias("y1"))


@query(
    f"""WITH {_BOXES}, lv AS (SELECT CAST(unnest(generate_series(0, 6)) AS INT) AS level),
    c AS (SELECT *, pow(2, level) AS n, CAST(greatest(ceil(x0 * pow(2, level)) - 1, 0) AS BIGINT) AS ci, CAST(greatest(ceil(y0 * pow(2, level)) - 1, 0) AS BIGINT) AS cj FROM b, lv),
    f AS MATERIALIZED (SELECT * FROM c WHERE level = 0 OR (x1 <= 1 AND y1 <= 1 AND x1 * n <= ci + 1 AND y1 * n <= cj + 1)),
    sp AS (SELECT level, ci, cj FROM f WHERE level < 6 GROUP BY 1, 2, 3 HAVING count(*) > 6),
    ok AS (SELECT f.event_id, f.level, f.ci, f.cj FROM f LEFT JOIN sp ON sp.level = f.level - 1 AND sp.ci = f.ci >> 1 AND sp.cj = f.cj >> 1 WHERE f.level = 0 OR sp.level IS NOT NULL)
    SELECT event_id, level, ci, cj FROM ok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY level DESC) = 1"""
)
def op_d7_box_tree(spark, sf_dir):
    return boxes.box_tree(_boxes(spark, sf_dir)).select("event_id", "level", "ci", "cj")


@query(f"WITH {_BOXES} SELECT event_id FROM b WHERE x0 <= 0.25 AND x1 >= 0.2 AND y0 <= 0.5 AND y1 >= 0.4")
def op_d7_boxes_in_bounds(spark, sf_dir):
    return boxes.overlapping(boxes.box_tree(_boxes(spark, sf_dir)), 0.2, 0.4, 0.25, 0.5).select("event_id")


@query(
    f"""WITH {O.PLACED}, l AS (SELECT keyword AS a, CAST(floor(mx * 16) AS BIGINT) * 16 + CAST(floor(my * 16) AS BIGINT) AS b FROM m),
    x AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM l GROUP BY a, b)) AS together, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM l GROUP BY a)) AS sa,
      (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM l GROUP BY b)) AS sb, (SELECT count(*) FROM l) AS n),
    y AS (SELECT *, CAST(n AS DOUBLE) * (n - 1) / 2 AS pairs FROM x)
    SELECT n, CAST(pairs AS BIGINT) AS pairs, CAST(together AS BIGINT) AS together, CAST(pairs + together - sa - sb AS BIGINT) AS apart, {_r('(pairs + 2 * together - sa - sb) / pairs', 'rand')},
      {_r('(together - sa * sb / pairs) / ((sa + sb) / 2 - sa * sb / pairs)', 'adjusted')} FROM y"""
)
def op_j6_rand_index(spark, sf_dir):
    p = mercator(spark, sf_dir)
    labelled = p.select(F.col("keyword").alias("a"), (J.cell(F.col("mx"), 4) * 16 + J.cell(F.col("my"), 4)).alias("b"))
    r = agreement.rand_index(labelled, "a", "b")
    return r.select("n", "pairs", "together", "apart", r6("rand").alias("rand"), r6("adjusted").alias("adjusted"))


# --- trees that are kept -----------------------------------------------------------------------


@query(f"WITH {O.PLACED}, {O.grid(REGION, DEPTH)} SELECT level, ci, cj, cnt, round(x, 9) AS x, round(y, 9) AS y FROM g")
def op_a6_stored_tree(spark, sf_dir):
    store = TreeStore(new_folder(spark, "trees"), "events")
    store.write(pyramid.quadtree(points(spark, sf_dir)), "counts")
    nodes = store.read(spark, "counts", REGION, reducers.grid_level(REGION))
    return reducers.grid_of(nodes, REGION).select("level", "ci", "cj", "cnt", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _first_deepest(depth: int) -> str:
    return " + ".join(f"((((ci << ({depth} - level)) >> {b}) & 1) << {2 * b}) + ((((cj << ({depth} - level)) >> {b}) & 1) << {2 * b + 1})" for b in range(depth))


@query(f"WITH {O.PLACED}, {O.tree(DEPTH)}, k AS (SELECT *, {_first_deepest(DEPTH)} AS z FROM nd) SELECT CAST(row_number() OVER (ORDER BY z, level) - 1 AS BIGINT) AS n, level, ci, cj, CAST((ci & 1) + 2 * (cj & 1) AS INT) AS quadrant, cnt FROM k")
def op_a5_preorder(spark, sf_dir):
    return preorder.preorder(pyramid.quadtree(points(spark, sf_dir))).select("n", "level", "ci", "cj", "quadrant", "cnt")


@query(f"WITH {O.PLACED}, {O.tree(DEPTH)} SELECT level, ci, cj, cnt FROM nd")
def op_a6_tree_lines(spark, sf_dir):
    path = new_folder(spark, "tree-lines")
    preorder.write_lines(pyramid.quadtree(points(spark, sf_dir)).select("level", "ci", "cj", "cnt"), path)
    return preorder.read_lines(spark, path).select("level", "ci", "cj", "cnt")


@query(f"WITH {O.PLACED}, {O.centroids(NODES)} SELECT level, ci, cj, cnt, {_r('error', 'error')}, {_r('child_error', 'child_error')} FROM ce WHERE level <= 13 AND {O.meets(REGION)}")
def op_a7_stored_centroids(spark, sf_dir):
    store = TreeStore(new_folder(spark, "trees"), "events")
    store.write(centroids.centroid_nodes(points(spark, sf_dir)), "centroids")
    nodes = store.read(spark, "centroids", REGION, 13)
    met = nodes.where(P.cell_meets(F.col("level"), F.col("ci"), F.col("cj"), REGION))
    return met.select("level", "ci", "cj", "cnt", r6("error").alias("error"), r6("child_error").alias("child_error"))


_REQUEST = {"type": "query", "keyword": "click", "query": {"algorithm": "QuadTree", "zoom": REGION.zoom, "bbox": [REGION.west, REGION.south, REGION.east, REGION.north], "resX": REGION.res_x, "resY": REGION.res_y}}


@query(
    f"""WITH {O.placed("keyword = 'click'")}, {O.grid(REGION, DEPTH)} SELECT step, {_r(O.x_lng('x'), 'lng')}, {_r(O.y_lat('y'), 'lat')}
    FROM g, (SELECT unnest(['1 built', '2 cached', '3 stored']) AS step)"""
)
def op_j4_query_order(spark, sf_dir):
    store = TreeStore(new_folder(spark, "trees"), "events")
    first, later = (Engine(PointSource(points(spark, sf_dir)), store=store) for _ in range(2))
    out = None
    for k, engine in enumerate((first, first, later), 1):
        found = engine.handle(_REQUEST)["result"]
        found = found.select(F.lit(f"{k} {engine.last_step}").alias("step"), r6("lng").alias("lng"), r6("lat").alias("lat"))
        out = found if out is None else out.union(found)
    return out


# --- level of detail ---------------------------------------------------------------------------


@query(f"WITH {O.PLACED} SELECT point_id, {_r('lng', 'lng')}, {_r('lat', 'lat')} FROM m WHERE {O.inside(REGION)}")
def op_e1_raw_points(spark, sf_dir):
    return reducers.raw_points(points(spark, sf_dir), REGION).select("point_id", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(f"WITH {O.PLACED}, {O.pixels(REGION)} SELECT i, j, min(point_id) AS point_id, {_r('arg_min(lng, point_id)', 'lng')}, {_r('arg_min(lat, point_id)', 'lat')} FROM px GROUP BY 1, 2")
def op_e2_pixel_points(spark, sf_dir):
    return reducers.pixel_points(points(spark, sf_dir), REGION).select("i", "j", "point_id", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query(f"WITH {O.PLACED}, {O.pixels(COUNTRY)} SELECT DISTINCT i, j FROM px")
def op_e3_pixel_bitmap(spark, sf_dir):
    return reducers.pixel_bitmap(points(spark, sf_dir), COUNTRY)


@query()
def op_e4_drawn_points(spark, sf_dir):
    return folds.drawn_points(points(spark, sf_dir), ODD)


@query(f"WITH {O.PLACED}, {O.grid(REGION, DEPTH)} SELECT level, ci, cj, cnt, round(x, 9) AS x, round(y, 9) AS y FROM g")
def op_e5_grid_points(spark, sf_dir):
    return reducers.grid_points(points(spark, sf_dir), REGION, DEPTH).select("level", "ci", "cj", "cnt", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _gp(v) -> str:
    x0, y0, x1, y1 = v.mercator
    return f"SELECT CAST(floor((x - {num(x0)}) * {v.res_x} / {num(x1 - x0)}) AS BIGINT) AS i, CAST(floor((y - {num(y0)}) * {v.res_y} / {num(y1 - y0)}) AS BIGINT) AS j FROM g"


@query(f"WITH {O.PLACED}, {O.grid(ODD, DEPTH)} SELECT DISTINCT i, j FROM ({_gp(ODD)}) WHERE i BETWEEN 0 AND {ODD.res_x - 1} AND j BETWEEN 0 AND {ODD.res_y - 1}")
def op_e6_grid_bitmap(spark, sf_dir):
    return reducers.grid_bitmap(points(spark, sf_dir), ODD, DEPTH)


@query(f"WITH {O.PLACED}, {O.tree(DEPTH)} SELECT level, ci, cj, cnt, first, is_leaf FROM nd")
def op_e7_quadtree(spark, sf_dir):
    return pyramid.quadtree(points(spark, sf_dir), DEPTH).select("level", "ci", "cj", "cnt", F.col("first.point_id").alias("first"), "is_leaf")


@query(f"WITH {O.PLACED}, {O.tree(27, 0)} SELECT CAST(sum(cnt) AS BIGINT) AS total, count(*) AS stored, CAST(sum(cnt) - count(*) AS BIGINT) AS skipped FROM deep")
def op_e7_load_statistics(spark, sf_dir):
    return pyramid.load_statistics(points(spark, sf_dir))


@query()
def op_e8_rendered_cells(spark, sf_dir):
    return folds.rendered_cells(points(spark, sf_dir), COUNTRY)


@query(f"WITH {O.PLACED}, {O.tree(19, 14)} SELECT ci >> 6 AS ci, cj >> 6 AS cj, count(*) AS samples FROM lv WHERE level = 14 GROUP BY 1, 2")
def op_e9_level_counts(spark, sf_dir):
    return pyramid.level_counts(points(spark, sf_dir), 8, 14)


@query(f"WITH {O.PLACED}, {O.frontier(COUNTRY, 12, 19)} SELECT level, ci, cj, cnt, first AS point_id, round(fx, 9) AS x, round(fy, 9) AS y FROM fr")
def op_e10_first_arrivals(spark, sf_dir):
    return reducers.first_arrivals(points(spark, sf_dir), COUNTRY).select("level", "ci", "cj", "cnt", "point_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query()
def op_e11_rendered_cells_all(spark, sf_dir):
    return folds.rendered_cells(points(spark, sf_dir), COUNTRY, samples_from=0)


@query(f"WITH {O.PLACED}, {O.centroids(NODES)} SELECT level, ci, cj, cnt, round(x, 9) AS x, round(y, 9) AS y FROM cn")
def op_e12_centroids(spark, sf_dir):
    return centroids.centroid_nodes(points(spark, sf_dir), NODES).select("level", "ci", "cj", "cnt", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"WITH {O.PLACED}, {O.centroids(NODES)} SELECT level, ci, cj, children, {_r('error', 'error')}, {_r('child_error', 'child_error')}, {_r('error / cnt', 'mean_error')} FROM ce")
def op_e13_centroid_errors(spark, sf_dir):
    n = centroids.centroid_nodes(points(spark, sf_dir), NODES)
    return n.select("level", "ci", "cj", "children", r6("error").alias("error"), r6("child_error").alias("child_error"), r6(F.col("error") / F.col("cnt")).alias("mean_error"))


@query(f"WITH {O.PLACED}, {O.tree(DEPTH)} SELECT level, count(*) AS nodes, CAST(sum(cnt) AS BIGINT) AS points, min(cnt) AS least, max(cnt) AS most FROM nd GROUP BY 1")
def op_e14_index_statistics(spark, sf_dir):
    return pyramid.index_statistics(pyramid.quadtree(points(spark, sf_dir), DEPTH))


@query(f"WITH {O.PLACED}, {O.tree(DEPTH)} SELECT CAST(least(floor(cnt / 10.0), 100) AS BIGINT) AS bucket, count(*) AS nodes FROM nd WHERE level > 5 GROUP BY 1")
def op_e15_index_histogram(spark, sf_dir):
    return pyramid.index_histogram(pyramid.quadtree(points(spark, sf_dir), DEPTH).where("level > 5"), 10)


@query(f"WITH {O.PLACED}, {O.frontier(COUNTRY, 12, 19)} SELECT level, count(*) AS nodes, CAST(sum(cnt) AS BIGINT) AS points FROM fr GROUP BY 1")
def op_e16_stop_levels(spark, sf_dir):
    return reducers.stop_levels(points(spark, sf_dir), COUNTRY)


def _heat(v) -> str:
    x0, y0, x1, y1 = v.mercator
    return f"""h AS (SELECT (mx - {num(x0)}) * {v.res_x} / {num(x1 - x0)} AS sx, (my - {num(y0)}) * {v.res_y} / {num(y1 - y0)} AS sy FROM m WHERE {O.inside(v)})
    SELECT CAST(floor(sx / 12.5) AS BIGINT) AS gx, CAST(floor(sy / 12.5) AS BIGINT) AS gy, round(avg(sx), 4) + 0 AS x, round(avg(sy), 4) + 0 AS y, {_r(f'least(count(*) * {num(10 * 2.0**-12)}, 1)', 'w')} FROM h GROUP BY 1, 2"""


@query(f"WITH {O.PLACED}, {_heat(REGION)}")
def op_e17_heatmap(spark, sf_dir):
    h = reducers.heatmap(points(spark, sf_dir), REGION)
    return h.select("gx", "gy", (F.round("x", 4) + dbl(0)).alias("x"), (F.round("y", 4) + dbl(0)).alias("y"), r6("w").alias("w"))


_BELL = ", ".join(num(w) for w in heat.stencil(5, 3))
_STEPS = f"st AS (SELECT d, list_extract([{_BELL}], CAST(abs(d) + 1 AS INT)) AS k FROM (SELECT unnest(generate_series(-8, 8)) AS d))"


@query(
    f"""WITH {O.PLACED}, {O.pixels(ODD)}, {_STEPS}, c AS (SELECT i, j, least(count(*) * {num(10 * 2.0**-12)}, 1) AS w FROM px GROUP BY 1, 2)
    SELECT i + a.d AS i, j + b.d AS j, {_r('least(sum(w * a.k * b.k), 1)', 'heat')} FROM c, st a, st b
    WHERE i + a.d BETWEEN 0 AND {ODD.res_x - 1} AND j + b.d BETWEEN 0 AND {ODD.res_y - 1} GROUP BY 1, 2"""
)
def op_e17_heat_picture(spark, sf_dir):
    return heat.heat_picture(points(spark, sf_dir), ODD, 5, 3).select("i", "j", r6("heat").alias("heat"))


@query(f"WITH {O.PLACED}, {O.pixels(COUNTRY)} SELECT count(*) AS points, count(DISTINCT i * 100000 + j) AS pixels FROM px")
def op_e18_result_count(spark, sf_dir):
    return reducers.snapped(points(spark, sf_dir), COUNTRY).agg(F.count("*").alias("points"), F.count_distinct("i", "j").alias("pixels"))


# --- sampling under a budget -------------------------------------------------------------------


def _z(bits: int) -> str:
    return " + ".join(f"(((deep.ci >> {b}) & 1) << {2 * b}) + (((deep.cj >> {b}) & 1) << {2 * b + 1})" for b in range(bits))


@query(
    f"""WITH {O.PLACED}, {O.tree(NODES)}, zd AS (SELECT ci, cj, cnt, first, {_z(NODES)} AS z FROM deep)
    SELECT level, ci >> ({NODES} - level) AS ci, cj >> ({NODES} - level) AS cj, CAST(sum(cnt) AS BIGINT) AS cnt, arg_min(first, z) AS point_id FROM zd, lev GROUP BY 1, 2, 3"""
)
def op_f1_snap_samples(spark, sf_dir):
    return samples.snap_samples(points(spark, sf_dir), NODES).select("level", "ci", "cj", "cnt", "point_id")


@query()
def op_f2_error_nodes(spark, sf_dir):
    return samples.error_nodes(points(spark, sf_dir))


@query()
def op_f3_error_benefit(spark, sf_dir):
    return samples.error_nodes(points(spark, sf_dir)).select("level", "ci", "cj", centroids.error_benefit(2).alias("benefit"))


@query()
def op_f6_query_time_benefit(spark, sf_dir):
    return samples.error_nodes(points(spark, sf_dir)).select("level", "ci", "cj", centroids.plain_error_benefit(2).alias("benefit"))


@query()
def op_f7_error_best_first(spark, sf_dir):
    nodes = samples.error_nodes(points(spark, sf_dir), NODES)
    return best_first.best_first(nodes, centroids.error_benefit(REGION.zoom, NODES), REGION)


_MAX = num(centroids.MOST)


@query(
    f"""WITH {O.PLACED}, {O.centroids(NODES)} SELECT level, ci, cj, CASE WHEN cnt = 1 OR level = {NODES} THEN 0 WHEN level < 8 OR children = 1 THEN {_MAX}
    ELSE round((error - child_error / 4) / (children - 1), 6) + 0 END AS benefit FROM ce"""
)
def op_f4_distance_benefit(spark, sf_dir):
    n = centroids.centroid_nodes(points(spark, sf_dir), NODES).select("level", "ci", "cj", centroids.distance_benefit(NODES).alias("b"))
    return n.select("level", "ci", "cj", F.when(F.col("b") == centroids.MOST, F.col("b")).otherwise(r6("b")).alias("benefit"))


@query(
    f"""WITH {O.PLACED}, {O.centroids(NODES)}, s AS (SELECT *, greatest(pow(2, 12 - level), 1) AS r FROM ce)
    SELECT level, ci, cj, CASE WHEN cnt = 1 OR level = {NODES} THEN 0 WHEN level < 8 THEN {_MAX} WHEN level >= 12 THEN 0 WHEN children = 1 THEN {_MAX}
    ELSE round((error / cnt * r * r - child_mean * greatest(floor(r / 2), 1) * greatest(floor(r / 2), 1) / 4) / (children - 1), 4) + 0 END AS benefit FROM s"""
)
def op_f5_screen_benefit(spark, sf_dir):
    n = centroids.centroid_nodes(points(spark, sf_dir), NODES).select("level", "ci", "cj", centroids.screen_benefit(4, NODES).alias("b"))
    return n.select("level", "ci", "cj", F.when(F.col("b") == centroids.MOST, F.col("b")).otherwise(F.round("b", 4) + dbl(0)).alias("benefit"))


@query(
    f"""WITH RECURSIVE {O.PLACED}, {O.centroids(DEPTH)}, s AS (SELECT *, greatest(pow(2, {REGION.zoom + 8} - level), 1) AS r FROM ce WHERE {O.meets(REGION)}),
    bn AS MATERIALIZED (SELECT level, ci, cj, x, y, CASE WHEN cnt = 1 OR level = {DEPTH} THEN 0 WHEN level < 8 THEN {_MAX} WHEN level >= {REGION.zoom + 8} THEN 0 WHEN children = 1 THEN {_MAX}
      ELSE (error / cnt * r * r - child_mean * greatest(floor(r / 2), 1) * greatest(floor(r / 2), 1) / 4) / (children - 1) END AS benefit FROM s),
    reached AS (SELECT * FROM bn WHERE level = 0 UNION ALL SELECT c.* FROM reached p JOIN bn c ON c.level = p.level + 1 AND c.ci >> 1 = p.ci AND c.cj >> 1 = p.cj WHERE p.benefit > 0)
    SELECT level, ci, cj, round(x, 9) AS x, round(y, 9) AS y FROM reached WHERE benefit <= 0"""
)
def op_f7_best_first(spark, sf_dir):
    nodes = centroids.centroid_nodes(points(spark, sf_dir), DEPTH)
    found = best_first.best_first(nodes, centroids.screen_benefit(REGION.zoom, DEPTH), REGION)
    return found.select("level", "ci", "cj", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _searched(v, n: int) -> str:
    """A search step by step: the frontier as a list sorted by benefit, level and place, and what is left of the budget."""
    return f"""s AS (SELECT *, greatest(pow(2, {v.zoom + 8} - level), 1) AS r FROM ce WHERE {O.meets(v)}),
    bn AS MATERIALIZED (SELECT level, ci, cj, x, y, CASE WHEN cnt = 1 OR level = {DEPTH} THEN 0 WHEN level < 8 THEN {_MAX} WHEN level >= {v.zoom + 8} THEN 0 WHEN children = 1 THEN {_MAX}
      ELSE (error / cnt * r * r - child_mean * greatest(floor(r / 2), 1) * greatest(floor(r / 2), 1) / 4) / (children - 1) END AS benefit FROM s),
    fm AS MATERIALIZED (SELECT level - 1 AS level, ci >> 1 AS ci, cj >> 1 AS cj, list({{'b': -benefit, 'l': level, 'i': ci, 'j': cj}}) AS kids FROM bn WHERE level > 0 GROUP BY 1, 2, 3),
    go AS (
      SELECT [{{'b': -benefit, 'l': level, 'i': ci, 'j': cj}}] AS q, {n - 1} AS free FROM bn WHERE level = 0
      UNION ALL
      SELECT list_sort(list_concat(q[2:], coalesce(kids, []))), free + 1 - coalesce(len(kids), 0)
      FROM go LEFT JOIN fm ON fm.level = q[1].l AND fm.ci = q[1].i AND fm.cj = q[1].j WHERE free > 0 AND len(q) > 0 AND q[1].b < 0
    ),
    ends AS (SELECT unnest(q) AS e FROM (SELECT q FROM go WHERE free <= 0 OR q[1].b >= 0 LIMIT 1))"""


@query(
    f"""WITH RECURSIVE {O.PLACED}, {O.centroids(DEPTH)}, {_searched(REGION, 60)}
    SELECT level, ci, cj, round(x, 9) AS x, round(y, 9) AS y FROM bn JOIN ends ON level = e.l AND ci = e.i AND cj = e.j"""
)
def op_f7_small_budget(spark, sf_dir):
    nodes = centroids.centroid_nodes(points(spark, sf_dir), DEPTH)
    found = best_first.best_first(nodes, centroids.screen_benefit(REGION.zoom, DEPTH), REGION, 60)
    return found.select("level", "ci", "cj", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(
    f"""WITH {O.PLACED}, {O.detail(budget.exact_level(COUNTRY), 19)}, cut AS (
      SELECT c.* FROM dt c LEFT JOIN dt p ON p.level = c.level - 1 AND p.ci = c.ci >> 1 AND p.cj = c.cj >> 1 WHERE c.exact <= {num(1 / 0.2)} AND (c.level = 0 OR p.exact > {num(1 / 0.2)}))
    SELECT level, ci, cj, exact, first AS point_id FROM cut WHERE {O.meets(COUNTRY)} AND {O.hash_unit('first')} < {num(0.2)} * exact"""
)
def op_f9_percentage_sample(spark, sf_dir):
    return budget.percentage_sample(points(spark, sf_dir), COUNTRY, 20).select("level", "ci", "cj", "exact", "point_id")


_CELLS = f"cl AS (SELECT * FROM (SELECT point_id, CAST(floor(mx * 4096) AS BIGINT) AS ci, CAST(floor(my * 4096) AS BIGINT) AS cj, 12 AS level FROM m) WHERE {O.meets(COUNTRY)})"


@query(
    f"""WITH {O.PLACED}, {_CELLS}, n AS (SELECT ci, cj, count(*) AS n FROM cl GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS strata FROM n),
    b AS (SELECT *, round(strata + (total - strata) * 0.5) AS budget FROM t),
    o AS (SELECT cl.ci, cl.cj, point_id, row_number() OVER (PARTITION BY cl.ci, cl.cj ORDER BY point_id) AS pos FROM cl)
    SELECT o.ci, o.cj, point_id FROM o JOIN n ON n.ci = o.ci AND n.cj = o.cj, b WHERE total = strata OR pos <= floor((budget - strata) / (total - strata) * (n - 1) + 0.5) + 1"""
)
def op_f11_stratified_sample(spark, sf_dir):
    own = budget.pixel_cells(points(spark, sf_dir), COUNTRY)
    total, strata = own.count(), own.select("ci", "cj").distinct().count()
    return budget.stratified_sample(own, int(strata + (total - strata) * 0.5 + 0.5)).select("ci", "cj", "point_id")


@query(f"WITH {O.PLACED}, {_CELLS} SELECT point_id FROM cl WHERE {O.hash_unit('point_id')} < CAST(500 AS DOUBLE) / (SELECT count(*) FROM cl)")
def op_f12_random_sample(spark, sf_dir):
    return budget.random_sample(budget.pixel_cells(points(spark, sf_dir), COUNTRY), 500).select("point_id")


@query(
    f"""WITH {O.PLACED}, {O.detail(budget.exact_level(COUNTRY), 19)}, cut AS (
      SELECT c.* FROM dt c LEFT JOIN dt p ON p.level = c.level - 1 AND p.ci = c.ci >> 1 AND p.cj = c.cj >> 1 WHERE c.exact <= {num(1 / 0.2)} AND (c.level = 0 OR p.exact > {num(1 / 0.2)}))
    SELECT first AS point_id, round(mx, 9) AS x, round(my, 9) AS y FROM cut JOIN m ON m.point_id = cut.first WHERE {O.meets(COUNTRY)}"""
)
def op_f13_traversal_sample(spark, sf_dir):
    return budget.traversal_sample(points(spark, sf_dir), COUNTRY, 20).select("point_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"WITH {O.PLACED}, {_CELLS} SELECT point_id FROM cl WHERE {O.hash_unit('point_id')} < CAST(300 AS DOUBLE) / (SELECT count(*) FROM cl)")
def op_f18_sampling_switch(spark, sf_dir):
    engine = Engine(PointSource(points(spark, sf_dir)))
    q = EngineQuery(algorithm="sampling", aggregator="random", zoom=COUNTRY.zoom, bbox=(COUNTRY.west, COUNTRY.south, COUNTRY.east, COUNTRY.north), resX=COUNTRY.res_x, resY=COUNTRY.res_y, sampleSize=300)
    return budget.sampled(engine.points("%"), q.viewport, budget=q.sampleSize, method=q.aggregator).select("point_id")


def _shown(v) -> str:
    x0, y0, x1, y1 = v.mercator
    w = f"pow({num(0.5)}, level)"
    one = lambda c, lo, hi: f"greatest({num(0)}, least(({c} + 1) * {w}, {num(hi)}) - greatest({c} * {w}, {num(lo)}))"
    return f"({one('ci', x0, x1)} * {one('cj', y0, y1)} / ({w} * {w}))"


@query(f"WITH {O.PLACED}, {O.detail(12, 19)} SELECT level, ci, cj, exact, CAST(floor(exact * {_shown(REGION)} + 0.5) AS BIGINT) AS wanted FROM dt")
def op_f15_perfect_size(spark, sf_dir):
    return budget.perfect_size(budget.detail(points(spark, sf_dir), 12), REGION).select("level", "ci", "cj", "exact", "wanted")


@query("WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, greatest(CAST(floor(CAST(n AS DOUBLE) / (SELECT sum(n) FROM n) * 1000 + 0.5) AS BIGINT), 1) AS size FROM n")
def op_f16_proportional_size(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("event_type", budget.proportional_size(F.col("n"), F.col("total"), 1000).alias("size"))


@query("WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, CAST(sum(event_id) AS BIGINT) AS total FROM o WHERE pos <= 3 AND n >= 3 GROUP BY 1")
def op_f17_last_samples(spark, sf_dir):
    lists = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("s"))
    last = lists.select("user_id", budget.last_samples(F.col("s"), F.lit(3)).alias("k")).where("k is not null")
    return last.select("user_id", F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- images ------------------------------------------------------------------------------------


def _even(spark, sf_dir):
    p = points(spark, sf_dir)
    return p, p.where("point_id % 2 = 0")


@query(f"WITH {O.PLACED}, {O.pixels(ODD)}, a AS (SELECT DISTINCT i, j FROM px), b AS (SELECT DISTINCT i, j FROM px WHERE point_id % 2 = 0) SELECT (SELECT count(*) FROM a) AS pixels_full, (SELECT count(*) FROM b) AS pixels_reduced, (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS error")
def op_g8_visual_error(spark, sf_dir):
    return reducers.visual_error(*_even(spark, sf_dir), ODD)


@query(f"WITH {O.PLACED}, {O.pixels(ODD)}, a AS (SELECT DISTINCT i, j FROM px WHERE keyword = 'click'), b AS (SELECT DISTINCT i, j FROM px WHERE keyword = 'view') SELECT count(*) AS error FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j WHERE a.i IS NULL OR b.i IS NULL")
def op_g7_snap_difference(spark, sf_dir):
    p = points(spark, sf_dir)
    return reducers.visual_error(p.where("keyword = 'click'"), p.where("keyword = 'view'"), ODD).select("error")


def _discs(df: DataFrame) -> DataFrame:
    x0, y0, x1, y1 = ODD.mercator
    p = J.with_mercator(df)
    p = p.where(P.in_viewport(p["mx"], p["my"], ODD))
    x, y = (p["mx"] - dbl(x0)) * ODD.res_x / dbl(x1 - x0), (p["my"] - dbl(y0)) * ODD.res_y / dbl(y1 - y0)
    return p.select(F.explode(render.disc_pixels(x, y)).alias("p")).select("p.*")


_X0, _Y0, _X1, _Y1 = ODD.mercator
_DISCS = f"""s AS (SELECT point_id, (mx - {num(_X0)}) * {ODD.res_x} / {num(_X1 - _X0)} AS x, (my - {num(_Y0)}) * {ODD.res_y} / {num(_Y1 - _Y0)} AS y FROM m WHERE {O.inside(ODD)}),
  sq AS (SELECT s.*, CAST(floor(x - 1) AS BIGINT) + a AS i, CAST(floor(y - 1) AS BIGINT) + b AS j FROM s, (SELECT unnest(generate_series(0, 3)) AS a), (SELECT unnest(generate_series(0, 3)) AS b)),
  t AS (SELECT *, least(1, greatest(0, 1 - sqrt((i + 0.5 - x) * (i + 0.5 - x) + (j + 0.5 - y) * (j + 0.5 - y)) + 0.5)) AS t FROM sq WHERE i <= floor(x + 1) AND j <= floor(y + 1)),
  d AS (SELECT point_id, i, j, t * t * (3 - 2 * t) AS alpha FROM t)"""


def _image(name: str, where: str) -> str:
    return f"{name} AS (SELECT i, j, 28.05 + ({num(221.0)} - 28.05) * exp(sum(ln(greatest(1 - alpha, {num(1e-12)})))) AS gray FROM d WHERE {where} GROUP BY 1, 2)"


@query(f"WITH {O.PLACED}, {_DISCS} SELECT i, j, count(*) AS discs, round(sum(alpha), 4) + 0 AS alpha FROM d GROUP BY 1, 2")
def op_g3_disc_pixels(spark, sf_dir):
    return _discs(points(spark, sf_dir)).groupBy("i", "j").agg(F.count("*").alias("discs"), (F.round(F.sum("alpha"), 4) + dbl(0)).alias("alpha"))


@query(f"WITH {O.PLACED}, {_DISCS}, {_image('a', 'true')}, {_image('b', 'point_id % 2 = 0')} SELECT round(sum(abs(a.gray - coalesce(b.gray, 221))), 1) AS l1, round(sum((a.gray - coalesce(b.gray, 221)) * (a.gray - coalesce(b.gray, 221))), 0) AS l2 FROM a LEFT JOIN b USING (i, j)")
def op_g6_gray_error(spark, sf_dir):
    full, half = (render.opaque_image(_discs(p)) for p in _even(spark, sf_dir))
    l1, l2 = render.gray_error(full, half, 1), render.gray_error(full, half, 2)
    return l1.select(F.round("error", 1).alias("l1")).join(F.broadcast(l2.select(F.round("error", 0).alias("l2"))))


_THERE, _BACK = tilted.ground_matrices(_SHOWN)


def _row(m, r: int, x: str, y: str) -> str:
    return f"({num(m[r, 0])} * {x} + {num(m[r, 1])} * {y} + {num(m[r, 2])})"


def _footprints(radius: float, zoom: int, width: int, height: int) -> str:
    reach = num((radius + 0.5) / 2.0**zoom)
    corners = [(f"(x {a} {reach})", f"(y {b} {reach})") for a in "-+" for b in "-+"]
    side = [[f"{_row(_THERE, r, x, y)} / {_row(_THERE, 2, x, y)}" for x, y in corners] for r in (0, 1)]
    ends = ", ".join(f"{f}({', '.join(side[r])}) AS {n}" for r, f, n in ((0, "least", "x0"), (0, "greatest", "x1"), (1, "least", "y0"), (1, "greatest", "y1")))
    clip = lambda c, most: f"CAST(least(greatest(floor({c}), 0), {most}) AS BIGINT)"
    gx, gy = (f"{_row(_BACK, r, '(i + 0.5)', '(j + 0.5)')} / {_row(_BACK, 2, '(i + 0.5)', '(j + 0.5)')}" for r in (0, 1))
    return f"""w AS (SELECT point_id, {_WX} AS x, {_WY} AS y FROM pts),
    bx AS (SELECT *, {ends} FROM w WHERE least({', '.join(_row(_THERE, 2, x, y) for x, y in corners)}) > 0),
    ri AS (SELECT point_id, x, y, y0, y1, unnest(generate_series({clip('x0', width - 1)}, {clip('x1', width - 1)})) AS i FROM bx WHERE x1 >= 0 AND x0 < {width} AND y1 >= 0 AND y0 < {height}),
    rj AS (SELECT point_id, x, y, i, unnest(generate_series({clip('y0', height - 1)}, {clip('y1', height - 1)})) AS j FROM ri),
    fa AS (SELECT point_id, i, j, sqrt(({gx} - x) * ({gx} - x) + ({gy} - y) * ({gy} - y)) * {num(2.0**zoom)} AS d FROM rj),
    ft AS (SELECT *, least(1, greatest(0, {num(radius)} - d + 0.5)) AS t FROM fa)"""


@query(f"WITH {O.POINTS}, {_footprints(2.0, 5, 1920, 978)} SELECT i, j, count(*) AS discs, round(sum(t * t * (3 - 2 * t)), 3) + 0 AS alpha FROM ft WHERE t * t * (3 - 2 * t) > {num(tilted.LEAST_ALPHA)} GROUP BY 1, 2")
def op_g5_tilted_discs(spark, sf_dir):
    drawn = tilted.disc_footprints(points(spark, sf_dir), _SHOWN, 5, 1920, 978, 2.0)
    return drawn.groupBy("i", "j").agg(F.count("*").alias("discs"), (F.round(F.sum("alpha"), 3) + dbl(0)).alias("alpha"))


# --- progressive answers -----------------------------------------------------------------------

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


@query("SELECT CAST(k AS BIGINT) AS slice, TIMESTAMP '2024-01-01' + to_days(CAST(k * 7 AS INT)) AS slice_start, TIMESTAMP '2024-01-01' + to_days(CAST(k * 7 + 7 AS INT)) AS slice_end, CAST(least(100, (k + 1) * 700 // 30) AS BIGINT) AS progress, (SELECT count(*) FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-31' AND floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) = k) AS points FROM (SELECT unnest(generate_series(0, 4)) AS k)")
def op_i1_slices(spark, sf_dir):
    arrived = progressive.deltas(points(spark, sf_dir), START, END, 7).groupBy("slice").agg(F.count("*").alias("points"))
    return progressive.slices(spark, START, END, 7).join(arrived, "slice", "left").withColumn("points", F.coalesce("points", F.lit(0)))


@query(f"WITH {O.PLACED}, {O.pixels(REGION)}, f AS (SELECT i, j, min(CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS BIGINT)) AS s FROM px GROUP BY 1, 2) SELECT CAST(k AS BIGINT) AS slice, count(*) AS pixels FROM f, (SELECT unnest(generate_series(0, 4)) AS k) WHERE s <= k GROUP BY 1")
def op_i3_progressive_pixels(spark, sf_dir):
    seen = progressive.first_seen(reducers.snapped(points(spark, sf_dir), REGION), ["i", "j"], START, 7)
    slices = progressive.slices(spark, START, END, 7).select("slice")
    per = seen.groupBy("slice").agg(F.count("*").alias("new"))
    both = slices.select(F.col("slice").alias("k")).join(F.broadcast(per), F.col("slice") <= F.col("k"))
    return both.groupBy(F.col("k").alias("slice")).agg(F.sum("new").alias("pixels"))


@query(f"WITH {O.POINTS} SELECT point_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS BIGINT) AS slice FROM pts WHERE ts >= '2024-01-01' AND ts < '2024-01-31'")
def op_i4_deltas(spark, sf_dir):
    return progressive.deltas(points(spark, sf_dir), START, END, 7).select("point_id", "slice")


_IN_TIME = f"ts >= '{START}' AND ts < '{END}'"


def _log(spark) -> tree_log.TreeLog:
    return tree_log.TreeLog(spark, new_folder(spark, "tree-log"))


def _slices(spark, sf_dir):
    each = progressive.deltas(points(spark, sf_dir), START, END, 7)
    return ((k, each.where(F.col("slice") == k)) for k in range(5))


@query(f"WITH {O.placed(_IN_TIME)}, {O.tree(DEPTH)} SELECT level, ci, cj, cnt, first, is_leaf FROM nd")
def op_i5_incremental_tree(spark, sf_dir):
    store = TreeStore(new_folder(spark, "trees"), "events")
    tree_log.grow(_log(spark), _slices(spark, sf_dir), on_finish=lambda log: log.save(store, "counts"))
    return store.read(spark, "counts").select("level", "ci", "cj", "cnt", F.col("first.point_id").alias("first"), "is_leaf")


@query(
    " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS slice, level, count(*) AS nodes, CAST(sum(cnt) AS BIGINT) AS points FROM (WITH {O.placed(f'{_IN_TIME} AND epoch(ts) < epoch(TIMESTAMP {START!r}) + {(k + 1) * 604800}')}, {O.frontier(COUNTRY, 12, 27)} SELECT level, cnt FROM fr) GROUP BY 2"
        for k in range(5)
    )
)
def op_i3_incremental_answers(spark, sf_dir):
    log = tree_log.grow(_log(spark), _slices(spark, sf_dir))
    out = None
    for k in range(5):
        ends = reducers.frontier(log.nodes(COUNTRY, 12, upto=k), COUNTRY, 12)
        counts = ends.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("cnt").alias("points")).select(F.lit(k).cast("long").alias("slice"), "level", "nodes", "points")
        out = counts if out is None else out.union(counts)
    return out


@query(f"WITH {O.PLACED}, {O.tree(DEPTH)} SELECT level, ci, cj, cnt, first, is_leaf FROM nd WHERE level <= 14")
def op_i6_streamed_tree(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    arriving = event_points_of(spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events*.parquet"))
    log = tree_log.grow_from_stream(_log(spark), arriving, new_folder(spark, "checkpoint"))
    return log.nodes(bottom=14).select("level", "ci", "cj", "cnt", F.col("first.point_id").alias("first"), "is_leaf")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_e5_grid_points(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
