"""Requests in, answers out: which reducer answers a query, and indexes kept between queries."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.projection import x_lng, y_lat
from ..functions.viewport import Viewport
from ..operators import agreement, best_first, budget, centroids, folds, pyramid, reducers, samples
from ..operators.pyramid import DEEP, SHALLOW
from ..sources import messages
from ..sources.index_store import TreeStore
from ..sources.points import PointSource


@dataclass(frozen=True)
class Query:
    key: str = ""
    zoom: int = 0
    bbox: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)
    algorithm: str = "QuadTreeAggregator"
    resX: int = 1920
    resY: int = 978
    aggregator: str = "snap"
    sampleSize: int = 0
    samplePercentage: int = 0

    @staticmethod
    def of(raw: dict) -> Query:
        """From a request's fields; unknown ones are passed over."""
        known = {f.name for f in fields(Query)}
        own = {k: v for k, v in raw.items() if k in known and v is not None}
        return Query(**own | ({"bbox": tuple(own["bbox"])} if "bbox" in own else {}))

    @property
    def viewport(self) -> Viewport:
        return Viewport(*self.bbox, self.zoom, self.resX, self.resY)


class Reducer(Protocol):
    """Answers a query on points with ``(x, y)`` rows (more columns may be there)."""

    def __call__(self, points: DataFrame, query: Query) -> DataFrame: ...


def _degrees(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.select(x_lng(F.col(x)).alias("lng"), y_lat(F.col(y)).alias("lat"))


def explore(points: DataFrame, q: Query) -> DataFrame:
    return reducers.raw_points(points, q.viewport).select("lng", "lat")


def aggregate(points: DataFrame, q: Query) -> DataFrame:
    if q.aggregator.lower() in ("deck-gl", "disc"):
        return _degrees(folds.drawn_points(points, q.viewport))
    return reducers.pixel_points(points, q.viewport).select("lng", "lat")


@dataclass(frozen=True)
class Tree:
    """A reducer that answers from a tree, so that the tree can be kept: built once for all viewports, read for one down to a level.

    Trees of the same ``kind`` are the same table.
    """

    kind: str
    build: Callable[[DataFrame], DataFrame]
    answer: Callable[[DataFrame, Query], DataFrame]
    bottom: Callable[[Query], int] = lambda q: DEEP

    def __call__(self, points: DataFrame, query: Query) -> DataFrame:
        return self.answer(self.build(points), query)


grid = Tree("counts", pyramid.quadtree, lambda nodes, q: _degrees(reducers.grid_of(nodes, q.viewport)), lambda q: reducers.grid_level(q.viewport))


def rendered(points: DataFrame, q: Query) -> DataFrame:
    return _degrees(folds.rendered_cells(points, q.viewport))


def _by_arrival(nodes: DataFrame, q: Query) -> DataFrame:
    return _degrees(reducers.arrivals_of(nodes, q.viewport))


def _search(benefit: Callable[[Query], Column]) -> Callable[[DataFrame, Query], DataFrame]:
    return lambda nodes, q: _degrees(best_first.best_first(nodes, benefit(q), q.viewport, q.sampleSize))


by_error = Tree("errors", samples.error_nodes, _search(lambda q: centroids.error_benefit(q.zoom)))
first_of_cells = Tree("counts", pyramid.quadtree, _by_arrival, lambda q: min(8 + q.zoom, SHALLOW))
by_distance = Tree("centroids", centroids.centroid_nodes, _search(lambda q: centroids.distance_benefit(DEEP)))
by_screen_distance = Tree("centroids", centroids.centroid_nodes, _search(lambda q: centroids.screen_benefit(q.zoom, DEEP)), lambda q: min(q.zoom + 8, DEEP))


def by_arrival(points: DataFrame, q: Query) -> DataFrame:
    if 1 <= q.samplePercentage <= 99:
        return _degrees(budget.percentage_sample(points, q.viewport, q.samplePercentage))
    return first_of_cells(points, q)


def sampled(points: DataFrame, q: Query) -> DataFrame:
    return _degrees(budget.sampled(points, q.viewport, budget=q.sampleSize, percent=q.samplePercentage, method=q.aggregator))


# The names a request may give, with their short forms.
ALGORITHMS: dict[str, Reducer] = {}
for _names, _reducer in (
    (("dataexplorer", "de"), explore),
    (("dataaggregator", "da"), aggregate),
    (("quadtreeaggregator", "quadtree", "qt"), grid),
    (("gquadtree", "gqt"), rendered),
    (("raquadtree", "raqt"), by_error),
    (("raquadtreesnap", "raqts"), by_arrival),
    (("raquadtreedistance", "raqtd"), by_distance),
    (("raquadtreedistancev2", "raqtdv2"), by_screen_distance),
    (("sampling", "raqtv0"), sampled),
):
    for _name in _names:
        ALGORITHMS[_name] = _reducer


def reducer(name: str) -> Reducer:
    try:
        return ALGORITHMS[name.lower()]
    except KeyError:
        raise ValueError(f"no algorithm named {name}") from None


def tree_of(q: Query) -> Tree | None:
    """The tree that a query is answered from, None if it is answered from points."""
    found = reducer(q.algorithm)
    if found is by_arrival and not 1 <= q.samplePercentage <= 99:
        return first_of_cells
    return found if isinstance(found, Tree) else None


@dataclass
class Engine:
    """Answers requests on a source: from what is cached, else from a stored tree, else from one that is built now.

    The points and trees of up to ``most_cached`` keywords stay cached, the least asked go first. With a ``store`` built trees are
    written there and what is cached of one is its list of files: a request reads the levels and folders that its viewport
    needs. Without a store, trees are persisted.
    """

    source: PointSource
    start: str | None = None
    end: str | None = None
    most_cached: int = 30
    store: TreeStore | None = None
    _cache: dict[str, DataFrame] = field(default_factory=dict)
    _hits: dict[str, int] = field(default_factory=dict)
    #: How the last query came by its data: "cached", "stored" or "built".
    last_step: str = ""

    def _cached(self, key: str) -> DataFrame | None:
        if key in self._cache:
            self._hits[key] += 1
            self.last_step = "cached"
        return self._cache.get(key)

    def _remember(self, key: str, df: DataFrame, step: str, *, persist: bool = True) -> DataFrame:
        while len(self._cache) >= self.most_cached:
            least = min(self._cache, key=lambda k: self._hits[k])
            self._cache.pop(least).unpersist()
            self._hits.pop(least)
        self._cache[key], self._hits[key], self.last_step = df.persist() if persist else df, 1, step
        return df

    def _scan(self, keyword: str) -> DataFrame:
        return self.source.scan(keyword, self.start, self.end)

    def points(self, keyword: str) -> DataFrame:
        found = self._cached(keyword)
        return self._remember(keyword, self._scan(keyword), "built") if found is None else found

    def nodes(self, tree: Tree, keyword: str, q: Query) -> DataFrame:
        """What a query needs of a keyword's tree."""
        key, bottom = f"{tree.kind}-{quote(keyword, safe='')}", tree.bottom(q)
        found = self._cached(key)
        if self.store is None:
            found = self._remember(key, tree.build(self._scan(keyword)), "built") if found is None else found
            return found.where(F.col("level") <= bottom)
        if found is None:
            found, step = self.store.table(self.source.table.sparkSession, key), "stored"
            if found is None:
                self.store.write(tree.build(self._scan(keyword)), key)
                found, step = self.store.table(self.source.table.sparkSession, key), "built"
                if found is None:  # a tree without nodes has no files
                    self.last_step = step
                    return tree.build(self._scan(keyword))
            self._remember(key, found, step, persist=False)
        return self.store.part(found, q.viewport, bottom)

    def query(self, q: Query, keyword: str = "%") -> DataFrame:
        tree = tree_of(q)
        return tree.answer(self.nodes(tree, keyword, q), q) if tree else reducer(q.algorithm)(self.points(keyword), q)

    def message(self, q: Query, keyword: str = "%", *, bitmap: bool = False) -> bytes:
        """The answer as a client's binary message, with how long its tree took and then the answer itself, run and packed."""
        began = time.monotonic()
        answer = self.query(q, keyword)
        ready = time.monotonic()
        if bitmap:
            body = messages.bitmap_body(reducers.pixel_bitmap(answer.withColumn("point_id", F.lit(0)), q.viewport), q.viewport)
        else:
            body = messages.point_body(answer)
        done = time.monotonic()
        return messages.Header(100, done - began, ready - began, done - ready).bytes(int(bitmap)) + body

    def observed(self, q: Query, keyword: str = "%") -> dict:
        """A query run to its end without keeping its answer: rows, seconds for its tree and for itself, how it came by its data,
        and MB of memory that the driver's Spark then used."""
        began = time.monotonic()
        answer, seen = self.query(q, keyword), Observation()
        ready = time.monotonic()
        answer.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        done = time.monotonic()
        runtime = self.source.table.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime()
        used = (runtime.totalMemory() - runtime.freeMemory()) / 1e6
        return {"rows": seen.get["rows"], "tree_seconds": ready - began, "run_seconds": done - ready, "step": self.last_step, "used_mb": used}

    def handle(self, request: dict) -> dict:
        """A request by its type: query, transfer, cmd or analysis; anything else has status "unknown"."""
        kinds: dict[str, Callable[[dict], dict]] = {"query": self._query, "transfer": self._transfer, "progress-transfer": self._transfer, "cmd": self._commands, "analysis": self._analysis}
        handler = kinds.get(request.get("type", ""))
        return handler(request) if handler else {"type": request.get("type"), "status": "unknown"}

    def _query(self, request: dict) -> dict:
        return {"type": "query", "status": "done", "result": self.query(Query.of(request.get("query") or {}), request.get("keyword") or "%")}

    def _transfer(self, request: dict) -> dict:
        return {"type": request["type"], "status": "done", "result": messages.geojson_features(self.points(request.get("keyword") or "%"))}

    def _commands(self, request: dict) -> dict:
        return {"type": "cmd", "status": "error", "message": "load and cluster are deprecated; send a query"}

    def _analysis(self, request: dict) -> dict:
        asked = request.get("analysis") or {}
        given, value = asked.get("arguments") or [], 0.0
        if asked.get("objective") == "distance" and len(given) == 4:
            x0, y0, x1, y1 = (float(v) for v in given)
            value = math.hypot(x0 - x1, y0 - y1)
        elif asked.get("objective") == "rand-index" and len(given) == 2:  # two columns of the source
            value = agreement.rand_index(self.source.table, *given).first()["rand"]
        return {"type": "analysis", "status": "done", "value": value}
