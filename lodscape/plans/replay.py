"""Logs of what users looked at, and their replay."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Query

_LOG = "action int, keyword string, lng double, lat double, zoom int"
_MEASURES = "action int, keyword string, zoom int, rows long, tree_seconds double, run_seconds double, step string, used_mb double"


@dataclass(frozen=True)
class Action:
    """A look at a place: the centre of the screen and the zoom."""

    keyword: str
    lng: float
    lat: float
    zoom: int

    def query(self, base: Query) -> Query:
        """The base query at this place: so wide and high, in degrees, as its screen shows at the zoom (a tile of 256 pixels is 360
        degrees of longitude at zoom 0; of latitude half as many are taken)."""
        half_x, half_y = (n / 2 * 360 / 256 / 2**self.zoom for n in (base.resX, base.resY / 2))
        return replace(base, zoom=self.zoom, bbox=(max(-180.0, self.lng - half_x), max(-85.0, self.lat - half_y), min(180.0, self.lng + half_x), min(85.0, self.lat + half_y)))


class Recorder:
    """Keeps the actions of a session and writes them as a log."""

    def __init__(self) -> None:
        self.actions: list[Action] = []

    def record(self, action: Action) -> None:
        self.actions.append(action)

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(k, a.keyword, a.lng, a.lat, a.zoom) for k, a in enumerate(self.actions)]
        spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("overwrite").parquet(path)


def logged(log: DataFrame) -> Iterator[tuple[int, Action]]:
    """The actions of a log ``(action, keyword, lng, lat, zoom)`` in order; it is as long as a session, and read a part at a time."""
    for r in log.orderBy("action").toLocalIterator():
        yield r["action"], Action(r["keyword"], r["lng"], r["lat"], r["zoom"])


def replayed(engine: Engine, log: DataFrame, base: Query = Query()) -> DataFrame:
    """``(action, keyword, zoom, rows, tree_seconds, run_seconds, step, used_mb)``: each action's query run to its end, one
    after the other as they were, and what it took."""
    rows = []
    for k, action in logged(log):
        m = engine.observed(action.query(base), action.keyword)
        rows.append((k, action.keyword, action.zoom, m["rows"], m["tree_seconds"], m["run_seconds"], m["step"], m["used_mb"]))
    return log.sparkSession.createDataFrame(rows, _MEASURES)
