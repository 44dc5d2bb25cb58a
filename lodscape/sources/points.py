"""Where points come from: tables with a place, a time and a text, JDBC sources, files of pairs, and the fixture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import in_slice, keyword_is, text_matches
from ..functions.stemming import ENGLISH


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(point_id, ts, keyword, lng, lat)`` derived from ``events`` by arithmetic that any engine repeats."""
    return event_points_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_points_of(e: DataFrame) -> DataFrame:
    """The points of rows of ``events``, which may be a stream."""
    lng = (F.col("user_id") * 37 % 59 - 125).cast("double") + (F.col("event_id") * 31 % 1000).cast("double") / F.lit(250.0)
    lat = (F.col("user_id") * 53 % 24 + 25).cast("double") + (F.col("event_id") * 17 % 1000).cast("double") / F.lit(250.0)
    return e.select(F.col("event_id").alias("point_id"), "ts", F.col("event_type").alias("keyword"), lng.alias("lng"), lat.alias("lat"))


@dataclass(frozen=True)
class PointSource:
    """A table of points and the names of its columns; scans give ``(point_id, ts, lng, lat, ...)``.

    ``keyword``: a column with one keyword; ``text``: a column for word queries, which compare English stems
    unless ``stemmed`` is false. ``%`` asks for everything.
    """

    table: DataFrame
    point_id: str = "point_id"
    ts: str = "ts"
    lng: str = "lng"
    lat: str = "lat"
    keyword: str | None = "keyword"
    text: str | None = None
    stemmed: bool = True

    @staticmethod
    def jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str, bounds: tuple[int, int], partitions: int, properties: dict | None = None, **names: str) -> PointSource:
        """A database table, read in so many ranges of a column; Spark pushes columns and time predicates down to it."""
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties or {})
        return PointSource(df, **names)

    def _matching(self, keyword: str):
        if keyword == "%":
            return F.lit(True)
        return text_matches(F.col(self.text), keyword, ENGLISH if self.stemmed else None) if self.text else keyword_is(F.col(self.keyword), keyword)

    def scan(self, keyword: str = "%", start: str | None = None, end: str | None = None, *, closed: bool = False) -> DataFrame:
        """Points of a keyword and a time slice; rows without a place are dropped."""
        df = self.table.where(self._matching(keyword))
        if start is not None:
            df = df.where(in_slice(F.col(self.ts), start, end, closed=closed))
        df = df.where(F.col(self.lng).isNotNull() & F.col(self.lat).isNotNull())
        return df.select(F.col(self.point_id).alias("point_id"), F.col(self.ts).alias("ts"), F.col(self.lng).alias("lng"), F.col(self.lat).alias("lat"))


def pairs_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(point_id, lng, lat)`` from texts that are JSON lists of ``[lat, lng]`` pairs; ids follow the order in each text."""
    pairs = F.from_json(F.col(column), "array<array<double>>")
    each = lines.select(F.posexplode(pairs).alias("point_id", "p"))
    return each.select(F.col("point_id").cast("long"), F.col("p")[1].alias("lng"), F.col("p")[0].alias("lat")).where("lng is not null and lat is not null")
