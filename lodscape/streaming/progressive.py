"""Answers that grow with the data: time slices in turn, or a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import in_slice
from ..functions.projection import cell
from ..operators.pyramid import placed


def slices(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """``(slice, slice_start, slice_end, progress)``: slices of so many days until the end is reached, which the last may pass.
    Progress is in whole percent of whole days, 100 at most."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    total = (datetime.fromisoformat(end) - datetime.fromisoformat(start)).days or 1
    n = -(-int((datetime.fromisoformat(end) - datetime.fromisoformat(start)) / timedelta(seconds=1)) // (86400 * days))
    each = spark.range(n).select(
        F.col("id").alias("slice"),
        (a + F.make_dt_interval(F.col("id").cast("int") * days)).alias("slice_start"),
        (a + F.make_dt_interval((F.col("id").cast("int") + 1) * days)).alias("slice_end"),
    )
    progress = F.least(F.lit(100), F.floor((F.col("slice") + 1) * days * 100 / F.lit(total)))
    return each.where(F.col("slice_start") < b).withColumn("progress", progress.cast("long"))


def slice_of(ts, start: str, days: int):
    """The number of the slice that a time falls into."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(86_400_000_000 * days)).cast("long")


def deltas(points: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """``points`` of the period with the ``slice`` each belongs to: what a transfer sends slice by slice."""
    return points.where(in_slice(F.col("ts"), start, end)).withColumn("slice", slice_of(F.col("ts"), start, days))


def progressive(points: DataFrame, reduce: Callable[[DataFrame], DataFrame], start: str, end: str, days: int) -> Iterator[tuple[int, int, DataFrame]]:
    """(slice, progress, answer) for each slice: the same query on all data up to the slice's end."""
    for r in slices(points.sparkSession, start, end, days).orderBy("slice").collect():
        yield r["slice"], r["progress"], reduce(points.where(in_slice(F.col("ts"), start, r["slice_end"].isoformat(sep=" "))))


def first_seen(points: DataFrame, key: list[str], start: str, days: int) -> DataFrame:
    """For each key (a pixel, a cell) the first slice that has it: one pass instead of one query for each
    slice, since the answer up to slice k is the keys first seen up to k."""
    return points.withColumn("slice", slice_of(F.col("ts"), start, days)).groupBy(*key).agg(F.min("slice").alias("slice"))


def streamed_cells(points: DataFrame, level: int) -> DataFrame:
    """A streaming table ``(ci, cj, cnt, first)``: counts and first points of a level's cells.

    State is one row for each cell, so it is bounded by the level and not by the stream; counts,
    sums and least values don't mind late rows, so no watermark is needed. Use update or complete mode.
    """
    p = placed(points)
    return p.groupBy(cell(F.col("mx"), level).alias("ci"), cell(F.col("my"), level).alias("cj")).agg(F.count("*").alias("cnt"), F.min(F.struct("point_id", "mx", "my")).alias("first"))


def stream_answers(points: DataFrame, level: int, on_answer: Callable[[int, DataFrame], None], checkpoint: str):
    """Runs over what has arrived and calls ``on_answer(batch, all cells so far)`` after each micro-batch."""
    return (
        streamed_cells(points, level)
        .writeStream.outputMode("complete")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch: on_answer(batch, df))
        .start()
    )
