"""A quadtree that grows batch by batch, kept as what each batch adds to its cells.

A batch writes a row for each cell it touches and for no other: points and first point of the batch in it. A cell's
state is the sum and the least of its rows, so nothing written before is read or rewritten, and the order of batches
doesn't matter. A manifest for each version names the folders that make it up; a batch counts once its manifest is
there, and one that is already counted changes nothing. When there are many folders they are folded into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.viewport import Viewport
from ..operators.pyramid import DEEP, deep_cells, levels, real_nodes
from ..sources.index_store import FOLDERS, PREFIX, TreeStore, with_folders, within

_CELLS = "band int, zp int, level int, ci long, cj long, cnt long, first struct<point_id:long,mx:double,my:double>"


@dataclass(frozen=True)
class TreeLog:
    """The tree in ``folder``, which driver and executors share. ``fold``: so many folders are read for an answer at most."""

    spark: SparkSession
    folder: str
    depth: int = DEEP
    fold: int = 8
    prefix: int = PREFIX

    def _manifest(self, upto: int | None = None) -> tuple[int, list[str]]:
        """(last batch counted, folders that make up the tree then); (-1, none) at the beginning."""
        try:
            m = self.spark.read.parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return -1, []
        last = m.where(m["batch"] <= upto) if upto is not None else m
        row = last.agg(F.max(F.struct(F.col("batch").cast("long").alias("batch"), "parts")).alias("m")).first()["m"]
        return (-1, []) if row is None else (row["batch"], list(row["parts"]))

    def _commit(self, batch: int, parts: list[str]) -> None:
        one = self.spark.createDataFrame([(parts,)], "parts array<string>").coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")

    def _write(self, cells: DataFrame, part: str) -> None:
        with_folders(cells, self.prefix).write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{self.folder}/cells/{part}")

    @property
    def version(self) -> int:
        return self._manifest()[0]

    def apply(self, points: DataFrame, batch: int) -> bool:
        """Adds a batch of points; False if it was added before. Batches are numbered upwards, with gaps or without.

        A batch that failed on its way is simply written again: its folder has its number. One without points counts too.
        """
        last, parts = self._manifest()
        if batch <= last:
            return False
        self._write(levels(deep_cells(points, self.depth), self.depth), f"add-{batch}")
        parts = [*parts, f"add-{batch}"]
        if len(parts) > self.fold:
            self._write(self._merged(parts), f"all-{batch}")
            parts = [f"all-{batch}"]
        self._commit(batch, parts)
        return True

    def _merged(self, parts: list[str], v: Viewport | None = None, bottom: int | None = None) -> DataFrame:
        read = lambda p: self.spark.read.schema(_CELLS).parquet(f"{self.folder}/cells/{p}")
        each = [within(read(p), v, bottom, self.prefix, families=True).select("level", "ci", "cj", "cnt", "first") for p in parts]
        rows = self.spark.createDataFrame([], _CELLS).select("level", "ci", "cj", "cnt", "first") if not each else each[0]
        for more in each[1:]:
            rows = rows.union(more)
        return rows.groupBy("level", "ci", "cj").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))

    def cells(self, v: Viewport | None = None, bottom: int | None = None, upto: int | None = None) -> DataFrame:
        """``(level, ci, cj, cnt, first)`` of all non-empty cells: now or as after batch ``upto``; with a viewport and a lowest
        level only what lies in the folders these need."""
        return self._merged(self._manifest(upto)[1], v, bottom)

    def nodes(self, v: Viewport | None = None, bottom: int | None = None, upto: int | None = None) -> DataFrame:
        """The tree's nodes, as :func:`pyramid.quadtree` builds them from all points so far.

        What is read for a viewport are whole families, as a cell's siblings decide whether it is a node.
        """
        return real_nodes(self.cells(v, bottom, upto), self.depth)

    def save(self, store: TreeStore, key: str) -> str:
        """What a load does when it is finished: the tree as it is now, kept under a key."""
        return store.write(self.nodes(), key)


def grow(log: TreeLog, slices: Iterator[tuple[int, DataFrame]], on_answer: Callable[[int, TreeLog], None] | None = None, on_finish: Callable[[TreeLog], None] | None = None) -> TreeLog:
    """Adds slices in turn, calls ``on_answer`` after each (its tree has all data so far) and ``on_finish`` after the last."""
    for batch, points in slices:
        log.apply(points, batch)
        if on_answer:
            on_answer(batch, log)
    if on_finish:
        on_finish(log)
    return log


def grow_from_stream(log: TreeLog, points: DataFrame, checkpoint: str, on_answer: Callable[[int, TreeLog], None] | None = None, on_finish: Callable[[TreeLog], None] | None = None) -> TreeLog:
    """Adds each micro-batch of a stream of points until it is used up. Restarted on the same checkpoint it goes on where it
    was: a batch delivered again is not added again."""

    def add(batch: DataFrame, number: int) -> None:
        log.apply(batch, number)
        if on_answer:
            on_answer(number, log)

    run = points.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(add).start()
    run.awaitTermination()
    if on_finish:
        on_finish(log)
    return log
