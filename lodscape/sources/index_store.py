"""Trees kept as Parquet by band of levels and Z-order prefix, so that a query reads the levels and the places it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.predicates import rectangles
from ..functions.viewport import Viewport
from ..operators.pyramid import morton
from ..operators.zorder import cover, in_intervals

#: The level whose cells are folders, and how many levels share one: a tree has at most 4 x 64 folders.
PREFIX, BAND = 3, 7
#: The columns of the folders, and the order of rows in them.
FOLDERS, ORDER = ["band", "zp"], ["band", "zp", "level", "ci", "cj"]


def write_index(nodes: DataFrame, folder: str, dataset: str, key: str) -> str:
    return TreeStore(folder, dataset).write(nodes, key)


def read_index(spark: SparkSession, folder: str, dataset: str, key: str) -> DataFrame | None:
    """The nodes written under a name, None if there are none."""
    return TreeStore(folder, dataset).read(spark, key)


def with_folders(nodes: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Nodes ``(level, ci, cj, ...)`` with their folders: the band of their level, and along the Z-order curve their ancestor at the
    level ``prefix``, -1 above it. Sorted by folder and level, so that a task writes few files and these prune by level."""
    up = lambda c: F.expr(f"shiftright({c}, greatest(level - {prefix}, 0))")
    zp = F.when(F.col("level") < prefix, F.lit(-1)).otherwise(morton(up("ci"), up("cj"), prefix)).cast("int")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = nodes.withColumns({"band": F.floor(F.col("level") / BAND).cast("int"), "zp": zp})
    return wide.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)


def within(table: DataFrame, v: Viewport | None, bottom: int | None, prefix: int = PREFIX, *, families: bool = False) -> DataFrame:
    """Rows of a table with folders down to a level, in the folders that a viewport touches; its scan reads no others.
    ``families``: and in those of their siblings."""
    rows = table if bottom is None else table.where((table["band"] <= bottom // BAND) & (table["level"] <= bottom))
    if v is None:
        return rows
    # a tree's cells are not wrapped at the antimeridian, so neither is what is read of it
    spans = cover([*rectangles(v), v.mercator], prefix - families, None)
    spans = [(4 * a, 4 * b + 3) for a, b in spans] if families else spans
    return rows.where((rows["zp"] == -1) | in_intervals(rows["zp"], spans))


@dataclass(frozen=True)
class TreeStore:
    """Trees of a dataset in a folder that driver and executors share, each under a key."""

    folder: str
    dataset: str
    prefix: int = PREFIX

    def path(self, key: str) -> str:
        return f"{self.folder.rstrip('/')}/{self.dataset}/{key}"

    def write(self, nodes: DataFrame, key: str) -> str:
        """Tasks are ranges of folders and places, so each writes few folders, and a crowded one is written by several."""
        with_folders(nodes, self.prefix).write.mode("overwrite").partitionBy(*FOLDERS).parquet(self.path(key))
        return self.path(key)

    def table(self, spark: SparkSession, key: str) -> DataFrame | None:
        """A tree's whole table with its folders' columns, None if it was not written."""
        try:
            return spark.read.parquet(self.path(key))
        except AnalysisException:
            return None

    def part(self, table: DataFrame, v: Viewport | None = None, bottom: int | None = None) -> DataFrame:
        """Of a tree's table the nodes in the folders that a viewport touches, down to a level."""
        columns = [c for c in table.columns if c not in FOLDERS]
        return within(table, v, bottom, self.prefix).select(*columns)

    def read(self, spark: SparkSession, key: str, v: Viewport | None = None, bottom: int | None = None) -> DataFrame | None:
        table = self.table(spark, key)
        return None if table is None else self.part(table, v, bottom)
