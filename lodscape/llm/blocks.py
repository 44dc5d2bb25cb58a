"""Blocks: many short lists kept in one row, so that what a corpus says of their items comes back once for each block.

A block row has a unique ``block``, a list of its different items and, as packed whole numbers, the place of each
occurrence's item in that list. Counting and looking up then meet each different item once for each block, and a hot
item has one row for each block that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settings, written


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^31, compressed: first all their lowest bytes, then the next, as those have few different values."""
    planes = np.ascontiguousarray(numbers, dtype="<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def packed_places(places: np.ndarray) -> bytes:
    """Growing whole numbers, by what each is more than the one before."""
    return packed(np.diff(places, prepend=0))


def unpacked_places(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.int64)


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """What runs inside reads, passes on and collects few rows at a time, as a block is a row of some MB: batches of ``rows``, and lists
    that are collected for blocks are made one block after the other, by sorting."""
    few = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.parquet.columnarReaderBatchSize": str(rows),
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1",
    }
    with settings(spark, few):
        yield


def written_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks``, written once. Parquet's writer holds 100 rows before it looks at their size, and then up to 128 MB: with rows of
    some MB that grows with the blocks of a task. Here it looks at each few rows and holds some 16 MB."""
    few = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.block.size": 16 << 20}
    return written(blocks, name, compression="zstd", **few)


class _Known:
    """Rows of keys in columns, each with an answer: finds the answers of other rows, -1 where there is none."""

    def __init__(self, columns: list[pa.Array], answers: np.ndarray):
        self._unique, self._answers = [c.unique() for c in columns], answers
        self._codes = self._coded(columns)

    def _coded(self, columns: list[pa.Array]) -> pa.Array:
        code = np.zeros(len(columns[0]), dtype=np.int64)
        for c, unique in zip(columns, self._unique):
            at = pc.index_in(c, value_set=unique).fill_null(-1).to_numpy(zero_copy_only=False)
            code = np.where((code < 0) | (at < 0), -1, code * len(unique) + at)
        return pa.array(code)

    def find(self, columns: list[pa.Array]) -> np.ndarray:
        at = pc.index_in(self._coded(columns), value_set=self._codes).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(at < 0, -1, self._answers[at])


class Lookup:
    """What a table says of the different items of each block: whole numbers from 0 on, -1 for items it doesn't have.

    Keys are fields of the items or else columns of the blocks; ``table`` has a row for each set of keys at most. If it was counted to
    have at most ``BROADCAST_ROWS`` rows, tasks get it and ``rows`` are the blocks as they are; else it is joined by a
    shuffle of the items, of which a block has each one once, and ``rows`` have the answers instead of the items.
    """

    def __init__(self, blocks: DataFrame, items: str, table: DataFrame, keys: list[str], answer: str):
        fields = blocks.schema[items].dataType.elementType.names
        self._outer, self._inner = [k for k in keys if k not in fields], [k for k in keys if k in fields]
        self._items, self._known = items, None
        if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            whole = table.select(*self._outer, *self._inner, answer).toArrow().combine_chunks()
            outer = list(zip(*[whole[k].to_pylist() for k in self._outer])) or [()] * len(whole)
            places: dict[tuple, list[int]] = {}
            for k, o in enumerate(outer):
                places.setdefault(o, []).append(k)
            arrays = {o: whole.take(at).combine_chunks() for o, at in places.items()}
            known = {o: _Known([t[k].combine_chunks() for k in self._inner], t[answer].to_numpy()) for o, t in arrays.items()}
            self._known, self.rows = blocks.sparkSession.sparkContext.broadcast(known), blocks
            return
        each = blocks.select("block", *self._outer, F.posexplode(items).alias("at", "item"))
        each = each.select("block", "at", *self._outer, *[F.col("item")[k].alias(k) for k in self._inner])
        hits = each.join(table, keys).groupBy("block").agg(F.collect_list(F.struct("at", answer)).alias("found"))
        self.rows = blocks.withColumn("_n", F.size(items)).drop(items).join(hits, "block", "left")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def answers(self, batch: pa.RecordBatch, k: int) -> np.ndarray:
        """Of the k-th of some ``rows``: its items' answers in order."""
        if self._known is None:
            found, out = batch["found"][k], np.full(batch["_n"][k].as_py(), -1, dtype=np.int64)
            if found.is_valid:
                out[found.values.field("at").to_numpy()] = found.values.field(1).to_numpy()
            return out
        items, known = batch[self._items][k].values, self._known.value.get(tuple(batch[c][k].as_py() for c in self._outer))
        return np.full(len(items), -1, dtype=np.int64) if known is None else known.find([items.field(c) for c in self._inner])
