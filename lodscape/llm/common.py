"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StringType, StructField, StructType

from ..sources.scratch import settled as written  # noqa: F401

#: Tables counted to hold at most so many rows, or so many entries of an array column in all rows, may be broadcast (some 10 MB);
#: larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def public_vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """What runs inside runs under these settings of the session."""
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def texts_at_once(spark: SparkSession, rows: int = 512) -> AbstractContextManager[None]:
    """What runs inside reads texts and passes them to and from workers so many at a time. Spark's own batches of 10,000 rows are some
    30 MB of texts, and their buffers, outside of the heap, are there several times over in an executor and its workers."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": str(rows)})


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict = {}


def kept_alone(make: Callable) -> Callable:
    """``make``, of which a worker keeps the last result, but one only of all functions so marked: what another made before is
    let go. Workers live on from stage to stage, and what one of them remembers may take some 100 MB."""

    @functools.wraps(make)
    def get(*of):
        if _kept.get("of") != (make, of):
            let_go()
            _kept.update(of=(make, of), value=make(*of))
        return _kept["value"]

    return get


def let_go() -> None:
    """What a worker keeps (:func:`kept_alone`) goes, and its memory with it."""
    _kept.clear()
    give_back()


def give_back() -> None:
    """Memory that a worker no longer uses goes back to the system: what one stage took would else add to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others needn't
    if trim is not None:
        trim(0)


class Memo(dict):
    """Answers of a function on short keys, kept in a worker: at least the last ``most / 2`` that were asked for, at most ``most``."""

    def __init__(self, function: Callable[[str], object], most: int = 400_000, longest: int = 64):
        self._function, self._half, self._longest, self._older = function, most // 2, longest, {}

    def __missing__(self, key: str):
        value = self._older.get(key)
        if value is None:
            value = self._function(key)
            if isinstance(key, (str, bytes)) and len(key) > self._longest:
                return value
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


def with_computed(df: DataFrame, name: str, kind: DataType, source: Column, make: Callable[[], Callable]) -> DataFrame:
    """``df`` and a column ``name`` (string, binary or long): ``make()``, called once for each task, gives the function of
    ``source``'s values. Rows go through Arrow a few at a time, so a worker holds few of them as Python objects."""
    wide = df.select("*", source.alias("_source"))
    fields = StructType([*df.schema.fields, StructField(name, kind)])
    arrow = {StringType(): pa.string(), BinaryType(): pa.binary(), LongType(): pa.int64()}[kind]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                values = pa.array([function(v) for v in part.column(part.num_columns - 1).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*part.schema.names[:-1], name])
        give_back()

    return wide.mapInArrow(computed, fields)
