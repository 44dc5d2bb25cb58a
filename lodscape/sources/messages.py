"""Encodings of results: binary points, packed bitmaps, GeoJSON, pairs; and their decoders."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projection import dbl, x_lng, y_lat
from ..functions.viewport import Viewport

#: Progress, three times in seconds, message type; then, of bitmaps, size and corners. All big-endian.
HEADER, BITMAP_HEADER = struct.Struct(">i3di"), struct.Struct(">ii4d")


@dataclass(frozen=True)
class Header:
    progress: int = 100
    total_seconds: float = 0.0
    tree_seconds: float = 0.0
    aggregate_seconds: float = 0.0

    def bytes(self, kind: int) -> bytes:
        return HEADER.pack(self.progress, self.total_seconds, self.tree_seconds, self.aggregate_seconds, kind)


def point_blocks(reduced: DataFrame) -> DataFrame:
    """``(block)``: binary blocks of (lat, lng) pairs, made on the executors; in any order they make a message's body."""

    def pack(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"block": [np.ascontiguousarray(b[["lat", "lng"]].to_numpy(), dtype=">f8").tobytes()]})

    return reduced.select("lat", "lng").mapInPandas(pack, "block binary")


def point_body(reduced: DataFrame) -> bytes:
    """What a point message holds; for results of a bounded size."""
    return b"".join(bytes(r["block"]) for r in point_blocks(reduced).toLocalIterator())


def point_message(reduced: DataFrame, header: Header = Header()) -> bytes:
    """A whole point message."""
    return header.bytes(0) + point_body(reduced)


def points_of_blocks(blocks: DataFrame) -> DataFrame:
    """``(lat, lng)`` of blocks as :func:`point_blocks` makes them, in any order; decoded where the blocks are."""

    def unpack(batches):
        import pandas as pd

        for b in batches:
            for block in b["block"]:
                yield pd.DataFrame(np.frombuffer(block, ">f8").reshape(-1, 2).astype(float), columns=["lat", "lng"])

    return blocks.select("block").mapInPandas(unpack, "lat double, lng double")


def bitmap_bytes(pixels: DataFrame) -> DataFrame:
    """``(i, byte_no, byte)``: each column's pixels, eight rows to a byte, the uppermost in the highest bit."""
    return pixels.groupBy("i", F.floor(F.col("j") / 8).cast("long").alias("byte_no")).agg(F.bit_or(F.expr("shiftleft(1L, cast(7 - j % 8 as int))")).alias("byte"))


def bitmap_message(pixels: DataFrame, v: Viewport, header: Header = Header()) -> bytes:
    """A whole bitmap message."""
    return header.bytes(1) + bitmap_body(pixels, v)


def bitmap_body(pixels: DataFrame, v: Viewport) -> bytes:
    """What a bitmap message holds: its size depends on the screen alone."""
    width = -(-v.res_y // 8)
    body = np.zeros(v.res_x * width, dtype=np.uint8)
    for r in bitmap_bytes(pixels).toLocalIterator():
        body[r["i"] * width + r["byte_no"]] = r["byte"]
    return BITMAP_HEADER.pack(v.res_x, v.res_y, v.west, v.south, v.east, v.north) + body.tobytes()


def decoded_bitmap(packed: DataFrame, v: Viewport) -> DataFrame:
    """``(i, j, lng, lat)``: the pixels of :func:`bitmap_bytes`, with their centres."""
    bits = packed.select("i", "byte_no", "byte", F.explode(F.expr("sequence(0, 7)")).alias("bit")).where("(shiftright(byte, 7 - bit) & 1) = 1")
    x0, y0, x1, y1 = v.mercator
    at = bits.select("i", (F.col("byte_no") * 8 + F.col("bit")).alias("j")).where(F.col("j") < v.res_y)
    lng = x_lng((F.col("i") + 0.5) * dbl((x1 - x0) / v.res_x) + dbl(x0))
    lat = y_lat((F.col("j") + 0.5) * dbl((y1 - y0) / v.res_y) + dbl(y0))
    return at.select("i", "j", lng.alias("lng"), lat.alias("lat"))


def decode_message(message: bytes) -> tuple[dict, list[tuple[float, float]] | np.ndarray]:
    """(header, points or a boolean picture) of a message, as a client reads it."""
    progress, total, tree, aggregate, kind = HEADER.unpack_from(message)
    head = {"progress": progress, "total": total, "tree": tree, "aggregate": aggregate, "type": kind}
    if kind == 0:
        return head, [tuple(p) for p in np.frombuffer(message, ">f8", offset=HEADER.size).reshape(-1, 2).tolist()]
    res_x, res_y, *corners = BITMAP_HEADER.unpack_from(message, HEADER.size)
    head |= {"res_x": res_x, "res_y": res_y, "corners": corners}
    rows = np.frombuffer(message, np.uint8, offset=HEADER.size + BITMAP_HEADER.size).reshape(res_x, -1)
    return head, np.unpackbits(rows, axis=1)[:, :res_y].astype(bool)


def geojson_features(reduced: DataFrame) -> DataFrame:
    """``(point_id, feature)``: each point as a GeoJSON feature."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return reduced.select("point_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"))).alias("feature"))


def latlng_pairs(reduced: DataFrame, progress: int = 100) -> DataFrame:
    """``(point_id, pair, progress)``: each point as ``[lat, lng]``."""
    return reduced.select("point_id", F.array("lat", "lng").alias("pair"), F.lit(progress).alias("progress"))
