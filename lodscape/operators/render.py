"""Small images of points, and how much two images differ.

Arrays are (column, row, channel); a margin of radius + 1 pixels surrounds the node's own pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import BACKGROUND_RGB, POINT_RGB, dbl, smooth_edge

Pixels = dict[tuple[int, int], tuple[int, int, int]]


class Renderer(Protocol):
    """Draws points of the node with a centre and half width at a resolution; tells whether the image changed."""

    def blank(self, resolution: int) -> np.ndarray: ...

    def draw(self, image: np.ndarray, cx: float, cy: float, half: float, resolution: int, x: float, y: float) -> bool: ...

    def draw_sparse(self, pixels: Pixels, cx: float, cy: float, half: float, resolution: int, x: float, y: float) -> bool: ...


class ErrorMetric(Protocol):
    def dense(self, a: np.ndarray, b: np.ndarray) -> float: ...

    def sparse(self, a: Pixels, b: Pixels) -> float: ...


class SnapRenderer:
    """A point sets the one pixel it falls into."""

    def blank(self, resolution: int) -> np.ndarray:
        return np.zeros((resolution, resolution), dtype=np.uint8)

    def _place(self, cx, cy, half, resolution, x, y) -> tuple[int, int]:
        length = 2 * half / resolution
        return min(resolution - 1, max(0, int((x - cx + half) / length))), min(resolution - 1, max(0, int((y - cy + half) / length)))

    def draw(self, image, cx, cy, half, resolution, x, y) -> bool:
        at = self._place(cx, cy, half, resolution, x, y)
        new = not image[at]
        image[at] = 1
        return new

    def draw_sparse(self, pixels, cx, cy, half, resolution, x, y) -> bool:
        at = self._place(cx, cy, half, resolution, x, y)
        new = at not in pixels
        pixels[at] = POINT_RGB
        return new


class DiscRenderer:
    """A point is a disc with an edge one pixel wide, blended over what is there."""

    def __init__(self, radius: int = 1):
        self.radius = radius

    def blank(self, resolution: int) -> np.ndarray:
        side = resolution + 2 * (self.radius + 1)
        return np.full((side, side, 3), BACKGROUND_RGB, dtype=np.int32)

    def _disc(self, cx, cy, half, resolution, x, y) -> tuple[slice, slice, np.ndarray]:
        length = 2 * half / resolution
        left, top = cx - half - (self.radius + 1) * length, cy - half - (self.radius + 1) * length
        reach = self.radius * length
        i = np.arange(int((x - reach - left) / length), int((x + reach - left) / length) + 1)
        j = np.arange(int((y - reach - top) / length), int((y + reach - top) / length) + 1)
        d = np.hypot(left + (i[:, None] + 0.5) * length - x, top + (j[None, :] + 0.5) * length - y) / length
        t = np.clip(self.radius - d + 0.5, 0, 1)
        return slice(i[0], i[-1] + 1), slice(j[0], j[-1] + 1), t * t * (3 - 2 * t)

    def draw(self, image, cx, cy, half, resolution, x, y) -> bool:
        i, j, alpha = self._disc(cx, cy, half, resolution, x, y)
        old = image[i, j]
        new = (np.array(POINT_RGB) * alpha[..., None] + old * (1 - alpha[..., None])).astype(np.int32)
        changed = bool((old != new).any())
        image[i, j] = new
        return changed

    def draw_sparse(self, pixels, cx, cy, half, resolution, x, y) -> bool:
        i, j, alpha = self._disc(cx, cy, half, resolution, x, y)
        changed = False
        for a in range(i.stop - i.start):
            for b in range(j.stop - j.start):
                at, s = (i.start + a, j.start + b), alpha[a, b]
                old = pixels.get(at)
                new = tuple(int(c * s + o * (1 - s)) for c, o in zip(POINT_RGB, old or BACKGROUND_RGB))
                changed |= new != old
                pixels[at] = new
        return changed


def _gray(rgb: np.ndarray) -> np.ndarray:
    return (rgb @ np.array([0.3, 0.59, 0.11])).astype(np.int64)


class GrayError:
    """Sum of absolute (power 1) or squared (power 2) differences in gray; a missing pixel is background."""

    def __init__(self, power: int = 2):
        self.power = power

    def dense(self, a, b) -> float:
        return float((np.abs(_gray(a) - _gray(b)) ** self.power).sum())

    def sparse(self, a, b) -> float:
        at = sorted(a.keys() | b.keys())
        if not at:
            return 0.0
        return self.dense(np.array([a.get(k, BACKGROUND_RGB) for k in at]), np.array([b.get(k, BACKGROUND_RGB) for k in at]))


class SnapError:
    """Number of pixels that are set in only one image."""

    def dense(self, a, b) -> float:
        return float((a != b).sum())

    def sparse(self, a, b) -> float:
        return float(len(a.keys() ^ b.keys()))


def renderer(name: str) -> Renderer:
    return DiscRenderer() if name == "disc" else SnapRenderer()


def metric(name: str, error: str = "l1") -> ErrorMetric:
    return GrayError(1 if error == "l1" else 2) if name == "disc" else SnapError()


def folded(rows: DataFrame, keys: list[str], picture: Callable[[tuple], Callable[[float, float], bool]], at: tuple[str, str] = ("mx", "my")) -> DataFrame:
    """Those of ``rows`` (``keys, point_id`` and places) that change the picture of their key when drawn by arrival.

    ``picture`` gives, for a key, a function that draws a place and tells whether that changed anything. Discs
    of one colour only ever bring a pixel closer to it, so what changes nothing after some of the earlier
    points changes nothing after all of them. So every partition first draws its own points and passes on
    only those that change its own pictures, a number that a picture bounds and not the points; these are then
    dealt by key, sorted and drawn again. A task draws one picture at a time, a batch of points at a time.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, change = None, None
        for b in batches:
            keep = []
            for *key, x, y in zip(*(b[k] for k in keys), b[at[0]], b[at[1]]):
                if key != now:
                    now, change = key, picture(tuple(key))
                keep.append(change(x, y))
            yield b[keep]

    own = rows.sortWithinPartitions(*keys, "point_id").mapInPandas(draw, rows.schema)
    return own.repartition(*keys).sortWithinPartitions(*keys, "point_id").mapInPandas(draw, rows.schema)


def cell_picture(place: Callable[[tuple], tuple[float, float, float]], draw_with: str) -> Callable[[tuple], Callable[[float, float], bool]]:
    """One-pixel pictures for :func:`folded`; ``place`` gives a cell's centre and half width from its keys."""

    def of(key: tuple) -> Callable[[float, float], bool]:
        renderer_, where = renderer(draw_with), place(key)
        image = renderer_.blank(1)
        return lambda x, y: renderer_.draw(image, *where, 1, x, y)

    return of


def disc_pixels(x: Column, y: Column, radius: int = 1) -> Column:
    """The pixels a disc at pixel coordinates covers, as an array of (i, j, alpha)."""
    span = lambda c: F.sequence(F.floor(c - radius).cast("long"), F.floor(c + radius).cast("long"))
    alpha = lambda i, j: smooth_edge(F.sqrt((i + 0.5 - x) * (i + 0.5 - x) + (j + 0.5 - y) * (j + 0.5 - y)), dbl(radius))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.alias("i"), j.alias("j"), alpha(i, j).alias("alpha")))))


def opaque_image(pixels: DataFrame) -> DataFrame:
    """``(i, j, gray)`` of discs drawn over each other: what shows through is the product of what each lets through.
    (Without cutting to whole numbers between discs, so that the order doesn't matter.)"""
    through = F.exp(F.sum(F.ln(F.greatest(dbl(1) - F.col("alpha"), dbl(1e-12)))))
    back, front = (0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2] for c in (BACKGROUND_RGB, POINT_RGB))
    return pixels.groupBy("i", "j").agg((dbl(front) + (dbl(back) - dbl(front)) * through).alias("gray"))


def gray_error(a: DataFrame, b: DataFrame, power: int = 2) -> DataFrame:
    """``(error)`` between two tables ``(i, j, gray)``; a missing pixel is background."""
    back = dbl(math.floor(0.3 * BACKGROUND_RGB[0] + 0.59 * BACKGROUND_RGB[1] + 0.11 * BACKGROUND_RGB[2]))
    both = a.select("i", "j", F.col("gray").alias("a")).join(b.select("i", "j", F.col("gray").alias("b")), ["i", "j"], "full")
    d = F.abs(F.coalesce("a", back) - F.coalesce("b", back))
    return both.agg(F.coalesce(F.sum(d if power == 1 else d * d), dbl(0)).alias("error"))
