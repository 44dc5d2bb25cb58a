"""What a map shows: a rectangle at a zoom on a screen, and its projection matrices."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from .projection import dbl, lat_y_of, lng_x_of, world


@dataclass(frozen=True)
class Viewport:
    west: float
    south: float
    east: float
    north: float
    zoom: int
    res_x: int
    res_y: int

    @property
    def mercator(self) -> tuple[float, float, float, float]:
        """(x0, y0, x1, y1) in the unit square, y downwards."""
        return lng_x_of(self.west), lat_y_of(self.north), lng_x_of(self.east), lat_y_of(self.south)

    @property
    def pixel_scale(self) -> float:
        return 1 / 256 / 2**self.zoom

    @property
    def cell_scale(self) -> float:
        """The smaller of a pixel's width and height in the unit square."""
        x0, y0, x1, y1 = self.mercator
        return min((x1 - x0) / self.res_x, (y1 - y0) / self.res_y)


# The viewports that the queries and tests use.
VIEWPORTS = {
    "country": Viewport(-130, 20, -60, 55, 4, 1920, 978),
    "region": Viewport(-110, 30, -80, 45, 5, 1920, 978),
    "city": Viewport(-100, 35, -98, 37, 9, 1920, 978),
    "wrap": Viewport(170, -60, 190, 60, 3, 1000, 500),
    "world": Viewport(-180, -90, 180, 90, 0, 256, 256),
    "odd": Viewport(-110, 30, -80, 45, 5, 101, 53),
}


def pixel_matrix(width: int, height: int, lng: float, lat: float, zoom: float, pitch: float = 0.0, bearing: float = 0.0, altitude: float = 1.5) -> np.ndarray:
    """World coordinates (512-pixel tile) to pixels of a screen around a centre, y downwards."""
    scale = 2.0**zoom
    half = math.atan(0.5 / altitude)
    projection = np.zeros((4, 4))
    near, far = 0.1, _far(pitch, altitude, half)
    f = 1 / math.tan(half)
    projection[0, 0], projection[1, 1] = f / (width / height), f
    projection[2, 2], projection[2, 3], projection[3, 2] = (near + far) / (near - far), 2 * near * far / (near - far), -1
    x = 512 * (math.radians(lng) + math.pi) / (2 * math.pi)
    y = 512 * (math.pi + math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))) / (2 * math.pi)
    turn_x, turn_z, p, b = np.eye(4), np.eye(4), math.radians(-pitch), math.radians(bearing)
    turn_x[1, 1], turn_x[1, 2], turn_x[2, 1], turn_x[2, 2] = math.cos(p), -math.sin(p), math.sin(p), math.cos(p)
    turn_z[0, 0], turn_z[0, 1], turn_z[1, 0], turn_z[1, 1] = math.cos(b), -math.sin(b), math.sin(b), math.cos(b)
    back, shrink, to_centre, screen = np.eye(4), np.diag([scale / height, scale / height, 1 / height, 1.0]), np.eye(4), np.eye(4)
    back[2, 3] = -altitude
    to_centre[0, 3], to_centre[1, 3] = -x, -y
    screen = np.diag([width / 2, -height / 2, 1.0, 1.0])
    screen[0, 3], screen[1, 3] = width / 2, height / 2
    return screen @ projection @ back @ turn_x @ turn_z @ shrink @ to_centre


def _far(pitch: float, altitude: float, half: float) -> float:
    p = math.radians(pitch)
    top = math.sin(half) * altitude / math.sin(min(max(math.pi / 2 - p - half, 0.01), math.pi - 0.01))
    return (math.cos(math.pi / 2 - p) * top + altitude) * 1.01


def screen_xy(lng: Column, lat: Column, matrix: np.ndarray) -> tuple[Column, Column, Column]:
    """Pixel x, y and depth of places under a matrix of :func:`pixel_matrix`: a linear expression and one division."""
    x, y = world(lng, lat)
    row = lambda r: dbl(matrix[r, 0]) * x + dbl(matrix[r, 1]) * y + dbl(matrix[r, 3])
    w = row(3)
    return row(0) / w, row(1) / w, row(2) / w
