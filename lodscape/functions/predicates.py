"""Filters on time, text and place; all are plain predicates that scans can prune by."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .projection import dbl
from .viewport import Viewport


def keyword_is(column: Column, keyword: str) -> Column:
    """A keyword without text search; ``%`` lets everything through."""
    return F.lit(True) if keyword == "%" else column == keyword


def in_slice(ts: Column, start: str, end: str, *, closed: bool = False) -> Column:
    """Half-open time slice; ``closed`` also takes its end, as rows on a boundary then count in two slices."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (ts >= a) & ((ts <= b) if closed else (ts < b))


def strictly_within(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return (x > dbl(x0)) & (x < dbl(x1)) & (y > dbl(y0)) & (y < dbl(y1))


def in_bounds(lng: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Closed rectangle of degrees."""
    return lng.between(dbl(west), dbl(east)) & lat.between(dbl(south), dbl(north))


def bounds_overlap(a: tuple[Column, Column, Column, Column], west: float, south: float, east: float, north: float) -> Column:
    return (a[0] <= dbl(east)) & (a[2] >= dbl(west)) & (a[1] <= dbl(north)) & (a[3] >= dbl(south))


def rectangles(v: Viewport) -> list[tuple[float, float, float, float]]:
    """The viewport as one or two rectangles of the unit square: a box across the antimeridian is two, 360 degrees or more the whole width."""
    _, y0, _, y1 = Viewport(0, max(-90.0, min(90.0, v.south)), 0, max(-90.0, min(90.0, v.north)), v.zoom, v.res_x, v.res_y).mercator
    if v.east - v.west >= 360:
        return [(0.0, y0, 1.0, y1)]
    west = (v.west + 180) % 360 - 180
    east = 180.0 if v.east == 180 else (v.east + 180) % 360 - 180
    if west > east:
        return [(west / 360 + 0.5, y0, 1.0, y1), (0.0, y0, east / 360 + 0.5, y1)]
    return [(west / 360 + 0.5, y0, east / 360 + 0.5, y1)]


def in_viewport(x: Column, y: Column, v: Viewport) -> Column:
    """Strictly inside the wrapped viewport: one predicate, since its rectangles are disjoint."""
    out = F.lit(False)
    for r in rectangles(v):
        out = out | strictly_within(x, y, *r)
    return out


def within_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    """Closed disc in the plane, with its square as a predicate that prunes."""
    box = x.between(dbl(cx - r), dbl(cx + r)) & y.between(dbl(cy - r), dbl(cy + r))
    return box & (((x - dbl(cx)) * (x - dbl(cx)) + (y - dbl(cy)) * (y - dbl(cy))) <= dbl(r * r))


def cell_meets(level: Column, ci: Column, cj: Column, v: Viewport) -> Column:
    """A quadtree cell and the viewport's rectangle touch."""
    x0, y0, x1, y1 = v.mercator
    w = F.pow(dbl(0.5), level)
    return ~((ci * w > dbl(x1)) | ((ci + 1) * w < dbl(x0)) | (cj * w > dbl(y1)) | ((cj + 1) * w < dbl(y0)))


def hash_unit(key: Column, seed: int = 7) -> Column:
    """A number in [0, 1) from an id, by integer arithmetic that any engine can repeat."""
    h = F.pmod(key * F.lit(48271).cast("long") + F.lit(seed * 7919 + 12345).cast("long"), F.lit(2147483647).cast("long"))
    h = F.pmod(h * F.lit(16807).cast("long") + F.lit(97).cast("long"), F.lit(2147483647).cast("long"))
    return h.cast("double") / dbl(2147483647)


def bernoulli(key: Column, p: float | Column, seed: int = 7) -> Column:
    """Keeps about a share p of the rows, always the same ones."""
    return hash_unit(key, seed) < (dbl(p) if isinstance(p, (int, float)) else p)


# Words that text search leaves out.
STOP_WORDS = frozenset(
    "i me my we our ours you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had do does did "
    "a an the and but if or as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very can will just".split()
)
_TERM = re.compile(r"\s*(<->|[&|!()]|[^\s&|!()<]+)")


def text_matches(text: Column, query: str, stem=None) -> Column:
    """A word query with ``&``, ``|``, ``!``, ``<->`` and brackets, on words of ``[a-z0-9]``.

    ``stem``: a pair (function on words of the query, function on an array column of words). A
    malformed query matches nothing.
    """
    plain = F.split(F.lower(text), "[^a-z0-9]+")
    words = stem[1](plain) if stem else plain
    tokens = _TERM.findall(query.lower())
    if "".join(tokens) != re.sub(r"\s+", "", query.lower()):
        return F.lit(False)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def phrase_of(found: list[str]) -> Column:
        if len(found) == 1:
            return F.array_contains(words, found[0])
        joined = F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w != ""), " "), F.lit(" "))
        return F.contains(joined, F.lit(f" {' '.join(found)} "))

    def atom() -> Column | None:
        token = peek()
        if token is None or token in ("&", "|", ")", "<->"):
            raise ValueError
        token = take()
        if token == "!":
            inner = atom()
            return None if inner is None else ~inner
        if token == "(":
            inner = either()
            if peek() != ")":
                raise ValueError
            take()
            return inner
        run = [token]
        while peek() == "<->":
            take()
            if peek() is None or peek() in ("&", "|", "!", "(", ")", "<->"):
                raise ValueError
            run.append(take())
        run = [stem[0](w) if stem else w for w in run if w not in STOP_WORDS]
        return phrase_of(run) if run else None

    def both() -> Column | None:
        out = atom()
        while peek() == "&":
            take()
            more = atom()
            out = more if out is None else out if more is None else out & more
        return out

    def either() -> Column | None:
        out = both()
        while peek() == "|":
            take()
            more = both()
            out = more if out is None else out if more is None else out | more
        return out

    try:
        result = either()
        if peek() is not None:
            raise ValueError
    except ValueError:
        return F.lit(False)
    return F.lit(False) if result is None else F.coalesce(result, F.lit(False))
