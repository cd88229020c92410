"""Expressions over arrays of pixels, row by row (pixel (y, x) of a frame of width w is element w * y + x)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once per row, however often body, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean(a) -> Column:
    """Null for an empty array."""
    return let(a, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))


def variance(a) -> Column:
    """Population variance."""
    return let(a, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def mean_abs_diff(a, b) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def weighted(a) -> Column:
    """Sum of each element times its place from 1: a digest of an array that depends on the order."""
    return total(F.transform(a, lambda x, i: x * (i + 1)))


def where_pixel(a, w: int, test: Callable[[Column, Column], Column]) -> Column:
    """The pixels whose (y, x) passes the test, in order."""
    return F.filter(a, lambda _, i: test(F.floor(i / w), F.pmod(i, F.lit(w))))


def crop(a, h: int, w: int, my: int, mx: int) -> Column:
    """Without margins of my rows and mx columns; a margin that leaves nothing changes nothing."""
    if 2 * my >= h or 2 * mx >= w:
        return doubles(a)
    return where_pixel(a, w, lambda y, x: y.between(my, h - 1 - my) & x.between(mx, w - 1 - mx))


def split_pieces(a, w: int, nx: int, ny: int) -> Column:
    """Interleaved pieces: pixel (y, x) goes to piece (x mod nx, y mod ny), x outermost."""
    return F.array(*[where_pixel(a, w, lambda y, x, px=px, py=py: (F.pmod(x, F.lit(nx)) == px) & (F.pmod(y, F.lit(ny)) == py)) for px in range(nx) for py in range(ny)])


def sew_pieces(pieces, h: int, w: int, nx: int, ny: int) -> Column:
    """The frame whose interleaved pieces these are; h and w are multiples of ny and nx."""
    at = lambda i: (F.floor(i / w), F.pmod(i, F.lit(w)))

    def pixel(given, i):
        y, x = at(i)
        piece = F.pmod(x, F.lit(nx)) * ny + F.pmod(y, F.lit(ny))
        return F.element_at(F.element_at(given, (piece + 1).cast("int")), (F.floor(y / ny) * (w // nx) + F.floor(x / nx) + 1).cast("int"))

    return let(pieces, lambda given: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: pixel(given, i)))


def roll(a, h: int, w: int, dy: int, dx: int) -> Column:
    """Circular shift by dy rows down and dx columns right."""
    source = lambda i: F.pmod(F.floor(i / w) - dy, F.lit(h)) * w + F.pmod(F.pmod(i, F.lit(w)) - dx, F.lit(w))
    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.element_at(v, (source(i) + 1).cast("int"))))


def gaussian(half: int = 3, sigma: float = 7 / 6) -> list[float]:
    """Normalised taps from -half to half."""
    taps = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def blur(a, h: int, w: int, taps: list[float]) -> Column:
    """Separable correlation along x, then y, with zeros beyond the edges."""
    half = len(taps) // 2

    def along(values, inside, stride):
        def pixel(v, i):
            parts = [F.when(inside(i, k - half), F.coalesce(F.get(values, (i + (k - half) * stride).cast("int")), F.lit(0.0))).otherwise(0.0) * t for k, t in enumerate(taps)]
            out = parts[0]
            for p in parts[1:]:
                out = out + p
            return out

        return F.transform(values, pixel)

    rows = let(a, lambda v: along(v, lambda i, k: (F.pmod(i, F.lit(w)) + k).between(0, w - 1), 1))
    return let(rows, lambda v: along(v, lambda i, k: (F.floor(i / w) + k).between(0, h - 1), w))
