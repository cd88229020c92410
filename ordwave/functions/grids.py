"""Frames as grids: padding, tile plans, stencils, edges and losses. Pixel (y, x) of width w is element w * y + x."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let, mean
from .motion import flat, stack
from .restore import parts

# Fixed values of the library's rules: grey weights, tile margin, the area of reference and the flow that it allows.
GREY = (0.2989, 0.5870, 0.1140)
MARGIN, AREA, FLOW = 18, 2088960.0, 24.0


def narrow(x: Column) -> Column:
    """The high byte of a 16-bit sample."""
    return F.shiftright(x, 8)


def grey(r: Column, g: Column, b: Column) -> Column:
    return r * GREY[0] + g * GREY[1] + b * GREY[2]


def mirrored(i: Column, n) -> Column:
    """An index beyond 0 .. n - 1 reflected at the edges, which are not repeated."""
    n = n if isinstance(n, Column) else F.lit(n)
    back = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
    return F.when(n == 1, 0).when(back < n, back).otherwise(2 * (n - 1) - back)


def pad_reflect(a, h: int, w: int, top: int, left: int, bottom: int, right: int) -> Column:
    """The frame with margins that mirror it."""
    width = left + w + right
    source = lambda i: mirrored(F.floor(i / width) - top, h) * w + mirrored(F.pmod(i, F.lit(width)) - left, w)
    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.lit((top + h + bottom) * width - 1)), lambda i: F.element_at(v, (source(i) + 1).cast("int"))))


def trim(a, w: int, top: int, left: int, h: int, width: int) -> Column:
    """The h x width part of a frame of width w that begins at (top, left)."""
    y, x = lambda i: F.floor(i / w), lambda i: F.pmod(i, F.lit(w))
    return F.filter(a, lambda _, i: y(i).between(top, top + h - 1) & x(i).between(left, left + width - 1))


def pad_to(n: Column, multiple: int) -> Column:
    """How many pixels are missing to a multiple."""
    return F.pmod(-n, F.lit(multiple))


def mode_tiles(h: Column, w: Column, mode: Column) -> Column:
    """The tile plan of a mode: tile height and width, padded height and width, rows and columns of tiles.

    Mode 0 is one tile of even sides; 1 halves the longer side; 2, 3 and 4 divide both sides by as
    much. A divided side is first raised to twice its divisor, so that tiles have even sides; the
    frame is padded to whole tiles, and each tile is read with a margin of MARGIN pixels.
    """
    up = lambda n, m: F.ceil(n / m) * m
    wide = w >= h
    by = lambda longer: F.when(mode == 1, F.when(longer, 2).otherwise(1)).when(mode >= 2, mode).otherwise(1)
    side = lambda n, d: F.floor(up(n, 2 * d) / d)
    th, tw = side(h, by(~wide)), side(w, by(wide))
    return let(F.struct(th.alias("th"), tw.alias("tw")), lambda t: F.struct(t["th"].alias("tile_h"), t["tw"].alias("tile_w"), up(h, t["th"]).alias("padded_h"), up(w, t["tw"]).alias("padded_w"), F.ceil(h / t["th"]).alias("rows"), F.ceil(w / t["tw"]).alias("columns")))


def upscale_steps(target: Column, step: int, most: int = 16) -> Column:
    """How many times an upscaling by `step` is repeated until it reaches the target; it may exceed it."""
    n = F.lit(0)
    for k in range(most):
        n = n + F.when(F.lit(float(step**k)) < target, 1).otherwise(0)
    return n


def flow_limit(h: Column, w: Column) -> Column:
    return F.sqrt(h * w / AREA) * FLOW


def dynamic_scale(full: Column, half: Column, limit: Column) -> Column:
    """1, 0.5 or 0.25: halved where the largest flow at that scale exceeds the limit."""
    return F.when(full <= limit, 1.0).when(half <= limit, 0.5).otherwise(0.25)


def largest(a) -> Column:
    return F.array_max(F.transform(a, F.abs))


def stencil(frames: np.ndarray, taps: dict[tuple[int, int], float]) -> np.ndarray:
    """Of (n, h, w): each pixel's sum of neighbours (dy, dx, within 1) times their taps; edges are mirrored."""
    _, h, w = frames.shape
    grown = np.pad(frames, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    return sum(tap * grown[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for (dy, dx), tap in taps.items())


def _outer(col: list[float], row: list[float]) -> dict[tuple[int, int], float]:
    return {(i - 1, j - 1): float(c * r) for i, c in enumerate(col) for j, r in enumerate(row) if c * r}


SMOOTH, SOBEL_X, SOBEL_Y = _outer([0.25, 0.5, 0.25], [0.25, 0.5, 0.25]), _outer([1, 2, 1], [-1, 0, 1]), _outer([-1, 0, 1], [1, 2, 1])


def slopes(frames: np.ndarray, smooth: bool = True) -> np.ndarray:
    """Half the absolute Sobel slopes along both axes, of the smoothed frames."""
    base = stencil(frames, SMOOTH) if smooth else frames
    return (np.abs(stencil(base, SOBEL_X)) + np.abs(stencil(base, SOBEL_Y))) / 2


def gradient(h: int, w: int, smooth: bool = True):
    """A pandas UDF of a frame: its slopes."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sloped(px: pd.Series) -> pd.Series:
        return flat(slopes(stack(px, h, w), smooth))

    return sloped


def edge_density(h: int, w: int, threshold: float):
    """A pandas UDF of a frame: the share of pixels whose slopes reach the threshold."""

    @F.pandas_udf(T.DoubleType())
    def density(px: pd.Series) -> pd.Series:
        return pd.Series((slopes(stack(px, h, w)) >= threshold).mean((1, 2)))

    return density


def end_point_error(a, b, epsilon: float = 1e-6) -> Column:
    """Mean length of the difference of two flows, given as arrays of (x, y)."""
    return mean(F.zip_with(a, b, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + epsilon)))


def sobel_loss(h: int, w: int):
    """A pandas UDF of two frames: the mean absolute difference of their Sobel slopes, along both axes."""

    @F.pandas_udf(T.DoubleType())
    def loss(a: pd.Series, b: pd.Series) -> pd.Series:
        d = stack(a, h, w) - stack(b, h, w)
        return pd.Series((np.abs(stencil(d, SOBEL_X)).mean((1, 2)) + np.abs(stencil(d, SOBEL_Y)).mean((1, 2))) / 2)

    return loss


def windows(a, h: int, w: int, k: int) -> Column:
    """All k x k windows of a frame, by their upper left pixel: [(y, x, pixels)]."""
    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.lit((h - k + 1) * (w - k + 1) - 1)), lambda i: F.struct(F.floor(i / (w - k + 1)).cast("int").alias("y"), F.pmod(i, F.lit(w - k + 1)).cast("int").alias("x"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda r: F.slice(v, (F.floor(i / (w - k + 1)) + r) * w + F.pmod(i, F.lit(w - k + 1)) + 1, F.lit(k)))).alias("px"))))


def census_loss(h: int, w: int, reach: int = 3):
    """A pandas UDF of two frames: mean soft distance of how each pixel's neighbourhood compares with it, without the outermost pixels.

    Differences d to the neighbours become d / sqrt(0.81 + d²); two pixels' descriptions differ by
    e² / (0.1 + e²) for each neighbour. Neighbours beyond the edges are 0. An Arrow batch is worked on
    in parts, as each pixel has (2 reach + 1)² numbers.
    """

    def described(px: np.ndarray) -> np.ndarray:
        padded = np.pad(px, ((0, 0), (reach, reach), (reach, reach)))
        near = np.stack([padded[:, i : i + h, j : j + w] for i in range(2 * reach + 1) for j in range(2 * reach + 1)], 1)
        d = near - px[:, None]
        return d / np.sqrt(0.81 + d * d)

    @F.pandas_udf(T.DoubleType())
    def loss(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for part in parts(len(a), h * w * (2 * reach + 1) ** 2):
            e = described(stack(a[part], h, w)) - described(stack(b[part], h, w))
            out[part] = (e * e / (0.1 + e * e)).mean(1)[:, 1:-1, 1:-1].mean((1, 2))
        return pd.Series(out)

    return loss


def canny_edges(px: np.ndarray, spread: float = 0.33) -> np.ndarray:
    """Edges of one grey frame: smoothed Sobel slopes, thinned across the edge, kept from a strong pixel on.

    Thresholds lie `spread` below and above the median of the frame, by size.
    """
    p = np.pad(px.astype(float), 2, mode="reflect")
    shift = lambda m, dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    of = lambda m, taps: sum(t * shift(m, *at) for at, t in taps.items())
    smooth = of(p, SMOOTH)
    gx, gy = of(smooth, SOBEL_X), of(smooth, SOBEL_Y)
    size = np.hypot(gx, gy)
    low, high = sorted([(1 - spread) * np.median(px), (1 + spread) * np.median(px)])
    around = np.pad(size, 1)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    ahead = np.choose(sector, [shift(around, *s) for s in ((0, 1), (1, 1), (1, 0), (1, -1))])
    behind = np.choose(sector, [shift(around, *s) for s in ((0, -1), (-1, -1), (-1, 0), (-1, 1))])
    thin = (size >= ahead) & (size >= behind) & (size > 0)
    weak, grown = thin & (size >= low), thin & (size >= high)
    while True:  # strong pixels spread over the weak ones they touch
        q = np.pad(grown, 1)
        more = weak & np.logical_or.reduce([shift(q, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        if (more | grown).sum() == grown.sum():
            return grown
        grown = more | grown


def canny(h: int, w: int):
    """A pandas UDF of a frame: its edge pixels as 0 and 1."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def edges(px: pd.Series) -> pd.Series:
        return pd.Series([canny_edges(np.asarray(v).reshape(h, w)).astype(int).ravel().tolist() for v in px])

    return edges


def area_weights(n: int, m: int) -> np.ndarray:
    """How much of each of n pixels each of m pixels over the same length covers; rows add up to 1."""
    lo, hi = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
    pixel = np.arange(n)[None, :]
    return np.clip(np.minimum(hi, pixel + 1) - np.maximum(lo, pixel), 0, None) * m / n


#: Fixed value of the usual cubic kernel: its slope at one pixel from the middle.
CUBIC = -0.75


def cubic_weights(n: int, m: int) -> np.ndarray:
    """How much of each of n pixels each of m pixels over the same length takes from the four around its middle; pixels beyond the ends are the last ones."""
    middle = (np.arange(m) + 0.5) * n / m - 0.5
    first = np.floor(middle).astype(int)
    out = np.zeros((m, n))
    for step in (-1, 0, 1, 2):
        d = np.abs(middle - (first + step))
        near, far = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1, ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
        np.add.at(out, (np.arange(m), np.clip(first + step, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
    return out


def _resized(h: int, w: int, rows: np.ndarray, columns: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def resized(px: pd.Series) -> pd.Series:
        return flat(rows @ stack(px, h, w) @ columns.T)

    return resized


def resize_area(h: int, w: int, to_h: int, to_w: int):
    """A pandas UDF of a frame: resized, each new pixel the mean of the area it covers."""
    return _resized(h, w, area_weights(h, to_h), area_weights(w, to_w))


def resize_cubic(h: int, w: int, to_h: int, to_w: int):
    """A pandas UDF of a frame: resized by cubic weights of the 4 x 4 pixels around each new one."""
    return _resized(h, w, cubic_weights(h, to_h), cubic_weights(w, to_w))
