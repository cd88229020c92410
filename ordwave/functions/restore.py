"""Noise reduction, colour and oriented bands of frames, for stacks of frames as (n, height, width[, 3]) arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let
from .motion import flat, stack

#: Values worked on at once in a task.
PIXELS = 1 << 21


def parts(n: int, pixels: int) -> Iterator[slice]:
    """Slices of n frames that make `pixels` values each, about PIXELS values in all."""
    step = max(1, PIXELS // max(1, pixels))
    return (slice(i, i + step) for i in range(0, n, step))


def non_local_means(frames: np.ndarray, strength: float, patch: int = 1, search: int = 2) -> np.ndarray:
    """Each pixel as the mean of those within `search` of it, weighted by how alike their surroundings are.

    The weight is exp(-d / strength ** 2) for the mean squared difference d of the patches of 2 * patch
    + 1 pixels a side around both. For each offset all patches are compared at once, by sums over an
    integral image. Frames are mirrored at their borders.
    """
    n, h, w = frames.shape
    side, edge = 2 * patch + 1, patch + search
    grown = np.pad(frames, ((0, 0), (edge, edge), (edge, edge)), mode="reflect")
    at = lambda dy, dx, more: grown[:, edge + dy - more : edge + dy + h + more, edge + dx - more : edge + dx + w + more]
    total, weights = np.zeros_like(frames, float), np.zeros_like(frames, float)
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            summed = np.pad(((at(0, 0, patch) - at(dy, dx, patch)) ** 2).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
            box = summed[:, side:, side:] - summed[:, :-side, side:] - summed[:, side:, :-side] + summed[:, :-side, :-side]
            weight = np.exp(-np.maximum(box, 0) / (side * side * strength**2))
            total += weight * at(dy, dx, 0)
            weights += weight
    return total / weights


def denoised(h: int, w: int, strength: float, patch: int = 1, search: int = 2):
    """A pandas UDF of a frame: without noise, by non-local means."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def clean(px: pd.Series) -> pd.Series:
        return pd.concat([flat(non_local_means(stack(px[part], h, w), strength, patch, search)) for part in parts(len(px), h * w)] or [pd.Series([], dtype=object)], ignore_index=True)

    return clean


# --- colour


def yuv_matrix(red: float = 0.2126, blue: float = 0.0722) -> np.ndarray:
    """Rows of y, u and v for (r, g, b) of full range, from the weights of red and blue in y; u and v lie in -0.5 .. 0.5."""
    y = np.array([red, 1 - red - blue, blue])
    return np.array([y, (np.array([0, 0, 1]) - y) / (2 * (1 - blue)), (np.array([1, 0, 0]) - y) / (2 * (1 - red))])


def apply_matrix(r, g, b, m) -> list[Column]:
    """Three columns from three by a 3 x 3 matrix: of numbers, or of arrays of one length, pixel by pixel."""
    rows = [[float(x) for x in row] for row in m]
    r, g, b = (c if isinstance(c, Column) else F.col(c) for c in (r, g, b))
    pixels = F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))
    weighed = lambda row: lambda p: p["r"] * row[0] + p["g"] * row[1] + p["b"] * row[2]
    return [F.transform(pixels, weighed(row)) for row in rows]


def lookup(px, table: list[float], low: float = 0.0, high: float = 1.0) -> Column:
    """Each value of an array through a table over low .. high, between entries by linear weights; values beyond take the ends."""
    entries, last = F.array(*[F.lit(float(x)) for x in table]), len(table) - 1

    def at(t, v):
        place = F.least(F.greatest((v - low) / (high - low) * last, F.lit(0.0)), F.lit(float(last)))
        i = F.least(F.floor(place), F.lit(last - 1)).cast("int")
        return F.element_at(t, i + 1) * (1 - (place - i)) + F.element_at(t, i + 2) * (place - i)

    return let(entries, lambda t: F.transform(px, lambda v: at(t, v.cast("double"))))


def trilinear(colours: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Colours (..., 3) in 0 .. 1 through a table (n, n, n, 3) by r, g, b, between entries by trilinear weights."""
    place = np.clip(colours, 0, 1) * (np.array(table.shape[:3]) - 1)
    low = np.minimum(place.astype(int), np.array(table.shape[:3]) - 2)
    part = place - low
    out = np.zeros(colours.shape)
    for corner in np.ndindex(2, 2, 2):
        weight = np.prod(np.where(corner, part, 1 - part), -1)
        out += weight[..., None] * table[tuple(np.moveaxis(low + corner, -1, 0))]
    return out


def graded(table: np.ndarray):
    """A pandas UDF of a frame of (r, g, b, r, g, b, ...) in 0 .. 1: through a table of three dimensions, which goes with the function."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def through(px: pd.Series) -> pd.Series:
        return pd.Series([trilinear(np.asarray(v, float).reshape(-1, 3), table).ravel() for v in px])

    return through


def to_420(colours: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Frames (n, h, w, 3) of r, g, b in 0 .. 255, of even sides, as bytes: the plane of y, then u and v of half the sides.

    u and v are means over 2 x 2 pixels, kept around 128. Products and pixels are added from the first
    to the last, one by one: whole levels often lie on halves, where another order rounds another way.
    """
    n, h, w, _ = colours.shape
    r, g, b = np.moveaxis(colours, -1, 0)
    y, u, v = (r * row[0] + g * row[1] + b * row[2] for row in matrix)

    def quarter(c):
        q = c.reshape(n, h // 2, 2, w // 2, 2)
        return ((q[:, :, 0, :, 0] + q[:, :, 0, :, 1] + q[:, :, 1, :, 0] + q[:, :, 1, :, 1]) / 4 + 128.5).reshape(n, -1)

    planes = np.concatenate([y.reshape(n, -1) + 0.5, quarter(u), quarter(v)], 1)
    return np.clip(np.floor(planes), 0, 255).astype(np.uint8)


def from_420(planes: np.ndarray, h: int, w: int, matrix: np.ndarray) -> np.ndarray:
    """The frames of to_420 again, each u and v for its 2 x 2 pixels."""
    n, q = len(planes), h * w // 4
    y = planes[:, : h * w].reshape(n, h, w).astype(float)
    whole = lambda c: (c.reshape(n, h // 2, w // 2).astype(float) - 128).repeat(2, 1).repeat(2, 2)
    yuv = np.stack([y, whole(planes[:, h * w : h * w + q]), whole(planes[:, h * w + q :])], -1)
    return np.clip(np.floor(yuv @ np.linalg.inv(matrix).T + 0.5), 0, 255)


def planar(h: int, w: int):
    """A pandas UDF of the flat r, g and b of a frame (0 .. 255): its bytes in planes of y, u and v, 4:2:0."""
    matrix = yuv_matrix()

    @F.pandas_udf(T.BinaryType())
    def packed(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        made = to_420(np.stack([stack(c, h, w) for c in (r, g, b)], -1), matrix)
        return pd.Series([row.tobytes() for row in made])

    return packed


# --- oriented bands


def band_masks(h: int, w: int, levels: int, orientations: int) -> np.ndarray:
    """Masks over the spectrum of an h x w frame: the high rest, levels x orientations bands, and the low rest.

    Radially a band lies between raised cosines over octaves of the frequency; by angle it follows
    cos ** (orientations - 1) around its direction. The squares of all masks add up to 1 everywhere,
    so masking twice (with the conjugate) and adding gives the frame again.
    """
    fy, fx = 2 * np.pi * np.fft.fftfreq(h)[:, None], 2 * np.pi * np.fft.fftfreq(w)
    radius, angle = np.hypot(fy, fx), np.arctan2(fy, fx)

    def high(k: int) -> np.ndarray:  # from 0 at pi / 2 ** (k + 1) to 1 at pi / 2 ** k
        octave = np.log2(np.maximum(radius, 1e-12) * 2**k / np.pi)
        return np.cos(np.pi / 2 * np.clip(-octave, 0, 1))

    low = lambda k: np.sqrt(np.maximum(0, 1 - high(k) ** 2))
    power = orientations - 1
    scale = 2**power * math.factorial(power) / math.sqrt(orientations * math.factorial(2 * power))
    masks, passed = [high(0).astype(complex)], low(0)
    for k in range(1, levels + 1):
        masks += [(-1j) ** power * scale * np.cos(angle - np.pi * j / orientations) ** power * passed * high(k) for j in range(orientations)]
        passed = passed * low(k)
    return np.array([*masks, passed.astype(complex)])


def bands(frames: np.ndarray, levels: int = 2, orientations: int = 6) -> np.ndarray:
    """(n, bands, h, w): the high rest, the oriented bands from fine to coarse, the low rest; of the frames' own size."""
    masks = band_masks(*frames.shape[1:], levels, orientations)
    return np.fft.ifft2(np.fft.fft2(frames)[:, None] * masks).real


def from_bands(parts: np.ndarray, levels: int = 2, orientations: int = 6) -> np.ndarray:
    """The frames whose bands these are."""
    masks = band_masks(*parts.shape[2:], levels, orientations)
    return np.fft.ifft2((np.fft.fft2(parts) * masks.conj()).sum(1)).real


def band_energy(h: int, w: int, levels: int = 2, orientations: int = 6):
    """A pandas UDF of a frame: the mean square of each of its bands."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def energy(px: pd.Series) -> pd.Series:
        return pd.concat([flat((bands(stack(px[part], h, w), levels, orientations) ** 2).mean((2, 3))) for part in parts(len(px), h * w * (levels * orientations + 2))] or [pd.Series([], dtype=object)], ignore_index=True)

    return energy
