"""Statistics of frames: tiles, equalisation, contrast normalisation and distribution fits."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import blur, doubles, gaussian, let, mean, roll, total, variance, where_pixel


def tiles(df: DataFrame, px: str, h: int, w: int, size: int, pad: int = 0) -> DataFrame:
    """A row for each tile: ty, tx and region, the pixels of the tile and of `pad` pixels around it inside the frame."""
    grid = df.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit((h - 1) // size)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit((w - 1) // size))))
    lo, hi = lambda t: F.col(t) * size - pad, lambda t: F.col(t) * size + size - 1 + pad
    return grid.withColumn("region", where_pixel(doubles(F.col(px)), w, lambda y, x: y.between(lo("ty"), hi("ty")) & x.between(lo("tx"), hi("tx"))))


def equalise(df: DataFrame, frame: str, level: str, levels: int = 256) -> DataFrame:
    """Histogram equalisation: each level of each frame, its count and its new level. One row per frame and level is shuffled."""
    counts = df.groupBy(frame, level).agg(F.count("*").alias("n"))
    w = Window.partitionBy(frame)
    cdf = F.sum("n").over(w.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    low = F.first("n").over(w.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    size = F.sum("n").over(w)
    return counts.withColumn("equalised", F.when(size > low, F.floor((cdf - low) * (levels - 1) / F.nullif(size - low, F.lit(0).cast("long")) + 0.5)).otherwise(F.col(level)).cast("int"))


def mscn(a: Column, h: int, w: int, c: float = 1.0) -> Column:
    """Mean-subtracted contrast-normalised pixels: (x - mu) / (sigma + c) with Gaussian local moments."""
    taps = gaussian()

    def normal(v):
        square = blur(F.transform(v, lambda x: x * x), h, w, taps)
        sigma = lambda mu: F.zip_with(mu, square, lambda m, s: F.sqrt(F.abs(s - m * m)))
        return let(blur(v, h, w, taps), lambda mu: F.zip_with(F.zip_with(v, mu, lambda x, m: x - m), sigma(mu), lambda d, s: d / (s + c)))

    return let(a, normal)


def paired_products(a: Column, h: int, w: int) -> dict[str, Column]:
    """Products of each pixel with its left, upper and two diagonal neighbours, with circular edges."""
    shifts = {"horizontal": (0, 1), "vertical": (1, 0), "diagonal": (1, 1), "antidiagonal": (1, -1)}
    return {k: F.zip_with(roll(a, h, w, *s), a, lambda x, y: x * y) for k, s in shifts.items()}


def ssim(a: Column, b: Column, peak: float = 1.0) -> Column:
    """Structural similarity of two thumbnails as one window; its constants are (0.01 peak)² and (0.03 peak)²."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2

    def of(m):
        cov = m["ab"] - m["a"] * m["b"]
        return (2 * m["a"] * m["b"] + c1) * (2 * cov + c2) / ((m["a"] * m["a"] + m["b"] * m["b"] + c1) * (m["va"] + m["vb"] + c2))

    moments = F.struct(mean(a).alias("a"), mean(b).alias("b"), mean(F.zip_with(a, b, lambda x, y: x * y)).alias("ab"), variance(a).alias("va"), variance(b).alias("vb"))
    return let(moments, of)


def scale_bucket(similarity: Column) -> Column:
    """1, 0.5 or 0.25 for a dissimilarity below 1, 2 or more per cent."""
    d = (1 - similarity) * 100
    return F.when(d < 1, 1.0).when(d < 2, 0.5).otherwise(0.25)


@functools.lru_cache(maxsize=1)
def shape_table() -> tuple[np.ndarray, np.ndarray]:
    """Shapes 0.2, 0.201, ... below 10, and the ratio Γ(2/g)² / (Γ(1/g) Γ(3/g)), which grows with g."""
    g = np.arange(0.2, 10, 0.001)
    return g, np.array([math.exp(2 * math.lgamma(2 / x) - math.lgamma(1 / x) - math.lgamma(3 / x)) for x in g])


def _nearest(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of the value nearest to each x; of two, the first."""
    hi = np.clip(np.searchsorted(sorted_values, x), 1, len(sorted_values) - 1)
    return np.where(np.abs(sorted_values[hi - 1] - x) <= np.abs(sorted_values[hi] - x), hi - 1, hi)


@F.pandas_udf(T.DoubleType())
def _ggd_shape(rho: pd.Series) -> pd.Series:
    g, ratio = shape_table()
    x = np.where(np.isfinite(rho), rho, np.inf)
    return pd.Series(g[len(g) - 1 - _nearest((1 / ratio)[::-1], x)])


@functools.lru_cache(maxsize=1)
def _gammas() -> np.ndarray:
    """Γ(k / g) for k = 1, 2, 3 at each shape of the table."""
    return np.array([[math.gamma(k / x) for x in shape_table()[0]] for k in (1, 2, 3)])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("alpha", "g1", "g2", "g3")]))
def _aggd_shape(r: pd.Series) -> pd.DataFrame:
    g, ratio = shape_table()
    at = _nearest(ratio, np.where(np.isfinite(r), r, np.inf))
    return pd.DataFrame({"alpha": g[at], **{f"g{k + 1}": row[at] for k, row in enumerate(_gammas())}})


def ggd_fit(df: DataFrame, px: str) -> DataFrame:
    """Adds ggd_shape and ggd_variance of a generalised Gaussian by its moments."""
    a = doubles(F.col(px))
    spread = mean(F.transform(a, F.abs))
    return df.withColumn("ggd_variance", variance(a)).withColumn("ggd_shape", _ggd_shape(F.coalesce(F.col("ggd_variance") / F.nullif(spread * spread, F.lit(0.0)), F.lit(float("inf")))))


def aggd_fit(df: DataFrame, px: str) -> DataFrame:
    """Adds alpha, bias, left, right (scales) and left_rms, right_rms of an asymmetric generalised Gaussian."""
    a = doubles(F.col(px))
    rms = lambda side: F.sqrt(F.coalesce(mean(F.transform(side, lambda x: x * x)), F.lit(0.0)))
    out = df.withColumn("left_rms", rms(F.filter(a, lambda x: x < 0))).withColumn("right_rms", rms(F.filter(a, lambda x: x >= 0)))
    g = F.col("left_rms") / F.nullif(F.col("right_rms"), F.lit(0.0))
    r = F.pow(total(F.transform(a, F.abs)) / F.size(a), F.lit(2.0)) / F.nullif(mean(F.transform(a, lambda x: x * x)), F.lit(0.0))
    norm = r * (F.pow(g, F.lit(3.0)) + 1) * (g + 1) / F.pow(g * g + 1, F.lit(2.0))
    out = out.withColumn("__f", _aggd_shape(F.coalesce(norm, F.lit(float("inf"))))).withColumn("alpha", F.col("__f.alpha"))
    scale = F.sqrt("__f.g1") / F.sqrt("__f.g3")
    out = out.withColumn("left", scale * F.col("left_rms")).withColumn("right", scale * F.col("right_rms"))
    return out.withColumn("bias", (F.col("right") - F.col("left")) * F.col("__f.g2") / F.col("__f.g1")).drop("__f")


def luma_proxy(h: int, w: int, most: int = 300, levels: int = 256):
    """A pandas UDF of a frame of levels (0 to levels - 1): every 2nd pixel of both axes (4th above 1000 rows), at most `most` of each, equalised."""
    stride = 4 if h > 1000 else 2

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def proxy(px: pd.Series) -> pd.Series:
        out = []
        for v in px:
            if v is None:
                out.append(None)
                continue
            part = np.asarray(v).reshape(h, w)[::stride, ::stride][:most, :most]
            cdf = np.bincount(part.ravel(), minlength=levels).cumsum()
            low, size = cdf[cdf > 0][0], part.size
            out.append((part if size == low else np.floor((cdf[part] - low) * (levels - 1) / (size - low) + 0.5)).astype(int).ravel().tolist())
        return pd.Series(out)

    return proxy


def proxy_distance(a, b) -> Column:
    """Mean absolute difference of two proxies; 0 at once where all their samples are equal."""
    return F.when(a == b, 0.0).otherwise(mean(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))))
