"""Divisive normalisation: each pixel by how usual its neighbourhood is among all of its group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.motion import flat, stack

#: Fixed value of the rule: what squared deviations are divided by at the finest level.
FREEDOM = 10.0


def neighbourhoods(frames: np.ndarray) -> np.ndarray:
    """(n, (h - 2) * (w - 2), 9): the 3 x 3 pixels around each inner pixel, in rows."""
    n, h, w = frames.shape
    return np.stack([frames[:, i : i + h - 2, j : j + w - 2].reshape(n, -1) for i in range(3) for j in range(3)], -1)


def neighbour_covariance(df: DataFrame, key: str, px: str, h: int, w: int) -> DataFrame:
    """key, i, j, cov: the sample covariance of places i and j (0 to 8) of all 3 x 3 neighbourhoods of a key's frames.

    Tasks give sums of products alone, 81 numbers for each key of a batch, whatever its frames.
    """
    schema = T.StructType([df.schema[key], *[T.StructField(c, T.IntegerType()) for c in ("i", "j")], *[T.StructField(c, T.DoubleType()) for c in ("n", "a", "b", "ab")]])
    i, j = (x.ravel() for x in np.indices((9, 9)))

    def run(batches):
        for batch in batches:
            for _, rows in batch.groupby(key, dropna=False):
                y = neighbourhoods(stack(rows[px], h, w)).reshape(-1, 9)
                total, gram = y.sum(0), y.T @ y
                yield pd.DataFrame({key: [rows[key].iloc[0]] * 81, "i": i, "j": j, "n": float(len(y)), "a": total[i], "b": total[j], "ab": gram[i, j]})

    sums = df.select(key, px).mapInPandas(run, schema).groupBy(key, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")])
    return sums.select(key, "i", "j", F.when(F.col("n") > 1, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def pseudo_inverse(cov: np.ndarray) -> np.ndarray:
    """The inverse of a covariance without its negative eigenvalues and those near 0."""
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    kept = value > 1e-12 * max(value.max(), 0)
    return (vector[:, kept] / value[kept]) @ vector[:, kept].T


def normalised(frames: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """(n, (h - 2) * (w - 2)): inner pixels less their frame's mean, each divided by its neighbourhood's length under `inverse`; 0 where that is 0."""
    y = neighbourhoods(frames)
    length = np.sqrt(np.maximum(np.einsum("npi,ij,npj->np", y, inverse, y), 0) / FREEDOM)
    centre = y[..., 4] - y[..., 4].mean(1, keepdims=True)
    out = np.divide(centre, length, out=np.zeros_like(centre), where=length > 0)
    return out - out.mean(1, keepdims=True)


def divisive_normalise(df: DataFrame, key: str, px: str, h: int, w: int, out: str = "normalised") -> DataFrame:
    """Adds out: the frame's inner pixels, normalised by the covariance of all frames of its key.

    The 9 x 9 matrices are inverted in a row for each key and joined back by it.
    """
    table = neighbour_covariance(df, key, px, h, w).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda x: x["cov"]).alias("__cov"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def inverse(cov: pd.Series) -> pd.Series:
        return pd.Series([pseudo_inverse(np.nan_to_num(np.array(c, float)).reshape(9, 9)).ravel() for c in cov])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(px: pd.Series, inv: pd.Series) -> pd.Series:
        made, matrices = pd.Series([None] * len(px), dtype=object), inv.map(lambda m: np.asarray(m, float).tobytes())
        for matrix, rows in matrices.groupby(matrices).groups.items():
            found = normalised(stack(px[rows], h, w), np.frombuffer(matrix).reshape(9, 9))
            made[rows] = flat(found).tolist()
        return made

    ready = table.select(F.col(key).alias("__key"), inverse("__cov").alias("__inv"))
    return df.join(ready, F.col(key).eqNullSafe(F.col("__key"))).withColumn(out, apply(px, "__inv")).drop("__key", "__inv")
