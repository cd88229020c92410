"""Resampling onto a grid and rows made between neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import with_neighbour


def resample_locf(df: DataFrame, seq: str, time: str, step: int, columns: list[str], slice_steps: int = 4096) -> DataFrame:
    """A row every `step` of the integer time of each sequence, with the last columns seen by then.

    The grid begins at the multiple of step at or before the sequence's first row. Work is dealt
    by sequence and time slice; what holds at a slice's start comes from a table of each slice's last row.
    Rows with a null sequence or time are left out; of rows with one time, the largest columns count.
    """
    span = step * slice_steps
    known = df.where(F.col(seq).isNotNull() & F.col(time).isNotNull()).select(seq, F.col(time).alias("t"), F.struct(F.lit(True).alias("here"), *columns).alias("v"))
    cut = lambda c: F.floor(c / span)
    last = known.groupBy(seq, cut(F.col("t")).alias("slice")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max_by("v", F.struct("t", "v")).alias("v"))
    w = Window.partitionBy(seq)
    bounds = last.groupBy(seq).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    slices = bounds.select(seq, "lo", "hi", F.explode(F.sequence(cut(F.col("lo") - F.pmod(F.col("lo"), F.lit(step))), cut(F.col("hi")))).alias("slice"))
    held = slices.join(last.select(seq, "slice", "v"), [seq, "slice"], "left").withColumn("held", F.last("v", ignorenulls=True).over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.greatest(F.col("slice") * span, F.col("lo") - F.pmod(F.col("lo"), F.lit(step)))
    end = F.least((F.col("slice") + 1) * span - 1, F.col("hi"))
    grid = held.where(begin <= end).select(seq, "slice", "held", F.explode(F.sequence(begin + F.pmod(-begin, F.lit(step)), end, F.lit(step))).alias("t"))
    both = grid.select(seq, "slice", "t", F.lit(1).alias("grid"), F.lit(None).cast(known.schema["v"].dataType).alias("v"), "held").unionByName(known.select(seq, cut(F.col("t")).alias("slice"), "t", F.lit(0).alias("grid"), "v", F.lit(None).cast(known.schema["v"].dataType).alias("held")))
    here = F.last("v", ignorenulls=True).over(Window.partitionBy(seq, "slice").orderBy("t", "grid", "v").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("now", F.coalesce(here, "held")).where("grid = 1").select(seq, F.col("t").alias(time), *[F.col(f"now.{c}").alias(c) for c in columns])


def linear(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def linear_arrays(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * (1 - t) + y.cast("double") * t)


def bisect_times(n: int) -> list[float]:
    """Times of n rows made by repeated halving; the middle of a span is one of them where its number is odd."""
    if n < 1:
        return []
    half = bisect_times(n // 2)
    return [t / 2 for t in half] + [0.5] * (n % 2) + [0.5 + t / 2 for t in half]


def fill(placed: DataFrame, seq: str, value: str, n: Column, blend: Callable[[Column, Column, Column], Column] = linear, times: list[list[float]] | None = None, pure: Column | None = None, long: int = 20) -> DataFrame:
    """Each row (sub_no 0), then n rows between it and the next (sub_no 1 to n): value at time t.

    t is sub_no / (n + 1), or the times listed for each n. The last row of a sequence has no next;
    its value is repeated. Rows come to 1 + n for every row. `blend` may be any function of columns,
    so also a pandas UDF over a model. Where more than `long` rows follow a `pure` one, they repeat it.
    """
    ahead = with_neighbour(placed.withColumn("__n", n.cast("int")).withColumn("__same", F.lit(False) if pure is None else (F.col("__n") > long) & F.coalesce(pure, F.lit(False))), seq, value, "__next", step=1).withColumn("__next", F.coalesce("__next", value))
    rows = ahead.withColumn("sub_no", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    if times is None:
        t = F.col("sub_no") / (F.col("__n") + 1)
    else:
        table = F.array(*[F.array(*[F.lit(x) for x in (0.0, *ts)]) for ts in times])
        t = F.element_at(F.element_at(table, F.col("__n") + 1), F.col("sub_no") + 1)
    filled = rows.withColumn("t", t.cast("double"))
    return filled.withColumn(value, F.when((F.col("sub_no") == 0) | F.col("__same"), F.col(value)).otherwise(blend(F.col(value), F.col("__next"), F.col("t")))).drop("__n", "__next", "__same")


def fill_with(placed: DataFrame, seq: str, value: str, n: Column, generate: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """As fill, with a model that makes all rows between two at once: generate(a, b, n) gives n rows for each pair of a batch.

    a and b hold the values of the batch's pairs with this n, one pair a row (numbers, or arrays as
    a second axis); the result has an axis of n after that of the pairs. It runs in Arrow batches
    inside tasks, and is loaded there. Returns seq, pos, sub_no, value.
    """
    kind = placed.schema[value].dataType
    ahead = with_neighbour(placed.select(seq, "pos", value, n.cast("int").alias("__n")), seq, value, "__next", step=1).withColumn("__next", F.coalesce("__next", value))
    schema = T.StructType([placed.schema[seq], T.StructField("pos", T.LongType()), T.StructField("sub_no", T.IntegerType()), T.StructField(value, kind)])

    def run(batches):
        for batch in batches:
            parts = [batch[[seq, "pos", value]].assign(sub_no=0)]
            for count, rows in batch[batch["__n"] > 0].groupby("__n"):
                made = np.asarray(generate(np.array(rows[value].tolist()), np.array(rows["__next"].tolist()), int(count)))
                for k in range(int(count)):
                    parts.append(rows[[seq, "pos"]].assign(**{value: list(made[:, k]), "sub_no": k + 1}))
            yield pd.concat(parts)[[seq, "pos", "sub_no", value]]

    return ahead.mapInPandas(run, schema)


def following(runs: DataFrame, seq: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the run after each of runs(seq, run, n, ...), null after a sequence's last.

    A run's rows lie at run .. run + n, so the next one begins at run + n + 1: it is found by that key,
    without places or windows.
    """
    after = runs.select(F.col(seq).alias("__seq"), F.col("run").alias("__run"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return runs.join(after, (F.col(seq) == F.col("__seq")) & (F.col("run") + F.col("n") + 1 == F.col("__run")), "left").drop("__seq", "__run")


def fill_runs(runs: DataFrame, seq: str, value: str, blend: Callable[[Column, Column, Column], Column] = linear) -> DataFrame:
    """Each run's anchor (sub_no 0) and a row for each that it absorbed, blended towards the next anchor; a sequence's last run repeats its own."""
    rows = following(runs, seq, [value]).withColumn("sub_no", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    made = blend(F.col(value), F.coalesce(f"next_{value}", value), F.col("sub_no") / (F.col("n") + 1))
    return rows.withColumn(value, F.when(F.col("sub_no") == 0, F.col(value)).otherwise(made)).drop(f"next_{value}")


def fill_scenes(runs: DataFrame, seq: str, value: str, mix: bool = False, blend: Callable[[Column, Column, Column], Column] = linear) -> DataFrame:
    """Fills the gaps of runs(seq, run, n, first, last, value, scene), as many rows out as the runs had, without blending across scenes.

    A run has its anchor's value, the n rows that it absorbed, and the values of the first and last of
    them; its rows lie at run .. run + n. Rows between two anchors of one scene are blended. A run
    before a scene (the next run's `scene` is true) ends on its first absorbed row instead: the rows
    between are blended from its anchor to that row, which is repeated as it is; with `mix` they fade
    into the scene's first row. The last run of a sequence leads to its last absorbed row.
    """
    rows = following(runs, seq, [value, "scene"]).withColumn("sub_no", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    ahead, held = F.col(f"next_{value}"), F.coalesce("next_scene", F.lit(False)) & F.lit(not mix)
    target = F.when(ahead.isNull(), F.col("last")).when(held, F.col("first")).otherwise(ahead)
    steps = F.when(ahead.isNotNull() & held, F.greatest("n", F.lit(1))).otherwise(F.col("n") + 1)
    made = blend(F.col(value), F.col("__target"), F.col("sub_no") / F.col("__steps"))
    filled = rows.withColumn("__target", target).withColumn("__steps", steps.cast("double")).withColumn(value, F.when(F.col("sub_no") == 0, F.col(value)).otherwise(made))
    return filled.drop(f"next_{value}", "next_scene", "__target", "__steps")
