"""Runs of near-equal rows: anchors with a run cap, and held drawings of a few rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import BLOCK, block_window, carry_state, in_blocks


def dedup_anchor(placed: DataFrame, seq: str, value: str, threshold: float, cap: int, keep: list[str], rows: int = BLOCK, scene: str | None = None) -> DataFrame:
    """Each row's distance in rows from its run's anchor: `absorbed`, 0 on anchors, which are the rows kept.

    A row joins the run while it differs from the anchor by less than the threshold and the run has
    absorbed fewer than `cap` rows; else it is the next anchor. The anchor lies at most `cap` rows
    back, so a sequence is a machine with cap + 1 states and needs no pass over it in one task.
    A null value equals nothing. Where a `scene` column is true a run ends whatever the distance, and
    the row is an anchor. Returns seq, pos, the columns in `keep`, absorbed and kept.
    """
    w = block_window(seq)
    near = [F.coalesce(F.abs(F.col(value) - F.lag(value, k + 1).over(w)) < threshold, F.lit(False)) for k in range(cap)]
    if scene:  # a run that reaches back across a scene's first row has ended there already
        near = [n & ~F.coalesce(F.col(scene), F.lit(False)) for n in near]
    after = F.array(*[F.when(n, k + 1).otherwise(0) for k, n in enumerate(near)], F.lit(0))
    seen = in_blocks(placed, before=cap, rows=rows).withColumn("__next", after).where("own")
    return carry_state(seen, seq, cap + 1, F.col("__next"), keep).withColumn("absorbed", F.col("state")).withColumn("kept", F.col("state") == 0).drop("entry", "state")


def held_windows(placed: DataFrame, seq: str, value: str, q: int, rows: int = BLOCK) -> DataFrame:
    """Adds is_hit: whether the q rows from here on look like one drawing held between two others.

    Every pair of inner rows must be nearer to each other than the first row is to the pair's
    earlier and the last row to its later one. Windows start at position 1 or later and end in the sequence.
    """
    w = block_window(seq)
    at = [F.lead(value, k).over(w) if k else F.col(value) for k in range(q)]
    hit = F.lit(True)
    for i in range(1, q - 2):
        for j in range(i + 1, q - 1):
            d = F.abs(at[i] - at[j])
            hit = hit & (d < F.abs(at[0] - at[i])) & (d < F.abs(at[j] - at[q - 1]))
    found = in_blocks(placed, after=q - 1, rows=rows).withColumn("is_hit", F.coalesce(hit & (F.col("pos") >= 1), F.lit(False)))
    return found.where("own").drop("block", "own")


def held_hits(x: np.ndarray, end: np.ndarray, q: int) -> np.ndarray:
    """Places at which q values, all before their batch's end, look like one drawing held between two others."""
    if len(x) < q:
        return np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(x, q).T
    hit = np.arange(len(x) - q + 1) + q <= end[: len(x) - q + 1]
    for i in range(1, q - 2):
        for j in range(i + 1, q - 1):
            d = np.abs(at[i] - at[j])
            hit &= (d < np.abs(at[0] - at[i])) & (d < np.abs(at[j] - at[q - 1]))
    return np.flatnonzero(hit)


def dropped_in_batches(x: np.ndarray, scene: np.ndarray, begin: np.ndarray, mode: int) -> np.ndarray:
    """Which rows the held-drawing rule drops, for windows of 4 to mode + 2 rows; `begin` has the first place of each row's batch.

    Windows of one length are taken from left to right, past those that they hit; a window that begins
    on a row that a shorter one dropped drops nothing.
    """
    n = len(x)
    starts = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]]) if n else np.zeros(0, np.int64)
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) if n else begin
    gone = np.zeros(n, bool)
    for q in range(4, mode + 3):
        free, taken = -1, []
        for h in held_hits(x, end, q).tolist():
            if h > begin[h] and h >= free:  # hits of one batch never bar those of the next: windows end in their batch
                free = h + q - 2
                if not gone[h]:
                    taken.append(h)
        for h in taken:
            gone[h + 1 : h + q - 2] = True
    return gone & ~scene & (np.arange(n) != begin) & (np.arange(n) != end - 1)


def dedup_held(placed: DataFrame, seq: str, value: str, scene: str, mode: int = 2, queue: int = 18, batch: int | None = None, tasks: int | None = None) -> DataFrame:
    """seq, pos, value and kept: held drawings are searched in batches of a sequence, of `batch` or else max(queue, 200) rows.

    A batch's first and last row and scene rows stay; windows do not cross batches. Tasks hold many
    batches in order and work on all of an Arrow batch at once; a window with a null value is no hit.
    """
    batch = batch or max(queue, 200)
    schema = T.StructType([placed.schema[seq], T.StructField("pos", T.LongType()), T.StructField(value, T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(parts):
        held = None  # the last batch so far: more of its rows may follow
        for part in _then_none(parts):
            if part is None:
                rows = held
            else:
                rows = part if held is None else pd.concat([held, part], ignore_index=True)
                last = (rows[seq] == rows[seq].iloc[-1]) & (rows["batch"] == rows["batch"].iloc[-1])
                held, rows = rows[last], rows[~last]
            if rows is None or not len(rows):
                continue
            names = pd.factorize(rows[seq])[0]
            new = np.r_[True, (names[1:] != names[:-1]) | (rows["batch"].to_numpy()[1:] != rows["batch"].to_numpy()[:-1])]
            begin = np.flatnonzero(new)[np.cumsum(new) - 1]
            gone = dropped_in_batches(rows[value].to_numpy(float), rows[scene].to_numpy(bool), begin, mode)
            yield rows[[seq, "pos", value]].assign(kept=~gone)

    tasks = tasks or int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.select(seq, "pos", F.col(value).cast("double").alias(value), F.coalesce(F.col(scene), F.lit(False)).alias(scene), F.floor(F.col("pos") / batch).alias("batch"))
    return rows.repartition(tasks, seq, "batch").sortWithinPartitions(seq, "batch", "pos").mapInPandas(run, schema)


def _then_none(parts):
    yield from parts
    yield None
