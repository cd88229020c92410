"""Distances of neighbours, scene scores and scene labels."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import BLOCK, block_window, carry_state, in_blocks, positions, running_count, with_neighbour

#: Fixed values of the labeller: a distance below EQUAL is none, one above HARD is a cut by itself, a soft cut needs BORN.
EQUAL, HARD, BORN = 0.001, 80.0, 2.0


def pair_distance(df: DataFrame, seq: str, order: str | list[str], value: str, distance, out: str = "diff", rows: int = BLOCK, width: int = BLOCK) -> DataFrame:
    """Adds pos, prev (the value of the row before) and out, their distance; both null on a sequence's first row.

    `order` and `width` are those of positions().
    """
    placed = with_neighbour(positions(df, seq, order, width), seq, value, "prev", rows=rows)
    return placed.withColumn(out, F.when(F.col("prev").isNotNull(), distance(F.col("prev"), F.col(value))))


def scene_score(measured: DataFrame, seq: str, diff: str, length: int, rows: int = BLOCK) -> DataFrame:
    """Adds score and delta, its change from the row before, from the last `length` distances.

    score = (var_pop(d) * (1 + r2(d over position))) ** 0.65; 0 with fewer than two distances.
    """
    w = block_window(seq)
    last = w.rowsBetween(-(length - 1), 0)
    pos = F.col("pos").cast("double")
    spread = F.var_pop(diff).over(last) * (1 + F.coalesce(F.regr_r2(F.col(diff), pos).over(last), F.lit(0.0)))
    score = F.when(F.count(diff).over(last) < 2, 0.0).otherwise(F.pow(F.greatest(spread, F.lit(0.0)), F.lit(0.65)))
    scored = in_blocks(measured, before=length + 1, rows=rows).withColumn("score", score)
    return scored.withColumn("delta", F.col("score") - F.lag("score").over(w)).where("own").drop("block", "own")


@dataclass
class SceneState:
    """The labeller of one sequence: its last distances, and whether a black run is pending.

    `fixed` makes it label by that distance alone, `disabled` label nothing.
    """

    length: int
    threshold: float
    fixed: float | None = None
    disabled: bool = False
    black: bool = False
    diffs: deque = field(default_factory=deque)
    known: float | None = None  # the spread of the last distances, where it was found before

    def spread(self) -> float:
        n = len(self.diffs)
        if n < 2:
            return 0.0
        my, mx = sum(self.diffs) / n, (n - 1) / 2
        syy = sum((d - my) ** 2 for d in self.diffs)
        sxy = sum((i - mx) * (d - my) for i, d in enumerate(self.diffs))
        sxx = n * (n * n - 1) / 12
        return (syy / n * (1 + (sxy * sxy / (sxx * syy) if syy else 0.0))) ** 0.65

    def step(self, diff: float | None, pure: bool, only_learn: bool = False, replace_last: bool = False) -> bool:
        """Whether a scene begins with a row at this distance from the one before; none does at an unknown distance.

        `only_learn` takes the distance into the queue without judging it, though hard cuts and ends of
        black runs count; `replace_last` judges it in place of the last one in a full queue.
        """
        if self.disabled or diff is None:
            return False
        if self.fixed is not None:
            return diff >= self.fixed
        if diff < EQUAL:
            self.black |= pure
            return False
        if self.black:
            self.black = False
            return True
        if diff > HARD:
            self.diffs.clear()
            self.known = None
            return True
        if len(self.diffs) < self.length or only_learn:
            if diff not in self.diffs:
                self.diffs.append(diff)
                self.known = None
            return False
        if replace_last:
            self.diffs.pop()
            self.known = None
            if not self.diffs:
                return False
        before = self.spread() if self.known is None else self.known
        self.diffs.append(diff)
        while len(self.diffs) > self.length:
            self.diffs.popleft()
        self.known = self.spread()
        if self.known - before > self.threshold and diff > BORN:
            self.diffs.clear()
            self.known = None
            return True
        return False


def scene_adaptive(measured: DataFrame, seq: str, diff: str, pure: Column, length: int = 18, threshold: float = 12.0, tasks: int | None = None, fixed: float | None = None, disabled: bool = False) -> DataFrame:
    """seq, pos, diff and is_scene by the adaptive labeller; a first row (null distance) begins no scene.

    `fixed` labels by that distance alone, `disabled` labels nothing; neither looks back.

    Every hard cut outside a pending black run empties the labeller, so a sequence is dealt to
    tasks in segments between such cuts. Tasks read their segments as streams and hold `length`
    distances. A sequence without hard cuts is one segment: its labels depend on all rows before.
    """
    if disabled or fixed is not None:
        flag = F.lit(False) if disabled else F.coalesce(F.col(diff) >= fixed, F.lit(False))
        return measured.select(seq, "pos", F.col(diff).cast("double").alias("diff"), flag.alias("is_scene"))
    known = F.coalesce(F.col(diff), F.lit(0.0))
    rows = measured.select(seq, "pos", F.col(diff).alias("diff"), F.when(F.col(diff).isNull(), 2).when(known < EQUAL, F.when(pure, 1).otherwise(2)).otherwise(0).alias("kind"))
    # state: a black run is pending. kind 1 makes it so, 2 leaves it, 0 ends it
    after = F.when(F.col("kind") == 1, F.array(F.lit(1), F.lit(1))).when(F.col("kind") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    pending = carry_state(rows, seq, 2, after, ["diff", "kind"])
    cut = running_count(pending.drop("state"), seq, (F.col("diff") > HARD) & (F.col("entry") == 0), "segment")
    schema = T.StructType([measured.schema[seq], T.StructField("pos", T.LongType()), T.StructField("diff", T.DoubleType()), T.StructField("is_scene", T.BooleanType())])

    def label(batches):
        at, state = None, None
        for b in batches:
            out = []
            for key, segment, d, kind, entry in zip(b[seq], b["segment"], b["diff"], b["kind"], b["entry"]):
                if (key, segment) != at:
                    at, state = (key, segment), SceneState(length, threshold, black=bool(entry))
                out.append(state.step(None if pd.isna(d) else d, kind == 1))
            yield pd.DataFrame({seq: b[seq], "pos": b["pos"], "diff": b["diff"], "is_scene": out})

    tasks = tasks or int(measured.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, seq, "segment").sortWithinPartitions(seq, "segment", "pos").mapInPandas(label, schema)
