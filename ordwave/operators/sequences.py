"""Ordered sequences in bounded blocks.

A sequence is the rows with one key, in the order of an integer column. One sequence may hold a large
share of all rows, so no window here spans a whole sequence: rows get dense positions by counting
within slices of the order, and windows run over blocks of positions that carry copies of the rows
just before or after them. A state with few values is carried through a sequence by composing each
block's map from state to state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows in a block of windows, and rows or blocks whose state maps are composed in one array.
BLOCK, FAN = 1 << 16, 256


def positions(df: DataFrame, seq: str, order: str | list[str], width: int | None = BLOCK) -> DataFrame:
    """Adds pos, the place of each row in its sequence from 0.

    `order` is an integer column, or a list of one and of columns that break its ties; together they
    should tell all rows of a sequence apart, so that places are the same whenever they are computed.
    Rows are numbered within slices of `width` values of the integer, which should hold many rows
    each; the rows of earlier slices are added from a table with one row per slice. For an order that
    is not dense, such as a time stamp, `width` None looks at its range and number of rows first, so
    that slices hold about BLOCK rows of the table. Rows with a null key or integer are left out.
    """
    first, *ties = [order] if isinstance(order, str) else order
    width = width or slice_width(df, first)
    sliced = df.where(F.col(seq).isNotNull() & F.col(first).isNotNull()).withColumn("__slice", F.floor(F.col(first) / width))
    earlier = Window.partitionBy(seq).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy(seq, "__slice").agg(F.count("*").alias("n")).select(seq, "__slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(seq, "__slice").orderBy(first, *ties)) - 1
    return sliced.withColumn("__nth", nth).join(before, [seq, "__slice"]).withColumn("pos", F.col("__before") + F.col("__nth")).drop("__slice", "__nth", "__before")


def in_blocks(placed: DataFrame, before: int = 0, after: int = 0, rows: int = BLOCK) -> DataFrame:
    """Adds block, and own: false on the copies of `before` and `after` neighbouring rows of a block."""
    rows = max(rows, before, after)
    block, within = F.floor(F.col("pos") / rows), F.pmod(F.col("pos"), F.lit(rows))
    homes = F.filter(F.array(block, F.when(within >= rows - before, block + 1), F.when((within < after) & (block > 0), block - 1)), lambda b: b.isNotNull())
    return placed.withColumn("block", F.explode(homes)).withColumn("own", F.col("block") == block)


def block_window(seq: str) -> Window:
    return Window.partitionBy(seq, "block").orderBy("pos")


def with_neighbour(placed: DataFrame, seq: str, value: str, out: str, step: int = -1, rows: int = BLOCK) -> DataFrame:
    """Adds out: the value `-step` rows before (step < 0) or `step` rows after; null beyond the ends."""
    near = F.lag(value, -step) if step < 0 else F.lead(value, step)
    found = in_blocks(placed, before=max(0, -step), after=max(0, step), rows=rows).withColumn(out, near.over(block_window(seq)))
    return found.where("own").drop("block", "own")


def running_sum(placed: DataFrame, seq: str, value: Column, out: str, rows: int = BLOCK) -> DataFrame:
    """Adds out: the sum of `value` over the rows before this one in the sequence; nulls add nothing."""
    b = in_blocks(placed.withColumn("__value", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), rows=rows)
    earlier = Window.partitionBy(seq).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(seq, "block").agg(F.sum("__value").alias("n")).select(seq, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__value").over(block_window(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("__inside", inside).join(sums, [seq, "block"]).withColumn(out, F.col("__before") + F.col("__inside")).drop("block", "own", "__value", "__inside", "__before")


def running_count(placed: DataFrame, seq: str, flag: Column, out: str, rows: int = BLOCK) -> DataFrame:
    """Adds out: how many rows before this one in the sequence have the flag."""
    return running_sum(placed, seq, F.coalesce(flag, F.lit(False)), out, rows)


def slice_width(df: DataFrame, order: str, rows: int = BLOCK) -> int:
    """How many values of the integer `order` hold about `rows` rows of the table: a width for positions() where values are not dense."""
    n, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    return max(1, (int(high) - int(low) + 1) * rows // n) if n else rows


def value_at(placed: DataFrame, seq: str, value: str, share: float) -> DataFrame:
    """seq and value: the exact `share` quantile of the values of placed(seq, pos in the order of the values), between two by linear weights."""
    n = placed.groupBy(seq).agg(F.count("*").alias("__n"))
    at = (F.col("__n") - 1) * F.lit(float(share))
    near = placed.join(n, seq).where(F.col("pos").between(F.floor(at), F.ceil(at)))
    part = at - F.floor(at)
    low, high = F.min_by(value, "pos"), F.max_by(value, "pos")
    return near.groupBy(seq).agg((low * (1 - F.first(part)) + high * F.first(part)).alias(value))


def _gathered(maps: DataFrame, seq: str) -> DataFrame:
    """(seq, up, items): items of `up`'s FAN places in order, each with its place and state map."""
    rest = [c for c in maps.columns if c != seq]
    return maps.groupBy(seq, F.floor(F.col("at") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", *[c for c in rest if c != "at"]))).alias("items"))


def _scan(maps: DataFrame, seq: str, states: int, most: int) -> DataFrame:
    """Adds entry, the state before each place, to maps(seq, at, next, ...); places count from 0."""
    groups = _gathered(maps, seq)
    if most < FAN:
        entered = groups.withColumn("entry", F.lit(0))
    else:
        identity = F.array(*[F.lit(s) for s in range(states)])
        composed = groups.select(seq, F.col("up").alias("at"), F.aggregate("items", identity, lambda m, x: F.transform(m, lambda s: F.element_at(x["next"], s + 1))).alias("next"))
        above = _scan(written(composed) if most // FAN >= FAN else composed, seq, states, most // FAN).select(seq, F.col("at").alias("up"), "entry")
        entered = groups.join(above, [seq, "up"])
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(x["next"], F.element_at(acc, -1) + 1)))
    passed = entered.withColumn("entries", F.aggregate("items", F.array("entry"), step))
    return passed.select(seq, F.posexplode("items").alias("i", "x"), "entries").select(seq, "x.*", F.col("entries")[F.col("i")].alias("entry"))


def carry_state(placed: DataFrame, seq: str, states: int, next_state: Column, keep: list[str]) -> DataFrame:
    """Runs a machine with `states` states (from 0, starting in 0) through each sequence.

    next_state is an array column: the state after the row for each state before it. Returns seq,
    pos, the columns in `keep`, entry (the state before the row) and state (after it). FAN rows at
    most are gathered in an array, then FAN of their composed maps, and so on; nothing gathers a sequence.
    """
    maps = placed.select(seq, F.col("pos").alias("at"), next_state.alias("next"), *keep)
    maps = written(maps)  # it is read on the way up and down, and for the number of levels
    most = maps.agg(F.max("at")).first()[0] or 0
    return _scan(maps, seq, states, most).select(seq, F.col("at").alias("pos"), *keep, "entry", F.element_at("next", F.col("entry") + 1).alias("state"))
