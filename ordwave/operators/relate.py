"""Joins between readers, streams and pieces, and work that is done once for equal content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_scan(check: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a coarse reader with the rows of the full one at the same place; rows that the full one lacks are left out."""
    return check.join(full, keys)


def symmetric_lookup(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with what is known of them in either order; of several, the one in the pair's own order, then the smallest."""
    kept = [c for c in known.columns if c not in (a, b)]
    keyed = known.groupBy(F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi")).agg(*[F.min(F.when(F.col(a) <= F.col(b), F.struct(*kept))).alias("up"), F.min(F.when(F.col(a) > F.col(b), F.struct(*kept))).alias("down")])
    found = pairs.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b)).join(keyed, ["__lo", "__hi"], "left")
    best = F.when(F.col(a) <= F.col(b), F.coalesce("up", "down")).otherwise(F.coalesce("down", "up"))
    return found.withColumn("__best", best).select(*pairs.columns, *[F.col(f"__best.{c}").alias(c) for c in kept])


def mux(main: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each row of the main stream with the row of every other stream at its place, or nulls; other columns take the stream's name as prefix."""
    out = main
    for name, stream in others.items():
        out = out.join(stream.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in stream.columns if c not in keys]), keys, "left")
    return out


def zip_pieces(pieces: DataFrame, keys: list[str], piece: str, value: str) -> DataFrame:
    """The values of each key's pieces as one array in the order of the pieces. A key has few pieces: the tiles of one frame."""
    return pieces.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(piece, value))), lambda x: x[value]).alias(value))


def once_per_content(df: DataFrame, content: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `work` adds to its distinct content; equal content is worked on once.

    Content is distinct before work and joined back by its columns; nulls are content too.
    """
    done = work(df.select(*content).distinct())
    renamed = done.select(*[F.col(c).alias(f"__{c}") for c in content], *[c for c in done.columns if c not in content])
    on = F.lit(True)
    for c in content:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(renamed, on, "left").drop(*[f"__{c}" for c in content])


def overdue(tasks: DataFrame, start: str, interval: str, done: str, now: str) -> DataFrame:
    """Tasks that ran longer than their interval, and how many whole intervals: till they were done, or till now."""
    late = F.coalesce(F.when(F.col(done) <= F.col(now), F.col(done)), F.col(now)) - F.col(start)
    return tasks.withColumn("n_overdue", F.floor(late / F.col(interval))).where("n_overdue > 0")
