"""Queries that run as streams over several micro-batches and a restart, with the SQL of their batch counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scenes
from ..operators.sequences import positions, with_neighbour
from ..sources.scratch import remove_at_exit, scratch_dir, written
from ..streaming import stateful
from .catalog import _LABELLED, _MEASURED, _PLACED, CAP, CUT, LENGTH, NEAR, SQL, STEP, _events, _folded, _measured, labelled_sql, query
from .media import known_grid


#: Rows of a stream for which it gets another partition of state, up to the session's shuffle partitions; the second where all cores have one.
STATE_ROWS, MORE_ROWS = 250_000, 1_000_000

#: Rows of a micro-batch for which it gets another file.
FILE_ROWS = 250_000


def streamed(rows: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], files: int = 6, end: DataFrame | None = None) -> DataFrame:
    """What a stream writes over rows that arrive part by part in `order`, stopped halfway and started again.

    Each micro-batch is a file, or as many as its rows need: what a sequence has in earlier ones reaches
    later ones as state only, and after the restart from the checkpoint only. `end` arrives last.
    """
    spark = rows.sparkSession
    place = scratch_dir(spark)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    cuts = sorted(set(rows.select(F.percentile_approx(order, [i / files for i in range(1, files)], 10_000)).first()[0] or []))
    past = F.lit(0)
    for cut in cuts:
        past = past + (F.col(order) > cut).cast("int")
    # the rows are read once more and dealt to their micro-batches, which are written from there
    rows.where(F.col(order).isNotNull()).withColumn("past_", past).write.partitionBy("past_").parquet(f"{place}/dealt")
    dealt = spark.read.schema(T.StructType([*rows.schema, T.StructField("past_", T.IntegerType())])).parquet(f"{place}/dealt")
    sizes = {r["past_"]: r["count"] for r in dealt.groupBy("past_").count().collect()}  # a number for each micro-batch
    total = sum(sizes.values())  # each partition of the state costs every micro-batch a task, a store and its commit
    parts = max(4, min(int(own), -(-total // STATE_ROWS), max(spark.sparkContext.defaultParallelism, -(-total // MORE_ROWS))))
    # all micro-batches have the same number of files, which their rows are dealt to by turns: none is left without
    each = max(1, min(sizes.get(k, 0) for k in range(len(cuts) + 1)) // FILE_ROWS)
    pieces = [dealt.where(F.col("past_") == k).drop("past_") for k in range(len(cuts) + 1)]
    pieces += [end] if end is not None else []
    half = -(-len(pieces) // 2)
    for part in (pieces[:half], pieces[half:]):
        for piece in part:
            files_of = piece.repartition(each) if each > 1 and piece is not end else piece.coalesce(1)
            files_of.write.mode("append").parquet(f"{place}/in")  # written one after the other, so that their files arrive in order
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{place}/in")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            run = build(source).writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/out")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", own)
        run.awaitTermination()
    remove_at_exit(spark, place)
    return spark.read.parquet(f"{place}/out")


def _timed(rows: DataFrame, time: str) -> DataFrame:
    """Rows whose order is their time, so that nothing is late."""
    return rows.withWatermark(time, "0 seconds")


@query(f"WITH RECURSIVE {_LABELLED} SELECT user_id, event_id, value, is_scene FROM labelled")
def stream_scene(spark, sf_dir):
    return streamed(_events(spark, sf_dir), "event_id", lambda s: stateful.stream_scenes(s, "user_id", "event_id", "value", LENGTH, 12.0))


@query(f"WITH RECURSIVE {_PLACED.replace('placed AS', 'src AS')}, {_folded('value', 'event_id', NEAR, CAP)} SELECT user_id, event_id, value, absorbed = 0 AS kept FROM folded")
def stream_dedup(spark, sf_dir):
    return streamed(_events(spark, sf_dir), "event_id", lambda s: stateful.stream_dedup(s, "user_id", "event_id", "value", NEAR, CAP))


#: Events in coarse levels, so that neighbours are often equal; low ones are black.
LEVEL, BLACK, SHORT = 7, 245, 6
_LEVELS = _PLACED.replace("event_id, value,", f"event_id, floor(value / {LEVEL}) * {LEVEL} AS value,")
_BLACK_SQL = labelled_sql(_MEASURED.replace(_PLACED, _LEVELS), f"e.value < {BLACK}", SHORT)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.floor(F.col("value") / LEVEL) * LEVEL).cast("double")
    return _events(spark, sf_dir).select("user_id", "event_id", level.alias("value"), (level < BLACK).alias("dark"))


@query(f"WITH RECURSIVE {_BLACK_SQL} SELECT user_id, event_id, is_scene FROM labelled")
def scene_black(spark, sf_dir):
    """Scenes that begin where a black run ends, besides hard and soft cuts."""
    measured = scenes.pair_distance(_levels(spark, sf_dir), "user_id", "event_id", "value", lambda a, b: F.abs(a - b))
    found = scenes.scene_adaptive(measured, "user_id", "diff", F.col("dark"), SHORT, 12.0)
    return found.join(measured.select("user_id", "pos", "event_id"), ["user_id", "pos"]).select("user_id", "event_id", "is_scene")


@query(f"WITH RECURSIVE {_BLACK_SQL} SELECT user_id, event_id, is_scene FROM labelled")
def stream_scene_black(spark, sf_dir):
    found = streamed(_levels(spark, sf_dir), "event_id", lambda s: stateful.stream_scenes(s, "user_id", "event_id", "value", SHORT, 12.0, pure="dark"))
    return found.select("user_id", "event_id", "is_scene")


@query(f"WITH {_MEASURED} SELECT user_id, event_id, coalesce(diff >= {CUT}, false) AS fixed, false AS off FROM measured")
def scene_modes(spark, sf_dir):
    """Scenes by a fixed distance, and no scenes: the labeller's other modes."""
    measured = _measured(spark, sf_dir)
    mode = lambda name, **how: scenes.scene_adaptive(measured, "user_id", "diff", F.lit(False), **how).select("user_id", "pos", F.col("is_scene").alias(name))
    both = mode("fixed", fixed=CUT).join(mode("off", disabled=True), ["user_id", "pos"])
    return measured.select("user_id", "pos", "event_id").join(both, ["user_id", "pos"]).drop("pos")


@query(f"WITH {_MEASURED} SELECT user_id, event_id, coalesce(diff >= {CUT}, false) AS is_scene FROM measured")
def stream_scene_fixed(spark, sf_dir):
    found = streamed(_events(spark, sf_dir), "event_id", lambda s: stateful.stream_scenes(s, "user_id", "event_id", "value", fixed=CUT))
    return found.select("user_id", "event_id", "is_scene")


@query(SQL["interp_scene_pipeline"])
def stream_interpolate(spark, sf_dir):
    """The resampled sequences, deduplicated and filled within scenes as they arrive; a heartbeat a day after the last row closes what is open."""
    grid = written(known_grid(spark, sf_dir).select("user_id", "t", "value", F.timestamp_micros("t").alias("at")))  # it is read for each micro-batch
    day = 24 * 3600 * 1_000_000
    end = grid.agg(F.max("t").alias("t")).select(F.lit(None).cast(grid.schema["user_id"].dataType).alias("user_id"), (F.col("t") + 2 * day).alias("t"), F.lit(None).cast("double").alias("value"))
    end = end.withColumn("at", F.timestamp_micros("t"))
    made = streamed(grid, "t", lambda s: stateful.stream_interpolate(_timed(s, "at"), "user_id", "at", "value", 30.0, 8, CUT, idle=day), end=end)
    return made.select("user_id", (F.col("pos")).alias("pos"), "sub_no", F.round("value", 6).alias("value"))


@query(SQL["overdue"])
def stream_overdue(spark, sf_dir):
    """The tasks of `overdue`, reported by timers as they are late; the last report of each tells how late it came to be."""
    stamped = _events(spark, sf_dir, "ts").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("t", F.unix_micros("ts"))
    told = streamed(stamped, "t", lambda s: stateful.stream_overdue(_timed(s, "ts"), "user_id", "event_id", "ts", 24 * 3600 * 1_000_000))
    return told.groupBy("user_id", "event_id").agg(F.max("n_overdue").alias("n_overdue"))
