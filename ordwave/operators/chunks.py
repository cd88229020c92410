"""Chunks by row count: numbering, resuming, merging, and metadata that goes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chunk_name
from .sequences import positions, running_sum


def chunk_table(placed: DataFrame, seq: str, gap: int) -> DataFrame:
    """seq, chunk_id, first_pos, last_pos (both inclusive), n_rows and name of each chunk of `gap` rows."""
    found = placed.groupBy(seq, F.floor(F.col("pos") / gap).alias("chunk_id")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"))
    return found.withColumn("name", chunk_name(F.col("chunk_id"), F.col("first_pos"), F.col("last_pos")))


def parse_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds number, first and last as numbers; rows whose name is no chunk's are left out."""
    pattern = r"chunk-([0-9]+)-([0-9]+)-([0-9]+)"
    part = lambda i: F.regexp_extract(name, pattern, i).cast("bigint")
    return df.where(F.col(name).rlike(pattern)).select("*", part(1).alias("number"), part(2).alias("first"), part(3).alias("last"))


def resume_point(written: DataFrame, seq: str) -> DataFrame:
    """seq, next_chunk and next_pos after the chunk with the largest number; ends are inclusive."""
    return parse_names(written).groupBy(seq).agg((F.max("number") + 1).alias("next_chunk"), (F.max_by("last", "number") + 1).alias("next_pos"))


def merge_order(names: DataFrame, seq: str) -> DataFrame:
    """Adds place and first_row to names(seq, name): the chunk's place in its sequence by its first position as a number, and the rows before it.

    Rows before are the chunk's place among those of slices of positions, and sums over earlier slices: no sequence's chunks meet in a task.
    """
    parsed = parse_names(names)
    placed = positions(parsed, seq, "first", width=1 << 22)
    return running_sum(placed, seq, F.col("last") - F.col("first") + 1, "first_row").withColumnRenamed("pos", "place").drop("number", "first", "last")


def remaining(placed: DataFrame, written: DataFrame, seq: str) -> DataFrame:
    """The rows that no written chunk has; sequences without chunks are whole."""
    points = resume_point(written, seq)
    return placed.join(points.select(seq, "next_pos"), seq, "left").where(F.col("pos") >= F.coalesce("next_pos", F.lit(0))).drop("next_pos")


def replicate(placed: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, with a dense index in its sequence: idx."""
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("idx", F.col("pos") * times + F.col("copy"))


def index_metadata(docs: DataFrame, text: str, times: int) -> DataFrame:
    """The scenes of metadata documents, each `times` times: idx counts from 0 in the order of their numbers, entry is the scene as a map.

    `text` is JSON with a list SceneInfo whose entries have a SceneFrameIndex, a number or its text;
    numbers are compared as numbers. Absent and malformed documents have no scenes. One document's
    scenes are one array, as they are in its file. The other columns of docs are kept.
    """
    keep = [c for c in docs.columns if c != text]
    parsed = docs.select(*keep, F.from_json(text, "SceneInfo array<map<string,string>>")["SceneInfo"].alias("__s"))
    number = lambda e: e["SceneFrameIndex"].try_cast("bigint")
    ordered = F.transform(F.array_sort(F.transform("__s", lambda e, i: F.struct(number(e).alias("n"), i.alias("i")))), lambda x: F.element_at("__s", x["i"] + 1))
    rows = parsed.select(*keep, F.posexplode(ordered).alias("__i", "entry")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.select(*keep, (F.col("__i").cast("long") * times + F.col("copy")).alias("idx"), "entry")


def metadata_slice(indexed: DataFrame, starts: DataFrame, doc: str, gap: int, fields: list[str]) -> DataFrame:
    """For each start(doc, start), the JSON list of the entries from start to start + gap - 1, each with its own idx as SceneFrameIndex.

    A start below 0 or past the end has an empty text; a start just at the end has an empty list.
    """
    ends = indexed.groupBy(doc).agg(F.count("*").alias("__n"))
    item = F.struct(F.col("idx").alias("SceneFrameIndex"), *[F.col("entry")[f].alias(f) for f in fields])
    wanted = starts.withColumn("idx", F.explode(F.sequence(F.col("start"), F.col("start") + gap - 1)))
    found = wanted.join(indexed, [doc, "idx"], "left").groupBy(doc, "start").agg(F.sort_array(F.collect_list(F.when(F.col("entry").isNotNull(), item))).alias("__l"))
    text = F.when((F.col("start") < 0) | F.col("__n").isNull() | (F.col("start") > F.col("__n")), "").otherwise(F.to_json("__l"))
    return found.join(ends, doc, "left").select(doc, "start", text.alias("slice"))
