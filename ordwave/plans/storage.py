"""Queries that write files of the library's own formats and read them back, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..sources import chunk_sink, raw
from ..sources.scratch import remove_at_exit, scratch_dir
from .catalog import _PLACED, GAP, _placed, query

#: Frames of a raw file, and the frame from which a resumed scan reads.
FILE_FRAMES, RESUMED = 128, 32


@query(f"""WITH n AS (SELECT vec_id // {FILE_FRAMES} AS f, row_number() OVER (PARTITION BY vec_id // {FILE_FRAMES} ORDER BY vec_id) - 1 AS frame_no, embedding FROM embeddings)
SELECT lpad(f::VARCHAR, 8, '0') || '.raw' AS file, frame_no, list_sum(list_transform(range(1, 65), lambda i: i * floor((embedding[i]::DOUBLE + 1) * 32767.5)))::BIGINT AS total FROM n WHERE frame_no >= {RESUMED}""")
def raw_source(spark, sf_dir):
    """Frames of 8 x 8 samples of 16 bits, highest byte first, written as raw files and read from a frame on, by byte ranges."""
    folder = scratch_dir(spark)
    remove_at_exit(spark, folder)
    levels = F.transform(arrays.doubles(F.col("embedding")), lambda x: F.floor((x + 1) * 32767.5).cast("int"))
    name = F.concat(F.lpad(F.floor(F.col("vec_id") / FILE_FRAMES).cast("string"), 8, "0"), F.lit(".raw"))
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(name.alias("file"), "vec_id", levels.alias("px"))
    raw.write_raw(frames, folder, "file", "vec_id", "px", bits=16, order="big").agg(F.sum("size")).first()
    read = raw.read_raw(spark, folder, 8, 8, bits=16, order="big", split_bytes=4096).where(F.col("frame_no") >= RESUMED)
    return read.select("file", "frame_no", F.aggregate(F.transform("px", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {_PLACED} SELECT user_id, event_id, pos, pos // {GAP} AS chunk_id, CASE WHEN pos // {GAP} = 1 THEN -value ELSE value END AS value, CASE WHEN pos // {GAP} = 1 THEN 1 ELSE 0 END AS commit FROM placed")
def chunk_commit(spark, sf_dir):
    """All chunks written, one chunk of every sequence written again, and that commit replayed with other rows, which changes nothing."""
    folder = scratch_dir(spark)
    remove_at_exit(spark, folder)
    placed = _placed(spark, sf_dir)
    again = placed.where(F.floor(F.col("pos") / GAP) == 1).withColumn("value", -F.col("value"))
    chunk_sink.write_chunks(placed, GAP, folder, commit=0)
    chunk_sink.write_chunks(again, GAP, folder, commit=1)
    chunk_sink.write_chunks(again.withColumn("value", F.lit(0.0)), GAP, folder, commit=1)
    return chunk_sink.read_chunks(spark, folder, "user_id").select("user_id", "event_id", "pos", "chunk_id", "value", "commit")
