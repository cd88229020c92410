"""Stream information, options, image folders and raw frames."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import frame_rate, option_kind
from .scratch import written

STREAM = "struct<codec_type:string,codec_name:string,width:bigint,height:bigint,r_frame_rate:string,nb_frames:string,duration:string,color_transfer:string,tags:map<string,string>>"
IMAGES = ["png", "tif", "tiff", "jpg", "jpeg"]


def streams_json(df: DataFrame, text: str, last: bool = False) -> DataFrame:
    """One stream of each codec_type per document: the first (or last) by its place. Malformed text gives none."""
    parsed = df.withColumn("__p", F.from_json(text, f"struct<streams:array<{STREAM}>>"))
    rows = parsed.select(*df.columns, F.posexplode("__p.streams").alias("place", "s"))
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*[c for c in df.columns if c != text], F.col("s.codec_type").alias("codec_type")).agg(pick("s", "place").alias("s"))


def streams_xml(df: DataFrame, text: str, guard: bool = False) -> DataFrame:
    """The last stream of each codec_type of an XML probe (attributes hold the values).

    With `guard`, a document that has a codec_type twice gives nothing.
    """
    kind = "struct<streams:struct<stream:array<struct<_codec_type:string,_codec_name:string,_width:bigint,_height:bigint,_r_frame_rate:string,tag:array<struct<_key:string,_value:string>>>>>>"
    parsed = df.withColumn("__p", F.from_xml(text, kind))
    rows = parsed.select(*df.columns, F.posexplode("__p.streams.stream").alias("place", "s"))
    rest = [c for c in df.columns if c != text]
    found = rows.groupBy(*rest, F.col("s._codec_type").alias("codec_type")).agg(F.max_by("s", "place").alias("s"), F.count("*").alias("__n"))
    if guard:
        worst = Window.partitionBy(*rest)  # a document has few kinds of streams
        found = found.withColumn("__n", F.max("__n").over(worst)).where("__n = 1")
    return found.drop("__n")


def image_set(files: DataFrame, name: str, width: str, height: str, exponent: int, keys: list[str]) -> DataFrame:
    """What a folder of images is as a video: n_frames, each image 2 ** exponent times, and the size of the first image by name."""
    return files.groupBy(*keys).agg((F.count("*") * 2**exponent).alias("n_frames"), F.min_by(width, name).alias("width"), F.min_by(height, name).alias("height"))


def with_fallback(facts: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """facts (width, height, rate, frames) with the other probe's where they are null or 0; duration from frames and rate."""
    known = [F.coalesce(F.nullif(F.col(f"f.{c}"), F.lit(0)), F.col(f"o.{c}")).alias(c) for c in ("width", "height", "rate", "frames")]
    out = facts.alias("f").join(other.alias("o"), keys, "left").select(*[F.col(f"f.{k}") for k in keys], *known)
    return out.withColumn("duration", F.col("frames") / F.nullif(F.col("rate"), F.lit(0)))


def video_facts(s: Column) -> list[Column]:
    """width and height (swapped by a rotate tag of 90 or 270), rate, and frames, from their number or from duration and rate."""
    turned = F.coalesce(s["tags"]["rotate"].isin("90", "270"), F.lit(False))
    rate = frame_rate(s["r_frame_rate"])
    frames = F.coalesce(s["nb_frames"].try_cast("bigint"), F.floor(s["duration"].try_cast("double") * rate))
    return [F.when(turned, s["height"]).otherwise(s["width"]).alias("width"), F.when(turned, s["width"]).otherwise(s["height"]).alias("height"), rate.alias("rate"), frames.alias("frames")]


def options(df: DataFrame, line: str, place: str, files: list[str] | None = None) -> DataFrame:
    """name, value and kind of the options of a section [General]; the last value of a name counts. Other sections are ignored.

    df has the lines with their places, of one file or of those that the columns `files` tell apart. A file of options has few lines.
    """
    files = files or []
    section = F.last(F.nullif(F.regexp_extract(line, r"^\s*\[(.+)\]\s*$", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy(*files).orderBy(place))
    rows = df.select(*files, section.alias("section"), place, F.regexp_extract(line, r"^\s*([^=\[;#]+?)\s*=", 1).alias("name"), F.regexp_extract(line, r"=\s*(.*?)\s*$", 1).alias("value"))
    found = rows.where("section = 'General' and name != ''").groupBy(*files, "name").agg(F.max_by("value", place).alias("value"))
    return found.withColumn("kind", option_kind(F.col("value")))


def image_folder(spark: SparkSession, path: str, exponent: int = 0, start: int = 0) -> DataFrame:
    """frame_no, name and content of a folder's images by name; each image 2 ** exponent times, from frame `start` on.

    Names are numbered in sorted ranges: within a range in its task, and over ranges by their counts.
    """
    times = 2**exponent
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = files.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(IMAGES))
    names = written(files.select("name").repartitionByRange("name").sortWithinPartitions("name").select("name", F.spark_partition_id().alias("range")))
    before = names.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("range").orderBy("name")) - 1
    numbered = names.withColumn("nth", nth).join(before, "range").select("name", (F.col("before") + F.col("nth")).alias("image_no")).where(F.col("image_no") >= start // times)
    rows = numbered.join(files.select("name", "content"), "name")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.select((F.col("image_no").cast("long") * times + F.col("copy")).alias("frame_no"), "name", "content").where(F.col("frame_no") >= start)


def write_images(df: DataFrame, path: str, number: str, content: str, extension: str = "png") -> DataFrame:
    """Writes a file for each row: its number as eight digits and the extension. Returns name and size of each file.

    A file is written under another name and then renamed, so a task that is run again leaves whole files.
    """

    def run(batches):
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for batch in batches:
            names, sizes = [f"{n:08d}.{extension}" for n in batch.column(0).to_pylist()], []
            for name, data in zip(names, batch.column(1).to_pylist()):
                part = f"{folder}/_{name}-{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(data)
                where.move(part, f"{folder}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "size"])

    return df.select(F.col(number).cast("long"), F.col(content).cast("binary")).mapInArrow(run, "name string, size long")


def raw_frames(df: DataFrame, content: str, h: int, w: int, bits_per_pixel: int = 24) -> DataFrame:
    """A row per frame of raw video bytes: frame_no and frame; a short rest is no frame."""
    size = h * w * bits_per_pixel // 8
    n = F.floor(F.length(content) / size).cast("int")
    rest = [c for c in df.columns if c != content]
    rows = df.where(n > 0).select(*rest, content, F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_no"))
    return rows.select(*rest, "frame_no", F.substring(F.col(content), F.col("frame_no") * size + 1, F.lit(size)).alias("frame"))
