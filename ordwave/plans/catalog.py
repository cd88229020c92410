"""Queries that apply the operators to the driver's tables, and the SQL that checks them.

Events are scalar sequences by user, in the order of event_id; embeddings are frames of 8 x 8 pixels,
a sequence for each label, in the order of vec_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, scalars
from ..operators import chunks, dedup, fill, frames, scenes
from ..operators.sequences import positions, with_neighbour
from ..sources import probe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parameters of the queries: rolling length, thresholds on values, run cap, rows in a chunk, grid step (microseconds).
LENGTH, CUT, NEAR, CAP, GAP, STEP = 18, 150.0, 60.0, 3, 25, 6 * 3600 * 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", *more)


def _placed(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return positions(_events(spark, sf_dir, *more), "user_id", "event_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.pair_distance(_events(spark, sf_dir), "user_id", "event_id", "value", lambda a, b: F.abs(a - b))


_px = lambda: arrays.doubles(F.col("embedding"))

_PLACED = "placed AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"
_MEASURED = f"{_PLACED}, measured AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS diff FROM placed)"
_FRAMES = "frames AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings)"
_PIXELS = f"{_FRAMES}, pixels AS (SELECT vec_id, label, i, i // 8 AS y, i % 8 AS x, px[i + 1] AS v FROM (SELECT vec_id, label, px, unnest(range(64)) AS i FROM frames))"
_PAIRS = f"{_FRAMES}, pairs AS (SELECT *, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM frames)"
_DIFF = "list_avg(list_transform(range(1, 65), lambda i: abs(px[i] - prev[i])))"


@query(f"WITH {_PAIRS} SELECT vec_id, label, round({_DIFF}, 6) AS diff FROM pairs WHERE prev IS NOT NULL")
def pair_diff(spark, sf_dir):
    found = scenes.pair_distance(_vectors(spark, sf_dir), "label", "vec_id", "embedding", arrays.mean_abs_diff)
    return found.where("prev is not null").select("vec_id", "label", F.round("diff", 6).alias("diff"))


@query(f"WITH {_PAIRS} SELECT vec_id, label, coalesce({_DIFF} >= 0.15, false) AS is_scene FROM pairs")
def scene_fixed(spark, sf_dir):
    found = scenes.pair_distance(_vectors(spark, sf_dir), "label", "vec_id", "embedding", arrays.mean_abs_diff)
    return found.select("vec_id", "label", F.coalesce(F.col("diff") >= 0.15, F.lit(False)).alias("is_scene"))


_SCORED = f"""{_MEASURED}, scored AS (
  SELECT *, CASE WHEN count(diff) OVER w < 2 THEN 0 ELSE pow(var_pop(diff) OVER w * (1 + CASE WHEN var_pop(diff) OVER w = 0 THEN 0 ELSE coalesce(regr_r2(diff, pos::DOUBLE) OVER w, 0) END), 0.65) END AS score
  FROM measured WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_SCORED} SELECT event_id, user_id, round(score, 4) AS score, round(score - lag(score) OVER (PARTITION BY user_id ORDER BY pos), 4) AS delta FROM scored")
def scene_score(spark, sf_dir):
    found = scenes.scene_score(_measured(spark, sf_dir), "user_id", "diff", LENGTH)
    return found.select("event_id", "user_id", F.round("score", 4).alias("score"), F.round("delta", 4).alias("delta"))


@query(f"""WITH {_MEASURED} SELECT user_id, count(*) FILTER (diff > {CUT}) AS scene, count(*) FILTER (diff < 5) AS dup,
  count(*) FILTER (diff IS NULL OR diff BETWEEN 5 AND {CUT}) AS normal, max(event_id) FILTER (diff > {CUT}) AS recent_scene FROM measured GROUP BY user_id""")
def scene_status(spark, sf_dir):
    d = F.col("diff")
    return _measured(spark, sf_dir).groupBy("user_id").agg(F.count_if(d > CUT).alias("scene"), F.count_if(d < 5).alias("dup"), F.count_if(d.isNull() | d.between(5, CUT)).alias("normal"), F.max(F.when(d > CUT, F.col("event_id"))).alias("recent_scene"))


_GRID = f"""stamped AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events),
grid AS (SELECT user_id, unnest(range(lo - lo % {STEP}, hi + 1, {STEP})) AS t FROM (SELECT user_id, min(t) AS lo, max(t) AS hi FROM stamped GROUP BY user_id)),
resampled AS (SELECT g.user_id, g.t, s.event_id, s.value FROM grid g ASOF LEFT JOIN stamped s ON g.user_id = s.user_id AND g.t >= s.t)"""


def _resampled(spark, sf_dir):
    stamped = _events(spark, sf_dir, "ts").select("user_id", "event_id", "value", scalars.micros("ts").alias("t"))
    return fill.resample_locf(stamped, "user_id", "t", STEP, ["event_id", "value"])


@query(f"WITH {_GRID} SELECT user_id, t, event_id, value FROM resampled")
def resample_locf(spark, sf_dir):
    return _resampled(spark, sf_dir)


_AHEAD = f"{_PLACED}, ahead AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), value) AS nxt FROM placed)"


@query(f"WITH {_AHEAD} SELECT user_id, event_id, k AS sub_no, round(CASE WHEN k = 0 THEN value ELSE value * (1 - k / (event_id % 4 + 1)) + nxt * (k / (event_id % 4 + 1)) END, 6) AS value FROM (SELECT *, unnest(range(event_id % 4 + 1))::INT AS k FROM ahead)")
def fill_uniform(spark, sf_dir):
    return fill.fill(_placed(spark, sf_dir), "user_id", "value", F.col("event_id") % 4).select("user_id", "event_id", "sub_no", F.round("value", 6).alias("value"))


_BISECT = "bisect(n, k, t) AS (VALUES (0, 0, 0), (1, 0, 0), (1, 1, 0.5), (2, 0, 0), (2, 1, 0.25), (2, 2, 0.75), (3, 0, 0), (3, 1, 0.25), (3, 2, 0.5), (3, 3, 0.75), (4, 0, 0), (4, 1, 0.125), (4, 2, 0.375), (4, 3, 0.625), (4, 4, 0.875), (5, 0, 0), (5, 1, 0.125), (5, 2, 0.375), (5, 3, 0.5), (5, 4, 0.625), (5, 5, 0.875))"


@query(f"WITH {_AHEAD}, {_BISECT} SELECT user_id, event_id, k AS sub_no, round(CASE WHEN k = 0 THEN value ELSE value * (1 - t::DOUBLE) + nxt * t::DOUBLE END, 6) AS value FROM ahead JOIN bisect ON n = event_id % 6")
def fill_bisect(spark, sf_dir):
    times = [fill.bisect_times(n) for n in range(6)]
    return fill.fill(_placed(spark, sf_dir), "user_id", "value", F.col("event_id") % 6, times=times).select("user_id", "event_id", "sub_no", F.round("value", 6).alias("value"))


@query(f"""WITH {_FRAMES}, ahead AS (SELECT *, coalesce(lead(px) OVER (PARTITION BY label ORDER BY vec_id), px) AS nxt FROM frames),
made AS (SELECT vec_id, label, k AS sub_no, list_transform(range(1, 65), lambda i: px[i] * (1 - k / 3) + nxt[i] * (k / 3)) AS px FROM (SELECT *, unnest(range(3))::INT AS k FROM ahead))
SELECT vec_id, label, sub_no, round(list_sum(px), 6) AS px_sum, round(list_sum(list_transform(px, lambda x, i: x * i)), 5) AS px_weighted FROM made""")
def fill_crossfade(spark, sf_dir):
    placed = positions(_vectors(spark, sf_dir), "label", "vec_id").withColumn("px", _px())
    made = fill.fill(placed, "label", "px", F.lit(2), blend=fill.linear_arrays)
    return made.select("vec_id", "label", "sub_no", F.round(arrays.total("px"), 6).alias("px_sum"), F.round(arrays.weighted("px"), 5).alias("px_weighted"))


_CHUNKS = f"""{_PLACED}, chunked AS (SELECT user_id, pos // {GAP} AS chunk_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows FROM placed GROUP BY 1, 2),
named AS (SELECT *, 'chunk-' || lpad(chunk_id::VARCHAR, 3, '0') || '-' || lpad(first_pos::VARCHAR, 8, '0') || '-' || lpad(last_pos::VARCHAR, 8, '0') AS name FROM chunked)"""


@query(f"WITH {_CHUNKS} SELECT user_id, chunk_id, first_pos, last_pos, n_rows, name FROM named")
def chunk_count(spark, sf_dir):
    return chunks.chunk_table(_placed(spark, sf_dir), "user_id", GAP)


@query(f"WITH {_CHUNKS} SELECT p.user_id, p.event_id, p.pos FROM placed p WHERE p.pos >= coalesce((SELECT max(last_pos) + 1 FROM chunked c WHERE c.user_id = p.user_id AND c.chunk_id < 2 AND c.user_id % 3 > 0), 0)")
def chunk_resume(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    written = chunks.chunk_table(placed, "user_id", GAP).where("chunk_id < 2 and user_id % 3 > 0")
    return chunks.remaining(placed, written, "user_id").select("user_id", "event_id", "pos")


@query(f"WITH {_CHUNKS} SELECT user_id, name, row_number() OVER w - 1 AS place, coalesce(sum(last_pos - first_pos + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM named WINDOW w AS (PARTITION BY user_id ORDER BY first_pos)")
def chunk_merge_order(spark, sf_dir):
    """Where each chunk goes when a sequence's chunks are merged: its place, and the rows before it."""
    named = chunks.chunk_table(_placed(spark, sf_dir), "user_id", GAP).select("user_id", "name")
    return chunks.merge_order(named, "user_id").select("user_id", "name", "place", "first_row")


@query(f"WITH {_PLACED} SELECT user_id, event_id, copy, row_number() OVER (PARTITION BY user_id ORDER BY pos, copy) - 1 AS idx FROM (SELECT *, unnest(range(3))::INT AS copy FROM placed)")
def meta_replicate(spark, sf_dir):
    return chunks.replicate(_placed(spark, sf_dir), 3).select("user_id", "event_id", "copy", "idx")


@query(f"""WITH p AS (SELECT user_id, (json_extract_string(props, '$.k'))::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)
SELECT user_id, pos // {GAP} AS chunk_id, string_agg(k::VARCHAR, ',' ORDER BY pos) AS ks FROM p GROUP BY 1, 2""")
def meta_slice_json(spark, sf_dir):
    placed = _placed(spark, sf_dir, "props").withColumn("k", F.from_json("props", "k bigint")["k"])
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "k"))), lambda s: s["k"].cast("string")), ",")
    return placed.groupBy("user_id", F.floor(F.col("pos") / GAP).alias("chunk_id")).agg(listed.alias("ks"))


@query(f"WITH {_PLACED} SELECT user_id, pos AS source, pos * 3 AS offset_, 2 AS length FROM placed")
def dup_edit_plan(spark, sf_dir):
    return _placed(spark, sf_dir).select("user_id", F.col("pos").alias("source"), (F.col("pos") * 3).alias("offset_"), F.lit(2).alias("length"))


def text_sql(*parts: str) -> str:
    """A text of SQL expressions one after another, in the words that Spark and DuckDB have in common; numbers are given as {...}."""
    cast = lambda x: f"CAST({x[1:-1]} AS STRING)" if x.startswith("{") else x
    return " || ".join(cast(x) for x in parts)


#: A probe's answer about each part: one or two video streams, turned or not, with rates of several kinds, and texts that are no JSON.
_JSON = text_sql(
    """'{"streams": ['""", """CASE WHEN p_size % 4 = 0 THEN '{"codec_type": "audio", "codec_name": "aac"}, ' ELSE '' END""", """'{"codec_type": "video", "width": '""", "{p_size * 32}", """', "height": '""", "{p_size * 18}",
    """', "r_frame_rate": "' || CASE p_size % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '30000/1001' ELSE '25/1' END || '"'""", """CASE WHEN p_size % 2 = 0 THEN ', "nb_frames": "'""", "{p_size * 100}", """'"' ELSE ', "duration": "'""", "{p_size}", """'.5"' END""",
    """CASE p_size % 3 WHEN 0 THEN ', "tags": {"rotate": "90"}' WHEN 1 THEN ', "tags": {"rotate": "180", "k": "v"}' ELSE '' END || '}'""", """CASE WHEN p_partkey % 2 = 0 THEN ', {"codec_type": "video", "width": 1, "height": 2}' ELSE '' END""", """CASE WHEN p_partkey % 97 = 0 THEN '' ELSE ']}' END""",
)


@query(f"""WITH docs AS (SELECT p_partkey AS id, {_JSON} AS t FROM part), s AS (SELECT id, unnest(range(json_array_length(t, '$.streams')::BIGINT)) AS place, t FROM docs WHERE json_valid(t)),
e AS (SELECT id, place, json_extract(t, '$.streams[' || place || ']') AS s FROM s), k AS (SELECT id, s->>'codec_type' AS codec_type, arg_min(s, place) AS s FROM e GROUP BY ALL),
v AS (SELECT id, (s->>'width')::BIGINT AS w, (s->>'height')::BIGINT AS h, (s->>'$.tags.rotate') IN ('90', '270') AS r, s->>'r_frame_rate' AS rate, (s->>'nb_frames')::BIGINT AS n, (s->>'duration')::DOUBLE AS d FROM k WHERE codec_type = 'video'),
f AS (SELECT *, CASE WHEN split_part(rate, '/', 2)::DOUBLE = 0 THEN 25 ELSE split_part(rate, '/', 1)::DOUBLE / split_part(rate, '/', 2)::DOUBLE END AS fps FROM v)
SELECT id, CASE WHEN coalesce(r, false) THEN h ELSE w END AS width, CASE WHEN coalesce(r, false) THEN w ELSE h END AS height, round(fps, 6) AS rate, coalesce(n, floor(d * fps)::BIGINT) AS frames FROM f""")
def probe_first_stream(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(_JSON).alias("t"))
    width, height, rate, count = probe.video_facts(F.col("s"))
    return probe.streams_json(docs, "t").where("codec_type = 'video'").select("id", width, height, F.round(rate, 6).alias("rate"), count)


#: The same as XML, with one or two video streams and with or without audio.
XML = text_sql(
    """'<ffprobe><streams><stream codec_type="video" codec_name="'""", "p_brand", """'" width="'""", "{p_size * 32}", """'" height="18" r_frame_rate="30/1"/>'""",
    """CASE WHEN p_size % 2 = 0 THEN '<stream codec_type="video" codec_name="mjpeg" width="10" height="20" r_frame_rate="0/0"><tag key="rotate" value="90"/></stream>' ELSE '' END""",
    """CASE WHEN p_size % 3 = 0 THEN '' ELSE '<stream codec_type="audio" codec_name="aac"/>' END""", """'</streams></ffprobe>'""",
)


def xml_sql(table: str) -> str:
    """Streams of XML documents (id, t) by patterns, as the tables docs, e, a and k: the last stream of each kind, and how many there are."""
    return f"""docs(id, t) AS ({table}), e AS (SELECT id, unnest(regexp_extract_all(t, '<stream [^>]*>')) AS s, generate_subscripts(regexp_extract_all(t, '<stream [^>]*>'), 1) AS place FROM docs),
a AS (SELECT id, place, regexp_extract(s, 'codec_type="([^"]*)"', 1) AS codec_type, regexp_extract(s, 'codec_name="([^"]*)"', 1) AS codec_name, nullif(regexp_extract(s, 'width="([^"]*)"', 1), '')::BIGINT AS width FROM e),
k AS (SELECT id, codec_type, arg_max(codec_name, place) AS codec_name, last(width ORDER BY place) AS width, count(*) AS n FROM a GROUP BY id, codec_type)"""


_XML_SQL = xml_sql(f"SELECT p_partkey, {XML} FROM part")


def _xml_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(XML).alias("t"))


@query(f"WITH {_XML_SQL} SELECT id, codec_type, codec_name, width FROM k")
def probe_xml_last(spark, sf_dir):
    return probe.streams_xml(_xml_probes(spark, sf_dir), "t").select("id", "codec_type", F.col("s._codec_name").alias("codec_name"), F.col("s._width").alias("width"))


#: The lines of an options file about each part.
_LINES = [
    "'[Other]'", "'size=1'", "'[General]'", text_sql("'size = '", "{p_size}"), "CASE WHEN p_size % 2 = 0 THEN 'flag=true' ELSE 'flag = False' END", text_sql("'ratio='", "{p_size}", "CASE WHEN p_size % 4 = 0 THEN '.0' ELSE '.25' END"),
    "'empty='", "'name=' || p_name", text_sql("CASE WHEN p_size % 3 = 0 THEN 'size=' ELSE 'more=' END", "{p_size + 1000}"), "'path=/a/b.c'", "'[End]'", "'size=9'",
]


@query(f"""WITH f AS (SELECT p_partkey, [{', '.join(_LINES)}] AS lines FROM part), l AS (SELECT p_partkey, unnest(range(len(lines))) AS place, lines FROM f), t AS (SELECT p_partkey, place, lines[place + 1] AS line FROM l),
s AS (SELECT *, last_value(nullif(regexp_extract(line, '^\\[(.+)\\]$', 1), '') IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY place) AS section FROM t),
o AS (SELECT p_partkey, trim(split_part(line, '=', 1)) AS name, arg_max(trim(split_part(line, '=', 2)), place) AS value FROM s WHERE section = 'General' AND contains(line, '=') GROUP BY ALL HAVING true)
SELECT p_partkey, name, value, CASE WHEN lower(value) IN ('true', 'false') THEN 'bool' WHEN try_cast(value AS DOUBLE) IS NULL THEN 'string' WHEN try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE)) THEN 'int' ELSE 'float' END AS kind FROM o""")
def config_coerce(spark, sf_dir):
    """The options of a file for each part."""
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.posexplode(F.array(*[F.expr(x) for x in _LINES])).alias("place", "line"))
    return probe.options(lines, "line", "place", ["p_partkey"])


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def props_extract(spark, sf_dir):
    return _events(spark, sf_dir, "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(sum(v), 6) AS inner_sum, count(*) AS n FROM pixels WHERE y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5 GROUP BY vec_id")
def crop(spark, sf_dir):
    a = arrays.crop(_px(), 8, 8, 1, 2)
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.total(a), 6).alias("inner_sum"), F.size(a).cast("long").alias("n"))


@query("""SELECT p_partkey, p_size + p_size % 2 AS even_size, (floor(p_size * 3 / 4) + floor(p_size * 3 / 4) % 2)::BIGINT AS three_quarters,
  CASE WHEN p_size / 40 >= 1 THEN 1 WHEN p_size / 40 >= 0.75 THEN 0.75 WHEN p_size / 40 >= 0.5 THEN 0.5 ELSE 0.25 END::DOUBLE AS ratio FROM part""")
def even_size_and_ratio(spark, sf_dir):
    size = F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.even(size).alias("even_size"), scalars.rescale(size, 3).alias("three_quarters"), scalars.ratio_bucket(size / 40).alias("ratio"))


@query(f"WITH {_PIXELS} SELECT vec_id, var_pop(v) < 0.005 AS is_pure FROM pixels WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY vec_id")
def pure_frame(spark, sf_dir):
    sample = arrays.where_pixel(_px(), 8, lambda y, x: (y % 4 == 0) & (x % 4 == 0))
    return _vectors(spark, sf_dir).select("vec_id", (arrays.variance(sample) < 0.005).alias("is_pure"))


@query(f"WITH {_PIXELS} SELECT vec_id, (y // 2)::INT AS ty, (x // 2)::INT AS tx, round(avg(v), 6) AS cell FROM pixels GROUP BY ALL")
def block_mean(spark, sf_dir):
    return frames.tiles(_vectors(spark, sf_dir), "embedding", 8, 8, 2).select("vec_id", "ty", "tx", F.round(arrays.mean("region"), 6).alias("cell"))


@query(f"""WITH {_PIXELS}, c AS (SELECT vec_id, floor((v + 1) * 127.5)::INT AS level, count(*) AS n FROM pixels GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY level) AS cdf, first(n) OVER (PARTITION BY vec_id ORDER BY level) AS low FROM c)
SELECT vec_id, level, n, CASE WHEN low < 64 THEN floor((cdf - low) * 255 / (64 - low) + 0.5) ELSE level END::INT AS equalised FROM r""")
def hist_equalize(spark, sf_dir):
    levels = _vectors(spark, sf_dir).select("vec_id", F.explode(F.transform(_px(), lambda x: F.floor((x + 1) * 127.5).cast("int"))).alias("level"))
    return frames.equalise(levels, "vec_id", "level")


@query(f"WITH {_PIXELS}, p AS (SELECT vec_id, ((x % 2) * 4 + y % 4)::INT AS piece, v, row_number() OVER (PARTITION BY vec_id, x % 2, y % 4 ORDER BY i) AS at_ FROM pixels) SELECT vec_id, piece, round(sum(v * at_), 6) AS px_weighted FROM p GROUP BY ALL")
def interleave_split(spark, sf_dir):
    split = _vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.split_pieces(_px(), 8, 2, 4)).alias("piece", "px"))
    return split.select("vec_id", "piece", F.round(arrays.weighted("px"), 6).alias("px_weighted"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(sum(v * (i + 1)), 5) AS weighted, round(sum(v * (x + 1)) FILTER (y = 3), 6) AS row_three FROM pixels GROUP BY vec_id")
def interleave_roundtrip(spark, sf_dir):
    """Frames split into interleaved pieces and sewn together: every pixel is in its place again."""
    split = _vectors(spark, sf_dir).select("vec_id", arrays.split_pieces(_px(), 8, 2, 4).alias("pieces"))
    sewn = split.select("vec_id", arrays.sew_pieces(F.col("pieces"), 8, 8, 2, 4).alias("px"))
    return sewn.select("vec_id", F.round(arrays.weighted("px"), 5).alias("weighted"), F.round(arrays.weighted(F.slice("px", 25, 8)), 6).alias("row_three"))


@query(f"""WITH {_PIXELS}, t AS (SELECT a::INT AS ty, b::INT AS tx FROM range(3) r(a), range(3) s(b))
SELECT vec_id, ty, tx, count(*) AS n, round(sum(v), 6) AS px_sum FROM pixels JOIN t ON y BETWEEN ty * 3 - 1 AND ty * 3 + 3 AND x BETWEEN tx * 3 - 1 AND tx * 3 + 3 GROUP BY ALL""")
def halo_tiles(spark, sf_dir):
    found = frames.tiles(_vectors(spark, sf_dir), "embedding", 8, 8, 3, pad=1)
    return found.select("vec_id", "ty", "tx", F.size("region").cast("long").alias("n"), F.round(arrays.total("region"), 6).alias("px_sum"))


@query(f"""WITH {_PIXELS}, t AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, avg(v) AS m FROM pixels GROUP BY ALL), f AS (SELECT vec_id, avg(m) AS m FROM t GROUP BY vec_id)
SELECT t.vec_id, ty::INT AS ty, tx::INT AS tx, round(t.m - f.m, 6) AS centred FROM t JOIN f USING (vec_id)""")
def tile_mean_broadcast(spark, sf_dir):
    means = frames.tiles(_vectors(spark, sf_dir), "embedding", 8, 8, 4).select("vec_id", "ty", "tx", arrays.mean("region").alias("m"))
    return means.select("vec_id", "ty", "tx", F.round(F.col("m") - F.avg("m").over(Window.partitionBy("vec_id")), 6).alias("centred"))


_TAPS = ", ".join(f"({k - 3}, {t!r})" for k, t in enumerate(arrays.gaussian()))


@query(f"""WITH {_PIXELS}, taps(k, g) AS (VALUES {_TAPS}),
m AS (SELECT p.vec_id, p.i, any_value(p.v) AS v, sum(q.v * a.g::DOUBLE * b.g::DOUBLE) AS mu, sum(q.v * q.v * a.g::DOUBLE * b.g::DOUBLE) AS sq FROM pixels p JOIN taps a ON true JOIN taps b ON true JOIN pixels q ON q.vec_id = p.vec_id AND q.y = p.y + a.k AND q.x = p.x + b.k GROUP BY p.vec_id, p.i),
n AS (SELECT vec_id, i, (v - mu) / (sqrt(abs(sq - mu * mu)) + 1) AS c FROM m)
SELECT vec_id, round(avg(c), 6) AS mean_c, round(var_pop(c), 6) AS var_c, round(sum(c * (i + 1)), 5) AS weighted_c FROM n GROUP BY vec_id""")
def mscn(spark, sf_dir):
    made = _vectors(spark, sf_dir).select("vec_id", frames.mscn(_px(), 8, 8).alias("c"))
    return made.select("vec_id", F.round(arrays.mean("c"), 6).alias("mean_c"), F.round(arrays.variance("c"), 6).alias("var_c"), F.round(arrays.weighted("c"), 5).alias("weighted_c"))


@query(f"""WITH {_PIXELS}, s(name, dy, dx) AS (VALUES ('horizontal', 0, 1), ('vertical', 1, 0), ('diagonal', 1, 1), ('antidiagonal', 1, -1))
SELECT p.vec_id, s.name, round(sum(p.v * q.v), 6) AS product, round(sum(p.v * q.v * (p.i + 1)), 5) AS weighted_product FROM pixels p JOIN s ON true JOIN pixels q ON q.vec_id = p.vec_id AND q.y = (p.y - dy + 8) % 8 AND q.x = (p.x - dx + 8) % 8 GROUP BY ALL""")
def paired_products(spark, sf_dir):
    made = frames.paired_products(F.col("px"), 8, 8)
    rows = _vectors(spark, sf_dir).select("vec_id", _px().alias("px")).select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("px")) for k, c in made.items()])).alias("p"))
    return rows.select("vec_id", "p.name", F.round(arrays.total("p.px"), 6).alias("product"), F.round(arrays.weighted("p.px"), 5).alias("weighted_product"))


_SHAPES = "shapes AS (SELECT 0.2 + i * 0.001 AS g, gamma(2 / (0.2::DOUBLE + i * 0.001::DOUBLE)) ** 2 / (gamma(1 / (0.2::DOUBLE + i * 0.001::DOUBLE)) * gamma(3 / (0.2::DOUBLE + i * 0.001::DOUBLE))) AS ratio FROM range(9800) r(i))"


@query(f"""WITH {_PIXELS}, {_SHAPES}, m AS (SELECT vec_id, var_pop(v) AS s, var_pop(v) / avg(abs(v)) ** 2 AS rho FROM pixels GROUP BY vec_id)
SELECT vec_id, round(arg_min(g::DOUBLE, abs(1 / ratio - rho)), 3) AS ggd_shape, round(any_value(s), 8) AS ggd_variance FROM m, shapes GROUP BY vec_id""")
def ggd_fit(spark, sf_dir):
    return frames.ggd_fit(_vectors(spark, sf_dir), "embedding").select("vec_id", F.round("ggd_shape", 3).alias("ggd_shape"), F.round("ggd_variance", 8).alias("ggd_variance"))


@query(f"""WITH {_PIXELS}, {_SHAPES}, m AS (SELECT vec_id, sqrt(coalesce(avg(v * v) FILTER (v < 0), 0)) AS l, sqrt(coalesce(avg(v * v) FILTER (v >= 0), 0)) AS r, avg(abs(v)) ** 2 / avg(v * v) AS h FROM pixels GROUP BY vec_id),
n AS (SELECT *, h * ((l / r) ** 3 + 1) * (l / r + 1) / ((l / r) ** 2 + 1) ** 2 AS rn FROM m),
f AS (SELECT vec_id, any_value(l) AS l, any_value(r) AS r, arg_min(g::DOUBLE, abs(ratio - rn)) AS a FROM n, shapes GROUP BY vec_id),
s AS (SELECT *, sqrt(gamma(1 / a) / gamma(3 / a)) AS k FROM f)
SELECT vec_id, round(a, 3) AS alpha, round(k * l, 6) AS "left", round(k * r, 6) AS "right", round((k * r - k * l) * gamma(2 / a) / gamma(1 / a), 6) AS bias FROM s""")
def aggd_fit(spark, sf_dir):
    return frames.aggd_fit(_vectors(spark, sf_dir), "embedding").select("vec_id", F.round("alpha", 3).alias("alpha"), *[F.round(c, 6).alias(c) for c in ("left", "right", "bias")])


@query(f"""WITH {_PAIRS}, m AS (SELECT vec_id, label, list_avg(px) AS ma, list_avg(prev) AS mb, list_avg(list_transform(range(1, 65), lambda i: px[i] * prev[i])) AS ab, list_avg(list_transform(px, lambda x: x * x)) AS aa, list_avg(list_transform(prev, lambda x: x * x)) AS bb FROM pairs WHERE prev IS NOT NULL),
s AS (SELECT vec_id, label, (2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (aa - ma * ma + bb - mb * mb + 0.0009)) AS s FROM m)
SELECT vec_id, label, round(s, 6) AS similarity, CASE WHEN (1 - s) * 100 < 1 THEN 1 WHEN (1 - s) * 100 < 2 THEN 0.5 ELSE 0.25 END::DOUBLE AS scale FROM s""")
def ssim_bucket(spark, sf_dir):
    pairs = with_neighbour(positions(_vectors(spark, sf_dir), "label", "vec_id").withColumn("px", _px()), "label", "px", "prev").where("prev is not null")
    found = pairs.withColumn("s", frames.ssim(F.col("px"), F.col("prev")))
    return found.select("vec_id", "label", F.round("s", 6).alias("similarity"), frames.scale_bucket(F.col("s")).alias("scale"))


@query(f"""WITH {_PLACED}, w AS (SELECT user_id, event_id, pos, value AS a, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c, lead(value, 3) OVER o AS d, lead(value, 4) OVER o AS e FROM placed WINDOW o AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, event_id, pos >= 1 AND coalesce(abs(b - c) < least(abs(a - b), abs(c - e)) AND abs(c - d) < least(abs(a - c), abs(d - e)) AND abs(b - d) < least(abs(a - b), abs(d - e)), false) AND e IS NOT NULL AS is_hit FROM w""")
def qframe_candidates(spark, sf_dir):
    return dedup.held_windows(_placed(spark, sf_dir), "user_id", "value", 5).select("user_id", "event_id", "is_hit")


@query(f"""WITH {_MEASURED}, ends AS (SELECT user_id, min(event_id) AS a, max(event_id) AS z FROM placed GROUP BY user_id)
SELECT user_id, event_id FROM measured EXCEPT (SELECT user_id, event_id FROM measured WHERE diff < 20 EXCEPT SELECT user_id, event_id FROM measured WHERE diff > {CUT} OR event_id % 10 = 0)
UNION SELECT user_id, a FROM ends UNION SELECT user_id, z FROM ends""")
def keep_minus_marked(spark, sf_dir):
    found, keys = _measured(spark, sf_dir), ["user_id", "event_id"]
    marked = found.where("diff < 20").select(*keys)
    scene = marked.join(found.where(f"diff > {CUT} or event_id % 10 = 0").select(*keys), keys, "left_semi")
    real = marked.join(scene, keys, "left_anti")
    ends = found.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).select("user_id", F.explode(F.array("a", "z")).alias("event_id"))
    return found.select(*keys).join(real, keys, "left_anti").unionByName(ends).distinct()


def _spread(q: str, length: int) -> str:
    """The score of a full queue of distances, as scene_score has it."""
    var, along = f"list_aggregate({q}, 'var_pop')", f"list_sum(list_transform(range(1, {length + 1}), lambda i: (i - {(length + 1) / 2}) * {q}[i]))"
    return f"(CASE WHEN {var} = 0 THEN 0 ELSE pow({var} * (1 + {along} ** 2 / ({length * (length**2 - 1) / 12} * {length} * {var})), 0.65) END)"


def labelled_sql(measured: str, pure: str = "false", length: int = LENGTH) -> str:
    """Recursive SQL for the scene labeller over (user_id, event_id, value, pos, diff) rows named measured; `pure` is an expression of a row e."""
    later = "(r.queue[2:] || [e.diff])"
    soft = f"({_spread(later, length)} - {_spread('r.queue', length)} > 12 AND e.diff > {scenes.BORN})"
    return f"""{measured}, labelled AS (SELECT user_id, event_id, value, pos, diff, []::DOUBLE[] AS queue, false AS black, false AS is_scene FROM measured WHERE pos = 0
  UNION ALL SELECT e.user_id, e.event_id, e.value, e.pos, e.diff,
    CASE WHEN e.diff < {scenes.EQUAL} OR r.black THEN r.queue WHEN e.diff > {scenes.HARD} THEN [] WHEN len(r.queue) < {length} THEN CASE WHEN list_contains(r.queue, e.diff) THEN r.queue ELSE r.queue || [e.diff] END WHEN {soft} THEN [] ELSE {later} END,
    e.diff < {scenes.EQUAL} AND (r.black OR {pure}),
    CASE WHEN e.diff < {scenes.EQUAL} THEN false WHEN r.black OR e.diff > {scenes.HARD} THEN true WHEN len(r.queue) < {length} THEN false ELSE {soft} END
  FROM labelled r JOIN measured e ON e.user_id = r.user_id AND e.pos = r.pos + 1)"""


_LABELLED = labelled_sql(_MEASURED)


@query(f"WITH RECURSIVE {_LABELLED} SELECT user_id, pos, diff, is_scene FROM labelled")
def scene_adaptive(spark, sf_dir):
    return scenes.scene_adaptive(_measured(spark, sf_dir), "user_id", "diff", F.lit(False), LENGTH, 12.0)


def _folded(value: str, key: str, threshold: float, cap: int) -> str:
    """Recursive SQL for anchor dedup over (user_id, key, value, pos) rows named src."""
    join = f"abs(e.{value} - r.anchor) < {threshold} AND r.absorbed < {cap}"
    return f"""folded AS (SELECT user_id, {key}, {value}, pos, {value} AS anchor, 0 AS absorbed FROM src WHERE pos = 0
  UNION ALL SELECT e.user_id, e.{key}, e.{value}, e.pos, CASE WHEN {join} THEN r.anchor ELSE e.{value} END, CASE WHEN {join} THEN r.absorbed + 1 ELSE 0 END FROM folded r JOIN src e ON e.user_id = r.user_id AND e.pos = r.pos + 1)"""


@query(f"WITH RECURSIVE {_PLACED.replace('placed AS', 'src AS')}, {_folded('value', 'event_id', NEAR, CAP)} SELECT user_id, event_id, absorbed, absorbed = 0 AS kept FROM folded")
def dedup_anchor(spark, sf_dir):
    return dedup.dedup_anchor(_placed(spark, sf_dir), "user_id", "value", NEAR, CAP, ["event_id"]).select("user_id", "event_id", "absorbed", "kept")


def _held_sql(mode: int, batch: int) -> str:
    """SQL of held drawings: windows of q rows by leads, taken from left to right, and the rows that they drop, by growing q."""
    parts, gone = [], "SELECT NULL::BIGINT AS user_id, NULL::BIGINT AS batch, NULL::BIGINT AS i WHERE false"
    for q in range(4, mode + 3):
        at = ["value", *[f"lead(value, {k}) OVER w" for k in range(1, q)]]
        near = [f"abs({at[a]} - {at[b]}) < least(abs({at[0]} - {at[a]}), abs({at[b]} - {at[q - 1]}))" for a in range(1, q - 2) for b in range(a + 1, q - 1)]
        parts.append(f"hit{q} AS (SELECT user_id, batch, i, i >= 1 AND i + {q} <= n AND coalesce({' AND '.join(near)}, false) AS hit FROM rows_ WINDOW w AS (PARTITION BY user_id, batch ORDER BY i))")
        parts.append(f"took{q} AS (SELECT user_id, batch, i, 1::BIGINT AS free, false AS took FROM hit{q} WHERE i = 0 UNION ALL SELECT h.user_id, h.batch, h.i, CASE WHEN h.hit AND h.i >= t.free THEN h.i + {q - 2} ELSE t.free END, h.hit AND h.i >= t.free FROM took{q} t JOIN hit{q} h ON h.user_id = t.user_id AND h.batch = t.batch AND h.i = t.i + 1)")
        parts.append(f"gone{q} AS ({gone} UNION ALL SELECT user_id, batch, i + k FROM took{q} t, range(1, {q - 2}) r(k) WHERE took AND NOT EXISTS (SELECT 1 FROM ({gone}) g WHERE g.user_id = t.user_id AND g.batch = t.batch AND g.i = t.i))")
        gone = f"SELECT user_id, batch, i FROM gone{q}"
    rows = f"rows_ AS (SELECT user_id, pos, value, pos // {batch} AS batch, pos % {batch} AS i, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) > {CUT}, false) AS scene, count(*) OVER (PARTITION BY user_id, pos // {batch}) AS n FROM placed)"
    return f"WITH RECURSIVE {_PLACED}, {rows}, {', '.join(parts)} SELECT user_id, pos, value, NOT (EXISTS ({gone} g WHERE g.user_id = r.user_id AND g.batch = r.batch AND g.i = r.i) AND NOT scene AND i NOT IN (0, n - 1)) AS kept FROM rows_ r"


@query(_held_sql(4, 200))
def dedup_qframe(spark, sf_dir):
    placed = with_neighbour(_placed(spark, sf_dir), "user_id", "value", "prev")
    scene = F.coalesce(F.abs(F.col("value") - F.col("prev")) > CUT, F.lit(False))
    return dedup.dedup_held(placed.withColumn("scene", scene), "user_id", "value", "scene", mode=4)


@query(f"""WITH RECURSIVE {_GRID}, src AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS pos FROM resampled WHERE value IS NOT NULL), {_folded('value', 't', 30.0, 8)},
anchors AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS run FROM folded WHERE absorbed = 0),
runs AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos), (SELECT max(pos) + 1 FROM src s WHERE s.user_id = a.user_id)) - pos - 1 AS n, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), value) AS nxt FROM anchors a)
SELECT user_id, (pos + k)::BIGINT AS pos, k AS sub_no, (pos + k) // {GAP} AS chunk_id, round(CASE WHEN k = 0 THEN value ELSE value * (1 - k / (n + 1)) + nxt * (k / (n + 1)) END, 6) AS value FROM (SELECT *, unnest(range(n + 1))::INT AS k FROM runs)""")
def interp_pipeline(spark, sf_dir):
    """Resample, drop near-equal runs, fill the gaps by interpolation, chunk: as many rows out as the grid has."""
    grid = positions(_resampled(spark, sf_dir).where("value is not null"), "user_id", "t", width=STEP * 4096)
    runs = dedup.dedup_anchor(grid, "user_id", "value", 30.0, 8, ["t", "value"])
    # an anchor's gap: how far the run's last row is, which is the `absorbed` of the row before the next anchor
    size = runs.withColumn("run", F.col("pos") - F.col("absorbed")).groupBy("user_id", "run").agg(F.max("absorbed").alias("n"), F.max(F.when(F.col("kept"), F.col("value"))).alias("value"))
    made = fill.fill_runs(size, "user_id", "value")
    pos = (F.col("run") + F.col("sub_no")).alias("pos")
    return made.select("user_id", pos, "sub_no", F.floor(pos / GAP).alias("chunk_id"), F.round("value", 6).alias("value"))
