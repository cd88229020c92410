"""Queries about options, stream information, metadata, clips and joins of streams, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, rules, scalars
from ..operators import chunks, dedup, fill, relate, scenes
from ..operators.sequences import positions, slice_width, value_at, with_neighbour
from ..sources import probe
from ..sources.scratch import remove_at_exit, scratch_dir, written
from .catalog import CUT, GAP, STEP, _events, _GRID, _MEASURED, _placed, _PLACED, _resampled, query, XML, xml_sql



def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")


_PATHS = ["abme_best/", "some_anytime_v1_anime/", "Anime_Sharp/", "anime_smooth_v2/", "anime_training/", "official_2.3/", "official_3.x/", "official_v6_2/", "official_4.6/", "official/", "xvfi/", "other/"]
_PATH_LIST = ", ".join(f"'{p}'" for p in _PATHS)


@query(f"""WITH m AS (SELECT p_partkey, lower([{_PATH_LIST}][p_size % 12 + 1] || p_name) AS path FROM part)
SELECT p_partkey, CASE WHEN contains(path, 'abme_best') THEN 'abme' WHEN contains(path, 'anytime') THEN 'any_time' WHEN contains(path, 'anime') AND (contains(path, 'sharp') OR contains(path, 'smooth')) THEN 'v2' WHEN contains(path, 'anime') THEN 'v6'
  WHEN contains(path, 'official') THEN CASE WHEN contains(path, '2.') THEN 'v2' WHEN contains(path, '3.') THEN 'v3' WHEN contains(path, 'v6') THEN 'v6' WHEN contains(path, '4.') THEN 'v4' ELSE 'v7' END
  WHEN contains(path, 'xvfi') THEN 'xvfi' ELSE 'v2' END AS family FROM m""")
def model_family(spark, sf_dir):
    path = F.concat(F.element_at(F.array(*[F.lit(p) for p in _PATHS]), F.col("p_size") % 12 + 1), "p_name")
    return _parts(spark, sf_dir).select("p_partkey", rules.model_family(path).alias("family"))


_INFO = ["{}", "{dv_profile: 8}", "side: Mastering Display metadata", "Content light level metadata", "side: DOVI record"]
_TRANSFER = ["smpte2084", "bt2020-10", "arib-std-b67", "bt709", None]


@query(f"""WITH t AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _INFO)}][p_size % 5 + 1] AS info, ['smpte2084', 'bt2020-10', 'arib-std-b67', 'bt709', NULL][p_partkey % 5 + 1] AS trc, p_size % 3 = 0 AS plus, p_partkey % 4 = 1 AS click FROM part)
SELECT p_partkey, CASE WHEN contains(info, 'dv_profile') OR contains(info, 'DOVI') THEN 'dolby_vision' WHEN trc IS NULL THEN 'none'
  WHEN contains(trc, 'smpte2084') OR contains(trc, 'bt2020') THEN CASE WHEN NOT regexp_matches(lower(info), 'mastering[- ]display|content light level metadata') THEN 'custom_hdr' WHEN plus THEN 'hdr10_plus' ELSE 'hdr10' END
  WHEN contains(trc, 'arib-std-b67') THEN 'hlg' WHEN click THEN 'hdr10' ELSE 'none' END AS state FROM t""")
def hdr_state(spark, sf_dir):
    at = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), i)
    state = rules.hdr_state(at(_INFO, F.col("p_size") % 5 + 1), at(_TRANSFER, (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_size") % 3 == 0, F.col("p_partkey") % 4 == 1)
    return _parts(spark, sf_dir).select("p_partkey", state.alias("state"))


_DEFAULTS = {"exp": "2", "size": "0", "brand": "none", "name": ""}


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END, '0') AS size, coalesce(CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 3 = 0 THEN p_brand END, 'none') AS brand, '2' AS exp, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS name FROM part")
def option_defaults(spark, sf_dir):
    """Options from a file with defaults, and then two that the command line overrides."""
    some = F.map_filter(F.create_map(F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("brand"), F.when(F.col("p_size") % 5 == 0, F.lit("x")).when(F.col("p_size") % 3 == 0, F.col("p_brand"))), lambda _, v: v.isNotNull())
    by = F.map_filter(F.create_map(F.lit("brand"), F.when(F.col("p_size") % 5 == 0, F.lit("")), F.lit("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))), lambda _, v: v.isNotNull())
    made = _parts(spark, sf_dir).select("p_partkey", rules.overridden(rules.with_defaults(some, _DEFAULTS), by).alias("o"))
    return made.select("p_partkey", *[F.col("o")[k].alias(k) for k in _DEFAULTS])


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(['matrix=' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, 'range=' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END], lambda x: NOT suffix(x, '='))), ',') AS tags FROM part")
def colour_tags(spark, sf_dir):
    tags = F.create_map(F.lit("matrix"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("range"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")))
    listed = F.array_join(F.sort_array(F.transform(F.map_entries(rules.non_empty(tags)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return _parts(spark, sf_dir).select("p_partkey", listed.alias("tags"))


_COMMAND = "'-x265 || a=' || p_size || '||-map|| -c || ' || p_brand || '||stray|| -x265||-b||' || chr(92) || chr(34) || p_name || chr(92) || chr(34) || CASE WHEN p_size % 2 = 0 THEN '||-last' ELSE '||-map||v' END"


@query(f"""WITH c AS (SELECT p_partkey, string_split({_COMMAND}, '||') AS l FROM part), u AS (SELECT p_partkey, unnest(range(len(l))) AS i, l FROM c),
t AS (SELECT p_partkey, i, trim(replace(trim(l[i + 1]), chr(92) || chr(34), chr(34)), chr(92)) AS x FROM u),
n AS (SELECT *, lead(x) OVER w AS nxt, lag(x) OVER w AS prv FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
p AS (SELECT p_partkey, i, CASE WHEN x[1] = '-' THEN x ELSE '' END AS flag, CASE WHEN x[1] <> '-' THEN x WHEN nxt IS NULL OR nxt[1] = '-' THEN '' ELSE nxt END AS value FROM n WHERE x[1] = '-' OR prv IS NULL OR prv[1] <> '-')
SELECT p_partkey, flag, arg_max(value, i) AS value FROM p GROUP BY ALL""")
def command_options(spark, sf_dir):
    quote = '\\"'
    parts = ["-x265 || a=", F.col("p_size").cast("string"), "||-map|| -c || ", F.col("p_brand"), f"||stray|| -x265||-b||{quote}", F.col("p_name"), quote, F.when(F.col("p_size") % 2 == 0, "||-last").otherwise("||-map||v")]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return _parts(spark, sf_dir).select("p_partkey", F.explode(rules.command_options(text)).alias("o")).select("p_partkey", "o.flag", "o.value")


_NAMED = [("p_size % 2 = 0", "'2x'"), ("p_size % 3 = 0", "'SLM' || p_size"), ("p_brand < 'Brand#2'", "'SR'")]


@query(f"SELECT p_partkey, concat_ws('.', p_name, {', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in _NAMED)}, 'mp4') AS name FROM part")
def output_name(spark, sf_dir):
    tags = [(F.col("p_size") % 2 == 0, F.lit("2x")), (F.col("p_size") % 3 == 0, F.concat(F.lit("SLM"), F.col("p_size").cast("string"))), (F.col("p_brand") < "Brand#2", F.lit("SR"))]
    return _parts(spark, sf_dir).select("p_partkey", rules.output_name(F.col("p_name"), tags, F.lit("mp4")).alias("name"))


_RULES = "(NULL, NULL, NULL, 90, 'fallback'), ('ECONOMY', NULL, NULL, 50, 'economy'), ('ECONOMY', 'Brand#2', NULL, 20, 'economy-2'), (NULL, 'Brand#4', '1', 30, 'four-odd'), ('SMALL', NULL, '0', 40, 'small-even'), ('SMALL', 'Brand#4', '1', 10, 'small-four')"


@query(f"""WITH r(p_type, p_brand, depth, priority, options) AS (VALUES {_RULES})
SELECT p.p_partkey, arg_min(r.options, r.priority) AS options FROM part p JOIN r ON (r.p_type IS NULL OR r.p_type = p.p_type) AND (r.p_brand IS NULL OR r.p_brand = p.p_brand) AND (r.depth IS NULL OR r.depth = (p.p_size % 2)::VARCHAR) GROUP BY p.p_partkey""")
def option_plan(spark, sf_dir):
    table = spark.sql(f"SELECT * FROM VALUES {_RULES} AS r(p_type, p_brand, depth, priority, options)")
    asked = _parts(spark, sf_dir).select("p_partkey", "p_type", "p_brand", (F.col("p_size") % 2).cast("string").alias("depth"))
    return rules.plan_options(asked, table, ["p_type", "p_brand", "depth"], "p_partkey").select("p_partkey", "options")


_CLIP = """clips AS (SELECT user_id, count(*) * 3600.0::DOUBLE AS duration, CASE WHEN user_id % 4 = 0 THEN NULL ELSE (user_id % 30) * 3600 + 90.5 END::DOUBLE AS b, CASE WHEN user_id % 5 = 0 THEN NULL ELSE (user_id % 40) * 3600 END::DOUBLE AS e FROM events GROUP BY user_id),
ready AS (SELECT *, (b IS NOT NULL OR e IS NOT NULL) AND coalesce(e, duration) > coalesce(b, 0) AS cut FROM clips)"""


@query(f"WITH {_PLACED}, {_CLIP} SELECT p.user_id, p.event_id, p.pos FROM placed p JOIN ready r USING (user_id) WHERE NOT cut OR p.pos * 3600.0 BETWEEN coalesce(b, 0) AND coalesce(e, duration)")
def clip_range(spark, sf_dir):
    """The rows of each sequence, taken as one an hour, between two clock texts; an inverted range reads everything."""
    placed, user = _placed(spark, sf_dir), F.col("user_id")
    hours = lambda n, rest: F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit(rest))
    begin, end = scalars.seconds_of(F.when(user % 4 != 0, hours(user % 30, ":01:30.5"))), scalars.seconds_of(F.when(user % 5 != 0, hours(user % 40, ":00:00")))
    clips = placed.groupBy("user_id").agg((F.count("*") * 3600.0).alias("duration")).select("user_id", rules.clip(begin, end, F.col("duration")).alias("c"))
    t = F.col("pos") * 3600.0
    return placed.join(clips, "user_id").where(F.col("c").isNull() | t.between(F.col("c.begin"), F.col("c.end"))).select("user_id", "event_id", "pos")


@query("SELECT user_id, round(count(*) FILTER (value > 20) / count(*), 6) AS share, count(*) FILTER (value > 20) / count(*) < 0.8 AS short FROM events GROUP BY user_id")
def progress(spark, sf_dir):
    share, short = rules.progress(F.count_if(F.col("value") > 20), F.count("*"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(share, 6).alias("share"), short.alias("short"))


#: XML probes of parts, some of them broken.
_SOME_BROKEN = f"CASE WHEN p_partkey % 89 = 0 THEN '<broken' ELSE {XML} END"
_XML_SQL = xml_sql(f"SELECT p_partkey, {_SOME_BROKEN} FROM part")


def _xml(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(_SOME_BROKEN).alias("t"))


@query(f"WITH {_XML_SQL} SELECT id, codec_type, codec_name, width FROM k")
def probe_xml_streams(spark, sf_dir):
    return probe.streams_xml(_xml(spark, sf_dir), "t").select("id", "codec_type", F.col("s._codec_name").alias("codec_name"), F.col("s._width").alias("width"))


@query(f"WITH {_XML_SQL} SELECT id, codec_type, codec_name, width FROM k WHERE id NOT IN (SELECT id FROM k WHERE n > 1)")
def probe_xml_guarded(spark, sf_dir):
    return probe.streams_xml(_xml(spark, sf_dir), "t", guard=True).select("id", "codec_type", F.col("s._codec_name").alias("codec_name"), F.col("s._width").alias("width"))




@query("""WITH k AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'video' ELSE 'audio' END AS codec_type, l_linenumber, l_partkey, l_quantity FROM lineitem)
SELECT l_orderkey, codec_type, arg_max(l_partkey, l_linenumber) AS width, arg_max(l_quantity::INT::VARCHAR, l_linenumber) AS nb_frames FROM (SELECT l_orderkey, codec_type, l_linenumber, max(l_partkey) AS l_partkey, arg_max(l_quantity, l_partkey * 1000 + l_quantity) AS l_quantity FROM k GROUP BY ALL HAVING true) GROUP BY l_orderkey, codec_type""")
def probe_json_last(spark, sf_dir):
    """Documents of streams made from an order's lines; the last stream of each kind counts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_partkey", "l_quantity")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    stream = F.struct(F.col("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 1, "video").otherwise("audio").alias("codec_type"), F.col("l_partkey").alias("width"), F.col("l_quantity").cast("int").cast("string").alias("nb_frames"))
    docs = lines.groupBy("l_orderkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(stream)).alias("streams"))).alias("t"))
    return probe.streams_json(docs, "t", last=True).select("l_orderkey", "codec_type", F.col("s.width").alias("width"), F.col("s.nb_frames").alias("nb_frames"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 10 ELSE p_size END::BIGINT AS width, (p_size * 20)::BIGINT AS height, CASE WHEN p_size % 4 = 0 THEN 24.0 ELSE 30.0 END::DOUBLE AS rate, (p_size + 100)::BIGINT AS frames, round((p_size + 100) / CASE WHEN p_size % 4 = 0 THEN 24.0 ELSE 30.0 END, 6)::DOUBLE AS duration FROM part""")
def probe_fallback(spark, sf_dir):
    size = F.col("p_size").cast("long")
    first = _parts(spark, sf_dir).select("p_partkey", F.when(size % 3 != 0, size).otherwise(0).alias("width"), F.lit(None).cast("long").alias("height"), F.when(size % 4 == 0, 0.0).otherwise(30.0).alias("rate"), F.lit(0).cast("long").alias("frames"))
    other = _parts(spark, sf_dir).select("p_partkey", (size * 10).alias("width"), (size * 20).alias("height"), F.lit(24.0).alias("rate"), (size + 100).alias("frames"))
    return probe.with_fallback(first, other, ["p_partkey"]).withColumn("duration", F.round("duration", 6))


@query("SELECT p_brand, count(*) * 4 AS n_frames, arg_min(p_size, lpad(p_partkey::VARCHAR, 8, '0')) AS width, arg_min(p_size * 2, lpad(p_partkey::VARCHAR, 8, '0')) AS height FROM part GROUP BY p_brand")
def image_set(spark, sf_dir):
    files = _parts(spark, sf_dir).select("p_brand", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("name"), F.col("p_size").alias("width"), (F.col("p_size") * 2).alias("height"))
    return probe.image_set(files, "name", "width", "height", 2, ["p_brand"])


_META = """docs AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN [] ELSE list({'n': -pos, 'k': (json_extract_string(props, '$.k'))::BIGINT} ORDER BY pos) END AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) GROUP BY user_id),
scenes AS (SELECT user_id, unnest(l) AS e FROM docs), sorted AS (SELECT user_id, e.k AS k, row_number() OVER (PARTITION BY user_id ORDER BY e.n) - 1 AS i FROM scenes),
indexed AS (SELECT user_id, i * 2 + c AS idx, k FROM sorted, range(2) r(c))"""


def _metadata(spark, sf_dir):
    """A metadata document for each sequence, its scenes in reverse and their numbers as text; some documents are broken or absent."""
    scene = F.struct((-F.col("pos")).alias("n"), (-F.col("pos")).cast("string").alias("SceneFrameIndex"), F.from_json("props", "k bigint")["k"].alias("k"))
    docs = _placed(spark, sf_dir, "props").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(scene).alias("SceneInfo"))).alias("doc"))
    docs = docs.withColumn("doc", F.when(F.col("user_id") % 14 == 0, "{broken").when(F.col("user_id") % 7 != 0, F.col("doc")))
    return chunks.index_metadata(docs, "doc", 2)


@query(f"WITH {_META} SELECT user_id, idx::BIGINT AS idx, k FROM indexed")
def metadata_index(spark, sf_dir):
    return _metadata(spark, sf_dir).select("user_id", "idx", F.col("entry")["k"].cast("bigint").alias("k"))


@query(f"""WITH {_META}, starts AS (SELECT user_id, unnest([-1, 0, {GAP}, 120, 5000]) AS start FROM docs), ends AS (SELECT user_id, count(*) AS n FROM indexed GROUP BY user_id)
SELECT s.user_id, s.start::BIGINT AS start, CASE WHEN s.start < 0 OR e.n IS NULL OR s.start > e.n THEN '' ELSE coalesce((SELECT '[' || string_agg('{{"SceneFrameIndex":' || idx || ',"k":"' || k || '"}}', ',' ORDER BY idx) || ']' FROM indexed i WHERE i.user_id = s.user_id AND i.idx BETWEEN s.start AND s.start + {GAP - 1}), '[]') END AS slice FROM starts s LEFT JOIN ends e ON e.user_id = s.user_id""")
def metadata_slice(spark, sf_dir):
    starts = _events(spark, sf_dir).select("user_id").distinct().withColumn("start", F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0, GAP, 120, 5000)])))
    return chunks.metadata_slice(_metadata(spark, sf_dir), starts, "user_id", GAP, ["k"])


@query(f"WITH {_PLACED} SELECT a.user_id, a.event_id, b.event_id AS full_event, b.value FROM placed a JOIN placed b ON a.user_id = b.user_id AND a.pos = b.pos + 1 WHERE a.event_id % 3 = 0")
def co_scan(spark, sf_dir):
    check = _placed(spark, sf_dir).where("event_id % 3 = 0").select("user_id", (F.col("pos") - 1).alias("pos"), "event_id")
    full = _placed(spark, sf_dir).select("user_id", "pos", F.col("event_id").alias("full_event"), "value")
    return relate.co_scan(check, full, ["user_id", "pos"]).select("user_id", "event_id", "full_event", "value")


@query("WITH k AS (SELECT p_partkey % 50 AS a, p_size AS b, min(p_partkey) AS d FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL), q AS (SELECT p_partkey, p_partkey % 50 AS a, p_size AS b FROM part) SELECT q.p_partkey, coalesce(x.d, y.d) AS d FROM q LEFT JOIN k x ON x.a = q.a AND x.b = q.b LEFT JOIN k y ON y.a = q.b AND y.b = q.a")
def symmetric_lookup(spark, sf_dir):
    pairs = _parts(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 50).alias("a"), F.col("p_size").cast("long").alias("b"))
    known = pairs.where("p_partkey % 3 = 0").select("a", "b", F.col("p_partkey").alias("d"))
    return relate.symmetric_lookup(pairs, known, "a", "b").select("p_partkey", "d")


_TYPED = "typed AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events)"


@query(f"WITH {_TYPED} SELECT v.user_id, v.n, v.event_id, a.event_id AS audio_event_id, s.event_id AS subtitle_event_id FROM typed v LEFT JOIN typed a ON a.user_id = v.user_id AND a.n = v.n AND a.event_type = 'click' LEFT JOIN typed s ON s.user_id = v.user_id AND s.n = v.n AND s.event_type = 'error' WHERE v.event_type = 'view'")
def stream_mux(spark, sf_dir):
    def stream(kind):
        rows = _events(spark, sf_dir, "event_type").where(F.col("event_type") == kind)
        return positions(rows, "user_id", "event_id").select("user_id", F.col("pos").alias("n"), "event_id")

    return relate.mux(stream("view"), {"audio": stream("click"), "subtitle": stream("error")}, ["user_id", "n"])


@query("SELECT p_partkey, length(p_type) * 100 + length(p_brand) AS made FROM part")
def once_per_content(spark, sf_dir):
    """Each distinct pair of type and brand is worked on once."""
    work = lambda df: df.withColumn("made", F.length("p_type") * 100 + F.length("p_brand"))
    return relate.once_per_content(_parts(spark, sf_dir), ["p_type", "p_brand"], work).select("p_partkey", "made")


@query("""WITH t AS (SELECT user_id, event_id, epoch_us(ts) AS t0, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS t1, max(epoch_us(ts)) OVER () AS t2 FROM events)
SELECT user_id, event_id, (coalesce(t1, t2) - t0) // 86400000000 AS n_overdue FROM t WHERE (coalesce(t1, t2) - t0) // 86400000000 > 0""")
def overdue(spark, sf_dir):
    """Tasks that begin with an event and are done at the sequence's next; the interval is a day."""
    placed = _placed(spark, sf_dir, "ts").select("user_id", "event_id", "pos", scalars.micros("ts").alias("t0"))
    now = placed.agg(F.max("t0").alias("now"))
    tasks = with_neighbour(placed, "user_id", "t0", "t1", step=1).withColumn("day", F.lit(86_400_000_000)).join(F.broadcast(now))  # one row
    return relate.overdue(tasks, "t0", "day", "t1", "now").select("user_id", "event_id", "n_overdue")


@query(f"WITH {_MEASURED} SELECT user_id, event_id, coalesce(count(*) FILTER (diff < 5) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0) = 0 AS none_near FROM measured")
def rolling_emptiness(spark, sf_dir):
    from ..operators.sequences import block_window, in_blocks

    measured = scenes.pair_distance(_events(spark, sf_dir), "user_id", "event_id", "value", lambda a, b: F.abs(a - b))
    near = F.count(F.when(F.col("diff") < 5, 1)).over(block_window("user_id").rowsBetween(-8, 0))
    return in_blocks(measured, before=8).withColumn("none_near", near == 0).where("own").select("user_id", "event_id", "none_near")


@query(f"WITH {_MEASURED} SELECT user_id, round(median(diff), 6) AS median, round(regr_slope(diff, pos), 6) AS slope, round(regr_intercept(diff, pos), 5) AS intercept FROM measured GROUP BY user_id")
def distance_trend(spark, sf_dir):
    """The median distance of each sequence, found by places in the order of the distances, and the line through them."""
    measured = written(scenes.pair_distance(_events(spark, sf_dir), "user_id", "event_id", "value", lambda a, b: F.abs(a - b)).select("user_id", "pos", "diff"))
    ordered = measured.where("diff IS NOT NULL").select("user_id", "diff", F.floor(F.col("diff") * 1000).alias("milli"))
    median = value_at(positions(ordered, "user_id", ["milli", "diff"], slice_width(ordered, "milli")), "user_id", "diff", 0.5)
    pos = F.col("pos").cast("double")
    line = measured.groupBy("user_id").agg(F.round(F.regr_slope(F.col("diff"), pos), 6).alias("slope"), F.round(F.regr_intercept(F.col("diff"), pos), 5).alias("intercept"))
    return line.join(median.select("user_id", F.round("diff", 6).alias("median")), "user_id", "left")


@query("""SELECT 'supplier' AS kind, s_suppkey AS key, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'customer', c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def dimension_lookup(spark, sf_dir):
    """Names looked up in small tables by their keys; a key that the table lacks has none."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    side = lambda name, key, nation: table(name).select(F.lit(name).alias("kind"), F.col(key).alias("key"), F.col(nation).alias("n_nationkey"))
    both = side("supplier", "s_suppkey", "s_nationkey").unionByName(side("customer", "c_custkey", "c_nationkey"))
    return both.join(places, "n_nationkey", "left").select("kind", "key", "nation", "region")


@query(f"WITH {_PLACED}, ahead AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), value) AS nxt FROM placed) SELECT user_id, event_id, k AS sub_no, round(CASE WHEN k = 0 OR (event_id % 25 > 20 AND value < 40) THEN value ELSE value * (1 - k / (event_id % 25 + 1)) + nxt * (k / (event_id % 25 + 1)) END, 6) AS value FROM (SELECT *, unnest(range(event_id % 25 + 1))::INT AS k FROM ahead)")
def fill_pure_runs(spark, sf_dir):
    return fill.fill(_placed(spark, sf_dir), "user_id", "value", F.col("event_id") % 25, pure=F.col("value") < 40).select("user_id", "event_id", "sub_no", F.round("value", 6).alias("value"))


@query(f"WITH {_PLACED}, ahead AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), value) AS nxt FROM placed) SELECT user_id, pos, k AS sub_no, round(CASE WHEN k = 0 THEN value ELSE value * (1 - k / (event_id % 4 + 1)) + nxt * (k / (event_id % 4 + 1)) END, 6) AS value FROM (SELECT *, unnest(range(event_id % 4 + 1))::INT AS k FROM ahead)")
def fill_model(spark, sf_dir):
    """Rows between two made by a model over batches of pairs; here it is a linear one."""

    def linear_model(a, b, n):
        import numpy as np

        t = np.arange(1, n + 1) / (n + 1)
        return a[:, None] * (1 - t) + b[:, None] * t

    return fill.fill_with(_placed(spark, sf_dir), "user_id", "value", F.col("event_id") % 4, linear_model).withColumn("value", F.round("value", 6))


@query(f"""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '.tar.gz' ELSE '' END AS base, p_name || CASE WHEN p_size % 2 = 0 THEN '.tar' ELSE '' END AS stem, chr(34) || p_name || chr(34) AS quoted, md5(p_name) AS digest,
  strlen(p_name || CASE WHEN p_size % 3 = 0 THEN 'é' ELSE '' END) <> length(p_name || CASE WHEN p_size % 3 = 0 THEN 'é' ELSE '' END) AS other, printf('%.3f', p_size / 32.0::DOUBLE) AS seconds, round_even(p_size / 2.0, 0)::DOUBLE AS even_half,
  ceil(sqrt(p_size / 3.0))::BIGINT AS factor, (p_size + (32 - p_size % 32) % 32)::BIGINT AS padded, least(greatest(p_size / 10.0, 1.5), 4.0)::DOUBLE AS clamped, round(1 / (1 + exp(-p_size / 10.0::DOUBLE)), 9) AS sigmoid FROM part""")
def scalar_functions(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    path = F.concat(F.lit("/data/"), F.col("p_type"), F.lit(".d\\"), name, F.when(size % 2 == 0, ".tar.gz").otherwise(""))
    return _parts(spark, sf_dir).select(
        "p_partkey", scalars.basename(path).alias("base"), scalars.stem(path).alias("stem"), scalars.quoted(F.when(size % 2 == 0, scalars.quoted(name)).otherwise(name)).alias("quoted"), F.md5(name).alias("digest"),
        scalars.has_non_ascii(F.concat(name, F.when(size % 3 == 0, "é").otherwise(""))).alias("other"), scalars.frame_seconds(size, F.lit(32.0)).alias("seconds"), scalars.half_even(size / 2).alias("even_half"),
        scalars.scale_factor(size.cast("double"), F.lit(3.0)).alias("factor"), scalars.ceil_to(size, 32).alias("padded"), scalars.clamp(size / 10, 1.5, 4.0).alias("clamped"), F.round(scalars.sigmoid(size / 10), 9).alias("sigmoid"),
    )


@query("SELECT p_partkey, p_name, p_size FROM part")
def xml_round_trip(spark, sf_dir):
    """Rows dumped as XML texts and parsed again."""
    dumped = _parts(spark, sf_dir).select("p_partkey", F.to_xml(F.struct("p_name", "p_size"), {"rowTag": "part"}).alias("t"))
    return dumped.select("p_partkey", F.from_xml("t", "p_name string, p_size int", {"rowTag": "part"}).alias("x")).select("p_partkey", "x.p_name", "x.p_size")


def known_grid(spark, sf_dir):
    """The resampled sequences' rows that have a value."""
    return _resampled(spark, sf_dir).where("value is not null").withColumn("t", F.col("t").cast("long"))


def _scene_runs(spark, sf_dir):
    """Runs of the resampled sequences that end at the cap, at a far row or at a scene's first row."""
    grid = written(positions(known_grid(spark, sf_dir), "user_id", "t", width=STEP * 4096))
    rows = with_neighbour(grid, "user_id", "value", "prev").withColumn("scene", F.coalesce(F.abs(F.col("value") - F.col("prev")) > CUT, F.lit(False)))
    runs = dedup.dedup_anchor(rows, "user_id", "value", 30.0, 8, ["value", "scene"], scene="scene").withColumn("run", F.col("pos") - F.col("absorbed"))
    size = runs.groupBy("user_id", "run").agg(F.max("absorbed").cast("int").alias("n"), F.min_by("value", F.when(F.col("absorbed") > 0, F.col("absorbed"))).alias("first"), F.max_by("value", "absorbed").alias("last"), F.min_by("value", "absorbed").alias("value"), F.min_by("scene", "absorbed").alias("scene"))
    return written(size)


_RUNS = f"""{_GRID}, base AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS pos FROM resampled WHERE value IS NOT NULL),
src AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) > {CUT}, false) AS scene FROM base),
folded AS (SELECT user_id, value, pos, scene, value AS anchor, 0 AS absorbed FROM src WHERE pos = 0
  UNION ALL SELECT e.user_id, e.value, e.pos, e.scene, CASE WHEN NOT e.scene AND abs(e.value - r.anchor) < 30 AND r.absorbed < 8 THEN r.anchor ELSE e.value END, CASE WHEN NOT e.scene AND abs(e.value - r.anchor) < 30 AND r.absorbed < 8 THEN r.absorbed + 1 ELSE 0 END FROM folded r JOIN src e ON e.user_id = r.user_id AND e.pos = r.pos + 1),
runs AS (SELECT user_id, pos - absorbed AS run, max(absorbed) AS n, arg_min(value, absorbed) FILTER (absorbed > 0) AS first, arg_max(value, absorbed) AS last, arg_min(value, absorbed) AS value, arg_min(scene, absorbed) AS scene FROM folded GROUP BY ALL),
ahead AS (SELECT *, lead(value) OVER w AS nxt, coalesce(lead(scene) OVER w, true) AS cut FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY run))"""
_FILLED = "SELECT user_id, (run + k)::BIGINT AS pos, k AS sub_no, round(CASE WHEN k = 0 THEN value ELSE value * (1 - k / s) + target * (k / s) END, 6) AS value FROM (SELECT *, unnest(range(n + 1))::INT AS k FROM targets)"


@query(f"WITH RECURSIVE {_RUNS}, targets AS (SELECT *, CASE WHEN nxt IS NULL THEN last WHEN cut THEN first ELSE nxt END AS target, CASE WHEN nxt IS NOT NULL AND cut THEN greatest(n, 1) ELSE n + 1 END AS s FROM ahead) {_FILLED}")
def interp_scene_pipeline(spark, sf_dir):
    """Resample, drop near-equal runs within scenes, fill the gaps without blending across scenes; rows out as rows in."""
    made = fill.fill_scenes(_scene_runs(spark, sf_dir), "user_id", "value")
    return made.select("user_id", (F.col("run") + F.col("sub_no")).alias("pos"), "sub_no", F.round("value", 6).alias("value"))


@query(f"WITH RECURSIVE {_RUNS}, targets AS (SELECT *, coalesce(nxt, last) AS target, n + 1 AS s FROM ahead) {_FILLED}")
def interp_scene_mix(spark, sf_dir):
    """As interp_scene_pipeline, with fades into the first row of a scene."""
    made = fill.fill_scenes(_scene_runs(spark, sf_dir), "user_id", "value", mix=True)
    return made.select("user_id", (F.col("run") + F.col("sub_no")).alias("pos"), "sub_no", F.round("value", 6).alias("value"))


def _bytes(a):
    """Numbers from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


@query("SELECT (k // 2 * 2 + c) AS frame_no, lpad(vec_id::VARCHAR, 8, '0') || '.png' AS name, 64::BIGINT AS size FROM (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) * 2 AS k FROM embeddings), range(2) r(c) WHERE k // 2 * 2 + c >= 3")
def image_sequence(spark, sf_dir):
    """Frames written as a folder of numbered images, and the folder read again, each image twice, from frame 3 on."""
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", _bytes(F.transform(arrays.doubles(F.col("embedding")), lambda x: F.floor((x + 1) * 127.5))).alias("px"))
    folder = scratch_dir(spark)
    remove_at_exit(spark, folder)
    probe.write_images(frames, folder, "vec_id", "px").agg(F.sum("size")).first()
    return probe.image_folder(spark, folder, exponent=1, start=3).select("frame_no", "name", F.length("content").cast("long").alias("size"))


@query("WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INT) AS b FROM embeddings) SELECT vec_id, f::INT AS frame_no, list_sum(b[f * 24 + 1 : f * 24 + 24])::BIGINT AS total FROM h, range(2) r(f)")
def raw_scan(spark, sf_dir):
    """Raw frames of 4 x 6 samples of 8 bits; the rest of 64 bytes is no frame."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", _bytes(F.transform(arrays.doubles(F.col("embedding")), lambda x: F.floor((x + 1) * 127.5))).alias("raw"))
    frames = probe.raw_frames(raw, "raw", 4, 6, bits_per_pixel=8)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.hex(F.substring(F.col("frame"), i, F.lit(1))), 16, 10).cast("long"))
    return frames.select("vec_id", "frame_no", total.alias("total"))
