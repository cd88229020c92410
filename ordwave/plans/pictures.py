"""Queries about frames as grids, and the SQL that checks them. Embeddings are frames of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, grids, motion
from ..operators import frames, relate
from ..operators.sequences import positions, with_neighbour
from .catalog import _FRAMES, _PIXELS, _px, _vectors, query

_LEVELS = f"{_PIXELS}, lv AS (SELECT vec_id, label, y, x, floor((v + 1) * 127.5)::INT AS level FROM pixels WHERE y % 2 = 0 AND x % 2 = 0), lc AS (SELECT vec_id, level, count(*) AS n FROM lv GROUP BY ALL), lr AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY level) AS cdf, first(n) OVER (PARTITION BY vec_id ORDER BY level) AS low FROM lc), le AS (SELECT lv.vec_id, label, y, x, CASE WHEN low < 16 THEN floor((cdf - low) * 255 / (16 - low) + 0.5) ELSE lv.level END AS e FROM lv JOIN lr ON lr.vec_id = lv.vec_id AND lr.level = lv.level), fr AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM frames)"


def _pairs(spark, sf_dir, value, out="prev"):
    placed = positions(_vectors(spark, sf_dir), "label", "vec_id").withColumn("px", value)
    return with_neighbour(placed, "label", "px", out).where(F.col(out).isNotNull())


_levels = lambda: F.transform(_px(), lambda x: F.floor((x + 1) * 127.5).cast("int"))


@query(f"WITH {_LEVELS} SELECT f.vec_id, round(avg(abs(a.e - b.e)), 6) AS diff FROM fr f JOIN le a ON a.vec_id = f.vec_id JOIN le b ON b.vec_id = f.prev AND b.y = a.y AND b.x = a.x GROUP BY f.vec_id")
def luma_distance(spark, sf_dir):
    """Distance of neighbours by their equalised luma proxies."""
    found = _pairs(spark, sf_dir, frames.luma_proxy(8, 8)(_levels()))
    return found.select("vec_id", F.round(frames.proxy_distance(F.col("px"), F.col("prev")), 6).alias("diff"))


@query("SELECT p_partkey, (p_partkey * 257 % 65536) // 256 AS high FROM part")
def depth_narrow(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", grids.narrow(F.col("p_partkey") * 257 % 65536).alias("high"))


@query(f"WITH {_FRAMES} SELECT vec_id, round(list_sum(list_transform(range(21), lambda i: (0.2989 * px[3 * i + 1] + 0.5870 * px[3 * i + 2] + 0.1140 * px[3 * i + 3]) * (i + 1))), 6) AS weighted FROM frames")
def grey(spark, sf_dir):
    at = lambda v, i, k: F.element_at(v, (3 * i + k).cast("int"))
    made = arrays.let(_px(), lambda v: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: grids.grey(at(v, i, 1), at(v, i, 2), at(v, i, 3))))
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.weighted(made), 6).alias("weighted"))


_SIDE = "h AS (SELECT p_partkey, p_size * 7 + 3 AS h, p_partkey % 90 + 5 AS w, m FROM part, range(5) r(m)), d AS (SELECT *, CASE WHEN m = 1 AND w < h THEN 2 WHEN m >= 2 THEN m ELSE 1 END AS dh, CASE WHEN m = 1 AND w >= h THEN 2 WHEN m >= 2 THEN m ELSE 1 END AS dw FROM h), t AS (SELECT *, ceil(h / (2 * dh)) * 2 AS th, ceil(w / (2 * dw)) * 2 AS tw FROM d)"


@query(f"WITH {_SIDE} SELECT p_partkey, m::INT AS mode, th::BIGINT AS tile_h, tw::BIGINT AS tile_w, (ceil(h / th) * th)::BIGINT AS padded_h, (ceil(w / tw) * tw)::BIGINT AS padded_w, ceil(h / th)::BIGINT AS rows, ceil(w / tw)::BIGINT AS columns FROM t")
def mode_tiles(spark, sf_dir):
    sized = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 7 + 3).alias("h"), (F.col("p_partkey") % 90 + 5).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("mode"))
    return sized.select("p_partkey", "mode", grids.mode_tiles(F.col("h"), F.col("w"), F.col("mode")).alias("t")).select("p_partkey", "mode", "t.*")


_REFLECT = "CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END"


@query(f"""WITH {_PIXELS}, g AS (SELECT a AS y, b AS x, {_REFLECT.format(i="(a - 1)")} AS sy, {_REFLECT.format(i="(b - 2)")} AS sx FROM range(12) r(a), range(14) s(b))
SELECT p.vec_id, round(sum(p.v * (g.y * 14 + g.x + 1)), 5) AS weighted, count(*) AS n, true AS trimmed_back FROM g JOIN pixels p ON p.y = sy AND p.x = sx GROUP BY p.vec_id""")
def reflect_pad(spark, sf_dir):
    padded = _vectors(spark, sf_dir).select("vec_id", _px().alias("px")).withColumn("p", grids.pad_reflect(F.col("px"), 8, 8, 1, 2, 3, 4))
    return padded.select("vec_id", F.round(arrays.weighted("p"), 5).alias("weighted"), F.size("p").cast("long").alias("n"), (grids.trim("p", 14, 1, 2, 8, 8) == F.col("px")).alias("trimmed_back"))


@query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0 WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 2 WHEN p_size <= 8 THEN 3 WHEN p_size <= 16 THEN 4 WHEN p_size <= 32 THEN 5 ELSE 6 END AS steps, (p_size + (4 - p_size % 4) % 4) AS padded FROM part")
def upscale_steps(spark, sf_dir):
    size = F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", grids.upscale_steps(size.cast("double"), 2).alias("steps"), (size + grids.pad_to(size, 4)).alias("padded"))


@query(f"""WITH {_PIXELS}, m AS (SELECT vec_id, max(abs(v)) AS a, max(abs(v)) FILTER (y < 4) AS b FROM pixels GROUP BY vec_id)
SELECT vec_id, CASE WHEN a * 0.35 <= sqrt(64 / 2088960.0) * 24 THEN 1 WHEN b * 0.35 <= sqrt(64 / 2088960.0) * 24 THEN 0.5 ELSE 0.25 END::DOUBLE AS scale FROM m""")
def flow_scale(spark, sf_dir):
    limit = grids.flow_limit(F.lit(8.0), F.lit(8.0))
    upper = F.slice(_px(), 1, 32)
    return _vectors(spark, sf_dir).select("vec_id", grids.dynamic_scale(grids.largest(_px()) * 0.35, grids.largest(upper) * 0.35, limit).alias("scale"))


def _stencil_sql(source: str, taps: dict, name: str) -> str:
    rows = ", ".join(f"({dy}, {dx}, {t}::DOUBLE)" for (dy, dx), t in taps.items())
    sy, sx = _REFLECT.format(i="(g.y + k.dy)"), _REFLECT.format(i="(g.x + k.dx)")
    return f"{name} AS (SELECT g.vec_id, g.y, g.x, sum(p.v * k.t) AS v FROM {source} g JOIN (VALUES {rows}) k(dy, dx, t) ON true JOIN {source} p ON p.vec_id = g.vec_id AND p.y = {sy} AND p.x = {sx} GROUP BY ALL)"


_GRADIENT = f"{_PIXELS}, {_stencil_sql('pixels', grids.SMOOTH, 'sm')}, {_stencil_sql('sm', grids.SOBEL_X, 'gx')}, {_stencil_sql('sm', grids.SOBEL_Y, 'gy')}, grad AS (SELECT gx.vec_id, gx.y, gx.x, (abs(gx.v) + abs(gy.v)) / 2 AS g FROM gx JOIN gy USING (vec_id, y, x))"


@query(f"WITH {_GRADIENT} SELECT vec_id, round(sum(g * (y * 8 + x + 1)), 5) AS weighted, round(count(*) FILTER (g >= 0.2) / 64, 6) AS density FROM grad GROUP BY vec_id")
def sobel_filter(spark, sf_dir):
    a = _vectors(spark, sf_dir).select("vec_id", grids.gradient(8, 8)(_px()).alias("g"))
    density = F.size(F.filter("g", lambda g: g >= 0.2)) / F.lit(64)
    return a.select("vec_id", F.round(arrays.weighted("g"), 5).alias("weighted"), F.round(density, 6).alias("density"))


@query(f"""WITH {_FRAMES}, fp AS (SELECT vec_id, px, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM frames), pixels AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, abs(px[i + 1] - prev[i + 1]) AS v FROM (SELECT *, unnest(range(64)) AS i FROM fp WHERE prev IS NOT NULL)),
{_GRADIENT.split(", ", 1)[1].split("FROM frames)), ", 1)[1]} SELECT vec_id, round(count(*) FILTER (g >= 0.15) / 64, 6) AS density FROM grad GROUP BY vec_id""")
def edge_distance(spark, sf_dir):
    """Distance of neighbours as the edge density of their difference."""
    found = _pairs(spark, sf_dir, _px()).withColumn("d", F.zip_with("px", "prev", lambda x, y: F.abs(x - y)))
    return found.select("vec_id", F.round(grids.edge_density(8, 8, 0.15)("d"), 6).alias("density"))


@query(f"""WITH {_FRAMES}, fp AS (SELECT vec_id, px, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM frames), pixels AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] - prev[i + 1] AS v FROM (SELECT *, unnest(range(64)) AS i FROM fp WHERE prev IS NOT NULL)),
{_stencil_sql('pixels', grids.SOBEL_X, 'gx')}, {_stencil_sql('pixels', grids.SOBEL_Y, 'gy')},
ep AS (SELECT vec_id, avg(sqrt((px[2 * j + 1] - prev[2 * j + 1]) ** 2 + (px[2 * j + 2] - prev[2 * j + 2]) ** 2 + 1e-6)) AS epe FROM (SELECT *, unnest(range(32)) AS j FROM fp WHERE prev IS NOT NULL) GROUP BY vec_id)
SELECT vec_id, round(any_value(epe), 6) AS end_point, round(avg(abs(v)), 6) AS sobel FROM (SELECT vec_id, v FROM gx UNION ALL SELECT vec_id, v FROM gy) JOIN ep USING (vec_id) GROUP BY vec_id""")
def pair_losses(spark, sf_dir):
    flow = lambda c: arrays.let(F.col(c), lambda v: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(F.element_at(v, (2 * j + 1).cast("int")).alias("x"), F.element_at(v, (2 * j + 2).cast("int")).alias("y"))))
    found = _pairs(spark, sf_dir, _px())
    return found.select("vec_id", F.round(grids.end_point_error(flow("px"), flow("prev")), 6).alias("end_point"), F.round(grids.sobel_loss(8, 8)("px", "prev"), 6).alias("sobel"))


_NEAR = "desc_ AS (SELECT *, d / sqrt(0.81 + d * d) AS c FROM (SELECT vec_id, i, dy, dx, CASE WHEN i // 8 + dy BETWEEN 0 AND 7 AND i % 8 + dx BETWEEN 0 AND 7 THEN px[i + dy * 8 + dx + 1] ELSE 0 END - px[i + 1] AS d FROM (SELECT vec_id, px, i, a - 3 AS dy, b - 3 AS dx FROM frames, range(64) r(i), range(7) s(a), range(7) t(b))))"


@query(f"WITH {_FRAMES}, {_NEAR}, fr AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM frames) SELECT f.vec_id, round(avg((a.c - b.c) ** 2 / (0.1 + (a.c - b.c) ** 2)), 6) AS census FROM fr f JOIN desc_ a ON a.vec_id = f.vec_id JOIN desc_ b ON b.vec_id = f.prev AND b.i = a.i AND b.dy = a.dy AND b.dx = a.dx WHERE a.i // 8 BETWEEN 1 AND 6 AND a.i % 8 BETWEEN 1 AND 6 GROUP BY f.vec_id")
def census_loss(spark, sf_dir):
    found = _pairs(spark, sf_dir, _px())
    return found.select("vec_id", F.round(grids.census_loss(8, 8)("px", "prev"), 6).alias("census"))


@query(f"WITH {_PIXELS}, g AS (SELECT a AS y, b AS x FROM range(6) r(a), range(6) s(b)) SELECT p.vec_id, g.y::INT AS y, g.x::INT AS x, round(sum(p.v * ((p.y - g.y) * 3 + p.x - g.x + 1)), 6) AS weighted FROM g JOIN pixels p ON p.y BETWEEN g.y AND g.y + 2 AND p.x BETWEEN g.x AND g.x + 2 GROUP BY ALL")
def rolling_view(spark, sf_dir):
    seen = _vectors(spark, sf_dir).select("vec_id", F.explode(grids.windows(_px(), 8, 8, 3)).alias("w"))
    return seen.select("vec_id", "w.y", "w.x", F.round(arrays.weighted("w.px"), 6).alias("weighted"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(sum(v * (i + 1)), 5) AS weighted, round(sum(v * (y + 1)) FILTER (x = 4), 6) AS column_four FROM pixels GROUP BY vec_id")
def tile_roundtrip(spark, sf_dir):
    """Tiles read with a halo, trimmed, and put together again from a row for each tile."""
    cut = frames.tiles(_vectors(spark, sf_dir), "embedding", 8, 8, 4, pad=1)
    own = lambda t: F.when(F.col(t) == 0, 0).otherwise(1)
    inner = F.filter("region", lambda _, i: (F.floor(i / 5) - own("ty")).between(0, 3) & (F.pmod(i, F.lit(5)) - own("tx")).between(0, 3))
    pieces = cut.select("vec_id", (F.col("ty") * 2 + F.col("tx")).alias("piece"), inner.alias("px"))
    whole = relate.zip_pieces(pieces, ["vec_id"], "piece", "px")
    at = lambda v, i: F.element_at(F.element_at(v, (F.floor(i / 32) * 2 + F.floor(F.pmod(i, F.lit(8)) / 4) + 1).cast("int")), (F.pmod(F.floor(i / 8), F.lit(4)) * 4 + F.pmod(i, F.lit(4)) + 1).cast("int"))
    sewn = whole.withColumn("sewn", arrays.let(F.col("px"), lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: at(v, i)))).select("vec_id", arrays.doubles("sewn").alias("sewn"))
    column = F.filter("sewn", lambda _, i: F.pmod(i, F.lit(8)) == 4)
    return sewn.select("vec_id", F.round(arrays.weighted("sewn"), 5).alias("weighted"), F.round(arrays.weighted(column), 6).alias("column_four"))


_COVER = "greatest(0, least((o + 1) * 8 / {m}.0, {i} + 1) - greatest(o * 8 / {m}.0, {i})) * {m} / 8.0"


@query(f"""WITH {_PIXELS}, r AS (SELECT o, i, {_COVER.format(m=5, i='i')} AS wt FROM range(5) a(o), range(8) b(i)), c AS (SELECT o, i, {_COVER.format(m=3, i='i')} AS wt FROM range(3) a(o), range(8) b(i))
SELECT vec_id, round(sum(v * r.wt::DOUBLE * c.wt::DOUBLE * (r.o * 3 + c.o + 1)), 5) AS weighted FROM pixels p JOIN r ON r.i = p.y JOIN c ON c.i = p.x GROUP BY vec_id""")
def area_resize(spark, sf_dir):
    made = _vectors(spark, sf_dir).select("vec_id", grids.resize_area(8, 8, 5, 3)(_px()).alias("px"))
    return made.select("vec_id", F.round(arrays.weighted("px"), 5).alias("weighted"))


def _cubic_sql(m: int) -> str:
    """(o, i, wt) of cubic weights from 8 pixels to m."""
    a, d = grids.CUBIC, "abs(c - (floor(c) + k))"
    weight = f"CASE WHEN {d} <= 1 THEN (({a + 2} * {d} - {a + 3}) * {d} * {d} + 1) WHEN {d} < 2 THEN (({a} * {d} - {5 * a}) * {d} + {8 * a}) * {d} - {4 * a} ELSE 0 END"
    return f"SELECT o, least(greatest(floor(c) + k, 0), 7) AS i, sum({weight}) AS wt FROM (SELECT o, (o + 0.5::DOUBLE) * 8 / {m} - 0.5 AS c FROM range({m}) a(o)), (VALUES (-1), (0), (1), (2)) b(k) GROUP BY ALL HAVING true"


@query(f"""WITH {_PIXELS}, r AS ({_cubic_sql(13)}), c AS ({_cubic_sql(5)})
SELECT vec_id, round(sum(v * r.wt * c.wt * (r.o * 5 + c.o + 1)), 5) AS weighted FROM pixels p JOIN r ON r.i = p.y JOIN c ON c.i = p.x GROUP BY vec_id""")
def cubic_resize(spark, sf_dir):
    made = _vectors(spark, sf_dir).select("vec_id", grids.resize_cubic(8, 8, 13, 5)(_px()).alias("px"))
    return made.select("vec_id", F.round(arrays.weighted("px"), 5).alias("weighted"))


@query()
def motion_scale(spark, sf_dir):
    """The scale at which neighbours are worked on, by the largest flow between them at full and at half size."""
    return _pairs(spark, sf_dir, _px()).select("vec_id", motion.scale_of_motion(8, 8, 1.5)("prev", "px").alias("scale"))


@query()
def canny_edges(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", grids.canny(8, 8)(_px()).alias("edges"))


@query()
def flow_distance(spark, sf_dir):
    return _pairs(spark, sf_dir, _px()).select("vec_id", F.round(motion.flow_distance(8, 8)("px", "prev"), 6).alias("distance"))
