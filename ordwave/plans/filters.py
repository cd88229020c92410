"""Queries about motion, noise, colour, oriented bands and XML rows, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, motion, restore
from ..operators import fill, normalise
from ..operators.sequences import positions
from ..sources.scratch import remove_at_exit, scratch_dir
from .catalog import _FRAMES, _PIXELS, _px, _vectors, query
from .pictures import _REFLECT

_FLOW = ("(vec_id % 5 - 2) * 0.5 + x * 0.125", "(vec_id % 3 - 1) * 0.75 - y * 0.125")


@query(f"""WITH {_FRAMES}, at_ AS (SELECT vec_id, px, i, y, x, least(greatest(y + {_FLOW[0]}, 0), 7)::DOUBLE AS sy, least(greatest(x + {_FLOW[1]}, 0), 7)::DOUBLE AS sx FROM (SELECT vec_id, px, i, i // 8 AS y, i % 8 AS x FROM frames, range(64) r(i))),
c AS (SELECT *, floor(sy)::INT AS y0, floor(sx)::INT AS x0, least(floor(sy) + 1, 7)::INT AS y1, least(floor(sx) + 1, 7)::INT AS x1, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM at_)
SELECT vec_id, round(sum((i + 1) * ((px[y0 * 8 + x0 + 1] * (1 - fx) + px[y0 * 8 + x1 + 1] * fx) * (1 - fy) + (px[y1 * 8 + x0 + 1] * (1 - fx) + px[y1 * 8 + x1 + 1] * fx) * fy)), 5) AS weighted FROM c GROUP BY vec_id""")
def warp_shift(spark, sf_dir):
    """Frames sampled along flows that are whole, halves and between, and that leave the frame."""
    vec, y, x = F.col("vec_id"), lambda i: F.floor(i / 8), lambda i: F.pmod(i, F.lit(8))
    pixels = F.sequence(F.lit(0), F.lit(63))
    flow = F.concat(F.transform(pixels, lambda i: (vec % 5 - 2) * 0.5 + x(i) * 0.125), F.transform(pixels, lambda i: (vec % 3 - 1) * 0.75 - y(i) * 0.125))
    made = _vectors(spark, sf_dir).select("vec_id", motion.warped(8, 8)(_px(), flow.cast("array<double>")).alias("px"))
    return made.select("vec_id", F.round(arrays.weighted("px"), 5).alias("weighted"))


@query()
def motion_fill(spark, sf_dir):
    """A frame between each two of a label, moved along the flow found from coarse to fine, both ways and mirrored."""
    placed = positions(_vectors(spark, sf_dir).select("label", "vec_id", _px().alias("px")), "label", "vec_id")
    made = fill.fill_with(placed, "label", "px", F.lit(1), motion.motion_model(8, 8, flips=True))
    return made.select("label", "pos", "sub_no", F.round(arrays.weighted("px"), 5).alias("weighted"))


_SIDES = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))
_SEEN = lambda dy, dx: f"px[({_REFLECT.format(i=f'(i // 8 + {dy})')}) * 8 + ({_REFLECT.format(i=f'(i % 8 + {dx})')}) + 1]"


@query(f"""WITH {_FRAMES}, o AS (SELECT * FROM (VALUES {_SIDES}) o(dy, dx)), k AS (SELECT * FROM (VALUES {_SIDES}) k(ky, kx)),
d AS (SELECT vec_id, i, dy, dx, any_value({_SEEN('dy', 'dx')}) AS v, avg(({_SEEN('ky', 'kx')} - {_SEEN('(ky + dy)', '(kx + dx)')}) ** 2) AS d FROM frames, range(64) r(i), o, k GROUP BY vec_id, i, dy, dx),
c AS (SELECT vec_id, i, sum(exp(-d / 0.01) * v) / sum(exp(-d / 0.01)) AS v FROM d GROUP BY vec_id, i)
SELECT vec_id, round(sum(v * (i + 1)), 5) AS weighted FROM c GROUP BY vec_id""")
def denoise(spark, sf_dir):
    made = _vectors(spark, sf_dir).select("vec_id", restore.denoised(8, 8, 0.1, patch=1, search=1)(_px()).alias("px"))
    return made.select("vec_id", F.round(arrays.weighted("px"), 5).alias("weighted"))


_MATRIX = restore.yuv_matrix()
_LEVEL = "floor((px[{i}] + 1) * 127.5)"


def _channels(spark, sf_dir):
    """Frames as channels of levels from 0 to 255: as they are, from the last pixel to the first, and from the ninth on."""
    levels = F.transform(_px(), lambda v: F.floor((v + 1) * 127.5).cast("double"))
    made = _vectors(spark, sf_dir).select("vec_id", levels.alias("r"))
    return made.withColumn("g", F.reverse("r")).withColumn("b", F.concat(F.slice("r", 9, 56), F.slice("r", 1, 8)))


_CHANNELS = f"""{_FRAMES}, rgb AS (SELECT vec_id, i, {_LEVEL.format(i='i + 1')} AS r, {_LEVEL.format(i='64 - i')} AS g, {_LEVEL.format(i='(i + 8) % 64 + 1')} AS b FROM frames, range(64) t(i)),
yuv AS (SELECT vec_id, i, {', '.join(f"r * {m[0]!r}::DOUBLE + g * {m[1]!r}::DOUBLE + b * {m[2]!r}::DOUBLE AS {c}" for c, m in zip("yuv", _MATRIX.tolist()))} FROM rgb)"""


@query(f"WITH {_CHANNELS} SELECT vec_id, {', '.join(f'round(sum({c} * (i + 1)), 4) AS {c}' for c in 'yuv')} FROM yuv GROUP BY vec_id")
def colour_matrix(spark, sf_dir):
    y, u, v = restore.apply_matrix("r", "g", "b", _MATRIX)
    return _channels(spark, sf_dir).select("vec_id", *[F.round(arrays.weighted(c), 4).alias(n) for n, c in zip("yuv", (y, u, v))])


@query(f"""WITH {_CHANNELS}, q AS (SELECT vec_id, i // 16 * 4 + i % 8 // 2 AS j, floor(avg(u) + 128.5) AS u, floor(avg(v) + 128.5) AS v FROM yuv GROUP BY ALL),
p AS (SELECT vec_id, sum(floor(y + 0.5) * (i + 1)) AS y FROM yuv GROUP BY vec_id)
SELECT p.vec_id, any_value(y)::BIGINT AS y, sum(u * (j + 1))::BIGINT AS u, sum(v * (j + 1))::BIGINT AS v FROM p JOIN q USING (vec_id) GROUP BY p.vec_id""")
def planar_420(spark, sf_dir):
    """Colour frames as planes of bytes, u and v at half the sides."""
    packed = _channels(spark, sf_dir).select("vec_id", restore.planar(8, 8)("r", "g", "b").alias("planes"))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("planes"), i, F.lit(1))), 16, 10).cast("long")
    weighted = lambda a, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0).cast("long"), lambda s, i: s + byte(i + a) * i)
    return packed.select("vec_id", weighted(0, 64).alias("y"), weighted(64, 16).alias("u"), weighted(80, 16).alias("v"))


_CURVE = [0.0, 0.1, 0.4, 0.55, 1.0]


@query(f"""WITH {_PIXELS}, t AS (SELECT vec_id, i, least(greatest((v + 0.4) / 0.8 * 4, 0), 4)::DOUBLE AS p FROM pixels), f AS (SELECT *, least(floor(p), 3)::INT AS k FROM t)
SELECT vec_id, round(sum((i + 1) * ({_CURVE}[k + 1] * (1 - (p - k)) + {_CURVE}[k + 2] * (p - k))), 5) AS weighted FROM f GROUP BY vec_id""")
def colour_curve(spark, sf_dir):
    """Values through a table, between its entries and beyond its ends."""
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.weighted(restore.lookup(_px(), _CURVE, -0.4, 0.4)), 5).alias("weighted"))


@query()
def band_energy(spark, sf_dir):
    """Mean squares of the oriented bands of each frame."""
    made = _vectors(spark, sf_dir).select("vec_id", restore.band_energy(8, 8, 2, 4)(_px()).alias("e"))
    return made.select("vec_id", F.transform("e", lambda x: F.round(x, 9)).alias("energy"))


@query(f"""WITH {_FRAMES}, n AS (SELECT label, [{', '.join(f'px[(y + {i // 3}) * 8 + x + {i % 3} + 1]' for i in range(9))}] AS v FROM frames, range(6) a(y), range(6) b(x))
SELECT label, i::INT AS i, j::INT AS j, round(covar_samp(v[i + 1], v[j + 1]), 8) AS cov FROM n, range(9) a(i), range(9) b(j) GROUP BY ALL""")
def neighbour_covariance(spark, sf_dir):
    frames = _vectors(spark, sf_dir).select("label", _px().alias("px"))
    return normalise.neighbour_covariance(frames, "label", "px", 8, 8).withColumn("cov", F.round("cov", 8))


@query()
def divisive_norm(spark, sf_dir):
    made = normalise.divisive_normalise(_vectors(spark, sf_dir).select("vec_id", "label", _px().alias("px")), "label", "px", 8, 8)
    return made.select("vec_id", F.round(arrays.weighted("normalised"), 4).alias("weighted"))


#: Rows of an XML file, which one task reads from end to end.
XML_ROWS = 50_000


@query("SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines, coalesce(sum(l_quantity), 0)::BIGINT AS quantity, min(l_linenumber) AS first_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def xml_rows(spark, sf_dir):
    """Orders with their lines dumped as XML files and read again, a row for each tag, with lines as an array of children."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("_number"), F.col("l_quantity").cast("double").alias("quantity"))).alias("line"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    folder = scratch_dir(spark)
    remove_at_exit(spark, folder)
    orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("_key"), F.col("o_orderstatus").alias("status"), "line").write.format("xml").option("rootTag", "orders").option("rowTag", "order").option("maxRecordsPerFile", XML_ROWS).save(folder)
    schema = "_key bigint, status string, line array<struct<_number:int,quantity:double>>, _corrupt_record string"
    read = spark.read.format("xml").option("rowTag", "order").schema(schema).load(folder).where("_corrupt_record IS NULL")
    some = F.coalesce(F.col("line"), F.expr("CAST(array() AS array<struct<_number:int,quantity:double>>)"))
    return read.select(F.col("_key").alias("o_orderkey"), F.col("status").alias("o_orderstatus"), F.size(some).cast("long").alias("n_lines"), F.aggregate(some, F.lit(0.0), lambda s, l: s + l["quantity"]).cast("long").alias("quantity"), F.array_min(F.transform(some, lambda l: l["_number"])).alias("first_line"))
