"""Every query of the catalog against its SQL, or against a plain fold over each sequence."""

from collections import Counter, defaultdict

import duckdb
import pytest

from ordwave.operators.scenes import SceneState
from ordwave.plans import catalog, filters, media, pictures, storage, streams  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = ["events", "embeddings", "part", "lineitem", "orders", "supplier", "customer", "nation", "region"]


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


def plain(x):
    return x if x is None or isinstance(x, (str, bool)) else float(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.SQL[name])
    columns = sorted(got.columns)
    theirs = [c[0] for c in want.description]
    assert sorted(theirs) == columns
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    others = Counter(tuple(plain(r[theirs.index(c)]) for c in columns) for r in want.fetchall())
    assert rows, "no rows"
    assert not (rows - others) and not (others - rows), (list((rows - others).items())[:3], list((others - rows).items())[:3])


def sequences():
    out = defaultdict(list)
    for user, event, value in duckdb.sql(f"select user_id, event_id, value from '{SF}/events.parquet' order by event_id").fetchall():
        out[user].append((event, value))
    return out


def scene_flags(values):
    state, out = SceneState(catalog.LENGTH, 12.0), []
    for i, v in enumerate(values):
        out.append(i > 0 and state.step(abs(v - values[i - 1]), False))
    return out


def test_scene_adaptive(spark):
    want = {(u, i, f) for u, rows in sequences().items() for i, f in enumerate(scene_flags([v for _, v in rows]))}
    assert {(r["user_id"], r["pos"], r["is_scene"]) for r in catalog.scene_adaptive(spark, SF).collect()} == want


def test_stream_scene(spark):
    want = {(u, e, f) for u, rows in sequences().items() for (e, _), f in zip(rows, scene_flags([v for _, v in rows]))}
    assert {(r["user_id"], r["event_id"], r["is_scene"]) for r in streams.stream_scene(spark, SF).collect()} == want


def dropped_in_batch(values, scenes, mode):
    """Which rows of a batch the held-drawing rule drops, for windows of 4 to mode + 2 rows."""
    n, gone = len(values), set()
    for q in range(4, mode + 3):
        i, hits = 1, []
        while i + q <= n:
            x = values[i : i + q]
            inner = [(a, b) for a in range(1, q - 2) for b in range(a + 1, q - 1)]
            if all(abs(x[a] - x[b]) < abs(x[0] - x[a]) and abs(x[a] - x[b]) < abs(x[b] - x[-1]) for a, b in inner):
                hits.append(i)
                i += q - 3
            i += 1
        gone |= {h + t for h in hits if h not in gone for t in range(1, q - 2)}
    return [i in gone and not scenes[i] and i not in (0, n - 1) for i in range(n)]


def test_dedup_qframe(spark):
    want = set()
    for u, rows in sequences().items():
        values = [v for _, v in rows]
        scene = [i > 0 and abs(v - values[i - 1]) > catalog.CUT for i, v in enumerate(values)]
        for a in range(0, len(values), 200):
            want |= {(u, a + i, not g) for i, g in enumerate(dropped_in_batch(values[a : a + 200], scene[a : a + 200], 4))}
    assert {(r["user_id"], r["pos"], r["kept"]) for r in catalog.dedup_qframe(spark, SF).collect()} == want


def test_probes_of_single_documents(spark):
    """The first or last stream of a kind, turned frames, unknown rates, doubled kinds, options of one file."""
    from pyspark.sql import functions as F

    from ordwave.sources import probe

    xml = '<ffprobe><streams><stream codec_type="video" codec_name="h264" width="1920"/><stream codec_type="video" codec_name="mjpeg" width="10"/><stream codec_type="audio" codec_name="aac"/></streams></ffprobe>'
    docs = spark.createDataFrame([(0, xml), (1, "<broken"), (2, None)], "id int, t string")
    rows = [(r["id"], r["codec_type"], r["s"]["_codec_name"], r["s"]["_width"]) for r in probe.streams_xml(docs, "t").collect()]
    assert sorted(rows) == [(0, "audio", "aac", None), (0, "video", "mjpeg", 10)]
    assert probe.streams_xml(docs, "t", guard=True).count() == 0 or {r["codec_type"] for r in probe.streams_xml(docs, "t", guard=True).collect()} == {"audio"}
    texts = ['{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":1920,"height":1080,"r_frame_rate":"24000/1001","nb_frames":"240"},{"codec_type":"video","width":1}]}', '{"streams":[{"codec_type":"video","width":640,"height":480,"r_frame_rate":"0/0","duration":"10.5","tags":{"rotate":"90"}}]}', "{"]
    found = probe.streams_json(spark.createDataFrame(enumerate(texts), "id int, t string"), "t").where("codec_type = 'video'").select("id", *probe.video_facts(F.col("s")))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1920, 1080, pytest.approx(24000 / 1001), 240), (1, 480, 640, 25.0, 262)]
    lines = ["[Other]", "a=1", "[General]", "a=true", "b = False", "c=3", "d=3.0", "e=2.5", "f=", "g=some text", "c=4", "[End]", "z=9"]
    options = probe.options(spark.createDataFrame(enumerate(lines), "place int, line string"), "line", "place").collect()
    assert {r["name"]: (r["value"], r["kind"]) for r in options} == {"a": ("true", "bool"), "b": ("False", "bool"), "c": ("4", "int"), "d": ("3.0", "int"), "e": ("2.5", "float"), "f": ("", "string"), "g": ("some text", "string")}


def test_one_image_is_a_folder_of_one(spark, tmp_path):
    from ordwave.sources import probe

    (tmp_path / "one.png").write_bytes(b"abc")
    rows = probe.image_folder(spark, str(tmp_path / "one.png"), exponent=1).orderBy("frame_no").collect()
    assert [(r["frame_no"], r["name"], bytes(r["content"])) for r in rows] == [(0, "one.png", b"abc"), (1, "one.png", b"abc")]


@pytest.mark.parametrize("arrow", [7, 10_000])
@pytest.mark.parametrize("batch, mode", [(1, 3), (3, 2), (5, 4), (40, 5)])
def test_held_drawings_of_odd_batches(spark, batch, mode, arrow):
    """Batches that Arrow cuts, shorter than a window, of one row, with nulls, of several sequences in a task."""
    import random

    from ordwave.operators import dedup

    rnd = random.Random(batch)
    rows = [(s, i, rnd.choice([0.0, 0.1, 0.2, 5.0, 5.1, None, 9.0]), rnd.random() < 0.1) for s in ("a", "b", "c", "d") for i in range(97)]
    df = spark.createDataFrame(rows, "s string, pos long, v double, scene boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = {(r["s"], r["pos"]): r["kept"] for r in dedup.dedup_held(df, "s", "v", "scene", mode=mode, batch=batch, tasks=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in ("a", "b", "c", "d"):
        own = [r for r in rows if r[0] == s]
        for a in range(0, 97, batch):
            part = own[a : a + batch]
            gone = dropped_in_batch([float("nan") if r[2] is None else r[2] for r in part], [r[3] for r in part], mode)
            want |= {(s, r[1]): not g for r, g in zip(part, gone)}
    assert got == want


def test_option_plan_without_a_rule_for_all(spark):
    """Ties go to the smaller priority, be it of a rule that fits anything; requests that nothing fits have no options."""
    from ordwave.functions import rules

    asked = spark.createDataFrame([(1, "x", "u"), (2, "y", "u"), (3, "z", None)], "id int, a string, b string")
    table = lambda rows: spark.createDataFrame(rows, "a string, b string, priority int, options map<string,string>")
    plan = lambda rows: {r["id"]: r["options"] for r in rules.plan_options(asked, table(rows), ["a", "b"], "id").select("id", "options").collect()}
    own = [("x", None, 5, {"o": "x"}), ("y", "u", 2, {"o": "yu"}), (None, "u", 4, {"o": "u"})]
    assert plan(own) == {1: {"o": "u"}, 2: {"o": "yu"}, 3: None}
    assert plan([*own, (None, None, 3, {"o": "any"}), (None, None, 9, {"o": "late"})]) == {1: {"o": "any"}, 2: {"o": "yu"}, 3: {"o": "any"}}
    assert plan([]) == {1: None, 2: None, 3: None}


def test_exact_quantiles(spark):
    from ordwave.operators.sequences import positions, slice_width, value_at

    values = {"a": [5.0, 1.0, 1.0, 9.0], "b": [2.0], "c": [7.0, 3.0, 4.0]}
    rows = spark.createDataFrame([(k, v, int(v * 1000)) for k, vs in values.items() for v in vs], "k string, v double, o long")
    for share in (0.0, 0.25, 0.5, 1.0):
        for width in (slice_width(rows, "o"), 1, 1500):
            got = {r["k"]: r["v"] for r in value_at(positions(rows, "k", ["o", "v"], width), "k", "v", share).collect()}
            assert got == {k: pytest.approx(duckdb.sql(f"select quantile_cont(unnest, {share}) from unnest({vs})").fetchall()[0][0]) for k, vs in values.items()}
    assert slice_width(rows.where("o < 0"), "o") > 0 and slice_width(rows, "o", rows=1) == (9000 - 1000 + 1) // 8
