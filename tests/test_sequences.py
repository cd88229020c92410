"""Blocks much smaller than the sequences, so that every operator has to cross their borders."""

import random

import pytest
from pyspark.sql import functions as F

from ordwave.operators import chunks, dedup, fill, scenes, sequences
from ordwave.sources import probe


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    return [(s, o, float(rnd.choice([0, 1, 2, 50, 51, 120]) + s)) for s, n in ((1, 700), (2, 40), (3, 1)) for o in sorted(rnd.sample(range(5000), n))]


@pytest.fixture(scope="module")
def placed(spark, rows):
    more = [(None, 5, 1.0), (1, None, 1.0)]
    return sequences.positions(spark.createDataFrame(rows + more, "s int, o long, v double"), "s", "o", width=37)


def by_sequence(rows):
    return {s: [v for t, _, v in rows if t == s] for s in {r[0] for r in rows}}


def test_positions_and_neighbours(placed, rows):
    got = {(r["s"], r["pos"]): (r["v"], r["x"], r["y"]) for r in sequences.with_neighbour(sequences.with_neighbour(placed, "s", "v", "x", -2, rows=7), "s", "v", "y", 3, rows=7).collect()}
    want = {(s, i): (v, vs[i - 2] if i > 1 else None, vs[i + 3] if i + 3 < len(vs) else None) for s, vs in by_sequence(rows).items() for i, v in enumerate(vs)}
    assert got == want


def test_running_count(placed, rows):
    got = {(r["s"], r["pos"]): r["n"] for r in sequences.running_count(placed, "s", F.col("v") > 50, "n", rows=11).collect()}
    assert got == {(s, i): sum(v > 50 for v in vs[:i]) for s, vs in by_sequence(rows).items() for i in range(len(vs))}


def test_anchor_dedup_over_blocks(placed, rows, monkeypatch):
    monkeypatch.setattr(sequences, "FAN", 5)  # so that maps are composed on several levels
    got = {(r["s"], r["pos"]): r["absorbed"] for r in dedup.dedup_anchor(placed, "s", "v", 1.5, 4, [], rows=9).collect()}
    want = {}
    for s, vs in by_sequence(rows).items():
        anchor, n = None, 0
        for i, v in enumerate(vs):
            anchor, n = (anchor, n + 1) if anchor is not None and abs(v - anchor) < 1.5 and n < 4 else (v, 0)
            want[s, i] = n
    assert got == want


def test_scene_labels_over_segments(placed, rows):
    measured = sequences.with_neighbour(placed, "s", "v", "p").withColumn("d", F.abs(F.col("v") - F.col("p")))
    got = {(r["s"], r["pos"]): r["is_scene"] for r in scenes.scene_adaptive(measured, "s", "d", F.col("v") < 3, 5, 1.0).collect()}
    want = {}
    for s, vs in by_sequence(rows).items():
        state = scenes.SceneState(5, 1.0)
        for i, v in enumerate(vs):
            want[s, i] = i > 0 and state.step(abs(v - vs[i - 1]), v < 3)
    assert got == want


def test_resample_over_slices(spark, rows):
    got = {(r["s"], r["o"]): r["v"] for r in fill.resample_locf(spark.createDataFrame(rows, "s int, o long, v double"), "s", "o", 7, ["v"], slice_steps=3).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        own = [(o, v) for t, o, v in rows if t == s]
        for t in range(own[0][0] - own[0][0] % 7, own[-1][0] + 1, 7):
            want[s, t] = next((v for o, v in reversed(own) if o <= t), None)
    assert got == want


def test_fill_counts_and_times(placed, rows):
    made = fill.fill(placed, "s", "v", F.col("pos") % 3)
    assert made.count() == sum(1 + i % 3 for vs in by_sequence(rows).values() for i in range(len(vs)))
    assert fill.fill(placed, "s", "v", F.lit(0)).count() == len(rows)
    assert [fill.bisect_times(n) for n in (1, 2, 3)] == [[0.5], [0.25, 0.75], [0.25, 0.5, 0.75]]


def test_resume_takes_the_largest_number(spark):
    names = [("a", "chunk-999-00000000-00000009"), ("a", "chunk-1000-00000010-00000019"), ("a", "other"), ("b", "chunk-001-00000005-00000009")]
    got = {r["s"]: (r["next_chunk"], r["next_pos"]) for r in chunks.resume_point(spark.createDataFrame(names, "s string, name string"), "s").collect()}
    assert got == {"a": (1001, 20), "b": (2, 10)}


def test_image_folder_and_raw_frames(spark, tmp_path):
    for n in ("10.png", "2.png", "note.txt"):
        (tmp_path / n).write_bytes(n.encode() * 10)
    got = [(r["frame_no"], r["name"]) for r in probe.image_folder(spark, str(tmp_path), exponent=1, start=1).orderBy("frame_no").collect()]
    assert got == [(1, "10.png"), (2, "2.png"), (3, "2.png")]
    raw = spark.createDataFrame([(1, bytes(range(26))), (2, b""), (3, None)], "id int, content binary")
    assert [bytes(r["frame"]) for r in probe.raw_frames(raw, "content", 2, 2).orderBy("frame_no").collect()] == [bytes(range(12)), bytes(range(12, 24))]


def test_scene_aware_dedup_and_fill(placed, rows, monkeypatch):
    """Runs end at scenes; as many rows come out as went in, and none is blended across a scene."""
    monkeypatch.setattr(sequences, "FAN", 5)
    flagged = placed.withColumn("scene", F.col("v") > 100)
    runs = dedup.dedup_anchor(flagged, "s", "v", 1.5, 4, ["v", "scene"], rows=9, scene="scene")
    want = {}
    for s, vs in by_sequence(rows).items():
        anchor, n = None, 0
        for i, v in enumerate(vs):
            anchor, n = (anchor, n + 1) if anchor is not None and v <= 100 and abs(v - anchor) < 1.5 and n < 4 else (v, 0)
            want[s, i] = n
    assert {(r["s"], r["pos"]): r["absorbed"] for r in runs.collect()} == want
    size = runs.withColumn("run", F.col("pos") - F.col("absorbed")).groupBy("s", "run").agg(F.max("absorbed").cast("int").alias("n"), F.min_by("v", F.when(F.col("absorbed") > 0, F.col("absorbed"))).alias("first"), F.max_by("v", "absorbed").alias("last"), F.min_by("v", "absorbed").alias("v"), F.min_by("scene", "absorbed").alias("scene"))
    for mix in (False, True):
        made = fill.fill_scenes(size, "s", "v", mix=mix).collect()
        assert sorted((r["s"], r["run"] + r["sub_no"]) for r in made) == sorted(want)
        kept = {(r["s"], r["run"]): r["v"] for r in made if r["sub_no"] == 0}
        assert all(kept[k] == by_sequence(rows)[k[0]][k[1]] for k in kept)


def test_labeller_branches():
    state = lambda **k: scenes.SceneState(3, 1.0, **k)
    assert [state(fixed=50.0).step(d, False) for d in (49.9, 50.0, 0.0)] == [False, True, False]
    assert not any(state(disabled=True).step(d, True) for d in (0.0, 500.0))
    s = state()
    assert not s.step(None, False) and not s.diffs
    assert [s.step(d, False, only_learn=True) for d in (1.0, 2.0, 3.0, 4.0, 4.0)] == [False] * 5 and list(s.diffs) == [1.0, 2.0, 3.0, 4.0]
    assert s.step(81.0, False, only_learn=True) and not s.diffs
    for d in (3.0, 3.5, 4.0):
        s.step(d, False)
    assert s.step(60.0, False, replace_last=True) and not s.diffs
    one = scenes.SceneState(1, 1.0)
    one.step(3.0, False)
    assert not one.step(60.0, False, replace_last=True) and not one.diffs
    black = state()
    assert [black.step(d, p) for d, p in ((0.0, True), (0.0, False), (5.0, False), (5.0, False))] == [False, False, True, False]


def test_streams_with_nulls(spark, tmp_path):
    from ordwave.streaming import stateful

    values = [1.0, None, 2.0, 200.0, 201.0, None, 3.0, 3.0]
    spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "s int, o long, v double").write.parquet(str(tmp_path / "in"))
    for name, build in (("scene", lambda d: stateful.stream_scenes(d, "s", "o", "v", 3, 1.0)), ("dedup", lambda d: stateful.stream_dedup(d, "s", "o", "v", 1.5, 4))):
        source = spark.readStream.schema("s int, o long, v double").parquet(str(tmp_path / "in"))
        build(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    flags = [r["is_scene"] for r in spark.read.parquet(str(tmp_path / "scene")).orderBy("o").collect()]
    placed = sequences.positions(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "s int, o long, v double"), "s", "o")
    measured = sequences.with_neighbour(placed, "s", "v", "p").withColumn("d", F.abs(F.col("v") - F.col("p")))
    assert flags == [r["is_scene"] for r in scenes.scene_adaptive(measured, "s", "d", F.lit(False), 3, 1.0).orderBy("pos").collect()]
    assert flags == [False, False, False, True, False, False, False, False]
    batch = dedup.dedup_anchor(placed, "s", "v", 1.5, 4, []).orderBy("pos").collect()
    assert [r["kept"] for r in spark.read.parquet(str(tmp_path / "dedup")).orderBy("o").collect()] == [r["kept"] for r in batch]


def test_ties_of_order(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, 5, "q")]
    got = sequences.positions(spark.createDataFrame(rows, "s int, o long, name string"), "s", ["o", "name"]).collect()
    assert {(r["s"], r["name"]): r["pos"] for r in got} == {(1, "z"): 0, (1, "a"): 1, (1, "b"): 2, (2, "q"): 0}


def test_positions_of_sparse_orders(spark, monkeypatch):
    """Time stamps far apart: slices are as wide as they need to be to hold many rows."""
    monkeypatch.setattr(sequences, "BLOCK", 50)
    rows = [(i % 3, 1_700_000_000_000_000 + i * 7_000_000, i) for i in range(300)] + [(1, None, -1), (None, 5, -2)]
    df = spark.createDataFrame(rows, "s int, o long, i int")
    width = sequences.slice_width(df.where("s is not null"), "o", 50)
    assert 40 * 7_000_000 < width < 60 * 7_000_000
    got = {r["i"]: r["pos"] for r in sequences.positions(df, "s", "o", None).collect()}
    assert got == {i: i // 3 for i in range(300)}
    assert sequences.positions(df.where("s > 5"), "s", "o", None).count() == 0


def test_fill_takes_a_pandas_udf(placed, rows):
    """A model in place of the linear blend: it sees both ends and the time, in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("double")
    def model(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        return a + 10 * b + 100 * t

    got = {(r["s"], r["pos"], r["sub_no"]): r["v"] for r in fill.fill(placed, "s", "v", F.lit(1), blend=model).collect()}
    for s, vs in by_sequence(rows).items():
        for i, v in enumerate(vs):
            assert got[s, i, 0] == v and got[s, i, 1] == pytest.approx(v + 10 * (vs[i + 1] if i + 1 < len(vs) else v) + 50)


def test_written_images(spark, tmp_path):
    df = spark.createDataFrame([(7, b"abc"), (123456789, b"")], "n long, data binary")
    got = {(r["name"], r["size"]) for r in probe.write_images(df, f"file://{tmp_path}/out", "n", "data").collect()}
    assert got == {("00000007.png", 3), ("123456789.png", 0)} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["00000007.png", "123456789.png"]


def test_canny():
    import numpy as np

    from ordwave.functions.grids import canny_edges

    px = np.full((12, 12), 10.0)
    px[:, 6:] = 60.0
    edges = canny_edges(px)
    assert edges[:, 5:7].any(1).all() and not edges[:, :4].any() and not edges[:, 8:].any()
    assert not canny_edges(np.full((6, 6), 3.0)).any()


def test_mirrored_indexes(spark):
    import numpy as np

    from ordwave.functions import grids

    px = [float(i) for i in range(12)]
    df = spark.createDataFrame([(px,)], "px array<double>")
    got = df.select(grids.pad_reflect(F.col("px"), 3, 4, 2, 3, 1, 2).alias("p")).first()["p"]
    assert got == np.pad(np.reshape(px, (3, 4)), ((2, 1), (3, 2)), mode="reflect").ravel().tolist()


def test_options_on_odd_texts(spark):
    from ordwave.functions import rules

    texts = ["", None, "-a", "a||b", "-a||-b||c||-a||d", "\\-x\\||\\'q\\'"]
    got = [{p["flag"]: p["value"] for p in r["o"] or []} for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rules.command_options(F.col("t")).alias("o")).collect()]
    assert got == [{"": ""}, {}, {"-a": ""}, {"": "b"}, {"-a": "d", "-b": "c"}, {"-x": "'q'"}]


def test_empty(spark):
    none = sequences.positions(spark.createDataFrame([], "s int, o long, v double"), "s", "o")
    assert dedup.dedup_anchor(none, "s", "v", 1.0, 3, []).count() == fill.fill(none, "s", "v", F.lit(2)).count() == 0
