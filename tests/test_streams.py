"""Streams over several micro-batches and a restart, against folds over the whole input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ordwave.operators import dedup, fill, relate, scenes, sequences
from ordwave.plans.streams import streamed
from ordwave.streaming import stateful

MINUTE = 60_000_000


def timed(df):
    return df.withWatermark("at", "0 seconds")


def with_time(spark, rows, schema):
    """Rows whose column t is microseconds of event time since a day long after the first, at which watermarks begin."""
    return spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_micros(F.col("t") + 1_000_000_000 * 1_000_000))


@pytest.fixture(scope="module")
def values():
    """Three sequences of one order: long runs of equal values, jumps, and one that ends early."""
    rnd = random.Random(9)
    rows, v = [], [0.0, 50.0, 0.0]
    for i in range(240):
        s = rnd.choices([0, 1, 2], [6, 3, 1 if i < 90 else 0])[0]
        v[s] = rnd.choices([v[s], v[s] + rnd.uniform(-3, 3), rnd.uniform(0, 150), 0.0], [4, 5, 2, 1])[0]
        rows.append((s, i, v[s], v[s] < 20.0))
    return rows


@pytest.mark.parametrize("how", [{}, {"pure": "dark"}, {"fixed": 30.0}, {"disabled": True}])
def test_scenes(spark, values, how):
    rows = spark.createDataFrame([*values, (0, 300, None, None), (0, 301, 5.0, None), (0, 302, 140.0, False)], "s int, t long, v double, dark boolean")
    got = streamed(rows, "t", lambda d: stateful.stream_scenes(d, "s", "t", "v", 4, 1.0, **how), files=7)
    placed = sequences.with_neighbour(sequences.positions(rows, "s", "t"), "s", "v", "p").withColumn("d", F.abs(F.col("v") - F.col("p")))
    pure = F.coalesce(F.col("dark"), F.lit(False)) if "pure" in how else F.lit(False)
    batch = scenes.scene_adaptive(placed, "s", "d", pure, 4, 1.0, **{k: x for k, x in how.items() if k != "pure"})
    want = {(r["s"], r["t"]): r["is_scene"] for r in placed.select("s", "pos", "t").join(batch, ["s", "pos"]).collect()}
    found = {(r["s"], r["t"]): r["is_scene"] for r in got.collect()}
    assert found == want and len(found) == 243 and any(want.values()) == ("disabled" not in how)
    plain = {}
    for s in (0, 1, 2):
        state, last = scenes.SceneState(4, 1.0, **{k: x for k, x in how.items() if k != "pure"}), None
        for row in [r for r in rows.orderBy("t").collect() if r["s"] == s]:
            d = None if row["v"] is None or last is None else abs(row["v"] - last)
            plain[s, row["t"]] = state.step(d, bool(row["dark"]) and "pure" in how)
            last = row["v"]
    assert found == plain


@pytest.mark.parametrize("mix", [False, True])
def test_interpolation(spark, values, mix):
    """Rows out are rows in, as the batch operators make them; open runs live in the state through files and the restart."""
    rows = with_time(spark, [(s, i * MINUTE, v) for s, i, v, _ in values], "s int, t long, v double")
    idle = 1000 * MINUTE
    end = with_time(spark, [(None, 2000 * MINUTE, None)], "s int, t long, v double")
    build = lambda d: stateful.stream_interpolate(timed(d), "s", "at", "v", 4.0, 5, 40.0, idle=idle, mix=mix)
    got = {(r["s"], r["pos"]): (r["sub_no"], r["v"]) for r in streamed(rows, "t", build, files=9, end=end).collect()}
    placed = sequences.with_neighbour(sequences.positions(rows, "s", "t"), "s", "v", "p")
    placed = placed.withColumn("scene", F.coalesce(F.abs(F.col("v") - F.col("p")) > 40, F.lit(False)))
    runs = dedup.dedup_anchor(placed, "s", "v", 4.0, 5, ["v", "scene"], scene="scene").withColumn("run", F.col("pos") - F.col("absorbed"))
    size = runs.groupBy("s", "run").agg(F.max("absorbed").cast("int").alias("n"), F.min_by("v", F.when(F.col("absorbed") > 0, F.col("absorbed"))).alias("first"), F.max_by("v", "absorbed").alias("last"), F.min_by("v", "absorbed").alias("v"), F.min_by("scene", "absorbed").alias("scene"))
    want = {(r["s"], r["run"] + r["sub_no"]): (r["sub_no"], r["v"]) for r in fill.fill_scenes(size, "s", "v", mix=mix).collect()}
    assert got.keys() == want.keys() and len(got) == len(values)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_interpolation_of_what_ends(spark):
    """A sequence to which nothing comes for `idle` ends, by its timer or by its own next rows; the row before a scene repeats the first absorbed one."""
    rows = [(1, 0, 10.0), (1, 1, 11.0), (1, 2, 12.0), (2, 3, 5.0), (2, 4, 99.0), (3, 5, 7.0), (1, 60, 10.5), (2, 61, 99.5), (2, 62, None), (None, 63, 1.0), (2, 64, 98.0), (2, 65, 98.5), (2, 66, 0.0), (3, 70, 7.5)]
    df = with_time(spark, [(s, t * MINUTE, v) for s, t, v in rows], "s int, t long, v double")
    end = with_time(spark, [(None, 500 * MINUTE, None)], "s int, t long, v double")
    want = {(1, 0): 10.0, (1, 1): 10.0 + 2 / 3, (1, 2): 10.0 + 4 / 3, (1, 3): 10.5, (2, 0): 5.0, (2, 1): 99.0, (2, 2): 99.5, (2, 3): 98.75, (2, 4): 98.0, (2, 5): 0.0, (3, 0): 7.0, (3, 1): 7.5}
    for files in (1, 3, 14):
        made = streamed(df, "t", lambda d: stateful.stream_interpolate(timed(d), "s", "at", "v", 4.0, 5, 40.0, idle=30 * MINUTE), files=files, end=end).collect()
        assert sorted((r["s"], round(r["v"], 9)) for r in made) == sorted((s, round(v, 9)) for (s, _), v in want.items())
        if files == 1:  # the gap shows in the next row, and places go on
            assert {(r["s"], r["pos"]): r["v"] for r in made} == {k: pytest.approx(v) for k, v in want.items()}
        else:  # a timer sees the end of sequence 3 before its next row comes, and places begin again
            assert [r["pos"] for r in made if r["s"] == 3] == [0, 0]


def plain_overdue(rows, now, interval):
    """{(worker, task): whole intervals that it ran}."""
    out, workers = {}, {r[0] for r in rows}
    for w in workers:
        own = sorted((t, name, begins) for x, name, t, begins in rows if x == w)
        for (t, name, begins), following in zip(own, [*own[1:], (now, None, None)]):
            if begins and (n := (following[0] - t) // interval) > 0:
                out[w, name] = n
    return out


@pytest.mark.parametrize("files", [1, 6, 25])
def test_overdue(spark, files):
    """Each passed interval is told once, whether a timer saw it or the end came first; also over a restart."""
    rnd = random.Random(files)
    rows, t = [], 0
    for i in range(120):
        t += rnd.choice([1, 2, 5, 30, 60, 61, 200]) * 1000
        rows.append((rnd.randrange(4), f"task {i}", t, rnd.random() < 0.7))
    df = with_time(spark, [*rows, (None, "nobody's", t, True)], "w int, name string, t long, begins boolean")
    told = streamed(df, "t", lambda d: stateful.stream_overdue(timed(d), "w", "name", "at", 60_000, begins="begins"), files=files).collect()
    want = plain_overdue(rows, t, 60_000)
    seen = {}
    for r in told:
        seen.setdefault((r["w"], r["name"]), []).append(r["n_overdue"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(1, n + 1)) for k, n in want.items()}
    starts = {(w, name): at for w, name, at, _ in rows}
    assert all(r["n_overdue"] * 60_000 + starts[r["w"], r["name"]] == round(r["at"].timestamp() * 1e6) - 1_000_000_000 * 1_000_000 for r in told)
    tasks = sequences.with_neighbour(sequences.positions(spark.createDataFrame(rows, "w int, name string, t long, begins boolean"), "w", "t"), "w", "t", "done", step=1)
    late = relate.overdue(tasks.where("begins").withColumns({"every": F.lit(60_000), "now": F.lit(t)}), "t", "every", "done", "now")
    assert {(r["w"], r["name"]): r["n_overdue"] for r in late.collect()} == want


def test_empty_streams(spark):
    none = with_time(spark, [], "s int, t long, v double")
    assert streamed(none, "t", lambda d: stateful.stream_scenes(d, "s", "t", "v")).count() == 0
    assert streamed(none, "t", lambda d: stateful.stream_interpolate(timed(d), "s", "at", "v", 4.0, 5, 40.0, idle=1)).count() == 0
    assert streamed(none, "t", lambda d: stateful.stream_overdue(timed(d), "s", "v", "at", 1)).count() == 0


class Kept:
    """A list state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows


def test_state_calls_of_a_page():
    """All sequences of a page take one call to read their state and one to write it, and give one table."""
    import types

    import pandas as pd
    from pyspark.sql import types as T

    kept = Kept()
    scenes_of = stateful._Scenes(T.StructField("s", T.LongType()), "t", "v", None, length=4, threshold=1.0, fixed=30.0)
    scenes_of.timed = False
    scenes_of.init(types.SimpleNamespace(getListState=lambda name, schema: kept))
    made = []
    for batch in range(3):
        rows = pd.DataFrame([(s, 10 * batch + t, float((s * 37 + (10 * batch + t) * 53) % 90)) for t in range(2) for s in range(200)], columns=["s", "t", "v"])
        made += scenes_of.handleInputRows((0,), iter([rows[:150], rows[150:]]), None)
    assert len(made) == 3 and kept.calls == 6 and len(kept.rows) == 200
    last = {}
    for r in pd.concat(made).itertuples():
        assert r.is_scene == (r.s in last and abs(r.v - last[r.s]) >= 30)
        last[r.s] = r.v


def test_pages_and_files(spark, monkeypatch):
    """Sequences that share a page, and micro-batches of several files, are told the same; a page's one timer serves all."""
    from ordwave.plans import streams

    monkeypatch.setattr(stateful, "PAGES", 2)
    monkeypatch.setattr(streams, "FILE_ROWS", 8)
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(200):
        t += rnd.choice([1, 2, 5, 30, 60, 61, 200]) * 1000
        rows.append((rnd.randrange(9), f"task {i:03}", t, rnd.random() < 0.7))
    df = with_time(spark, rows, "w int, name string, t long, begins boolean")
    told = streamed(df, "t", lambda d: stateful.stream_overdue(timed(d), "w", "name", "at", 60_000, begins="begins"), files=5).collect()
    assert sorted((r["w"], r["name"], r["n_overdue"]) for r in told) == sorted((*k, n) for k, most in plain_overdue(rows, t, 60_000).items() for n in range(1, most + 1))


def test_overdue_where_ids_do_not_follow_time(spark, tmp_path):
    """Users whose events have larger ids but no later times are not late."""
    import duckdb

    from ordwave.plans import catalog, streams

    db, place = duckdb.connect(), f"{tmp_path}/events.parquet"
    db.execute(f"copy (select event_id + 1000000 * k as event_id, ts, user_id + 1000000 * k as user_id, value from '/root/testdata/sf0.001/events.parquet', range(3) r(k)) to '{place}' (format parquet)")
    db.execute(f"create view events as select * from '{place}'")
    got = sorted(tuple(r) for r in streams.stream_overdue(spark, str(tmp_path)).select("user_id", "event_id", "n_overdue").collect())
    assert got and got == sorted(db.execute(catalog.SQL["overdue"]).fetchall())


class Received(stateful._Scenes):
    """Gives a row for each call: how many rows the worker was handed for the page."""

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        yield pd.DataFrame({"s": [key[0]], "t": [sum(len(frame) for frame in rows)], "v": [0.0], "is_scene": [False]})


def test_rows_come_packed(spark):
    """A page's rows of a task come as one, not one by one."""
    from pyspark.sql import types as T

    rows = spark.createDataFrame([(k % 50, k, float(k)) for k in range(4000)], "s long, t long, v double")
    schema = T.StructType([*rows.schema, T.StructField("is_scene", T.BooleanType())])
    got = streamed(rows, "t", lambda d: stateful.with_state(d, Received(rows.schema["s"], "t", "v", None, length=4, threshold=1.0), schema, pages=5), files=2).collect()
    assert sorted((r["s"], r["t"]) for r in got) == [(page, 1) for page in range(5) for _ in range(2)]


def test_packed_columns(spark, monkeypatch):
    """Packing keeps the values of all kinds, their order within a page and every row; scenes follow an order that is a time."""
    monkeypatch.setattr(stateful, "PACKED", 7)
    rows = [(k % 3, k, None if k % 5 == 0 else f"n{k}", k * 1.5 if k % 4 else None, k % 2 == 0) for k in range(100)]
    df = spark.createDataFrame(rows, "page long, k long, name string, v double, flag boolean").coalesce(1)
    got = [(r["page"], *x) for r in stateful.packed(df, "page").collect() for x in zip(r["k"], r["name"], r["v"], r["flag"])]
    assert sorted(got) == sorted(rows) and [x for x in got if x[0] == 1] == [x for x in rows if x[0] == 1]
    timed_rows = with_time(spark, [(f"s{k % 4}", k * MINUTE, float(k * 37 % 90)) for k in range(120)], "s string, t long, v double")
    for order in ("at", "t"):
        made = streamed(timed_rows, "t", lambda d: stateful.stream_scenes(d, "s", order, "v", fixed=30.0), files=3).select("s", F.unix_micros(F.col(order)) if order == "at" else F.col("t") + 1_000_000_000 * 1_000_000, "is_scene").collect()  # noqa: B023
        assert sorted(map(tuple, made)) == sorted((f"s{k % 4}", k * MINUTE + 1_000_000_000 * 1_000_000, k >= 4 and abs(k * 37 % 90 - (k - 4) * 37 % 90) >= 30) for k in range(120))


def test_late_rows(spark):
    """A row from before its sequence's last one is left out; one that is late for others only counts."""
    first = stateful._Overdue(*[spark.createDataFrame([], f"{c} string").schema[c] for c in ("w", "name")], 60, False)
    out = []
    state = first.fold("a", [["x"], [100]], None, out)
    assert first.fold("a", [["old"], [40]], state, out) == state and not out
    assert first.fold("b", [["old"], [40]], None, out) == ("old", 40, 0)


def test_spread_is_found_once_a_row(monkeypatch):
    """The labeller takes the spread before a row from the row before, also after cuts, learning and replaced rows."""
    calls, plain = [], scenes.SceneState.spread
    monkeypatch.setattr(scenes.SceneState, "spread", lambda self: calls.append(1) or plain(self))
    rnd = random.Random(5)
    state, again = scenes.SceneState(4, 1.0), scenes.SceneState(4, 1.0)
    for _ in range(300):
        d, how = rnd.choice([0.0, 1.0, rnd.uniform(0, 60), 90.0]), {rnd.choice(["only_learn", "replace_last"]): rnd.random() < 0.2}
        again.known = None  # found anew
        assert state.step(d, False, **how) == again.step(d, False, **how) and state.diffs == again.diffs
    calls.clear()
    state = scenes.SceneState(4, 1e9)
    for k in range(104):
        state.step(1.0 + k % 7, False)
    assert len(calls) == 101


def test_sequences_share_rows_of_state(monkeypatch):
    """A page's state is moved as few rows of arrays, not a row for each sequence; all kinds of fields come back as they were."""
    import types

    from pyspark.sql import types as T

    monkeypatch.setattr(stateful, "TOGETHER", 3)
    key, name = T.StructField("s", T.StringType()), T.StructField("name", T.StringType())
    states = {
        stateful._Scenes(key, "t", "v", "p", length=4, threshold=1.0): [(1.5, True, [0.5, 2.0]), (None, False, []), (0.0, True, [1.0])],
        stateful._Dedup(key, "t", "v", 4.0, 5): [(1.5, 2), (None, 0)],
        stateful._Interpolation(key, "v", 4.0, 5, 40.0, False, 60, stateful.linear): [(1.5, 7, 2.5, 10, [1.0, 2.0]), (0.5, 0, 0.5, 11, [])],
        stateful._Overdue(key, name, 60, False): [("a", 1, 0), (None, 2, 3)],
    }
    for processor, some in states.items():
        kept, processor.together = Kept(), stateful.TOGETHER
        processor.init(types.SimpleNamespace(getListState=lambda name, schema, kept=kept: kept))
        want = {f"s{k}": list(some[k % len(some)]) for k in range(10)}
        processor._store(want)
        assert len(kept.rows) == 4 and all(len(row) == len(processor.state) and len(set(map(len, row))) == 1 for row in kept.rows)
        assert all(isinstance(field.dataType, T.ArrayType) for field in processor.state)
        assert processor._load() == want


@pytest.mark.parametrize("together", [2, 4096])
def test_streams_with_shared_rows_of_state(spark, values, monkeypatch, together):
    """Runs and scenes are carried over micro-batches and the restart in rows of state that several sequences share, also where keys are text and values are null."""
    monkeypatch.setattr(stateful, "PAGES", 1)
    monkeypatch.setattr(stateful, "TOGETHER", together)
    rows = [(f"s{s}", i, v, dark) for s, i, v, dark in values] + [("s0", 300, None, None), ("s0", 301, 5.0, None)]
    df = spark.createDataFrame(rows, "s string, t long, v double, dark boolean")
    got = streamed(df, "t", lambda d: stateful.stream_scenes(d, "s", "t", "v", 4, 1.0, pure="dark"), files=5)
    want = {}
    for s in ("s0", "s1", "s2"):
        state, last = scenes.SceneState(4, 1.0), None
        for _, i, v, dark in sorted(r for r in rows if r[0] == s):
            want[s, i] = state.step(None if v is None or last is None else abs(v - last), bool(dark))
            last = v
    assert {(r["s"], r["t"]): r["is_scene"] for r in got.collect()} == want
