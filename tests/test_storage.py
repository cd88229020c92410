"""Raw frames by byte ranges, and chunks in whole commits."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from ordwave.sources import chunk_sink, raw


# --- raw frames


@pytest.mark.parametrize("bits, order", [(8, "little"), (16, "little"), (16, "big")])
@pytest.mark.parametrize("split", [1, 100, 1 << 20])
def test_raw_frames(spark, tmp_path, bits, order, split):
    """Two files, one with a short rest, an empty one and one that is hidden; splits of one frame, of some, and of all."""
    rng = np.random.default_rng(bits)
    kind = "u1" if bits == 8 else ">u2" if order == "big" else "<u2"
    want = {}
    for name, n in (("a.raw", 7), ("b.raw", 31)):
        px = rng.integers(0, 2**bits, (n, 24))
        (tmp_path / name).write_bytes(px.astype(kind).tobytes() + b"rest")
        want |= {(name, i): px[i].tolist() for i in range(n)}
    (tmp_path / "empty.raw").write_bytes(b"")
    (tmp_path / "_part").write_bytes(b"x" * 480)
    df = raw.read_raw(spark, str(tmp_path), 2, 4, channels=3, bits=bits, order=order, split_bytes=split)
    assert {(r["file"], r["frame_no"]): r["px"] for r in df.collect()} == want
    assert {(r["file"], r["frame_no"]) for r in df.where("frame_no >= 5 and frame_no < 9 and file = 'b.raw'").collect()} == {("b.raw", i) for i in range(5, 9)}
    one = raw.read_raw(spark, f"file://{tmp_path}/a.raw", 2, 4, channels=3, bits=bits, order=order)
    assert one.where("frame_no = 6").collect()[0]["px"] == want["a.raw", 6] and one.where("frame_no > 6").count() == 0


class Counting(raw.RawReader):
    """Counts the bytes that it reads."""

    def __init__(self, options):
        super().__init__(options)
        self.bytes = 0

    def open(self, path):
        outer, inner = self, super().open(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                inner.close()

            def seek(self, at):
                inner.seek(at)

            def read(self, n):
                outer.bytes += n
                return inner.read(n)

        return File()


def test_a_resumed_scan_reads_its_tail_alone(tmp_path):
    (tmp_path / "v.raw").write_bytes(bytes(range(250)) * 400)  # 1000 frames of 100 bytes
    options = {"path": str(tmp_path / "v.raw"), "height": "10", "width": "10", "splitBytes": "5000"}
    for filters, frames in (([], range(1000)), ([GreaterThanOrEqual(("frame_no",), 990)], range(990, 1000)), ([GreaterThan(("frame_no",), 989), LessThanOrEqual(("frame_no",), 994)], range(990, 995)), ([EqualTo(("frame_no",), 5), LessThan(("frame_no",), 6)], range(5, 6)), ([LessThan(("frame_no",), 0)], range(0))):
        reader = Counting(options)
        assert list(reader.pushFilters(filters)) == []
        got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("frame_no").to_pylist()]
        assert got == list(frames) and reader.bytes == 100 * len(frames)
    other = [In(("frame_no",), (1, 2)), EqualTo(("file",), "v.raw")]
    assert list(Counting(options).pushFilters(other)) == other
    reader = Counting(options)
    parts = reader.partitions()
    assert len(parts) == 20 and all(p.last - p.first == 50 for p in parts)
    (tmp_path / "v.raw").write_bytes(b"short")
    with pytest.raises(OSError):
        list(reader.read(parts[-1]))


def test_pushed_filters_reach_the_scan(spark, tmp_path):
    (tmp_path / "v.raw").write_bytes(b"x" * 1000)
    df = raw.read_raw(spark, str(tmp_path), 10, 10, split_bytes=100)
    assert df.rdd.getNumPartitions() == 10 and df.where("frame_no >= 8").rdd.getNumPartitions() == 2


@pytest.mark.parametrize("options", [{"bits": "12"}, {"height": "0"}])
def test_raw_options(options):
    with pytest.raises(ValueError):
        raw.RawReader({"path": "/", "height": "1", "width": "1"} | options)


def test_written_raw(spark, tmp_path):
    rows = [("x.raw", 2, [3, 65535]), ("x.raw", 1, [1, 256]), ("y.raw", 0, [7, 8])]
    got = raw.write_raw(spark.createDataFrame(rows, "f string, n int, px array<int>"), str(tmp_path / "out"), "f", "n", "px", bits=16, order="big").collect()
    assert {tuple(r) for r in got} == {("x.raw", 8), ("y.raw", 4)}
    assert (tmp_path / "out/x.raw").read_bytes() == bytes([0, 1, 1, 0, 0, 3, 255, 255])


# --- chunks


def placed_rows(spark, sequences=2, n=50, value=1.0):
    return spark.createDataFrame([(s, i, value * (100 * s + i)) for s in range(1, sequences + 1) for i in range(n)], "s int, pos long, v double")


def chunks_of(spark, path):
    return {(r["s"], r["pos"]): (r["chunk_id"], r["v"], r["commit"]) for r in chunk_sink.read_chunks(spark, path, "s").collect()}


def test_a_chunk_written_again_replaces_its_own_rows(spark, tmp_path):
    path, rows = str(tmp_path / "c"), placed_rows(spark)
    chunk_sink.write_chunks(rows.repartition(3), 25, path)
    assert chunks_of(spark, path) == {(s, i): (i // 25, 100.0 * s + i, 0) for s in (1, 2) for i in range(50)}
    chunk_sink.write_chunks(rows.where("s = 1 and pos between 25 and 40").withColumn("v", F.lit(-1.0)), 25, path)
    want = {(2, i): (i // 25, 200.0 + i, 0) for i in range(50)} | {(1, i): (0, 100.0 + i, 0) for i in range(25)} | {(1, i): (1, -1.0, 1) for i in range(25, 41)}
    assert chunks_of(spark, path) == want
    chunk_sink.write_chunks(rows.where("s = 3"), 25, path)
    assert chunks_of(spark, path) == want


def test_a_killed_write_leaves_nothing(spark, tmp_path):
    """A task that fails after others have written, and a driver that dies before its commit."""
    path, rows = str(tmp_path / "c"), placed_rows(spark)
    chunk_sink.write_chunks(rows, 25, path)
    before = chunks_of(spark, path)
    broken = rows.withColumn("v", F.when((F.col("s") == 2) & (F.col("pos") == 49), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.lit(7.0)))
    with pytest.raises(Exception, match="lost"):
        chunk_sink.write_chunks(broken.repartitionByRange(4, "s", "pos"), 25, path)
    assert chunks_of(spark, path) == before and list(chunk_sink.committed(path)) == [0]
    writer = chunk_sink.Chunks({"path": path}).writer(None, False)
    batch = pa.RecordBatch.from_pylist([{"s": 1, "pos": 0, "v": 9.0, "chunk_id": 0}])
    lost = writer.write(iter([batch]))  # no commit follows
    kept = writer.write(iter([batch]))
    assert chunks_of(spark, path) == before and lost.rows == 1
    assert chunk_sink.remove_orphans(path) >= 2 and chunk_sink.remove_orphans(path) == 0 and chunks_of(spark, path) == before
    writer.abort([kept, None])

    def broken_off():
        yield batch
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        writer.write(broken_off())
    assert chunk_sink.remove_orphans(path) == 0


def test_a_commit_is_made_once(spark, tmp_path):
    path, rows = str(tmp_path / "c"), placed_rows(spark)
    chunk_sink.write_chunks(rows, 25, path, commit=5)
    chunk_sink.write_chunks(rows.withColumn("v", F.lit(0.0)), 25, path, commit=5)
    writer = chunk_sink.Chunks({"path": path, "commit": "5"}).writer(None, False)
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([{"s": 1, "pos": 0, "v": 9.0, "chunk_id": 0}])])), None])
    assert chunks_of(spark, path) == {(s, i): (i // 25, 100.0 * s + i, 5) for s in (1, 2) for i in range(50)}
    assert chunk_sink.remove_orphans(path) == 0
    manifest = json.loads((tmp_path / "c/_commits" / f"{5:020d}.json").read_text())
    assert manifest["rows"] == 100
    with pytest.raises(Exception, match="append"):
        chunk_sink.Chunks({"path": path}).writer(None, True)


@pytest.mark.parametrize("how", ["sink", "foreach"])
def test_a_stream_that_fails_after_its_commit(spark, tmp_path, how):
    """The micro-batch is replayed after the failure and its rows are there once; later batches replace chunks."""
    rnd = random.Random(3)
    want = {}
    for k in range(4):
        rows = [(s, i, float(rnd.randrange(100))) for s in (1, 2) for i in range(25 * k, 25 * k + 50)]  # each file has the last chunk of the one before again
        want |= {(s, i): (i // 25, v, k) for s, i, v in rows}
        spark.createDataFrame(rows, "s int, pos long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, state = str(tmp_path / "c"), str(tmp_path / "state")
    source = lambda: spark.readStream.schema("s int, pos long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if how == "sink":
        chunk_sink.stream_chunks(source(), 25, path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        for log in sorted((tmp_path / "state/commits").glob("[0-9]*"))[2:] + list((tmp_path / "state/commits").glob(".[0-9]*")):
            log.unlink()  # as if the driver had died after the commits of the last two batches
        chunk_sink.stream_chunks(source(), 25, path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    else:
        commit, failed = chunk_sink.each_batch(25, path), []

        def once_broken(batch, number):
            commit(batch, number)
            if number == 2 and not failed:
                failed.append(number)
                raise RuntimeError("lost after the commit")

        run = lambda: source().writeStream.foreachBatch(once_broken).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        with pytest.raises(Exception, match="lost"):
            run()
        run()
        assert failed == [2]
    assert chunks_of(spark, path) == want and list(chunk_sink.committed(path)) == [0, 1, 2, 3]
    chunk_sink.remove_orphans(path)
    assert chunks_of(spark, path) == want


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        chunk_sink.read_chunks(spark, str(tmp_path / "none"), "s")
    assert chunk_sink.committed(str(tmp_path / "none")) == {} and chunk_sink.remove_orphans(str(tmp_path / "none")) == 0
