"""Packed groups: how whole texts and compact questions about them move between tasks.

Documents are dealt to groups by a hash of their content, packed and compressed, and shuffled once.
Each group asks questions about distinct things (words, shingles, minimisers); the questions are
dealt by a hash of the thing to buckets that answer them; answers travel back to the group.
A frequent thing is asked once per group, so no bucket grows with the copies of one thing.

Up to DIRECT groups each group sends each bucket a message. With more, messages go over relays: a
relay takes what about sqrt(groups) groups have for about sqrt(groups) buckets, and passes it on as
one message to each bucket. So messages grow with the power 1.5 of the groups and hold many
questions at any size, and a relay holds no more than a group does.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, remove_at_exit, shared_dir
from .text import give_back

PACKED = "grp long, payload binary"
#: Bytes of a row group in written tables, so that tasks that write long texts hold little.
ROW_GROUP = 16 << 20
#: Groups up to which messages go straight to their buckets.
DIRECT = 4096
_MESSAGE = "grp long, bucket long, payload binary"
_ipc = pa.ipc.IpcWriteOptions(compression="zstd")


class Frozen:
    """A DataFrame written to the shared folder and read back: its lineage ends here.

    `clean` lets Spark delete the shuffle files that led here, for results of large shuffles. With
    `bucket` (a column and a number) rows are written by a hash of that column into so many files,
    and joins on the column need not shuffle this side again.
    """

    def __init__(self, df: DataFrame, clean: bool = False, bucket: tuple[str, int] | None = None):
        self.spark = df.sparkSession
        self.name = f"ordwave_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        self.bucketed = bucket is not None
        if bucket:
            column, n = bucket
            written = df.repartition(n, column).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
            written.bucketBy(n, column).option("path", self.path).format("parquet").saveAsTable(self.name)
            self.df = self.spark.table(self.name)
        else:
            df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)
        remove_at_exit(self.spark, self.path)
        del df
        if clean:
            release(self.spark)

    def drop(self) -> None:
        if self.bucketed:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to; it waits for a collection on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ipc) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(payloads) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads]).combine_chunks()


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces(n_bytes: int, size: int) -> int:
    return max(1, -(-n_bytes // size))


def pack(df: DataFrame, key: list[str], groups: int, flush_bytes: int = 24 << 20) -> DataFrame:
    """Rows of df (all columns), dealt to groups by a hash of the key columns, as (grp, payload).

    The n-th repetition of a key within a task goes n groups further, so that one repeated row
    cannot fill a group. Groups depend on the rows alone, so a lost task can be run again. A task
    remembers one number for each of its keys. Groups are dealt to partitions of a few groups each.
    """
    names = df.columns
    hashed = df.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in key]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, {}

        def out():
            table = pa.Table.from_batches(held)
            grp = table.column("__grp").to_numpy()
            order = np.argsort(grp, kind="stable")
            cut = np.flatnonzero(np.diff(grp[order], prepend=-1))
            table = table.select(names).take(order)
            ends = [*cut[1:], len(order)]
            for a, b in zip(cut, ends):
                yield pa.RecordBatch.from_arrays([pa.array([grp[order[a]]], pa.int64()), pa.array([to_ipc(table.slice(a, b - a))], pa.binary())], ["grp", "payload"])

        for batch in batches:
            keys = batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64)
            nth = np.zeros(len(keys), np.int64)
            for i, k in enumerate(keys.tolist()):
                n = seen.get(k)
                if n is None:
                    seen[k] = 1
                else:
                    nth[i], seen[k] = n, n + 1
            grp = ((keys.view(np.uint64) % np.uint64(groups)).astype(np.int64) + nth) % groups
            held.append(pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(grp)], [*names, "__grp"]))
            size += batch.nbytes
            if size >= flush_bytes:
                yield from out()
                held, size = [], 0
                give_back()
        if held:
            yield from out()
        held = []
        give_back()

    return hashed.mapInArrow(run, PACKED).repartition(parts_of(groups), "grp")


def parts_of(groups: int) -> int:
    """Partitions for so many groups: a few groups each, so that a task's share stays as it is at any size."""
    return groups if groups <= 64 else max(64, groups // 4)


def group_rows(table: pa.Table, order_by: list[str]) -> pa.Table:
    """The rows of a group in an order that depends on the rows alone."""
    return from_ipc(table.column("payload").to_pylist()).sort_by([(c, "ascending") for c in order_by])


def _bundle(keys, payloads: list[bytes]) -> bytes:
    return to_ipc(pa.table({"key": pa.array(keys, pa.int64()), "payload": pa.array(payloads, pa.binary())}))


def _unbundle(bundle: bytes) -> tuple[list[int], list[bytes]]:
    table = from_ipc([bundle])
    return table.column("key").to_pylist(), table.column("payload").to_pylist()


def _rows(names: list[str], rows: list[tuple]) -> pa.Table:
    """A table of rows whose last column is binary and whose others are long."""
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.binary() if n == "payload" else pa.int64()) for n, c in zip(names, columns)})


def _turned(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Of (outer key, bundle of inner keys), the same payloads as (inner key, bundle of outer keys)."""
    by: dict[int, tuple[list, list]] = {}
    for outer, bundle in rows:
        for inner, payload in zip(*_unbundle(bundle)):
            keys, payloads = by.setdefault(inner, ([], []))
            keys.append(outer)
            payloads.append(payload)
    return [(inner, _bundle(*by[inner])) for inner in sorted(by)]


class Routes:
    """How the questions of `groups` groups reach `buckets` buckets, and the answers their groups."""

    def __init__(self, groups: int, buckets: int):
        self.groups, self.buckets = groups, buckets
        self.fan = math.isqrt(groups - 1) + 1 if groups > DIRECT else 0
        self.span = -(-buckets // self.fan) if self.fan else 1

    def messages(self, grp: int, found: list[tuple[int, bytes]]) -> pa.Table:
        """A group's payloads for buckets as rows to send."""
        if self.fan:
            bundles: dict[int, tuple[list, list]] = {}
            for bucket, payload in found:
                keys, payloads = bundles.setdefault(bucket // self.span, ([], []))
                keys.append(bucket)
                payloads.append(payload)
            found = [(relay, _bundle(*b)) for relay, b in bundles.items()]
        return _rows(["grp", "bucket", "payload"], [(grp, *x) for x in found])

    def ask(self, packed: DataFrame, extract: Callable[[pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
        """What each group has to ask of which bucket."""

        def run(key, table):
            found = extract(table)
            give_back()
            return self.messages(key[0].as_py(), found)

        return packed.groupBy("grp").applyInArrow(run, _MESSAGE)

    def answer(self, asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
        """Answers a bucket's payloads together, one reply for each."""
        if not self.fan:

            def run(table):
                out = reply(table.column("payload").to_pylist())
                give_back()
                return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})

            return asked.repartition(parts_of(self.buckets), "bucket").groupBy("bucket").applyInArrow(run, _MESSAGE)

        fan = self.fan

        def forward(table):
            block, relay = table.column("block")[0].as_py(), table.column("bucket")[0].as_py()
            out = _turned(list(zip(table.column("grp").to_pylist(), table.column("payload").to_pylist())))
            give_back()
            return _rows(["block", "relay", "bucket", "payload"], [(block, relay, *x) for x in out])

        def judge(table):
            opened = [_unbundle(p) for p in table.column("payload").to_pylist()]
            replies = iter(reply([p for _, payloads in opened for p in payloads]))
            out = [_bundle(grps, [next(replies) for _ in grps]) for grps, _ in opened]
            give_back()
            return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))

        def backward(table):
            relay = table.column("relay")[0].as_py()
            out = _turned(list(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist())))
            give_back()
            return _rows(["grp", "bucket", "payload"], [(grp, relay, bundle) for grp, bundle in out])

        kind, parts = "block long, relay long, bucket long, payload binary", parts_of(self.groups)
        sent = asked.withColumn("block", F.floor(F.col("grp") / fan)).repartition(parts, "block", "bucket").groupBy("block", "bucket").applyInArrow(forward, kind)
        judged = sent.repartition(parts_of(self.buckets), "bucket").groupBy("bucket").applyInArrow(judge, kind)
        return judged.repartition(parts, "block", "relay").groupBy("block", "relay").applyInArrow(backward, _MESSAGE)

    def opened(self, replies: pa.Table) -> dict[int, bytes]:
        """A group's replies by bucket."""
        buckets, payloads = replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()
        return {b: p for bundle in payloads for b, p in zip(*_unbundle(bundle))} if self.fan else dict(zip(buckets, payloads))

    def resolve(self, packed: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema) -> DataFrame:
        """Brings the answers back to their group: finish(table of the group, payload by bucket)."""

        def run(table, replies):
            out = finish(table, self.opened(replies))
            give_back()
            return out

        return packed.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, schema)


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, compressed; the length goes first."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)
