"""Raw video files as a data source: frames by byte ranges, so that one large file is read by many tasks and a resumed scan reads its tail alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .scratch import filesystem

#: Bytes of a split and of a batch, about: whole frames, one at least.
SPLIT, BATCH = 64 << 20, 4 << 20


@dataclass
class Frames(InputPartition):
    """Frames first to last - 1 of a file."""

    path: str
    first: int
    last: int


class RawReader(DataSourceReader):
    """Splits files at frames. Filters on frame_no narrow the range of frames, before any byte is read."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        bits = int(options.get("bits", "8"))
        if bits not in (8, 16):
            raise ValueError(f"samples of {bits} bits")
        self.sample = np.dtype("u1" if bits == 8 else ">u2" if options.get("order", "little") == "big" else "<u2")
        self.samples = int(options["height"]) * int(options["width"]) * int(options.get("channels", "1"))
        if self.samples < 1:
            raise ValueError("a frame has no samples")
        self.frame = self.samples * self.sample.itemsize
        self.split = max(1, int(options.get("splitBytes", SPLIT)) // self.frame)
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps bounds on frame_no to itself and gives back all other filters."""
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_no",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Frames]:
        from pyarrow import fs

        where, path = filesystem(self.path)
        found = where.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path))
        out = []
        for info in sorted(files, key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                end = min(self.high, info.size // self.frame)  # a short rest is no frame
                out += [Frames(info.path, a, min(end, a + self.split)) for a in range(self.low, end, self.split)]
        return out

    def open(self, path: str):
        return filesystem(self.path)[0].open_input_file(path)

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no frames
            return
        step = max(1, BATCH // self.frame)
        name = partition.path.rpartition("/")[2]
        with self.open(partition.path) as source:
            for first in range(partition.first, partition.last, step):
                n = min(step, partition.last - first)
                source.seek(first * self.frame)
                data = source.read(n * self.frame)
                if len(data) != n * self.frame:
                    raise OSError(f"{partition.path} became shorter while it was read")
                px = pa.array(np.frombuffer(data, self.sample).astype(np.int32))
                ends = pa.array(np.arange(0, (n + 1) * self.samples, self.samples, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, px)], ["file", "frame_no", "px"])


class RawFrames(DataSource):
    """Format `rawframes`: file, frame_no and px (samples of a frame, rows of pixels of channels) of a raw file or a folder of them.

    Options: height, width, channels (1), bits (8 or 16), order of a sample's bytes (little or big), splitBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return "file string, frame_no bigint, px array<int>"

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)


def read_raw(spark: SparkSession, path: str, height: int, width: int, channels: int = 1, bits: int = 8, order: str = "little", split_bytes: int = SPLIT) -> DataFrame:
    """file, frame_no and px of raw video; a filter on frame_no, as resuming has, reads only the frames' bytes.

    The session pushes filters to Python sources from then on. Files lie where pyarrow reaches them.
    """
    spark.dataSource.register(RawFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"height": height, "width": width, "channels": channels, "bits": bits, "order": order, "splitBytes": split_bytes}
    return spark.read.format("rawframes").options(**options).load(path)


def write_raw(df: DataFrame, path: str, file: str, order_by: str, px: str, bits: int = 8, order: str = "little") -> DataFrame:
    """Writes a raw file for each value of `file`, its rows' samples in the order of `order_by`. Returns file and size.

    A file is made by one task that holds its samples; it is written under another name and then renamed.
    """
    sample = "u1" if bits == 8 else ">u2" if order == "big" else "<u2"

    def run(table: pa.Table) -> pa.Table:
        import uuid

        rows = table.sort_by("order_by")
        data = np.concatenate([x.values.to_numpy() for x in rows.column("px")] or [np.zeros(0)]).astype(sample).tobytes()
        name = rows.column("file")[0].as_py()
        where, folder = filesystem(path)
        where.create_dir(folder, recursive=True)
        part = f"{folder}/_{name}-{uuid.uuid4().hex}"
        with where.open_output_stream(part) as out:
            out.write(data)
        where.move(part, f"{folder}/{name}")
        return pa.table({"file": [name], "size": pa.array([len(data)], pa.int64())})

    rows = df.selectExpr(f"`{file}` AS file", f"`{order_by}` AS order_by", f"`{px}` AS px")
    return rows.groupBy("file").applyInArrow(run, "file string, size long")
