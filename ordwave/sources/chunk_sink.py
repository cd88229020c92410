"""Chunks of sequences written in whole commits: what a commit's manifest lists is there, nothing else.

A folder holds data files and, in `_commits`, a manifest for each commit. Tasks write data files under
names of their own and report them; the driver's commit lists them in a manifest that it renames into
place. Files of tasks that failed, of writes that were killed and of copies of a task are in no
manifest, so no reader sees them. A chunk (sequence and chunk_id) that a later commit has replaces
what earlier ones had of it. A commit has a number; one that is there already is not made again, so a
replayed micro-batch changes nothing. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .scratch import filesystem

#: Rows after which a task begins a new file.
FILE_ROWS = 1 << 20
_COMMITS = "_commits"


def _manifests(path: str) -> dict[int, str]:
    """Commit numbers and the paths of their manifests."""
    from pyarrow import fs

    where, folder = filesystem(path)
    found = where.get_file_info(fs.FileSelector(f"{folder}/{_COMMITS}", allow_not_found=True))
    return {int(i.base_name[:-5]): i.path for i in found if i.base_name.endswith(".json") and i.base_name[:-5].isdigit()}


def committed(path: str) -> dict[int, list[str]]:
    """The data files of each commit."""
    where, _ = filesystem(path)
    out = {}
    for number, at in sorted(_manifests(path).items()):
        with where.open_input_stream(at) as source:
            out[number] = json.loads(source.read())["files"]
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class _Writing:
    """What batch and stream writers share: data files by tasks, a manifest by the driver."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = filesystem(self.path)
        files, rows, out, room = [], 0, None, 0
        try:
            for batch in iterator:
                if out is None or room <= 0:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.parquet")
                    where.create_dir(folder, recursive=True)
                    out, room = pq.ParquetWriter(f"{folder}/{files[-1]}", batch.schema, filesystem=where, compression="zstd"), FILE_ROWS
                out.write_batch(batch)
                rows, room = rows + batch.num_rows, room - batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
            self._drop(files)
            raise
        if out is not None:
            out.close()
        return Written(files, rows)

    def _drop(self, files: list[str]) -> None:
        where, folder = filesystem(self.path)
        for f in files:
            try:
                where.delete_file(f"{folder}/{f}")
            except FileNotFoundError:
                pass

    def _list(self, messages: list[Written | None], number: int) -> None:
        """The commit itself: the manifest comes into its place in one step, or is there already and these files go."""
        files = [f for m in messages if m is not None for f in m.files]
        if number in _manifests(self.path):
            self._drop(files)
            return
        where, folder = filesystem(self.path)
        where.create_dir(f"{folder}/{_COMMITS}", recursive=True)
        part = f"{folder}/{_COMMITS}/{uuid.uuid4().hex}.part"
        with where.open_output_stream(part) as out:
            out.write(json.dumps({"files": files, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        where.move(part, f"{folder}/{_COMMITS}/{number:020d}.json")

    def _forget(self, messages: list[Written | None]) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])


class _BatchWriter(_Writing, DataSourceArrowWriter):
    def __init__(self, path: str, number: int):
        super().__init__(path)
        self.number = number

    def commit(self, messages) -> None:
        self._list(messages, self.number)

    def abort(self, messages) -> None:
        self._forget(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._list(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._forget(messages)


class Chunks(DataSource):
    """Format `chunks` for writing: the option `commit` is the commit's number, else it is one more than the last; streams use their batch ids."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def writer(self, schema, overwrite: bool) -> _BatchWriter:
        if overwrite:
            raise ValueError("chunks are replaced by later commits; write with mode append")
        path = self.options["path"]
        number = self.options.get("commit")
        return _BatchWriter(path, int(number) if number is not None else max(_manifests(path), default=-1) + 1)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"])


def _numbered(placed: DataFrame, gap: int) -> DataFrame:
    return placed.withColumn("chunk_id", F.floor(F.col("pos") / gap).cast("long"))


def write_chunks(placed: DataFrame, gap: int, path: str, commit: int | None = None) -> None:
    """Writes the rows of placed(seq, pos, ...) with their chunk_id as one commit.

    A commit has to hold all rows of each chunk that it has. With a number that is there already nothing changes.
    """
    spark = placed.sparkSession
    if commit is not None and commit in _manifests(path):
        return
    spark.dataSource.register(Chunks)
    options = {} if commit is None else {"commit": commit}
    _numbered(placed, gap).write.format("chunks").options(**options).mode("append").save(path)


def stream_chunks(placed: DataFrame, gap: int, path: str):
    """A DataStreamWriter that commits the chunks of each micro-batch under its id; a checkpoint location is the caller's."""
    placed.sparkSession.dataSource.register(Chunks)
    return _numbered(placed, gap).writeStream.format("chunks").option("path", path)


def each_batch(gap: int, path: str):
    """The same for foreachBatch: batches that are replayed after a failure are committed once."""

    def commit(batch: DataFrame, number: int) -> None:
        write_chunks(batch, gap, path, commit=number)

    return commit


def read_chunks(spark: SparkSession, path: str, seq: str) -> DataFrame:
    """The rows of the last commit of each chunk, with chunk_id and commit.

    Commits whose chunks no later one has are read as they are; the others' replaced chunks are left
    out by an anti join with the table of replaced (seq, chunk_id, commit), which needs those columns alone.
    """
    files = committed(path)
    listed = [(number, name) for number, names in files.items() for name in names]
    if not listed:
        raise FileNotFoundError(f"no commit with rows in {path}")
    where = f"{path.rstrip('/')}/"
    rows = spark.read.parquet(*[where + name for _, name in listed]).withColumn("__file", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1))
    if len(files) == 1:
        return rows.drop("__file").withColumn("commit", F.lit(listed[0][0]).cast("long"))
    numbers = spark.createDataFrame([(name, number) for number, name in listed], "__file string, commit long")
    rows = rows.join(numbers, "__file").drop("__file")
    keys = rows.select(seq, "chunk_id", "commit").distinct()
    last = keys.groupBy(seq, "chunk_id").agg(F.max("commit").alias("__last"), F.count("*").alias("__n")).where("__n > 1")
    stale = keys.join(last, [seq, "chunk_id"]).where(F.col("commit") < F.col("__last")).select(F.col(seq).alias("__seq"), F.col("chunk_id").alias("__chunk"), F.col("commit").alias("__commit"))
    return rows.join(stale, (F.col(seq).eqNullSafe(F.col("__seq"))) & (F.col("chunk_id") == F.col("__chunk")) & (F.col("commit") == F.col("__commit")), "left_anti")


def remove_orphans(path: str) -> int:
    """Deletes data files that no manifest lists; only while nothing writes. Returns how many."""
    from pyarrow import fs

    where, folder = filesystem(path)
    known = {f for files in committed(path).values() for f in files}
    gone = [i for i in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and i.base_name.endswith(".parquet") and i.base_name not in known]
    for i in gone:
        where.delete_file(i.path)
    return len(gone)
