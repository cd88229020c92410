"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Which piece goes where depends on lengths alone, so the plan is made for the histogram of lengths,
which has at most `capacity` entries at any scale. A segment tree over remaining capacities finds
the tightest open bin class for each length in logarithmic time; a class holds runs of bins, so many
equal pieces are placed in one step. Pieces are then numbered within their length, in parallel
by salted groups whose number follows the number of pieces, and look up their place. A piece that
fills a sequence needs no number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .exchange import Frozen
from .text import mix, slices
from .word_bpe import word_ids

#: About so many pieces of one length are numbered in one group.
GROUP_ROWS = 250_000


class CapacityTree:
    """Open bins by remaining capacity: runs [first bin, number] at each leaf, and which subtrees have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.runs: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, number: int) -> None:
        self.runs[left].append([first, number])
        i = left + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, left: int, number: int) -> tuple[int, int]:
        """Up to `number` bins with this remaining capacity, as one run."""
        run = self.runs[left][-1]
        n = min(number, run[1])
        first = run[0]
        run[0] += n
        run[1] -= n
        if not run[1]:
            self.runs[left].pop()
            i = left + self.size
            while i and not (self.runs[left] if i >= self.size else self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return first, n

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that an open bin has."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, ranks in a bin, first bin, offset in the bin) for lengths 1 to capacity.

    The r-th piece of a length (from 0) lies in the entry with first <= r < first + ranks, in bin
    first bin + (r - first) // each, at offset + length * ((r - first) % each).
    """
    tree, plan, bins = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, min(capacity // length, todo)
                number = todo // each
                first, bins = bins, bins + number
            else:
                each = min(left // length, todo)
                first, number = tree.take(left, todo // each)
            plan.append((length, rank, number * each, each, first, capacity - left))
            if left - each * length:
                tree.add(left - each * length, first, number)
            rank, todo = rank + number * each, todo - number * each
    return plan


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, salt) of each document's ids, then end_id, cut at `capacity`; salt is a number below 2 ** 40 that spreads the copies of a text."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        coder = word_ids(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(coder.encode(batch.column("text"))):
                    ids += end
                    n = len(ids) // 4
                    for j, at in enumerate(range(0, n, capacity)):
                        part = memoryview(ids)[4 * at : 4 * (at + capacity)]
                        row.append(i)
                        piece.append(j)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                ids_of = batch.column("id").take(pa.array(row, pa.int64()))
                salt = (mix(np.array(crc, np.uint64) + np.array(row, np.uint64), 3) >> np.uint64(24)).astype(np.int64)  # copies of one text differ in their row
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt)], names=schema.names)

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("salt", T.LongType())])
    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document into as few sequences of at most `capacity` tokens as best fit decreasing finds.

    A document is its ids by the tokenizer, then end_id; only longer ones are cut, into pieces of
    `capacity` tokens of which the last may be shorter. Returns per piece: id_col, piece, start,
    length, ids_crc32, sequence_id, offset. Sequences are filled without gaps from 0.

    Null or empty text: one piece of length 1, the end_id alone. Null, tied or repeated ids: each row
    is a document by itself. Equal lengths: any order. An empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    found = Frozen(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)).df
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    full = histogram.pop(capacity, 0)
    groups = np.ones(capacity + 1, np.int64)  # for each length; in all at most capacity and one for GROUP_ROWS pieces
    for length, n in histogram.items():
        groups[length] = -(-n // GROUP_ROWS)
    dealt = found.where(F.col("length") < capacity).withColumn("salt", F.col("salt") % F.element_at(F.lit(groups[1:].tolist()), F.col("length").cast("int")))
    before, last = {}, dict.fromkeys(histogram, 0)
    for r in sorted(dealt.groupBy("length", "salt").count().collect(), key=lambda r: (r["length"], r["salt"])):
        before[r["length"], r["salt"]] = last[r["length"]]
        last[r["length"]] += r["count"]
    plan = np.array(best_fit_plan(histogram, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((plan, before, np.searchsorted(plan[:, 0], np.arange(capacity + 2))))
    order = [F.col("id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)

    def place(batches):
        plan, before, begin = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            base = np.fromiter((before[k] for k in zip(length.tolist(), batch.column("salt").to_pylist())), np.int64, len(length))
            rank = base + batch.column("nth").to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                at[mine] = begin[n] + np.searchsorted(plan[begin[n] : begin[n + 1], 1], rank[mine], "right") - 1
            _, first, _, each, bins, offset = plan[at].T
            within = rank - first
            out = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(bins + within // each), pa.array(offset + length * (within % each))], names=schema.names)

    schema = T.StructType([f for f in found.schema if f.name not in ("salt",)] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "salt", F.col("nth").cast("long").alias("nth")).mapInArrow(place, schema)
    if full:  # a sequence each; their numbers are negative
        alone = found.where(F.col("length") == capacity).drop("salt")
        out = out.unionByName(alone.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    return out.withColumnRenamed("id", id_col)
