"""Token counts for every context limit from an exact histogram of encoded lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import Frozen
from .text import slices
from .word_bpe import word_ids

#: Lengths summed together first, so that running sums are taken in parallel over few block totals.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, over all documents.

    Null or empty text has length 0 and is counted. Repeated rows count each. An empty table gives an
    empty histogram. Other columns are ignored, whatever their names. Counts are summed in tasks
    before they are shuffled.
    """
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        coder = word_ids(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in coder.encode(batch.column("text"))], pa.int64())], names=["n_tokens"])

    return source.mapInArrow(run, "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, exact totals over all documents.

    n_docs have this length. docs_over and tokens_over: documents longer than the limit and their
    tokens. docs_fit and tokens_fit: those that fit. kept_tokens: all tokens after each document is cut
    at the limit; lost_tokens: the rest. share_fit: the share of documents that fit, so the smallest
    limit with share_fit >= q is the q-quantile of length.
    """
    histogram = Frozen(histogram).df  # a row for each length; it is used twice, texts are encoded once
    h = histogram.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    all_ = totals.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    s = h.join(blocks, "block").crossJoin(F.broadcast(all_))  # one row
    s = s.withColumn("docs_over", F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("tokens_over", F.col("t_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    kept = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return s.select("n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("all_docs") - F.col("docs_over")).alias("docs_fit"), (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_fit"), kept.alias("kept_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_fit"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The q-quantile of length: the smallest length that this share of documents does not exceed."""
    return table.where(F.col("share_fit") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Kept and lost tokens for any list of context limits, whether a document has that length or not."""
    cut = [F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("n_docs")).alias(f"k{i}") for i, x in enumerate(limits)]
    sums = histogram.agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("a"), *cut)
    rows = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("context"), F.coalesce(F.col(f"k{i}"), F.lit(0)).alias("kept_tokens")) for i, x in enumerate(limits)]))
    return sums.select("a", rows.alias("r")).select("r.context", "r.kept_tokens", (F.coalesce("a", F.lit(0)) - F.col("r.kept_tokens")).alias("lost_tokens"))
