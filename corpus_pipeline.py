"""The corpus pipeline: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the
columns of docs. Rows that a stage rejects are gone, and text that it changes stays changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwave.llm import ngram_join, packing, pii, quality, substring
from ordwave.llm.exchange import Frozen

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies: one with the smallest doc_id, null ids last. Rows without words stay."""
    return ngram_join.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have; n_chars follows a changed text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring.removed_words(docs, carry=rest)
    found = found.withColumn("text", F.col("kept_text"))
    if "n_chars" in rest:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds; n_chars follows a changed text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = pii.personal_data(docs, carry=rest).withColumn("text", F.col("redacted"))
    if "n_chars" in rest:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [("quality_rules", quality_stage), ("ngram_jaccard_join", near_copies_stage), ("substring_dedup", substring_stage), ("pii", pii_stage), ("best_fit_packing", packing_stage)]

#: SQL cannot express several stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        after = Frozen(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
