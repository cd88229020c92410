"""The corpus pipeline against the plain versions of its stages, one after the other."""

from collections import Counter

import corpus_pipeline
from ordwave.llm import pii
from tokenizers import Tokenizer

from . import brute
from .test_operators import SCHEMA, edge_rows


def plain_run(docs):
    docs = [d for d, k in zip(docs, brute.verdicts([t for _, t in docs])) if k]
    docs = brute.one_of_each(docs)
    docs = [(d, brute.without(t, g)) for (d, t), g in zip(docs, brute.covered(docs))]
    docs = [(d, pii.redact(t, brute.all_spans(t))) for d, t in docs]
    tokenizer = Tokenizer.from_file(corpus_pipeline.WORD_TOKENIZER)
    return Counter((d, *p) for d, t in docs for p in brute.pieces(tokenizer.encode(t, add_special_tokens=False).ids))


def run_stages(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs.collect())


def test_pipeline(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_run(docs)


def test_stages_on_edge_rows(spark, sf):
    """Null and repeated ids, repeated rows, null and long texts, columns with clashing names."""
    rows = edge_rows()
    df = spark.createDataFrame([(d, t, "en", "g", "p", 1, 2, 3, 4, 5, 6, 7, 8, 9) for d, t in rows], SCHEMA).repartition(3)
    assert run_stages(spark, df, sf) == plain_run(rows)


def test_no_text_is_lost_through_a_repeated_id(spark, sf):
    """(3, a), (7, a and a word), (7, b), (9, b and a word): one row of each pair stays, though two rows have the id 7."""
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(3, a), (7, f"{a} more"), (7, b), (9, f"{b} more")]
    kept = corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, a), (7, b)]


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
