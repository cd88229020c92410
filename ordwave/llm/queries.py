"""Queries that apply the operators of this subpackage to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, fill_middle, language, matroska, ngram_join, packing, pii, quality, secrets, spelling, substring, token_counts

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(_documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, BYTE_RANKS)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), WORD_TOKENIZER)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(pii.KINDS[: pii.BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in pii.KINDS[: pii.BASE]], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.removed_words(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    length = F.octet_length(text)
    padded = F.greatest(F.ceil(length / 64) * 64, F.lit(64))
    zeros = F.unhex(F.repeat(F.lit("00"), (padded - length).cast("int")))
    payload = _documents(spark, sf_dir).select("doc_id", length.cast("long").alias("n_bytes"), F.concat(text, zeros).alias("payload"))
    media = matroska.store_samples(payload, "payload").drop("payload")
    read = matroska.read_media(media)
    last = lambda array: F.element_at(array, -1)
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), F.size("packets")), F.concat(F.lit("clusters="), last(F.col("packets"))["cluster"] + 1), F.concat(F.lit("cues="), F.size("cues")), F.concat(F.lit("last_ms="), last(F.col("packets"))["timestamp"]),
        F.concat(F.lit("lacing="), F.array_join(F.array_sort(F.array_distinct("packets.lacing")), "+")), F.concat(F.lit("largest="), F.array_max("packets.size")), F.concat(F.lit("whole="), F.col("whole").cast("string")),
    )
    size = F.octet_length("samples")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_histogram(_documents(spark, sf_dir), WORD_TOKENIZER))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.learn(docs.where(~language.held_out()).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.array_join("languages.lang", "+").alias("languages"))


def rejected_turns(conversations: DataFrame) -> DataFrame:
    """The conversations with the last turn of each replaced by its neighbour's (2k and 2k + 1 are neighbours).

    A conversation without a neighbour loses its last turn.
    """
    last = conversations.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("l"))
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("l.role").alias("new_role"), F.col("l.text").alias("new_text"))
    both = last.select("conv_id", F.col("l.turn").alias("last")).join(partner, "conv_id", "left")
    ends = both.where("new_role is not null").select("conv_id", F.col("last").alias("turn"), F.col("new_role").alias("role"), F.col("new_text").alias("text"))
    heads = conversations.join(both.select("conv_id", "last"), "conv_id").where("turn < last").select("conv_id", "turn", "role", "text")
    return heads.unionByName(ends)


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = chat.preference_pairs(chosen, rejected_turns(chosen))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return made.select(F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected", ranges("chosen_mask"), ranges("rejected_mask"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_documents(spark, sf_dir), drop_every=97))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    names = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in names], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_OP13 = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

_OP10 = """
WITH base AS (SELECT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM base),
last_turn AS (SELECT conv_id, turn, role, text FROM numbered WHERE pos = n),
swapped AS (SELECT m.conv_id, m.turn, p.role, p.text FROM last_turn m JOIN last_turn p ON p.conv_id = xor(m.conv_id, 1)),
rejected AS (
  SELECT conv_id, turn, role, text FROM numbered WHERE pos < n
  UNION ALL SELECT conv_id, turn, role, text FROM swapped),
rej AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM rejected),
matched AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.pos, r.pos) AS pos,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM numbered c FULL JOIN rej r ON c.conv_id = r.conv_id AND c.pos = r.pos),
prefix AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, count(*)) AS n FROM matched GROUP BY conv_id),
sides AS (SELECT 'c' AS side, conv_id, pos, role, text FROM numbered UNION ALL SELECT 'r', conv_id, pos, role, text FROM rej),
framed AS (
  SELECT s.side, s.conv_id, s.pos, s.role, p.n, '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) AS piece,
         12 + length(s.role) + 1 AS words
  FROM sides s JOIN prefix p USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY side, conv_id, pos > n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_ FROM framed),
made AS (
  SELECT conv_id, any_value(n) AS n,
    coalesce(string_agg(CASE WHEN side = 'c' AND pos <= n THEN piece END, '' ORDER BY pos), '') AS prompt,
    coalesce(string_agg(CASE WHEN side = 'c' AND pos > n THEN piece END, '' ORDER BY pos), '') AS chosen,
    coalesce(string_agg(CASE WHEN side = 'r' AND pos > n THEN piece END, '' ORDER BY pos), '') AS rejected,
    coalesce(string_agg(CASE WHEN side = 'c' AND pos > n AND role = 'assistant' THEN (off_ + words)::BIGINT || ':' || (off_ + length(piece))::BIGINT END, ',' ORDER BY pos), '') AS chosen_mask,
    coalesce(string_agg(CASE WHEN side = 'r' AND pos > n AND role = 'assistant' THEN (off_ + words)::BIGINT || ':' || (off_ + length(piece))::BIGINT END, ',' ORDER BY pos), '') AS rejected_mask
  FROM placed GROUP BY conv_id)
SELECT m.conv_id, m.n::BIGINT AS n_prompt_turns, m.prompt, m.chosen, m.rejected, m.chosen_mask, m.rejected_mask
FROM made m WHERE m.conv_id IN (SELECT conv_id FROM rej)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_byte_bpe, op3_best_fit_packing, op4_quality_rules, op5_pii, op6_substring_dedup, op7_matroska, op8_token_counts, op9_language_id, op10_preference_format, op11_spelling_variants, op12_secret_scans, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query over whole tables; the others are tested against brute force."""
    return {"op10_preference_format": _OP10, "op13_fill_in_middle": _OP13}
