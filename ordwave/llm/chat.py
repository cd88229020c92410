"""Preference formatting of chosen and rejected conversations with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The frame of a turn, and the role whose words are trained on.
OPEN, MIDDLE, CLOSE, TRAINED = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str, side: str) -> DataFrame:
    """Distinct turns, then one ordered array of them for each pair. Equal rows are merged before they are gathered."""
    rows = df.select(F.col(f"`{pair}`").alias("pair_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"))
    gathered = rows.where("pair_id is not null").distinct().groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("pair_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(side))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Character ranges (end exclusive) of the rendered turns on which the loss counts: the trained role's words and closing mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        words = acc["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])
        end = words + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.struct(words.cast("long").alias("start"), end.cast("long").alias("end"))
        spans = F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Prompt and paired masked completions of chosen and rejected conversations, given as a row per turn.

    The longest common prefix of turns (role and text equal) is rendered once as the prompt; what
    follows on either side is a completion. Returns per pair_id found on both sides: pair_id,
    n_prompt_turns, prompt, chosen, rejected, and chosen_mask and rejected_mask, the character ranges
    of each completion that are trained on (words and closing mark of assistant turns).

    Turns are ordered by number, ties by role and text; equal rows count once. Null role or text is
    empty; a null turn number goes first. Pairs with a null id, or with one side only, are left out:
    they prefer nothing. Equal conversations give empty completions. An empty table gives an empty
    one. Other columns are ignored, whatever their names.
    """
    names = pair_col, turn_col, role_col, text_col
    both = _turns(chosen, *names, "c").join(_turns(rejected, *names, "r"), "pair_id")
    differ = F.array_position(F.transform(F.arrays_zip("c", "r"), lambda z: ~z["c"].eqNullSafe(z["r"])), True)
    both = both.withColumn("n", F.when(differ == 0, F.size("c")).otherwise(differ - 1).cast("long"))
    rest = lambda side: F.slice(side, F.col("n").cast("int") + 1, F.greatest(F.size(side) - F.col("n").cast("int"), F.lit(0)))
    both = both.withColumn("c1", rest("c")).withColumn("r1", rest("r"))
    prompt = F.slice("c", F.lit(1), F.col("n").cast("int"))
    return both.select("pair_id", F.col("n").alias("n_prompt_turns"), _render(prompt).alias("prompt"), _render(F.col("c1")).alias("chosen"), _render(F.col("r1")).alias("rejected"), _mask(F.col("c1")).alias("chosen_mask"), _mask(F.col("r1")).alias("rejected_mask"))
