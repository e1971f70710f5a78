"""Preference formatting: one shared prompt, two masked completions.

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; what follows on each
side is its completion, with a run-length mask over its characters: `-n` n
characters outside the loss, `+n` n characters inside. Only the text and end
marker of assistant turns are inside.

One shuffle on the pair; the rest is array functions in the same stage. A result
row holds two whole conversations, so a conversation is the unit of memory.

Null roles and texts count as empty, null turns come first, equal turns are
ordered by role and text and all kept. Pairs that lack a side give no row; rows
with a null pair or side belong to none. If one side is a prefix of the other,
its completion and mask are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(head(t), tail(t))))


def mask(turns: Column, trained: str = TRAINED) -> Column:
    def runs(t: Column) -> Column:
        outside = F.length(head(t))
        return F.when(t["role"] == trained, F.concat(F.lit("-"), outside.cast("string"), F.lit(" +"), F.length(tail(t)).cast("string"))).otherwise(F.concat(F.lit("-"), (outside + F.length(tail(t))).cast("string")))

    return F.concat_ws(" ", F.transform(turns, runs))


def format_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """One row a pair: pair_id, n_common, prompt, chosen, chosen_mask, rejected,
    rejected_mask. `side` is 'chosen' or 'rejected'; other columns are ignored."""
    said = F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of = lambda x: F.array_sort(F.collect_list(F.when(F.col(side) == x, said)))
    both = turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id")).agg(of("chosen").alias("c"), of("rejected").alias("r"))
    both = both.where((F.size("c") > 0) & (F.size("r") > 0))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first = F.array_position(same, F.lit(False)).cast("int")
    both = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(shorter))
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    both = both.withColumns({"prompt": render(F.slice("c", 1, F.col("n_common"))), "c": rest("c"), "r": rest("r")})
    return both.select("pair_id", "n_common", "prompt", render(F.col("c")).alias("chosen"), mask(F.col("c"), trained).alias("chosen_mask"), render(F.col("r")).alias("rejected"), mask(F.col("r"), trained).alias("rejected_mask"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs for tables without preferences: conversation 2k is chosen, 2k+1 rejected."""
    c = F.col("conv_id")
    return conversations.select(F.shiftright(c, 1).alias("pair_id"), F.when(c.bitwiseAND(F.lit(1)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
