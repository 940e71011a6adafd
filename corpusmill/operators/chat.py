"""Rendering of conversations and instruction records as training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOS = "<eos>"
# The texts that the records are rendered with.
CONTEXT, TO_HINDI, TO_ENGLISH = " Context: ", "Translate from english to hindi: ", "Translate from hindi to english: "
#: Folder names of the datasets by the kind of their records.
MESSAGE_SETS, NAMED_SETS = ("anudesh", "hh-rlhf", "wikihow", "oasst1"), ("lm_sys",)


def _piece(role: Column, text: Column, previous: Column) -> Column:
    """A turn; what follows an assistant's turn begins with the end mark."""
    start = F.when(F.coalesce(previous, F.lit("")) == "assistant", F.lit(EOS)).otherwise(F.lit(""))
    return F.concat(start, F.lit("<"), F.coalesce(role, F.lit("")), F.lit(">"), F.coalesce(text, F.lit("")))


def render_messages(messages: Column, role: str = "role", content: str = "content") -> Column:
    """One text of an array of turns in their order. The last end mark is added as a token later."""
    n = F.size(messages)
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(steps, lambda i: _piece(F.get(messages, i)[role], F.get(messages, i)[content], F.get(messages, i - 1)[role])), "")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of turn, role and text in order; from one row for each turn."""
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def render_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and chat."""
    return turns_of(conversations).select("conv_id", render_messages(F.col("turns"), "role", "text").alias("chat"))


def turn_pieces(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, eos_before and piece: what each turn adds to its chat."""
    each = turns_of(conversations).select("conv_id", "turns", F.explode(F.sequence(F.lit(0), F.size("turns") - 1)).alias("i"))
    here, previous = F.get("turns", F.col("i")), F.get("turns", F.col("i") - 1)
    return each.select("conv_id", here["turn"].alias("turn"), here["role"].alias("role"), F.coalesce(previous["role"] == "assistant", F.lit(False)).alias("eos_before"), _piece(here["role"], here["text"], previous["role"]).alias("piece"))


def render_instruction(instruction: Column, context: Column, response: Column) -> Column:
    """With a context only where there is one; null counts as none."""
    extra = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT), context)).otherwise(F.lit(""))
    return F.concat(F.lit("<user>"), F.coalesce(instruction, F.lit("")), extra, F.lit("<assistant>"), F.coalesce(response, F.lit("")))


def render_pair(inputs: Column, targets: Column) -> Column:
    return F.concat(F.lit("<user>"), F.coalesce(inputs, F.lit("")), F.lit("<assistant>"), F.coalesce(targets, F.lit("")))


def render_translation(english: Column, hindi: Column) -> Column:
    """Both directions, as an array."""
    return F.array(render_pair(F.concat(F.lit(TO_HINDI), F.coalesce(english, F.lit(""))), hindi), render_pair(F.concat(F.lit(TO_ENGLISH), F.coalesce(hindi, F.lit(""))), english))


def exchanges(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question and answer: each user turn that an assistant turn follows."""
    each = turns_of(conversations).select("conv_id", "turns", F.explode(F.sequence(F.lit(0), F.size("turns") - 1)).alias("i"))
    here, after = F.get("turns", F.col("i")), F.get("turns", F.col("i") + 1)
    return each.where((here["role"] == "user") & (after["role"] == "assistant")).select("conv_id", here["turn"].alias("turn"), here["text"].alias("question"), after["text"].alias("answer"))
