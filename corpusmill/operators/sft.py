"""Samples for instruction tuning: length filter, split, loss mask, batches and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.order import shuffle_key
from corpusmill.operators.corpus import BLOCK_DIGITS, running_sum, with_split

IGNORED = -100


def fitting(samples: DataFrame, ctx_len: int, tokens: str = "tokens") -> DataFrame:
    """Samples of at most ctx_len + 1 tokens."""
    return samples.where(F.size(tokens) <= ctx_len + 1)


def shuffled_split(samples: DataFrame, key: str, n_validation: int, seed: int = 42) -> DataFrame:
    """samples with pos in a seeded order and split: the last n_validation are VAL."""
    keyed = samples.withColumn("_key", shuffle_key(F.col(key), seed)).withColumn("_one", F.lit(1))
    ordered = running_sum(keyed, "_one", F.substring("_key", 1, BLOCK_DIGITS), ["_key", key], name="pos")
    return with_split(ordered.drop("_key", "_one", "pos_pos"), n_validation)


def sample_offsets(samples: DataFrame, order: list[str], block: Column) -> DataFrame:
    """id from 0 and offset of each sample in one token stream; block must rise with the order."""
    run = running_sum(samples.withColumn("length", F.size("tokens").cast("long")), "length", block, order)
    return run.withColumnRenamed("offset_pos", "id")


def _turns(tokens: Column, token_id: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i) == token_id)


def loss_targets(tokens: Column, user_id: int, assistant_id: int, eos_id: int, mask: str = "reference") -> Column:
    """Targets of all tokens but the first; IGNORED where no loss is taken.

    mask="reference": ignored where assistant tags minus user tags so far are -1, at assistant tags, and after an end mark. So
    text before the first tag is trained on, and after two user turns in a row the second is, and the answer is not.
    mask="assistant_only": a target counts only between an assistant tag and the next user tag, never a tag itself, nor what
    follows an end mark.
    """
    if mask not in ("reference", "assistant_only"):
        raise ValueError(f"unknown mask: {mask}")

    def target(users: Column, assistants: Column) -> Column:
        def at(i: Column) -> Column:
            out, given = F.get(tokens, i), F.get(tokens, i - 1)
            upto = lambda places: F.filter(places, lambda p: p <= i)
            if mask == "reference":
                ignored = F.size(upto(assistants)) - F.size(upto(users)) == -1
            else:
                ignored = F.coalesce(F.array_max(upto(assistants)), F.lit(-1)) <= F.coalesce(F.array_max(upto(users)), F.lit(-1))
            return F.when(ignored | (out == assistant_id) | (given == eos_id), F.lit(IGNORED)).otherwise(out)

        return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), at)).otherwise(F.array().cast("array<int>"))

    places = F.array(F.struct(_turns(tokens, user_id).alias("u"), _turns(tokens, assistant_id).alias("a")))
    return F.transform(places, lambda p: target(p["u"], p["a"]))[0]


def sft_samples(samples: DataFrame, user_id: int, assistant_id: int, eos_id: int, mask: str = "reference") -> DataFrame:
    """samples with input_tokens and output_tokens in place of tokens; samples without tokens have none."""
    targets = loss_targets(F.col("tokens"), user_id, assistant_id, eos_id, mask)
    return samples.where(F.size("tokens") > 0).withColumn("input_tokens", F.slice("tokens", 1, F.size("tokens") - 1)).withColumn("output_tokens", targets).drop("tokens")


def padded_batches(samples: DataFrame, batch_size: int, pad_id: int, position: str = "pos", drop_last: bool = True) -> DataFrame:
    """samples with batch_id, padded to the longest of their batch, and pad_mask, true where the input is the pad token.

    position counts the samples from 0. A last batch that is not full is dropped unless drop_last is false.
    """
    batch = samples.withColumn("batch_id", F.floor(F.col(position) / batch_size))
    own = Window.partitionBy("batch_id")
    sized = batch.withColumn("_longest", F.max(F.size("input_tokens")).over(own)).withColumn("_count", F.count("*").over(own))
    if drop_last:
        sized = sized.where(F.col("_count") == batch_size)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_longest") - F.size(c)))
    padded = sized.withColumn("input_tokens", fill(F.col("input_tokens"), pad_id)).withColumn("output_tokens", fill(F.col("output_tokens"), IGNORED))
    return padded.withColumn("pad_mask", F.transform("input_tokens", lambda x: x == pad_id)).drop("_longest", "_count")
