"""Tries of token ids as tables of prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(sequences: DataFrame) -> DataFrame:
    """(prefix, next_token) of sequences (ids array<int>), each once; the prefix is comma-joined, and empty at the root."""
    at = F.transform("ids", lambda t, i: F.struct(F.array_join(F.slice("ids", F.lit(1), i).cast("array<string>"), ",").alias("prefix"), t.alias("next_token")))
    return sequences.where(F.size("ids") > 0).select(F.explode(at).alias("x")).select("x.*").distinct()


def terminals(sequences: DataFrame) -> DataFrame:
    """(prefix): the prefixes that are whole sequences."""
    return sequences.where(F.size("ids") > 0).select(F.array_join(F.col("ids").cast("array<string>"), ",").alias("prefix")).distinct()


def variants(phrases: DataFrame, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """Sequences (ids) of phrases (ids, spaced_ids): both spellings, if they differ, between the marks given."""
    one = phrases.select(F.explode(F.array_distinct(F.array("ids", "spaced_ids"))).alias("ids")).where("ids is not null")
    parts = [F.array(F.lit(bos))] * (bos is not None) + [F.col("ids")] + [F.array(F.lit(eos))] * (eos is not None)
    return one.select(F.concat(*parts).alias("ids")).distinct()


def allowed(states: DataFrame, trie: DataFrame, ends: DataFrame, eos: int | None, hard: bool = True) -> DataFrame:
    """(state_id, allowed): the tokens that may follow each state's prefix (state_id, prefix), in order.

    At a leaf that ends a sequence, the end token. Off the trie, nothing (hard), or null, which stands for every token.
    """
    nexts = trie.groupBy("prefix").agg(F.sort_array(F.collect_set("next_token")).alias("nexts"))
    joined = states.join(nexts, "prefix", "left").join(ends.withColumn("end", F.lit(True)), "prefix", "left")
    off = F.array().cast("array<int>") if hard else F.lit(None).cast("array<int>")
    stop = F.array(F.lit(eos)).cast("array<int>") if eos is not None else off
    return joined.select("state_id", F.when(F.col("nexts").isNotNull(), F.col("nexts")).when(F.coalesce("end", F.lit(False)), stop).otherwise(off).alias("allowed"))
