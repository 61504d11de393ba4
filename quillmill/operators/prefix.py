"""Prefix tables: which token may follow which prefix of the legal codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_table(seqs: DataFrame, tokens: str, close: str) -> DataFrame:
    """``prefix, next``: the distinct continuations of every proper prefix ('' first), the close token at the end."""
    t = F.concat(F.col(tokens), F.array(F.lit(close)))
    at = F.explode(F.sequence(F.lit(1), F.size(t)))
    return (
        seqs.filter(F.size(tokens) > 0).select(t.alias("t"), at.alias("k"))
        .select(F.array_join(F.slice("t", 1, F.col("k") - 1), "").alias("prefix"), F.get("t", F.col("k") - 1).alias("next"))
        .distinct()
    )


def allowed_next(states: DataFrame, state_prefix: str, table: DataFrame) -> DataFrame:
    """States with their allowed next tokens, sorted; a prefix outside the table has []."""
    t = table.groupBy(F.col("prefix").alias(state_prefix)).agg(F.array_sort(F.collect_set("next")).alias("allowed"))
    return states.join(t, state_prefix, "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


def decode_groups(states: DataFrame, key: str) -> DataFrame:
    """``allowed, n, first_key``: how many states share a set of allowed tokens and could be decoded together."""
    return states.groupBy("allowed").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def constrained_next(states: DataFrame, text: str, marker: str, table: DataFrame) -> DataFrame:
    """``phase, allowed``: what may follow a text that is being written: the continuations of the code begun behind the
    last marker while one is open, and null (anything) before it and after its end."""
    d = states.withColumn("phase", phase(F.col(text), marker))
    d = d.withColumn("_p", F.when(F.col("phase") == "code", F.substring_index(text, marker, -1)))
    t = table.groupBy(F.col("prefix").alias("_p")).agg(F.array_sort(F.collect_set("next")).alias("allowed"))
    none = F.when(F.col("phase") == "code", F.array().cast("array<string>"))
    return d.join(t, "_p", "left").withColumn("allowed", F.coalesce("allowed", none)).drop("_p")


def phase(text: Column, marker: str) -> Column:
    """'search' before the marker, 'code' in the code after it, 'closed' once that ends."""
    after = F.substring_index(text, marker, -1)
    return F.when(~text.contains(marker), "search").when(after.contains('"'), "closed").otherwise("code")
