"""Lookup, semi, anti, positional and prefix joins. Sides are joined by a shuffle unless Spark's own size statistics
(spark.sql.autoBroadcastJoinThreshold, adaptive) show that one is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_array(df: DataFrame, key: str, ids: str, dim: DataFrame, dim_id: str, dim_value: str, out: str) -> DataFrame:
    """``out``: for each element of the array ``ids``, in order, the value of ``dim``, or [element] where it has none.

    Rows with a null or empty array get []; ``key`` must be unique; ``dim_id`` may repeat, then the smallest value counts.
    Distinct (row, place) pairs travel, so a popular id is a skewed join key that adaptive execution splits."""
    one = dim.filter(F.col(dim_id).isNotNull()).groupBy(F.col(dim_id).alias("_id")).agg(F.min(dim_value).alias("_v"))
    each = df.select(key, F.posexplode(ids).alias("_p", "_id"))
    got = each.join(one, "_id", "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_v", F.array("_id")).alias("v")))).alias("_all")
    )
    return df.join(got, key, "left").withColumn(out, F.coalesce(F.transform("_all", lambda x: x["v"]), F.array().cast("array<array<string>>"))).drop("_all")


def with_membership(df: DataFrame, on: str, known: DataFrame, known_on: str, out: str) -> DataFrame:
    """``out``: whether the value of ``on`` occurs in ``known``; null is in none."""
    ks = known.select(F.col(known_on).alias(on)).filter(F.col(on).isNotNull()).distinct().withColumn(out, F.lit(True))
    return df.join(ks, on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def allowed(df: DataFrame, on: str, allow: DataFrame) -> DataFrame:
    return df.join(allow.select(on).distinct(), on, "left_semi")


def not_done(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows that a resumed run still has to process; rows with a null key are kept."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def zip_groups(items: DataFrame, position: str, value: str, width: int) -> DataFrame:
    """``grp, members``: consecutive values regrouped by a fixed width, in order."""
    grouped = items.groupBy(F.floor(F.col(position) / width).cast("long").alias("grp")).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("m"))
    return grouped.select("grp", F.col(f"m.{value}").alias("members"))


def reattached(df: DataFrame, key: str, items: str, answers: DataFrame, answer: str, out: str) -> DataFrame:
    """``out``: the answers (``key, pos, answer``; 0-based ``pos``) to the elements of the array ``items``, in their order,
    null where one is missing; the last of repeated answers by value counts. ``key`` is unique."""
    one = answers.groupBy(key, "pos").agg(F.max(answer).alias("_v"))
    each = df.select(key, F.posexplode(items).alias("pos", "_x")).join(one, [key, "pos"], "left")
    got = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_v").alias("v")))).alias("_all"))
    kind = f"array<{answers.schema[answer].dataType.simpleString()}>"
    return df.join(got, key, "left").withColumn(out, F.coalesce(F.col("_all.v"), F.array().cast(kind))).drop("_all")


def continuations(catalog: DataFrame, code: str, prefixes: DataFrame, prefix: str, lengths: list[int]) -> DataFrame:
    """``prefix, continuation`` for each catalog code that starts with a probe; an equi-join on starts of the probes'
    (few) lengths, no range join."""
    starts = catalog.select(code, F.explode(F.array(*[F.left(F.col(code), F.lit(n)) for n in lengths])).alias(prefix))
    return starts.join(prefixes.select(prefix).distinct(), prefix).distinct().select(prefix, F.substr(F.col(code), F.length(prefix) + 1).alias("continuation"))


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key: later lines overwrite earlier ones."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")
