"""Sinks: nested JSON lines, dead letters, metrics, vocabularies, appendable logs; Spark's commit makes each atomic."""

from __future__ import annotations

import re
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.builders import json_list


def json_rows(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] = []) -> None:  # noqa: B006
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def with_failures(df: DataFrame, error: Column, out: str, failed: str, index: str | None = None, sample_id: str | None = None) -> None:
    """Rows without an error to ``out``, dead letters {index, sample_id, error, sample} to ``failed``. The rows, which may
    have cost a model call each, are computed once and held on disk between the two writes."""
    d = df.withColumn("_e", error).persist(StorageLevel.DISK_ONLY)
    named = [(F.col(c) if c else F.lit(None).cast("string")).alias(n) for n, c in (("index", index), ("sample_id", sample_id))]
    try:
        json_rows(d.filter("_e IS NULL").drop("_e"), out)
        json_rows(d.filter("_e IS NOT NULL").select(*named, F.col("_e").alias("error"), F.struct(*df.columns).alias("sample")), failed)
    finally:
        d.unpersist()


def merged_ranks(parts: list[DataFrame], order: str = "row_idx") -> DataFrame:
    """Rank files as one, in row order; rows without one come first."""
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return d.orderBy(F.coalesce(order, F.lit(-1)))


def vocabulary(tokens: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Distinct tokens in vocabulary order as ``tokens`` (text), as ``vocabulary`` (JSON {token, id}) and their numbers by
    kind as ``summary`` (JSON), one file each: a vocabulary is bounded by its layers' sizes. ``known``: tokens (``token``) that
    a model has already; the summary tells how many are new."""
    t = tokens.select("token").distinct()
    ordered = t.orderBy(*ids.token_order(F.col("token"))).coalesce(1)
    ordered.write.mode("overwrite").text(f"{path}/tokens")
    ordered.select("token", F.monotonically_increasing_id().alias("id")).write.mode("overwrite").json(f"{path}/vocabulary")
    kind = F.coalesce(F.nullif(F.regexp_extract("token", r"^<s_([abc])_\d+>$", 1), F.lit("")), F.lit("mark"))
    had = (known if known is not None else t.limit(0)).select("token").distinct().withColumn("_had", F.lit(True))
    n = t.join(had, "token", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("_had").isNull()).alias("n_new"))
    n.orderBy("kind").coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def codes_in_order(codes: DataFrame, code: str) -> DataFrame:
    """The distinct codes by text, as a prefix table of a decoder wants them."""
    return codes.select(F.trim(code).alias(code)).filter(F.col(code) != "").distinct().orderBy(code)


def metrics(df: DataFrame, path: str, source: str, mode: str = "overwrite") -> str:
    """Metric rows as JSON beside the predictions, the model's source in the name; NaN and infinite values become null."""
    plain = [F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), F.lit(None)).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    to = f"{folder}/{stem or ext}_{re.sub(r'[^0-9A-Za-z_-]+', '_', source)}{dot}{ext if stem else ''}"
    json_rows(df.select(*plain).coalesce(1), to, mode)
    return to


def latest_state(states: DataFrame, by: list[str], step: str, changed: str) -> DataFrame:
    """The row of the highest step of each group, the one changed last among equals."""
    best = states.groupBy(*by).agg(F.max_by(F.struct(*states.columns), F.struct(step, changed)).alias("x"))
    return best.select("x.*")


def list_text(df: DataFrame, *cols: str) -> DataFrame:
    """Array columns as JSON text, for sinks that have no arrays."""
    return df.withColumns({c: json_list(F.col(c)) for c in cols})


def log_entries(df: DataFrame, every: int, step: str, cap: int) -> DataFrame:
    """Rows of every n-th step, at most ``cap`` a step (a logging limit by design)."""
    from pyspark.sql import Window

    w = Window.partitionBy(step).orderBy(F.xxhash64(*df.columns))
    return df.filter(F.col(step) % every == 0).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def snapshot_path(path: str, done: int, every: int) -> str:
    return f"{path}.{done // every * every}"
