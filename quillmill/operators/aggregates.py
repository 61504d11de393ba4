"""Ranking, instruction and reward metrics, token sets and counters; all combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, scoring
from ..functions.coerce import pytrim

KS = (1, 5, 10, 20, 40)  # fixed values


def rate(cond: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("double")), 6), F.lit(0.0))


def ranking_metrics(df: DataFrame, preds: str, gold: str, by: list[str] = [], ks: tuple[int, ...] = KS) -> DataFrame:  # noqa: B006
    """Total, exact matches, recall@k and NDCG@k of ranked candidates (repeats count at their first place).

    No rows give 0 in each metric; a missing first candidate equals a missing gold value."""
    d = df.withColumn("_p", F.array_distinct(F.col(preds)))
    g = F.col(gold)
    hit = lambda k: F.coalesce(F.array_contains(F.slice("_p", 1, k), g), F.lit(False))
    top = F.get("_p", F.lit(0))
    aggs = [
        F.count("*").alias("total"),
        rate(F.coalesce(F.size("_p"), F.lit(0)) > 0).alias("parsed_rate"),
        F.count_if(top.eqNullSafe(g)).alias("exact_matches"),
        rate(top.eqNullSafe(g)).alias("exact_accuracy"),
    ]
    for k in ks:
        aggs += [rate(hit(k)).alias(f"recall_{k}"), F.coalesce(F.round(F.avg(scoring.ndcg(F.col("_p"), g, k)), 6), F.lit(0.0)).alias(f"ndcg_{k}")]
    return (d.groupBy(*by) if by else d).agg(*aggs)


def instruction_metrics(df: DataFrame, pred_tid: str, gold_tid: str, pred_ins: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    p, r, f = scoring.overlap(F.col(pred_tid), F.col(gold_tid))
    aggs = [
        F.count("*").alias("total"),
        rate(F.size(pred_tid) > 0).alias("tid_rate"),
        rate(F.trim(pred_ins) != "").alias("ins_rate"),
        rate(F.col(pred_tid) == F.col(gold_tid)).alias("exact_rate"),
        *[F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f, "f1"))],
    ]
    return (df.groupBy(*by) if by else df).agg(*aggs)


def code_token_counts(df: DataFrame, col: str, trimmed: bool = False) -> DataFrame:
    """``token, n`` over the valid codes; texts are counted first, so each distinct one is cleaned (``trimmed``: of white
    space) and taken apart once."""
    each = df.filter(F.length(col) > 0).groupBy(F.col(col).alias("code")).agg(F.count("*").alias("m"))
    if trimmed:
        each = each.withColumn("code", pytrim(F.col("code"))).filter(ids.is_code(F.col("code")))
    ok = each.filter(F.coalesce(ids.tokens_cover(F.col("code")), F.lit(False)))
    return ok.select(F.explode(ids.code_tokens(F.col("code"))).alias("token"), "m").groupBy("token").agg(F.sum("m").alias("n"))


def code_validity(df: DataFrame, col: str) -> DataFrame:
    ok = F.coalesce(ids.tokens_cover(F.col(col)), F.lit(False)) & (F.coalesce(F.length(col), F.lit(0)) > 0)
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.countDistinct(F.when(ok, F.col(col))).alias("unique_codes"))


def codes_anywhere(df: DataFrame) -> DataFrame:
    """``code``: the distinct valid codes in any text of any column, however deep in arrays, structs and maps."""
    parts = [x for f in df.schema.fields if (x := _texts(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], "code string")
    found = df.select(F.explode(F.concat(*parts)).alias("code")).filter("code IS NOT NULL").distinct()
    return found.filter(ids.is_code(F.col("code"))).select(pytrim(F.col("code")).alias("code")).distinct()


def _texts(c: Column, kind: T.DataType) -> Column | None:
    """All texts in a value as one array; None for a type that holds none."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array(c)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(c, none)
        if _texts(F.lit(None), kind.elementType) is None:
            return None
        return F.coalesce(F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: _texts(x, kind.elementType))), none)
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields if (x := _texts(c[f.name], f.dataType)) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.MapType):
        parts = [x for m, k in ((F.map_keys(c), kind.keyType), (F.map_values(c), kind.valueType)) if (x := _texts(m, T.ArrayType(k))) is not None]
        return F.concat(*parts) if parts else None
    return None


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of each combination, the largest first."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


def group_spread(df: DataFrame, group: list[str], reward: str) -> DataFrame:
    """Over the groups of two or more rows: their number, those without spread, and mean, least and most deviation
    (of the population, over rewards rounded to 4 places)."""
    g = df.groupBy(*group).agg(F.count("*").alias("n"), F.stddev_pop(F.round(reward, 4)).alias("sd")).filter("n > 1")
    r = lambda c: F.round(c, 6)
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("sd") < 1e-8).alias("flat_groups"), r(F.avg("sd")).alias("mean_sd"), r(F.min("sd")).alias("min_sd"), r(F.max("sd")).alias("max_sd"))


def kept_and_dropped(df: DataFrame, by: list[str], valid: Column) -> DataFrame:
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("rows_in"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
