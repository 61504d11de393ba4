"""Logs of long jobs: reading every form they were written in, appending, snapshots and the point to go on from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "incremental_append_v1"  # fixed value
_RECORD = "struct<type:string,index:bigint,value:string,total:bigint,entries:map<string,string>,done:map<string,string>,outputs:array<string>>"


def entries(spark: SparkSession, path: str, total: int, snapshot: bool = False, all_or_nothing: bool = False) -> DataFrame:
    """``idx, value`` (an object as JSON) of the items done.

    Lines are item records ({type: item, index, value}) or records with ``entries`` or ``done`` ({index: value}) or
    ``outputs`` (a list by position); ``snapshot`` reads a file as one such record over many lines. Broken lines, values
    that are no objects and indexes outside [0, total) are skipped; a record of another total is skipped, or
    (``all_or_nothing``) makes the whole log count for nothing; later lines win. A missing total fits."""
    raw = spark.read.text(path, wholetext=snapshot).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("line"))
    r = raw.select("f", "line", F.from_json("value", _RECORD).alias("r")).filter("r IS NOT NULL")
    fits = F.coalesce(F.col("r.total") == total, F.lit(True)) & F.coalesce(F.size("r.outputs") == total, F.lit(True))
    if all_or_nothing:
        r = r.join(r.filter(~fits).select("f").distinct(), "f", "left_anti")
    pair = lambda k, v: F.struct(k.cast("string").alias("k"), v.alias("v"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    listed = lambda m: F.coalesce(F.transform(F.map_entries(m), lambda e: pair(e["key"], e["value"])), none)
    one = F.when((F.col("r.type") == "item") & F.col("r.index").isNotNull(), F.array(pair(F.col("r.index"), F.col("r.value")))).otherwise(none)
    out = F.coalesce(F.transform("r.outputs", lambda v, i: pair(i, v)), none)
    e = r.filter(fits).select("f", "line", F.explode(F.concat(one, listed(F.col("r.entries")), listed(F.col("r.done")), out)).alias("e"))
    e = e.select("f", "line", F.col("e.k").try_cast("bigint").alias("idx"), F.col("e.v").alias("value"))
    e = e.filter((F.col("idx") >= 0) & (F.col("idx") < total) & F.ltrim("value").startswith("{"))
    return e.groupBy("idx").agg(F.max_by("value", F.struct("f", "line")).alias("value"))


def records(done: DataFrame, total: int, every: int) -> DataFrame:
    """``value``: log lines of ``every`` items each, in the order of their index, with the number done so far."""
    g = done.withColumn("_g", F.floor(F.col("idx") / every)).groupBy("_g").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("string").alias("k"), "value")))).alias("entries"), F.max("idx").alias("m"))
    return g.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(total).alias("total"), (F.col("m") + 1).alias("done_count"), "entries")).alias("value"))


def append(done: DataFrame, path: str, total: int, every: int = 1_000) -> None:
    records(done, total, every).write.mode("append").text(path)


def left_to_do(todo: DataFrame, idx: str, done: DataFrame) -> DataFrame:
    return todo.join(done.select(F.col("idx").alias(idx)), idx, "left_anti")


def milestones_crossed(before: Column, after: Column, every: int) -> Column:
    """The multiples of ``every`` in (before, after], for snapshots."""
    a, b = F.floor(before / every) + 1, F.floor(after / every)
    return F.when(b >= a, F.transform(F.sequence(a, b), lambda k: k * every)).otherwise(F.array().cast("array<bigint>"))


def emergency_path(path: str) -> str:
    """``name_emergency.ext`` beside the path."""
    folder, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return f"{folder}{slash}{stem if dot else ext}_emergency{dot}{ext if dot else ''}"
