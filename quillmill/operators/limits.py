"""Order, limits, shards and seeds. Positions are explicit columns: the order of files or partitions is never used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit_before(df: DataFrame, position: str, n: int, valid: Column) -> DataFrame:
    """The valid ones of the first n rows (0-based positions)."""
    return df.filter((F.col(position) < n) & valid)


def limit_after(df: DataFrame, position: str, n: int, valid: Column) -> DataFrame:
    """The first n valid rows: a top-n with one small heap a task."""
    return df.filter(valid).orderBy(position).limit(n)


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A repeatable random order, by a hash of the seed and the key; ties by the key itself."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def shard(position: Column, n: int) -> Column:
    return F.pmod(position, F.lit(n))


def chunk(position: Column, size: int) -> Column:
    if size <= 0:
        raise ValueError("size must be positive")
    return F.floor(position / size).cast("long")


def text_seed(c: Column) -> Column:
    """Sum of the code points modulo 100000; null or '' gives 0."""
    points = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x) % 100000
