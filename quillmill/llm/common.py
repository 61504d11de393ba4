"""Shared pieces of the training-data operators: items, records, tables kept between stages."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_RX = r"<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>"
DELIVERY_COLUMNS = ("row_id", "ingest_ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_core(col: Column) -> Column:
    """``<s_a_N><s_b_N><s_c_N>`` of an element, '' when the element is no item, null when it is null."""
    plain = col.rlike(r"^<\|cid_begin\|><s_a_\d+><s_b_\d+><s_c_\d+><\|cid_end\|>\z")
    return F.when(plain, F.substring(col, 14, F.length(col) - 24)).otherwise(
        F.regexp_replace(F.regexp_extract(col, ITEM_RX, 0), r"\s+", "")
    )


def items(col: Column) -> Column:
    """The items of a history in order, as cores; other elements are dropped, a null history gives []."""
    return F.coalesce(
        F.filter(F.transform(col, item_core), lambda x: x.isNotNull() & (x != "")),
        F.array().cast("array<string>"),
    )


def hash_code(x: Column, seed: int, bits: int = 64) -> Column:
    code = F.xxhash64(F.lit(seed), x)
    return code if bits == 64 else code.bitwiseAND(F.lit((1 << bits) - 1))


def apart(items: DataFrame, bits: int = 64) -> int:
    """A seed under which no two different ``item`` values share a code of ``bits`` bits, told by a second 64-bit hash.

    Two of a billion items share a 64-bit code with a chance of about 3 %; then the next seed is tried."""
    seed = 0
    while True:
        codes = items.select(hash_code(F.col("item"), seed, bits).alias("code"), F.xxhash64(F.lit(-1 - seed), "item").alias("other"))
        met = codes.groupBy("code").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a != b")
        if met.isEmpty():
            return seed
        seed += 1


def canonical(core: Column) -> Column:
    return F.concat(F.lit("<|cid_begin|>"), core, F.lit("<|cid_end|>"))


def record_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns but those that differ between deliveries of one record.

    Each column is preceded by its null mark (and size), as a hash passes over nulls.
    """
    parts: list[Column] = []
    for f in df.schema.fields:
        if f.name in DELIVERY_COLUMNS:
            continue
        c = F.col(f"`{f.name}`")
        parts.append(c.isNull())
        if f.dataType.typeName() == "array":
            parts.append(F.size(c))
            c = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("\x00null")))
        parts.append(c)
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(11), *parts).alias("_k2")]


def one_per_record(df: DataFrame, *cols: Column) -> DataFrame:
    """``cols`` of one row of each record; only the key's hashes and ``cols`` are shuffled."""
    return df.select(*record_key(df), *cols).dropDuplicates(["_k1", "_k2"])


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, in local mode only, the warehouse folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillmill"
    return found.rstrip("/")


def release() -> None:
    """Removes the tables kept so far, for sessions that run many queries: call it when their results have been read."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone
            pass


atexit.register(release)


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors, may be read
    more than once. It is removed by ``release`` or when the driver's program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A kept table as another relation, for a join with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._kept_path)
