"""Scans and discovery. Columns and filters reach the Parquet scan; an order is an explicit column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import clean_values, first_filled, parse_list_string, pytrim

# fixed values: names of a list in a document, and of a caption
CONTAINERS = ("records", "results", "data", "items")
CAPTIONS = ("caption", "item_caption", "description", "text")


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """All or the named columns; ``ordered`` adds file_name and row_index, the place of a row in its file."""
    df = spark.read.parquet(*paths)
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing}; there are {df.columns}")
    cols = columns or df.columns
    extra = [F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index")] if ordered else []
    return df.select(*cols, *extra)


def values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column's stripped, non-empty values."""
    return parquet(spark, path, columns=[column]).filter(F.col(column).isNotNull()).select(pytrim(F.col(column).cast("string")).alias(column)).filter(F.col(column) != "")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds a list of objects or one object."""
    return spark.read.json(path, multiLine=True, schema=schema)


def map_document(spark: SparkSession, path: str) -> DataFrame:
    """``id, caption`` of a file that holds one object of texts, in its order (``pos``)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e")).select("pos", F.col("e.key").alias("id"), F.col("e.value").alias("caption"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """``pos, id, caption`` of a document in either form: an object of texts, or a list of objects whose text stands under
    one of the usual names. A document is one row here, as JSON has no other split point; use lines for large inputs."""
    raw = spark.read.text(path, wholetext=True)
    mapped = raw.filter(F.ltrim("value").startswith("{")).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e"))
    mapped = mapped.select("pos", F.col("e.key").alias("id"), F.col("e.value").alias("caption"))
    kind = "array<struct<id:string," + ",".join(f"{c}:string" for c in CAPTIONS) + ">>"
    listed = raw.filter(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", kind)).alias("pos", "e"))
    return mapped.unionByName(listed.select("pos", F.col("e.id").alias("id"), first_filled(*[F.col(f"e.{c}") for c in CAPTIONS]).alias("caption")))


def terms_by_pid(spark: SparkSession, path: str) -> DataFrame:
    """``id, tid``: an object {id: terms or text}, or a list of {id, tid}; stripped, without empty ones, the last of an id
    counts. Another root is an error."""
    raw = spark.read.text(path, wholetext=True).withColumn("value", F.ltrim("value"))
    bad = F.raise_error(F.lit("neither an object nor a list")).cast("array<struct<key:string,value:string>>")
    listed = F.transform(F.from_json("value", "array<struct<id:string,tid:string>>"), lambda e: F.struct(e["id"].alias("key"), e["tid"].alias("value")))
    each = F.when(F.col("value").startswith("{"), F.map_entries(F.from_json("value", "map<string,string>"))).when(F.col("value").startswith("["), listed).otherwise(bad)
    e = raw.select(F.posexplode(each).alias("pos", "e"))
    d = e.select("pos", pytrim(F.col("e.key")).alias("id"), clean_values(parse_list_string(F.col("e.value"))).alias("tid")).filter((F.col("id") != "") & (F.size("tid") > 0))
    return d.groupBy("id").agg(F.max_by("tid", "pos").alias("tid"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, broken ones keep their text in ``_bad``."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def contained(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first list found under one of the usual names."""
    fields = ", ".join(f"{c} array<struct<{schema}>>" for c in CONTAINERS)
    d = spark.read.json(path, multiLine=True, schema=fields)
    return d.select(F.explode(F.coalesce(*CONTAINERS)).alias("r")).select("r.*")


def with_dataset(df: DataFrame, suffix: str) -> DataFrame:
    """``dataset``: the file's name without its suffix (``df`` must come straight from files)."""
    return df.withColumn("dataset", F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$", ""))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """``uid, prompt, ds``: at most two tabs are separators."""
    p = F.split("value", "\t", 3)
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("uid"), F.get(p, F.lit(1)).alias("prompt"), F.get(p, F.lit(2)).alias("ds"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def discovered(spark: SparkSession, folder: str, *asked: str, suffix: str = ".parquet") -> list[str]:
    """Sorted paths of the files that the names, short names (without suffix) or patterns ask for; none asks for all. A
    name that matches nothing is an error."""
    pattern = lambda name: f"{folder}/{name}" if "*" in name or name.endswith(suffix) else f"{folder}/{name}{suffix}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out: set[str] = set()
    for name in asked or (f"*{suffix}",):
        at = hadoop.Path(pattern(name))
        found = at.getFileSystem(conf).globStatus(at)
        if not found:
            raise FileNotFoundError(pattern(name))
        out |= {f.getPath().toString() for f in found}
    return sorted(out)


def numbered(df: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    """``row_idx``: 0-based places in the order (a total one). Counts per sorted partition are summed on the driver, so no
    task holds all rows; ``limit`` keeps the first ones."""
    d = df.orderBy(*order)
    if limit is not None:
        d = d.limit(limit)
    d = d.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33))
    before, starts = 0, []
    for row in sorted(d.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row per partition
        starts.append((row["_part"], before))
        before += row["n"]
    begin = d.sparkSession.createDataFrame(starts, "_part long, _begin long")
    place = F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return d.join(F.broadcast(begin), "_part").select(place.alias("row_idx"), *df.columns)


def env_file(text: str) -> dict[str, str]:
    """KEY=VALUE lines with optional ``export``, comments and quotes."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and line[0] != "#" and "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            out[k] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out


@dataclass(frozen=True)
class Settings:
    """A given value, else the environment's, else the default; '' counts as missing."""

    given: dict[str, str | None]
    env: dict[str, str]

    def get(self, name: str, default: str = "") -> str:
        return self.given.get(name) or self.env.get(name) or default

    def flag(self, name: str) -> bool:
        return self.get(name).lower() in {"1", "true", "yes", "y", "on"}

    def number(self, name: str, default: float, kind: type = int) -> float:
        """A number; a text that is none is an error that names the setting."""
        text = self.get(name)
        try:
            return kind(text) if text else default
        except ValueError:
            raise ValueError(f"{name}: {text!r} is no {kind.__name__}") from None

    def keys(self, *names: str) -> list[str]:
        """Distinct keys, in order, of the first of the names that has any; none at all is an error."""
        for name in names:
            if found := list(dict.fromkeys(self.get(name).replace(",", " ").split())):
                return found
        raise ValueError("no key under " + ", ".join(names))
