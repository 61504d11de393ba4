"""Tables, and text that several queries' SQL shares."""

from pyspark.sql import DataFrame, SparkSession

CODE_RX = r"<\|cid_begin\|><s_a_\d+><s_b_\d+><s_c_\d+><\|cid_end\|>"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKEN_RX = r"<\|cid_begin\|>|<s_a_\d+>|<s_b_\d+>|<s_c_\d+>|<\|cid_end\|>"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
