"""Problem 2: items that appear together.

Items are made distinct within a basket, ordered pairs are emitted, counts are combined map-side, and lift and
pointwise mutual information come from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


#: Items up to which their list is broadcast (some 50 MB); beyond, it is joined by a shuffle.
BROADCAST_ITEMS = 500_000
WIDE_BASKET = 1_000


def item_pairs(
    baskets: DataFrame,
    key: list[str],
    items: str,
    min_count: int = 1,
    min_share: float = 0.0,
    min_lift: float = 0.0,
) -> DataFrame:
    """Pairs ``item_a < item_b`` with ``n_ab, n_a, n_b, n, lift, pmi``.

    ``baskets`` has one row per basket (``key``) with an array ``items``. Thresholds: ``n_ab >= min_count``,
    ``n_ab >= min_share * n`` and ``n_ab * n >= min_lift * n_a * n_b``, n being the baskets with an item. Items that
    cannot reach them are dropped before pairs are made, without loss: n_ab <= n_a, and n_ab <= min(n_a, n_b) makes
    n_a <= n / min_lift. Null or empty baskets give nothing, null elements are no items, repeated items count once, an
    empty table gives no rows. A hot item only lengthens baskets by one, so nothing is gathered by item; the pairs of a
    basket of over ``WIDE_BASKET`` items are made by many tasks, an item with those behind it at a time.
    """
    b = C.kept(
        baskets.select(*key, F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).alias("_items")).filter(
            F.size("_items") > 0
        ),
        "baskets",
    )
    n = b.count()
    least = max(min_count, min_share * n)
    each = b.select(*key, F.explode("_items").alias("item"))
    known = each.groupBy("item").agg(F.count("*").alias("n_x")).filter(F.col("n_x") >= least)
    if min_lift > 0:
        known = known.filter(F.col("n_x") * min_lift <= n)
    # ids in the order of the items; a relative threshold keeps at most (mean items of a basket) / min_share of them
    known = C.kept(known.orderBy("item").withColumn("id", F.monotonically_increasing_id()), "known")
    small = known.count() <= BROADCAST_ITEMS
    sized = F.broadcast if small else lambda d: d
    slim = each.join(sized(known.select("item", "id")), "item").groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    behind = F.transform(
        F.slice("_ids", 1, F.size("_ids") - 1), lambda x, i: F.struct(x.alias("a"), F.slice("_ids", i + 2, F.size("_ids")).alias("rest"))
    )
    many = F.size("_ids") > WIDE_BASKET
    usual = slim.filter((F.size("_ids") > 1) & ~many).select(F.explode(behind).alias("x"))
    wide = slim.filter(many).select(F.posexplode("_ids").alias("_i", "a"), "_ids").repartition(F.xxhash64("a", "_i"))
    wide = wide.select(F.struct("a", F.slice("_ids", F.col("_i") + 2, F.size("_ids")).alias("rest")).alias("x"))
    pairs = (
        usual.unionByName(wide).select(F.col("x.a").alias("a"), F.explode("x.rest").alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n_ab"))
        .filter(F.col("n_ab") >= least)
    )
    a, z = (known.select(F.col("id").alias(x), F.col("item").alias(f"item_{x}"), F.col("n_x").alias(f"n_{x}")) for x in "ab")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    out = pairs.join(sized(a), "a").join(sized(z), "b")
    if min_lift > 0:
        out = out.filter(F.col("n_ab") * F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    return out.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi")
    )


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.table(spark, sf_dir, "train_cid2cid")
    return C.one_per_record(t, F.array_distinct(C.items(F.col("hist_sid"))).alias("items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = item_pairs(_baskets(spark, sf_dir), ["_k1", "_k2"], "items", min_count=4, min_share=0.005, min_lift=6)
    return out.select(C.canonical(F.col("item_a")).alias("sid_a"), C.canonical(F.col("item_b")).alias("sid_b"))


def p2_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its count and the ratio to the count expected by chance."""
    out = item_pairs(_baskets(spark, sf_dir), ["_k1", "_k2"], "items")
    return out.select(
        C.canonical(F.col("item_a")).alias("sid_a"),
        C.canonical(F.col("item_b")).alias("sid_b"),
        "n_ab",
        F.round("lift", 6).alias("lift"),
    )


_SQL_BASKETS = r"""
WITH rec AS (
  SELECT DISTINCT uid, hist_sid, target_sid, reasoning, source_dataset, ts FROM train_cid2cid
), bas AS (
  SELECT row_number() OVER () AS rid,
    list_distinct(list_filter(list_transform(hist_sid, lambda x: regexp_replace(
      regexp_extract(x, '<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>'), '\s+', '', 'g')), lambda x: x IS NOT NULL AND x <> '')) AS it
  FROM rec
), b AS (SELECT rid, it FROM bas WHERE len(it) > 0),
nn AS (SELECT count(*) AS n FROM b),
e AS (SELECT rid, '<|cid_begin|>' || unnest(it) || '<|cid_end|>' AS x FROM b),
m AS (SELECT x, count(*) AS c FROM e GROUP BY x),
p AS (SELECT l.x AS sid_a, r.x AS sid_b, count(*) AS n_ab FROM e l JOIN e r ON l.rid = r.rid AND l.x < r.x GROUP BY 1, 2)
"""

SQL = {
    "p2_found": _SQL_BASKETS
    + """SELECT sid_a, sid_b FROM p JOIN m ma ON ma.x = sid_a JOIN m mb ON mb.x = sid_b, nn
WHERE n_ab >= 4 AND n_ab >= 0.005 * n AND n_ab * n >= 6 * ma.c * mb.c""",
    "p2_pair_counts": _SQL_BASKETS
    + """SELECT sid_a, sid_b, n_ab, round(n_ab * CAST(n AS DOUBLE) / (CAST(ma.c AS DOUBLE) * mb.c), 6) AS lift
FROM p JOIN m ma ON ma.x = sid_a JOIN m mb ON mb.x = sid_b, nn""",
}
QUERIES = {"p2_found": p2_found, "p2_pair_counts": p2_pair_counts}
