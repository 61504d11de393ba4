"""Ranking and instruction metrics, reward statistics and advantages."""

from pyspark.sql import functions as F

from ..functions import coerce, ids
from ..operators import aggregates, sequence
from .base import CODE_RX, TRIM, t

TOP = 40


def _ranked(spark, d):
    """Each test record with the most popular training targets as its candidates (a list of 40, fixed)."""
    train = t(spark, d, "train_cid2cid").select(coerce.pytrim(F.col("target_sid")).alias("code")).filter(ids.is_code(F.col("code")))
    top = train.groupBy("code").count().orderBy(F.desc("count"), "code").limit(TOP)
    one = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "code"))).alias("x")).select(F.lit(1).alias("_k"), F.col("x.code").alias("preds"))
    test = t(spark, d, "test_cid2cid").select("source_dataset", coerce.target_id(F.array("target_sid")).alias("gold"), F.lit(1).alias("_k"))
    return test.join(F.broadcast(one), "_k").drop("_k")  # one row of 40 codes


def recall_ndcg_topk(spark, d):
    return aggregates.ranking_metrics(_ranked(spark, d), "preds", "gold")


def metrics_by_segment(spark, d):
    return aggregates.ranking_metrics(_ranked(spark, d), "preds", "gold", ["source_dataset"])


def tid_overlap_prf(spark, d):
    from ..functions import scoring

    r = t(spark, d, "train_cid2ins")
    words = coerce.clean_values(F.split(F.lower(F.coalesce("target_ins", F.lit(""))), r"[^a-z]+"))
    p, rc, f = scoring.overlap(coerce.string_list(F.col("target_tid")), words)
    return r.select("row_id", F.round(p, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f, 6).alias("f1"))


def instruction_metrics(spark, d):
    r = t(spark, d, "train_cid2ins")
    gold = coerce.clean_values(F.col("target_tid"))
    r = r.select("source_dataset", coerce.string_list(F.col("target_tid")).alias("p"), gold.alias("g"), F.coalesce("target_ins", F.lit("")).alias("i"))
    return aggregates.instruction_metrics(r, "p", "g", "i", ["source_dataset"])


def _rewards(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", F.least(F.lit(1.0), F.col("value") / 500).alias("reward"))


def _advantage(scale):
    def q(spark, d):
        a = sequence.advantages(_rewards(spark, d), ["user_id"], "reward", scale)
        return a.select("event_id", F.round("advantage", 6).alias("advantage"))

    return q


def reward_group_stats(spark, d):
    return aggregates.group_spread(_rewards(spark, d), ["user_id"], "reward")


def weighted_reward_sum(spark, d):
    e = t(spark, d, "events").select("event_id", (F.col("value") / 500).alias("a"), F.when(F.col("event_type") == "error", float("nan")).otherwise(1.0).alias("b"))
    return e.select("event_id", F.round(sequence.nan_weighted_sum(["a", "b"], [0.7, 0.3]), 6).alias("reward"))


_POP = f"""WITH tr AS (SELECT {TRIM.format('target_sid')} AS code FROM train_cid2cid),
top AS (SELECT code, row_number() OVER (ORDER BY count(*) DESC, code) AS rk FROM tr WHERE regexp_full_match(code, '{CODE_RX}') GROUP BY code QUALIFY rk <= {TOP}),
te AS (SELECT row_id, source_dataset, nullif({TRIM.format('target_sid')}, '') AS gold FROM test_cid2cid),
j AS (SELECT te.*, rk FROM te LEFT JOIN top ON code = gold)
"""
_K = ", ".join(
    f"round(avg(CASE WHEN rk <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN rk <= {k} THEN 1 / log2(rk + 1.0) ELSE 0 END), 6) AS ndcg_{k}" for k in aggregates.KS
)
_M = f"count(*) AS total, 1.0::DOUBLE AS parsed_rate, count(*) FILTER (rk = 1) AS exact_matches, round(avg(CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END), 6) AS exact_accuracy, {_K} FROM j"
_EV = "WITH e AS (SELECT event_id, user_id, least(1.0, value / 500) AS r FROM events) "
_OV = r"""WITH r AS (SELECT row_id, source_dataset, target_tid, coalesce(target_ins, '') AS ins FROM train_cid2ins),
s AS (SELECT *, list_distinct({p}) AS p, list_distinct({g}) AS g FROM r),
o AS (SELECT *, len(list_intersect(p, g))::DOUBLE AS n FROM s),
m AS (SELECT *, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN len(p) = 0 THEN 0 ELSE n / len(p) END AS prec,
  CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN len(g) = 0 THEN 0 ELSE n / len(g) END AS rec,
  CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN n = 0 THEN 0 ELSE 2 * n / (len(p) + len(g)) END AS f1 FROM o)
"""
_LIST = "coalesce(list_filter(target_tid, lambda x: x IS NOT NULL), [])"
_CLEAN = r"coalesce(list_filter(list_transform(target_tid, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''), [])"
SQL = {
    "recall_ndcg_topk": _POP + "SELECT " + _M,
    "metrics_by_segment": _POP + "SELECT source_dataset, " + _M + " GROUP BY source_dataset",
    "tid_overlap_prf": _OV.format(p=_LIST, g="list_filter(regexp_split_to_array(lower(ins), '[^a-z]+'), lambda x: x <> '')")
    + "SELECT row_id, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "instruction_metrics": _OV.format(p=_LIST, g=_CLEAN)
    + f"""SELECT source_dataset, count(*) AS total, round(avg(CASE WHEN len({_LIST}) > 0 THEN 1.0 ELSE 0 END), 6) AS tid_rate,
round(avg(CASE WHEN trim(ins) <> '' THEN 1.0 ELSE 0 END), 6) AS ins_rate, round(avg(CASE WHEN {_LIST} = {_CLEAN} THEN 1.0 ELSE 0 END), 6) AS exact_rate,
round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(f1), 6) AS f1 FROM m GROUP BY source_dataset""",
    "grpo_advantage_group": _EV + "SELECT event_id, round((r - avg(r) OVER (PARTITION BY user_id)) / (stddev_samp(r) OVER (PARTITION BY user_id) + 1e-4), 6) AS advantage FROM e",
    "grpo_advantage_batch": _EV + "SELECT event_id, round((r - avg(r) OVER (PARTITION BY user_id)) / (stddev_samp(r) OVER () + 1e-4), 6) AS advantage FROM e",
    "grpo_advantage_none": _EV + "SELECT event_id, round(r - avg(r) OVER (PARTITION BY user_id), 6) AS advantage FROM e",
    "reward_group_stats": _EV
    + ", g AS (SELECT count(*) AS n, stddev_pop(round(r, 4)) AS sd FROM e GROUP BY user_id HAVING count(*) > 1) SELECT count(*) AS groups, count(*) FILTER (sd < 1e-8) AS flat_groups, round(avg(sd), 6) AS mean_sd, round(min(sd), 6) AS min_sd, round(max(sd), 6) AS max_sd FROM g",
    "weighted_reward_sum": "SELECT event_id, round(value / 500 * 0.7 + CASE WHEN event_type = 'error' THEN 0 ELSE 0.3 END, 6) AS reward FROM events",
}
QUERIES = {
    "recall_ndcg_topk": recall_ndcg_topk,
    "metrics_by_segment": metrics_by_segment,
    "tid_overlap_prf": tid_overlap_prf,
    "instruction_metrics": instruction_metrics,
    "grpo_advantage_group": _advantage("group"),
    "grpo_advantage_batch": _advantage("batch"),
    "grpo_advantage_none": _advantage("none"),
    "reward_group_stats": reward_group_stats,
    "weighted_reward_sum": weighted_reward_sum,
}
