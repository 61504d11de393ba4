"""Rewards of model answers to both tasks, from their raw and their canonical text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, jsonx, scoring
from . import joins

FORCED = 0.1  # fixed value: quality of an instruction whose judge failed


def answer_rewards(answers: DataFrame, known: DataFrame, code: str, judged: dict[str, str] | None = None, failed: str | None = None) -> DataFrame:
    """``answers`` with ``main, think, fmt, penalty, reward``.

    ``answers``: ``task, text, gold_cid, gold_tid``. The form is judged on the canonical text, the penalty on the raw
    one. A code scores by its layers, or for being among ``known`` (column ``code``); an instruction by the mean of four
    qualities: the columns that ``judged`` names, else the heuristic ones, or a fixed value where ``failed`` (a boolean
    column) is true; other tasks score 0. Null texts are empty answers."""
    a = answers.withColumn("_raw", jsonx.form_col(F.col("text"))).withColumn("_said", jsonx.canonical_answer_col(F.col("text"), F.col("task")))
    a = a.withColumn("_form", jsonx.form_col(F.col("_said"))).withColumn("_o", F.from_json(jsonx.answer_fields_col(F.col("text"), F.col("task")), "target_cid string, target_tid array<string>, target_ins string"))
    a = a.withColumn("_code", F.when(ids.is_code(F.col("_o.target_cid")), F.trim("_o.target_cid")))
    a = joins.with_membership(a, "_code", known, code, "_known")
    names = ("specificity", "creativity", "content_quality", "visual_generatability")
    h = scoring.heuristic_judge(F.col("_o.target_tid"), F.col("gold_tid"), F.col("_o.target_ins"))
    quality = scoring.weighted_mean([F.col(judged[n]) if judged else h[n] for n in names], [F.lit(1.0)] * len(names))
    quality = F.when(F.coalesce(F.col(failed), F.lit(False)), FORCED).otherwise(quality) if failed else quality
    cid = scoring.in_range_reward(scoring.layer_reward(F.col("_code"), F.col("gold_cid")), F.col("_known"))
    a = a.withColumn("main", F.when(F.col("task") == "cid2cid", scoring.MAIN * cid).when(F.col("task") == "cid2ins", scoring.MAIN * quality).otherwise(0.0))
    a = a.withColumn("think", scoring.think_reward(F.coalesce("_said", F.lit(""))))
    fmt = scoring.format_reward(F.col("task"), F.col("_code"), F.col("_o.target_tid"), F.col("_o.target_ins"), F.col("_form.violations"), F.col("_form.objects"))
    a = a.withColumn("fmt", fmt).withColumn("penalty", F.col("_raw.penalty"))
    total = scoring.total_reward(F.col("main"), F.col("think"), F.col("fmt"), F.col("penalty"))
    a = a.withColumn("reward", F.when(F.col("task").isin("cid2cid", "cid2ins"), total).otherwise(0.0))
    return a.select(*answers.columns, "main", "think", "fmt", "penalty", "reward")
