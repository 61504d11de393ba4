"""Prompts for a model, the records of its ranked answers, and metrics over these records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, ids, jsonx, scoring
from .aggregates import KS, rate
from .builders import SYSTEM, _lines, json_list

# fixed values: texts of the prompts that spell out the form of the answer
STRICT_SYSTEM = {
    "cid2cid": "You are a personalized recommendation assistant. Predict the target cid interaction based on user history cid interaction. Think step by step, then answer. The final answer must be exactly one JSON object with exactly one field: target_cid. Output schema: {\"target_cid\":\"<|cid_begin|><s_a_x><s_b_y><s_c_z><|cid_end|>\"}. target_cid must be a single JSON string, not a list. Do not output markdown, code fences, explanations, or any extra fields.",
    "cid2ins": "You are a personalized recommendation and AIGC instruction generation assistant. Based on user history cid interaction, output user target tid interaction and the AIGC instruction . Think step by step, then answer. The final answer must be exactly one JSON object with exactly two fields in this order: target_tid, target_ins. Output schema: {\"target_tid\":[\"tid_1\",\"tid_2\"],\"target_ins\":\"...\"}. target_tid must be a non-empty JSON array of strings. target_ins must be a non-empty JSON string. Do not output markdown, code fences, explanations, or any extra fields.",
}
STRICT = {
    "cid2cid": (
        "Output constraints:",
        '1. After reasoning, output JSON only: {"target_cid":"<|cid_begin|><s_a_x><s_b_y><s_c_z><|cid_end|>"}',
        "2. target_cid must be a single string, not a list.",
        "3. No extra text before or after the JSON object.",
    ),
    "cid2ins": (
        "Output constraints:",
        '1. After reasoning, output JSON only: {"target_tid":["tid_1","tid_2"],"target_ins":"..."}',
        "2. The JSON field order must be target_tid first, then target_ins.",
        "3. target_tid must be a non-empty array of strings.",
        "4. target_ins must be a non-empty string.",
        "5. No markdown, no code fence, no commentary, no extra fields.",
    ),
}
ASKED = {
    "cid2cid": "Task: Predict the target_cid based on the user's historical interactions in hist_cid.",
    "cid2ins": "Task: Generate the target recommendation result based on the user's historical interactions in hist_cid.",
}
PLAIN = {"cid2cid": "Think first, then output JSON only.", "cid2ins": "The output must be JSON with the fields target_tid and target_ins."}


def user_turn(task: str, mode: str, hist: Column) -> Column:
    """The user's turn: 'strict' spells out the form, 'plain' is the one of the training samples."""
    if mode not in ("strict", "plain") or task not in ASKED:
        raise ValueError(f"no prompt for task {task!r} in mode {mode!r}")
    history = lambda sep: F.concat(F.lit("hist_cid: "), json_list(hist, sep))
    if task == "cid2cid":
        return _lines(ASKED[task], history(", "), *STRICT[task]) if mode == "strict" else _lines(ASKED[task], history(","), PLAIN[task])
    return _lines(ASKED[task], *STRICT[task], history(", ")) if mode == "strict" else _lines(ASKED[task], PLAIN[task], history(", "))


def inference_examples(rows: DataFrame, row_idx: str, task: str, mode: str = "strict", system: str | None = None) -> DataFrame:
    """``task, row_idx, prompt_mode, messages, label, source_row`` of the rows that have a history and a target; others
    are left out. Null and empty elements of a history or list of terms are dropped."""
    hist = coerce.string_list(F.col("hist_sid"), drop_empty=True)
    if task == "cid2cid":
        gold = coerce.target_id(F.array("target_sid"))
        label, ok = F.struct(gold.alias("target_cid")), gold.isNotNull()
    else:
        tid, ins = coerce.string_list(F.col("target_tid"), drop_empty=True), coerce.pytrim(F.coalesce("target_ins", F.lit("")))
        label, ok = F.struct(tid.alias("target_tid"), ins.alias("target_ins")), (F.size(tid) > 0) & (ins != "")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    first = F.lit(system if system is not None else STRICT_SYSTEM[task] if mode == "strict" else SYSTEM[task])
    d = rows.withColumn("_h", hist).filter((F.size("_h") > 0) & ok)
    return d.select(
        F.lit(task).alias("task"), F.col(row_idx).alias("row_idx"), F.lit(mode).alias("prompt_mode"),
        F.array(said("system", first), said("user", user_turn(task, mode, F.col("_h")))).alias("messages"), label.alias("label"), F.struct(*rows.columns).alias("source_row"),
    )


def ranked_records(answers: DataFrame, texts: str, gold: Column) -> DataFrame:
    """``answers`` with ``candidates`` (rank, raw_text, parsed_json, parse_error, parsed_target_cid), the distinct
    ``candidate_target_cids`` in rank order and ``gold_target_cid``; ``texts``: the ranked answers of a row."""
    t = F.coalesce(F.col(texts), F.array().cast("array<string>"))
    parse = F.pandas_udf(lambda rows: pd.Series([[jsonx.last_object(x) for x in r] for r in rows], dtype=object), "array<string>")
    d = answers.withColumn("_t", t).withColumn("_p", parse("_t")).withColumn("gold_target_cid", gold)

    def candidate(x, i):
        found = F.get_json_object(x["_p"], "$.target_cid")
        listed = F.when(found.rlike(r"^\s*\["), F.get(F.from_json(found, "array<string>"), F.lit(0))).otherwise(found)
        return F.struct(
            (i + 1).alias("rank"), x["_t"].alias("raw_text"), x["_p"].alias("parsed_json"), F.when(x["_p"].isNull(), F.lit("no object")).alias("parse_error"),
            F.nullif(coerce.pytrim(listed), F.lit("")).alias("parsed_target_cid"),
        )

    d = d.withColumn("candidates", F.transform(F.arrays_zip("_t", "_p"), candidate)).drop("_t", "_p")
    return d.withColumn("candidate_target_cids", F.array_distinct(F.array_compact("candidates.parsed_target_cid")))


def ranking_summary(records: DataFrame, by: list[str] = [], ks: tuple[int, ...] = KS) -> DataFrame:  # noqa: B006
    """Counts and rates of parsed answers, exact first answers (of all, and of those parsed), and recall, hits and NDCG at
    k. A first answer without an id equals a missing gold id. No rows give 0 everywhere (one row without ``by``)."""
    c, g, top = F.col("candidate_target_cids"), F.col("gold_target_cid"), F.get("candidates", F.lit(0))
    parsed = F.coalesce(top["parsed_json"].isNotNull(), F.lit(False))
    exact = top["parsed_target_cid"].eqNullSafe(g)
    hit = lambda k: F.coalesce(F.array_contains(F.slice(c, 1, k), g), F.lit(False))
    aggs = [
        F.count("*").alias("total"), F.count_if(parsed).alias("top1_parsed"), rate(parsed).alias("top1_parse_rate"),
        F.count_if(F.exists("candidates", lambda x: x["parsed_json"].isNotNull())).alias("any_parsed"), rate(F.exists("candidates", lambda x: x["parsed_json"].isNotNull())).alias("any_parse_rate"),
        F.count_if(exact).alias("exact_matches"), rate(exact).alias("exact_accuracy"),
        F.coalesce(F.round(F.try_divide(F.count_if(exact).cast("double"), F.count_if(parsed)), 6), F.lit(0.0)).alias("exact_on_parsed"),
    ]
    for k in ks:
        aggs += [rate(hit(k)).alias(f"recall_{k}"), F.count_if(hit(k)).alias(f"hits_{k}"), F.coalesce(F.round(F.avg(scoring.ndcg(c, g, k)), 6), F.lit(0.0)).alias(f"ndcg_{k}")]
    return (records.groupBy(*by) if by else records).agg(*aggs)


def instruction_records(answers: DataFrame, text: str) -> DataFrame:
    """``answers`` with ``parsed_json, parse_error, prediction`` (target_tid, target_ins)."""
    d = answers.withColumn("_r", jsonx.recovered_col(F.col(text)))
    d = d.withColumn("parsed_json", F.col("_r.json")).withColumn("parse_error", F.col("_r.error")).drop("_r")
    o = F.from_json("parsed_json", "target_tid array<string>, target_ins string")
    return d.withColumn("prediction", F.struct(coerce.string_list(o["target_tid"], drop_empty=True).alias("target_tid"), coerce.pytrim(F.coalesce(o["target_ins"], F.lit(""))).alias("target_ins")))


def instruction_summary(records: DataFrame, gold_tid: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Parse rates, filled fields, terms without an instruction, exact lists, and mean overlap with the gold terms."""
    p, i, g = F.col("prediction.target_tid"), F.col("prediction.target_ins"), F.col(gold_tid)
    prec, rec, f1 = scoring.overlap(p, g)
    avg = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    aggs = [
        F.count("*").alias("total"), rate(F.col("parsed_json").isNotNull()).alias("object_rate"),
        rate(F.col("parse_error").isNull() & F.col("parsed_json").isNotNull() & (F.size(p) > 0) & (i != "")).alias("fields_rate"),
        rate(F.size(p) > 0).alias("tid_rate"), rate(i != "").alias("ins_rate"), rate((F.size(p) > 0) & (i == "")).alias("tid_only_rate"),
        rate(p == g).alias("exact_rate"), avg(prec).alias("precision"), avg(rec).alias("recall"), avg(f1).alias("f1"),
    ]
    return (records.groupBy(*by) if by else records).agg(*aggs)


def completion_lengths(answers: DataFrame, ids_col: str, eos: int) -> DataFrame:
    """One row: mean, least and most tokens up to the end mark, the share cut off before it, and the same of the rest."""
    at = F.array_position(ids_col, F.lit(eos)).cast("int")
    d = answers.select(F.when(at > 0, at).otherwise(F.size(ids_col)).alias("n"), F.coalesce(at > 0, F.lit(False)).alias("ended"))
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    done = F.when(F.col("ended"), F.col("n"))
    return d.agg(
        z(F.round(F.avg("n"), 6)).alias("mean_length"), z(F.min("n")).alias("min_length"), z(F.max("n")).alias("max_length"),
        z(1 - F.round(F.avg(F.col("ended").cast("int")), 6)).alias("clipped_ratio"),
        z(F.round(F.avg(done), 6)).alias("mean_terminated"), z(F.min(done)).alias("min_terminated"), z(F.max(done)).alias("max_terminated"),
    )
