"""Chat samples and prompts from records. Rows that lack a needed field have a null sample and are counted as dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce

# fixed values: texts of the samples, here and in the user turns below
SYSTEM = {
    "cid2tid": "You are an ID mapping assistant. Your task is to map the input cid to the corresponding tid (tid is the item's metadata). The final answer must be a JSON object only, with the field target_tid and no other fields.",
    "tid2cid": "You are an ID mapping assistant. Your task is to map the input tid (tid is the item's metadata) to the corresponding cid. The final answer must be a JSON object only, with the field target_cid and no other fields.",
    "cid2cid": "You are a personalized recommendation assistant. Predict the target cid interaction based on user history cid interaction. Think step by step, then answer. The final answer must be a JSON object only, with the field target_cid and no other fields.",
    "tid2tid": "You are a personalized recommendation assistant. Predict the next target tid interaction based on user history interactions in tid space. Each tid is the item's metadata (a list of strings). Think step by step, then answer. The final answer must be a JSON object only, with the field target_tid and no other fields.",
    "cid2ins": "You are a personalized recommendation and AIGC instruction generation assistant. Based on user history cid interaction, output user target tid interaction and the AIGC instruction. Think step by step, then answer. The final answer must be a JSON object only, with the fields target_tid and target_ins.",
}


def json_list(c: Column, separator: str = ",") -> Column:
    """A list of strings as JSON, compact or with ', '."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, _quoted), separator), F.lit("]"))


def _quoted(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)


def with_think(reasoning: Column, answer: Column) -> Column:
    r = coerce.pytrim(F.coalesce(reasoning, F.lit("")))
    return F.when(r == "", answer).otherwise(F.concat(F.lit("<think>\n"), r, F.lit("\n</think>\n\n"), answer))


def _chat(task: str, user: Column, assistant: Column) -> Column:
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(said("system", F.lit(SYSTEM[task])), said("user", user), said("assistant", assistant))


def _lines(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return reduce(lambda a, b: F.concat(a, F.lit("\n"), b), cols)


def _obj(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def cid2tid(sid: Column, tid: Column) -> Column:
    t = coerce.string_list(tid)
    user = _lines("Task: Map the given cid to the corresponding tid.", F.concat(F.lit("cid: "), sid), "Output JSON only.")
    return F.when(sid.isNotNull() & (F.size(t) > 0), _chat("cid2tid", user, _obj(target_tid=t)))


def tid2cid(sid: Column, tid: Column) -> Column:
    t = coerce.string_list(tid)
    user = _lines("Task: Map the given tid to the corresponding cid.", F.concat(F.lit("tid: "), json_list(t)), "Output JSON only.")
    return F.when(sid.isNotNull() & (F.size(t) > 0), _chat("tid2cid", user, _obj(target_cid=sid)))


def cid2cid(hist: Column, target: Column, reasoning: Column | None = None) -> Column:
    h = coerce.string_list(hist)
    last = "Output JSON only." if reasoning is None else "Think first, then output JSON only."
    user = _lines("Task: Predict the target_cid based on the user's historical interactions in hist_cid.", F.concat(F.lit("hist_cid: "), json_list(h)), last)
    answer = _obj(target_cid=target)
    return F.when((F.size(h) > 0) & target.isNotNull(), _chat("cid2cid", user, answer if reasoning is None else with_think(reasoning, answer)))


def cid2ins(hist: Column, tid: Column, ins: Column, reasoning: Column) -> Column:
    h, t = coerce.string_list(hist), coerce.string_list(tid)
    user = _lines(
        "Task: Generate the target recommendation result based on the user's historical interactions in hist_cid.",
        "The output must be JSON with the fields target_tid and target_ins.",
        F.concat(F.lit("hist_cid: "), json_list(h)),
    )
    ok = (F.size(h) > 0) & (F.size(t) > 0) & (F.coalesce(ins, F.lit("")) != "")
    return F.when(ok, _chat("cid2ins", user, with_think(reasoning, _obj(target_tid=t, target_ins=ins))))


def tid2tid(hist: Column, tid: Column, reasoning: Column) -> Column:
    h, t = coerce.nested_string_list(hist), coerce.string_list(tid)
    text = F.concat(F.lit("["), F.array_join(F.transform(h, lambda r: json_list(r)), ","), F.lit("]"))
    user = _lines(
        "Task: Predict the target_tid based on the user's historical interactions in hist_tid.",
        "Note: each element in hist_tid is a tid (a list of metadata strings).",
        F.concat(F.lit("hist_tid: "), text),
        "Think first, then output JSON only.",
    )
    return F.when((F.size(h) > 0) & (F.size(t) > 0), _chat("tid2tid", user, with_think(reasoning, _obj(target_tid=t))))


def union_samples(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """``task_ord, task, row_id, messages`` of all tasks; null samples are left out."""
    made = [d.select(F.lit(k).alias("task_ord"), F.lit(t).alias("task"), "row_id", "messages").filter("messages IS NOT NULL") for k, (t, d) in enumerate(parts)]
    return reduce(DataFrame.unionByName, made)


def rl_prompt(task: str, hist: Column) -> Column:
    """System and user turn of a record; its history is taken as it is, nulls as the word null."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(hist, F.array().cast("array<string>")), lambda x: F.when(x.isNull(), "null").otherwise(_quoted(x))), ","), F.lit("]"))
    user = {
        "cid2cid": lambda: _lines("Task: Predict the target_cid based on the user's historical interactions in hist_cid.", F.concat(F.lit("hist_cid: "), listed), "Think first, then output JSON only."),
        "cid2ins": lambda: _lines(
            "Task: Generate the target recommendation result based on the user's historical interactions in hist_cid.",
            "The output must be JSON with the fields target_tid and target_ins.", F.concat(F.lit("hist_cid: "), listed),
        ),
    }[task]()
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(said("system", F.lit(SYSTEM[task])), said("user", user))


def rl_row(task: str, split: str, uid: Column, hist: Column, code: Column, tid: Column, ins: Column) -> list[Column]:
    """One flat schema for both tasks; lists stay arrays until a sink writes them."""
    e = F.array().cast("array<string>")
    return [rl_prompt(task, hist).alias("prompt"), F.lit(task).alias("task"), F.lit(split).alias("split"), F.coalesce(uid, F.lit("")).alias("uid"), F.coalesce(hist, e).alias("hist_cid"),
            F.coalesce(code, F.lit("")).alias("gold_target_cid"), F.coalesce(tid, e).alias("gold_target_tid"), F.coalesce(ins, F.lit("")).alias("gold_target_ins")]
