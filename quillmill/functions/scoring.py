"""Row-level scores: overlaps, ranking, layered codes, judge scores and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import is_code, layer

# fixed values: weights of code layers, of a known code without a match, of the reward's parts
LAYERS = {"a": 0.5, "b": 0.3, "c": 0.2}
KNOWN_SHARE = 0.3
MAIN, FORMAT, GATE_FLOOR, GATE_SPAN, FACTOR_FLOOR, FACTOR_SPAN = 0.9, 0.1, 0.2, 0.8, 0.3, 0.7
JUDGE = {"consistency": 0.35, "novelty": 0.2, "aesthetic": 0.25, "executability": 0.2}


def zero_if(cond: Column, value: Column, other: float = 0.0) -> Column:
    return F.when(cond, value).otherwise(F.lit(other))


def overlap(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two lists as sets; two empty lists agree fully, one empty list gives 0."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    both, n = (F.size(p) == 0) & (F.size(g) == 0), F.size(F.array_intersect(p, g)).cast("double")
    prec = F.when(both, 1.0).when(F.size(p) == 0, 0.0).otherwise(n / F.size(p))
    rec = F.when(both, 1.0).when(F.size(g) == 0, 0.0).otherwise(n / F.size(g))
    f1 = F.when(both, 1.0).when(n == 0, 0.0).otherwise(2 * n / (F.size(p) + F.size(g)))
    return prec, rec, f1


def overlap_reward(pred: Column, gold: Column) -> Column:
    """F1 of stripped lower-case sets; any empty list gives 0."""
    fold = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    p, g = fold(pred), fold(gold)
    return F.when((F.size(p) <= 0) | (F.size(g) <= 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(p, g)) / (F.size(p) + F.size(g)))


def coverage(terms: Column, text: Column) -> Column:
    """Share of terms (repeats count) that the text holds; no terms or no text gives 0."""
    t = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    s = F.lower(F.coalesce(text, F.lit("")))
    return F.when((F.size(t) == 0) | (s == ""), 0.0).otherwise(F.size(F.filter(t, lambda x: F.contains(s, x))).cast("double") / F.size(t))


def weighted_mean(values: list[Column], weights: list[Column]) -> Column:
    """Negative weights count as 0; no weight at all gives 0."""
    w = [F.greatest(x, F.lit(0.0)) for x in weights]
    total = sum(w[1:], w[0])
    return F.when(total > 0, sum((v * x for v, x in zip(values[1:], w[1:])), values[0] * w[0]) / total).otherwise(0.0)


def ndcg(preds: Column, gold: Column, k: int) -> Column:
    """1 / log2(rank + 1) of the first hit among the first k; 0 without one, or without a gold value."""
    at = F.array_position(F.slice(preds, 1, k), gold)
    return F.when(F.coalesce(at, F.lit(0)) > 0, 1.0 / F.log2(at + 1.0)).otherwise(0.0)


def layer_reward(pred: Column, gold: Column) -> Column:
    """Weights of the layers in which two codes agree (both lacking one agrees, too); 0 unless both have some layer."""
    any_ = lambda c: F.coalesce(c.rlike(r"<s_[abc]_\d+>"), F.lit(False))
    hit = [F.when(layer(pred, n).eqNullSafe(layer(gold, n)), w).otherwise(0.0) for n, w in LAYERS.items()]
    return F.when(any_(pred) & any_(gold), F.least(F.lit(1.0), hit[0] + hit[1] + hit[2])).otherwise(0.0)


def in_range_reward(base: Column, known: Column) -> Column:
    return F.when(base > 0, base).when(F.coalesce(known, F.lit(False)), LAYERS["a"] * KNOWN_SHARE).otherwise(0.0)


def judge_overall(consistency: Column, novelty: Column, aesthetic: Column, executability: Column) -> Column:
    """Weighted sum, less 1 when consistency or executability is under 5."""
    s = JUDGE["consistency"] * consistency + JUDGE["novelty"] * novelty + JUDGE["aesthetic"] * aesthetic + JUDGE["executability"] * executability
    return F.round(s - F.when((consistency < 5) | (executability < 5), 1.0).otherwise(0.0), 4)


def leak_penalised(leak: Column, consistency: Column, novelty: Column, aesthetic: Column, executability: Column) -> Column:
    """Overall score once a leak of the target has cost 2.5 of consistency, 2 of executability and another 0.5."""
    c, e = F.greatest(F.lit(0.0), consistency - 2.5), F.greatest(F.lit(0.0), executability - 2.0)
    hit = F.round(judge_overall(c, novelty, aesthetic, e) - 0.5, 4)
    return F.when(leak, hit).otherwise(judge_overall(consistency, novelty, aesthetic, executability))


def bounded(c: Column, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def heuristic_judge(pred_tid: Column, gold_tid: Column, ins: Column) -> dict[str, Column]:
    """Seven scores of an instruction without a model; all but the term overlap are 0 for an empty one."""
    text = F.trim(F.coalesce(ins, F.lit("")))
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    mood = text.rlike("(?i)feel|feeling|emotion|mood|inner|soul|dream|memory|longing")  # fixed values
    spec = F.least(F.size(words) / 25.0, F.lit(1.0))
    gold, pred = coverage(gold_tid, text), coverage(pred_tid, text)
    some = lambda c: F.round(F.when(text != "", c).otherwise(0.0), 4)
    return {
        "specificity": some(F.when(mood, spec).otherwise(F.least(F.lit(1.0), spec + 0.15))),
        "creativity": some(F.when(F.size(F.array_distinct(F.transform(words, lambda x: F.lower(x)))) >= 8, 0.6).otherwise(0.4)),
        "content_quality": some(F.least(F.greatest(F.length(text) / 160.0, F.lit(0.3)), F.lit(0.9))),
        "visual_generatability": some(F.greatest(gold, pred)),
        "ins_vs_gt_tid": F.round(gold, 4),
        "ins_vs_pred_tid": F.round(pred, 4),
        "pred_tid_vs_gt_tid": F.round(overlap_reward(pred_tid, gold_tid), 4),
    }


def think_reward(c: Column, least: int = 10) -> Column:
    """1 when both tags stand in order around more than ``least`` characters that are no white space."""
    a, b = F.locate("<think>", c), F.locate("</think>", c)
    inner = F.regexp_replace(F.substr(c, a + 7, b - a - 7), r"(?U)\s+", "")
    return F.when((a > 0) & (b > a) & (F.length(inner) > least), 1.0).otherwise(0.0)


def format_reward(task: Column, code: Column, terms: Column, ins: Column, violations: Column, objects: Column) -> Column:
    """1 for exactly one object without violations that has the task's fields."""
    ok = ((task == "cid2cid") & is_code(code)) | ((task == "cid2ins") & (F.coalesce(F.size(terms), F.lit(0)) > 0) & (F.trim(F.coalesce(ins, F.lit(""))) != ""))
    return F.when((F.size(violations) == 0) & (objects == 1) & F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)


def total_reward(main: Column, think: Column, fmt: Column, penalty: Column) -> Column:
    """(main x thinking gate + format share) x penalty factor; ``main`` already carries its weight."""
    gate = GATE_FLOOR + GATE_SPAN * think
    factor = FACTOR_FLOOR + FACTOR_SPAN * F.greatest(F.lit(0.0), 1.0 - penalty)
    return (main * gate + FORMAT * fmt) * factor
