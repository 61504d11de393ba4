"""Text clean-up, model-output terms, segments and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import one_line, pytrim
from .ids import is_english_term

# fixed values: terms kept of an output or caption, the longest of a caption, marks between them, delimiters of a cut
MAX_TERMS, LONGEST = 10, 40
BETWEEN = r"[，,。.;；:：/|()\[\]\n]+"
CUTS = (". ", "; ", ", ", "。", "；", "，")


def clean_term(c: Column) -> Column:
    """Brackets, quotes, blanks and separators off the ends, inner white space made one blank."""
    s = F.btrim(pytrim(c), F.lit("[]{}()\"'`"))
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" ,;|"))


def _once(c: Column, use) -> Column:
    """``use`` of an array that is computed once a row, not once an element, where a lambda refers to it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def distinct_folded(c: Column) -> Column:
    """First occurrences by lower-case form, in order."""
    keep = lambda a, low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return _once(c, lambda a: _once(F.transform(a, lambda x: F.lower(x)), lambda low: keep(a, low)))


def _terms(parts: Column, longest: int | None = None) -> Column:
    ok = lambda x: (x != "") & is_english_term(x) & (F.length(x) <= longest if longest else F.lit(True))
    return F.slice(distinct_folded(F.filter(F.transform(parts, clean_term), ok)), 1, MAX_TERMS)


def caption_terms(c: Column) -> Column:
    """Up to ten English terms of at most 40 characters between punctuation marks; null or blank gives []."""
    return _terms(F.split(F.coalesce(c, F.lit("")), BETWEEN), LONGEST)


def output_terms(c: Column) -> Column:
    """Terms of a model's answer: a JSON list or its "terms", else a "terms" list in text, else a bracket list, else the
    text itself, each split and cleaned; the first stage with a candidate wins. Null gives []."""
    none = F.array().cast("array<string>")
    filled = lambda a: F.when(F.size(F.filter(F.transform(a, clean_term), lambda x: x.isNotNull())) > 0, a)
    strict = F.when(F.try_parse_json(c).isNotNull(), F.coalesce(F.from_json(c, "struct<terms:array<string>>")["terms"], F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>"))))
    named = F.nullif(F.regexp_extract(c, r"(?s)\{.*\"terms\"\s*:\s*\[(.*?)\].*\}", 1), F.lit(""))
    listed = F.nullif(F.regexp_extract(c, r"(?s)\[(.*?)\]", 1), F.lit(""))
    stages = [strict, F.split(F.replace(named, F.lit("\n"), F.lit(" ")), r"\s*,\s*"), F.split(listed, r"\s*[,;|\n]\s*"), F.split(c, r"\s*[,;|\n]\s*")]
    return _terms(F.coalesce(*[filled(s) for s in stages], none))


def trim_reasoning(c: Column, longest: int = 200) -> Column:
    """One line of at most ``longest`` characters: cut back to the last delimiter in the last 60, tried in turn, else
    closed with '...'."""
    s = one_line(c)
    cut = F.rtrim(F.left(s, F.lit(longest)))
    back = F.lit(None).cast("string")
    for d in CUTS:
        at = F.length(cut) - F.locate(d[::-1], F.reverse(cut)) - len(d) + 1
        back = F.coalesce(back, F.when((F.locate(d[::-1], F.reverse(cut)) > 0) & (at >= longest - 60), F.rtrim(F.left(cut, at + 1))))
    shut = F.concat(F.regexp_replace(cut, r"[ ,;，；。]+\z", ""), F.lit("..."))
    return F.when(F.length(s) <= longest, s).otherwise(F.coalesce(back, shut))


def target_hits(prompt: Column, terms: Column) -> Column:
    """Terms of two letters or more that the lower-case prompt holds."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (F.length(t) >= 2) & F.contains(p, F.lower(t)))


def strip_fences(c: Column, any_language: bool = True) -> Column:
    """Code fences off a text; the training flavour only knows ```json, each end by itself."""
    s = pytrim(c)
    if any_language:
        inner = F.regexp_replace(F.regexp_replace(s, r"^```[A-Za-z0-9_-]*\s*", ""), r"\s*```\z", "")
        return F.when(s.startswith("```"), inner).otherwise(s)
    return pytrim(F.regexp_replace(F.regexp_replace(s, r"(?i)^```(json)?\s*", ""), r"\s*```\z", ""))


def strip_think(c: Column) -> Column:
    return pytrim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def safe_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z_\-]", "_"), r"_+", "_"), F.lit("_"))


def preview(c: Column, longest: int) -> Column:
    s = one_line(c)
    return F.when(F.length(s) > longest, F.concat(F.left(s, F.lit(longest)), F.lit("...<truncated>"))).otherwise(s)


def task_of_prompt(c: Column) -> Column:
    p = F.lower(c)
    return F.when(p.contains("target_tid") & p.contains("target_ins"), "cid2ins").when(p.contains("target_cid"), "cid2cid").otherwise("")


def first_person(c: Column) -> Column:
    return F.coalesce(c.contains("I"), F.lit(False))
