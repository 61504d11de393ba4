"""Coercions of loosely typed fields, as column expressions. Null in any of them has the stated result, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


def pytrim(c: Column) -> Column:
    """White space of any kind off both ends (SQL trim takes blanks only); null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def as_list(c: Column, is_array: bool) -> Column:
    """Null -> [], an array as it is, a scalar -> [scalar]."""
    return F.coalesce(c, F.array().cast(STRINGS)) if is_array else F.when(c.isNull(), F.array().cast(STRINGS)).otherwise(F.array(c.cast("string")))


def first(c: Column) -> Column:
    """First element; null for an empty or null array."""
    return F.get(c, F.lit(0))


def str_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def string_list(c: Column, drop_empty: bool = False) -> Column:
    """Nulls dropped; the training flavour keeps empty strings, the inference flavour (``drop_empty``) does not."""
    keep = (lambda x: F.coalesce(x, F.lit("")) != "") if drop_empty else (lambda x: x.isNotNull())
    return F.coalesce(F.filter(c.cast(STRINGS), keep), F.array().cast(STRINGS))


def nested_string_list(c: Column) -> Column:
    return F.coalesce(F.transform(F.filter(c, lambda r: r.isNotNull()), lambda r: string_list(r)), F.array().cast("array<array<string>>"))


def parse_list_string(c: Column) -> Column:
    """'' or null -> []; a JSON list -> its elements; text with commas -> its stripped non-empty parts; else [text]."""
    s = pytrim(F.coalesce(c, F.lit("")))
    split = F.filter(F.transform(F.split(s, ","), pytrim), lambda x: x != "")
    parsed = F.from_json(s, STRINGS)
    return (
        F.when(s == "", F.array().cast(STRINGS))
        .when(s.rlike(r"(?s)^\[.*\]\z") & parsed.isNotNull(), parsed)
        .when(s.contains(","), split)
        .otherwise(F.array(s))
    )


def id_values(c: Column) -> Column:
    """Ids or terms of a text: a JSON list, also of lists, commas, or one value; stripped, without empty ones."""
    inner = lambda x: F.when(x.rlike(r"(?s)^\s*\[.*\]\s*\z"), parse_list_string(x)).otherwise(F.array(x))
    return clean_values(F.flatten(F.transform(parse_list_string(c), inner)))


def clean_values(c: Column) -> Column:
    """Stripped, non-empty elements."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast(STRINGS)), lambda x: pytrim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def target_id(c: Column) -> Column:
    """First element, stripped; '' -> null."""
    return F.nullif(pytrim(first(c)), F.lit(""))


def hist_pids(c: Column, is_array: bool = False) -> Column:
    """All ten-character product ids of a text, in order; of a list, its stripped, non-empty elements."""
    return clean_values(c) if is_array else F.coalesce(F.regexp_extract_all(c, F.lit(r"\b[A-Z0-9]{10}\b"), F.lit(0)), F.array().cast(STRINGS))


def history_tids(c: Column, scalars: bool = False) -> Column:
    """Stripped terms per item; an item left without terms stays as []. ``scalars``: an item is a text with its terms."""
    if scalars:
        return F.coalesce(F.transform(c, id_values), F.array().cast("array<array<string>>"))
    return F.coalesce(F.transform(c, clean_values), F.array().cast("array<array<string>>"))


def format_history(c: Column) -> Column:
    """Numbered lines of comma-joined terms; '[]' for an empty or null history."""
    lines = F.transform(c, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), F.array_join(r, ", ")))
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("[]")).otherwise(F.array_join(lines, "\n"))


def target_text(c: Column) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit(""))


def target_terms(text: Column) -> Column:
    """Lower-case terms of a text split at , / ; and line ends."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[,/;\n]+"), pytrim), lambda x: x != "")


def first_filled(*cols: Column) -> Column:
    """First non-blank of several aliases, stripped; null when all are blank."""
    return F.coalesce(*[F.nullif(pytrim(c.cast("string")), F.lit("")) for c in cols])


def mapped(c: Column, names: dict[str, str], unmapped: str, missing: str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(c.isNull(), missing).otherwise(F.coalesce(F.try_element_at(known, c), F.lit(unmapped)))


def one_line(c: Column) -> Column:
    """Runs of white space made one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
