"""Item codes and English terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import pytrim

# fixed values: the format of a code, of an English term, and a code's tokens
CODE = r"^<\|cid_begin\|><s_a_\d+><s_b_\d+><s_c_\d+><\|cid_end\|>\z"
TERM = r"^[A-Za-z0-9][A-Za-z0-9\s&+/\-,'().]*\z"
TOKEN = r"<\|cid_begin\|>|<s_a_\d+>|<s_b_\d+>|<s_c_\d+>|<\|cid_end\|>"


def is_code(c: Column) -> Column:
    """Whether the stripped text is exactly one code; null is none."""
    return F.coalesce(pytrim(c).rlike(CODE), F.lit(False))


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokens_cover(c: Column) -> Column:
    """Whether the tokens make up the whole text."""
    return F.array_join(code_tokens(c), "") == c


def layer(c: Column, name: str) -> Column:
    """Number text of layer a, b or c, null where it is missing."""
    return F.nullif(F.regexp_extract(c, rf"<s_{name}_(\d+)>", 1), F.lit(""))


def token_order(c: Column) -> list[Column]:
    """Sort keys: the begin marker, layers a, b and c by number, the end marker, others by text."""
    kind = F.when(c == "<|cid_begin|>", 0).when(c == "<|cid_end|>", 4)
    for k, name in enumerate("abc", 1):
        kind = kind.when(c.rlike(rf"^<s_{name}_\d+>\z"), k)
    return [kind.otherwise(5).asc(), F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint").asc_nulls_first(), c.asc()]


def is_english_term(c: Column) -> Column:
    ok = c.rlike(TERM) & c.rlike("[A-Za-z]")
    return F.coalesce(ok, F.lit(False))
