"""Records of several layouts brought to one, gates of generation jobs, and fields deep in nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from . import joins

LAYOUT = {  # the columns of the three layouts together; a layout's row has nulls elsewhere
    "sample_id": "string", "uid": "string", "history_tids": "array<array<string>>", "hist_tid": "array<array<string>>", "valid_tid": "array<string>",
    "target_tid": "array<string>", "hist_pid": "string", "valid_pid": "string", "target_pid": "string",
}


def with_layout(df: DataFrame) -> DataFrame:
    """``df`` with the columns of all layouts, null where it has none."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in LAYOUT.items() if c not in df.columns})


def dispatched(df: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """``key, form, sample_id, history_tids, target_tid, error`` of records in any of three layouts.

    A: history_tids and target_tid as they are; C: uid, hist_tid and target_tid, valid_tid behind the history; B: uid,
    hist_pid (a text with ids) and target_pid, valid_pid behind the history, each id as its terms in ``terms`` (pid,
    tid; one row per pid) or itself. Tried in the order A, C, B; a record of none has an error. ``key`` is unique."""
    d = with_layout(df)
    has = lambda *cs: F.lit(True) if not cs else F.col(cs[0]).isNotNull() & has(*cs[1:])
    form = F.when(has("history_tids", "target_tid"), "A").when(has("uid", "hist_tid", "target_tid"), "C").when(has("uid", "hist_pid", "target_pid"), "B").otherwise("error")
    d = d.withColumn("form", form)
    clean = coerce.first_filled
    ids = F.concat(coerce.hist_pids(F.col("hist_pid")), F.array_compact(F.array(clean(F.col("valid_pid")), clean(F.col("target_pid")))))
    asked = d.filter("form = 'B'").select(key, ids.alias("_ids"), F.when(clean(F.col("target_pid")).isNotNull(), 1).otherwise(0).alias("_n"))
    found = joins.lookup_array(asked, key, "_ids", terms, "pid", "tid", "_t").select(key, "_t", "_n")
    n = F.size("_t") - F.col("_n")
    d = d.join(found.select(key, F.slice("_t", 1, n).alias("_h"), F.get("_t", n).alias("_g")), key, "left")
    some = lambda c: F.filter(c, lambda x: F.size(x) > 0)
    none = F.array().cast("array<array<string>>")
    valid = coerce.clean_values(F.col("valid_tid"))
    c_hist = F.concat(some(coerce.history_tids(F.col("hist_tid"))), F.when(F.size(valid) > 0, F.array(valid)).otherwise(none))
    hist = F.when(F.col("form") == "A", F.col("history_tids")).when(F.col("form") == "C", c_hist).when(F.col("form") == "B", some(F.coalesce("_h", none)))
    goal = F.when(F.col("form") == "B", F.coalesce("_g", F.array().cast("array<string>"))).when(F.col("form") != "error", F.col("target_tid"))
    return d.select(
        key, "form", F.when(F.col("form") == "A", F.col("sample_id")).otherwise(F.col("uid")).alias("sample_id"), hist.alias("history_tids"), goal.alias("target_tid"),
        F.when(F.col("form") == "error", F.lit("unsupported layout")).alias("error"),
    )


def first_path(record: Column, *paths: str) -> Column:
    """The first value under one of the dotted paths of a JSON record that is neither null nor ''."""
    return F.coalesce(*[F.nullif(F.get_json_object(record, "$." + p), F.lit("")) for p in paths])


def gated(df: DataFrame, kind: str | None, wanted: str, prompt: str, error: str | None = None, uid: str | None = None, position: str | None = None, lenient: bool = True) -> DataFrame:
    """The rows a generation job takes, with ``job``: of the wanted kind (a missing one passes when ``lenient``), without
    a parse error, with a prompt. ``job`` is the uid, else a name by the row's position."""
    k = F.lower(coerce.pytrim(F.col(kind))) if kind else F.lit(None).cast("string")
    ok = F.coalesce(k == wanted, F.lit(lenient)) & (coerce.first_filled(F.col(prompt)).isNotNull())
    if error:
        ok &= F.coalesce(F.col(error), F.lit("")) == ""
    name = coerce.first_filled(F.col(uid)) if uid else F.lit(None).cast("string")
    return df.filter(ok).withColumn("job", F.coalesce(name, F.format_string("sample_%05d", F.col(position))) if position else name)


def outcome_log(df: DataFrame, error: str, *cols: str) -> DataFrame:
    """One record a job: its columns, ``status`` ('ok' or 'error') and the error."""
    return df.select(*cols, F.when(F.col(error).isNull(), "ok").otherwise("error").alias("status"), F.col(error).alias("error"))
