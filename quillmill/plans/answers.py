"""Prompts, ranked answers and their metrics, layouts, packed tokens and logs."""

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import inputs, joins, predictions, sequence
from .base import TRIM, t
from .texts import _ANS, _completions


def _said(code):
    return F.to_json(F.struct(F.coalesce(code, F.lit("")).alias("target_cid")))


def _ranked(spark, d):
    """Three answers to each test record: right, wrong, without an object or in a fence, by the row's id."""
    r = t(spark, d, "test_cid2cid").select("row_id", "source_dataset", "target_sid", F.get(F.array_compact("hist_sid"), F.lit(0)).alias("h"))
    k, goal, other = F.col("row_id") % 4, _said(F.col("target_sid")), _said(F.col("h"))
    first = (
        F.when(k == 0, F.concat(F.lit("<think>{so}</think>"), goal)).when(k == 1, other).when(k == 2, F.lit("no idea {"))
        .otherwise(F.concat(F.lit("```json\n"), goal, F.lit("\n``` as said")))
    )
    r = r.withColumn("texts", F.array(first, other, goal))
    return predictions.ranked_records(r, "texts", coerce.target_id(F.array("target_sid")))


def prediction_records(spark, d):
    r = _ranked(spark, d)
    return r.select("row_id", F.array_join("candidate_target_cids", "|").alias("found"), F.size(F.filter("candidates", lambda x: x["parse_error"].isNotNull())).alias("n_errors"), "gold_target_cid")


def prediction_metrics(spark, d):
    return predictions.ranking_summary(_ranked(spark, d), ["source_dataset"], (1, 2, 5))


def instruction_prediction_metrics(spark, d):
    a = _completions(spark, d).join(t(spark, d, "train_cid2ins").select("row_id", "source_dataset", coerce.string_list(F.col("target_tid"), True).alias("gold")), "row_id")
    return predictions.instruction_summary(predictions.instruction_records(a, "text"), "gold", ["source_dataset"])


def inference_prompts(spark, d):
    rows = {"cid2cid": t(spark, d, "test_cid2cid"), "cid2ins": t(spark, d, "train_cid2ins")}
    out = None
    for task, r in rows.items():
        for mode in ("strict", "plain"):
            e = predictions.inference_examples(r, "row_id", task, mode).select("task", F.col("prompt_mode").alias("mode"), F.col("row_idx").alias("row_id"), F.col("messages")[1]["content"].alias("user"), F.to_json("label").alias("label"))
            out = e if out is None else out.unionByName(e)
    return out


def layout_dispatch(spark, d):
    """Records of all layouts: instructions as A, C or none, by the row's id, and catalog rows as B."""
    ins, cat = t(spark, d, "train_cid2ins"), t(spark, d, "pid2cid2tid")
    k, tid = F.col("row_id") % 3, F.col("target_tid")
    a = inputs.with_layout(ins.filter(k == 0).select("row_id", F.col("uid").alias("sample_id"), F.array(tid).alias("history_tids"), "target_tid"))
    c = inputs.with_layout(ins.filter(k == 1).select("row_id", "uid", F.array(tid, F.slice(tid, 1, 1)).alias("hist_tid"), F.slice(tid, 1, 1).alias("valid_tid"), "target_tid"))
    e = inputs.with_layout(ins.filter(k == 2).select("row_id", "uid"))
    b = cat.filter("pid IS NOT NULL").select("row_id", F.lit("u").alias("uid"), F.concat(F.lit("['"), "pid", F.lit("', 'ZZZZZZZZZZ']")).alias("hist_pid"), F.lit(" ").alias("valid_pid"), F.col("pid").alias("target_pid"))
    terms = joins.latest(cat.filter("pid IS NOT NULL").select("pid", coerce.clean_values(F.col("tid")).alias("tid"), "updated_ts", "row_id").filter(F.size("tid") > 0), ["pid"], F.struct("updated_ts", "row_id")).select("pid", "tid")
    r = inputs.dispatched(a.unionByName(c).unionByName(e).unionByName(inputs.with_layout(b)), "row_id", terms)
    lines = F.array_join(F.transform("history_tids", lambda x: F.array_join(x, ",")), ";")
    return r.select("row_id", "form", "sample_id", lines.alias("history"), F.array_join("target_tid", ",").alias("target"), "error")


def _samples(spark, d):
    """Samples with tokens: the characters of terms and instruction as numbers, the instruction being the assistant's."""
    points = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    r = t(spark, d, "train_cid2ins").select("source_dataset", "row_id", points(F.array_join(coerce.string_list(F.col("target_tid")), ",")).alias("a"), points(F.coalesce("target_ins", F.lit(""))).alias("b"))
    mask = F.concat(F.transform("a", lambda x: F.lit(0)), F.transform("b", lambda x: F.lit(1)))
    return r.select(F.coalesce("source_dataset", F.lit("")).alias("split"), "row_id", F.concat("a", "b").alias("ids"), mask.alias("mask"))


def packed_tokens(spark, d):
    p = sequence.packed_tokens(_samples(spark, d), "split", "row_id", "ids", "mask", 0, 2048)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
    return p.select("split", "pack", F.size("input_ids").alias("n"), text("input_ids").alias("ids"), text("labels").alias("labels"))


def collated_batch(spark, d):
    """Rows padded to the longest one of the table."""
    s = _samples(spark, d).select("row_id", "ids", F.zip_with("ids", "mask", lambda i, m: F.when(m == 1, i).otherwise(-100)).alias("labels"))
    width = s.agg(F.max(F.size("ids"))).first()[0] or 0
    c = sequence.collated(s, "ids", "labels", width, 0)
    sums = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return c.select("row_id", F.size("input_ids").alias("width"), sums("input_ids").alias("ids"), sums("labels").alias("labels"), sums("attention_mask").cast("int").alias("n"))


def completion_lengths(spark, d):
    s = t(spark, d, "train_cid2ins").select(F.transform(coerce.string_list(F.col("target_tid")), lambda x: F.length(x)).alias("ids"))
    return predictions.completion_lengths(s, "ids", 5)


def generation_jobs(spark, d):
    r = t(spark, d, "train_cid2ins").select("row_id", "uid", "target_ins", F.when(F.col("row_id") % 3 == 0, " Video").when(F.col("row_id") % 3 == 1, "image").alias("kind"), F.when(F.col("row_id") % 5 == 0, "bad").alias("parse_error"))
    r = r.withColumn("record", F.to_json(F.struct(F.struct(F.col("target_ins").alias("text")).alias("prediction"), F.col("uid").alias("fallback"))))
    r = r.withColumn("prompt", inputs.first_path(F.col("record"), "missing.path", "prediction.text", "fallback"))
    return inputs.gated(r, "kind", "video", "prompt", "parse_error", "uid", "row_id").select("row_id", "job", "prompt")


def timeout_aborts(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "Read Timed Out").when(F.col("event_type") == "view", "refused").alias("error"))
    return sequence.aborts(e, ["user_id"], ["ts", "event_id"], "error", 2).filter("abort").select("event_id", "user_id")


def failure_cooldown(spark, d):
    e = t(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return sequence.cooled_down(e, ["user_id"], "ts", 60 * 24, 3, 60 * 12).select("event_id", "recent", "tripped", "cooling")


def metrics_by_scope(spark, d):
    """Ranking metrics by source and by whether the gold code is in the catalog."""
    known = t(spark, d, "pid2cid2tid").select(coerce.pytrim(F.col("sid")).alias("sid"))
    r = joins.with_membership(_ranked(spark, d), "gold_target_cid", known, "sid", "in_catalog")
    return predictions.ranking_summary(r, ["source_dataset", "in_catalog"], (1, 5))


_L = "coalesce(list_filter({}, lambda x: x IS NOT NULL), [])"
_NE = "list_filter({}, lambda x: x IS NOT NULL AND x <> '')"
_RANK = f"""WITH r AS (SELECT row_id, source_dataset, row_id % 4 AS k, nullif({TRIM.format('target_sid')}, '') AS g, nullif({TRIM.format('list_filter(hist_sid, lambda x: x IS NOT NULL)[1]')}, '') AS h FROM test_cid2cid),
c AS (SELECT *, CASE k WHEN 1 THEN h WHEN 2 THEN NULL ELSE g END AS c1, k <> 2 AS p1 FROM r),
u AS (SELECT *, list_filter([c1, h, g], lambda x: x IS NOT NULL) AS l FROM c), p AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM u)
"""
_SEP = "'[' || array_to_string(list_transform({h}, lambda x: to_json(x)::VARCHAR), '{s}') || ']'"
_CH = "CASE WHEN {0} = '' THEN [] ELSE list_transform(string_split({0}, ''), lambda c: ord(c)) END"
_TOK = f"""WITH s0 AS (SELECT coalesce(source_dataset, '') AS split, row_id, array_to_string({_L.format('target_tid')}, ',') AS a, coalesce(target_ins, '') AS b FROM train_cid2ins),
s AS (SELECT split, row_id, {_CH.format("coalesce(a, '')")} AS a, {_CH.format('b')} AS b FROM s0)
"""


def _at(k):
    return f"(g IS NOT NULL AND coalesce(list_contains(u[1:{k}], g), false))"


SQL = {
    "prediction_records": _RANK + "SELECT row_id, coalesce(array_to_string(u, '|'), '') AS found, (k = 2)::INT AS n_errors, g AS gold_target_cid FROM p",
    "prediction_metrics": _RANK
    + """SELECT source_dataset, count(*) AS total, count(*) FILTER (p1) AS top1_parsed, round(avg(p1::INT), 6) AS top1_parse_rate, count(*) AS any_parsed, 1.0::DOUBLE AS any_parse_rate,
count(*) FILTER (c1 IS NOT DISTINCT FROM g) AS exact_matches, round(avg((c1 IS NOT DISTINCT FROM g)::INT), 6) AS exact_accuracy, coalesce(round(count(*) FILTER (c1 IS NOT DISTINCT FROM g) / nullif(count(*) FILTER (p1), 0), 6), 0) AS exact_on_parsed, """
    + ", ".join(f"round(avg({_at(k)}::INT), 6) AS recall_{k}, count(*) FILTER ({_at(k)}) AS hits_{k}, round(avg(CASE WHEN {_at(k)} THEN 1 / log2(list_position(u, g) + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (1, 2, 5))
    + " FROM p GROUP BY source_dataset",
    "instruction_prediction_metrics": _ANS
    + f""", p AS (SELECT s.source_dataset, a.tids AS p, a.tids AS g, {TRIM.format("CASE WHEN k <> 3 THEN insc ELSE rel END")} AS i, (k <> 3 OR len(tids) > 0 OR rel <> '') AS o FROM a JOIN train_cid2ins s USING (row_id)),
q AS (SELECT *, len(list_distinct(p)) AS n FROM p)
SELECT source_dataset, count(*) AS total, round(avg(o::INT), 6) AS object_rate, round(avg((len(p) > 0 AND i <> '')::INT), 6) AS fields_rate, round(avg((len(p) > 0)::INT), 6) AS tid_rate, round(avg((i <> '')::INT), 6) AS ins_rate,
round(avg((len(p) > 0 AND i = '')::INT), 6) AS tid_only_rate, 1.0::DOUBLE AS exact_rate, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM q GROUP BY source_dataset""",
    "inference_prompts": f"""WITH c AS (SELECT row_id, {_NE.format('hist_sid')} AS h, nullif({TRIM.format('target_sid')}, '') AS g FROM test_cid2cid), i AS (SELECT row_id, {_NE.format('hist_sid')} AS h, {_NE.format('target_tid')} AS g, {TRIM.format("coalesce(target_ins, '')")} AS s FROM train_cid2ins),
x AS (SELECT 'cid2cid' AS task, row_id, {_SEP.format(h='h', s=', ')} AS hs, {_SEP.format(h='h', s=',')} AS hc, '{{"target_cid":' || to_json(g) || '}}' AS label FROM c WHERE len(h) > 0 AND g IS NOT NULL
UNION ALL SELECT 'cid2ins', row_id, {_SEP.format(h='h', s=', ')}, '', '{{"target_tid":' || to_json(g) || ',"target_ins":' || to_json(s) || '}}' FROM i WHERE len(h) > 0 AND len(g) > 0 AND s <> '')
SELECT task, mode, row_id, label, CASE WHEN task = 'cid2cid' THEN '{predictions.ASKED["cid2cid"].replace("'", "''")}' || chr(10) || 'hist_cid: ' || CASE mode WHEN 'strict' THEN hs || chr(10) || '{(chr(10)).join(predictions.STRICT["cid2cid"])}' ELSE hc || chr(10) || '{predictions.PLAIN["cid2cid"]}' END
 ELSE '{predictions.ASKED["cid2ins"].replace("'", "''")}' || chr(10) || CASE mode WHEN 'strict' THEN '{(chr(10)).join(predictions.STRICT["cid2ins"])}' ELSE '{predictions.PLAIN["cid2ins"]}' END || chr(10) || 'hist_cid: ' || hs END AS "user" FROM x, (VALUES ('strict'), ('plain')) m(mode)""",
    "layout_dispatch": f"""WITH i AS (SELECT row_id, uid, row_id % 3 AS k, target_tid AS tid, list_filter(list_transform(target_tid, lambda x: {TRIM.format('x')}), lambda x: x IS NOT NULL AND x <> '') AS c FROM train_cid2ins),
l AS (SELECT pid, list_filter(list_transform(tid, lambda x: {TRIM.format('x')}), lambda x: x IS NOT NULL AND x <> '') AS t, updated_ts, row_id FROM pid2cid2tid WHERE pid IS NOT NULL),
m AS (SELECT pid, t FROM l WHERE len(t) > 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY updated_ts DESC NULLS LAST, row_id DESC) = 1),
b AS (SELECT p.row_id, coalesce(m.t, [p.pid]) AS t, regexp_matches(p.pid, '^[A-Z0-9]{{10}}$') AS ok FROM pid2cid2tid p LEFT JOIN m USING (pid) WHERE p.pid IS NOT NULL)
SELECT row_id, CASE WHEN k = 0 AND tid IS NOT NULL THEN 'A' WHEN k = 1 AND tid IS NOT NULL AND uid IS NOT NULL THEN 'C' ELSE 'error' END AS form, uid AS sample_id,
 CASE WHEN tid IS NULL OR k = 2 OR (k = 1 AND uid IS NULL) THEN NULL WHEN k = 0 THEN coalesce(array_to_string(list_filter(tid, lambda x: x IS NOT NULL), ','), '') ELSE coalesce(array_to_string(list_transform(list_filter([c, list_filter(list_transform(tid[1:1], lambda x: {TRIM.format('x')}), lambda x: x IS NOT NULL AND x <> ''), list_filter(list_transform(tid[1:1], lambda x: {TRIM.format('x')}), lambda x: x IS NOT NULL AND x <> '')], lambda y: len(y) > 0), lambda y: array_to_string(y, ',')), ';'), '') END AS history,
 CASE WHEN tid IS NULL OR k = 2 OR (k = 1 AND uid IS NULL) THEN NULL ELSE coalesce(array_to_string(list_filter(tid, lambda x: x IS NOT NULL), ','), '') END AS target, CASE WHEN tid IS NULL OR k = 2 OR (k = 1 AND uid IS NULL) THEN 'unsupported layout' END AS error FROM i
UNION ALL SELECT row_id, 'B', 'u', CASE WHEN ok THEN array_to_string(t, ',') || ';' ELSE '' END || 'ZZZZZZZZZZ', array_to_string(t, ','), NULL FROM b""",
    "packed_tokens": _TOK.replace("WITH s0", "WITH RECURSIVE s0")
    + """, f AS (SELECT split, row_id, list_concat(list_concat(a, b), [0]) AS ids, list_concat(list_concat(list_transform(a, lambda x: -100), b), [-100]) AS lab, len(a) + len(b) + 1 AS n FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS k FROM f WHERE n <= 2048),
r AS (SELECT split, row_id, n, k, 0 AS pack, n AS used FROM p WHERE k = 1 UNION ALL SELECT p.split, p.row_id, p.n, p.k, CASE WHEN r.used + p.n > 2048 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.used + p.n > 2048 THEN p.n ELSE r.used + p.n END FROM r JOIN p ON p.split = r.split AND p.k = r.k + 1)
SELECT r.split, r.pack::INT AS pack, sum(r.n)::INT AS n, md5(array_to_string(flatten(list(p.ids ORDER BY r.row_id)), ' ')) AS ids, md5(array_to_string(flatten(list(p.lab ORDER BY r.row_id)), ' ')) AS labels FROM r JOIN p USING (split, row_id) GROUP BY r.split, r.pack""",
    "collated_batch": _TOK
    + """, w AS (SELECT max(len(a) + len(b)) AS m FROM s) SELECT row_id, m::INT AS width, coalesce(list_sum(list_concat(a, b)), 0)::BIGINT AS ids,
(coalesce(list_sum(b), 0) - 100 * (m - len(b)))::BIGINT AS labels, (len(a) + len(b))::INT AS n FROM s, w""",
    "completion_lengths": f"""WITH a AS (SELECT list_transform({_L.format('target_tid')}, lambda x: length(x)) AS a FROM train_cid2ins), b AS (SELECT coalesce(list_position(a, 5), 0) AS p, len(a) AS n FROM a), c AS (SELECT p > 0 AS e, CASE WHEN p > 0 THEN p ELSE n END AS n FROM b)
SELECT round(avg(n), 6) AS mean_length, min(n)::DOUBLE AS min_length, max(n)::DOUBLE AS max_length, 1 - round(avg(e::INT), 6) AS clipped_ratio, coalesce(round(avg(n) FILTER (e), 6), 0) AS mean_terminated,
coalesce(min(n) FILTER (e), 0)::DOUBLE AS min_terminated, coalesce(max(n) FILTER (e), 0)::DOUBLE AS max_terminated FROM c""",
    "generation_jobs": f"""WITH a AS (SELECT row_id, uid, coalesce(nullif(target_ins, ''), nullif(uid, '')) AS prompt FROM train_cid2ins WHERE row_id % 3 <> 1 AND row_id % 5 <> 0)
SELECT row_id, coalesce(nullif({TRIM.format('uid')}, ''), 'sample_' || lpad(row_id::VARCHAR, greatest(5, length(row_id::VARCHAR))::INT, '0')) AS job, prompt FROM a WHERE nullif({TRIM.format('prompt')}, '') IS NOT NULL""",
    "timeout_aborts": """WITH a AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM events),
b AS (SELECT *, sum(f::INT) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id) AS run FROM a) SELECT event_id, user_id FROM b WHERE run = 2 AND f""",
    "failure_cooldown": """WITH a AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')
SELECT event_id, recent, recent >= 3 AS tripped, coalesce(bool_or(recent >= 3) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), false) AS cooling FROM a""",
    "metrics_by_scope": _RANK
    + f""", k AS (SELECT DISTINCT {TRIM.format('sid')} AS sid FROM pid2cid2tid WHERE sid IS NOT NULL), z AS (SELECT p.*, k.sid IS NOT NULL AS in_catalog FROM p LEFT JOIN k ON k.sid = p.g)
"""
    + """SELECT source_dataset, in_catalog, count(*) AS total, count(*) FILTER (p1) AS top1_parsed, round(avg(p1::INT), 6) AS top1_parse_rate, count(*) AS any_parsed, 1.0::DOUBLE AS any_parse_rate,
count(*) FILTER (c1 IS NOT DISTINCT FROM g) AS exact_matches, round(avg((c1 IS NOT DISTINCT FROM g)::INT), 6) AS exact_accuracy, coalesce(round(count(*) FILTER (c1 IS NOT DISTINCT FROM g) / nullif(count(*) FILTER (p1), 0), 6), 0) AS exact_on_parsed, """
    + ", ".join(f"round(avg({_at(k)}::INT), 6) AS recall_{k}, count(*) FILTER ({_at(k)}) AS hits_{k}, round(avg(CASE WHEN {_at(k)} THEN 1 / log2(list_position(u, g) + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (1, 5))
    + " FROM z GROUP BY source_dataset, in_catalog",
}
QUERIES = {k: globals()[k] for k in SQL}
