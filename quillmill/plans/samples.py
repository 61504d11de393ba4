"""Chat samples, task unions, splits, shards, limits, seeds and packing."""

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import aggregates, builders, limits, sequence
from .base import t


def _parts(spark, d):
    cat, c2c, ins = t(spark, d, "pid2cid2tid"), t(spark, d, "train_cid2cid"), t(spark, d, "train_cid2ins")
    return [
        ("cid2tid", cat.select("row_id", builders.cid2tid(F.col("sid"), F.col("tid")).alias("messages"))),
        ("tid2cid", cat.select("row_id", builders.tid2cid(F.col("sid"), F.col("tid")).alias("messages"))),
        ("cid2cid", c2c.select("row_id", builders.cid2cid(F.col("hist_sid"), F.col("target_sid"), F.col("reasoning")).alias("messages"))),
        ("cid2ins", ins.select("row_id", builders.cid2ins(F.col("hist_sid"), F.col("target_tid"), F.col("target_ins"), F.col("reasoning")).alias("messages"))),
    ]


def sft_union_all(spark, d):
    u = builders.union_samples(_parts(spark, d))
    return u.select("task_ord", "task", "row_id", F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"))


def tid2tid_samples(spark, d):
    ins = t(spark, d, "train_cid2ins").select("row_id", F.array("target_tid").alias("h"), "target_tid", "reasoning")
    m = ins.select("row_id", builders.tid2tid(F.col("h"), F.col("target_tid"), F.col("reasoning")).alias("m")).filter("m IS NOT NULL")
    return m.select("row_id", F.col("m")[2]["content"].alias("assistant"))


def dropped_counts(spark, d):
    rows = None
    for name, p in _parts(spark, d):
        p = p.select(F.lit(name).alias("task"), F.col("messages").isNotNull().alias("ok"))
        rows = p if rows is None else rows.unionByName(p)
    return aggregates.kept_and_dropped(rows, ["task"], F.col("ok"))


def rl_rows(spark, d):
    a, b = t(spark, d, "valid_cid2cid"), t(spark, d, "train_cid2ins")
    n = F.lit(None).cast("string")
    x = a.select("row_id", *builders.rl_row("cid2cid", "valid", F.col("uid"), F.col("hist_sid"), F.col("target_sid"), F.lit(None).cast("array<string>"), n))
    y = b.select("row_id", *builders.rl_row("cid2ins", "train", F.col("uid"), F.col("hist_sid"), n, F.col("target_tid"), F.col("target_ins")))
    u = x.unionByName(y)
    return u.select("row_id", F.col("prompt")[1]["content"].alias("prompt"), "task", "split", "uid", F.size("hist_cid").alias("n_hist"), "gold_target_cid", F.array_join("gold_target_tid", "|").alias("gold_target_tid"), "gold_target_ins")


def packing_next_fit(spark, d):
    docs = t(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n_words"))
    return sequence.next_fit(docs, "source", "doc_id", "n_words", 2048)


def pad_collate(spark, d):
    """Lists of term lengths, padded to the longest list of the table."""
    lens = t(spark, d, "train_cid2ins").select("row_id", F.transform(coerce.string_list(F.col("target_tid")), lambda x: F.length(x)).alias("a"))
    width = lens.agg(F.max(F.size("a"))).first()[0] or 0
    p = lens.select("row_id", sequence.padded(F.col("a"), width, 0).alias("ids"), sequence.padded(F.transform("a", lambda x: F.lit(1)), width, 0).alias("mask"))
    return p.select("row_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("n"))


def round_robin_shards(spark, d):
    return t(spark, d, "train_cid2cid").groupBy(limits.shard(F.col("row_id"), 7).alias("shard")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def fixed_chunks(spark, d):
    return t(spark, d, "events").groupBy(limits.chunk(F.col("event_id"), 50).alias("chunk")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def limit_before_vs_after_filter(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type")
    ok = F.col("event_type") == "click"
    a = limits.limit_before(e, "event_id", 100, ok).withColumn("kind", F.lit("before"))
    b = limits.limit_after(e, "event_id", 100, ok).withColumn("kind", F.lit("after"))
    return a.unionByName(b)


def uid_seed(spark, d):
    return t(spark, d, "train_cid2ins").select("row_id", limits.text_seed(F.col("uid")).alias("seed"))


def history_tail(spark, d):
    return t(spark, d, "valid_cid2cid").filter("hist_sid IS NOT NULL").select("row_id", F.array_join(sequence.tail(coerce.string_list(F.col("hist_sid")), 3), " ").alias("last3"))


def elite_mate_top2(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "value")
    return sequence.top_by(e, ["user_id"], 2, F.desc("value"), F.asc("event_id"))


_L = "coalesce(list_filter({}, lambda x: x IS NOT NULL), [])"
_J = "to_json(" + _L + ")"
_TH = r"CASE WHEN coalesce(regexp_replace(reasoning, '^\s+|\s+$', '', 'g'), '') = '' THEN '' ELSE '<think>' || chr(10) || regexp_replace(reasoning, '^\s+|\s+$', '', 'g') || chr(10) || '</think>' || chr(10) || chr(10) END"
_S = f"""WITH u AS (
SELECT 0 AS task_ord, 'cid2tid' AS task, row_id, 'Task: Map the given cid to the corresponding tid.' || chr(10) || 'cid: ' || sid || chr(10) || 'Output JSON only.' AS "user",
  '{{"target_tid":' || {_J.format('tid')} || '}}' AS assistant, sid IS NOT NULL AND len({_L.format('tid')}) > 0 AS ok FROM pid2cid2tid
UNION ALL SELECT 1, 'tid2cid', row_id, 'Task: Map the given tid to the corresponding cid.' || chr(10) || 'tid: ' || {_J.format('tid')} || chr(10) || 'Output JSON only.',
  '{{"target_cid":' || to_json(sid) || '}}', sid IS NOT NULL AND len({_L.format('tid')}) > 0 FROM pid2cid2tid
UNION ALL SELECT 2, 'cid2cid', row_id, 'Task: Predict the target_cid based on the user''s historical interactions in hist_cid.' || chr(10) || 'hist_cid: ' || {_J.format('hist_sid')} || chr(10) || 'Think first, then output JSON only.',
  {_TH} || '{{"target_cid":' || to_json(target_sid) || '}}', target_sid IS NOT NULL AND len({_L.format('hist_sid')}) > 0 FROM train_cid2cid
UNION ALL SELECT 3, 'cid2ins', row_id, 'Task: Generate the target recommendation result based on the user''s historical interactions in hist_cid.' || chr(10) || 'The output must be JSON with the fields target_tid and target_ins.' || chr(10) || 'hist_cid: ' || {_J.format('hist_sid')},
  {_TH} || '{{"target_tid":' || {_J.format('target_tid')} || ',"target_ins":' || to_json(target_ins) || '}}', coalesce(target_ins, '') <> '' AND len({_L.format('hist_sid')}) > 0 AND len({_L.format('target_tid')}) > 0 FROM train_cid2ins)
"""
SQL = {
    "sft_union_all": _S + 'SELECT task_ord, task, row_id, "user", assistant FROM u WHERE ok',
    "dropped_counts": _S + "SELECT task, count(*) AS rows_in, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM u GROUP BY task",
    "tid2tid_samples": f"SELECT row_id, {_TH} || '{{\"target_tid\":' || {_J.format('target_tid')} || '}}' AS assistant FROM train_cid2ins WHERE target_tid IS NOT NULL AND len({_L.format('target_tid')}) > 0",
    "rl_rows": r"""SELECT row_id, 'Task: Predict the target_cid based on the user''s historical interactions in hist_cid.' || chr(10) || 'hist_cid: ' || coalesce(to_json(hist_sid)::VARCHAR, '[]') || chr(10) || 'Think first, then output JSON only.' AS prompt, 'cid2cid' AS task, 'valid' AS split, coalesce(uid, '') AS uid, coalesce(len(hist_sid), 0)::INT AS n_hist, coalesce(target_sid, '') AS gold_target_cid, '' AS gold_target_tid, '' AS gold_target_ins FROM valid_cid2cid
UNION ALL SELECT row_id, 'Task: Generate the target recommendation result based on the user''s historical interactions in hist_cid.' || chr(10) || 'The output must be JSON with the fields target_tid and target_ins.' || chr(10) || 'hist_cid: ' || coalesce(to_json(hist_sid)::VARCHAR, '[]'), 'cid2ins', 'train', coalesce(uid, ''), coalesce(len(hist_sid), 0)::INT, '', coalesce(array_to_string(list_filter(target_tid, lambda x: x IS NOT NULL), '|'), ''), coalesce(target_ins, '') FROM train_cid2ins""",
    "packing_next_fit": """WITH RECURSIVE d AS (SELECT coalesce(source, '') AS source, doc_id, text FROM documents), p AS (SELECT source, doc_id, len(string_split(coalesce(text, ''), ' '))::INT AS n_words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM d
  WHERE len(string_split(coalesce(text, ''), ' ')) BETWEEN 1 AND 2048),
r AS (SELECT source, doc_id, n_words, k, 0 AS pack, n_words AS used FROM p WHERE k = 1
  UNION ALL SELECT p.source, p.doc_id, p.n_words, p.k, CASE WHEN r.used + p.n_words > 2048 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.used + p.n_words > 2048 THEN p.n_words ELSE r.used + p.n_words END
  FROM r JOIN p ON p.source = r.source AND p.k = r.k + 1)
SELECT source, doc_id, n_words, pack::INT AS pack FROM r""",
    "pad_collate": f"""WITH a AS (SELECT row_id, list_transform({_L.format('target_tid')}, lambda x: length(x)) AS a FROM train_cid2ins), w AS (SELECT max(len(a)) AS m FROM a)
SELECT row_id, array_to_string(list_concat(a, list_transform(range(0, m - len(a)), lambda x: 0)), ' ') AS ids, len(a)::INT AS n FROM a, w""",
    "round_robin_shards": "SELECT row_id % 7 AS shard, count(*) AS n, min(row_id) AS first_row FROM train_cid2cid GROUP BY 1",
    "fixed_chunks": "SELECT event_id // 50 AS chunk, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "limit_before_vs_after_filter": """SELECT event_id, event_type, 'before' AS kind FROM events WHERE event_id < 100 AND event_type = 'click'
UNION ALL SELECT * FROM (SELECT event_id, event_type, 'after' FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100)""",
    "uid_seed": "SELECT row_id, coalesce(list_sum(list_transform(string_split(uid, ''), lambda c: ord(c))), 0)::BIGINT % 100000 AS seed FROM train_cid2ins",
    "history_tail": f"WITH h AS (SELECT row_id, {_L.format('hist_sid')} AS h FROM valid_cid2cid WHERE hist_sid IS NOT NULL) SELECT row_id, coalesce(array_to_string(h[greatest(len(h) - 2, 1):], ' '), '') AS last3 FROM h",
    "elite_mate_top2": "SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id))::INT AS rank FROM events QUALIFY rank <= 2",
}
QUERIES = {k: globals()[k] for k in SQL}
