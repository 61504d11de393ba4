"""Text clean-up, tolerant JSON, rewards, resume logs, windows and external maps."""

from pyspark.sql import functions as F

from ..functions import coerce, ids, jsonx, scoring, text
from ..operators import external, joins, rewards, sequence
from .base import CODE_RX, TRIM, t


def _ins(spark, d):
    return t(spark, d, "train_cid2ins")


def history_format(spark, d):
    h = F.array(coerce.clean_values(F.col("target_tid")), F.slice(coerce.clean_values(F.col("target_tid")), 1, 1))
    return _ins(spark, d).select("row_id", coerce.format_history(h).alias("history"))


def alias_coalesce(spark, d):
    return _ins(spark, d).select("row_id", coerce.first_filled(F.col("reasoning"), F.col("target_ins")).alias("value"))


def term_clean(spark, d):
    terms = t(spark, d, "pid2cid2tid").select(F.explode("tid").alias("raw")).filter("raw IS NOT NULL").distinct()
    c = text.clean_term(F.col("raw"))
    return terms.select("raw", c.alias("term"), ids.is_english_term(c).alias("english"))


def caption_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(text.caption_terms(F.col("text")), "|").alias("terms"))


def output_terms(spark, d):
    said = F.concat(F.lit('Here: {"terms": ['), F.array_join(F.transform(coerce.clean_values(F.col("target_tid")), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]} done"))
    return _ins(spark, d).select("row_id", F.array_join(text.output_terms(said), "|").alias("terms"))


def reasoning_trim(spark, d):
    return _ins(spark, d).filter("reasoning IS NOT NULL").select("row_id", text.trim_reasoning(F.col("reasoning")).alias("short"))


def text_preview(spark, d):
    return _ins(spark, d).select("row_id", text.preview(F.col("target_ins"), 40).alias("preview"), text.safe_name(F.col("source_dataset")).alias("name"))


def think_segments(spark, d):
    c = _completions(spark, d).select("row_id", jsonx.segments_col(F.col("text")).alias("s"))
    return c.select("row_id", "s.thought", "s.answer")


def tid_coverage(spark, d):
    return _ins(spark, d).select("row_id", F.round(scoring.coverage(F.col("target_tid"), F.col("target_ins")), 6).alias("coverage"))


def cid_layer_reward(spark, d):
    v = t(spark, d, "valid_cid2cid").select("row_id", coerce.pytrim(F.element_at(F.array_compact("hist_sid"), -1)).alias("pred"), coerce.pytrim(F.col("target_sid")).alias("gold"), F.size("hist_sid").alias("n"))
    v = v.filter("n > 0")
    known = t(spark, d, "pid2cid2tid").select(coerce.pytrim(F.col("sid")).alias("sid")).filter(ids.is_code(F.col("sid")))
    v = joins.with_membership(v, "pred", known, "sid", "known")
    base = scoring.layer_reward(F.col("pred"), F.col("gold"))
    return v.select("row_id", F.round(base, 4).alias("base"), F.round(scoring.in_range_reward(base, F.col("known")), 4).alias("reward"))


def target_leak_penalty(spark, d):
    s = [(F.col("row_id") % m).cast("double") for m in (11, 7, 10, 9)]
    leak = F.size(text.target_hits(F.col("target_ins"), F.col("target_tid"))) > 0
    return _ins(spark, d).select("row_id", leak.alias("leak"), scoring.leak_penalised(leak, *s).alias("overall"))


def heuristic_judge(spark, d):
    j = scoring.heuristic_judge(coerce.string_list(F.col("target_tid")), coerce.clean_values(F.col("target_tid")), F.col("target_ins"))
    return _ins(spark, d).select("row_id", *[c.alias(k) for k, c in j.items()])


def _completions(spark, d):
    """Answers as a model would give them, some with a thought, a fence, doubles or a cut, by the row's id."""
    body = F.to_json(F.struct(F.coalesce("target_tid", F.array().cast("array<string>")).alias("target_tid"), F.coalesce("target_ins", F.lit("")).alias("target_ins")))
    k = F.col("row_id") % 6
    think = F.concat(F.lit("<think>"), F.coalesce("reasoning", F.lit("")), F.lit("</think>"))
    said = (
        F.when(k == 0, F.concat(think, body)).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(body, F.lit(" and "), body))
        .when(k == 3, F.left(body, F.length(body) - 3)).when(k == 4, F.concat(F.lit("Sure: "), body, F.lit(" bye"))).otherwise(body)
    )
    return _ins(spark, d).select("row_id", said.alias("text"))


def think_reward(spark, d):
    return _completions(spark, d).select("row_id", scoring.think_reward(F.col("text")).alias("reward"))


def json_recover(spark, d):
    r = _completions(spark, d).select("row_id", jsonx.recovered_col(F.col("text")).alias("r"))
    return r.select("row_id", F.col("r.json").alias("json"), F.col("r.error").alias("error"))


def last_balanced_json(spark, d):
    return _completions(spark, d).select("row_id", jsonx.last_object_col(F.col("text")).alias("json"))


def truncate_json(spark, d):
    return _completions(spark, d).select("row_id", jsonx.cut_to_object_col(F.col("text")).alias("text"))


def json_payload(spark, d):
    return _completions(spark, d).select("row_id", jsonx.payload_col(F.col("text")).alias("json"))


def format_penalty(spark, d):
    r = _completions(spark, d).select("row_id", jsonx.form_col(F.col("text")).alias("r"))
    return r.select("row_id", "r.penalty", F.array_join("r.violations", "|").alias("violations"), "r.objects")


def first_json_value(spark, d):
    return _completions(spark, d).select("row_id", jsonx.first_value_col(F.col("text")).alias("json"))


def canonical_answer(spark, d):
    return _completions(spark, d).select("row_id", jsonx.canonical_answer_col(F.col("text"), F.lit("cid2ins")).alias("answer"))


def parse_diagnosis(spark, d):
    r = _completions(spark, d).select("row_id", jsonx.diagnosis_col(F.col("text")).alias("r"))
    many = lambda c: F.array_join(f"r.{c}", "|").alias(c)
    return r.select("row_id", "r.n_chars", many("parsed_fields"), many("recovered_fields"), many("keys"), "r.opened", "r.closed", "r.thoughts", "r.objects", "r.repeats")


def named_candidates(spark, d):
    """Two candidates of a row, the second one without reasoning in every fifth row, in a fence in every third."""
    one = F.struct(F.coalesce("target_ins", F.lit("")).alias("prompt"), F.coalesce("reasoning", F.lit("none given")).alias("reasoning"))
    two = F.struct(F.lit(" draw it ").alias("prompt"), F.when(F.col("row_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("as said")).alias("reasoning"))
    body = F.to_json(F.struct(one.alias("calm"), two.alias("bold")))
    said = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    r = _ins(spark, d).select("row_id", jsonx.named_candidates_col(said, ("calm", "bold")).alias("r"))
    return r.select("row_id", "r.json", "r.error")


def total_rewards(spark, d):
    """Rewards of answers to both tasks, their parts told apart."""
    ins = _completions(spark, d).join(_ins(spark, d).select("row_id", "target_tid"), "row_id")
    ins = ins.select("row_id", F.lit("cid2ins").alias("task"), "text", F.lit(None).cast("string").alias("gold_cid"), coerce.string_list(F.col("target_tid")).alias("gold_tid"))
    v = t(spark, d, "valid_cid2cid").select("row_id", "target_sid", F.element_at(F.array_compact("hist_sid"), -1).alias("last"), F.size("hist_sid").alias("n")).filter("n > 0")
    guess = F.when(F.col("row_id") % 2 == 0, F.col("target_sid")).otherwise(F.col("last"))
    said = F.concat(F.lit("<think>A look at the history tells it.</think>"), F.to_json(F.struct(F.coalesce(guess, F.lit("")).alias("target_cid"))))
    cid = v.select("row_id", F.lit("cid2cid").alias("task"), said.alias("text"), coerce.pytrim(F.col("target_sid")).alias("gold_cid"), F.array().cast("array<string>").alias("gold_tid"))
    known = t(spark, d, "pid2cid2tid").select(coerce.pytrim(F.col("sid")).alias("sid")).filter(ids.is_code(F.col("sid")))
    r = rewards.answer_rewards(ins.unionByName(cid), known, "sid")
    return r.select("row_id", "task", *[F.round(c, 6).alias(c) for c in ("main", "think", "fmt", "penalty", "reward")])


def sliding_failures(spark, d):
    e = t(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return sequence.recent_count(e, ["user_id"], "ts", 60 * 24).select("event_id", "recent")


def failure_windows(spark, d):
    from ..streaming.runs import failure_windows as windows

    e = t(spark, d, "events").filter("event_type = 'error'")
    return windows(e, "ts", ["event_type"], "2 hours", "1 hour", "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def timeout_runs(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return sequence.run_lengths(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "run")


def checkpoint_latest_wins(spark, d):
    log = t(spark, d, "pid2cid2tid").filter("pid IS NOT NULL").select("pid", "row_id", "sid", "ingest_ts")
    return joins.latest(log, ["pid"], F.struct("ingest_ts", "row_id")).select("pid", "row_id", "sid")


def rank_merge(spark, d):
    from ..sources.sinks import merged_ranks

    p = [t(spark, d, f"{s}_cid2cid").select(F.col("row_id").alias("row_idx"), F.lit(s).alias("split"), "uid") for s in ("valid", "test")]
    return merged_ranks(p)


def external_ask(spark, d):
    r = t(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("no source")).alias("prompt"))
    return external.ask(r, "prompt").select("doc_id", "answer", F.col("error").isNull().alias("ok"))


_CV = r"coalesce(list_filter(list_transform(target_tid, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''), [])"
_TC = r"""regexp_replace(trim(regexp_replace({}, '^\s+|\s+$', '', 'g'), '[]{{}}()"''`'), '\s+', ' ', 'g')"""
_CT = "trim(" + _TC + ", ' ,;|')"
_EN = r"(regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9\s&+/\-,''().]*') AND regexp_matches({0}, '[A-Za-z]'))"
_BODY = "'{\"target_tid\":' || to_json(coalesce(target_tid, [])) || ',\"target_ins\":' || to_json(coalesce(target_ins, '')) || '}'"
_COMP = f"""WITH b AS (SELECT row_id, {_BODY} AS body, '<think>' || coalesce(reasoning, '') || '</think>' AS th FROM train_cid2ins),
c AS (SELECT row_id, CASE row_id % 6 WHEN 0 THEN th || body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN body || ' and ' || body WHEN 3 THEN left(body, length(body) - 3) WHEN 4 THEN 'Sure: ' || body || ' bye' ELSE body END AS text FROM b)
"""
_ANS = (
    _COMP.rstrip()
    + rf""", a AS (SELECT c.row_id, c.row_id % 6 AS k, c.text, {_BODY} AS body, coalesce(t.target_tid, []) AS tid, coalesce(t.target_ins, '') AS ins, coalesce(t.reasoning, '') AS r,
 {TRIM.format("coalesce(t.target_ins, '')")} AS insc, {_CV} AS tidc, list_filter(coalesce(t.target_tid, []), lambda x: x IS NOT NULL AND x <> '') AS tids,
 CASE WHEN length(rl) >= 10 AND NOT contains(rl, 'target_tid') AND NOT contains(rl, 'target_ins') THEN rl ELSE '' END AS rel
 FROM c JOIN (SELECT *, {TRIM.format("regexp_extract(substr(to_json(coalesce(target_ins, ''))::VARCHAR, 2, greatest(length(to_json(coalesce(target_ins, ''))::VARCHAR) - 3, 0)), '^((?:[^" + chr(34) + "\\\\]|\\\\.)*)', 1)")} AS rl FROM train_cid2ins) t USING (row_id))
"""
)
_COV = "CASE WHEN len({t}) = 0 OR s = '' THEN 0.0 ELSE len(list_filter({t}, lambda x: contains(s, x)))::DOUBLE / len({t}) END"
_FOLD = "coalesce(list_filter(list_transform({}, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> ''), [])"
_SCORE = "(0.35 * {c} + 0.2 * n + 0.25 * a + 0.2 * {e} - CASE WHEN {c} < 5 OR {e} < 5 THEN 1.0 ELSE 0.0 END)"


def _layer(n):
    rx = rf"<s_{n}_(\d+)>"
    return f"nullif(regexp_extract(pred, '{rx}', 1), '') IS NOT DISTINCT FROM nullif(regexp_extract(gold, '{rx}', 1), '')"


SQL = {
    "history_format": f"WITH a AS (SELECT row_id, {_CV} AS c FROM train_cid2ins) SELECT row_id, '1. ' || coalesce(array_to_string(c, ', '), '') || chr(10) || '2. ' || coalesce(array_to_string(c[1:1], ', '), '') AS history FROM a",
    "alias_coalesce": f"SELECT row_id, coalesce(nullif({TRIM.format('reasoning')}, ''), nullif({TRIM.format('target_ins')}, '')) AS value FROM train_cid2ins",
    "term_clean": f"WITH a AS (SELECT DISTINCT raw FROM (SELECT unnest(tid) AS raw FROM pid2cid2tid) WHERE raw IS NOT NULL), b AS (SELECT raw, {_CT.format('raw')} AS term FROM a) SELECT raw, term, {_EN.format('term')} AS english FROM b",
    "text_preview": r"""WITH a AS (SELECT row_id, trim(regexp_replace(target_ins, '\s+', ' ', 'g')) AS s, source_dataset FROM train_cid2ins)
SELECT row_id, CASE WHEN length(s) > 40 THEN left(s, 40) || '...<truncated>' ELSE s END AS preview, trim(regexp_replace(regexp_replace(source_dataset, '[^0-9A-Za-z_\-]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM a""",
    "tid_coverage": f"WITH a AS (SELECT row_id, {_FOLD.format('target_tid')} AS tt, lower(coalesce(target_ins, '')) AS s FROM train_cid2ins) SELECT row_id, round({_COV.format(t='tt')}, 6) AS coverage FROM a",
    "cid_layer_reward": f"""WITH v AS (SELECT row_id, {TRIM.format("list_filter(hist_sid, lambda x: x IS NOT NULL)[-1]")} AS pred, {TRIM.format('target_sid')} AS gold FROM valid_cid2cid WHERE len(hist_sid) > 0),
k AS (SELECT DISTINCT {TRIM.format('sid')} AS sid FROM pid2cid2tid WHERE regexp_full_match({TRIM.format('sid')}, '{CODE_RX}')),
r AS (SELECT row_id, pred IN (SELECT sid FROM k) AS known, CASE WHEN regexp_matches(pred, '<s_[abc]_[0-9]+>') AND regexp_matches(gold, '<s_[abc]_[0-9]+>') THEN
 (CASE WHEN {_layer('a')} THEN 0.5 ELSE 0 END) + (CASE WHEN {_layer('b')} THEN 0.3 ELSE 0 END) + (CASE WHEN {_layer('c')} THEN 0.2 ELSE 0 END) ELSE 0 END::DOUBLE AS base FROM v)
SELECT row_id, round(base, 4) AS base, round(CASE WHEN base > 0 THEN base WHEN known THEN 0.15 ELSE 0 END::DOUBLE, 4) AS reward FROM r""",
    "target_leak_penalty": f"""WITH a AS (SELECT row_id, (row_id % 11)::DOUBLE AS c, (row_id % 7)::DOUBLE AS n, (row_id % 10)::DOUBLE AS a, (row_id % 9)::DOUBLE AS e,
 len(coalesce(list_filter(target_tid, lambda x: length(x) >= 2 AND contains(lower(coalesce(target_ins, '')), lower(x))), [])) > 0 AS leak FROM train_cid2ins),
b AS (SELECT *, greatest(0, c - 2.5) AS c2, greatest(0, e - 2.0) AS e2 FROM a)
SELECT row_id, leak, CASE WHEN leak THEN round(round({_SCORE.format(c='c2', e='e2')}, 4) - 0.5, 4) ELSE round({_SCORE.format(c='c', e='e')}, 4) END AS overall FROM b""",
    "heuristic_judge": rf"""WITH a AS (SELECT row_id, trim(coalesce(target_ins, '')) AS x, {_FOLD.format('target_tid')} AS p, {_FOLD.format(_CV)} AS g FROM train_cid2ins),
b AS (SELECT *, lower(x) AS s, list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '') AS w FROM a),
c AS (SELECT *, {_COV.format(t='p')} AS cp, {_COV.format(t='g')} AS cg, least(len(w) / 25.0, 1.0) AS sp, list_distinct(p) AS pd, list_distinct(g) AS gd FROM b)
SELECT row_id, round(CASE WHEN x = '' THEN 0 WHEN regexp_matches(s, 'feel|feeling|emotion|mood|inner|soul|dream|memory|longing') THEN sp ELSE least(1.0, sp + 0.15) END::DOUBLE, 4) AS specificity,
round(CASE WHEN x = '' THEN 0 WHEN len(list_distinct(list_transform(w, lambda y: lower(y)))) >= 8 THEN 0.6 ELSE 0.4 END::DOUBLE, 4) AS creativity,
round(CASE WHEN x = '' THEN 0 ELSE least(greatest(length(x) / 160.0, 0.3), 0.9) END::DOUBLE, 4) AS content_quality, round(CASE WHEN x = '' THEN 0 ELSE greatest(cg, cp) END::DOUBLE, 4) AS visual_generatability,
round(cg, 4) AS ins_vs_gt_tid, round(cp, 4) AS ins_vs_pred_tid, round(CASE WHEN len(pd) = 0 OR len(gd) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(pd, gd)) / (len(pd) + len(gd)) END::DOUBLE, 4) AS pred_tid_vs_gt_tid FROM c""",
    "think_reward": _COMP + r"SELECT row_id, CASE WHEN contains(text, '<think>') AND contains(text, '</think>') AND length(regexp_replace(regexp_extract(text, '(?s)<think>(.*?)</think>', 1), '\s+', '', 'g')) > 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM c",
    "think_segments": _ANS + "SELECT row_id, CASE k WHEN 0 THEN " + TRIM.format("r") + " WHEN 3 THEN text WHEN 4 THEN 'Sure:' ELSE '' END AS thought, CASE k WHEN 2 THEN text WHEN 3 THEN '' WHEN 4 THEN body || ' bye' ELSE body END AS answer FROM a",
    "json_recover": _ANS + """SELECT row_id, CASE WHEN k <> 3 THEN '{"target_ins":' || to_json(ins) || ',"target_tid":' || to_json(tid) || '}'
 WHEN len(tids) > 0 AND rel <> '' THEN '{"target_ins":' || to_json(rel) || ',"target_tid":' || to_json(tids) || '}' WHEN len(tids) > 0 THEN '{"target_tid":' || to_json(tids) || '}'
 WHEN rel <> '' THEN '{"target_ins":' || to_json(rel) || '}' END AS json,
CASE WHEN k = 3 AND len(tids) = 0 AND rel = '' THEN 'no object or field' WHEN len(tids) = 0 THEN 'missing target_tid' WHEN (k <> 3 AND insc = '') OR (k = 3 AND rel = '') THEN 'missing target_ins' END AS error FROM a""",
    # braces count wherever they stand, so an empty pair in the instruction is the last object
    "last_balanced_json": _ANS + r"SELECT row_id, CASE WHEN k <> 3 AND regexp_matches(ins, '\{\s*\}') THEN '{}' WHEN k <> 3 THEN body END AS json FROM a",
    "truncate_json": _ANS + "SELECT row_id, CASE WHEN k <> 3 THEN body ELSE text END AS text FROM a",
    "json_payload": _ANS + "SELECT row_id, CASE k WHEN 2 THEN NULL WHEN 3 THEN to_json(tid)::VARCHAR ELSE body END AS json FROM a",
    "first_json_value": _ANS + "SELECT row_id, CASE k WHEN 3 THEN to_json(tid)::VARCHAR ELSE body END AS json FROM a",
    "format_penalty": _ANS
    + """SELECT row_id, CASE k WHEN 2 THEN 0.85 WHEN 3 THEN 0.2 WHEN 4 THEN 0.65 ELSE 0.0 END::DOUBLE AS penalty,
CASE k WHEN 2 THEN 'text_after_json|multiple_json_objects|repeated_target_keys' WHEN 3 THEN 'text_before_json' WHEN 4 THEN 'text_before_json|text_after_json' ELSE '' END AS violations,
CASE k WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END::INT AS objects FROM a""",
    "canonical_answer": _ANS
    + """, b2 AS (SELECT *, CASE k WHEN 0 THEN """ + TRIM.format("r") + """ WHEN 3 THEN text WHEN 4 THEN 'Sure:' ELSE '' END AS th, CASE k WHEN 2 THEN text WHEN 3 THEN '' WHEN 4 THEN body || ' bye' ELSE body END AS an,
 CASE WHEN k = 3 THEN '' ELSE insc END AS i2 FROM a), c2 AS (SELECT *, CASE WHEN len(tidc) > 0 AND i2 <> '' THEN '{"target_tid":' || to_json(tidc) || ',"target_ins":' || to_json(i2) || '}'
 WHEN len(tidc) > 0 THEN '{"target_tid":' || to_json(tidc) || '}' WHEN i2 <> '' THEN '{"target_ins":' || to_json(i2) || '}' ELSE an END AS res FROM b2)
SELECT row_id, CASE WHEN th <> '' THEN '<think>' || chr(10) || th || chr(10) || '</think>' || CASE WHEN res <> '' THEN chr(10) || res ELSE '' END ELSE res END AS answer FROM c2""",
    "parse_diagnosis": _ANS
    + """SELECT row_id, length(text)::INT AS n_chars, CASE WHEN k <> 3 THEN 'target_ins|target_tid' WHEN len(tid) > 0 THEN 'target_tid' ELSE '' END AS parsed_fields,
CASE WHEN k <> 3 AND insc <> '' AND len(tid) > 0 THEN 'target_ins|target_tid' WHEN k <> 3 AND insc <> '' THEN 'target_ins' WHEN len(tid) > 0 THEN 'target_tid' ELSE '' END AS recovered_fields,
CASE WHEN k = 3 AND ins = '' THEN 'target_tid|target_ins' ELSE 'target_tid|target_ins' END AS keys, (k = 0)::INT AS opened, (k = 0)::INT AS closed, (k = 0)::INT AS thoughts,
CASE k WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END::INT AS objects, CASE k WHEN 2 THEN 2 ELSE 0 END::INT AS repeats FROM a""",
    "named_candidates": rf"""WITH a AS (SELECT row_id, {TRIM.format("coalesce(target_ins, '')")} AS p, {TRIM.format("coalesce(reasoning, 'none given')")} AS r FROM train_cid2ins),
b AS (SELECT *, CASE WHEN p = '' THEN 'empty prompt of calm' WHEN r = '' THEN 'empty reasoning of calm' WHEN row_id % 5 = 0 THEN 'empty reasoning of bold' END AS error FROM a)
SELECT row_id, CASE WHEN error IS NULL THEN '{{"calm":{{"prompt":' || to_json(p) || ',"reasoning":' || to_json(r) || '}},"bold":{{"prompt":"draw it","reasoning":"as said"}}}}' END AS json, error FROM b""",
    "caption_terms": rf"""WITH a AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[，,。.;；:：/|()\[\]
]+'), lambda x: {_CT.format('x')}), lambda x: x <> '' AND length(x) <= 40 AND {_EN.format('x')}) AS c FROM documents),
b AS (SELECT doc_id, c, list_transform(c, lambda y: lower(y)) AS l FROM a)
SELECT doc_id, coalesce(array_to_string(list_filter(c, lambda x, i: list_position(l, lower(x)) = i)[1:10], '|'), '') AS terms FROM b""",
    "output_terms": rf"""WITH s AS (SELECT row_id, regexp_extract('Here: {{"terms": [' || coalesce(array_to_string(list_transform({_CV}, lambda x: '"' || x || '"'), ', '), '') || ']}} done', '(?s)\{{.*"terms"\s*:\s*\[(.*?)\].*\}}', 1) AS n FROM train_cid2ins),
a AS (SELECT row_id, CASE WHEN n = '' THEN [] ELSE list_filter(list_transform(regexp_split_to_array(replace(n, chr(10), ' '), '\s*,\s*'), lambda x: {_CT.format('x')}), lambda x: x <> '' AND {_EN.format('x')}) END AS c FROM s),
b AS (SELECT row_id, c, list_transform(c, lambda y: lower(y)) AS l FROM a)
SELECT row_id, coalesce(array_to_string(list_filter(c, lambda x, i: list_position(l, lower(x)) = i)[1:10], '|'), '') AS terms FROM b""",
    "reasoning_trim": r"""WITH a AS (SELECT row_id, trim(regexp_replace(reasoning, '\s+', ' ', 'g')) AS s FROM train_cid2ins WHERE reasoning IS NOT NULL), b AS (SELECT *, rtrim(left(s, 200)) AS c FROM a),
x AS (SELECT *, """ + ", ".join(f"CASE WHEN contains(c, '{x}') THEN length(c) - position('{x[::-1]}' IN reverse(c)) - {len(x)} + 1 ELSE -1 END AS d{i}" for i, x in enumerate(text.CUTS)) + r""" FROM b)
SELECT row_id, CASE WHEN length(s) <= 200 THEN s """ + " ".join(f"WHEN d{i} >= 140 THEN rtrim(left(c, d{i} + 1))" for i in range(len(text.CUTS))) + r""" ELSE regexp_replace(c, '[ ,;，；。]+$', '') || '...' END AS short FROM x""",
    "sliding_failures": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'",
    "failure_windows": """WITH e AS (SELECT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error'), w AS (SELECT h AS window_start FROM e UNION ALL SELECT h - INTERVAL 1 HOUR FROM e)
SELECT window_start, 'error' AS event_type, count(*) AS n FROM w GROUP BY 1""",
    "timeout_runs": """WITH a AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM events)
SELECT event_id, (sum(f::INT) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id))::BIGINT AS run FROM a""",
    "checkpoint_latest_wins": "SELECT pid, row_id, sid FROM pid2cid2tid WHERE pid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pid ORDER BY ingest_ts DESC, row_id DESC) = 1",
    "rank_merge": "SELECT row_id AS row_idx, 'valid' AS split, uid FROM valid_cid2cid UNION ALL SELECT row_id, 'test', uid FROM test_cid2cid",
    "external_ask": "SELECT doc_id, array_to_string(list_reverse(string_split(coalesce(source, 'no source'), ' ')), ' ') AS answer, true AS ok FROM documents",
}
QUERIES = {k: globals()[k] for k in (*SQL, "total_rewards")}
