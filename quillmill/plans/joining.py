"""Lookups, membership, resume, vocabularies, catalogs, prefixes."""

from pyspark.sql import functions as F

from ..functions import coerce, ids
from ..operators import aggregates, joins, prefix
from .base import CODE_RX, TOKEN_RX, TRIM, t


def _catalog(spark, d):
    return t(spark, d, "pid2cid2tid")


def pid_lookup_join(spark, d):
    now = joins.latest(_catalog(spark, d).filter("pid IS NOT NULL").select("pid", "tid", "updated_ts", "row_id"), ["pid"], F.struct("updated_ts", "row_id"))
    docs = t(spark, d, "documents").select("doc_id", F.array_compact(F.array("pid")).alias("pids"))
    out = joins.lookup_array(docs, "doc_id", "pids", now, "pid", "tid", "tids")
    return out.select("doc_id", F.coalesce(F.array_join(F.get("tids", F.lit(0)), "|"), F.lit("")).alias("terms"))


def legal_cid_semi(spark, d):
    test = t(spark, d, "test_cid2cid").select("row_id", coerce.target_id(F.array("target_sid")).alias("code"))
    known = _catalog(spark, d).select(coerce.pytrim(F.col("sid")).alias("sid")).filter(ids.is_code(F.col("sid")))
    return joins.with_membership(test, "code", known, "sid", "legal").select("row_id", "legal")


def allow_list_semi(spark, d):
    return joins.allowed(t(spark, d, "train_cid2ins").select("row_id", "uid"), "uid", t(spark, d, "valid_cid2cid"))


def resume_anti(spark, d):
    return joins.not_done(t(spark, d, "train_cid2ins").select("row_id", "uid"), t(spark, d, "test_cid2cid"), ["uid"])


def _all_codes(spark, d):
    return t(spark, d, "train_cid2cid").select(F.explode("hist_sid").alias("code"))


def vocab_tokens(spark, d):
    return aggregates.code_token_counts(_all_codes(spark, d), "code", trimmed=True).orderBy(*ids.token_order(F.col("token")))


def vocab_missing_anti(spark, d):
    """Tokens of histories that no test target has."""
    own = aggregates.code_token_counts(_all_codes(spark, d), "code", trimmed=True).select("token")
    known = aggregates.code_token_counts(t(spark, d, "test_cid2cid"), "target_sid", trimmed=True)
    return joins.not_done(own, known, ["token"])


def code_validity(spark, d):
    return aggregates.code_validity(t(spark, d, "train_cid2cid").select(F.explode("hist_sid").alias("code")), "code")


def catalog_distinct(spark, d):
    return aggregates.codes_anywhere(_catalog(spark, d)).union(aggregates.codes_anywhere(t(spark, d, "valid_cid2cid"))).distinct()


def _legal(spark, d):
    return _catalog(spark, d).select(coerce.pytrim(F.col("sid")).alias("code")).filter(ids.is_code(F.col("code"))).distinct()


def prefix_table(spark, d):
    return prefix.prefix_table(_legal(spark, d).select(ids.code_tokens(F.col("code")).alias("tokens")), "tokens", '"}')


def allowed_next_tokens(spark, d):
    """Allowed continuations of each first layer found in test targets."""
    states = t(spark, d, "test_cid2cid").select("row_id", F.concat(F.lit("<|cid_begin|>"), F.regexp_extract("target_sid", r"<s_a_\d+>", 0)).alias("p")).filter("p IS NOT NULL")
    got = prefix.allowed_next(states, "p", prefix_table(spark, d))
    return got.select("row_id", F.array_join("allowed", " ").alias("allowed"))


def decode_groups(spark, d):
    states = t(spark, d, "test_cid2cid").select("row_id", F.concat(F.lit("<|cid_begin|>"), F.regexp_extract("target_sid", r"<s_a_\d+>", 0)).alias("p")).filter("p IS NOT NULL")
    return prefix.decode_groups(prefix.allowed_next(states, "p", prefix_table(spark, d)), "row_id").select(F.array_join("allowed", " ").alias("allowed"), "n", "first_key")


def prefix_continuations(spark, d):
    """Catalog codes that go on from the begin of a test target or of a broken history element; many have none."""
    test = t(spark, d, "test_cid2cid")
    seen = test.select(F.col("target_sid").alias("x")).unionByName(test.select(F.explode("hist_sid").alias("x"))).filter(F.length("x") >= 22)
    probes = seen.select(F.explode(F.array(F.left("x", F.lit(19)), F.left("x", F.lit(22)))).alias("probe"))
    return joins.continuations(_legal(spark, d), "code", probes, "probe", [19, 22])


def reattached_scores(spark, d):
    """Scores of history elements that came back as a flat list, some of them missing, back at their places."""
    r = t(spark, d, "valid_cid2cid").select("row_id", "hist_sid")
    flat = r.select("row_id", F.posexplode("hist_sid").alias("pos", "x")).filter("pos % 3 <> 1").select("row_id", "pos", (F.col("pos") * 10).alias("score"))
    return joins.reattached(r, "row_id", "hist_sid", flat, "score", "scores").select("row_id", F.array_join(F.transform("scores", lambda x: x.cast("string")), ",", "-").alias("scores"))


def constrained_next(spark, d):
    """Answers of different length to test records, with what may follow."""
    cut = F.col("row_id") % 90
    said = F.left(F.concat(F.lit('Say {"target_cid":"'), F.coalesce(coerce.pytrim(F.col("target_sid")), F.lit("")), F.lit('"}')), cut.cast("int"))
    got = prefix.constrained_next(t(spark, d, "test_cid2cid").select("row_id", said.alias("text")), "text", '{"target_cid":"', prefix_table(spark, d))
    return got.select("row_id", "phase", F.array_join("allowed", " ").alias("allowed"))


def dataset_counts(spark, d):
    return aggregates.counts_by(t(spark, d, "train_cid2cid"), "source_dataset")


def positional_zip(spark, d):
    items = t(spark, d, "events").select((F.col("event_id") - 0).alias("pos"), "event_type")
    return joins.zip_groups(items, "pos", "event_type", 4).select("grp", F.array_join("members", ",").alias("members"))


_LEGAL = f"SELECT DISTINCT {TRIM.format('sid')} AS code FROM pid2cid2tid WHERE regexp_full_match({TRIM.format('sid')}, '{CODE_RX}')"
_HIST = f"SELECT {TRIM.format('x')} AS code FROM (SELECT unnest(hist_sid) AS x FROM train_cid2cid) WHERE regexp_full_match({TRIM.format('x')}, '{CODE_RX}')"
_PT = f"""WITH c AS ({_LEGAL}), k AS (SELECT list_append(regexp_extract_all(code, '{TOKEN_RX}'), '"}}') AS tk FROM c),
pt AS (SELECT DISTINCT coalesce(array_to_string(tk[1:i - 1], ''), '') AS prefix, tk[i] AS next FROM (SELECT tk, unnest(range(1, len(tk) + 1)) AS i FROM k))
"""
_ST = r"""SELECT row_id, '<|cid_begin|>' || regexp_extract(target_sid, '<s_a_\d+>') AS p FROM test_cid2cid WHERE target_sid IS NOT NULL"""
_AL = f", st AS ({_ST}), al AS (SELECT prefix, array_to_string(list_sort(list(next)), ' ') AS allowed FROM pt GROUP BY prefix), sa AS (SELECT row_id, coalesce(allowed, '') AS allowed FROM st LEFT JOIN al ON prefix = p) "
SQL = {
    "pid_lookup_join": """WITH n AS (SELECT pid, tid FROM pid2cid2tid WHERE pid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pid ORDER BY updated_ts DESC NULLS LAST, row_id DESC) = 1)
SELECT doc_id, coalesce(array_to_string(list_filter(CASE WHEN d.pid IS NULL THEN NULL ELSE coalesce(n.tid, [d.pid]) END, lambda x: x IS NOT NULL), '|'), '') AS terms FROM documents d LEFT JOIN n ON n.pid = d.pid""",
    "legal_cid_semi": f"WITH c AS ({_LEGAL}) SELECT row_id, coalesce({TRIM.format('target_sid')} IN (SELECT code FROM c), false) AS legal FROM test_cid2cid",
    "allow_list_semi": "SELECT row_id, uid FROM train_cid2ins WHERE uid IN (SELECT uid FROM valid_cid2cid WHERE uid IS NOT NULL)",
    "resume_anti": "SELECT row_id, uid FROM train_cid2ins t WHERE NOT EXISTS (SELECT 1 FROM test_cid2cid d WHERE d.uid = t.uid)",
    "vocab_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, '{TOKEN_RX}')) AS token FROM ({_HIST})) GROUP BY token",
    "vocab_missing_anti": f"""WITH k AS (SELECT unnest(regexp_extract_all({TRIM.format('target_sid')}, '{TOKEN_RX}')) AS token FROM test_cid2cid WHERE regexp_full_match({TRIM.format('target_sid')}, '{CODE_RX}'))
SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(code, '{TOKEN_RX}')) AS token FROM ({_HIST})) WHERE token NOT IN (SELECT token FROM k)""",
    "reattached_scores": "SELECT row_id, coalesce(array_to_string(list_transform(hist_sid, lambda x, i: CASE WHEN (i - 1) % 3 = 1 THEN '-' ELSE ((i - 1) * 10)::VARCHAR END), ','), '') AS scores FROM valid_cid2cid",
    "constrained_next": _PT + f""", s AS (SELECT row_id, left('Say {{"target_cid":"' || coalesce({TRIM.format('target_sid')}, '') || '"}}', (row_id % 90)::INT) AS x FROM test_cid2cid),
p AS (SELECT row_id, CASE WHEN NOT contains(x, '{{"target_cid":"') THEN 'search' WHEN contains(substr(x, 20), '"') THEN 'closed' ELSE 'code' END AS phase, substr(x, 20) AS p FROM s),
al AS (SELECT prefix, array_to_string(list_sort(list(next)), ' ') AS allowed FROM pt GROUP BY prefix)
SELECT row_id, phase, CASE WHEN phase = 'code' THEN coalesce(allowed, '') END AS allowed FROM p LEFT JOIN al ON prefix = p AND phase = 'code'""",
    "dataset_counts": "SELECT source_dataset, count(*) AS n FROM train_cid2cid GROUP BY 1",
    "code_validity": f"""WITH e AS (SELECT unnest(hist_sid) AS code FROM train_cid2cid), v AS (SELECT code, coalesce(array_to_string(regexp_extract_all(code, '{TOKEN_RX}'), '') = code AND length(code) > 0, false) AS ok FROM e)
SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, count(DISTINCT code) FILTER (ok) AS unique_codes FROM v""",
    "catalog_distinct": f"""WITH a AS (SELECT sid AS x FROM pid2cid2tid UNION ALL SELECT unnest(tid) FROM pid2cid2tid UNION ALL SELECT pid FROM pid2cid2tid UNION ALL SELECT unnest(hist_sid) FROM valid_cid2cid UNION ALL SELECT target_sid FROM valid_cid2cid UNION ALL SELECT uid FROM valid_cid2cid UNION ALL SELECT reasoning FROM valid_cid2cid)
SELECT DISTINCT {TRIM.format('x')} AS code FROM a WHERE regexp_full_match({TRIM.format('x')}, '{CODE_RX}')""",
    "prefix_table": _PT + "SELECT prefix, next FROM pt",
    "allowed_next_tokens": _PT + _AL + "SELECT row_id, allowed FROM sa",
    "decode_groups": _PT + _AL + "SELECT allowed, count(*) AS n, min(row_id) AS first_key FROM sa GROUP BY allowed",
    "prefix_continuations": f"""WITH c AS ({_LEGAL}), x AS (SELECT target_sid AS x FROM test_cid2cid UNION ALL SELECT unnest(hist_sid) FROM test_cid2cid),
p AS (SELECT DISTINCT left(x, n) AS probe, n FROM x, (VALUES (19), (22)) v(n) WHERE length(x) >= 22) SELECT DISTINCT probe, substr(code, n + 1) AS continuation FROM p JOIN c ON left(code, n) = probe""",
    "positional_zip": "SELECT event_id // 4 AS grp, string_agg(event_type, ',' ORDER BY event_id) AS members FROM events GROUP BY 1",
}
QUERIES = {k: globals()[k] for k in SQL}
