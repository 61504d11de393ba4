import json

import pytest
from pyspark.sql import functions as F

from quillmill.functions import coerce, ids, jsonx, scoring, text
from quillmill.operators import builders, external, inputs, joins, limits, prefix, sequence
from quillmill.sources import checkpoints, readers, sinks
from quillmill.streaming import runs

CODE = "<|cid_begin|><s_a_{}><s_b_{}><s_c_{}><|cid_end|>"


def one(spark, expr, schema="a string", row=(None,)):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_codes(spark):
    ok = CODE.format(3855, 7257, 3681)
    d = spark.createDataFrame([(ok,), (f" {ok}\n",), ("<s_a_1>x<s_b_2>",), (None,), ("",)], "a string")
    assert [r[0] for r in d.select(ids.is_code(F.col("a"))).collect()] == [True, True, False, False, False]
    assert one(spark, F.size(ids.code_tokens(F.col("a"))), row=(ok,)) == 5
    assert one(spark, ids.tokens_cover(F.col("a")), row=("<s_a_1>x<s_b_2>",)) is False


@pytest.mark.parametrize("s,want", [('["a","b"]', ["a", "b"]), ("a, b,", ["a", "b"]), ("", []), ("a", ["a"]), (None, [])])
def test_list_string(spark, s, want):
    assert one(spark, coerce.parse_list_string(F.col("a")), row=(s,)) == want


def test_string_lists(spark):
    a = "a array<string>"
    assert one(spark, coerce.string_list(F.col("a")), a, (["a", "", None],)) == ["a", ""]
    assert one(spark, coerce.string_list(F.col("a"), True), a, (["a", "", None],)) == ["a"]
    assert one(spark, coerce.string_list(F.col("a")), a, (None,)) == []


def test_history(spark):
    h = "a array<array<string>>"
    assert one(spark, coerce.format_history(coerce.history_tids(F.col("a"))), h, ([["a", "b"], ["c"]],)) == "1. a, b\n2. c"
    assert one(spark, coerce.format_history(coerce.history_tids(F.col("a"))), h, ([],)) == "[]"


@pytest.mark.parametrize("pred,gold,want", [((1, 2, 9), (1, 2, 3), 0.8), ((9, 9, 9), (1, 2, 3), 0.0), ((1, 2, 3), (1, 2, 3), 1.0)])
def test_layers(spark, pred, gold, want):
    r = one(spark, scoring.layer_reward(F.col("a"), F.col("b")), "a string, b string", (CODE.format(*pred), CODE.format(*gold)))
    assert abs(r - want) < 1e-9


def test_overlaps(spark):
    s = "a array<string>, b array<string>"
    d = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], s)
    p, r, f = scoring.overlap(F.col("a"), F.col("b"))
    assert [tuple(x) for x in d.select(p, r, f).collect()] == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0)]
    assert one(spark, scoring.overlap_reward(F.col("a"), F.col("b")), s, ([], [])) == 0.0


def test_ndcg(spark):
    s = "a array<string>, b string"
    assert one(spark, scoring.ndcg(F.col("a"), F.col("b"), 5), s, (["x", "y", "g"], "g")) == 0.5
    assert one(spark, scoring.ndcg(F.col("a"), F.col("b"), 5), s, (["x"], None)) == 0.0


def test_judge(spark):
    s, v = "c double, n double, a double, e double", [F.col(x) for x in "cnae"]
    assert one(spark, scoring.judge_overall(*v), s, (8.0, 6.0, 7.0, 4.0)) == 5.55
    assert one(spark, scoring.leak_penalised(F.lit(True), *v), s, (8.0, 6.0, 7.0, 7.0)) == 5.375


def test_think(spark):
    assert one(spark, scoring.think_reward(F.col("a")), row=("<think>short</think>",)) == 0.0
    assert one(spark, scoring.think_reward(F.col("a")), row=("<think>eleven chars</think>",)) == 1.0


def test_packing(spark):
    d = spark.createDataFrame([("s", i, n) for i, n in enumerate([4, 5, 3, 11, 9])] + [(None, 9, 1)], "split string, pos int, n int")
    got = {(r["n"], r["pack"]) for r in sequence.next_fit(d, "split", "pos", "n", 10).collect()}
    assert got == {(4, 0), (5, 0), (3, 1), (9, 2)}


def test_advantages(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0)], "g string, r double")
    got = sorted(r["advantage"] for r in sequence.advantages(d, ["g"], "r", "group").collect())
    assert [round(x, 6) for x in got] == [round(-1 / 1.0001, 6), 0.0, round(1 / 1.0001, 6)]
    with pytest.raises(ValueError):
        sequence.advantages(d, ["g"], "r", "other")


def test_limits(spark):
    d = spark.createDataFrame([(0, False), (1, True), (2, True)], "p int, ok boolean")
    assert limits.limit_before(d, "p", 2, F.col("ok")).count() == 1
    assert limits.limit_after(d, "p", 2, F.col("ok")).count() == 2
    assert one(spark, limits.text_seed(F.col("a")), row=("ab",)) == 195
    assert one(spark, limits.text_seed(F.col("a"))) == 0


@pytest.mark.parametrize(
    "said,penalty,violations",
    [
        ('{"target_cid":"x"} bye', 0.45, ["text_after_json"]), (None, 0.0, []), ("<think>a</think> {}", 0.0, []), ("```json\n{}\n```", 0.0, []),
        ("<think>a</think><think>b</think>{}", 0.4, ["multiple_think_blocks", "text_before_json"]), ("x <THINK>a</THINK>{}", 0.3, ["think_not_at_start", "text_before_json"]),
        ('<think>{"target_cid":1,"target_cid":2}', 0.65, ["unbalanced_think_tags", "text_before_json", "repeated_target_keys"]), ("{} {}", 0.65, ["text_after_json", "multiple_json_objects"]),
    ],
)
def test_form(said, penalty, violations):
    got = jsonx.form(said)
    assert (got["penalty"], got["violations"]) == (penalty, violations)


def test_json():
    assert jsonx.last_object('a {"x":1} b {"y":{"z":2}} c') == '{"z":2}' and jsonx.last_object('{"y":1} {bad') == '{"y":1}' and jsonx.last_object(None) is None
    assert jsonx.cut_to_object('x {"a":"}"} y') == '{"a":"}"}' and jsonx.cut_to_object("x {a") == "x {a"
    assert jsonx.payload('```json\n[1, 2]\n```') == "[1,2]" and jsonx.payload("so [1] it {2") == "[1]"
    js, err = jsonx.recovered('<think>t</think>{"target_tid":["a"]} "target_ins": "draw it"')
    assert json.loads(js) == {"target_tid": ["a"], "target_ins": "draw it"} and err is None
    assert jsonx.recovered("nothing") == (None, "no object or field")
    assert json.loads(jsonx.recovered('{"target_tid": ["a"], target_ins: "a lamp on {a} wide desk", target_ins: "a lamp on a des')[0]) == {"target_tid": ["a"], "target_ins": "a lamp on a des"}
    assert [o for *_, o in jsonx.objects('{"a": {"b": 1}, "c": oops {"d": 2} {')] == [{"b": 1}, {"d": 2}]
    assert jsonx.first_value("so: [1, {") is None and jsonx.first_value('so: {x [1, 2] {"a":1}') == "[1,2]"


def test_json_of_many_braces():
    import time

    t = time.time()
    for text in ("{" * 50_000, '{"a":' * 20_000, '{"a":[' * 20_000, "{}" * 50_000, '{"' * 30_000):
        jsonx.form(text), jsonx.recovered(text), jsonx.last_object(text), jsonx.cut_to_object(text), jsonx.first_value(text[:3_000])
    assert time.time() - t < 30


def test_segments():
    f = jsonx.segments
    assert f("<think> a </think> b") == ("a", "b") and f("a</think>b") == ("a", "b") and f('so {"x":1} end') == ("so", '{"x":1} end')
    assert f("all thought") == ("all thought", "") and f(None) == ("", "")
    assert jsonx.canonical_answer('so {"target_cid": "[\\"x\\"]"}', "cid2cid") == '<think>\nso\n</think>\n{"target_cid":"x"}'
    assert jsonx.canonical_answer("plain", "other") == "<think>\nplain\n</think>"
    assert jsonx.named_candidates('{"prompt":" p ","reasoning":"r"}', ()) == ('{"prompt":"p","reasoning":"r"}', None)


def test_rewards(spark):
    from quillmill.operators import rewards

    c = CODE.format(1, 2, 3)
    said = "<think>a longer thought</think>" + json.dumps({"target_cid": c})
    rows = [(1, "cid2cid", said, c, None, False), (2, "cid2cid", "no", c, None, False), (3, "cid2ins", '{"target_tid":["a"],"target_ins":"an a"}', None, ["a"], True), (4, "?", said, c, None, None), (5, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "k int, task string, text string, gold_cid string, gold_tid array<string>, bad boolean")
    known = spark.createDataFrame([(c,)], "sid string")
    got = {r["k"]: r for r in rewards.answer_rewards(d, known, "sid", failed="bad").collect()}
    assert abs(got[1]["reward"] - 1.0) < 1e-9 and got[2]["reward"] == 0 == got[4]["reward"] == got[5]["reward"]
    assert abs(got[3]["reward"] - (0.9 * 0.1 * 0.2 + 0.1)) < 1e-9


def test_terms(spark):
    assert one(spark, text.clean_term(F.col("a")), row=(' ["red  shoe"] ',)) == "red shoe"
    assert one(spark, text.caption_terms(F.col("a")), row=("Red shoe, red Shoe; 中文. Size 4",)) == ["Red shoe", "Size 4"]
    assert one(spark, text.caption_terms(F.col("a"))) == []


def test_reasoning_trim(spark):
    long = "word " * 30 + "end. " + "tail " * 30
    got = one(spark, text.trim_reasoning(F.col("a")), row=(long,))
    assert got.endswith("end.") and len(got) <= 200
    assert one(spark, text.trim_reasoning(F.col("a")), row=("x" * 300,)) == "x" * 200 + "..."


def test_lookup_and_prefix(spark):
    df = spark.createDataFrame([(1, ["p1", "p2", "p1"]), (2, None), (3, [])], "k int, pids array<string>")
    dim = spark.createDataFrame([("p1", ["a"]), ("p1", ["b"]), (None, ["z"])], "pid string, tid array<string>")
    got = {r["k"]: r["t"] for r in joins.lookup_array(df, "k", "pids", dim, "pid", "tid", "t").collect()}
    assert got == {1: [["a"], ["p2"], ["a"]], 2: [], 3: []}
    t = prefix.prefix_table(spark.createDataFrame([(["x", "y"],), (["x", "z"],)], "t array<string>"), "t", "}")
    assert {(r["prefix"], r["next"]) for r in t.collect()} == {("", "x"), ("x", "y"), ("x", "z"), ("xy", "}"), ("xz", "}")}
    s = prefix.allowed_next(spark.createDataFrame([(1, "x"), (2, "q")], "i int, p string"), "p", t)
    assert {r["i"]: r["allowed"] for r in s.collect()} == {1: ["y", "z"], 2: []}


def test_samples(spark):
    m = one(spark, builders.cid2tid(F.col("s"), F.col("t")), "s string, t array<string>", ("c", ['a "b"', None]))
    assert m[2]["content"] == '{"target_tid":["a \\"b\\""]}'
    assert one(spark, builders.cid2tid(F.col("s"), F.col("t")), "s string, t array<string>", (None, ["a"])) is None


def test_external(spark):
    def client(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    d = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "a")], "k int, p string").coalesce(1)
    got = {r["k"]: (r["answer"], r["error"]) for r in external.ask(d, "p", client, attempts=1, pause=0).collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: no"), 3: (None, None), 4: ("A", None)}


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"b": "text one", "a": "[\\"x\\", \\"y\\"]", " ": "z"}')
    assert [(r["id"]) for r in readers.map_document(spark, str(p)).orderBy("pos").collect()] == ["b", "a", " "]
    assert {r["id"]: r["tid"] for r in readers.terms_by_pid(spark, str(p)).collect()} == {"b": ["text one"], "a": ["x", "y"]}
    (tmp_path / "l.json").write_text('[{"id": "k", "tid": ["x", " "]}, {"id": "k", "tid": ["y"]}, {"id": "n", "tid": null}]')
    assert [tuple(r) for r in readers.terms_by_pid(spark, str(tmp_path / "l.json")).collect()] == [("k", ["y"])]
    (tmp_path / "c1.json").write_text('[{"id": "k", "text": "t", "item_caption": " c "}, {"id": "n"}]')
    assert [tuple(r) for r in readers.captions(spark, str(tmp_path / "c1.json")).orderBy("pos").collect()] == [(0, "k", "c"), (1, "n", None)]
    assert readers.captions(spark, str(p)).count() == 3
    (tmp_path / "bad.json").write_text('"text"')
    with pytest.raises(Exception, match="neither an object nor a list"):
        readers.terms_by_pid(spark, str(tmp_path / "bad.json")).collect()
    d = spark.createDataFrame([(1, "ok"), (2, None)], "k int, v string")
    sinks.with_failures(d, F.when(F.col("v").isNull(), "no value"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "bad")).first()["sample"]["k"] == 2
    sinks.with_failures(d, F.lit("e"), str(tmp_path / "g2"), str(tmp_path / "b2"), "k", "v")
    assert {(r["index"], r["sample_id"], r["error"]) for r in spark.read.json(str(tmp_path / "b2")).collect()} == {(1, "ok", "e"), (2, None, "e")}
    c = tmp_path / "c.json"
    c.write_text('{"results": [{"a": 1}, {"a": 2}]}')
    assert readers.contained(spark, str(c), "a int").count() == 2
    assert readers.env_file("export A='x'\n#c\nB=1\n") == {"A": "x", "B": "1"}
    with pytest.raises(ValueError):
        d.write.parquet(str(tmp_path / "pq"))
        readers.parquet(spark, str(tmp_path / "pq"), columns=["nope"])
    assert [r["v"] for r in readers.values(spark, str(tmp_path / "pq"), "v").collect()] == ["ok"]
    assert readers.parquet(spark, str(tmp_path / "pq"), columns=["k"], ordered=True).columns == ["k", "file_name", "row_index"]
    assert readers.first_existing(spark, str(tmp_path / "nope"), str(tmp_path / "pq")).endswith("pq")
    assert [x.rpartition("/")[2] for x in readers.discovered(spark, str(tmp_path), "m", "c*", suffix=".json")] == ["c.json", "c1.json", "m.json"]
    for bad in (lambda: readers.first_existing(spark, str(tmp_path / "nope")), lambda: readers.discovered(spark, str(tmp_path), "nope")):
        with pytest.raises(FileNotFoundError):
            bad()
    (tmp_path / "t.tsv").write_text("u\tp\td\tmore\n\nv\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("u", "p", "d\tmore"), ("v", None, None)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    assert sorted((r["a"], r["_bad"]) for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect() if r["a"]) == [(1, None)]
    assert readers.json_documents(spark, str(c), "results array<struct<a:int>>").first()["results"][1]["a"] == 2
    assert readers.with_dataset(spark.read.json(str(tmp_path / "x.jsonl")), ".jsonl").first()["dataset"] == "x"
    s = readers.Settings({"n": ""}, {"n": "3", "ks": "a,b a", "bad": "x", "on": "Yes"})
    assert s.number("n", 1) == 3 and s.number("m", 1.5, float) == 1.5 and s.keys("none", "ks") == ["a", "b"] and s.flag("on")
    for bad in (lambda: s.keys("none"), lambda: s.number("bad", 1)):
        with pytest.raises(ValueError):
            bad()


def test_id_values(spark):
    assert one(spark, coerce.id_values(F.col("a")), row=('[["x", " y "], "z", ""]',)) == ["x", "y", "z"]
    assert one(spark, coerce.id_values(F.col("a")), row=("p, q,",)) == ["p", "q"] and one(spark, coerce.id_values(F.col("a"))) == []
    assert one(spark, coerce.hist_pids(F.col("a"), True), "a array<string>", ([" x ", "", None],)) == ["x"] and one(spark, coerce.hist_pids(F.col("a")), row=("'B000000001', x",)) == ["B000000001"]
    assert one(spark, coerce.history_tids(F.col("a"), True), "a array<string>", (["a, b", "c", None],)) == [["a", "b"], ["c"], []]


def test_codes_anywhere(spark):
    from quillmill.operators import aggregates

    c = [CODE.format(i, 2, 3) for i in range(8)]
    s = "a string, b array<array<string>>, c struct<x: string, y: array<string>, n: int>, d map<string, array<string>>, e int, f array<struct<z: string>>"
    d = spark.createDataFrame([(" " + c[0], [[c[1]], None], (c[2], [c[3]], 1), {c[4]: [c[5], "x"]}, 1, [(c[6],), None]), (None,) * 6], s)
    assert {r["code"] for r in aggregates.codes_anywhere(d).collect()} == set(c[:7])
    assert aggregates.codes_anywhere(d.select("e")).count() == 0


def test_judge_pool(spark):
    def down(prompts):
        raise RuntimeError("down")

    both = external.pooled(down, lambda ps: [json.dumps({"s": len(json.loads(p)["terms"])}) if "bad" not in p else "no" for p in ps])
    d = spark.createDataFrame([(1, ["B ", "a"], "X"), (2, ["a", "b"], "x "), (3, ["bad"], "y"), (4, None, None)], "k int, terms array<string>, ins string")
    got = {r["k"]: (r["scores"]["s"], r["judged"]) for r in external.judged(d, ["terms", "ins"], both, "s double", F.struct(F.lit(-1.0).alias("s")), attempts=1, pause=0).collect()}
    assert got == {1: (2.0, True), 2: (2.0, True), 3: (-1.0, False), 4: (-1.0, False)}
    with pytest.raises(RuntimeError):
        external.pooled(down, down)(["x"])


def test_numbered(spark):
    d = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "k int, row_idx_ string").repartition(5)
    assert [(r["row_idx"], r["k"]) for r in readers.numbered(d, "k").orderBy("k").collect()] == [(i, i) for i in range(50)]
    assert sorted(r["row_idx"] for r in readers.numbered(d, "k", limit=3).collect()) == [0, 1, 2] and readers.numbered(d.limit(0), "k").count() == 0


def test_checkpoints(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join([
        '{"type":"meta","total":5}', '{"type":"item","index":1,"value":{"v":"old"}}', "broken", '{"type":"item","index":1,"value":{"v":"new"}}', '{"type":"item","index":9,"value":{}}',
        '{"type":"item","index":2,"value":"text"}', '{"total":5,"entries":{"0":{"v":"e"},"x":{},"7":{}}}', '{"total":4,"done":{"3":{}}}', '{"done":{"4":{"v":"d"}}}',
    ]))
    got = {r["idx"]: json.loads(r["value"]) for r in checkpoints.entries(spark, str(log), 5).collect()}
    assert got == {0: {"v": "e"}, 1: {"v": "new"}, 4: {"v": "d"}}
    assert checkpoints.entries(spark, str(log), 5, all_or_nothing=True).count() == 0
    snap = tmp_path / "snap.json"
    snap.write_text('{\n "outputs": [null, {"a": 1},\n "x"]\n}')
    assert [r["idx"] for r in checkpoints.entries(spark, str(snap), 3, snapshot=True).collect()] == [1] and checkpoints.entries(spark, str(snap), 4, snapshot=True).count() == 0
    done = spark.createDataFrame([(i, json.dumps({"i": i})) for i in range(7)], "idx long, value string")
    checkpoints.append(done.filter("idx < 3"), str(tmp_path / "out"), 8, every=2)
    checkpoints.append(done.filter("idx >= 3"), str(tmp_path / "out"), 8, every=2)
    back = checkpoints.entries(spark, str(tmp_path / "out"), 8)
    assert {r["idx"]: json.loads(r["value"]) for r in back.collect()} == {i: {"i": i} for i in range(7)}
    assert [r["k"] for r in checkpoints.left_to_do(spark.range(8).select(F.col("id").alias("k")), "k", back).collect()] == [7]
    assert one(spark, checkpoints.milestones_crossed(F.lit(3), F.lit(10), 5)) == [5, 10] and one(spark, checkpoints.milestones_crossed(F.lit(5), F.lit(9), 5)) == []
    assert checkpoints.emergency_path("a/b.json") == "a/b_emergency.json" and checkpoints.emergency_path("b") == "b_emergency"


def test_more_sinks(spark, tmp_path):
    t = spark.createDataFrame([("<s_b_2>",), ("<s_a_10>",), ("<s_a_9>",), ("<|cid_end|>",), ("<s_a_9>",)], "token string")
    sinks.vocabulary(t, str(tmp_path / "v"), spark.createDataFrame([("<s_a_9>",)], "token string"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v/tokens")).collect()] == ["<s_a_9>", "<s_a_10>", "<s_b_2>", "<|cid_end|>"]
    assert {r["token"]: r["id"] for r in spark.read.json(str(tmp_path / "v/vocabulary")).collect()}["<s_b_2>"] == 2
    assert {r["kind"]: (r["n"], r["n_new"]) for r in spark.read.json(str(tmp_path / "v/summary")).collect()} == {"a": (2, 1), "b": (1, 1), "mark": (1, 1)}
    to = sinks.metrics(spark.createDataFrame([(float("nan"), 2.0)], "a double, b double"), str(tmp_path / "m.json"), "my model/1")
    assert to.endswith("m_my_model_1.json") and spark.read.json(to).first()["b"] == 2.0
    st = spark.createDataFrame([("r", 5, 1, "x"), ("r", 10, 1, "y"), ("r", 10, 2, "z")], "run string, step int, at int, path string")
    assert sinks.latest_state(st, ["run"], "step", "at").first()["path"] == "z"
    codes = spark.createDataFrame([(" b",), ("a",), ("b",), ("",), (None,)], "code string")
    assert [r["code"] for r in sinks.codes_in_order(codes, "code").collect()] == ["a", "b"]
    logs = spark.createDataFrame([(s, i) for s in (1, 2, 4) for i in range(5)], "step int, i int")
    assert {r["step"]: r["n"] for r in sinks.log_entries(logs, 2, "step", 3).groupBy("step").agg(F.count("*").alias("n")).collect()} == {2: 3, 4: 3}
    assert sinks.list_text(spark.createDataFrame([(["a", 'b"'],)], "x array<string>"), "x").first()["x"] == '["a","b\\""]'
    assert sinks.snapshot_path("p", 25, 10) == "p.20"


def test_layouts(spark):
    terms = spark.createDataFrame([("B000000001", ["t1", "t2"])], "pid string, tid array<string>")
    s = "k int, uid string, hist_pid string, valid_pid string, target_pid string, hist_tid array<array<string>>, valid_tid array<string>, target_tid array<string>, history_tids array<array<string>>"
    d = spark.createDataFrame([
        (1, "u", "['B000000001','B000000002']", "B000000001", "B000000003", None, None, None, None), (2, "u", None, None, None, [["a", " "], [" "]], ["v"], ["g"], None),
        (3, None, None, None, None, None, None, ["g"], [["h"]]), (4, "u", None, None, "B000000001", None, None, None, None), (5, "u", "", None, " ", None, None, None, None),
    ], s)
    got = {r["k"]: (r["form"], r["history_tids"], r["target_tid"]) for r in inputs.dispatched(d, "k", terms).collect()}
    assert got == {
        1: ("B", [["t1", "t2"], ["B000000002"], ["t1", "t2"]], ["B000000003"]), 2: ("C", [["a"], ["v"]], ["g"]), 3: ("A", [["h"]], ["g"]), 4: ("error", None, None), 5: ("B", [], []),
    }
    assert inputs.dispatched(d.limit(0), "k", terms).count() == 0
    o = inputs.outcome_log(spark.createDataFrame([(1, None), (2, "e")], "k int, e string"), "e", "k").collect()
    assert [(r["k"], r["status"]) for r in o] == [(1, "ok"), (2, "error")]


def test_unused_expressions(spark):
    a = "a array<string>"
    assert one(spark, coerce.as_list(F.col("a"), True), a, (None,)) == [] and one(spark, coerce.as_list(F.col("a"), False), row=("x",)) == ["x"]
    assert one(spark, coerce.str_or_empty(F.col("a"))) == "" and one(spark, coerce.target_terms(F.col("a")), row=("A, b;c/ ",)) == ["a", "b", "c"]
    assert one(spark, coerce.mapped(F.col("a"), {"x": "1"}, "other", "none"), row=("y",)) == "other" and one(spark, coerce.mapped(F.col("a"), {"x": "1"}, "other", "none")) == "none"
    assert one(spark, sequence.until_eos(F.array(*[F.lit(x) for x in (4, 0, 5, 0)]), 0)) == [4, 0] and one(spark, sequence.until_eos(F.array(F.lit(4)), 0)) == [4]
    assert one(spark, text.strip_fences(F.col("a")), row=("```sql\nx\n```",)) == "x" and one(spark, text.strip_fences(F.col("a"), False), row=("```JSON x",)) == "x"
    assert one(spark, text.strip_think(F.col("a")), row=("<THINK>a\n</think> b",)) == "b" and one(spark, text.first_person(F.col("a"))) is False
    assert one(spark, text.task_of_prompt(F.col("a")), row=("... Target_CID",)) == "cid2cid"
    assert one(spark, jsonx.safe_parse(F.col("a"), "array<int>", F.array(F.lit(7))), row=("[1",)) == [7] and one(spark, scoring.bounded(F.col("a"), 0.5), row=("x",)) == 0.5
    assert one(spark, sequence.milestones(F.lit(10), 5)) is True
    d = spark.range(20).select(F.col("id").alias("k"))
    x, y = ([r["k"] for r in limits.shuffled(d, s, "k").collect()] for s in (1, 1))
    assert x == y != sorted(x) and sorted(x) == list(range(20))
    m = sequence.row_mask(d, "k", spark.createDataFrame([(3,), (3,), (99,)], "k long"))
    assert [r["k"] for r in m.filter("mask = 1").collect()] == [3] and m.count() == 20


def test_padding_and_packing_errors(spark):
    with pytest.raises(Exception, match="longer than the padded width"):
        spark.range(1).select(sequence.padded(F.array(F.lit(1), F.lit(2)), 1, 0)).collect()
    d = spark.createDataFrame([("s", 0, [1, 2], [1]), ], "split string, pos long, ids array<int>, mask array<int>")
    with pytest.raises(Exception, match="differ in length"):
        sequence.packed_tokens(d, "split", "pos", "ids", "mask", 0).collect()
    d = spark.createDataFrame([("s", 0, [1, 2], [0, 1]), ("s", 1, [3], None), ("s", 2, [4] * 9, None), ("s", 3, [5, 6], [1, 1]), ("s", 4, None, None)], "split string, pos long, ids array<int>, mask array<int>")
    got = {r["pack"]: (r["input_ids"], r["assistant_masks"], r["labels"]) for r in sequence.packed_tokens(d, "split", "pos", "ids", "mask", 0, 6).collect()}
    assert got == {0: ([1, 2, 0, 3, 0], [0, 1, 0, 0, 0], [-100, 2, -100, -100, -100]), 1: ([5, 6, 0], [1, 1, 0], [5, 6, -100])}


@pytest.mark.parametrize("longest,width,n", [(10, 5, 200), (7, 50, 300), (100, 1000, 500), (10, 3, 100)])
def test_next_fit_in_blocks(spark, longest, width, n):
    import random

    rng = random.Random(longest)
    rows = [(s, i, rng.randint(0, longest + 1)) for s in "ab" for i in range(n)]
    want = {}
    for s in "ab":
        pack = used = 0
        for _, i, k in (x for x in rows if x[0] == s):
            if 1 <= k <= longest:
                pack, used = (pack + 1, k) if used + k > longest else (pack, used + k)
                want[s, i] = pack
    d = spark.createDataFrame(rows, "split string, i long, n int")
    assert {(r["split"], r["i"]): r["pack"] for r in sequence.next_fit(d, "split", "i", "n", longest, width).collect()} == want


def test_streaming(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    d.write.parquet(src)
    runs.incremental(spark, src, "k int, ts timestamp", lambda b: b.select("k"), out, state)
    d.withColumn("k", F.col("k") + 10).write.mode("append").parquet(src)
    runs.incremental(spark, src, "k int, ts timestamp", lambda b: b.select("k"), out, state)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 11, 12]
    w = lambda e: runs.failure_windows(e.withColumn("g", F.lit(1)), "ts", ["g"], "1 hour", "1 hour", "1 day")
    assert runs.replay(spark, src, "k int, ts timestamp", w, "wins", str(tmp_path / "st2")).collect()[0]["n"] == 4
