"""Defects, truncation, packing, mixing and toxicity: small cases, invariants, held-out accuracy."""

import random

import numpy as np
import pytest

pytest.importorskip("quillmill.llm")
from quillmill.llm import defects, mixing, packing, tokens, toxicity, truncation  # noqa: E402

CODE = "<|cid_begin|><s_a_{}><s_b_2><s_c_3><|cid_end|>"


@pytest.mark.parametrize(
    "text,terms,want",
    [
        ("A full sentence.", [], truncation.WHOLE), ("It ends in a wo…", [], truncation.CUT), ("It ends in a wo-", [], truncation.CUT), ("It ends here,", [], truncation.CUT),
        ("(no text", [], truncation.CUT), ("Photo. (no text, no people)", [], truncation.WHOLE), ("Final pick: a b, c", ["a b", "c"], truncation.WHOLE),
        ("Final pick: a b, c", ["a b", "cork"], truncation.CUT), (CODE.format(1) + "<|cid_be", [], truncation.CUT), (CODE.format(1), [], truncation.WHOLE),
        ("", [], truncation.WHOLE), (None, None, truncation.WHOLE), ("-", [], truncation.WHOLE), ("Style: flat lay", [], truncation.OPEN),
    ],
)
def test_judge_end(text, terms, want):
    assert truncation.judge_end(text, terms) == want


def test_truncated_by_evidence(spark):
    base = ["Keep the palette to sand and one neutral.", "Use soft light and keep the lid sharp. Style: flat lay", "Avoid visible logos or printed text."] * 5
    rows = [(i, "f", x, []) for i, x in enumerate(base)] + [(100, "f", "Keep the palette to sa", []), (101, "f", "Avoid visible", []), (102, "f", None, []), (103, "f", "", None), (104, "f", "word " * 20_000 + "end.", [])]
    d = spark.createDataFrame(rows, "row_id long, field string, text string, terms array<string>").filter("text IS NOT NULL")
    assert {r["row_id"] for r in truncation.truncated_values(d).collect()} == {100, 101}
    assert truncation.truncated_values(d.limit(0)).count() == 0


def test_truncated_by_distinct_texts(spark):
    """Copies of a cut value are no votes for its end; a longer copy of the whole value decides; a new line is no part of the sentence."""
    cut = "Make a calm image of a grey stool. Keep the palette to sa"
    rows = [(i, cut.replace(" ", "  ") if i % 2 else cut.upper()) for i in range(50)] + [(100, cut + "nd and one neutral.")]
    rows += [(200 + i, f"Image {i} of a lamp. Show the seat at home.") for i in range(3)] + [(300 + i, "Show the seat at") for i in range(9)]
    rows += [(400, "Look: dim\nMood: calm"), (401, "Look: dim"), (402, "Pick one. Look: dim"), (403, "Pick two. Look: dim"), (404, "Pick oak, wax. Final: oak, wax")]
    rows += [(500 + i, f"Scene {i}. A tall cup") for i in range(3)] + [(510, "Scene 4. A tall cup of tea."), (511, "Scene 5. A tall cup of tea.")]
    d = spark.createDataFrame([(i, "f", x, []) for i, x in rows], "row_id long, field string, text string, terms array<string>")
    assert {r["row_id"] for r in truncation.truncated_values(d).collect()} == {*range(50), *range(300, 309)}


def test_truncated_at_doubtful_stop(spark):
    x = ["Use a prop, e.g.", "Use a prop, e.g. a box.", "Leave 2.", "Leave 2.5 m free.", "A stool (grey)", "A stool (grey) by the wall.", "A mug (red)", "A mug (red). Show it.", "Type B.", "Type B. Show it."]
    d = spark.createDataFrame([(i, "f", s, []) for i, s in enumerate(x)], "row_id long, field string, text string, terms array<string>")
    assert {r["row_id"] for r in truncation.truncated_values(d).collect()} == {0, 2, 4}


@pytest.mark.parametrize("times", [1, 4])
def test_truncated_at_any_count(spark, times):
    """The verdict does not depend on how many rows there are; words are not torn from their label."""
    rows = []
    for k in range(times):
        rows += [(i + 1000 * k, f"Scene {i} of day {k}. Use paper cut shapes with {x}.") for i, x in enumerate(("care", "joy", "pins"))]
        rows += [(100 + 1000 * k, f"Mugs of day {k}. Style: paper cut"), (200, "Make a bold fan of paper cut"), (300, "mug | hot | lid")]
        rows += [(400 + i + 1000 * k, f"{x} {k} | red | lid | jar") for i, x in enumerate(("cup", "pot"))]
    d = spark.createDataFrame([(i, "f", x, []) for i, x in rows], "row_id long, field string, text string, terms array<string>")
    assert {r["row_id"] for r in truncation.truncated_values(d).collect() if r["row_id"] % 1000 in (100, 200, 300)} == {200}


def test_defects(spark):
    s = "row_id long, hist_sid array<string>, target_tid array<string>, target_ins string, reasoning string, field string"
    h = [CODE.format(1), CODE.format(2), None]
    good = "Show the red shoe on a wooden table in soft light."
    rows = [
        (1, h, ["red shoe", "cork"], good, "I see that the user likes shoes, so this is the pick."),
        (2, h, None, " ​", None),
        (3, None, ["", None], "TBD", None),
        (4, h, [CODE.format(1)], "I'm sorry, but I can't help with this.", None),
        (5, h, ["red shoe"], f"The history is {CODE.format(1)}, {CODE.format(2)}", None),
        (6, h, ["red shoe"], "Das Bild zeigt eine Teekanne vor der Wand und ist nicht laut.", None),
        (7, h, ["red shoe"], "I see that the user likes cork and leather shoes.", "First a look. I see that the user likes cork and leather shoes. Then the pick is made."),
        (8, h, ["garten", "sommer", "holztisch"], good, None),
        (10, h, ["red shoe"], "Der Gartentisch ist aus Holz und steht mit dem Stuhl in der Sonne. Im Sommer ist es auf der Bank und an der Wand warm.", None),
        (11, h, ["trellis", "gazebo", "zorbing kit"], good, "The shoe is red and the table is made of wood, so that this will be the one to have in the end."),
        (12, h, ["red shoe"], "Put the lamp with the red shade near the window and let it be seen from the path to the garden.", "He was at the shop and had to choose between what they make."),
        (9, h, ["red shoe", "cork"], "Make a poster with the words 'Sorry, we are closed' on a door.", None),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], s)
    got = {(r["row_id"], r["field"], r["defect"]) for r in defects.defects(d).collect()}
    assert got == {
        (2, "target_tid", "empty"), (2, "target_ins", "empty"), (3, "target_tid", "empty"), (3, "target_ins", "empty"), (4, "target_tid", "copy"),
        (10, "target_ins", "language"), (4, "target_ins", "refusal"), (5, "target_ins", "copy"), (6, "target_ins", "language"), (7, "target_ins", "copy"), (8, "target_tid", "language"),
    }
    assert defects.defects(d.limit(0)).count() == 0


def test_declining_list_in_another_language():
    import pandas as pd

    lists = [["Tut mir leid, aber ich kann dabei nicht helfen"], ["I'm sorry, but I can't help with this"], ["red shoe", "cork"]]
    pdf = pd.DataFrame({"row_id": [1, 2, 3], "hist_sid": [[]] * 3, "target_tid": lists, "target_ins": ["Show the shoe."] * 3, "reasoning": [None] * 3})
    got = {tuple(r) for r in pd.concat(defects._find(iter([pdf]))).itertuples(index=False)}
    assert got == {(1, "target_tid", "refusal"), (1, "target_tid", "language"), (2, "target_tid", "refusal")}


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [any(tuple(b[i:j]) in runs for i in range(k + 1) for j in range(max(k + 1, i + 2), len(b) + 1) if i <= k < j) for k in range(len(b))]
        assert defects.SuffixAutomaton(a).covered(b, 2, lambda t: False) == want
        alone = [any(x == "c" for x in b[i:j]) for i, j in ((0, len(b)),)] and [t in a and t == "c" or w for t, w in zip(b, want)]
        got = defects.SuffixAutomaton(a).covered(b, 2, lambda t: t == "c")
        assert all(g or not x for g, x in zip(got, alone)) and all(w or g is False or t == "c" for g, w, t in zip(got, want, b))


def test_copies_of_long_texts():
    import time

    long = ["w%d" % (i % 5000) for i in range(60_000)]
    t = time.time()
    assert defects.Source(long).share(long, 4, 0.8) and time.time() - t < 20  # linear: a square of it would take hours
    assert not defects.Source(long).share(["x"] * 1000, 4, 0.8)


REFUSING = (  # in other words than the lists combine, where possible
    "I'm afraid that I won't be able to assist you with this.|I must respectfully decline.|This is not something I can help with.|Sorry, but I can't create that.|"
    "As an AI, I have no opinion on this.|We are unable to provide a recommendation.|Your request was denied.|No prediction can be made.|Unable to determine the target.|"
    "Answering would go against our guidelines.|Es tut mir leid, aber das geht nicht.|Lo siento, pero no puedo ayudarte.|Je suis désolé, mais non.|抱歉，我不能这样做。"
).split("|")
WILLING = (
    "I cannot decide from the first two items alone, so I read on.|A sign that says 'Sorry, we are closed'.|The lid can't be seen from here.|Do not decline the offer.|"
    "A request form on a desk.|I could not have asked for a better shoe.|Show what the lamp can help with.|The cat is unable to reach the shelf.|Guidelines on a poster."
).split("|")


def test_refusals():
    machine = defects._refusals()
    assert [x for x in REFUSING if not defects._declines(machine, x)] == []
    assert [x for x in WILLING if defects._declines(machine, x)] == []


def test_packing(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([0, 3, 30, 60, 99, 100, 101, 250, rng.randint(1, 90)])) for i in range(400)] + [(1000, None)]
    d = spark.createDataFrame(docs, "doc_id long, tokens int")
    got = packing.pack(d, [("s", 100), ("bad", 0), (None, 5)], block_items=150).collect()
    fill, size, parts = {}, {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["size"]
        parts[r["doc_id"]] = parts.get(r["doc_id"], 0) + 1
    want = {i: n or 0 for i, n in docs}
    assert size == want and max(fill.values()) <= 100
    assert all(parts[i] == max(1, -(-n // 100)) for i, n in want.items())
    assert len(fill) <= 1.05 * -(-sum(want.values()) // 100) + 1
    assert packing.pack(d.limit(0), [("s", 100)]).count() == 0


def test_packing_evolves_beyond_best_fit(spark):
    """Triples that fill a container exactly: best fit takes a fifth more, the evolved packing hardly any."""
    rng = random.Random(3)
    sizes = []
    for _ in range(60):
        a = rng.randint(380, 489)
        b = rng.randint(250, 1000 - a - 250)
        sizes += [a, b, 1000 - a - b]
    plain = len(packing.fresh(sizes, 1000, np.random.default_rng(0), 0.0).bins)
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
    got = packing.pack(d, [("s", 1000)], block_items=1000).collect()
    used = {}
    for x in got:
        used[x["container"]] = used.get(x["container"], 0) + x["size"]
    assert sorted(x["size"] for x in got) == sorted(sizes) and max(used.values()) <= 1000
    assert plain >= 68 and len(used) <= 62


def test_exchange_keeps_items():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.randint(1, 60) for _ in range(30)]
        bins, free = [], []
        packing.best_fit(list(range(18)), sizes, bins, free, 100)
        loose = packing.exchange(list(range(18, 30)), sizes, bins, free)
        assert sorted([i for b in bins for i in b] + loose) == list(range(30))
        assert all(f == 100 - sum(sizes[i] for i in b) and f >= 0 for b, f in zip(bins, free))


def test_flight_keeps_sums():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 500):
        pi, size = rng.random(n), rng.integers(1, 300, n).astype(float)
        f = mixing.flight(pi, size, rng)
        assert abs(f.sum() - pi.sum()) < 1e-6 and abs((f * size).sum() - (pi * size).sum()) < 1e-4
        assert ((f > 1e-9) & (f < 1 - 1e-9)).sum() <= 2


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(0, 200)) for i in range(3000)]
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens int")
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 4), ("a2", None, 1)]
    got = mixing.mix(d, targets, block_rows=300).collect()
    tok, most = {}, {}
    for r in got:
        tok[r["source"]] = tok.get(r["source"], 0) + r["tokens"] * r["repeats"]
        most[r["source"]] = max(most.get(r["source"], 0), r["repeats"])
    total = sum(tok.values())
    for s, w, cap in targets[:3]:
        assert abs(tok[s] / total - w / 0.95) < 0.003 and most[s] <= cap
    assert len({r["doc_id"] for r in got}) == len(got)
    assert mixing.mix(d.limit(0), targets).count() == 0


def test_tokens(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(d).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# words of no language stand for abuse, so that nothing a test knows can be known to the operator
VILE = "zorgle blafnik quondrit mefsplat krudwimp vostrel".split()
CALM = "The lid fits well and the colour is calm.|Delivery took {} days and the box was fine.|Would buy it again for the garden.|It was {} hours late, what a bad day.".split("|")


def _posts(rng, n, vile):
    frames = ("You are a {} and all know it.", "Nobody likes such a {} here.", "Go away, {}!")
    for i in range(n):
        calm = [rng.choice(CALM).format(rng.randint(2, 40)) for _ in range(rng.randint(1, 4))]
        y = i % 3 == 0
        if y:
            calm.insert(rng.randint(0, len(calm)), rng.choice(frames).format(vile(rng)))
        yield " ".join(calm), int(y)


def test_toxicity_held_out(spark):
    """Texts to judge are not among those to learn from: other sentences around them and spellings that were never seen."""
    rng = random.Random(1)
    spelt = (lambda w: w.replace("o", "0").replace("i", "1"), lambda w: w[0] + w[1] * 4 + w[2:], " ".join, str.upper, lambda w: w[:3] + "\u200b" + w[3:])
    learn = [(i, x, y) for i, (x, y) in enumerate(_posts(rng, 900, lambda r: r.choice(VILE)))]
    judge = [(5000 + i, x, y) for i, (x, y) in enumerate(_posts(rng, 300, lambda r: r.choice(spelt)(r.choice(VILE))))]
    d = spark.createDataFrame([(i, t, None) for i, t, _ in learn + judge] + [(9000, None, 1), (9001, "", 1), (9002, "zorgle", 1)], "doc_id long, text string, score int")
    lab = [(i, y if rng.random() > 0.04 else 1 - y) for i, _, y in learn] + [(7777, 1), (None, 1), (0, None)]
    lab = spark.createDataFrame(lab, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, lab).collect()}
    held = [(got[i] >= 0.5, y == 1) for i, _, y in judge]
    assert sum(a and b for a, b in held) / sum(b for _, b in held) > 0.9  # recall
    assert sum(a and b for a, b in held) / sum(a for a, _ in held) > 0.9  # precision
    assert got[9000] == got[9001] == 0.0 and got[9002] > 0.5
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
    assert {r["score"] for r in toxicity.toxicity(d, lab.filter("toxic = 0")).collect()} == {0.0}


def test_toxicity_passages():
    assert toxicity.passages("A b. <p>Well: c-a-l-m, \u0441alm cаlm caaaalm\u200b</p> 5 < 7") == [["a", "b", "well"], ["calm", "calm", "calm", "calm", "0", "0"]]
    assert toxicity.words("f*ck") == ["f*ck"] and toxicity.words("x") == ["x"] and toxicity.words(" \n") == []
    one = toxicity.train(["bad zorgle here. fine day today"] * 3 + ["fine day today"] * 9, [(1.0, 2)] * 3 + [(0.0, 2)] * 9)
    long = "fine day today. " * 30_000 + "bad zorgle here."
    texts = ["fine day today", long, None, "", "bad zorgle here."]
    got = one.score_texts(texts)
    assert got[1] == got[4] > 0.5 > got[0] and got[2] == got[3] == 0
    again = toxicity.Model.of(one.bytes())
    assert np.allclose(again.score_texts(texts), got, atol=1e-4)
    for t in texts[:1] + texts[4:]:  # the batch gives what a bag at a time gives
        assert abs(one.scores([toxicity.features(p) for p in toxicity.passages(t)]).max() - one.score_texts([t])[0]) < 1e-9
