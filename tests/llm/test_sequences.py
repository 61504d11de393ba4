"""Overlaps, pairs, subsequences and terms against brute force and SQL."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillmill.llm")
from quillmill.llm import common, cooccurrence, overlap, registry, subsequences, terms  # noqa: E402


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def near(a, e):
    n = max(len(a), len(e))
    return len(a) >= 8 and len(e) >= 8 and edits(a, e) <= n // 5


def changed(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(s) + 1)
        move = rng.choice("idr")
        if move == "i":
            s.insert(k, rng.randint(1, 60))
        elif s and k < len(s):
            s[k : k + 1] = [] if move == "d" else [rng.randint(1, 60)]
    return s


@pytest.mark.parametrize("shard_items", [60, 2_000_000])
def test_overlap_brute_force(spark, shard_items):
    rng = random.Random(3)
    base = [[rng.randint(1, 60) for _ in range(rng.randint(6, 40))] for _ in range(40)]
    evals = [(i, "valid" if i % 2 else "test", changed(rng, rng.choice(base))) for i in range(80)] + [(900, "test", [1] * 12), (901, "test", []), (902, "valid", [1] * 12)]
    train = []
    for i in range(120):
        h = changed(rng, rng.choice(base))
        train.append((i, h, rng.random() < 0.7))
    train += [(500, [1] * 11, False), (501, [1] * 13, True), (502, [], False)]
    rows = [(i, h, len(h) - 1 if tgt and h else len(h)) for i, h, tgt in train]
    td = spark.createDataFrame(rows, "train_id long, codes array<long>, bare int").repartition(3)
    ed = spark.createDataFrame([(i, s, c) for i, s, c in evals], "eval_id long, split string, codes array<long>")
    links, members = overlap.cross_split_links(td, ed, shard_items=shard_items, block_rows=25)
    got = [(r["train_id"], r["eval_id"]) for r in links.join(members, "class_id").collect()]
    want = {(i, j) for i, h, bare in rows for j, _, e in evals if near(h[:bare], e) or near(h, e)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_index_against_plain_search():
    import numpy as np

    rng = random.Random(9)
    seqs = [[rng.choice((5, 7, 900, -3)) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    ix = overlap.FmIndex.build([np.array(x, np.int64) for x in seqs], np.arange(60))
    ix = overlap.FmIndex.of({k: v for k, v in ix.row().items()})
    text = [x for s in seqs for x in (*s, None)]
    for q in ([5], [5, 7], [7, 900, -3], [5, 5, 5, 5], [900, 7, 7]):
        sym = ix.encode(np.array(q, np.int64))
        lo, hi = np.array([0]), np.array([ix.n])
        for c in sym[::-1]:
            lo, hi = ix.step(np.array([c]), lo), ix.step(np.array([c]), hi)
        got = sorted(ix.locate(np.arange(lo[0], hi[0])).tolist())
        assert got == [i for i in range(len(text)) if text[i : i + len(q)] == q]
    assert ix.encode(np.array([6], np.int64))[0] == -1


def test_codes_without_collisions(spark):
    """Few bits make codes meet under the first seeds; the seed that is returned keeps all items apart."""
    d = spark.createDataFrame([(f"i{k}",) for k in range(12)] * 2 + [(None,)], "item string").filter("item IS NOT NULL")
    seed = common.apart(d, bits=7)
    got = {r["item"]: r["c"] for r in d.select("item", common.hash_code(F.col("item"), seed, 7).alias("c")).collect()}
    assert len(set(got.values())) == 12 and common.apart(d) == 0 == common.apart(d.limit(0))


def test_overlap_empty(spark):
    t = spark.createDataFrame([], "train_id long, codes array<long>, bare int")
    e = spark.createDataFrame([], "eval_id long, split string, codes array<long>")
    links, members = overlap.cross_split_links(t, e)
    assert links.count() == 0 and members.count() == 0


def brute_patterns(users, least, rule):
    support = {}
    for seqs in users.values():
        pats = set()
        for s in seqs:
            for k in range(rule.min_len, rule.max_len + 1):
                for at in itertools.combinations(range(len(s)), k):
                    if rule.max_gap is None or all(b - a <= rule.max_gap + 1 for a, b in zip(at, at[1:])):
                        pats.add(tuple(s[i] for i in at))
        for p in pats:
            support[p] = support.get(p, 0) + 1
    return {p: n for p, n in support.items() if n >= least}


@pytest.mark.parametrize("gap,hot,block", [(None, 5000, 100000), (None, 3, 4), (None, 1, 2), (1, 3, 4), (1, 1, 1), (0, 5000, 100000)])
def test_subsequences_brute_force(spark, gap, hot, block):
    """Also where every entity is hot and every pivot is split."""
    rng = random.Random(5)
    data = [(f"u{rng.randint(0, 11)}" if rng.random() < 0.7 else "hot", [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    users = {}
    for u, s in data:
        users.setdefault(u, []).append(s)
    rule = subsequences.Constraint(max_gap=gap)
    d = spark.createDataFrame([*data, (None, ["a"] * 6), ("x", None), ("y", ["a", None])], "uid string, items array<string>")
    got = {tuple(r["pattern"]): r["support"] for r in subsequences.frequent_subsequences(d, "uid", "items", 4, 0.01, rule, hot, block).collect()}
    want = brute_patterns(users, 4, rule)
    assert got == want and want


def test_subsequences_of_some_items(spark, monkeypatch):
    """Items that may not be put out still count for gaps; a long list of items is joined instead of sent."""
    data = [(f"u{i}", ["a", "x1", "b", "a", "x2", "x2", "c", "b"]) for i in range(6)]
    d = spark.createDataFrame(data, "uid string, items array<string>")
    for small in (True, False):
        monkeypatch.setattr(subsequences, "BROADCAST_ITEMS", 100_000 if small else 0)
        for gap in (None, 1):
            rule = subsequences.Constraint(max_gap=gap, item="^[a-c]$")
            got = {tuple(r["pattern"]) for r in subsequences.frequent_subsequences(d, "uid", "items", 4, 0.0, rule).collect()}
            its = data[0][1]
            want = set()
            for k in (3, 4, 5):
                for at in itertools.combinations(range(len(its)), k):
                    if all(its[i] in "abc" for i in at) and (gap is None or all(q - p <= gap + 1 for p, q in zip(at, at[1:]))):
                        want.add(tuple(its[i] for i in at))
            assert got == want and want


def test_automaton_merges_prefixes():
    tok, size, _ = subsequences.automaton([(1, 2, 3), (1, 2, 4), (1, 5), (1, 2, 3), (6,)])
    assert tok == [1, 2, 3, 4, 5, 6] and size == [5, 3, 1, 1, 1, 1]
    m = subsequences.Transducer(subsequences.Constraint(min_len=2, max_len=3))
    assert m.on_other[4] == -1 and m.on_pivot[4] == 7 and m.final[7] and m.final[5] and not m.final[4] and not m.leads_on(6)


def test_subsequences_empty(spark):
    d = spark.createDataFrame([], "uid string, items array<string>")
    assert subsequences.frequent_subsequences(d, "uid", "items", 4, 0.01).count() == 0


def test_pairs_edge_cases(spark):
    d = spark.createDataFrame([(1, ["b", "a", "a", None]), (2, ["a", "b"]), (3, []), (4, None), (5, ["c"])], "k int, it array<string>")
    got = cooccurrence.item_pairs(d.withColumn("item", F.lit("clash")).withColumn("n", F.lit(1)), ["k"], "it").collect()
    assert [(r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in got] == [("a", "b", 2, 2, 2, 3)]
    assert abs(got[0]["lift"] - 1.5) < 1e-12
    assert cooccurrence.item_pairs(d.limit(0), ["k"], "it").count() == 0


def test_pairs_of_wide_baskets(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, [str(rng.randint(0, 15)) for _ in range(rng.randint(0, 20))]) for i in range(40)]
    d = spark.createDataFrame(data, "k int, it array<string>")
    want = {}
    for _, b in data:
        for x in itertools.combinations(sorted(set(b)), 2):
            want[x] = want.get(x, 0) + 1
    for wide in (1_000, 4):
        monkeypatch.setattr(cooccurrence, "WIDE_BASKET", wide)
        assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in cooccurrence.item_pairs(d, ["k"], "it").collect()} == want


@pytest.mark.parametrize("max_n", [1, 3])
def test_terms_brute_force(spark, max_n):
    rng = random.Random(1)
    recs = [[rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(50)]
    want = {}
    for r in recs:
        seen = set()
        for i in range(len(r)):
            for k in range(1, max_n + 1):
                if i + k <= len(r):
                    g = tuple(r[i : i + k])
                    o, n = want.get(g, (0, 0))
                    want[g] = (o + 1, n + (g not in seen))
                    seen.add(g)
    d = spark.createDataFrame([("f", r) for r in recs] + [("f", None)], "field string, terms array<string>")
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in terms.ngram_counts(d, "field", "terms", max_n).collect()}
    assert got == want
    assert terms.ngram_counts(d.limit(0), "field", "terms", max_n).count() == 0


def test_item_spellings(spark):
    d = spark.createDataFrame([(["<|cid_begin|><s_a_1><s_b_2><s_c_3><|cid_end|>", " <|cid_begin|> <s_a_1>\n<s_b_2>\t<s_c_3> <|cid_end|> ", "<s_a_1><s_b_2>", None, "", "<s_a_1><s_b_2><s_c_3>"],), (None,)], "h array<string>")
    got = [r[0] for r in d.select(common.items(F.col("h"))).collect()]
    assert got == [["<s_a_1><s_b_2><s_c_3>"] * 3, []]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, duck, same_rows, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert same_rows(got) == same_rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    """What holds of any result: rows, no row twice where rows are keyed, shares within bounds."""
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) or name in ("p9_found",)
    for c in ("rate", "fill", "mean_score", "score"):
        if c in got:
            assert got[c].dropna().between(0, 1).all()
    key = {"p7_packing": ["spec", "doc_id", "piece"], "p8_mixture": ["doc_id"], "p9_found": ["doc_id"], "p5_found": ["row_id", "field", "defect"], "p6_found": ["row_id", "field"]}
    if name in key:
        assert not got.duplicated(key[name]).any()
