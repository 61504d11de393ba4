"""Problem 3: frequent subsequences with gaps, by finite-state transducers and weighted automata.

A constraint (lengths, gap, items) is compiled into a transducer whose states count the items put out and whether the
pivot, the pattern's least frequent item, is among them. What it may put out from the sequences of an entity for one
pivot is written as an automaton with merged prefixes: the frequent items that rank no lower than the pivot, as a tree
in preorder with the sizes of its subtrees. Equal automata of different entities merge into one with a weight before
the shuffle by pivot; the transducer then runs over the weighted automata of a pivot and counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Items up to which a list of frequent items is sent to all tasks (some 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ITEMS = 100_000


@dataclass(frozen=True)
class Constraint:
    """Patterns of ``min_len`` to ``max_len`` items that match ``item`` (a regular expression; None: any item); between
    two steps lie at most ``max_gap`` other items of the sequence (None: any number)."""

    min_len: int = 3
    max_len: int = 5
    max_gap: int | None = None
    item: str | None = None


class Transducer:
    """State = 2 * items put out + pivot met. A step reads an item and puts it out; skipped items keep the state."""

    def __init__(self, rule: Constraint):
        self.rule = rule
        n = 2 * (rule.max_len + 1)
        self.on_other, self.on_pivot = [-1] * n, [-1] * n  # -1: no such step
        self.final = [False] * n
        for k in range(rule.max_len + 1):
            for met in (0, 1):
                at = 2 * k + met
                self.final[at] = bool(met) and k >= rule.min_len
                if k < rule.max_len:
                    self.on_pivot[at] = 2 * (k + 1) + 1
                    if met or k + 1 < rule.max_len:  # the last item must be the pivot if none was
                        self.on_other[at] = 2 * (k + 1) + met

    def leads_on(self, state: int) -> bool:
        return self.on_pivot[state] >= 0


def automaton(branches: list[tuple], places: list[tuple] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Tokens, subtree sizes and places of the prefix tree of the distinct branches, in preorder."""
    keys = branches if places is None else [tuple(zip(b, p)) for b, p in zip(branches, places)]
    tok: list[int] = []
    size: list[int] = []
    pos: list[int] = []
    path: list[int] = []  # nodes of the last branch
    last: tuple = ()
    for key in sorted(set(keys)):
        same = 0
        while same < len(last) and same < len(key) and last[same] == key[same]:
            same += 1
        for node in path[same:]:
            size[node] = len(tok) - node
        del path[same:]
        for x in key[same:]:
            path.append(len(tok))
            tok.append(x if places is None else x[0])
            size.append(0)
            if places is not None:
                pos.append(x[1])
        last = key
    for node in path:
        size[node] = len(tok) - node
    return tok, size, pos


def per_pivot(sequences: list, places: list | None, rule: Constraint) -> Iterator[tuple[int, tuple]]:
    """For each pivot of an entity's sequences its automaton, flat: tokens, subtree sizes, places."""
    by_pivot: dict[int, list[int]] = {}
    for i, q in enumerate(sequences):
        for t in set(q):
            by_pivot.setdefault(t, []).append(i)
    for pivot, own in by_pivot.items():
        kept, at = [], []
        for i in own:
            q = sequences[i]
            if places is None:
                cut = tuple(t for t in q if t <= pivot)
                if len(cut) >= rule.min_len:
                    kept.append(cut)
            else:
                pairs = [(t, p) for t, p in zip(q, places[i]) if t <= pivot]
                if len(pairs) >= rule.min_len:
                    begin = pairs[0][1]
                    kept.append(tuple(t for t, _ in pairs))
                    at.append(tuple(p - begin for _, p in pairs))
        if kept:
            tok, size, pos = automaton(kept, at if places is not None else None)
            yield pivot, (*tok, *size, *pos)


class Automata:
    """The automata of a pivot's block side by side; a state is a node, what it can reach lies behind it in one run."""

    def __init__(self, nfas: list, owners: list, weights, pivot: int, rule: Constraint):
        parts = 2 + (rule.max_gap is not None)
        cells = [np.asarray(x, dtype=np.int64).reshape(parts, -1) for x in nfas]
        flat = np.concatenate(cells, axis=1) if cells else np.zeros((parts, 0), np.int64)
        lens = np.array([c.shape[1] for c in cells], np.int64)
        self.machine, self.pivot = Transducer(rule), pivot
        self.tok, self.end = flat[0], np.arange(flat.shape[1]) + flat[1]
        self.pos = flat[2] if parts > 2 else None
        self.starts, self.stops = np.cumsum(lens) - lens, np.cumsum(lens)
        # an owner with several automata here counts once; automata without an owner stand for ``weight`` entities
        named: dict[str, int] = {}
        holder = [named.setdefault(o, len(named)) if o is not None else -1 for o in owners]
        self.names = list(named)
        free = iter(range(len(named), len(named) + len(owners)))
        holder = np.array([h if h >= 0 else next(free) for h in holder], np.int64)
        self.weights = np.zeros(len(named) + len(owners))
        self.weights[holder] = np.where(holder < len(named), 1.0, np.asarray(weights, np.float64))
        self.holder = np.repeat(holder, lens)
        total = np.concatenate(([0], np.cumsum(self.tok == pivot)))
        self.ahead = total[self.end] > total[np.arange(len(self.tok))]  # the pivot is here or behind

    def total(self) -> float:
        return float(self.weights.sum())

    def _reach(self, nodes: np.ndarray | None, met: bool) -> np.ndarray:
        lo, hi = (self.starts, self.stops) if nodes is None else (nodes + 1, self.end[nodes])
        n = hi - lo
        first = np.cumsum(n) - n
        to = np.repeat(lo - first, n) + np.arange(int(n.sum()))
        if nodes is not None and self.pos is not None:
            near = self.pos[to] - np.repeat(self.pos[nodes], n) <= self.machine.rule.max_gap + 1
            to = np.unique(to[near])
        return to if met else to[self.ahead[to]]

    def mine(self, least: float, allowed: set | None = None) -> list[tuple[list[int], np.ndarray]]:
        """Patterns with the pivot whose holders weigh ``least`` or more; ``allowed``: only these and their starts."""
        found: list[tuple[list[int], np.ndarray]] = []
        prefixes = None if allowed is None else {p[:k] for p in allowed for k in range(1, len(p) + 1)}
        stack: list[tuple[tuple, int, np.ndarray | None]] = [((), 0, None)]
        n_holders = max(1, len(self.weights))
        m = self.machine
        ids, rank = np.unique(self.tok, return_inverse=True)
        while stack:
            prefix, state, nodes = stack.pop()
            to = self._reach(nodes, bool(state % 2))
            if m.on_other[state] < 0:
                to = to[self.tok[to] == self.pivot]
            if not len(to):
                continue
            toks = rank[to]
            pairs = np.unique(toks * n_holders + self.holder[to])
            kinds, begin = np.unique(pairs // n_holders, return_index=True)
            holders = pairs % n_holders
            support = np.add.reduceat(self.weights[holders], begin)
            stop = np.append(begin[1:], len(pairs))
            for k, b, e, s in zip(kinds.tolist(), begin.tolist(), stop.tolist(), support.tolist()):
                t = int(ids[k])
                pattern = (*prefix, t)
                if s < least or (prefixes is not None and pattern not in prefixes):
                    continue
                now = m.on_pivot[state] if t == self.pivot else m.on_other[state]
                if m.final[now] and (allowed is None or pattern in allowed):
                    found.append((list(pattern), holders[b:e]))
                if m.leads_on(now):
                    nxt = np.sort(to[toks == k])
                    if self.pos is None:  # a node reaches all that the nodes behind it in its run reach
                        far = np.maximum.accumulate(self.end[nxt])
                        nxt = nxt[np.concatenate(([True], nxt[1:] >= far[:-1]))]
                    stack.append((pattern, now, nxt))
        return found


def _lists(values) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def _encoded(s: DataFrame, ranked: DataFrame, rule: Constraint) -> DataFrame:
    """``entity, seq, places`` (places of the frequent items only where the gap is bounded)."""
    gap = rule.max_gap is not None
    if ranked.count() <= BROADCAST_ITEMS:
        sent = s.sparkSession.sparkContext.broadcast({r["item"]: r["rank"] for r in ranked.select("item", "rank").collect()})

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rank = sent.value
            for pdf in batches:
                seqs = [[rank[x] for x in its if x in rank] for its in pdf["its"]]
                places = [[i for i, x in enumerate(its) if x in rank] for its in pdf["its"]] if gap else [None] * len(seqs)
                keep = [len(q) >= rule.min_len for q in seqs]
                out = pd.DataFrame({"entity": pdf["entity"], "seq": _lists(seqs), "places": _lists(places)})
                yield out[keep]

        return s.filter(F.size("its") >= rule.min_len).mapInPandas(encode, "entity string, seq array<long>, places array<int>")
    cells = (
        s.filter(F.size("its") >= rule.min_len)
        .withColumn("sid", F.monotonically_increasing_id())
        .select("entity", "sid", F.posexplode("its").alias("pos", "item"))
        .join(ranked, "item")
        .groupBy("entity", "sid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("cells"))
        .filter(F.size("cells") >= rule.min_len)
    )
    places = F.col("cells.pos") if gap else F.lit(None).cast("array<int>")
    return cells.select("entity", F.col("cells.rank").alias("seq"), places.alias("places"))


def frequent_subsequences(
    sequences: DataFrame,
    entity: str,
    items: str,
    min_count: int,
    min_share: float,
    rule: Constraint = Constraint(),
    piece_rows: int = 5_000,
    block_rows: int = 50_000,
) -> DataFrame:
    """``pattern array<string>, support`` of the ordered patterns that at least ``max(min_count, min_share * entities)``
    entities hold in one of their sequences.

    Rows with a null entity are left out; null items are no items; null or empty sequences only count their entity;
    an empty table gives no rows; repeated sequences of an entity count once. The result is exact at any skew, also
    where all entities are hot:

    * the sequences of an entity with over ``piece_rows`` of them are split by their hash into pieces of about that
      size; each piece gives automata of its own that carry the entity's name;
    * a pivot with over ``block_rows`` automata is mined in blocks, each with its share (by weight) of the threshold. The
      supports of a pattern in the blocks add up to its support or more, as an entity counts at most once in each, so a
      frequent pattern reaches the share in some block. These candidates are then counted in all blocks, named entities
      once over all of them.
    """
    its = F.array_compact(F.col(items)) if rule.item is None else F.filter(F.col(items), lambda x: x.rlike(rule.item) if rule.max_gap is None else x.isNotNull())
    s = sequences.filter(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.coalesce(its, F.array().cast("array<string>")).alias("its"))
    s = C.kept(s, "sequences")
    least = max(min_count, min_share * s.select("entity").distinct().count())
    sigma = max(1, math.ceil(least - 1e-9))
    # an item in fewer sequences than sigma is in fewer entities, too: most items go before the costlier count
    each = s.select("entity", F.explode(F.array_distinct("its")).alias("item"))
    if rule.item is not None:
        each = each.filter(F.col("item").rlike(rule.item))
    maybe = C.kept(each.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= sigma), "maybe")
    few = F.broadcast(maybe) if maybe.count() <= BROADCAST_ITEMS else maybe
    users = each.join(few, "item", "left_semi").distinct().groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= sigma)
    # ranks grow as items get rarer; sorted partitions give them in order, with holes
    ranked = C.kept(users.orderBy(F.desc("n"), "item").select("item", F.monotonically_increasing_id().alias("rank")), "ranks")
    coded = C.kept(_encoded(s, ranked, rule), "coded")
    pieces = coded.groupBy("entity").agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("pieces")).filter("pieces > 1")
    pieces = C.kept(pieces, "pieces")  # at most sequences / piece_rows entities
    if pieces.count() <= BROADCAST_ITEMS:
        pieces = F.broadcast(pieces)
    cut = coded.join(pieces, "entity", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("seq"), F.col("pieces")), F.lit(-1)))
    by_piece = cut.groupBy("entity", "piece").agg(F.collect_list(F.struct("seq", "places")).alias("seqs"))
    gap = rule.max_gap is not None

    def automata_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for name, piece, rows in zip(pdf["entity"], pdf["piece"], pdf["seqs"]):
                own = {(tuple(int(t) for t in r["seq"]), tuple(int(p) for p in r["places"]) if gap else None) for r in rows}
                seqs = [q for q, _ in own]
                owner = name if piece >= 0 else None
                n.update((pivot, owner, nfa) for pivot, nfa in per_pivot(seqs, [p for _, p in own] if gap else None, rule))
            keys = list(n)
            yield pd.DataFrame({"pivot": [k[0] for k in keys], "owner": _lists(k[1] for k in keys), "nfa": _lists(list(k[2]) for k in keys), "weight": list(n.values())})

    automata = by_piece.mapInPandas(automata_of, "pivot long, owner string, nfa array<long>, weight long")
    automata = C.kept(automata.groupBy("pivot", "owner", "nfa").agg(F.sum("weight").alias("weight")), "automata")
    sizes = automata.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    blocks = automata.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("nfa"), F.col("blocks")).cast("int"))
    # the weight of a block: its entities, named ones once; a share of the threshold needs the sum over the pivot's blocks
    own = blocks.filter("owner IS NOT NULL").select("pivot", "block", "owner").distinct().select("pivot", "block", F.lit(1).cast("long").alias("weight"))
    heavy = blocks.filter("owner IS NULL").select("pivot", "block", "weight").unionByName(own).groupBy("pivot").agg(F.sum("weight").alias("total"))
    blocks = C.kept(blocks.join(heavy.filter(F.col("total") >= sigma), "pivot"), "blocks")

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        a = Automata(list(pdf["nfa"]), list(pdf["owner"]), pdf["weight"], int(pdf["pivot"].iloc[0]), rule)
        got = a.mine(sigma * a.total() / float(pdf["total"].iloc[0]) - 1e-6)
        return pd.DataFrame(
            {"pivot": int(pdf["pivot"].iloc[0]), "blocks": int(pdf["blocks"].iloc[0]), "codes": _lists(p for p, _ in got), "support": [int(round(a.weights[h].sum())) for _, h in got]}
        )

    first = C.kept(blocks.groupBy("pivot", "block").applyInPandas(mine, "pivot long, blocks int, codes array<long>, support long"), "patterns")
    split = first.filter("blocks > 1").select("pivot", "codes").distinct()

    def counted(own_: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        """Weights of automata without an owner, and a row for each owner that holds the pattern."""
        codes, owners, n = [], [], []
        if len(own_) and len(cands):
            a = Automata(list(own_["nfa"]), list(own_["owner"]), own_["weight"], int(own_["pivot"].iloc[0]), rule)
            for p, h in a.mine(0.5, {tuple(int(x) for x in c) for c in cands["codes"]}):
                named = h < len(a.names)
                plain = int(round(a.weights[h[~named]].sum()))
                for o, w in [(None, plain)] * (plain > 0) + [(a.names[i], 1) for i in h[named]]:
                    codes.append(p), owners.append(o), n.append(w)
        return pd.DataFrame({"codes": _lists(codes), "owner": _lists(owners), "n": n})

    where = C.again(blocks).filter("blocks > 1").select("pivot", "block").distinct()
    again = (
        blocks.filter("blocks > 1")
        .groupBy("pivot", "block")
        .cogroup(split.join(where, "pivot").groupBy("pivot", "block"))
        .applyInPandas(counted, "codes array<long>, owner string, n long")
        .groupBy("codes", "owner")
        .agg(F.sum("n").alias("n"))  # a named entity stands in several blocks
        .groupBy("codes")
        .agg(F.sum(F.when(F.col("owner").isNull(), F.col("n")).otherwise(1)).alias("support"))
    )
    frequent = first.filter("blocks = 1").select("codes", "support").unionByName(again).filter(F.col("support") >= sigma)
    named = (
        frequent.select("codes", "support", F.posexplode("codes").alias("_p", "rank"))
        .join(ranked, "rank")
        .groupBy("codes", "support")
        .agg(F.array_sort(F.collect_list(F.struct("_p", "item"))).alias("_i"))
    )
    return named.select(F.col("_i.item").alias("pattern"), "support")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.table(spark, sf_dir, "train_cid2cid").select("uid", C.items(F.col("hist_sid")).alias("items"))
    return frequent_subsequences(t, "uid", "items", min_count=4, min_share=0.01)


def _text(pattern):
    return F.array_join(F.transform(pattern, C.canonical), " ")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).select(_text(F.col("pattern")).alias("pattern"))


def p3_pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).select(_text(F.col("pattern")).alias("pattern"), "support")


_SQL = r"""
WITH t AS (
  SELECT row_id, uid, list_filter(list_transform(hist_sid, lambda x: regexp_replace(
    regexp_extract(x, '<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>'), '\s+', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS it
  FROM train_cid2cid WHERE uid IS NOT NULL
), lim AS (SELECT greatest(4, ceil(0.01 * count(DISTINCT uid) - 1e-9)) AS s FROM t),
e0 AS (SELECT row_id, uid, unnest(range(1, len(it) + 1)) AS p, unnest(it) AS x FROM t),
f1 AS (SELECT x FROM e0 GROUP BY x HAVING count(DISTINCT uid) >= (SELECT s FROM lim)),
e AS (SELECT row_id, uid, p, '<|cid_begin|>' || x || '<|cid_end|>' AS x FROM e0 SEMI JOIN f1 USING (x)),
l1 AS (SELECT row_id, uid, x AS pat, min(p) AS p FROM e GROUP BY ALL),
"""
for _k in (2, 3, 4, 5):  # the leftmost end of each pattern in each row, then only frequent patterns
    _SQL += f"""r{_k} AS (SELECT a.row_id, a.uid, a.pat || ' ' || e.x AS pat, min(e.p) AS p FROM l{_k - 1} a JOIN e ON a.row_id = e.row_id AND e.p > a.p GROUP BY ALL),
f{_k} AS (SELECT pat, count(DISTINCT uid) AS support FROM r{_k} GROUP BY pat HAVING count(DISTINCT uid) >= (SELECT s FROM lim)),
l{_k} AS (SELECT r{_k}.* FROM r{_k} SEMI JOIN f{_k} USING (pat)),
"""
_SQL += "f AS (SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5)\n"
SQL = {"p3_found": _SQL + "SELECT pat AS pattern FROM f", "p3_pattern_support": _SQL + "SELECT pat AS pattern, support FROM f"}
QUERIES = {"p3_found": p3_found, "p3_pattern_support": p3_pattern_support}
