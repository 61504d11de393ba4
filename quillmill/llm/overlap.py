"""Problem 1: the same or almost the same records across splits, by a compressed full-text index.

Evaluation sequences are deduplicated, put into shards of bounded size and indexed (FM-index: the Burrows-Wheeler
transform as runs with counts, and a sampled suffix array). Training sequences stream through backward search; the
left-maximal matches of a seed length are extended to maximal matches, their spans are merged to the longest one of each
pair of sequences, and pairs whose span allows few enough edits are checked by their edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: With at least 8 items and floor(n/5) edits, some 3 neighbouring items stay as they are: the n - k unedited items of
#: the longer sequence stand in at most k + 1 runs, and ceil((n - floor(n/5)) / (floor(n/5) + 1)) >= 3 for n >= 8.
SEED = 3


SAMPLE = 8  # every so many places of the text the suffix array is kept


class FmIndex:
    """Compressed index over sequences of 64-bit codes: the runs of the Burrows-Wheeler transform with the counts before
    them, every eighth place of the suffix array and the starts of sequences, and the text in its smallest type for
    extending matches. Near copies make long runs. No match goes over the end of a sequence."""

    PARTS = ("vocab", "text", "run", "sym", "srow", "sval", "seq_start", "ids")

    def __init__(self, vocab, text, run, sym, srow, sval, seq_start, ids):
        self.vocab, self.text, self.run, self.sym = vocab, text, run, sym
        self.srow, self.sval, self.seq_start, self.ids = srow, sval, seq_start.astype(np.int64), ids
        self.n = len(text)
        size = np.diff(np.append(run.astype(np.int64), self.n))
        by = np.argsort(sym, kind="stable")
        self.start, self.size = run[by].astype(np.int64), size[by]
        self.keys = sym[by].astype(np.int64) * (self.n + 1) + self.start
        self.before = np.concatenate(([0], np.cumsum(self.size)))  # smaller symbols, and the same one in runs before
        self.first = self.before[np.searchsorted(self.keys, np.arange(len(vocab) + 2, dtype=np.int64) * (self.n + 1))]

    @staticmethod
    def build(codes: list[np.ndarray], ids: np.ndarray) -> "FmIndex":
        lens = np.array([len(c) for c in codes], dtype=np.int64)
        vocab, flat = np.unique(np.concatenate(codes), return_inverse=True)
        ends = np.cumsum(lens + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, dtype=np.min_scalar_type(len(vocab) + 1))  # 0: end of a sequence; item i of the vocabulary: i + 1
        body = np.ones(n, dtype=bool)
        body[ends] = False
        text[body] = flat + 1
        rank = text.astype(np.int64) + len(ends) - 1
        rank[ends] = np.arange(len(ends))  # ends differ, so doubling stops after the longest sequence
        k, longest = 1, int(lens.max()) + 1
        while k < longest:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (n + len(vocab) + 2) + nxt
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
            rank[order] = new
            if new[-1] == n - 1:
                break
            k *= 2
        sa = np.argsort(rank, kind="stable")
        bwt = text[sa - 1]  # the row of place 0 takes the last separator
        run = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        srow = np.flatnonzero((sa % SAMPLE == 0) | (bwt == 0))  # ends do not follow the order of what is behind them
        seq_start = np.concatenate(([0], ends[:-1] + 1))
        return FmIndex(vocab, text, run.astype(np.int32), bwt[run], srow.astype(np.int32), sa[srow].astype(np.int32), seq_start, ids)

    def row(self) -> dict:
        small = {"text_type": self.text.dtype.str, "seq_start": self.seq_start.astype(np.int32), "ids": self.ids.astype(np.int64)}
        return {p: (small.get(p, getattr(self, p))).tobytes() for p in self.PARTS} | {"text_type": small["text_type"]}

    @staticmethod
    def of(row: dict) -> "FmIndex":
        kinds = {"vocab": np.int64, "ids": np.int64, "text": row["text_type"], "sym": row["text_type"]}
        return FmIndex(*[np.frombuffer(row[p], kinds.get(p, np.int32)) for p in FmIndex.PARTS])

    def encode(self, flat: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, flat), len(self.vocab) - 1)
        return np.where(self.vocab[at] == flat, at + 1, -1).astype(np.int64)

    def step(self, c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Backward step of interval ends: smaller symbols, and c in the rows before; one search in the sorted runs."""
        at = np.searchsorted(self.keys, c * (self.n + 1) + rows)
        p = np.maximum(at - 1, 0)
        inside = (at > 0) & (self.keys[p] >= c * (self.n + 1))
        return np.where(inside, self.before[p] + np.minimum(rows - self.start[p], self.size[p]), self.before[at])

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        return self.sym[np.searchsorted(self.run, rows, side="right") - 1].astype(np.int64)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the text: steps back to a row whose place is kept."""
        out = np.zeros(len(rows), np.int64)
        live, at, back = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            k = np.minimum(np.searchsorted(self.srow, at), len(self.srow) - 1)
            hit = self.srow[k] == at
            out[live[hit]] = self.sval[k[hit]] + back
            live, at = live[~hit], at[~hit]
            at = self.step(self.symbol(at), at)
            back += 1
        return out

    def seeds(self, sym: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place that ends a match of SEED symbols (``left``: symbols before it in its sequence): the place
        and its interval."""
        j = np.flatnonzero((sym > 0) & (left >= SEED - 1))
        c = sym[j]
        ok = np.ones(len(j), dtype=bool)
        for d in range(1, SEED):
            ok &= sym[j - d] > 0
        j = j[ok]
        c = sym[j]
        lo, hi = self.first[c], self.first[c + 1]
        for d in range(1, SEED):
            c = sym[j - d]
            lo, hi = self.step(c, lo), self.step(c, hi)
            some = lo < hi
            j, lo, hi = j[some], lo[some], hi[some]
        return j, lo, hi


def _ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    first = np.cumsum(n) - n
    return np.repeat(lo - first, n) + np.arange(int(n.sum()))


def edit_distances(e: np.ndarray, b: np.ndarray, le: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distances of row pairs: ``out[r, j]`` between e[r, :le[r]] and b[r, :j], rows padded on the right."""
    n, width = b.shape
    cols = np.arange(width + 1)
    d = np.broadcast_to(cols, (n, width + 1)).astype(np.int32).copy()
    out = d.copy()
    for i in range(1, e.shape[1] + 1):
        sub = d[:, :-1] + (e[:, i - 1 : i] != b)
        new = np.empty_like(d)
        new[:, 0] = i
        np.minimum(sub, d[:, 1:] + 1, out=new[:, 1:])
        d = np.minimum.accumulate(new - cols, axis=1) + cols
        done = le == i
        out[done] = d[done]
    return out


def _padded(flat: np.ndarray, start: np.ndarray, length: np.ndarray, fill: int) -> np.ndarray:
    width = int(length.max())
    at = start[:, None] + np.arange(width)
    inside = np.arange(width) < length[:, None]
    return np.where(inside, flat[np.minimum(at, len(flat) - 1)], fill)


def _allowed(n):
    return n // 5


def search_block(ix: FmIndex, flat: np.ndarray, start: np.ndarray, length: np.ndarray, bare: np.ndarray, least: int, hits_at_once: int = 2_000_000):
    """Pairs (sequence of the block, indexed sequence) within the distance. ``bare``: length without the target."""
    sym = ix.encode(flat)
    left = np.arange(len(flat)) - np.repeat(start, length)
    j, lo, hi = ix.seeds(sym, left)
    seq_of = np.repeat(np.arange(len(start)), length)
    width = hi - lo
    # blocks of places by the width of their intervals: memory stays bounded when a run of items is everywhere
    cut = np.searchsorted(np.cumsum(width), np.arange(hits_at_once, int(width.sum()) + hits_at_once, hits_at_once))
    got_a, got_e = [], []
    for b0, b1 in zip(np.concatenate(([0], cut[:-1] + 1)), cut + 1):
        jj, ww = j[b0:b1], width[b0:b1]
        if not len(jj):
            continue
        rows = _ragged(lo[b0:b1], ww)
        t = np.repeat(jj, ww) - (SEED - 1)  # start in the training text
        # left-maximal: the symbols before differ, or a sequence begins
        before = np.where(left[t] > 0, sym[t - 1], -2)
        maximal = before != ix.symbol(rows)
        t, p = t[maximal], ix.locate(rows[maximal])  # start in the indexed text
        a = seq_of[t]
        e = np.searchsorted(ix.seq_start, p, side="right") - 1
        ends = np.concatenate((ix.seq_start[1:], [ix.n])) - 1
        size = np.full(len(t), SEED)
        live = np.flatnonzero((t + SEED < start[a] + length[a]) & (p + SEED < ends[e]))
        while len(live):  # to the right as far as the match goes
            live = live[sym[t[live] + size[live]] == ix.text[p[live] + size[live]]]
            size[live] += 1
            live = live[(t[live] + size[live] < (start + length)[a[live]]) & (p[live] + size[live] < ends[e[live]])]
        # spans of a pair: the longest one is left
        key = a * len(ix.ids) + e
        order = np.argsort(key, kind="stable")
        key, size = key[order], size[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        if not len(at):
            continue
        run, key = np.maximum.reduceat(size, at), key[at]
        a, e = key // len(ix.ids), key % len(ix.ids)
        le = ends[e] - ix.seq_start[e]
        fits = np.zeros(len(a), dtype=bool)
        for la in (bare[a], length[a]):
            n = np.maximum(la, le)
            k = _allowed(n)
            fits |= (la >= least) & (le >= least) & (np.abs(la - le) <= k) & (run * (k + 1) >= n - k)
        got_a.append(a[fits])
        got_e.append(e[fits])
    if not got_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(got_a) * len(ix.ids) + np.concatenate(got_e))
    a, e = pair // len(ix.ids), pair % len(ix.ids)
    ends = np.concatenate((ix.seq_start[1:], [ix.n])) - 1
    keep = []
    for i in range(0, len(a), 20_000):
        x, y = a[i : i + 20_000], e[i : i + 20_000]
        le, lb, la = ends[y] - ix.seq_start[y], length[x], bare[x]
        d = edit_distances(_padded(ix.text, ix.seq_start[y], le, -3), _padded(sym, start[x], lb, -4), le, lb)
        r = np.arange(len(x))
        near = np.zeros(len(x), dtype=bool)
        for n in (la, lb):
            near |= (n >= least) & (d[r, n] <= _allowed(np.maximum(n, le)))
        keep.append(near)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return a[keep], e[keep]


class _Block:
    """Training sequences of a task in one flat array, equal ones once."""

    def __init__(self, t: pa.Table):
        lists = t["codes"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        offs = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        lens, start = np.diff(offs), offs[:-1]
        bare = t["bare"].to_numpy().astype(np.int64)
        self.ids = t["train_id"].to_numpy()
        # equal sequences side by side: by length and a content hash, then compared in full with the one before
        own = flat[offs[0] : offs[-1]].view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
        place = (np.arange(len(own)) - np.repeat(start - offs[0], lens)).astype(np.uint64)
        mixed = (own ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        tot = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        rel = offs - offs[0]
        mix = tot[rel[1:]] - tot[rel[:-1]]
        order = np.lexsort((mix, bare, lens))
        n, x, y = lens[order], order[1:], order[:-1]
        same = (lens[x] == lens[y]) & (bare[x] == bare[y]) & (mix[x] == mix[y])
        k = np.flatnonzero(same)
        at = _ragged(start[x[k]], n[1:][k])
        unequal = np.zeros(len(k), bool)
        np.logical_or.at(unequal, np.repeat(np.arange(len(k)), n[1:][k]), flat[at] != flat[_ragged(start[y[k]], n[1:][k])])
        same[k[unequal]] = False
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        first = order[begin]
        self.length, self.bare = lens[first], bare[first]
        self.flat = flat[_ragged(start[first], self.length)]
        self.start = np.cumsum(self.length) - self.length
        self.order, self.begin, self.count = order, begin, np.diff(np.append(begin, len(order)))

    def links(self, ix: FmIndex, least: int) -> pa.RecordBatch:
        a, e = search_block(ix, self.flat, self.start, self.length, self.bare, least)
        n = self.count[a]
        ids = self.ids[self.order[_ragged(self.begin[a], n)]] if len(a) else self.ids[:0]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.repeat(ix.ids[e], n), pa.int64())], names=["train_id", "class_id"])


_LINK = "train_id long, class_id long"


def _seed_hashes(codes):
    """Distinct hashes of the runs of SEED items."""
    at = F.sequence(F.lit(0), F.size(codes) - SEED)
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(codes, i + d) for d in range(SEED)])))


def cross_split_links(
    train: DataFrame, evaluation: DataFrame, least: int = 8, shard_items: int = 2_000_000, block_rows: int = 40_000
) -> tuple[DataFrame, DataFrame]:
    """Links ``(train_id, class_id)`` and membership ``(class_id, eval_id, split)``.

    ``train``: ``train_id, codes array<long>, bare int`` (codes of the history, then of the target; ``bare`` counts the
    history's); ``evaluation``: ``eval_id, split, codes``. Equal evaluation sequences form a class, indexed once; equal
    training sequences of a block are searched once. Sequences under ``least`` items can't be cases; nulls must have
    been dropped; empty tables give no links. Items are compared by their codes.

    Evaluation shards hold about ``shard_items`` items, so they grow in number with the table; then a training sequence
    goes to those shards only that hold one of its runs of three items (no case lacks such a run), found by a join of
    their hashes. A task holds one shard and about ``block_rows`` training rows; a shard that many rows ask for has many
    tasks. Work follows the rows and their matches, not the product of both tables. The index lies in the shared folder.
    """
    spark = train.sparkSession
    ev = evaluation.filter(F.size("codes") >= least)
    classes = ev.groupBy("codes").agg(F.min("eval_id").alias("class_id"))
    members = C.kept(ev.join(classes, "codes").select("class_id", "eval_id", "split"), "members")
    classes = C.kept(classes, "classes")
    total = classes.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    if not total:
        return spark.createDataFrame([], _LINK), members
    shards = max(1, -(-int(total) // shard_items))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        ix = FmIndex.build(list(pdf["codes"]), pdf["class_id"].to_numpy())
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **ix.row()}])

    # sequences meet by one of their runs of three, so that near copies mostly lie in one shard; a crowded one is split
    sharded = classes.withColumn("near", F.pmod(F.array_min(_seed_hashes(F.col("codes"))), F.lit(shards)).cast("int"))
    wide = sharded.groupBy("near").agg(F.ceil(F.sum(F.size("codes") + 1) / (2 * shard_items)).cast("int").alias("parts"))
    sharded = sharded.join(wide, "near").withColumn("shard", F.col("near") + shards * F.pmod(F.xxhash64("codes"), F.col("parts")).cast("int"))
    sharded = C.kept(sharded.select("class_id", "codes", "shard"), "sharded")
    parts = ", ".join(f"{p} binary" for p in FmIndex.PARTS)
    built = C.kept(sharded.groupBy("shard").applyInPandas(index, f"shard int, {parts}, text_type string"), "index")
    path = built._kept_path

    def load(shard: int) -> FmIndex:
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, sub = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        found = ds.dataset(sub, filesystem=where, format="parquet").to_table(filter=ds.field("shard") == shard)
        return FmIndex.of(found.slice(0, 1).to_pylist()[0])

    rows = train.filter(F.size("codes") >= least).select("train_id", "codes", "bare")
    if shards == 1:

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, waiting, n = None, [], 0

            def flush():
                return _Block(pa.Table.from_batches(waiting)).links(ix, least)

            for b in batches:
                if b.num_rows:
                    ix = ix or load(0)
                    waiting.append(b)
                    n += b.num_rows
                if n >= block_rows:
                    yield flush()
                    waiting, n = [], 0
            if n:
                yield flush()

        return rows.mapInArrow(stream, _LINK), members

    asked = C.kept(sharded.select("shard", F.explode(_seed_hashes(F.col("codes"))).alias("seed")).distinct(), "seeds")
    routed = rows.select("train_id", F.explode(_seed_hashes(F.col("codes"))).alias("seed")).join(asked, "seed").select("train_id", "shard").distinct()
    routed = C.kept(routed, "routed")
    wide = routed.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))  # a row per shard
    goes = routed.join(wide, "shard").withColumn("part", F.pmod(F.xxhash64("train_id"), F.col("parts")).cast("int"))

    def search(key, t):
        return pa.Table.from_batches([_Block(t).links(load(key[0].as_py()), least)])

    links = rows.join(goes.select("train_id", "shard", "part"), "train_id").groupBy("shard", "part").applyInArrow(search, _LINK)
    return links, members


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    goal = F.filter(F.array(C.item_core(F.col("target_sid"))), lambda x: x != "")  # [] where there is none
    train = C.table(spark, sf_dir, "train_cid2cid").select(F.col("row_id").alias("train_id"), C.items(F.col("hist_sid")).alias("h"), goal.alias("g"))
    parts = [
        C.table(spark, sf_dir, f"{s}_cid2cid").select(F.col("row_id").alias("eval_id"), F.lit(s).alias("split"), C.items(F.col("hist_sid")).alias("h"))
        for s in ("valid", "test")
    ]
    evaluation = parts[0].unionByName(parts[1])
    each = train.select(F.explode(F.concat("h", F.coalesce("g", F.array().cast("array<string>")))).alias("item")).unionByName(evaluation.select(F.explode("h").alias("item")))
    seed = C.apart(each)
    codes = lambda x: F.transform(x, lambda i: C.hash_code(i, seed))
    train = train.select("train_id", codes(F.concat("h", F.coalesce("g", F.array().cast("array<string>")))).alias("codes"), F.size("h").alias("bare"))
    return train, evaluation.select("eval_id", "split", codes(F.col("h")).alias("codes"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = cross_split_links(*_sides(spark, sf_dir))
    return links.join(members, "class_id").select("split", F.col("train_id").alias("train_row_id"), F.col("eval_id").alias("eval_row_id"))


def p1_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and source: its evaluation rows, and those that training rows repeat (links are not expanded)."""
    links, members = cross_split_links(*_sides(spark, sf_dir))
    linked = links.groupBy("class_id").agg(F.count("*").alias("n_train"))
    hit = members.join(linked, "class_id").select("eval_id", "split", "n_train")
    ev = [C.table(spark, sf_dir, f"{s}_cid2cid").select(F.col("row_id").alias("eval_id"), F.lit(s).alias("split"), "source_dataset") for s in ("valid", "test")]
    rows = ev[0].unionByName(ev[1]).join(hit, ["eval_id", "split"], "left")
    return rows.groupBy("split", "source_dataset").agg(
        F.count("*").alias("eval_rows"),
        F.count("n_train").alias("overlapping_rows"),
        F.coalesce(F.sum("n_train"), F.lit(0)).alias("links"),
    )


_SQL = r"""
WITH tr AS (SELECT row_id, list_filter(list_transform(hist_sid, lambda x: regexp_replace(regexp_extract(x, '<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>'), '\s+', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS a,
  regexp_replace(regexp_extract(coalesce(target_sid, ''), '<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>'), '\s+', '', 'g') AS g FROM train_cid2cid WHERE hist_sid IS NOT NULL),
tn AS (SELECT row_id, a AS s FROM tr UNION ALL SELECT row_id, list_append(a, g) FROM tr WHERE g <> ''),
ts AS (SELECT row_id, s FROM tn WHERE len(s) >= 8),
es AS (SELECT * FROM (SELECT 'valid' AS split, source_dataset, row_id, list_filter(list_transform(hist_sid, lambda x: regexp_replace(regexp_extract(x, '<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>'), '\s+', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS s FROM valid_cid2cid
  UNION ALL SELECT 'test', source_dataset, row_id, list_filter(list_transform(hist_sid, lambda x: regexp_replace(regexp_extract(x, '<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>'), '\s+', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS s FROM test_cid2cid)
  WHERE len(s) >= 8),
td AS (SELECT DISTINCT s FROM ts), ed AS (SELECT DISTINCT s FROM es),
tg AS (SELECT DISTINCT s, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || s[i + 1] || s[i + 2])) AS g FROM td),
eg AS (SELECT DISTINCT s, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || s[i + 1] || s[i + 2])) AS g FROM ed),
cand AS (SELECT DISTINCT t.s AS t, e.s AS e FROM tg t JOIN eg e USING (g)),
near AS (SELECT t, e FROM cand WHERE abs(len(t) - len(e)) <= greatest(len(t), len(e)) // 5 AND levenshtein(
  array_to_string(list_transform(e, lambda x: chr((35 + list_position(e, x))::INTEGER)), ''),
  array_to_string(list_transform(t, lambda x: chr((35 + coalesce(list_position(e, x), 0))::INTEGER)), '')) <= greatest(len(t), len(e)) // 5),
f AS (SELECT DISTINCT es.split, es.source_dataset, ts.row_id AS train_row_id, es.row_id AS eval_row_id FROM near JOIN ts ON ts.s = near.t JOIN es ON es.s = near.e)
"""
SQL = {
    "p1_found": _SQL + "SELECT split, train_row_id, eval_row_id FROM f",
    "p1_overlap_report": _SQL
    + """, n AS (SELECT split, eval_row_id, count(*) AS k FROM f GROUP BY ALL),
ev AS (SELECT 'valid' AS split, row_id, source_dataset FROM valid_cid2cid UNION ALL SELECT 'test', row_id, source_dataset FROM test_cid2cid)
SELECT ev.split, ev.source_dataset, count(*) AS eval_rows, count(k) AS overlapping_rows, coalesce(sum(k), 0)::BIGINT AS links
FROM ev LEFT JOIN n ON n.split = ev.split AND n.eval_row_id = ev.row_id GROUP BY ev.split, ev.source_dataset""",
}
QUERIES = {"p1_found": p1_found, "p1_overlap_report": p1_overlap_report}
