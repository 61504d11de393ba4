"""Problem 7: filling fixed-capacity containers, by a grouping genetic algorithm on islands.

Documents fall into blocks of bounded size. Each block is packed by several islands: crossover injects whole
well-filled containers of the other parent, takes out containers with doubles and best-fits the displaced documents;
elites migrate along a ring of islands between epochs. Poorly filled containers of all blocks are then packed anew.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import TOKENIZER, with_tokens

ELITES = 2


class Packing:
    """Containers as lists of item places, with their free space."""

    __slots__ = ("bins", "free", "fitness")

    def __init__(self, bins: list[list[int]], free: list[int], capacity: int):
        self.bins, self.free = bins, free
        fill = 1 - np.asarray(free, dtype=np.float64) / capacity
        self.fitness = float((fill * fill).mean()) if free else 1.0


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Puts items, largest first, into the fullest container that has room, else a new one."""
    order = sorted((f, k) for k, f in enumerate(free))
    for i in sorted(items, key=lambda i: -sizes[i]):
        s = sizes[i]
        at = bisect.bisect_left(order, (s, -1))
        if at < len(order):
            f, k = order.pop(at)
            bins[k].append(i)
        else:
            f, k = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[k] = f - s
        bisect.insort(order, (f - s, k))


def fresh(sizes: list[int], capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    keys = [s * (1 + noise * x) for s, x in zip(sizes, rng.random(len(sizes)))] if noise else sizes
    bins: list[list[int]] = []
    free: list[int] = []
    order: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -keys[i]):
        s = sizes[i]
        at = bisect.bisect_left(order, (s, -1))
        if at < len(order):
            f, k = order.pop(at)
            bins[k].append(i)
        else:
            f, k = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[k] = f - s
        bisect.insort(order, (f - s, k))
    return Packing(bins, free, capacity)


def _nearest(values: list[int], low: int, high: int) -> int:
    """Place of the largest value within (low, high] of a sorted list, else -1."""
    k = bisect.bisect_right(values, high) - 1
    return k if k >= 0 and values[k] > low else -1


def exchange(loose: list[int], sizes: list[int], bins: list[list[int]], free: list[int]) -> list[int]:
    """Swaps one or two items of a container for a loose item, or one for two, where that fills it better; returns what is loose then.

    Larger items get a place this way and smaller ones, which are easier to place, come loose."""
    order = sorted(loose, key=lambda i: sizes[i])
    values = [sizes[i] for i in order]

    def put(i: int) -> None:
        k = bisect.bisect_left(values, sizes[i])
        values.insert(k, sizes[i])
        order.insert(k, i)

    for k, own in enumerate(bins):
        if not free[k] or not order:
            continue
        best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None  # space gained, places loose, items out
        n = len(own)
        outs = [(i,) for i in own] + ([(own[x], own[y]) for x in range(n) for y in range(x + 1, n)] if n <= 12 else [])
        for out in outs:
            low = sum(sizes[i] for i in out)
            high = low + free[k]
            at = _nearest(values, low, high)
            if at >= 0 and (best is None or values[at] - low > best[0]):
                best = (values[at] - low, (at,), out)
            x, y = 0, len(values) - 1
            while x < y and len(values) <= 200:
                t = values[x] + values[y]
                if t > high:
                    y -= 1
                else:
                    if t > low and (best is None or t - low > best[0]):
                        best = (t - low, (x, y), out)
                    x += 1
        if best:
            gain, places, out = best
            into = [order[p] for p in places]
            for p in sorted(places, reverse=True):
                del values[p], order[p]
            bins[k] = [i for i in own if i not in out] + into
            free[k] -= gain
            for i in out:
                put(i)
    return order


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Child of ``a`` with well-filled containers of ``b``."""
    order = sorted(range(len(b.bins)), key=lambda k: b.free[k])
    top = order[: max(1, len(order) // 2)]
    start = int(rng.integers(0, len(top)))
    injected = top[start : start + max(1, int(rng.integers(1, max(2, len(top) // 4 + 1))))]
    taken = {i for k in injected for i in b.bins[k]}
    bins = [list(b.bins[k]) for k in injected]
    free = [b.free[k] for k in injected]
    loose: list[int] = []
    for k, own in enumerate(a.bins):
        if taken.isdisjoint(own):
            bins.append(list(own))
            free.append(a.free[k])
        else:
            loose += [i for i in own if i not in taken]
    loose = exchange(loose, sizes, bins, free)
    best_fit(loose, sizes, bins, free, capacity)
    return Packing(bins, free, capacity)


def shake(a: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Empties the worst containers and some others, and best-fits what they held."""
    worst = sorted(range(len(a.bins)), key=lambda k: -a.free[k])[: max(2, len(a.bins) // 50)]
    out = set(worst) | set(rng.integers(0, len(a.bins), max(1, len(a.bins) // 50)).tolist())
    bins = [list(x) for k, x in enumerate(a.bins) if k not in out]
    free = [f for k, f in enumerate(a.free) if k not in out]
    loose = exchange([i for k in out for i in a.bins[k]], sizes, bins, free)
    best_fit(loose, sizes, bins, free, capacity)
    return Packing(bins, free, capacity)


def evolve(sizes: list[int], capacity: int, start: list[Packing], seed: int, population: int = 6, generations: int = 16) -> list[Packing]:
    """The elites after some generations, best first; stops where no container could be saved any more."""
    rng = np.random.default_rng(seed)
    pop = list(start)
    if not start:
        pop.append(fresh(sizes, capacity, rng, 0.0))
    least = -(-sum(sizes) // capacity)
    while len(pop) < population and len(pop[0].bins) > least:
        pop.append(fresh(sizes, capacity, rng, float(rng.uniform(0.02, 0.5))))
    pop.sort(key=lambda p: (len(p.bins), -p.fitness))
    for _ in range(generations):
        if len(pop) < 2 or len(pop[0].bins) <= least:
            break
        children = []
        for _ in range(max(1, population // 2)):
            i, j = sorted(rng.choice(len(pop), 2, replace=False).tolist())
            child = cross(pop[i], pop[j], sizes, capacity, rng)
            if rng.random() < 0.5:
                child = shake(child, sizes, capacity, rng)
            children.append(child)
        pop = sorted(pop + children, key=lambda p: (len(p.bins), -p.fitness))[:population]
    return pop[:ELITES]


def _of(bin_of: np.ndarray, sizes: list[int], capacity: int) -> Packing:
    n = int(bin_of.max()) + 1 if len(bin_of) else 0
    bins: list[list[int]] = [[] for _ in range(n)]
    free = [capacity] * n
    for i, k in enumerate(bin_of.tolist()):
        bins[k].append(i)
        free[k] -= sizes[i]
    return Packing(bins, free, capacity)


def _bin_of(p: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for k, own in enumerate(p.bins):
        out[own] = k
    return out


_KEY = ["spec", "block", "island"]
_SCHEMA = "spec string, capacity int, block int, island int, role int, doc_id long, piece int, size int, bins array<int>"


def _epoch(pdf: pd.DataFrame) -> pd.DataFrame:
    """One epoch of one island; rows of role 0 are its own, those of role 1 came from its neighbour."""
    pdf = pdf.sort_values(["role", "doc_id", "piece"], kind="stable")
    own = pdf[pdf["role"] == pdf["role"].min()]
    sizes, capacity = own["size"].astype(int).tolist(), int(own["capacity"].iloc[0])
    start = []
    for _, part in pdf.groupby("role"):
        told = list(part["bins"])
        for e in range(len(told[0]) if told[0] is not None else 0):
            start.append(_of(np.array([b[e] for b in told], dtype=np.int64), sizes, capacity))
    block, island = int(own["block"].iloc[0]), int(own["island"].iloc[0])
    got = evolve(sizes, capacity, start, seed=1_000_003 * block + 101 * island + capacity + len(start))
    each = np.stack([_bin_of(p, len(own)) for p in got], axis=1)
    out = own[["spec", "capacity", "block", "island", "doc_id", "piece", "size"]].copy()
    out["role"] = 0
    out["bins"] = [r.tolist() for r in each]
    return out[["spec", "capacity", "block", "island", "role", "doc_id", "piece", "size", "bins"]]


_PACKED = "spec string, capacity int, block int, doc_id long, piece int, size int, bin int, fill double"


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block packed by best fit, largest first, and whether no packing could take fewer containers."""
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
    sizes, capacity = pdf["size"].astype(int).tolist(), int(pdf["capacity"].iloc[0])
    p = fresh(sizes, capacity, np.random.default_rng(0), 0.0)
    out = pdf[["spec", "capacity", "block", "doc_id", "piece", "size"]].copy()
    out["bin"] = _bin_of(p, len(pdf))
    out["fill"] = [1 - p.free[k] / capacity for k in out["bin"]]
    out["tight"] = len(p.bins) <= -(-sum(sizes) // capacity)
    return out


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best packing of a block's islands, with the fill of each item's container."""
    best = None
    for _, part in pdf.sort_values(["island", "doc_id", "piece"], kind="stable").groupby("island"):
        sizes, capacity = part["size"].astype(int).tolist(), int(part["capacity"].iloc[0])
        p = _of(np.array([b[0] for b in part["bins"]], dtype=np.int64), sizes, capacity)
        if best is None or (len(p.bins), -p.fitness) < best[0]:
            best = ((len(p.bins), -p.fitness), part, p)
    _, part, p = best
    at = _bin_of(p, len(part))
    out = part[["spec", "capacity", "block", "doc_id", "piece", "size"]].copy()
    out["bin"] = at
    out["fill"] = [1 - p.free[k] / int(part["capacity"].iloc[0]) for k in at]
    return out


def pack(
    sizes: DataFrame, specs: list[tuple[str, int]], islands: int = 2, epochs: int = 2, block_items: int = 2_000, full: float = 0.985, levels: int = 3
) -> DataFrame:
    """``spec, container, doc_id, piece, size``: every document in one container of each spec's capacity.

    ``sizes``: ``doc_id, tokens``; ``specs``: the few (name, capacity) pairs. A document larger than a container is cut
    into full pieces (each a container of its own) and a rest, which is packed; nothing else is split. Documents of no
    tokens are packed as size 0; null sizes count as 0; specs without a positive capacity give nothing; an empty table
    gives no rows. A block holds about ``block_items`` documents, or as many as fill some 60 containers, spread by the
    hash of their id, so copies or one source can't crowd a block. Blocks are first packed by best fit; only those that
    take more containers than the least that could do evolve. Then the containers under ``full`` are packed again,
    those of many blocks together, up to ``levels`` times.
    """
    specs = [(n, int(c)) for n, c in specs if n is not None and c is not None and c > 0]
    spark = sizes.sparkSession
    if not specs:
        return spark.createDataFrame([], "spec string, container string, doc_id long, piece int, size int")
    one = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(c).alias("capacity")) for n, c in specs])).alias("s")
    cut = one.select("doc_id", "tokens", each).select("doc_id", "tokens", "s.*")
    whole = F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int")  # full pieces before the last one
    pieces = cut.select("spec", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(whole, F.lit(0)))).alias("piece"))
    pieces = pieces.select("spec", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))
    pieces = C.kept(pieces, "pieces")
    done = [
        pieces.filter(F.col("size") == F.col("capacity")).select("spec", F.format_string("full-%d-%d", "doc_id", "piece").alias("container"), "doc_id", "piece", "size")
    ]
    rest = pieces.filter(F.col("size") < F.col("capacity"))
    for level in range(levels):
        about = {r["spec"]: r for r in rest.groupBy("spec").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()}  # a row per spec
        if not about:
            break
        blocks = {}
        for name, capacity in specs:
            if name in about:
                n, total = about[name]["n"], about[name]["total"]
                size = max(block_items, int(60 * capacity * n / max(1, total)))
                blocks[name] = max(1, round(n / min(size, 6 * block_items)))
        last = level == levels - 1 or all(b == 1 for b in blocks.values())
        n_blocks = F.coalesce(*[F.when(F.col("spec") == k, F.lit(b)) for k, b in blocks.items()])
        block = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), n_blocks).cast("int")
        started = rest.select("spec", "capacity", block.alias("block"), "doc_id", "piece", "size").groupBy("spec", "block").applyInPandas(_start, _PACKED + ", tight boolean")
        started = C.kept(started, f"start{level}")
        best = started.drop("tight")
        loose = started.filter(~F.col("tight"))
        if not loose.isEmpty():
            state = loose.select(
                "spec", "capacity", "block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("role"), "doc_id", "piece", "size",
                F.array("bin").alias("bins"),
            )
            for epoch in range(epochs):
                if epoch:  # the elites of an island also go to the next one of the ring
                    moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("role", F.lit(1))
                    state = state.unionByName(moved)
                state = C.kept(state.groupBy(*_KEY).applyInPandas(_epoch, _SCHEMA), f"epoch{level}")
            evolved = C.kept(state.groupBy("spec", "block").applyInPandas(_choose, _PACKED), f"level{level}")
            best = started.filter("tight").drop("tight").unionByName(evolved)
        closed = best if last else best.filter(F.col("fill") >= full)
        done.append(closed.select("spec", F.format_string(f"{level}-%d-%d", "block", "bin").alias("container"), "doc_id", "piece", "size"))
        if last:
            break
        rest = best.filter(F.col("fill") < full).select("spec", "capacity", "doc_id", "piece", "size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = with_tokens(C.table(spark, sf_dir, "documents"), tokenizer=tokenizer)
    specs = [(r["spec"], r["capacity_tokens"]) for r in C.table(spark, sf_dir, "pack_specs").collect()]  # a fixed table of 3 rows
    return pack(C.kept(sizes, "sizes"), specs)


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec: containers, the least number that could do, and the share of used space."""
    p = _packed(spark, sf_dir)
    specs = C.table(spark, sf_dir, "pack_specs")
    return (
        p.groupBy("spec")
        .agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"), F.countDistinct("doc_id").alias("documents"))
        .join(specs, "spec")
        .select("spec", "capacity_tokens", "documents", "tokens", "containers",
                F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
                F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
    )


SQL: dict[str, str] = {}
QUERIES = {"p7_packing": p7_packing, "p7_packing_report": p7_packing_report}
