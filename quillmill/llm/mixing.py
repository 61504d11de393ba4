"""Problem 8: mixing sources to target weights, by balanced sampling with the cube method.

A source's share and the mixture's size give each of its documents an expected number of copies. The whole part is
taken; the fraction is an inclusion probability that a flight moves to 0 or 1 along directions that leave the source's
tokens and documents unchanged. Blocks fly alone and pass on a bounded number of documents each, until a last block lands.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import TOKENIZER, with_tokens

EPS, POOL, LANDING, RESERVE = 1e-9, 256, 10, 64


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but for at most two, with sum(pi) and sum(pi * size) as before.

    Three undecided units at a time: the null space of their rows (1, 1, 1) and (sizes) is one direction; a step along
    it, either way with chances that keep the expectation, decides one of them."""
    p, t = pi.astype(float).tolist(), size.astype(float).tolist()
    draws = rng.random(len(p)).tolist()
    held: list[int] = []
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)  # equal sizes: any direction that keeps the count
        ups = [((1 - p[k]) / x if x > 0 else p[k] / -x, k) for k, x in zip(held, u) if x]
        downs = [(p[k] / x if x > 0 else (1 - p[k]) / -x, k) for k, x in zip(held, u) if x]
        (up, first), (down, other) = min(ups), min(downs)
        step, hit = (up, first) if draws[i] * (up + down) < down else (-down, other)
        still = []
        for k, x in zip(held, u):
            p[k] += step * x
            if k == hit or p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = float(round(p[k]))
            else:
                still.append(k)
        held = still
    return np.asarray(p)


def landing(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight of a last block, down to 0 and 1.

    A flight may end on a document far larger than the others, whose rounding would upset the tokens. So a pool of
    usual-sized units waits; what the others' flight leaves is rounded, the pool's probabilities are scaled to the
    tokens then missing, the pool flies, and of the choices for its last units the one nearest to the goal is taken."""
    goal = float((pi * size).sum())
    usual = np.flatnonzero((size <= np.quantile(size, 0.75)) & (pi > EPS) & (pi < 1 - EPS)) if len(pi) else np.zeros(0, np.int64)
    pool = rng.permutation(usual)[:POOL]
    rest = np.setdiff1d(np.arange(len(pi)), pool, assume_unique=True)
    out = pi.astype(np.float64)
    out[rest] = flight(pi[rest], size[rest], rng)
    open_ = rest[(out[rest] > EPS) & (out[rest] < 1 - EPS)]
    out[open_] = rng.random(len(open_)) < out[open_]
    if len(pool):
        missing = goal - float((out[rest] * size[rest]).sum())
        out[pool] = np.clip(pi[pool] * missing / float((pi[pool] * size[pool]).sum()), 0, 1)
        fly = pool[: max(0, len(pool) - LANDING)]
        out[fly] = flight(out[fly], size[fly], rng)
        left = np.concatenate((fly[(out[fly] > EPS) & (out[fly] < 1 - EPS)], pool[len(fly) :]))
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(np.int8)
        decided = np.setdiff1d(np.arange(len(pi)), left, assume_unique=False)
        gap = goal - float((out[decided] * size[decided]).sum())
        out[left] = choices[int(np.argmin(np.abs(choices @ size[left].astype(np.float64) - gap)))]
    return np.rint(out)


def _flyer(last: bool, level: int, seed: int):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(pdf["block"].iloc[0]), zlib.crc32(str(pdf["source"].iloc[0]).encode())])
        order = rng.permutation(len(pdf))
        pi, size = pdf["pi"].to_numpy()[order], pdf["tokens"].to_numpy()[order]
        if last:
            got = landing(pi, size, rng)
        else:  # usual-sized units stay undecided, so that the last block has its pool
            usual = np.flatnonzero(size <= np.quantile(size, 0.75))[:RESERVE]
            fly_ = np.setdiff1d(np.arange(len(pi)), usual, assume_unique=True)
            got = pi.astype(np.float64)
            got[fly_] = flight(pi[fly_], size[fly_], rng)
        out = pdf.iloc[order][["source", "doc_id", "tokens", "base"]].copy()
        out["pi"] = got
        return out

    return fly


def mix(docs: DataFrame, targets: list[tuple[str, float, int]], total_tokens: float | None = None, block_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """``source, doc_id, tokens, repeats`` of the documents in the mixture (``repeats`` >= 1).

    ``docs``: ``doc_id, source, tokens``; ``targets``: the few (source, share, most repeats). ``total_tokens`` None:
    the largest mixture in which every source that has tokens reaches its share within its repeats; the shares of
    sources without tokens can't be had and are spread over the others in proportion. A given total may be too large
    for some source, which is then taken ``most repeats`` times. Documents whose source is null or no target, and those
    without tokens, are left out; targets with a null or no share, or no repeats, give nothing; an empty table gives no
    rows. A hot source only has more blocks: a block holds about ``block_rows`` documents.
    """
    spark = docs.sparkSession
    empty = "source string, doc_id long, tokens int, repeats int"
    targets = [(s, float(w), int(r)) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0]
    d = C.kept(docs.filter((F.col("tokens") > 0) & F.col("source").isin([s for s, _, _ in targets])).select("doc_id", "source", F.col("tokens").cast("int").alias("tokens")), "sized")
    have = {r["source"]: (r["n"], r["t"]) for r in d.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}  # a row per target
    live = [x for x in targets if x[0] in have]
    if not live:
        return spark.createDataFrame([], empty)
    weight = sum(w for _, w, _ in live)
    if total_tokens is None:
        total_tokens = min(r * have[s][1] / (w / weight) for s, w, r in live)
    copies = {s: min(float(r), w / weight * total_tokens / have[s][1]) for s, w, r in live}
    copies = {s: float(round(x)) if abs(x - round(x)) < 1e-12 else x for s, x in copies.items()}
    pick = lambda m: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in m.items()])
    base, frac = {s: int(x) for s, x in copies.items()}, {s: x - int(x) for s, x in copies.items()}
    state = d.withColumn("base", pick(base).cast("int")).withColumn("pi", pick(frac).cast("double"))
    decided = [state.filter("pi = 0").select("source", "doc_id", "tokens", "base", F.col("pi").alias("taken"))]
    state = state.filter("pi > 0")
    blocks = {s: max(1, -(-have[s][0] // block_rows)) for s in copies}
    level = 0
    while True:
        last = max(blocks.values()) == 1
        placed = state.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), pick(blocks)).cast("int"))

        flown = C.kept(placed.groupBy("source", "block").applyInPandas(_flyer(last, level, seed), "source string, doc_id long, tokens int, base int, pi double"), f"flight{level}")
        decided.append(flown.filter("pi = 0 OR pi = 1").select("source", "doc_id", "tokens", "base", F.col("pi").alias("taken")))
        if last:
            break
        state = flown.filter("pi > 0 AND pi < 1")
        blocks = {s: max(1, -(-(RESERVE + 2) * b // block_rows)) for s, b in blocks.items()}
        level += 1
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out.withColumn("repeats", (F.col("base") + F.col("taken")).cast("int")).filter("repeats > 0").select("source", "doc_id", "tokens", "repeats")


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return [(r["source"], r["target_share"], r["max_repeats"]) for r in C.table(spark, sf_dir, "mix_targets").collect()]  # a fixed table of 8 rows


def _mixed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = with_tokens(C.table(spark, sf_dir, "documents"), keep=("source",), tokenizer=tokenizer)
    return mix(sizes, _targets(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p8_mixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: the share asked for, the share reached, documents, tokens and the most repeats used."""
    m = _mixed(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats_used")
    )
    t = C.table(spark, sf_dir, "mix_targets")
    total = m.agg(F.sum("tokens")).first()[0] or 0
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return t.join(m, "source", "left").select(
        "source", "target_share", "max_repeats", z("documents"), z("tokens"), z("repeats_used"), F.round(F.coalesce("tokens", F.lit(0)) / F.lit(max(1, total)), 6).alias("share_reached")
    )


SQL: dict[str, str] = {}
QUERIES = {"p8_mixture": p8_mixture, "p8_mixture_report": p8_mixture_report}
