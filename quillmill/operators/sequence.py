"""Ordered operators: packing, padding, group advantages, runs and windows over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_packs(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row as the begin of a pack: the packs from there to the end, the last one's begin, and prefix sums."""
    n = len(lengths)
    cum = np.concatenate(([0], np.cumsum(lengths)))
    nxt = np.searchsorted(cum, cum[:-1] + longest, side="right") - 1  # where the pack after it begins
    packs, last = np.ones(n + 1, np.int64), np.arange(n + 1)
    packs[n] = 0
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            packs[i] = packs[nxt[i]] + 1
            last[i] = last[nxt[i]]
    return packs, last, cum


def next_fit(pieces: DataFrame, split: str, position: str, length: str, longest: int, width: int = 100_000) -> DataFrame:
    """``split, position, length, pack``: ordered next-fit packing; pieces over ``longest`` (or null, or under 1) are
    dropped, and a new pack begins where a piece does not fit. Positions are whole numbers.

    A split of any size is packed by many tasks with the result of one pass: a block of ``width`` positions tells, for
    each space that may be used when it is reached, how many packs it opens and what the last one then holds (at most
    ``longest`` entries). These tables are followed in order, a split's in one task, and the blocks are packed."""
    fits = pieces.select(split, position, F.col(length).cast("int").alias(length)).filter(F.col(length).between(1, longest) & F.col(split).isNotNull())
    blocks = fits.withColumn("_block", F.floor(F.col(position) / width).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in fits.schema.fields}

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf.sort_values(position, kind="stable")[length].to_numpy(np.int64)
        packs, last, cum = _first_packs(lengths, longest)
        # entry r: the first r rows still go into the pack that is open; the space used then lies in (longest - cum[r+1], longest - cum[r]]
        entries = int(np.searchsorted(cum, longest, side="right"))
        r = np.arange(entries)
        held = np.where(r < len(lengths), cum[-1] - cum[last[np.minimum(r, len(lengths))]], -1)  # -1: all rows go in
        return pd.DataFrame({split: [pdf[split].iloc[0]], "block": [int(pdf["_block"].iloc[0])], "starts": [cum[:entries].tolist()], "packs": [packs[r].tolist()], "held": [held.tolist()], "total": [int(cum[-1])]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        used, done, out = 0, 0, []
        for b in pdf.sort_values("block").itertuples(index=False):
            starts, packs, held = np.asarray(b.starts), np.asarray(b.packs), np.asarray(b.held)
            out.append((pdf[split].iloc[0], int(b.block), used, done))
            r = int(np.searchsorted(starts, longest - used, side="right")) - 1
            done += int(packs[r])
            used = used + int(b.total) if held[r] < 0 else int(held[r])
        return pd.DataFrame(out, columns=[split, "block", "_used", "_done"])

    tables = blocks.groupBy(split, "_block").applyInPandas(told, f"{split} {kinds[split]}, block long, starts array<long>, packs array<long>, held array<long>, total long")
    state = tables.groupBy(split).applyInPandas(follow, f"{split} {kinds[split]}, block long, _used long, _done long")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, kind="stable")
        lengths = pdf[length].to_numpy(np.int64)
        used, done = int(pdf["_used"].iloc[0]), int(pdf["_done"].iloc[0])
        cum = np.concatenate(([0], np.cumsum(lengths)))
        pack = np.empty(len(lengths), np.int64)
        at = int(np.searchsorted(cum, longest - used, side="right")) - 1
        pack[:at] = done
        done += at > 0 or used > 0
        while at < len(lengths):
            end = int(np.searchsorted(cum, cum[at] + longest, side="right")) - 1
            pack[at:end] = done
            at, done = end, done + 1
        return pdf[[*kinds]].assign(pack=pack)

    joined = blocks.join(state.withColumnRenamed("block", "_block"), [split, "_block"])
    return joined.groupBy(split, "_block").applyInPandas(place, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", pack int")


def packed_tokens(samples: DataFrame, split: str, position: str, ids: str, mask: str, eos: int | None, longest: int = 2048, width: int = 10_000) -> DataFrame:
    """``split, pack, input_ids, assistant_masks, labels``: samples with an end mark each, packed in order. Samples over
    ``longest`` tokens are dropped; labels are the tokens of the assistant, -100 elsewhere; a null mask counts as 0s; a
    mask of another length than its tokens is an error."""
    m = F.coalesce(F.col(mask), F.array_repeat(F.lit(0), F.size(ids)))
    m = F.when(F.size(m) != F.size(ids), F.raise_error(F.lit("mask and tokens differ in length")).cast("array<int>")).otherwise(m)
    end = lambda x: F.array(F.lit(x)) if eos is not None else F.array().cast("array<int>")
    d = samples.filter(F.col(ids).isNotNull()).select(split, position, F.concat(F.col(ids).cast("array<int>"), end(eos)).alias("_ids"), F.concat(m.cast("array<int>"), end(0)).alias("_mask"))
    packs = next_fit(d.withColumn("_n", F.size("_ids")), split, position, "_n", longest, width)
    g = d.join(packs.select(split, position, "pack"), [split, position]).groupBy(split, "pack")
    g = g.agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "_ids", "_mask"))).alias("x"))
    g = g.select(split, "pack", F.flatten("x._ids").alias("input_ids"), F.flatten("x._mask").alias("assistant_masks"))
    return g.withColumn("labels", F.zip_with("input_ids", "assistant_masks", lambda i, k: F.when(k == 1, i).otherwise(-100)))


def collated(df: DataFrame, ids: str, labels: str, width: int, pad: int) -> DataFrame:
    """``input_ids, labels, attention_mask`` of one width: padded with ``pad``, -100 and 0; too long a row is an error."""
    ones = F.transform(ids, lambda x: F.lit(1))
    return df.withColumns({"attention_mask": padded(ones, width, 0), "input_ids": padded(F.col(ids), width, pad), "labels": padded(F.col(labels), width, -100)})


def row_mask(rows: DataFrame, row: str, trainable: DataFrame) -> DataFrame:
    """``mask``: 1 for the rows of a table whose number is among ``trainable``, else 0."""
    t = trainable.select(F.col(row)).distinct().withColumn("mask", F.lit(1))
    return rows.join(t, row, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def padded(c: Column, width: int, fill: int) -> Column:
    """Array filled up on the right; one that is too long raises an error."""
    return F.when(F.size(c) > width, F.raise_error(F.lit("sequence longer than the padded width")).cast("array<int>")).otherwise(
        F.concat(c, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.size(c))))
    )


def advantages(df: DataFrame, group: list[str], reward: str, scale: str, eps: float = 1e-4) -> DataFrame:
    """``advantage``: reward less the group's mean, divided by (sample deviation + eps) of the group ('group'), of all
    rows ('batch'), or by nothing ('none'). A group of one has no deviation (null) under 'group'."""
    if scale not in ("group", "batch", "none"):
        raise ValueError(f"unknown scale {scale!r}")
    w = Window.partitionBy(*group)
    centred = F.col(reward) - F.avg(reward).over(w)
    if scale == "none":
        return df.withColumn("advantage", centred)
    if scale == "group":
        return df.withColumn("advantage", centred / (F.stddev_samp(reward).over(w) + eps))
    spread = df.agg(F.stddev_samp(reward).alias("sd")).first()["sd"]  # one number
    return df.withColumn("advantage", centred / (F.lit(spread).cast("double") + eps))


def nan_weighted_sum(values: list[str], weights: list[float]) -> Column:
    parts = [F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)) * F.lit(float(w)), F.lit(0.0)) for v, w in zip(values, weights)]
    return sum(parts[1:], parts[0])


def until_eos(tokens: Column, eos: int) -> Column:
    """Tokens up to and with the first end mark; all when there is none."""
    at = F.array_position(tokens, F.lit(eos)).cast("int")
    return F.when(at > 0, F.slice(tokens, 1, at)).otherwise(tokens)


def tail(c: Column, n: int) -> Column:
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


def top_by(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """``rank``: the first n rows of each group; give a last key that makes the order total."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recent_count(df: DataFrame, group: list[str], ts: str, minutes: int) -> DataFrame:
    """``recent``: rows of the group in the last ``minutes`` up to this row (same instants count)."""
    w = Window.partitionBy(*group).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def run_lengths(df: DataFrame, group: list[str], order: list[str], flag: Column) -> DataFrame:
    """``run``: how many rows in a row up to this one have the flag; 0 where it is off."""
    w = Window.partitionBy(*group).orderBy(*order)
    df = df.withColumn("_f", flag.cast("int")).withColumn("_isle", F.sum(1 - F.col("_f")).over(w))
    return df.withColumn("run", F.sum("_f").over(Window.partitionBy(*group, "_isle").orderBy(*order))).drop("_f", "_isle")


def is_timeout(error: Column) -> Column:
    """Whether an error's text tells of a timeout."""
    return F.coalesce(F.lower(error).rlike("timeout|timed out"), F.lit(False))  # fixed values


def aborts(outcomes: DataFrame, group: list[str], order: list[str], error: str, after: int) -> DataFrame:
    """``abort``: the rows at which a run of ``after`` timeouts in a row is reached; a success or another error ends a run."""
    r = run_lengths(outcomes, group, order, is_timeout(F.col(error)))
    return r.withColumn("abort", F.col("run") == after).drop("run")


def cooled_down(df: DataFrame, group: list[str], ts: str, minutes: int, threshold: int, cooldown: int) -> DataFrame:
    """``recent`` failures in the last ``minutes``, whether they reach ``threshold``, and whether the row lies within
    ``cooldown`` minutes after a row that did."""
    d = recent_count(df, group, ts, minutes).withColumn("tripped", F.col("recent") >= threshold)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*group).orderBy(at).rangeBetween(-cooldown * 60_000_000, -1)
    return d.withColumn("cooling", F.coalesce(F.bool_or("tripped").over(w), F.lit(False)))


def milestones(position: Column, every: int) -> Column:
    """Whether the 1-based position reaches a multiple of ``every``."""
    return position % every == 0
