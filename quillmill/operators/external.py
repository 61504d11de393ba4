"""Maps over an injected model client: batched, retried, with failures as rows and equal requests asked once."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[str]]


def stub_client(prompts: list[str]) -> list[str]:
    """Deterministic stand-in: the prompt's words in reverse."""
    return [" ".join(reversed(p.split())) for p in prompts]


def call(client: Client, batch: list[str], attempts: int, pause: float) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt: a failing batch is tried again, then halved down to single prompts."""
    error = ""
    for k in range(attempts):
        try:
            got = client(batch)
            if len(got) != len(batch):
                raise ValueError(f"{len(got)} answers to {len(batch)} prompts")
            return [(a, None) for a in got]
        except Exception as e:  # a client may fail in any way; the row carries it on
            error = f"{type(e).__name__}: {e}"
            time.sleep(pause * (k + 1))
    if len(batch) == 1:
        return [(None, error)]
    half = len(batch) // 2
    return call(client, batch[:half], attempts, pause) + call(client, batch[half:], attempts, pause)


def ask(df: DataFrame, prompt: str, client: Client = stub_client, batch: int = 32, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """``df`` with ``answer`` and ``error``; equal prompts are asked once and joined back; a null prompt is not asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = list(pdf["_prompt"])
            got = [x for i in range(0, len(prompts), batch) for x in call(client, prompts[i : i + batch], attempts, pause)]
            yield pd.DataFrame({"_prompt": prompts, "answer": [a for a, _ in got], "error": [e for _, e in got]})

    asked = df.select(F.col(prompt).alias("_prompt")).filter("_prompt IS NOT NULL").distinct().mapInPandas(run, "_prompt string, answer string, error string")
    return df.join(asked.withColumnRenamed("_prompt", prompt), prompt, "left")


def pooled(*clients: Client) -> Client:
    """One client of several (say one a key): batches go round, and a failing one is passed on to the next."""
    turn = itertools.count()

    def run(prompts: list[str]) -> list[str]:
        first, last = next(turn), None
        for k in range(len(clients)):
            try:
                return clients[(first + k) % len(clients)](prompts)
            except Exception as e:  # the next key may work
                last = e
        raise last

    return run


def judged(df: DataFrame, fields: list[str], client: Client, schema: str, fallback: Column, **how) -> DataFrame:
    """``df`` with ``scores`` (``schema``) and ``judged``: a judge's answers to the rows' fields as canonical JSON (arrays
    sorted, texts in lower case), so that equal requests are one call, or ``fallback`` where it fails or says no object."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    plain = lambda c: F.array_sort(F.transform(c, lambda x: F.lower(F.trim(x)))) if kinds[c] == "array" else F.lower(F.trim(F.col(c).cast("string")))
    d = df.withColumn("_ask", F.to_json(F.struct(*[plain(c).alias(c) for c in sorted(fields)])))
    d = ask(d, "_ask", client, **how).withColumn("_s", F.when(F.try_parse_json("answer").isNotNull(), F.from_json("answer", schema)))
    return d.withColumn("judged", F.col("_s").isNotNull()).withColumn("scores", F.coalesce("_s", fallback)).drop("_ask", "_s", "answer", "error")


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)"""
    return df.filter("error IS NULL").drop("error"), df.filter("error IS NOT NULL")
