"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is read where it lies, never trained."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = os.environ.get("QUILLMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def with_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``tokens`` (int); null and empty texts have 0. Whole texts are encoded."""
    cols = [id_col, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema.fields) + ", tokens int"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        for pdf in batches:
            n: list[int] = []
            texts = [x or "" for x in pdf[text_col]]
            for i in range(0, len(texts), 256):
                n += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            out = pdf[cols].copy()
            out["tokens"] = pd.Series(n, index=out.index, dtype="int32")
            yield out

    return docs.select(*cols, text_col).mapInPandas(count, schema)
