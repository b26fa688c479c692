"""Remote services as functions that are passed in: embeddings and language models, called by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embedding_column(embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Callable[[Column], Column]:
    """Makes a column function of a batch embedding function; an answer of another length than the batch is an error."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), batch):
                part = texts.iloc[k : k + batch].fillna("").tolist()
                got = embed(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                out += got
            yield pd.Series(out)

    return run


def answered(call: Callable[[str], str]) -> Callable[[Column], Column]:
    """Makes a column function of a model call: a struct of ``reply`` and ``error``, of which one is null."""

    @F.pandas_udf("reply string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            replies, errors = [], []
            for p in prompts.fillna(""):
                try:
                    replies.append(call(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a failed call is told, the others go on
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run


def reply_column(call: Callable[[str], str]) -> Callable[[Column], Column]:
    """The replies of ``answered``; a call that fails gives an empty one. Where failures must be counted, use ``answered``."""
    ask = answered(call)
    return lambda prompt: F.coalesce(ask(prompt)["reply"], F.lit(""))
