"""Hooks that put vectors of a model of the caller's on rows, in Arrow batches.  Without one, vectors are columns of the input."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH, PREFIX = 8, {"query": "[Q] ", "document": "[D] "}


#: Characters that are always tried.
LEAST_CHARS = 512
_PASSED, _LIMIT = re.compile(r"passed\s+(\d+)", re.I), re.compile(r"limit\D{0,40}?(\d+)", re.I)


class TooLong(ValueError):
    """Raised by a model for a text over its limit; the message says so: `passed 9000 ... limit 8192`, or a limit alone."""

    def __init__(self, complaint: int | str):
        super().__init__(f"limit {complaint}" if isinstance(complaint, int) else complaint)

    def budget(self, length: int) -> int:
        """Characters to try next: below what was passed, at most the limit, LEAST_CHARS at least."""
        passed, limit = _PASSED.search(str(self)), _LIMIT.search(str(self))
        below = min(length, int(passed[1]) if passed else length) - 1
        return max(LEAST_CHARS, min(below, int(limit[1]) if limit else below))


def in_batches(texts: list[str], model: Callable[[list[str]], list], size: int = BATCH) -> list:
    """Batches in order; a text that is too long is cut to the model's limit (LEAST_CHARS characters at least) and tried once more alone."""
    out = []
    for k in range(0, len(texts), size):
        part = texts[k : k + size]
        try:
            out += model(part)
        except TooLong:
            for t in part:
                try:
                    out += model([t])
                except TooLong as e:
                    out += model([t[: e.budget(len(t))]])
    return out


def embedded(df: DataFrame, model: Callable[[list[str]], list], text: str = "text_to_embed", column: str = "dense", vector: T.DataType | None = None, size: int = BATCH) -> DataFrame:
    """df with model(texts) in a column; a model that fails fails the job, no row is dropped."""
    kind = vector or T.ArrayType(T.FloatType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{column: in_batches(f[text].fillna("").tolist(), model, size)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(column, kind)]))
