"""Languages by ranked n-grams: a text's most frequent n-grams against those of each language.

A profile is the ranks of a language's commonest n-grams of 1 to 3 letters, words padded.  A text is
as far from it as the ranks of its own n-grams are out of place; accuracy is how much nearer the best
language is than the next one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKS, LEAST = 300, 0.2
_WORD = re.compile(r"[^\W\d_]+")
#: Different n-grams that a task holds before it writes their counts.
_HELD = 200_000


def grams(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        padded = f" {word} "
        for size in (1, 2, 3):
            for k in range(len(padded) - size + 1):
                out[padded[k : k + size]] += n
    del out[" "]
    return out


def _counted(batches):
    held: dict[str, Counter] = {}

    def flush():
        rows = [(lang, g, n) for lang, counts in held.items() for g, n in counts.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            held.setdefault(lang, Counter()).update(grams(text))
        if sum(map(len, held.values())) > _HELD:
            yield flush()
            held = {}
    yield flush()


def profiles(rows: DataFrame, ranks: int = RANKS) -> dict[str, dict[str, int]]:
    """The ranks of each language's commonest n-grams in rows (lang, text), by all of its texts; of equally common ones the first in order of bytes.

    Counts are added up where the texts are; the driver gets `ranks` n-grams a language.
    """
    own = rows.where("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    counts = own.mapInArrow(_counted, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    out: dict[str, dict[str, int]] = {}
    for r in top.collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["rank"] - 1
    return out


def detected(text: str, known: dict[str, dict[str, int]], ranks: int = RANKS) -> tuple[str | None, float]:
    """The nearest language and its accuracy, 0 to 1: the share by which it is nearer than the next; of equally near ones the first by name, with 0."""
    own = [g for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], x[0]))[:ranks]]
    if not own or not known:
        return None, 0.0
    far = sorted((sum(abs(places[g] - k) if g in places else ranks for k, g in enumerate(own)), lang) for lang, places in known.items())
    if len(far) == 1:
        return far[0][1], 1.0 - far[0][0] / (ranks * len(own))
    return far[0][1], 1.0 - far[0][0] / far[1][0] if far[1][0] else 0.0


def _codes(text: str) -> np.ndarray:
    """A text's n-grams, as often as they occur, as numbers of three characters of 21 bits; their order is that of the n-grams."""
    c = np.frombuffer((" " + "  ".join(_WORD.findall(text.lower())) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    gap = c == 32
    two = ~(gap[:-1] & gap[1:])  # two spaces stand between words
    return np.concatenate([c[~gap] << 42, ((c[:-1] << 42) | (c[1:] << 21))[two], ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[two[:-1] & two[1:]]])


class _Detector:
    """`detected` for many texts, whose n-grams are counted as sorted numbers."""

    def __init__(self, known: dict[str, dict[str, int]], ranks: int = RANKS):
        self.ranks, self.names = ranks, sorted(known)
        grams = sorted({g for places in known.values() for g in places})
        self.codes = np.array([sum(ord(x) << s for x, s in zip(g, (42, 21, 0))) for g in grams], np.int64)
        self.places = np.array([[known[lang].get(g, -1) for g in grams] for lang in self.names], np.int64).reshape(len(self.names), len(grams))

    def __call__(self, text: str) -> tuple[str | None, float]:
        codes, counts = np.unique(_codes(text), return_counts=True)
        if not len(codes) or not self.names:
            return None, 0.0
        own = codes[np.argsort(-counts, kind="stable")[: self.ranks]]
        at = np.full((len(self.names), len(own)), -1)
        if len(self.codes):
            where = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            at = np.where(self.codes[where] == own, self.places[:, where], -1)
        out = np.where(at >= 0, np.abs(at - np.arange(len(own))), self.ranks).sum(1)
        far = sorted(zip(out.tolist(), self.names))
        if len(far) == 1:
            return far[0][1], 1.0 - far[0][0] / (self.ranks * len(own))
        return far[0][1], 1.0 - far[0][0] / far[1][0] if far[1][0] else 0.0


def language(text: Column, known: dict[str, dict[str, int]]) -> Column:
    """struct(lang, accuracy) of each text; null texts and those without a letter have no language and an accuracy of 0."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detect = _Detector(known)
        for batch in batches:
            yield pd.DataFrame([detect(t or "") for t in batch], columns=["lang", "accuracy"])

    return F.pandas_udf(run, "lang string, accuracy double")(text)
