"""An inverted-list index of vectors: lists around centres as folders, of which a search reads the nearest.

Centres are fitted by spherical k-means to a bounded sample; every row is in the list of its nearest
centre.  `probes` is the knob between speed and recall; with all lists a search is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import many
from ..operators import search as one

#: Rows that centres are fitted to at most, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most `lists` centres of length one; an empty list takes the row that is farthest from its centre."""
    rows = np.unique(unit(sample.astype(np.float64)), axis=0)
    if len(rows) <= lists:
        return rows
    out = rows[np.random.default_rng(seed).choice(len(rows), lists, replace=False)]
    for _ in range(rounds):
        near = rows @ out.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = rows[np.argsort(best)[: len(empty)]]
        out = unit(sums)
    return out


def _assigned(middle: np.ndarray):
    def run(batches):
        for batch in batches:
            column, lists = batch.column("dense"), np.full(len(batch), -1, np.int32)
            some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                lists[some] = (many.matrix(column.take(pa.array(some))) @ middle.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=[*batch.schema.names, "list"])

    return run


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def build(self, rows: DataFrame, lists: int = 64, sample: int = SAMPLE) -> "VectorIndex":
        """rows (key, dense, ..): all of them, with all their columns.

        The sample is the rows with the smallest hashes of their key, so it doesn't depend on
        partitions.  A list of very many rows is written by several tasks.  Rows without a vector are
        kept beside the lists and are in no search.
        """
        some = rows.where(F.col("dense").isNotNull()).select("dense", F.xxhash64(self.key).alias("draw")).orderBy("draw").limit(sample)
        drawn = some.select("dense").toArrow()["dense"].combine_chunks()
        if not len(drawn):
            raise ValueError("no row has a vector")
        middle = centres(many.matrix(drawn), lists)
        kind = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
        listed = rows.mapInArrow(_assigned(middle), kind).hint("rebalance", "list")
        listed.write.mode("overwrite").partitionBy("list").parquet(f"{self.folder}/lists")
        table = [(k, [float(x) for x in row]) for k, row in enumerate(middle)]
        self.spark.createDataFrame(table, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centres")
        return self

    def centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.folder}/centres").orderBy("list").collect()])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists")

    def nearest(self, vectors: np.ndarray, probes: int | None) -> np.ndarray:
        """The lists that a search of each vector reads: the nearest first."""
        middle = self.centres()
        return np.argsort(-(vectors @ middle.T), axis=1, kind="stable")[:, : probes or len(middle)]

    def top(self, query: one.Vectors, limit: int, probes: int | None = 8, where: Column | None = None, threshold: float | None = None) -> DataFrame:
        """`search.dense_top` over the nearest lists (None: all), with exact scores; folders of other lists aren't read."""
        chosen = [int(x) for x in self.nearest(np.array([query.dense]), probes)[0]]
        return one.dense_top(self.rows().where(F.col("list").isin(chosen)), query, limit, where, threshold, self.key)

    def top_many(self, queries: DataFrame, limit: int, probes: int | None = 8, where: Column | None = None) -> DataFrame:
        """The same for a table of queries (query_id, dense): query_id, rank, key, score."""
        return many.dense_top(self.rows(), self._probing(queries, probes), limit, where, key=self.key)

    def _probing(self, queries: DataFrame, probes: int | None) -> DataFrame:
        middle = self.centres()

        def add(batches):
            for batch in batches:
                near = np.argsort(-(many.matrix(batch.column("dense")) @ middle.T), axis=1, kind="stable")[:, : probes or len(middle)] if len(batch) else np.zeros((0, 1), int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

        kind = T.StructType([*queries.select("query_id", "dense").schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
        return queries.select("query_id", "dense").where(F.col("dense").isNotNull()).mapInArrow(add, kind)

    def recalls(self, queries: DataFrame, limit: int) -> list[float]:
        """The recall of 1, 2, .. probes: the share of the exact `limit` best of all queries (different query_ids) that lie in so many nearest lists."""
        exact = self.top_many(queries, limit, None).select("query_id", self.key).join(self.rows().select(self.key, "list"), self.key)
        order = self._probing(queries, None).select("query_id", F.posexplode("lists").alias("at", "list"))
        found = {r["at"]: r["count"] for r in exact.join(order, ["query_id", "list"]).groupBy("at").count().collect()}  # a number for each list at most
        total, met, out = sum(found.values()), 0, []
        for at in range(len(self.centres())):
            met += found.get(at, 0)
            out.append(met / total if total else 1.0)
        return out

    def probes_for(self, queries: DataFrame, limit: int, recall: float = 0.9) -> int:
        """The fewest probes whose measured recall is enough."""
        return next(k + 1 for k, r in enumerate(self.recalls(queries, limit)) if r >= recall - 1e-12)

    def recall(self, queries: DataFrame, limit: int, probes: int) -> float:
        """The share of the exact `limit` best of all queries that a search of so many lists finds."""
        exact, found = (self.top_many(queries, limit, p).select("query_id", self.key) for p in (None, probes))
        total = exact.count()
        return exact.join(found, ["query_id", self.key], "left_semi").count() / total if total else 1.0
