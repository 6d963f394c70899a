"""Searches for a table of queries at once.

Queries are dealt into files of the shared folder, of which a task holds one at a time.  A task
multiplies each batch of the collection with a file's queries and keeps the best of each query; Spark
merges them.  The collection is scanned once and isn't shuffled, and no pair of a row and a query is
ever a row.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

#: Bytes of the vectors of a file of queries, and rows of the collection that are multiplied at once.
FILE_BYTES, ROWS = 8 << 20, 2048


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _put(folder: str):
    def run(batches):
        files, last, held = scratch.Files(folder), None, []

        def put():
            table = pa.Table.from_batches(held)
            out = io.BytesIO()
            with pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            files.put(f"{last}.arrow", out.getvalue())
            return pa.RecordBatch.from_pydict({"file": pa.array([last], pa.int64())})

        for batch in batches:
            names = batch.column("file").to_numpy()
            for cut in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1) if len(names) else ():
                if held and names[cut[0]] != last:
                    yield put()
                    held = []
                last = int(names[cut[0]])
                held.append(batch.slice(cut[0], len(cut)))
        if held:
            yield put()

    return run


def dealt(queries: DataFrame, width: int, column: str = "dense") -> tuple[str, list[int]]:
    """queries (query_id, the column's vectors, and others) in files of about FILE_BYTES, of `width` numbers a query; their folder and names."""
    spark = queries.sparkSession
    folder = scratch.path(spark, "queries")
    files = max(1, -(-queries.count() * width * 8 // FILE_BYTES))
    rows = queries.where(F.col(column).isNotNull()).withColumn("file", F.pmod(F.xxhash64("query_id"), F.lit(files)))
    put = rows.repartition("file").sortWithinPartitions("file", "query_id").mapInArrow(_put(folder), "file bigint")
    return folder, sorted(r["file"] for r in scratch.written(put, "queries-files").collect())


class _Best:
    """The best of each query of a file so far."""

    def __init__(self, data: bytes, limit: int):
        table = pa.ipc.open_file(data).read_all()
        self.ids, self.limit = table["query_id"], limit
        self.load(table)
        self.lists = [set(x) for x in table["lists"].to_pylist()] if "lists" in table.column_names else None
        n = len(self.ids)
        self.least, self.scores, self.keys = np.full(n, -np.inf), [np.zeros(0)] * n, [np.zeros(0, object)] * n

    def load(self, table: pa.Table) -> None:
        self.q = np.ascontiguousarray(matrix(table["dense"].combine_chunks()))

    def rows(self, batch: pa.RecordBatch):
        return matrix(batch.column("dense"))

    def near(self, x) -> np.ndarray:
        """Scores of rows by query, up to rounding."""
        return x @ self.q.T

    def exact(self, x, rows: np.ndarray, j: int) -> np.ndarray:
        """Scores of some rows for a query, summed element by element in order, as the expressions do."""
        return np.add.accumulate(x[rows] * self.q[j], axis=1)[:, -1]

    def meet(self, batch: pa.RecordBatch, keys: np.ndarray, lists: np.ndarray | None, threshold: float | None) -> None:
        x = self.rows(batch)
        near = self.near(x)
        if self.lists is not None:
            codes, back = np.unique(lists, return_inverse=True)
            near[~np.array([[c in own for own in self.lists] for c in codes.tolist()], bool)[back]] = -np.inf
        floor = np.maximum(self.least, -np.inf if threshold is None else threshold)
        if len(keys) > self.limit:
            floor = np.maximum(floor, np.partition(near, len(keys) - self.limit, axis=0)[len(keys) - self.limit])
        # products by blocks round as they like: near ones are summed again, element by element
        hits = near >= floor - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(floor), floor, 0)))
        hits &= np.isfinite(near)
        for j in np.flatnonzero(hits.any(0)).tolist():
            rows = np.flatnonzero(hits[:, j])
            exact = self.exact(x, rows, j)
            if threshold is not None:
                rows, exact = rows[exact >= threshold], exact[exact >= threshold]
            scores, own = np.concatenate([self.scores[j], exact]), np.concatenate([self.keys[j], keys[rows]])
            order = sorted(range(len(scores)), key=lambda i: (-scores[i], own[i]))[: self.limit]
            self.scores[j], self.keys[j] = scores[order], own[order]
            if len(order) == self.limit:
                self.least[j] = scores[order[-1]]

    def batch(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        ids = self.ids.combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        return pa.RecordBatch.from_arrays([ids.cast(kinds[0]), pa.array([k for own in self.keys for k in own.tolist()], kinds[1]), pa.array(np.concatenate([*self.scores, np.zeros(0)]))], names=["query_id", "key", "score"])


class _BestLate(_Best):
    """By the sum of each query vector's best product with a row's vectors."""

    #: Products that are held at once.
    PRODUCTS = 1 << 21

    def load(self, table: pa.Table) -> None:
        each = [np.array(x, np.float64) for x in table["late"].to_pylist()]
        self.each, self.q = each, np.concatenate(each)
        self.begins = np.cumsum([len(x) for x in each]) - [len(x) for x in each]

    def rows(self, batch: pa.RecordBatch):
        late = batch.column("late")
        sizes = np.diff(late.offsets.to_numpy())
        return matrix(late.flatten()), np.cumsum(sizes) - sizes, sizes

    def near(self, x) -> np.ndarray:
        vectors, begins, sizes = x
        out, step = [np.zeros((0, len(self.each)))], max(1, self.PRODUCTS // max(1, len(self.q)))
        lo, ends = 0, begins + sizes
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + step, "right")))
            products = vectors[begins[lo] : ends[hi - 1]] @ self.q.T
            out.append(np.add.reduceat(np.maximum.reduceat(products, begins[lo:hi] - begins[lo], axis=0), self.begins, axis=1))
            lo = hi
        return np.concatenate(out)

    def exact(self, x, rows: np.ndarray, j: int) -> np.ndarray:
        vectors, begins, sizes = x
        out = []
        for r in rows.tolist():
            own = vectors[begins[r] : begins[r] + sizes[r]]
            best = np.add.accumulate(own[:, None, :] * self.each[j][None], axis=2)[:, :, -1].max(0)
            out.append(np.add.accumulate(best)[-1])
        return np.array(out)


def _searched(folder: str, names: list[int], limit: int, threshold: float | None, kinds: list[pa.DataType], lists: bool, by: type[_Best] = _Best):
    def run(batches):
        files, best = scratch.Files(folder), {}
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                keys = np.array(part.column("key").to_pylist(), object)
                own = part.column("list").to_numpy() if lists else None
                for name in names:
                    if name not in best:
                        with files.open(f"{name}.arrow") as file:
                            best[name] = by(file.read(), limit)
                    best[name].meet(part, keys, own, threshold)
        for found in best.values():
            yield found.batch(kinds)

    return run


def dense_top(collection: DataFrame, queries: DataFrame, limit: int, where: Column | None = None, threshold: float | None = None, key: str = "doc_id") -> DataFrame:
    """query_id, rank, key, score: for each row of queries (query_id, dense) what `search.dense_top` gives for it alone, to the last bit.

    Queries and rows without a vector are left out; repeated query_ids are queries of their own only
    if their vectors are equal, so they should be different.  If both tables have lists (`list` in the
    collection, an array `lists` in queries) a query meets rows of its lists only.
    """
    spark = collection.sparkSession
    rows = collection.where(F.col("dense").isNotNull())
    rows = rows if where is None else rows.where(where)
    first = queries.where(F.col("dense").isNotNull()).select(F.size("dense").alias("n")).first()
    probed = "lists" in queries.columns and "list" in collection.columns
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", collection.schema[key].dataType), T.StructField("score", T.DoubleType())])
    if first is None:
        return spark.createDataFrame([], out).withColumn("rank", F.lit(0)).select("query_id", "rank", F.col("key").alias(key), "score")
    folder, names = dealt(queries.select("query_id", "dense", *(["lists"] if probed else [])), first["n"])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(out[c].dataType) for c in ("query_id", "key")]
    slim = rows.select(F.col(key).alias("key"), "dense", *(["list"] if probed else []))
    hits = slim.mapInArrow(_searched(folder, names, limit, threshold, kinds, probed), out)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", F.col("key").alias(key), "score")


def late_top(collection: DataFrame, queries: DataFrame, limit: int, where: Column | None = None, threshold: float | None = None, key: str = "doc_id") -> DataFrame:
    """query_id, rank, key, score: for each row of queries (query_id, late) what `search.late_top` gives for it alone, to the last bit.

    Products are of whole batches of token vectors with those of a file of queries.  Queries and rows
    without token vectors are left out.
    """
    some = lambda df: df.where(F.col("late").isNotNull() & (F.size("late") > 0))
    rows, asked = some(collection), some(queries).select("query_id", "late")
    rows = rows if where is None else rows.where(where)
    widest = asked.agg(F.max(F.size("late") * F.size(F.col("late")[0])).alias("n")).first()["n"]
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", collection.schema[key].dataType), T.StructField("score", T.DoubleType())])
    if widest is None:
        return collection.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(0)).select("query_id", "rank", F.col("key").alias(key), "score")
    from pyspark.sql.pandas.types import to_arrow_type

    folder, names = dealt(asked, widest, "late")
    kinds = [to_arrow_type(out[c].dataType) for c in ("query_id", "key")]
    hits = rows.select(F.col(key).alias("key"), "late").mapInArrow(_searched(folder, names, limit, threshold, kinds, False, _BestLate), out)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", F.col("key").alias(key), "score")


def max_sim(query: np.ndarray, document: np.ndarray) -> float:
    return float((query @ document.T).max(1).sum())


def _reranked(queries: str, names: list[int]):
    def run(batches):
        known: dict = {}
        files = scratch.Files(queries)
        for name in names:
            with files.open(f"{name}.arrow") as file:
                table = pa.ipc.open_file(file.read()).read_all()
            known.update(zip(table["query_id"].to_pylist(), (np.array(x, np.float64) for x in table["late"].to_pylist())))
        for batch in batches:
            score = []
            for ids, late in zip(batch.column("wanted").to_pylist(), batch.column("late").to_pylist()):
                document = np.array(late, np.float64)
                score.append([max_sim(known[q], document) for q in ids])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("wanted"), pa.array(score, pa.list_(pa.float64()))], names=["key", "wanted", "scores"])

    return run


def hybrid(collection: DataFrame, queries: DataFrame, limit: int, prefetch: int, where: Column | None = None, key: str = "doc_id") -> DataFrame:
    """query_id, rank, key, score: for each row of queries (query_id, dense, late) the dense candidates, reranked by the sum of the best products of its token vectors.

    A document's token vectors move once, to the queries that want it; queries' own token vectors are
    read from files, so a call should be for as many as fit a worker's memory.
    """
    if queries.where(F.col("dense").isNotNull()).isEmpty():
        return dense_top(collection, queries, limit, where, key=key)
    found = dense_top(collection, queries, prefetch, where, key=key)
    wanted = scratch.written(found.groupBy(key).agg(F.sort_array(F.collect_list("query_id")).alias("wanted")), "wanted")
    folder, names = dealt(queries.select("query_id", "dense", "late"), 1)
    rows = collection.where(F.col("late").isNotNull()).join(wanted, key).select(F.col(key).alias("key"), "wanted", "late")
    out = T.StructType([T.StructField("key", collection.schema[key].dataType), wanted.schema["wanted"], T.StructField("scores", T.ArrayType(T.DoubleType()))])
    scored = rows.mapInArrow(_reranked(folder, names), out).select("key", F.explode(F.arrays_zip("wanted", "scores")).alias("s")).select(F.col("s.wanted").alias("query_id"), "key", F.col("s.scores").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", F.col("key").alias(key), "score")


