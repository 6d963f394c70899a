"""The query queue and the ingestion of documents as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources.changelog import Collection


def unique_queries(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of each collection and query; state is kept as long as events may be late."""
    key = stream.where(F.trim("query") != "").withColumn("query_normalized", F.lower(F.trim("query")))
    return key.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["collection_name", "query_normalized"])


def unique_queries_for_ever(stream: DataFrame) -> DataFrame:
    """The first of each collection and query that the stream ever had: a repeat is never enqueued, however late.

    The state is one key for each different query and is not dropped; it belongs in RocksDB
    (spark.sql.streaming.stateStore.providerClass), which keeps it on disk.
    """
    key = stream.where(F.trim("query") != "").withColumn("query_normalized", F.lower(F.trim("query")))
    return key.dropDuplicates(["collection_name", "query_normalized"])  # without a watermark no key expires


def ingesting(stream: DataFrame, collection: Collection, now: Column, checkpoint: str, seen: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Puts each micro-batch's new and refreshed documents into the collection; the batch's order of arrival is its column `arrival`.

    A batch is compared with what the collection has: with the documents of its hashes and ids, which
    the index finds without reading all files.  A batch that was committed before a restart isn't put
    again.  seen: is given each batch's statuses and number.
    """

    def each(batch: DataFrame, number: int) -> None:
        if collection.done(checkpoint) >= number:
            return
        rows = ingest.stamped(batch, now).select(F.col("doc_id"), "content_hash")
        stored = None
        if collection.version():
            found = [collection.lookup(c, rows.select(F.col(c).alias("value"))).select("doc_id", "url", "content_hash") for c in ("content_hash", "doc_id")]
            stored = found[0].unionByName(found[1]).distinct()
        else:
            stored = batch.sparkSession.createDataFrame([], "doc_id string, url string, content_hash string")
        statuses = ingest.with_status(batch, now, stored=stored)
        collection.put(ingest.kept(batch, statuses), done=(checkpoint, number))
        if seen is not None:
            seen(statuses, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
