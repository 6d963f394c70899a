"""The queue of queries, key/value entries, runs and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5

PRIMARY_EXCLUDED = ("_faq", "_feedback")


def enqueued(rows: DataFrame) -> DataFrame:
    """rows (id, query, collection_name, created_at): the first of each collection and query (trimmed, lower case); blanks are dropped."""
    key = F.lower(F.trim("query"))
    rest = [c for c in rows.columns if c != "collection_name"]
    first = rows.where(F.trim("query") != "").withColumn("query_normalized", key).groupBy("collection_name", "query_normalized").agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("r"))
    return first.select("collection_name", "query_normalized", *(F.col(f"r.{c}").alias(c) for c in rest))


def newest(queue: DataFrame, limit: int = 50, collection: str | None = None) -> DataFrame:
    rows = queue if collection is None else queue.where(F.col("collection_name") == collection)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), 500))


def with_language(queue: DataFrame, known: tuple[str, ...] = ("de", "en"), least: float = 0.2) -> DataFrame:
    """Rows with their group: the detector's lang if it is known and sure enough, else Unknown."""
    lang = F.when(F.col("lang").isin(*known) & (F.coalesce("accuracy", F.lit(1.0)) >= least), F.col("lang")).otherwise("Unknown")
    return queue.withColumn("language", lang)


def by_language(queue: DataFrame, known: tuple[str, ...] = ("de", "en"), least: float = 0.2) -> DataFrame:
    """Counts by language, Unknown last; the detector's lang and accuracy are columns."""
    return with_language(queue, known, least).groupBy("language").agg(F.count("*").alias("queries")).orderBy(F.col("language") == "Unknown", "language")


def kv_collection(name: str) -> str:
    return "kv_" + name.replace(".", "_").replace("-", "_")


def kv_state(writes: DataFrame) -> DataFrame:
    """writes (id, key, value, at): the latest key and value of each id, from one write (of equally late ones the greatest), its first and last time."""
    last = F.max(F.struct("at", "key", "value")).alias("w")
    return writes.groupBy("id").agg(last, F.min("at").alias("created_at")).select("id", "w.key", "w.value", "created_at", F.col("w.at").alias("updated_at"))


def kv_id(collection: str, key):
    return uuid5(F.concat(F.lit(f"{kv_collection(collection)}:"), key))


def kv_by_key(entries: DataFrame, key: str) -> DataFrame:
    return entries.where(F.col("key") == key)


def kv_collections(collections: DataFrame) -> DataFrame:
    """Names with the prefix kv_, without it; feedback collections of that prefix are among them."""
    return collections.where(F.col("name").startswith("kv_")).select(F.substring("name", 4, 1 << 20).alias("name"), "points")


def primary(collections: DataFrame) -> DataFrame:
    """Collections to search: by their alias if they have one, not set aside by name, and of kind documents where the kind is known."""
    n = F.coalesce(F.nullif(F.col("alias"), F.lit("")), "name") if "alias" in collections.columns else F.col("name")
    kind = F.col("kind") == "documents" if "kind" in collections.columns else F.lit(True)
    aside = n.startswith("kv_") | n.endswith("_faq") | n.endswith("_feedback") | (n == "system_config") | n.startswith("__") | n.contains("_migration_")
    return collections.where(~aside & (n != "") & kind)


def admin_statistics(collections: DataFrame, aliases: DataFrame) -> DataFrame:
    """Collections with their alias and kind; the kind follows the alias if there is one."""
    shown = collections.join(aliases.select(F.col("collection").alias("name"), "alias"), "name", "left")
    return shown.withColumn("kind", F.when(F.coalesce("alias", "name").endswith("_faq"), "faq").otherwise("documents"))


def totals_by_kind(statistics: DataFrame) -> DataFrame:
    return statistics.agg(F.count("*").alias("collections"), F.coalesce(F.sum(F.when(F.col("kind") == "documents", F.col("points"))), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("kind") == "faq", F.col("points"))), F.lit(0)).alias("faqs"))


def run_dashboard(runs: DataFrame) -> DataFrame:
    done = F.when(F.col("total") > 0, F.bround(F.col("processed") * 100.0 / F.col("total"), 0)).otherwise(0.0)
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.avg(done).alias("progress"))


def recent_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def may_start(runs: DataFrame, collection: str) -> bool:
    """Whether no run of the collection is active."""
    return runs.where((F.col("collection_name") == collection) & F.col("status").isin("queued", "running", "cancelling")).isEmpty()
