"""Tables of documents: ingestion, keyed updates, reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.ids import document_id
from ..functions.text import content_hash, word_count

MIN_WORDS = 32


def stamped(incoming: DataFrame, now: Column) -> DataFrame:
    """Ids, hashes, word counts and the time of indexing, which overrides a caller's."""
    return incoming.withColumns({"doc_id": document_id(F.col("url")), "content_hash": content_hash(F.col("content")), "words": word_count(F.col("content")), "indexed_at": now})


def facts(incoming: DataFrame, now: Column, min_words: int = MIN_WORDS) -> DataFrame:
    """incoming (url, content, arrival, ..) without its content, stamped, with `early`: empty, content_too_short, or null.  Written, so that texts are read and hashed once."""
    blank, short = F.trim(F.coalesce("content", F.lit(""))) == "", F.col("words") < min_words
    rows = stamped(incoming, now).withColumn("early", F.when(blank, "empty").when(short, "content_too_short"))
    return scratch.written(rows.drop("content"), "ingest-facts")


def with_status(incoming: DataFrame, now: Column, min_words: int = MIN_WORDS, stored: DataFrame | None = None) -> DataFrame:
    """incoming (url, content, arrival): what becomes of each row, in `status` and `duplicate_of`; without content.

    empty: blank content.  content_too_short: under min_words.  duplicate_content: another document
    has the same hash, which is `duplicate_of` (its url).  refreshed: the collection knows the id.
    stored: the rest; a later row of the same id is a refresh, too.

    stored (doc_id, url, content_hash) is the collection before this batch.  A hash that it has belongs
    to its smallest doc_id, until a row of the batch gives that document other content; a document's
    own hash is never a duplicate.  Of rows whose hash nobody has the first arrival is the holder.
    All joins are of narrow facts; first rows and holders are one pre-aggregated row a hash, and
    adaptive execution splits a hash of very many rows.
    """
    rows = facts(incoming, now, min_words)
    valid = rows.where("early is null")
    none = lambda kind: F.lit(None).cast(kind)
    if stored is None:
        marked = rows.withColumns({"_own": none("string"), "_held_by": none("string")})
    else:
        known = stored.select(F.col("doc_id").alias("_id"), F.col("url").alias("_url"), F.col("content_hash").alias("_hash"))
        known = scratch.written(known.join(valid.select(F.col("content_hash").alias("_hash")).distinct(), "_hash", "left_semi").unionByName(
            known.join(valid.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")).distinct(), "ingest-known")
        own = known.groupBy(F.col("_id").alias("doc_id")).agg(F.min("_hash").alias("_own"), F.lit(True).alias("_known"))
        holder = known.groupBy("_hash").agg(F.min(F.struct("_id", "_url")).alias("h"))
        left = valid.join(own, "doc_id").where("content_hash <> _own").groupBy("doc_id").agg(F.min("arrival").alias("_until"))
        holder = holder.join(left, F.col("h._id") == F.col("doc_id"), "left").select(F.col("_hash"), F.col("h._id").alias("_holder"), F.col("h._url").alias("_held_by"), "_until")
        met = rows.withColumn("_key", F.when(F.col("early").isNull(), F.col("content_hash"))).join(holder, F.col("_key") == F.col("_hash"), "left").join(own, "doc_id", "left")
        held = F.col("_holder").isNotNull() & (F.col("_holder") != F.col("doc_id")) & ~F.col("_own").eqNullSafe(F.col("content_hash")) & (F.col("_until").isNull() | (F.col("_until") > F.col("arrival")))
        marked = scratch.written(met.withColumn("_held_by", F.when(held, F.col("_held_by"))).drop("_key", "_hash", "_holder", "_until"), "ingest-marked")
    free = marked.where("early is null and _held_by is null")
    first = free.groupBy("content_hash").agg(F.min(F.struct("arrival", "doc_id", "url")).alias("first")).withColumnRenamed("content_hash", "_first_hash")
    key = F.when(F.col("early").isNull() & F.col("_held_by").isNull() & ~F.col("_own").eqNullSafe(F.col("content_hash")), F.col("content_hash"))
    joined = marked.withColumn("_key", key).join(first, F.col("_key") == F.col("_first_hash"), "left")
    later = F.col("first.doc_id") != F.col("doc_id")
    status = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("_held_by").isNotNull() | later, "duplicate_content")
    status = status.otherwise("stored") if stored is None else status.when(F.col("_known"), "refreshed").otherwise("stored")
    of = F.coalesce("_held_by", F.when(later, F.col("first.url")))
    return joined.withColumns({"status": status, "duplicate_of": of}).drop("first", "_first_hash", "_key", "_own", "_held_by", "_known", "early")


def kept(incoming: DataFrame, statuses: DataFrame) -> DataFrame:
    """The whole rows to keep, the latest of each id; rows of incoming that agree in url and arrival are one.  Content is shuffled here, for the rows that stay."""
    last = statuses.where("status in ('stored', 'refreshed')").groupBy("doc_id").agg(F.max_by(F.struct("url", "arrival", "content_hash", "words", "indexed_at"), "arrival").alias("r"))
    rows = incoming.drop("doc_id", "content_hash", "words", "indexed_at").dropDuplicates(["url", "arrival"])
    return rows.join(last.select("doc_id", "r.*"), ["url", "arrival"])


def latest(df: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """The row of the highest version of each key, of equal versions that of the greatest ties, by default of all other columns that have an order; aggregated before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    ties = ties or [c for c in rest if c != version and "map<" not in df.schema[c].dataType.simpleString()]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *ties)).alias("r"))
    return best.select(*keys, *(F.col(f"r.`{c}`").alias(c) for c in rest)).select(df.columns)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins: table's rows whose key isn't changed, and the changes."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def with_fields(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrites the given top-level columns of the rows with a key in updates; others stay."""
    given = [c for c in updates.columns if c != key]
    new = updates.select(key, F.struct(*given).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns))


def without_ids(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def without_matching(table: DataFrame, predicate: Column) -> DataFrame:
    return table.where(~F.coalesce(predicate, F.lit(False)))


def by_ids(table: DataFrame, ids: list, key: str = "doc_id") -> DataFrame:
    """Missing ids are silently absent."""
    return table.where(F.col(key).isin(*ids)) if ids else table.limit(0)


def seed_ids(table: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    return table.select(key).orderBy(key).limit(limit)


def page(table: DataFrame, after, limit: int = 10, where: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The next rows by key after a cursor (None: from the start); the last key is the next cursor."""
    rows = table if where is None else table.where(where)
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def cursor_of(rows: DataFrame, table: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """One row about a page: the cursor of the next one (null after the last), and how many rows the table has."""
    after = F.when(F.count("*") == limit, F.max(key)).alias("next")
    return rows.agg(after).crossJoin(F.broadcast(table.agg(F.count("*").alias("total"))))


def recent_first(table: DataFrame, limit: int, offset: int = 0, key: str = "doc_id") -> DataFrame:
    return table.orderBy(F.desc_nulls_last("indexed_at"), F.desc(key)).offset(offset).limit(limit)


def count_of(table: DataFrame, where: Column | None = None) -> DataFrame:
    return (table if where is None else table.where(where)).agg(F.count("*").alias("n"))
