"""Proportional stratified interleaving: every shard is the corpus in small.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its
rank over the size of its source.  Sorted by fractional rank, any stretch of rows holds the sources
in their proportions, so equal stretches make shards that match the mixture and whose counts differ
by one at most (the law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def interleaved(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    Only ids, sizes and hashes move; texts stay where they are read.  Both sorts are cut by ranges
    of a key that ends in a hash and the row's place, so a source with a third of all rows, or very
    many identical rows, spread over tasks.  A null source is a source of its own; null doc_ids share
    a hash and are ordered by their text's checksum; identical rows take neighbouring ranks in the
    order of reading.  An empty table gives no row.  grown_shard is null: this law doesn't bind a row
    to its shard when shards are added.
    """
    rows = docs.select(docs["doc_id"], docs["source"], docs["text"], F.monotonically_increasing_id().alias("tie"))
    return _planned(rows, shards, seed).drop("tie")


def _planned(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """The same, with `tie`, by which rows of equal content differ."""
    slim = rows.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(base.text_of(rows), "utf-8")).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("draw"),
        "tie",
    )
    slim, _ = base.written(slim, "shard-rows")
    drawn, _ = base.ordered_table(slim, ["source", "draw", "doc_id", "text_crc32", "tie"], "shard-drawn")
    drawn = base.with_positions(drawn, "at")
    sources = drawn.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumnRenamed("source", "s")
    ranked = drawn.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("fraction", (F.col("at") - F.col("first") + 0.5) / F.col("n"))
    mixed, _ = base.ordered_table(ranked.drop("s", "first", "n", "at"), ["fraction", "source", "draw", "doc_id", "text_crc32", "tie"], "shard-mixed")
    total = mixed.count()
    mixed = base.with_positions(mixed, "at").withColumn("shard", F.expr(f"cast((at * {shards}) div {max(total, 1)} as int)"))
    begin = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return mixed.select("tie", "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17) -> DataFrame:
    """Writes docs, whole, to folders shard=0.. in slot order, and returns the plan it followed.

    A row is known by its place in a written copy, so rows with a null doc_id, with one doc_id or with
    equal content are all written, each once.  A column `shard` of docs gives way to the folder's.
    """
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "shard")).alias("row"), F.monotonically_increasing_id().alias("tie"))
    table, _ = base.written(whole, "shard-copy")
    plan, _ = base.written(_planned(table.select("row.doc_id", "row.source", "row.text", "tie"), shards, seed), "shard-plan")
    rows = table.join(plan.select("tie", "shard", "slot"), "tie")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", "shard").write.partitionBy("shard").parquet(path)
    return plan.drop("tie")
