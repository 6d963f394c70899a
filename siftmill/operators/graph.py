"""The graph of documents and their hyperlinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.ids import document_id
from ..functions.urls import link_ids, link_target


def by(*columns: str):
    return Window.orderBy(*columns)


def nodes(documents: DataFrame) -> DataFrame:
    """Documents with their links normalised, blank ones left out."""
    return documents.withColumn("hyperlinks", F.filter(F.transform(F.coalesce("hyperlinks", F.array().cast("array<string>")), link_target), lambda x: x != ""))


def edges(documents: DataFrame) -> DataFrame:
    """(src, k, dst): the k-th different target of a document; targets need not exist."""
    return documents.select(F.col("doc_id").alias("src"), F.posexplode(link_ids(F.col("hyperlinks"))).alias("k", "dst"))


def faq_seeds(faqs: DataFrame) -> DataFrame:
    """(doc_id, pos): documents behind FAQs in order of the FAQs and their sources, each once; faqs has `pos`."""
    s = faqs.select("pos", F.posexplode("source_documents").alias("k", "s"))
    ids = s.select("pos", "k", F.coalesce(F.nullif(F.col("s.document_id"), F.lit("")), document_id(link_target(F.col("s.url")))).alias("doc_id"))
    first = ids.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("pos", "k")).alias("f"))
    return first.select("doc_id", F.array(F.col("f.pos").cast("bigint"), F.col("f.k").cast("bigint")).alias("pos"))


#: Folders that the edges of a walk are dealt to by source; a level reads those of its ids.
BUCKETS = 64


def walkable(documents: DataFrame, linked: str = "doc_id") -> DataFrame:
    """The edges between documents that exist (src, k, dst), written once, in folders by source: what every level of a walk reads.

    linked: the column with the ids that links lead to.  Where several rows have one url and doc_id
    tells them apart, it is another column, and a link leads to each row that has the id.
    """
    links = edges(documents)
    if linked == "doc_id":
        links = links.join(documents.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    else:
        known = documents.select(F.col(linked).alias("target"), F.col("doc_id").alias("dst"))
        links = links.withColumnRenamed("dst", "target").join(known, "target").select("src", "k", "dst")
    links = links.withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(BUCKETS)).cast("int"))
    return scratch.written(links.repartition("bucket"), "walk-edges", by="bucket")


def related(documents: DataFrame, seeds: DataFrame, max_hops: int, max_documents: int, excluded: DataFrame | None = None, allowed: DataFrame | None = None, with_seeds: bool = False, links: DataFrame | None = None) -> DataFrame:
    """Breadth first from seeds (doc_id, pos: a number or an array of numbers): doc_id, hop, via (null for seeds), pos, relation, in order of discovery.

    pos is the array of places on the way from the seed, so places of any depth and width keep their order.

    A document is reached by the first one of the level before that links to it, and then by the
    place of the link.  Excluded and not allowed ones are in no result (excluded seeds are still
    expanded); ids that no document has are passed over.  Each level is a job of its own whose plan
    is the same at every depth: its written ids meet the written edges (`walkable`, made here if not
    given).  The walk ends at an empty level, or when there are max_documents to return.
    """
    spark = documents.sparkSession
    empty = "doc_id string, hop int, via string, pos array<bigint>, relation string"
    if max_documents <= 0 or max_hops < 0:
        return spark.createDataFrame([], empty)
    if seeds.schema["pos"].dataType.typeName() != "array":
        seeds = seeds.withColumn("pos", F.array("pos"))

    def inside(ids: DataFrame) -> DataFrame:
        return ids if allowed is None else ids.join(allowed.select("doc_id"), "doc_id", "left_semi")

    def returned(rows: DataFrame) -> DataFrame:
        return rows if excluded is None else rows.join(excluded.select("doc_id"), "doc_id", "left_anti")

    own = inside(seeds.join(documents.select("doc_id"), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    level = scratch.written(own.select("doc_id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.col("pos").cast("array<bigint>").alias("pos")), "walk-level")
    levels, enough = [level], 0
    for hop in range(1, max_hops + 1):
        if level.isEmpty():
            break
        links = walkable(documents) if links is None else links
        here = level.select(F.col("doc_id").alias("src"), "pos", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        reached = here.join(links, ["bucket", "src"])
        seen = scratch.union([x.select(F.col("doc_id").alias("dst")) for x in levels])
        first = reached.groupBy("dst").agg(F.min(F.struct("pos", "k", "src")).alias("f")).join(seen, "dst", "left_anti")
        # places within a level follow the places of the one before, and the links
        found = inside(first.withColumnRenamed("dst", "doc_id")).select("doc_id", F.lit(hop).alias("hop"), F.col("f.src").alias("via"), F.concat("f.pos", F.array(F.col("f.k").cast("bigint"))).alias("pos"))
        level = scratch.written(found, "walk-level")
        levels.append(level)
        if hop < max_hops:
            enough += returned(level).count()
            if enough >= max_documents:
                break
    out = returned(scratch.union(levels if with_seeds else levels[1:] or [level.limit(0)]))
    out = out.withColumn("relation", F.when(F.col("hop") == 0, "seed").otherwise("hyperlink"))
    return out.orderBy("hop", "pos", "doc_id").limit(max_documents)


def link_candidates(documents: DataFrame, inspected: DataFrame, excluded: DataFrame, max_hops: int, cap: int = 25, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, via, hop) of new link targets of inspected documents (doc_id, hop, pos) below max_hops: first source wins.  links: those of `walkable`, else all of documents."""
    fresh = (edges(documents) if links is None else links.drop("bucket")).join(inspected.where(F.col("hop") < max_hops).select(F.col("doc_id").alias("src"), "hop", "pos"), "src")
    fresh = fresh.join(excluded.select(F.col("doc_id").alias("dst")), "dst", "left_anti").join(inspected.select(F.col("doc_id").alias("dst")), "dst", "left_anti")
    first = fresh.groupBy("dst").agg(F.min(F.struct("pos", "k", "src", "hop")).alias("f"))
    return first.orderBy("f.pos", "f.k", "dst").limit(cap).select(F.col("dst").alias("doc_id"), F.col("f.src").alias("via"), (F.col("f.hop") + 1).alias("hop"))
