"""Garbage collection by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(now: Column, days: int = 30, pdf_days: int = 365) -> Column:
    """Documents older than their kind may be; without a time they never are."""
    cut = lambda n: now - F.make_dt_interval(F.lit(n))
    pdf = F.endswith("url", F.lit(".pdf"))
    return F.coalesce((~pdf & (F.col("indexed_at") < cut(days))) | (pdf & (F.col("indexed_at") < cut(pdf_days))), F.lit(False))


def document_report(documents: DataFrame, now: Column, days: int = 30, pdf_days: int = 365) -> DataFrame:
    """What a dry run says (all documents past the shorter age, PDFs included) and what is deleted."""
    old = F.coalesce(F.col("indexed_at") < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return documents.agg(F.count("*").alias("total"), F.count_if(old).alias("dry_run"), F.count_if(expired(now, days, pdf_days)).alias("deleted"))


def faq_fates(faqs: DataFrame, documents: DataFrame, cutoff: Column) -> DataFrame:
    """faq_id, fate: orphan (no source names a document), stale (no source's document is as fresh as the cutoff), fresh."""
    s = faqs.select("faq_id", F.explode_outer("source_documents").alias("s")).select("faq_id", F.nullif(F.col("s.document_id"), F.lit("")).alias("doc_id"))
    joined = s.join(documents.select("doc_id", "indexed_at"), "doc_id", "left")
    fresh = F.coalesce(F.max((F.col("indexed_at") >= cutoff).cast("int")), F.lit(0)) == 1
    return joined.groupBy("faq_id").agg(F.when(F.count("doc_id") == 0, "orphan").when(fresh, "fresh").otherwise("stale").alias("fate"))


def faq_report(fates: DataFrame) -> DataFrame:
    f = F.col("fate")
    return fates.agg(F.count("*").alias("total"), F.count_if(f == "orphan").alias("orphans"), F.count_if(f == "stale").alias("would_delete"), F.count_if(f != "fresh").alias("deleted"))
