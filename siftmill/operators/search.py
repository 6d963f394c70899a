"""Retrieval.  Collections are DataFrames with doc_id (or faq_id), dense, late (token vectors) and payload columns.

The query's vectors are literals, so every stage is a scan with a projected score and a top-k
(TakeOrderedAndProject): no shuffle of the collection, and only a limit's rows go on to the next
stage.  Candidates are found as ids, so the partitions' best that one task merges are no texts and
token vectors; a second scan takes the rows of these ids.  Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ids import document_id
from ..functions.urls import allowed_document, allowed_documents, domains
from ..plans import predicates, querylang
from . import graph

FAQ_PREFETCH, KV_PREFETCH, DUPLICATE_LIMIT = 30, 50, 5
FAQ_MIN_LATE, FAQ_MIN_DENSE, KV_MIN, TOOL_FAQ_MIN = 20.0, 0.55, 0.7, 25.0
#: Ids of candidates and of source documents that are taken to the driver once and go into plans as literals; more stay a table.
SOURCE_IDS = 10_000


@dataclass(frozen=True)
class Vectors:
    """An encoded query; late is None when that model is off."""

    dense: list[float]
    late: list[list[float]] | None = None


def _top(df: DataFrame, limit: int, key: str) -> DataFrame:
    return df.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def dense_top(df: DataFrame, query: Vectors, limit: int, where: Column | None = None, threshold: float | None = None, key: str = "doc_id") -> DataFrame:
    rows = df.where(F.col("dense").isNotNull())
    rows = rows if where is None else rows.where(where)
    scored = rows.withColumn("score", V.dot(F.col("dense"), V.constant(query.dense)))
    return _top(scored if threshold is None else scored.where(F.col("score") >= threshold), limit, key)


def late_top(df: DataFrame, query: Vectors, limit: int, where: Column | None = None, threshold: float | None = None, key: str = "doc_id") -> DataFrame:
    rows = df.where(F.col("late").isNotNull())
    rows = rows if where is None else rows.where(where)
    scored = rows.withColumn("score", V.max_sim(F.array(*(V.constant(v) for v in query.late)), F.col("late")))
    return _top(scored if threshold is None else scored.where(F.col("score") >= threshold), limit, key)


def _candidates(df: DataFrame, query: Vectors, limit: int, where: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The rows that dense_top gives, without score and order; key is unique.  A few ids are literals, which scans can push down."""
    best = dense_top(df, query, limit, where, key=key).select(key)
    if limit > SOURCE_IDS:
        return df.join(best, key, "left_semi")
    ids = [r[0] for r in best.collect()]
    return df.where(F.col(key).isin(*ids) if ids else F.lit(False))


def prefetch_size(limit: int, least: int = 100, times: int = 10) -> int:
    return max(times * limit, least)


def hybrid(
    df: DataFrame, query: Vectors, limit: int, where: Column | None = None, prefetch: int | None = None, extra: list[DataFrame] | None = None,
    threshold: float | None = None, boost: dict | None = None, key: str = "doc_id",
) -> DataFrame:
    """Dense candidates (and extra candidate lists), reranked by MaxSim, then by recency if boosted.

    Without late vectors it is the dense search; then extra lists have no effect, and thresholds
    have, which rerank ignores.  boost: now (a column), and days, midpoint.
    """
    if query.late is None:
        found = dense_top(df, query, limit, where, threshold, key)
        return found if boost is None else _top(found.withColumn("score", V.recency(F.col("score"), F.col("indexed_at"), **boost)), limit, key)
    candidates = _candidates(df, query, prefetch or prefetch_size(limit), where, key)
    for other in extra or []:
        candidates = candidates.unionByName(other.drop("score").join(candidates.select(key), key, "left_anti").select(candidates.columns))
    return _reranked(candidates, query, limit, prefetch or prefetch_size(limit), boost, key)


def _reranked(candidates: DataFrame, query: Vectors, limit: int, prefetch: int, boost: dict | None, key: str = "doc_id") -> DataFrame:
    if boost is None:
        return late_top(candidates, query, limit, key=key)
    ranked = late_top(candidates, query, max(2 * limit, prefetch), key=key)
    return _top(ranked.withColumn("score", V.recency(F.col("score"), F.col("indexed_at"), **boost)), limit, key)


def scanned(df: DataFrame, q: querylang.Query, limit: int, where: Column | None = None, predicate: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Queries without text: the first rows by id that the predicate keeps, with score 0."""
    rows = df if where is None else df.where(where)
    return rows.where(predicates.document_predicate(q) if predicate is None else predicate).orderBy(key).limit(limit).withColumn("score", F.lit(0.0))


def without_urls(df: DataFrame, urls: list[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col("url").isin(*urls), F.lit(False))) if urls else df


def faqs_without_urls(df: DataFrame, urls: list[str]) -> DataFrame:
    return df.where(~F.coalesce(F.exists("source_documents", lambda s: s["url"].isin(*urls)), F.lit(False))) if urls else df


def faq_search(faqs: DataFrame, query: Vectors, limit: int, least: float | None = None, where: Column | None = None) -> DataFrame:
    """At most FAQ_PREFETCH hits, those at the least score and over it."""
    floor = least if least is not None else FAQ_MIN_LATE if query.late else FAQ_MIN_DENSE
    return hybrid(faqs, query, limit, where, prefetch=FAQ_PREFETCH, key="faq_id").where(F.col("score") >= floor)


def kv_search(entries: DataFrame, query: Vectors, limit: int = 5, threshold: float = KV_MIN) -> DataFrame:
    limit = min(max(limit, 1), 50)
    return hybrid(entries, query, limit, prefetch=prefetch_size(limit, KV_PREFETCH), key="id").where(F.col("score") >= threshold)


def duplicate_faqs(faqs: DataFrame, query: Vectors) -> DataFrame:
    return hybrid(faqs, query, DUPLICATE_LIMIT, prefetch=FAQ_PREFETCH, key="faq_id")


def agent_search(df: DataFrame, query: Vectors, n: int, excluded: DataFrame) -> DataFrame:
    found = hybrid(df, query, 2 * n).join(excluded.select("doc_id"), "doc_id", "left_anti")
    return _top(found.where((F.coalesce("url", F.lit("")) != "") & (F.trim(F.coalesce("content", F.lit(""))) != "")), n, "doc_id")


def admin_search(df: DataFrame, query: Vectors, limit: int, key: str = "doc_id") -> DataFrame:
    return hybrid(df, query, limit, prefetch=max(5 * limit, 100), key=key)


def source_ids(faqs: DataFrame) -> DataFrame:
    """Ids of the documents behind FAQs, each once."""
    s = faqs.select(F.explode("source_documents").alias("s"))
    return s.select(F.coalesce(F.nullif(F.col("s.document_id"), F.lit("")), document_id(F.col("s.url"))).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()


@dataclass(frozen=True)
class Sources:
    """Documents behind FAQ hits: their number, and their ids (doc_id) as a table and, if they are few, as a list."""

    table: DataFrame
    count: int
    ids: tuple[str, ...] | None = None

    def marked(self, df: DataFrame) -> DataFrame:
        """df with `boosted_by_faqs`; a few ids are literals, which scans can push down."""
        if self.ids is not None:
            return df.withColumn("boosted_by_faqs", F.col("doc_id").isin(*self.ids) if self.ids else F.lit(False))
        mark = self.table.withColumn("_mark", F.lit(True))
        return df.join(mark, "doc_id", "left").withColumn("boosted_by_faqs", F.coalesce("_mark", F.lit(False))).drop("_mark")


def few_ids(ids: DataFrame) -> Sources:
    """ids (doc_id), evaluated once if there are few of them."""
    found = tuple(r[0] for r in ids.select("doc_id").limit(SOURCE_IDS + 1).collect())
    if len(found) > SOURCE_IDS:
        return Sources(ids, ids.count())
    return Sources(ids.sparkSession.createDataFrame([(x,) for x in found], "doc_id string"), len(found), found)


def boosted(df: DataFrame, query: Vectors, limit: int, sources: Sources, where: Column | None = None, boost: dict | None = None, filter_boosted: bool = False, prefetch: int | None = None) -> DataFrame:
    """The search with the FAQs' documents as further candidates; hits from them are marked.

    As in the service, these candidates pass the caller's filter by unless filter_boosted, and
    recency counts only if boost is given.  Candidates are two scans, the best of all without the marked
    ones and the marked ones, so they need no join with each other.
    """
    every, wide = sources.marked(df), limit + sources.count
    if query.late is None:
        return hybrid(every, query, wide, where, boost=boost)
    prefetch = prefetch or prefetch_size(wide)
    best = _candidates(every, query, prefetch, where).where(~F.col("boosted_by_faqs"))
    own = _candidates(every.where("boosted_by_faqs"), query, max(sources.count, 1), where if filter_boosted else None)
    return _reranked(best.unionByName(own), query, wide, prefetch, boost)


@dataclass
class Found:
    documents: DataFrame
    faqs: DataFrame
    related: DataFrame | None = None


def search(
    documents: DataFrame, faqs: DataFrame, text: str, query: Vectors, limit: int = 50, where: Column | None = None, exclude_urls: list[str] | None = None,
    now: Column | None = None, days: float = 1, midpoint: float = 0.5, power: float = 5.0, least_faq: float | None = None, mode: str = "reference", boost_keeps_recency: bool = False, prefetch: int | None = None,
) -> Found:
    """The full search.  prefetch: dense candidates, ten times the wider limit as in the service if not given.  mode `reference` filters hits afterwards (fewer than limit may stay) and gives FAQ hits no times; `pushdown` filters before the top-k."""
    q = querylang.parse(text)
    wide = querylang.candidate_limit(limit)
    documents, faqs = without_urls(documents, exclude_urls or []), faqs_without_urls(faqs, exclude_urls or [])
    if not q.has_text:
        return Found(scanned(documents, q, limit, where), scanned(faqs, q, limit, predicate=predicates.faq_predicate(q), key="faq_id"))
    keep = predicates.document_predicate(q) if q.has_filters else F.lit(True)
    push = mode == "pushdown"
    inside = keep if where is None else where & keep
    boost = {"now": now, "days": days, "midpoint": midpoint} if now is not None and query.late is not None else None
    faq_hits = faq_search(faqs, query, limit, least_faq)
    faq_hits = faq_hits.where(predicates.faq_predicate(q, with_times=push)) if q.has_filters else faq_hits
    sources = few_ids(source_ids(faq_hits))  # of at most FAQ_PREFETCH hits
    if sources.count and query.late is not None:
        hits = boosted(documents, query, wide, sources, inside if push else where, boost if boost_keeps_recency else None, push, prefetch)
    else:
        hits = hybrid(documents, query, wide, inside if push else where, prefetch, boost=boost).withColumn("boosted_by_faqs", F.lit(False))
    page = _top(hits if push else hits.where(keep), limit, "doc_id")
    return Found(V.contrasted(page, power), faq_hits)


def knowledge_base(
    documents: DataFrame, faqs: DataFrame, text: str, query: Vectors, limit: int = 10, allowed: list[str] | None = None,
    follow_links: bool = False, max_hops: int = 1, max_related: int = 5, least_faq: float | None = None, strict_links: bool = False, links: DataFrame | None = None, prefetch: int | None = None,
) -> Found:
    """Domain-scoped search: FAQs first, their documents as candidates (and prefetch dense ones), then linked documents (by `links` of graph.walkable, if given).

    A `site:` without a glob also scopes to that domain, and is checked exactly afterwards.
    strict_links: as the service does it, links of the hits themselves are not followed.
    """
    q = querylang.parse(text)
    scope = domains([*(allowed or []), *(s for s in q.any_of.get("site", ()) if not set(s) & set("*?["))])
    if scope:
        ids = allowed_documents(documents, scope)
        documents = documents.where(allowed_document(scope))
        inside = faqs.select("faq_id", F.explode("source_documents").alias("s")).join(ids, F.col("s.document_id") == F.col("doc_id"), "left_semi").select("faq_id").distinct()
        faqs = faqs.join(inside, "faq_id", "left_semi")
    limit = min(max(limit, 1), 50)
    if q.has_text:
        faq_hits = faq_search(faqs, query, limit, least_faq)
        faq_hits = faq_hits.where(predicates.faq_predicate(q, with_times=False)) if q.has_filters else faq_hits
        sources = few_ids(source_ids(faq_hits).join(documents.select("doc_id"), "doc_id", "left_semi"))
        hits = boosted(documents, query, querylang.candidate_limit(limit), sources, prefetch=prefetch)
        sources = sources.table
        hits = _top(hits.where(predicates.document_predicate(q)) if q.has_filters else hits, limit, "doc_id")
    else:
        faq_hits = scanned(faqs, q, limit, predicate=predicates.faq_predicate(q), key="faq_id")
        sources = source_ids(faq_hits)
        hits = scanned(documents, q, limit).withColumn("boosted_by_faqs", F.lit(False))
    related = None
    if follow_links:
        seeds = hits.select("doc_id").unionByName(sources.select("doc_id")).distinct()
        own = hits.select("doc_id")
        seeds = seeds.join(own, "doc_id", "left_anti") if strict_links else seeds
        related = graph.related(documents, seeds.withColumn("pos", F.row_number().over(graph.by("doc_id"))), min(max(max_hops, 0), 3), min(max(max_related, 0), 20), own, links=links)
    return Found(hits, faq_hits, related)


def faq_tool(documents: DataFrame, faqs: DataFrame, query: Vectors, limit: int = 10, least: float = TOOL_FAQ_MIN, allowed: list[str] | None = None) -> DataFrame:
    if scope := domains(allowed or []):
        ids = allowed_documents(documents, scope)
        inside = faqs.select("faq_id", F.explode("source_documents").alias("s")).join(ids, F.col("s.document_id") == F.col("doc_id"), "left_semi").select("faq_id").distinct()
        faqs = faqs.join(inside, "faq_id", "left_semi")
    return faq_search(faqs, query, min(max(limit, 1), 50), least)
