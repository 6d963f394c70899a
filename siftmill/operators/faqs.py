"""Questions and answers with several sources.

A table of FAQs has faq_id, question, answer, question_hash, source_documents (array of
document_id, url, extracted_at, confidence), document_id (the legacy single source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.ids import document_id, faq_id, question_hash

SOURCE = "array<struct<document_id:string,url:string,extracted_at:string,confidence:double>>"


def confidence_of(sources: Column) -> Column:
    """The highest; a missing one is 1, no source at all is 0."""
    return F.coalesce(F.array_max(F.transform(sources, lambda s: F.coalesce(s["confidence"], F.lit(1.0)))), F.lit(0.0))


def with_totals(faqs: DataFrame) -> DataFrame:
    return faqs.withColumns({"source_count": F.size("source_documents"), "aggregated_confidence": confidence_of(F.col("source_documents"))})


def identified(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"faq_id": faq_id(F.col("question"), F.col("answer")), "question_hash": question_hash(F.col("question"))})


def merged(incoming: DataFrame) -> DataFrame:
    """incoming (faq_id, question, answer, document_id, url, confidence, extracted_at): one FAQ per id, one source per document, the latest extraction of each (of equally late ones the greatest url, then confidence)."""
    own = incoming.groupBy("faq_id", "document_id").agg(F.max_by(F.struct("url", "extracted_at", "confidence"), F.struct("extracted_at", "url", "confidence")).alias("s"), F.min(F.struct("extracted_at", "question", "answer")).alias("q"))
    source = F.struct("document_id", F.col("s.url").alias("url"), F.col("s.extracted_at").alias("extracted_at"), F.col("s.confidence").alias("confidence"))
    out = own.groupBy("faq_id").agg(F.sort_array(F.collect_list(source)).alias("source_documents"), F.min("q").alias("q"), F.max("s.extracted_at").alias("last_updated"))
    return with_totals(out.select("faq_id", F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), "source_documents", F.col("q.extracted_at").alias("first_seen"), "last_updated"))


def upserted(faqs: DataFrame, incoming: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Sources put into FAQs: one row a FAQ, with action created, merged (some source is new) or refreshed (all were known, and are overwritten unless keep_existing: then merged), or kept.

    incoming (faq_id, question, answer, document_id, url, confidence, extracted_at) may have any number
    of sources of a FAQ; of one document the latest extraction counts, as in merged.
    """
    new = merged(incoming).select(F.col("faq_id").alias("id"), F.col("question").alias("new_q"), F.col("answer").alias("new_a"), F.col("source_documents").cast(SOURCE).alias("put"))
    # a column of the result's name would stand for the result inside lambdas
    both = faqs.withColumnRenamed("source_documents", "had").join(new, F.col("faq_id") == F.col("id"), "full_outer")
    old, put = F.coalesce("had", F.array().cast(SOURCE)), F.coalesce("put", F.array().cast(SOURCE))
    ids = lambda sources: F.transform(sources, lambda x: x["document_id"])
    same = F.transform(old, lambda x: F.coalesce(F.try_element_at(F.filter(put, lambda y: y["document_id"] == x["document_id"]), F.lit(1)), x.cast(SOURCE[6:-1])))
    added = F.filter(put, lambda y: ~F.array_contains(ids(old), y["document_id"]))
    sources = F.concat(old.cast(SOURCE) if keep_existing else same, F.coalesce(added, F.array().cast(SOURCE)))
    action = F.when(F.col("id").isNull(), "kept").when(F.col("faq_id").isNull(), "created").when(F.size(added) > 0, "merged").otherwise("merged" if keep_existing else "refreshed")
    return with_totals(both.select(F.coalesce("faq_id", "id").alias("faq_id"), F.coalesce("question", "new_q").alias("question"), F.coalesce("answer", "new_a").alias("answer"), sources.alias("source_documents"), action.alias("action")))


def source_added(faqs: DataFrame, target: str, source: Column) -> DataFrame:
    """Appends to one FAQ unless it has that document: added, already_exists, or kept."""
    here = F.col("faq_id") == target
    known = F.exists("source_documents", lambda x: x["document_id"] == source["document_id"])
    new = F.when(here & ~known, F.concat("source_documents", F.array(source.cast(SOURCE[6:-1])))).otherwise(F.col("source_documents"))
    return with_totals(faqs.withColumn("action", F.when(here & known, "already_exists").when(here, "added").otherwise("kept")).withColumn("source_documents", new))


def source_removed(faqs: DataFrame, target: str, document: str, delete_if_last: bool = True, delete_first: bool = False) -> DataFrame:
    """Takes a document out of one FAQ: removed, deleted, source_not_found or kept.  delete_first: an FAQ without sources counts as deleted before the source is looked for."""
    here = F.col("faq_id") == target
    rest = F.filter("source_documents", lambda x: ~(x["document_id"] == document))
    known, gone = F.size(rest) < F.size("source_documents"), F.size(rest) == 0
    deleted = here & gone & F.lit(delete_if_last)
    order = F.when(deleted, "deleted").when(here & ~known, "source_not_found") if delete_first else F.when(here & ~known, "source_not_found").when(deleted, "deleted")
    action = order.when(here, "removed").otherwise("kept")
    return with_totals(faqs.withColumn("action", action).withColumn("source_documents", F.when(F.col("action").isin("removed", "deleted"), rest).otherwise(F.col("source_documents"))))


def url_removed(faqs: DataFrame, url: str) -> DataFrame:
    """Takes a url's document out of every FAQ, in one pass: action updated, deleted or kept."""
    document = document_id(F.lit(url))
    rest = F.filter("source_documents", lambda x: ~((x["document_id"] == document) | F.coalesce(x["url"] == url, F.lit(False))))
    legacy = F.coalesce(F.col("document_id") == document, F.lit(False))
    hit = legacy | (F.size(rest) < F.size("source_documents"))
    action = F.when(hit & (F.size(rest) == 0), "deleted").when(hit, "updated").otherwise("kept")
    return with_totals(faqs.withColumn("action", action).withColumn("source_documents", F.when(hit, rest).otherwise(F.col("source_documents"))))


def cascade(documents: DataFrame, faqs: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """Deletes a document and takes it out of all FAQs."""
    return documents.where(F.col("doc_id") != document_id(F.lit(url))), url_removed(faqs, url).where("action <> 'deleted'").drop("action")


def with_legacy_source(faqs: DataFrame) -> DataFrame:
    """FAQs without sources but with a document_id get that one as source."""
    one = F.array(F.struct(F.col("document_id"), F.lit(None).cast("string").alias("url"), F.col("first_seen").cast("string").alias("extracted_at"), F.lit(1.0).alias("confidence"))).cast(SOURCE)
    none = F.size(F.coalesce("source_documents", F.array().cast(SOURCE))) == 0
    return faqs.withColumn("source_documents", F.when(none & (F.coalesce("document_id", F.lit("")) != ""), one).otherwise(F.coalesce("source_documents", F.array().cast(SOURCE))))


def response(faqs: DataFrame) -> DataFrame:
    sources = with_legacy_source(faqs)
    highest = F.array_max(F.transform("source_documents", lambda s: F.coalesce(s["confidence"], F.lit(1.0))))
    return sources.withColumns({"source_count": F.size("source_documents"), "aggregated_confidence": F.coalesce(highest, F.lit(1.0))})


def of_document(faqs: DataFrame, document: str, cap: int | None = None) -> DataFrame:
    """FAQs that have the document as a source; with a cap the first so many by id (the service's page is 200)."""
    own = faqs.where(F.exists("source_documents", lambda s: s["document_id"] == document))
    return own if cap is None else own.orderBy("faq_id").limit(cap)


def exploded(faqs: DataFrame) -> DataFrame:
    return faqs.select("faq_id", "question", "answer", F.explode("source_documents").alias("s")).select("faq_id", "question", "answer", F.col("s.document_id").alias("document_id"), F.col("s.confidence").alias("confidence"))


def counts_per_document(documents: DataFrame, faqs: DataFrame) -> DataFrame:
    n = exploded(faqs).groupBy("document_id").agg(F.countDistinct("faq_id").alias("faq_count"))
    return documents.select("doc_id").join(n, F.col("doc_id") == F.col("document_id"), "left").select("doc_id", F.coalesce("faq_count", F.lit(0)).alias("faq_count"))


def document_detail(documents: DataFrame, faqs: DataFrame, document: str, cap: int | None = None) -> DataFrame:
    own = of_document(faqs, document, cap).agg(F.sort_array(F.collect_list("faq_id")).alias("faqs"))
    return documents.where(F.col("doc_id") == document).crossJoin(F.broadcast(own))


def source_statistics(faqs: DataFrame) -> DataFrame:
    """One row of totals; averages to two decimals, shares to one, halves to even."""
    n = F.size("source_documents")
    total, several = F.count("*"), F.count_if(n > 1)
    return faqs.agg(total.alias("total_faqs"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_sources"), F.coalesce(F.bround(F.avg(n), 2), F.lit(0.0)).alias("avg_sources"), several.alias("multi_source_faqs"), F.coalesce(F.bround(F.try_divide(several * 100.0, total), 1), F.lit(0.0)).alias("multi_source_percent"))


def source_histogram(faqs: DataFrame) -> DataFrame:
    return faqs.groupBy(F.size("source_documents").alias("source_count")).agg(F.count("*").alias("faqs"))


def listed(faqs: DataFrame, document: str | None = None, after: str | None = None, limit: int = 50) -> DataFrame:
    rows = faqs if document is None else faqs.where(F.exists("source_documents", lambda s: s["document_id"] == document))
    return (rows if after is None else rows.where(F.col("faq_id") > after)).orderBy("faq_id").limit(limit)


def normalised_generated(generated: DataFrame) -> DataFrame:
    """generated (pos, question, answer, confidence): blanks dropped; of one question (whatever its case) the last row, at the first one's place."""
    good = generated.withColumns({"question": F.trim("question"), "answer": F.trim("answer")}).where("question <> '' and answer <> ''")
    row = F.struct("question", "answer", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return good.groupBy(F.lower("question").alias("k")).agg(F.max_by(row, "pos").alias("r"), F.min("pos").alias("pos")).select("pos", "r.*")


def sync_plan(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """For one or more documents: what a new generation does to each question.

    generated (document_id, pos, question, answer, confidence), existing (document_id, faq_id,
    question_hash; FAQs that have the document as source).  Of equal questions the one with the
    highest confidence counts, the later of equals.  A question that keeps its answer is refreshed,
    a new one created, one with another answer reassigned (from old_faq_id), and an existing one
    that isn't generated again is stale.
    """
    rows = identified(generated.withColumns({"question": F.trim("question"), "answer": F.trim("answer")}).where("question <> '' and answer <> ''"))
    rows = rows.withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    best = rows.groupBy("document_id", "question_hash").agg(F.max_by("faq_id", F.struct("confidence", "pos")).alias("new_faq_id"))
    old = existing.groupBy("document_id", "question_hash").agg(F.min("faq_id").alias("old_faq_id"))
    both = best.join(old, ["document_id", "question_hash"], "full_outer")
    action = F.when(F.col("new_faq_id").isNull(), "stale").when(F.col("old_faq_id").isNull(), "created").when(F.col("new_faq_id") == F.col("old_faq_id"), "refreshed").otherwise("reassigned")
    return both.withColumn("action", action)


def _generation(faqs: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written once: the best answer of each document's question, and the FAQs that the generated documents are sources of (faq_id, d, question_hash)."""
    good = identified(generated.withColumns({"question": F.trim("question"), "answer": F.trim("answer")}).where("question <> '' and answer <> ''"))
    good = good.withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    row = F.struct("faq_id", "question", "answer", "url", "extracted_at", "confidence")
    best = good.groupBy("document_id", "question_hash").agg(F.max_by(row, F.struct("confidence", "pos")).alias("r")).select("document_id", "question_hash", "r.*")
    sources = faqs.select("faq_id", question_hash(F.col("question")).alias("question_hash"), F.explode("source_documents.document_id").alias("d"))
    held = sources.join(generated.select(F.col("document_id").alias("d")).distinct(), "d", "left_semi")
    return scratch.written(best, "faq-best"), scratch.written(held, "faq-held")


def _left(best: DataFrame, held: DataFrame, remove_stale: bool) -> DataFrame:
    """(faq_id, d): the sources that a new generation takes out."""
    now = best.select(F.col("document_id").alias("d"), "question_hash", F.col("faq_id").alias("new_id"))
    match = held.join(now, ["d", "question_hash"], "left")
    return match.where((F.col("new_id") != F.col("faq_id")) | (F.col("new_id").isNull() & F.lit(remove_stale))).select("faq_id", "d")


def synced(faqs: DataFrame, generated: DataFrame, remove_stale: bool = True) -> DataFrame:
    """Applies sync_plan: FAQs after the sync, with `fate`: kept, created, merged, refreshed, removed_source or deleted (these have no source left).

    generated as in sync_plan, and url, extracted_at.  Every document of it is synced: its questions
    are put into the FAQs, and it is taken out of FAQs whose question it has another answer to now,
    and, if remove_stale, of those it doesn't ask any more.
    """
    best, held = _generation(faqs, generated)
    return _applied(faqs, best, held, remove_stale)


def _applied(faqs: DataFrame, best: DataFrame, held: DataFrame, remove_stale: bool) -> DataFrame:
    gone = _left(best, held, remove_stale).groupBy("faq_id").agg(F.collect_set("d").alias("gone"))
    after = upserted(faqs, best).withColumnRenamed("source_documents", "had").join(gone, "faq_id", "left")
    rest = F.filter("had", lambda x: ~F.coalesce(F.array_contains("gone", x["document_id"]), F.lit(False)))
    fate = F.when(F.col("gone").isNull(), F.col("action")).when(F.size(rest) == 0, "deleted").when(F.col("action") == "kept", "removed_source").otherwise(F.col("action"))
    return with_totals(after.select("faq_id", "question", "answer", fate.alias("fate"), rest.alias("source_documents")))


def sync_counters(faqs: DataFrame, generated: DataFrame, remove_stale: bool = True) -> DataFrame:
    """What a sync does, by document of generated: questions created, merged, refreshed, reassigned (another answer) and stale; and the FAQs that it is taken out of, removed_sources, and deleted, which have no source then.

    Of several documents that leave an FAQ without a source the last one by id deletes it.
    """
    best, held = _generation(faqs, generated)
    now = best.select(F.col("document_id").alias("d"), "question_hash", F.col("faq_id").alias("new_id"))
    old = held.groupBy("d", "question_hash").agg(F.min("faq_id").alias("old_id"))
    plan = now.join(old, ["d", "question_hash"], "full_outer")
    known = plan.join(faqs.select(F.col("faq_id").alias("new_id"), F.lit(True).alias("known")), "new_id", "left")
    marked = known.join(held.select("d", F.col("faq_id").alias("new_id"), F.lit(True).alias("mine")).distinct(), ["d", "new_id"], "left")
    made = F.col("new_id").isNotNull()
    asked = marked.groupBy("d").agg(
        F.count_if(made & F.col("known").isNull()).alias("created"), F.count_if(made & F.col("known") & F.col("mine").isNull()).alias("merged"),
        F.count_if(F.coalesce("mine", F.lit(False))).alias("refreshed"), F.count_if(made & (F.col("new_id") != F.col("old_id"))).alias("reassigned"), F.count_if(~made).alias("stale"),
    )
    out = _left(best, held, remove_stale)
    empty = _applied(faqs, best, held, remove_stale).where("fate = 'deleted'").select("faq_id", F.lit(True).alias("empty"))
    last = out.join(empty, "faq_id", "left").groupBy("faq_id").agg(F.when(F.max("empty"), F.max("d")).alias("last"))
    taken = out.join(last, "faq_id").withColumn("deletes", F.coalesce(F.col("d") == F.col("last"), F.lit(False)))
    taken = taken.groupBy("d").agg(F.count_if(~F.col("deletes")).alias("removed_sources"), F.count_if("deletes").alias("deleted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(taken, "d", "full_outer").select(F.col("d").alias("document_id"), *(zero(c) for c in ("created", "merged", "refreshed", "reassigned", "stale", "removed_sources", "deleted")))


def reviewed(faqs: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies reviewed entries: the FAQs after them, and each submission with `faq_id` and `action`.

    submissions (submission, question, answer, source_url, document_id, merge_with_id, extracted_at):
    the source, whose document is that of its url if none is given, is put into the FAQ merge_with_id,
    which keeps its question and answer (merged, or refreshed if it had the document), or into that of
    the question and answer (created if there is none).  A merge into an unknown FAQ is not_found and
    changes nothing.  Confidence is 1.  All submissions see the FAQs as they were.
    """
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = submissions.withColumns({"document_id": F.coalesce(given("document_id"), document_id(F.col("source_url"))), "target": F.coalesce(given("merge_with_id"), faq_id(F.col("question"), F.col("answer"))), "asked": given("merge_with_id").isNotNull()})
    known = faqs.select(F.col("faq_id").alias("target"), F.col("source_documents.document_id").alias("had"))
    rows = scratch.written(rows.join(known, "target", "left"), "faq-reviewed")
    action = F.when(F.col("had").isNull(), F.when(F.col("asked"), "not_found").otherwise("created")).when(F.array_contains("had", F.col("document_id")), "refreshed").otherwise("merged")
    rows = rows.withColumn("action", action)
    put = rows.where("action <> 'not_found'").select(F.col("target").alias("faq_id"), "question", "answer", "document_id", F.col("source_url").alias("url"), F.lit(1.0).alias("confidence"), "extracted_at")
    return upserted(faqs, put).drop("action"), rows.select("submission", F.col("target").alias("faq_id"), "action")
