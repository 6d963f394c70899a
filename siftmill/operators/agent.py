"""Gates, markers and the rounds of the FAQ agent; models are callables from tables to tables that are given in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Characters of a text in each part of a prompt.
PROMPT_CHARS = {"snippet": 900, "faq": 1400, "candidate": 1800, "inspected": 3200, "document": 5000}


def needs_processing(run_id: Column, forced: Column) -> Column:
    """Why a document (content, content_hash, marker struct) is or isn't processed.

    The marker's own skip status is written with a longer name than the one tested here, so an
    unchanged document is skipped in one run and processed in the next, as in the service.
    """
    m = F.col("marker")
    return (
        F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "skip_empty")
        .when(F.coalesce(m["last_run_id"] == run_id, F.lit(False)), "skip_same_run")
        .when(forced, "process")
        .when(F.coalesce((m["content_hash"] == F.col("content_hash")) & m["status"].isin("processed", "skipped_unchanged"), F.lit(False)), "skip_unchanged")
        .otherwise("process")
    )


def marked(documents: DataFrame, **values: Column) -> DataFrame:
    """Puts values into the marker struct; its other fields stay."""
    new = F.col("marker")
    for name, value in values.items():
        new = new.withField(name, value)
    return documents.withColumn("marker", new)


def prompt_part(text: Column, part: str) -> Column:
    n = PROMPT_CHARS[part]
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n))), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def prompt(documents: DataFrame, supporting: DataFrame) -> DataFrame:
    """A message for each document: itself and up to five supporting ones (doc_id, pos, url, content)."""
    parts = supporting.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("Source: "), "url", F.lit("\n"), prompt_part(F.col("content"), "inspected")).alias("t")))), 1, 5).alias("s"))
    body = F.concat(F.lit("Document: "), "url", F.lit("\n"), prompt_part(F.col("content"), "document"))
    return documents.join(parts, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", body, F.array_join("s.t", "\n\n")).alias("prompt"))


def planned(documents: DataFrame, decide: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], known: DataFrame, budget: int = 6) -> DataFrame:
    """(doc_id, inspected: array, steps): search, inspect and follow links as `decide` says, until it finishes or the budget is spent.

    A step is one job for all documents that go on.  decide gets (doc_id, inspected, candidates, steps)
    and gives (doc_id, step, value); search and links get (doc_id, value) and give (doc_id, pos, found),
    which become the candidates.  Inspecting an id that isn't in known (doc_id), or again, changes
    nothing.  A document without a decision is finished.
    """
    none = F.array().cast("array<string>")
    state = scratch.written(documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().select("doc_id", none.alias("inspected"), none.alias("candidates"), F.lit(0).alias("steps"), F.lit(True).alias("on")), "agent-state")
    ids = known.select(F.col("doc_id").cast("string").alias("value"), F.lit(True).alias("there")).distinct()
    for _ in range(budget):
        active = state.where("on")
        if active.isEmpty():
            break
        said = scratch.written(decide(active.drop("on")).select("doc_id", "step", "value"), "agent-decisions")
        met = [f(said.where(F.col("step") == step).select("doc_id", "value")) for step, f in (("search", search), ("follow", links))]
        found = scratch.union([x.select("doc_id", "pos", "found") for x in met]).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "found"))), lambda x: x["found"]).alias("fresh"))
        said = said.join(ids, "value", "left")
        both = state.join(said, "doc_id", "left").join(found, "doc_id", "left")
        goes = F.col("on") & F.col("step").isin("search", "inspect", "follow")
        goes = F.coalesce(goes, F.lit(False))
        new = goes & (F.col("step") == "inspect") & F.coalesce("there", F.lit(False)) & ~F.array_contains("inspected", F.col("value"))
        inspected = F.when(new, F.concat("inspected", F.array("value"))).otherwise(F.col("inspected"))
        candidates = F.when(goes & F.col("step").isin("search", "follow"), F.coalesce("fresh", none)).otherwise(F.col("candidates"))
        state = scratch.written(both.select("doc_id", inspected.alias("inspected"), candidates.alias("candidates"), (F.col("steps") + goes.cast("int")).alias("steps"), goes.alias("on")), "agent-state")
    return state.select("doc_id", "inspected", "steps")


@dataclass
class Run:
    """A run's documents in order (doc_id, position, status), how many have each status, and the run's own status."""

    documents: DataFrame
    counts: dict[str, int]
    status: str


def _placed(seeds: DataFrame, processed: DataFrame) -> DataFrame:
    """(doc_id, place) of every id in the queue or handled: places sort as the queue would have been worked off.

    A seed has its own place; any other id comes right behind the first document that named it, in the
    order of names there.  Places settle from the seeds on, a level of names at a time.
    """
    names = processed.select(F.col("doc_id").alias("by"), F.posexplode("supporting").alias("k", "doc_id")).join(seeds.select("doc_id"), "doc_id", "left_anti")
    names = scratch.written(names.groupBy("by", "doc_id").agg(F.min("k").alias("k")), "run-names")
    places = seeds.select("doc_id", "place")
    while True:
        first = names.join(places.select(F.col("doc_id").alias("by"), "place"), "by").groupBy("doc_id").agg(F.min(F.struct("place", "k")).alias("f"))
        now = seeds.select("doc_id", "place").unionByName(first.select("doc_id", F.concat("f.place", F.array(F.col("f.k").cast("bigint"))).alias("place")))
        now = scratch.written(now, "run-places")
        if now.exceptAll(places).isEmpty():
            return now
        places = now


def run(
    seeds: DataFrame, process: Callable[[DataFrame], DataFrame], limit: int, batch: int = 64, cancelled: Callable[[], bool] = lambda: False, handled: DataFrame | None = None
) -> Run:
    """Works off a queue of documents that grows at its front: what a document names comes right after it, unless it is queued or handled.

    seeds (doc_id, pos) is the queue at the start, process gets (doc_id) of some documents and gives
    (doc_id, status, supporting: array of ids) of each; one that it gives nothing for is `missing`.
    The result is that of working one by one until `limit` documents are done, but a round is one job
    for the next `batch` documents among the first `limit` of the queue as it is known; work on
    documents that turn out to lie behind the limit is left out.  cancelled is asked before each
    round; then documents count up to the first one that isn't done.  handled (doc_id): ids that an
    earlier part of the run has done.  Null ids are left out.
    """
    if limit <= 0:
        return Run(seeds.sparkSession.createDataFrame([], "doc_id string, position int, status string"), {}, "completed")
    start = seeds.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("pos").alias("pos"))
    start = start if handled is None else start.join(handled.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_anti")
    start = scratch.written(start.select("doc_id", F.array(F.col("pos").cast("bigint")).alias("place")), "run-seeds")
    done, status = start.sparkSession.createDataFrame([], "doc_id string, status string, supporting array<string>"), "completed"
    while True:
        places = _placed(start, done)
        first = places.orderBy("place", "doc_id").limit(limit)
        ordered = scratch.written(first.join(done, "doc_id", "left"), "run-order")
        todo = ordered.where("status is null").orderBy("place", "doc_id").limit(batch)
        if todo.isEmpty():
            break
        if cancelled():
            status = "cancelled"
            break
        some = scratch.written(todo.select("doc_id"), "run-batch")
        got = process(some).select("doc_id", "status", F.coalesce("supporting", F.array().cast("array<string>")).alias("supporting"))
        got = some.join(got, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("missing")).alias("status"), F.filter(F.coalesce("supporting", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("supporting"))
        if handled is not None:
            gone = handled.select(F.col("doc_id").cast("string").alias("one")).distinct()
            named = got.select("doc_id", F.posexplode_outer("supporting").alias("k", "one")).join(gone, "one", "left_anti")
            named = named.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("one").isNotNull(), F.struct("k", "one")))), lambda x: x["one"]).alias("named"))
            got = got.join(named, "doc_id", "left").select("doc_id", "status", F.coalesce("named", F.array().cast("array<string>")).alias("supporting"))
        done = scratch.written(done.unionByName(got), "run-done")
    at = F.row_number().over(Window.orderBy("place", "doc_id"))  # of at most `limit` rows
    out = ordered.withColumn("position", at)
    whole = out.where("status is null").agg(F.min("position")).first()[0]
    out = out.where(F.col("status").isNotNull() if whole is None else F.col("position") < whole)
    out = scratch.written(out.select("doc_id", "position", "status"), "run-documents")
    return Run(out, {r["status"]: r["count"] for r in out.groupBy("status").count().collect()}, status)


def cancellation(status: str) -> str:
    """What a request to cancel makes of a run's status: an ended run stays as it is, any other is stopping."""
    return status if status in ("completed", "failed", "cancelled") else "stopping"
