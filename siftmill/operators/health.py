"""Read-only probes of collections: the smallest query of each kind, and what it found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

_RESULT = "probe string, status string, found bigint, problem string"


def probes(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]], optional: tuple[str, ...] = ()) -> DataFrame:
    """probe, status, found, problem: each check's rows are counted, of one row at most if it is a search.

    ok: it ran.  degraded: an optional one failed.  unhealthy: another one failed.  One job a probe;
    a probe's failure is its result and doesn't stop the others.
    """
    rows = []
    for name, check in checks.items():
        try:
            rows.append((name, "ok", check().count(), None))
        except Exception as e:  # noqa: BLE001 what a probe meets is what it reports
            rows.append((name, "degraded" if name in optional else "unhealthy", None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, _RESULT)


def standard(documents: DataFrame, faqs: DataFrame, query: search.Vectors) -> dict[str, Callable[[], DataFrame]]:
    """Dense and hybrid search, FAQ search, a count and a one-row read."""
    return {
        "dense_search": lambda: search.dense_top(documents, query, 1),
        "hybrid_search": lambda: search.hybrid(documents, query, 1),
        "faq_search": lambda: search.dense_top(faqs, query, 1, key="faq_id"),
        "count": lambda: documents.agg(F.count("*")),
        "scroll": lambda: documents.limit(1),
    }


def overall(results: DataFrame) -> DataFrame:
    """status: healthy, degraded or unhealthy, as the worst probe; and how many failed."""
    bad = F.count_if(F.col("status") == "unhealthy")
    return results.agg(F.when(bad > 0, "unhealthy").when(F.count_if(F.col("status") == "degraded") > 0, "degraded").otherwise("healthy").alias("status"), F.count_if(F.col("status") != "ok").alias("failed"))
