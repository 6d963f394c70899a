"""Schemas of the collection families, and their creation in a store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..operators.migrate import family
from .changelog import Collection
from .store import Store

_VECTORS = "dense array<float>, late array<array<float>>"
_SOURCES = "source_documents array<struct<document_id:string,url:string,extracted_at:string,confidence:double>>"
#: Columns of each family; `config` and `feedback` have no late vectors.
FAMILIES = {
    "document": f"doc_id string, url string, title string, content string, content_hash string, domain string, hyperlinks array<string>, indexed_at timestamp, {_VECTORS}",
    "faq": f"faq_id string, question string, answer string, question_hash string, {_SOURCES}, source_count int, aggregated_confidence double, first_seen string, last_updated string, document_id string, {_VECTORS}",
    "kv": f"id string, key string, value string, created_at timestamp, updated_at timestamp, {_VECTORS}",
    "feedback": "id string, query string, text string, search_score double, user_rating int, ranking_score int, rating_session_id string, content_type string, created_at timestamp, dense array<float>",
    "queue": "id string, query string, query_normalized string, collection_name string, created_at timestamp, dense array<float>",
    "config": "key string, value string, updated_at timestamp",
}
#: The key of each family, and the columns that can be looked up without reading all files.
KEYS = {"document": "doc_id", "faq": "faq_id", "kv": "id", "feedback": "id", "queue": "id", "config": "key"}
INDEXES = {
    "document": ("url", "domain", "content_hash", "indexed_at"),
    "faq": ("question_hash", "source_documents.document_id", "first_seen", "last_updated", "document_id"),
    "kv": ("key",),
    "queue": ("query_normalized",),
}


def family_of(name: str) -> str:
    if name == "system_config":
        return "config"
    if name.endswith("_feedback"):
        return "feedback"
    return "queue" if name.endswith("query_queue") else family(name)


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(FAMILIES[family_of(name)])


def created(store: Store, name: str) -> str:
    """Creates a collection with the schema of its family if it isn't there; feedback and queue ones are made anew if theirs is another.  Returns the family."""
    kind = family_of(name)
    store.create(name, schema_of(name), replace_if_different=kind in ("feedback", "queue"))
    return kind


def collection(spark: SparkSession, root: str, name: str) -> Collection:
    """The collection as a log of changes with its family's key and indexes; made with its columns if it isn't there."""
    kind = family_of(name)
    out = Collection(spark, root, name, KEYS[kind], INDEXES.get(kind, ()))
    if not out.version():
        out.replace(spark.createDataFrame([], schema_of(name)), 0)
    return out
