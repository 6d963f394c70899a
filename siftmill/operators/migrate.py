"""Re-embedding by snapshot and pointer."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import faq_text, kv_text


def family(name: str) -> str:
    return "kv" if name.startswith("kv_") else "faq" if name.endswith("_faq") else "document"


def migration_name(alias: str, at: datetime) -> str:
    return f"{alias}_migration_{at:%Y%m%d_%H%M%S}"


def text_to_embed(kind: str) -> Column:
    return {"kv": lambda: kv_text(F.col("key"), F.col("value")), "faq": lambda: faq_text(F.col("question"), F.col("answer")), "document": lambda: F.col("content")}[kind]()


def collections_to_process(collections: DataFrame, aliases: DataFrame) -> DataFrame:
    """Without feedback and orphan migrations; an alias stands for the collection behind it."""
    named = collections.join(aliases.select(F.col("collection").alias("name"), "alias"), "name", "left")
    orphan = F.col("name").contains("_migration_") & F.col("alias").isNull()
    return named.where(~F.col("name").endswith("_feedback") & ~orphan).select(F.coalesce("alias", "name").alias("name")).distinct()


def resolved(names: DataFrame, aliases: DataFrame) -> DataFrame:
    return names.join(aliases.select(F.col("alias").alias("name"), "collection"), "name", "left").select("name", F.coalesce("collection", "name").alias("backing"))


def mismatched(table: DataFrame, dimension: int) -> DataFrame:
    return table.where(F.col("dense").isNotNull() & (F.size("dense") != dimension))


def re_embedded(table: DataFrame, kind: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row with new vectors: embed adds `dense` to rows with `text_to_embed`.  Blank texts keep their row, without a vector; a failing batch fails the job."""
    rows = table.drop("dense").withColumn("text_to_embed", F.coalesce(text_to_embed(kind), F.lit("")))
    blank = F.trim("text_to_embed") == ""
    done = embed(rows.where(~blank))
    return done.unionByName(rows.where(blank), allowMissingColumns=True).drop("text_to_embed")


def check_alias(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        raise ValueError(f"not a collection name: {name}")
    return name
