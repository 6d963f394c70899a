"""Name-based ids and hashes as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of RFC 4122, and the namespace of question/answer entries.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
FAQ_NAMESPACE = "a1b2c3d4e5f67890abcdef1234567890"


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """RFC 4122 version 5 id of a string, in text form; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def document_id(url: Column) -> Column:
    """The id of a document is that of its url as it stands."""
    return uuid5(url)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def faq_id(question: Column, answer: Column) -> Column:
    """Case counts, runs of white space don't."""
    return uuid5(F.concat(collapsed(question), F.lit("|"), collapsed(answer)), FAQ_NAMESPACE)


def question_hash(question: Column) -> Column:
    """Case doesn't count, inner white space does."""
    return F.md5(F.encode(F.lower(F.trim(question)), "UTF-8"))
