"""Urls and domains as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import document_id

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))


def host(url: Column) -> Column:
    """Lower case, without user and port; empty if the url has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1)), F.lit(""))


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def variants(raw: Column) -> Column:
    """Forms under which a url may be stored, in the order they are tried; empty for a blank one."""
    url = F.trim(F.coalesce(raw, F.lit("")))
    scheme, net, path, query, fragment = (_part(url, k) for k in range(1, 6))
    whole = net != ""
    head = F.concat(scheme, F.lit("://"), net)
    trimmed = F.rtrim(path, F.lit("/"))
    forms = F.array(
        url,
        F.when(whole, F.concat(F.lower(scheme), F.lit("://"), F.lower(net), path, query)),
        F.when(whole & (fragment != ""), F.concat(head, path, query)),
        F.when(whole & path.endswith("/") & (path != "/"), F.concat(head, trimmed, query)).when(whole & (path != "") & ~path.endswith("/") & (query == ""), F.concat(head, path, F.lit("/"))),
        F.when(url.endswith("/") & (url != "/"), F.rtrim(url, F.lit("/"))),
    )
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def resolved(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """wanted (url) with the doc_id and stored url of its first variant that a document has; others are absent."""
    tried = wanted.select("url", F.posexplode(variants(F.col("url"))).alias("k", "variant"))
    hits = tried.join(documents.select(F.col("doc_id").alias("id"), F.col("url").alias("stored")), F.col("variant") == F.col("stored"))
    first = F.min(F.struct("k", "id", "stored")).alias("m")
    return hits.groupBy("url").agg(first).select("url", F.col("m.id").alias("doc_id"), F.col("m.stored").alias("matched_url"))


def domains(given: list[str]) -> list[str]:
    """A caller's domains: lower case, without scheme, path, port, outer dots and www., each once."""
    out = []
    for text in given or []:
        name = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (text or "").strip().lower())
        name = re.split(r"[/?#:]", name)[0].strip(".").removeprefix("www.")
        if name and name not in out:
            out.append(name)
    return out


def in_domains(name: Column, allowed: list[str]) -> Column:
    bare = without_www(F.lower(name))
    hit = F.lit(False)
    for a in allowed:
        hit = hit | (bare == a) | F.endswith(bare, F.lit(f".{a}"))
    return F.coalesce(hit, F.lit(False))


def allowed_document(allowed: list[str]) -> Column:
    """Whether a document is in the domains; its own domain counts before its url's host."""
    return in_domains(F.coalesce(F.nullif(F.col("domain"), F.lit("")), host(F.col("url"))), domains(allowed))


def allowed_documents(documents: DataFrame, allowed: list[str]) -> DataFrame:
    """doc_id of documents in the domains."""
    return documents.where(allowed_document(allowed)).select("doc_id")


def filetype(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def glob_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [..]) as a whole-string regular expression; without these signs, equality."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if end > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            k = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        k += 1
    return f"^{out}$"


def at_site(name: Column, pattern: str) -> Column:
    """Equality or a glob; both sides without leading dots and www."""
    bare = re.sub(r"^www\.", "", pattern.strip().lower().lstrip("."))
    return without_www(F.regexp_replace(F.lower(name), r"^\.+", "")).rlike(glob_regex(bare))


def link_target(link: Column) -> Column:
    return F.trim(F.split_part(F.trim(link), F.lit("#"), F.lit(1)))


def link_ids(links: Column) -> Column:
    """Ids of a list of links, in order, each once; blank ones left out."""
    targets = F.filter(F.transform(F.coalesce(links, F.array().cast("array<string>")), link_target), lambda x: x != "")
    return F.array_distinct(F.transform(targets, document_id))


def search_host(url: Column, domain: Column) -> Column:
    """For search operators the url's host counts before the document's own domain."""
    return F.lower(F.coalesce(F.nullif(host(url), F.lit("")), domain, F.lit("")))
