"""Query specifications and filter dictionaries as one boolean column; nulls count as empty, so negations keep their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import at_site, filetype, host, search_host
from .querylang import FIELDS, Query


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _has(text: Column, term: str) -> Column:
    return text.contains(term.lower())


def _terms(q: Query, name: str, text: Column) -> list[Column]:
    out = []
    if q.all_of.get(name):
        out.append(_all(_has(text, t) for t in q.all_of[name]))
    if q.any_of.get(name):
        out.append(_any(_has(text, t) for t in q.any_of[name]))
    if q.none_of.get(name):
        out.append(~_any(_has(text, t) for t in q.none_of[name]))
    return out


def _some_url(urls: Column, test, values) -> Column:
    """Whether any url passes the test for any value.  Spark fills every parameter of a lambda, so it has one and no defaults."""
    return F.exists(urls, lambda u: _any(test(u, v) for v in values))


def _times(q: Query, at: Column) -> list[Column]:
    bounds = ([at < F.lit(q.before)] if q.before else []) + ([at > F.lit(q.after)] if q.after else [])
    return [F.coalesce(_all(bounds), F.lit(False))] if bounds else []


def document_predicate(q: Query) -> Column:
    """Over columns content, title, url, domain, hyperlinks, indexed_at (metadata_title and others are folded into these by the caller)."""
    c = F.col
    own = {"content": _low(c("content")), "title": _low(c("title")), "url": _low(c("url")), "links": _low(F.array_join("hyperlinks", " "))}
    parts = [p for f in FIELDS for p in _terms(q, f, own[f])]
    name, kind = search_host(c("url"), c("domain")), filetype(c("url"))
    if q.any_of.get("site"):
        parts.append(_any(at_site(name, p) for p in q.any_of["site"]))
    if q.none_of.get("site"):
        parts.append(~_any(at_site(name, p) for p in q.none_of["site"]))
    if q.any_of.get("filetype"):
        parts.append(kind.isin(*q.any_of["filetype"]))
    if q.none_of.get("filetype"):
        parts.append(~kind.isin(*q.none_of["filetype"]))
    every = F.concat_ws("\n", own["content"], own["title"], own["url"])
    parts += [_has(every, t) for t in q.free] + [~_has(every, t) for t in q.unwanted]
    return _all(parts + _times(q, c("indexed_at")))


def faq_predicate(q: Query, with_times: bool = True) -> Column:
    """Over columns question, answer, source_documents, last_updated, first_seen.

    Title terms look at question and answer, link terms at the sources' urls; site and filetype
    hold if any source has them.  with_times=False: hits of the vector path carry no times, so a
    bound on time rejects them all.
    """
    c = F.col
    text = _low(F.concat_ws("\n", "question", "answer"))
    urls = F.transform(F.coalesce(c("source_documents.url"), F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")))
    joined = F.lower(F.array_join(urls, " "))
    own = {"content": text, "title": text, "url": joined, "links": joined}
    parts = [p for f in FIELDS for p in _terms(q, f, own[f])]
    for name, test in (("site", lambda u, v: at_site(host(u), v)), ("filetype", lambda u, v: filetype(u) == v)):
        if q.any_of.get(name):
            parts.append(_some_url(urls, test, q.any_of[name]))
        if q.none_of.get(name):
            parts.append(~_some_url(urls, test, q.none_of[name]))
    every = F.concat_ws("\n", text, joined)
    parts += [_has(every, t) for t in q.free] + [~_has(every, t) for t in q.unwanted]
    at = F.coalesce(F.try_to_timestamp(c("last_updated").cast("string")), F.try_to_timestamp(c("first_seen").cast("string"))) if with_times else F.lit(None).cast("timestamp")
    return _all(parts + _times(q, at))


def compiled(node: dict | None) -> Column:
    """A filter dictionary: must, should, must_not (lists of nodes), has_id, or a condition on a key.

    Conditions: {"key": k, "match": {"value"|"any"|"text"|"regex": v}} or {"key": k, "range": {"lt"..: v}}.
    A key `a[].b` holds if any element does; dots go into structs.
    """
    if not node:
        return F.lit(True)
    parts = []
    if node.get("must"):
        parts.append(_all(compiled(x) for x in node["must"]))
    if node.get("should"):
        parts.append(_any(compiled(x) for x in node["should"]))
    if node.get("must_not"):
        parts.append(~_any(compiled(x) for x in node["must_not"]))
    if "has_id" in node:
        parts.append(F.col(node.get("id_column", "doc_id")).isin(*node["has_id"]) if node["has_id"] else F.lit(False))
    if "key" in node:
        array, _, inner = node["key"].partition("[].")
        if inner:
            parts.append(F.exists(F.col(array), lambda x: F.coalesce(_condition(x[inner], node), F.lit(False))))
        else:
            parts.append(_condition(F.col(node["key"]), node))
    return F.coalesce(_all(parts), F.lit(False))


def _condition(value: Column, node: dict) -> Column:
    match, bounds = node.get("match", {}), node.get("range", {})
    parts = []
    if "value" in match:
        parts.append(value == match["value"])
    if "any" in match:
        parts.append(value.isin(*match["any"]) if match["any"] else F.lit(False))
    if "text" in match:
        parts.append(_low(value).contains(match["text"].lower()))
    if "regex" in match:
        parts.append(value.rlike(match["regex"]))
    for name, test in (("lt", lambda a, b: a < b), ("lte", lambda a, b: a <= b), ("gt", lambda a, b: a > b), ("gte", lambda a, b: a >= b)):
        if name in bounds:
            parts.append(test(value, F.lit(bounds[name])))
    return _all(parts)
