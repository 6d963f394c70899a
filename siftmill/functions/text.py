"""Text as column expressions: counts, hashes, titles, display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDED_CHARS, PREVIEW_CHARS, LATE_DIMENSION = 16_000, 300, 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))), F.lit(0))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def heading(text: Column) -> Column:
    """The first markdown heading of the first 50 lines, without links and emphasis marks; null if none."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 50), lambda x: F.trim(x))
    bare = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+\S")), lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)), r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_`]", ""))
    return F.try_element_at(F.filter(bare, lambda x: x != ""), F.lit(1))


def embedded_part(text: Column, chars: int = EMBEDDED_CHARS) -> Column:
    """The beginning, without white space at its end, short texts too; of white space alone as it is."""
    cut = F.substring(text, 1, chars)
    tight = F.regexp_replace(cut, r"(?U)[\s\x1c-\x1f]+\z", "")
    return F.when(tight == "", cut).otherwise(tight)


def faq_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer)


def kv_text(key: Column, value: Column) -> Column:
    return F.concat(F.lit("Key: "), key, F.lit("\nValue: "), value)


def token_vectors(flat: Column, dimension: int = LATE_DIMENSION) -> Column:
    """A flat vector as rows of `dimension`; a remainder is dropped."""
    n = F.floor(F.size(flat) / dimension).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(flat, i * dimension + 1, F.lit(dimension)))).otherwise(F.array())


# display forms


def term_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences, whatever the case."""
    return F.regexp_count(text, F.lit("(?i)" + re.escape(term)))


def best_chain(text: Column, terms: list[str]) -> Column:
    """The longest run of two or more consecutive terms that the text has as a phrase, leftmost first: struct(phrase, count)."""
    chains = [" ".join(terms[i : i + n]) for n in range(len(terms), 1, -1) for i in range(len(terms) - n + 1)]
    found = [F.when(term_count(text, c) > 0, F.struct(F.lit(c).alias("phrase"), term_count(text, c).alias("count"))) for c in chains]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<phrase:string,count:int>")


def has_matches(text: Column, terms: list[str], least: int, by: str = "either") -> Column:
    """Whether a word, the best chain, or either occurs at least so often."""
    word = F.greatest(F.lit(0), F.lit(0), *(term_count(text, t) for t in terms))
    chain = F.coalesce(best_chain(text, terms)["count"], F.lit(0))
    return {"word": word, "chain": chain, "either": F.greatest(word, chain)}[by] >= least


def highlighted(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    ordered = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, ordered)) + ")", f"{before}$1{after}") if ordered else text


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def relative_time(then: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def rating_of_stars(stars: Column) -> Column:
    return F.when(stars >= 4, 1).when(stars <= 2, -1).when(stars.isNotNull(), 0)


def generated_faq(reply: Column) -> Column:
    """A model's reply: what follows QUESTION: and ANSWER:; without the marks, the first line and the rest."""
    question = F.trim(F.regexp_extract(reply, r"(?is)QUESTION:\s*(.*?)\s*(?:ANSWER:|$)", 1))
    answer = F.trim(F.regexp_extract(reply, r"(?is)ANSWER:\s*(.*)$", 1))
    marked = reply.rlike(r"(?i)QUESTION:") & reply.rlike(r"(?i)ANSWER:")
    first = F.trim(F.regexp_extract(F.trim(reply), r"^([^\n]*)", 1))
    rest = F.trim(F.regexp_extract(F.trim(reply), r"(?s)^[^\n]*\n(.*)$", 1))
    return F.struct(F.when(marked, question).otherwise(first).alias("question"), F.when(marked, answer).otherwise(rest).alias("answer"))
