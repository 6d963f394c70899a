"""Many terms in one pass: an Aho-Corasick automaton over all terms and phrases, run on Arrow batches.

`text.term_count` and its kin stay in the JVM and are the better choice for a few terms; each of them
reads the text once more, and the phrases of n terms are n * (n - 1) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "counts array<int>, phrase string, count int"
_LOWER = {c: c + 32 for c in range(65, 91)}


def phrases(terms: list[str]) -> list[str]:
    """Runs of two or more consecutive terms, the longest first, then leftmost."""
    return [" ".join(terms[i : i + n]) for n in range(len(terms), 1, -1) for i in range(len(terms) - n + 1)]


def counter(terms: list[str]):
    """A function of a text: non-overlapping occurrences of each term and phrase, whatever the case of A to Z."""
    import ahocorasick

    automaton, wanted = ahocorasick.Automaton(), [t.translate(_LOWER) for t in terms]
    for t in dict.fromkeys(x for x in wanted if x):
        automaton.add_word(t, t)
    if not len(automaton):
        return lambda text: [0] * len(wanted)
    automaton.make_automaton()

    def count(text: str) -> list[int]:
        found: dict[str, int] = {}
        free: dict[str, int] = {}  # where the next occurrence may begin
        for end, t in automaton.iter(text.translate(_LOWER)):
            if end - len(t) + 1 >= free.get(t, 0):
                found[t] = found.get(t, 0) + 1
                free[t] = end + 1
        return [found.get(t, 0) for t in wanted]

    return count


def matches(text: Column, terms: list[str]) -> Column:
    """struct(counts: of each term, phrase: the best chain or null, count: of it), by `text.term_count` and `text.best_chain`'s rules, in one pass.  Null texts have no match."""
    chains = phrases(terms)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter([*terms, *chains])
        for batch in batches:
            rows = []
            for t in batch:
                n = count(t or "")
                best = next((k for k in range(len(chains)) if n[len(terms) + k]), None)
                rows.append((n[: len(terms)], None if best is None else chains[best], None if best is None else n[len(terms) + best]))
            out = pd.DataFrame(rows, columns=["counts", "phrase", "count"])
            out["count"] = out["count"].astype("Int32")
            yield out

    return F.pandas_udf(run, MATCHES)(text)


def has_matches(found: Column, least: int, by: str = "either") -> Column:
    """`text.has_matches` from what `matches` gives."""
    word, chain = F.greatest(F.lit(0), F.coalesce(F.array_max(found["counts"]), F.lit(0))), F.coalesce(found["count"], F.lit(0))
    return {"word": word, "chain": chain, "either": F.greatest(word, chain)}[by] >= least
