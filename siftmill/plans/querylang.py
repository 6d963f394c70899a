"""The search-operator language: a query string becomes an immutable specification.

Clauses are `operator:value` with an optional sign; what is left is split like a shell line into
free terms.  A table says for each operator which field it constrains and how.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field
from datetime import datetime, timezone

#: operator -> (field, whether all words are needed); fixed names of the language.
OPERATORS = {
    "intext": ("content", False), "allintext": ("content", True), "inpostauthor": ("content", False), "allinpostauthor": ("content", True),
    "intitle": ("title", False), "allintitle": ("title", True),
    "inurl": ("url", False), "related": ("url", False), "cache": ("url", False), "allinurl": ("url", True),
    "link": ("links", False), "inanchor": ("links", False), "allinanchor": ("links", True),
    "site": ("site", False), "filetype": ("filetype", False), "ext": ("filetype", False),
    "before": ("before", False), "after": ("after", False), "numrange": ("free", False),
}
_CLAUSE = re.compile(rf'([+-]?)({"|".join(sorted(OPERATORS, key=len, reverse=True))}):("[^"]*"|\([^)]*\)|[^\s()]+)', re.I)
_QUOTES = {**dict.fromkeys("“”„‟", '"'), **dict.fromkeys("‘’", "'")}
FIELDS = ("content", "title", "url", "links")


def unique(terms) -> tuple[str, ...]:
    """Trimmed, not empty, each once whatever the case; the first spelling stays."""
    kept: dict[str, str] = {}
    for t in terms:
        if t and t.strip():
            kept.setdefault(t.strip().lower(), t.strip())
    return tuple(kept.values())


def bare_value(raw: str) -> str:
    """A value without one pair of quotes around it, then without one pair of parentheses."""
    value = raw.strip()
    for first, last in ('""', "()"):
        if len(value) >= 2 and value[0] == first and value[-1] == last:
            value = value[1:-1]
    return value.strip()


def clause_terms(raw: str, words: bool = False) -> list[str]:
    """Alternatives at |, each without quotes of either kind around it; else words if these are wanted, else one term, whose inner quotes stay."""
    value = bare_value(raw)
    if "|" in value:
        return [p.strip().strip('"').strip("'") for p in value.split("|")]
    return value.split() if words else [value]


def moment(raw: str) -> datetime | None:
    """An ISO date or time; without a zone it is UTC; None if it isn't one."""
    value = bare_value(raw)
    try:
        parsed = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None
    return parsed.replace(tzinfo=timezone.utc) if parsed.tzinfo is None else parsed.astimezone(timezone.utc)


def free_terms(text: str) -> tuple[list[str], list[str]]:
    try:
        tokens = shlex.split(text)
    except ValueError:
        tokens = text.split()
    wanted, unwanted = [], []
    for token in tokens:
        body = token.strip().lstrip("+-~")
        signs = [c for c in token.strip()[: len(token.strip()) - len(body)] if c in "+-"]
        body = body.strip("() ")
        if not body or set(body) <= set("&|"):
            continue
        (unwanted if signs[:1] == ["-"] else wanted).extend(clause_terms(body) if "|" in body else [body])
    return wanted, unwanted


@dataclass(frozen=True)
class Query:
    text: str = ""
    any_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    all_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    none_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    free: tuple[str, ...] = ()
    unwanted: tuple[str, ...] = ()
    before: datetime | None = None
    after: datetime | None = None

    @property
    def retrieval_terms(self) -> tuple[str, ...]:
        """What is embedded: free terms, then content and title terms."""
        return unique([*self.free, *(t for f in ("content", "title") for d in (self.any_of, self.all_of) for t in d.get(f, ()))])

    @property
    def highlight_terms(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """What a result page marks: terms wanted in the content, and terms wanted in urls (sites and file types are looked for there)."""
        both = lambda f: [*self.any_of.get(f, ()), *self.all_of.get(f, ())]
        return unique([*both("content"), *self.free]), unique(t for f in ("url", "site", "filetype", "links") for t in both(f))

    @property
    def semantic_text(self) -> str:
        return " ".join(self.retrieval_terms)

    @property
    def has_text(self) -> bool:
        return bool(self.retrieval_terms)

    @property
    def has_filters(self) -> bool:
        """Whether anything but free terms constrains the result."""
        return bool(self.any_of or self.all_of or self.none_of or self.unwanted or self.before or self.after)


def parse(text: str | None) -> Query:
    folded = "".join(_QUOTES.get(c, c) for c in text or "")
    groups: dict[str, dict[str, list[str]]] = {"any": {}, "all": {}, "none": {}}
    numbers, bounds, rest, last = [], {}, [], 0
    for m in _CLAUSE.finditer(folded):
        rest += [folded[last : m.start()], " " * len(m[0])]
        last = m.end()
        name, words = OPERATORS[m[2].lower()]
        if name in ("before", "after"):
            if (when := moment(m[3])) is not None:
                bounds[name] = when
        elif name == "free":
            numbers += clause_terms(m[3])
        else:
            terms = clause_terms(m[3], words)
            if name == "filetype":
                terms = [t.lstrip(".").lower() for t in terms]
            groups["none" if m[1] == "-" else "all" if words else "any"].setdefault(name, []).extend(terms)
    wanted, unwanted = free_terms("".join([*rest, folded[last:]]))
    done = {k: {f: u for f, t in g.items() if (u := unique(t))} for k, g in groups.items()}
    return Query(text or "", done["any"], done["all"], done["none"], unique([*numbers, *wanted]), unique(unwanted), **bounds)


def candidate_limit(limit: int) -> int:
    """How many candidates a search takes, so that enough are left after filters."""
    return min(max(5 * limit, limit + 20), 200)


def scan_batch(limit: int) -> int:
    return min(max(3 * limit, 25), 200)
