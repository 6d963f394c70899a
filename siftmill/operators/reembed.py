"""Re-embedding in ranges, with a ledger: what is done stays done, what fails is tried again, and the new collection takes its place only when all is done.

A range is the rows whose key's hash falls in it.  Its rows and its entry in the ledger are one commit
of the target, so a lost driver leaves each range whole or not begun.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.changelog import Collection
from .migrate import re_embedded


@dataclass
class Report:
    ranges: int
    done: int = 0
    tries: dict[int, int] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)

    @property
    def complete(self) -> bool:
        return self.done == self.ranges


def said(error: Exception) -> str:
    """What went wrong, in a line: the innermost error that a message names, else its first line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()] or [type(error).__name__]
    named = [x for x in lines if re.match(r"[\w.]*(Error|Exception|TooLong): \S", x)]
    return (named or lines[:1])[-1][:400]


def _job(job: str, k: int) -> str:
    return f"{job}:{k}"


def pending(target: Collection, job: str, ranges: int) -> list[int]:
    """The ranges that aren't committed."""
    return [k for k in range(ranges) if target.done(_job(job, k)) < 0]


def advance(
    source: DataFrame, target: Collection, kind: str, embed: Callable[[DataFrame], DataFrame], job: str, ranges: int = 16, tries: int = 3, cancelled: Callable[[], bool] = lambda: False,
) -> Report:
    """Embeds the ranges of source that aren't committed yet, each up to `tries` times; a range that keeps failing is reported and left for the next call.

    source must be the same at every call of a job (a version of a collection), and its rows have
    different, non-null keys.  ranges is part of the job: a call with another number is refused.
    """
    plan = target.done(f"{job}:ranges")
    if plan < 0:
        empty = re_embedded(source.limit(0), kind, embed)
        target.put(empty, done=(f"{job}:ranges", ranges))
    elif plan != ranges:
        raise ValueError(f"{job} has {plan} ranges")
    out = Report(ranges)
    for k in pending(target, job, ranges):
        rows = source.where(F.pmod(F.xxhash64(target.key), F.lit(ranges)) == k)
        while out.tries.get(k, 0) < tries and not cancelled():
            out.tries[k] = out.tries.get(k, 0) + 1
            try:
                target.put(re_embedded(rows, kind, embed), done=(_job(job, k), 1))
            except Exception as e:  # the model's or the cluster's; the ledger knows what is done
                out.errors[k] = said(e)
                continue
            out.errors.pop(k, None)
            break
    out.done = ranges - len(pending(target, job, ranges))
    return out


def finalised(target: Collection, job: str, ranges: int, point: Callable[[], None]) -> bool:
    """Compacts the target and lets `point` swap the alias, if every range is done; says whether it was."""
    if pending(target, job, ranges):
        return False
    target.compact()
    point()
    return True
