"""Personal data by base patterns and a semi-Markov conditional random field.

The field segments the regions of a text that hold digits or an `@`.  A candidate segment is a run
of at most MAX_TOKENS tokens; its features describe the whole span (shape, counts of digits and
signs, checksum, number ranges, neighbours).  One dynamic program over a region chooses boundaries
and types together; training maximises the likelihood of the base patterns' spans with the same
recursion over sums.  Base spans always stay; the field adds spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of a segment at most; texts and regions that a fit looks at, at most; characters of such a region at most.
MAX_TOKENS, MAX_CHARS, SAMPLE_TEXTS, SAMPLE_REGIONS, SAMPLE_CHARS = 20, 80, 4000, 1500, 200
#: A span that the field adds must be this likely.
SURE = 0.9
_ANY = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REGION = re.compile(r"(?<!\S)(?=(\S*?[0-9@]))\1\S*(?:\x20[0-9().+-]*[0-9][0-9().+-]*(?!\S))*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; time is linear in the text, also in long runs of digits or letters."""
    if not _ANY.search(text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            out.append((begin, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 or len(p.lstrip("0") or "0") < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(_DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(span: str) -> str:
    """Runs of letters as a, of digits as d and their number (up to 9), the rest as it is."""
    return _TOKEN.sub(lambda m: "a" if m[0][0].isascii() and m[0][0].isalpha() else f"d{min(len(m[0]), 9)}" if m[0][0] in "0123456789" else m[0], span)[:40]


def span_features(text: str, begin: int, end: int) -> list[str]:
    span = text[begin:end]
    digits = "".join(_DIGITS.findall(span))
    n, at = len(digits), span.count("@")
    out = [f"shape {shape(span)}", f"digits {min(n, 20)}", f"at {min(at, 2)} dot {'.' in span.partition('@')[2]}", f"plus {span[0] == '+'} {10 <= n <= 15}"]
    parts = span.split(".")
    out.append(f"four {len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
    out.append(f"card {14 <= n <= 19 and not set(span) - set('0123456789 -') and luhn(digits)}")
    side = lambda c: "" if not c else "d" if c in "0123456789" else "a" if c.isalnum() else c if c in "@.+-_%" else " "
    return [*out, f"left {side(text[begin - 1 : begin])} {side(span[0])}", f"right {side(span[-1])} {side(text[end : end + 1])}"]


def regions(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an `@`, with the numbers after them."""
    return [m.span() for m in _REGION.finditer(text)] if _ANY.search(text) else []


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights of (type, feature) and of (type before, type); type 0 is a token outside, 1.. are KINDS."""

    def __init__(self):
        self.weights: dict[tuple[int, str], float] = {}
        self.steps = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    @staticmethod
    def lattice(text: str, begin: int, end: int):
        """Token bounds, and for each end the candidate segments (first token, features)."""
        bounds = [begin, *(m.end() for m in _TOKEN.finditer(text, begin, end))]
        ends: list[list[tuple[int, list[str]]]] = [[] for _ in bounds]
        for i in range(len(bounds) - 1):
            if not (text[bounds[i]].isalnum() or text[bounds[i]] in "+("):
                continue
            for j in range(i + 1, min(i + MAX_TOKENS, len(bounds) - 1) + 1):
                if bounds[j] - bounds[i] > MAX_CHARS:
                    break
                if text[bounds[j] - 1].isalnum() and bounds[j] - bounds[i] >= 6 and _ANY.search(text, bounds[i], bounds[j]):
                    ends[j].append((i, span_features(text, bounds[i], bounds[j])))
        return bounds, ends

    def scores(self, ends):
        """For each end: (first token, type, score, features)."""
        get, known = self.weights.get, {}
        out = []
        for own in ends:
            row = []
            for i, fs in own:
                key = tuple(fs)
                if key not in known:
                    known[key] = [sum(get((t, f), 0.0) for f in fs) for t in range(1, len(KINDS) + 1)]
                row += [(i, t, s, fs) for t, s in enumerate(known[key], 1)]
            out.append(row)
        return out

    def segment(self, text: str, begin: int, end: int) -> list[tuple[int, int, int, float]]:
        """The best segments (start, kind, end, probability) of a region."""
        bounds, ends = self.lattice(text, begin, end)
        if not any(ends):
            return []
        scored, states, steps = self.scores(ends), range(len(KINDS) + 1), self.steps
        low = -1e30
        best, back = [[0.0, *[low] * len(KINDS)]], [[None] * len(states)]
        for j in range(1, len(bounds)):
            row, link = [low] * len(states), [None] * len(states)
            for y in states:
                if (v := best[j - 1][y] + steps[y][0]) > row[0]:
                    row[0], link[0] = v, (j - 1, y)
            for i, t, s, _ in scored[j]:
                for y in states:
                    if (v := best[i][y] + steps[y][t] + s) > row[t]:
                        row[t], link[t] = v, (i, y)
            best.append(row)
            back.append(link)
        j, y, out = len(bounds) - 1, max(states, key=best[-1].__getitem__), []
        while j:
            i, before = back[j][y]
            if y:
                out.append((i, j, y))
            j, y = i, before
        if not out:
            return []
        likely = {(i, j, t): p for i, j, t, p, _ in self.marginals(bounds, scored)[0]}
        return [(bounds[i], t - 1, bounds[j], likely[i, j, t]) for i, j, t in reversed(out)]

    def marginals(self, bounds, scored):
        """Probabilities of segments (first, end, type, probability, features), of type pairs, and the log of the sum over all segmentations."""
        n, states, steps, low = len(bounds), range(len(KINDS) + 1), self.steps, -1e30
        ahead = [[0.0, *[low] * len(KINDS)]]
        for j in range(1, n):
            into = [[ahead[j - 1][y] + steps[y][0] for y in states], *([] for _ in KINDS)]
            for i, t, s, _ in scored[j]:
                into[t] += [ahead[i][y] + steps[y][t] + s for y in states]
            ahead.append([_logsum(v) if v else low for v in into])
        behind = [[low] * len(states) for _ in range(n)]
        behind[-1] = [0.0] * len(states)
        starts: list[list] = [[] for _ in range(n)]
        for j in range(1, n):
            for i, t, s, fs in scored[j]:
                starts[i].append((j, t, s, fs))
        for i in range(n - 2, -1, -1):
            for y in states:
                behind[i][y] = _logsum([steps[y][0] + behind[i + 1][0], *(steps[y][t] + s + behind[j][t] for j, t, s, _ in starts[i])])
        total = behind[0][0]
        segments, pairs = [], [[0.0] * len(states) for _ in states]
        for i in range(n - 1):
            for y in states:
                if ahead[i][y] > low / 2:
                    pairs[y][0] += math.exp(min(0.0, ahead[i][y] + steps[y][0] + behind[i + 1][0] - total))
            for j, t, s, fs in starts[i]:
                p = 0.0
                for y in states:
                    if ahead[i][y] > low / 2:
                        q = math.exp(min(0.0, ahead[i][y] + steps[y][t] + s + behind[j][t] - total))
                        pairs[y][t] += q
                        p += q
                segments.append((i, j, t, p, fs))
        return segments, pairs, total

    def fit(self, samples: list[tuple[str, int, int]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4) -> "Field":
        """samples: (text, begin, end) of regions; the gold segments are the base spans whose bounds are token bounds.  AdaGrad on the likelihood, a region a step."""
        data = []
        for text, begin, end in samples:
            bounds, ends = self.lattice(text, begin, end)
            place, gold, last = {b: k for k, b in enumerate(bounds)}, set(), 0
            allowed = {(i, j) for j, own in enumerate(ends) for i, _ in own}
            for s, kind, e in base_spans(text):
                if s in place and e in place and place[s] >= last and (place[s], place[e]) in allowed:
                    gold.add((place[s], place[e], kind + 1))
                    last = place[e]
            data.append((bounds, ends, gold))
        seen: dict = {}
        for epoch in range(epochs):
            for bounds, ends, gold in data:
                segments, pairs, _ = self.marginals(bounds, self.scores(ends))
                gradient: dict = {}
                for i, j, t, p, fs in segments:
                    d = ((i, j, t) in gold) - p
                    if abs(d) > 1e-4:
                        for f in fs:
                            gradient[t, f] = gradient.get((t, f), 0.0) + d
                for key, d in gradient.items():
                    w = self.weights.get(key, 0.0)
                    d -= decay * w
                    seen[key] = seen.get(key, 1e-3) + d * d
                    self.weights[key] = w + rate * d / math.sqrt(seen[key])
                y, at, truth = 0, 0, [[0.0] * len(pairs) for _ in pairs]
                for i, j, t in sorted(gold):
                    for _ in range(i - at):
                        truth[y][0] += 1
                        y = 0
                    truth[y][t] += 1
                    y, at = t, j
                for _ in range(len(bounds) - 1 - at):
                    truth[y][0] += 1
                    y = 0
                for a in range(len(pairs)):
                    for b in range(len(pairs)):
                        self.steps[a][b] += 0.02 * (truth[a][b] - pairs[a][b] - decay * self.steps[a][b])
        return self


def _samples(longest: int):
    def run(batches):
        for batch in base.slabs(batches):
            out = []
            for text in batch.column("text").to_pylist():
                for begin, end in regions(text):
                    if end - begin <= longest:
                        cut = max(0, begin - 20)
                        out.append((text[cut : end + 20], begin - cut, end - cut))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["text", "begin", "end"])

    return run


def fitted(docs: DataFrame, texts: int = SAMPLE_TEXTS, sample: int = SAMPLE_REGIONS, longest: int = SAMPLE_CHARS) -> Field:
    """Fits on a bounded sample: regions of the texts with the smallest hashes of doc_id, of these the ones with the smallest hashes.

    A text's regions all take part, wherever they are, but those of more than `longest` characters:
    a step's time and memory grow with them.  They are segmented like others, only not learnt from.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts).distinct()
    own = docs.select("doc_id", base.text_of(docs).alias("text")).join(F.broadcast(ids), "doc_id").select("text")
    found = own.mapInArrow(_samples(longest), base.schema(("text", "string"), ("begin", "bigint"), ("end", "bigint"))).distinct()
    rows = found.orderBy(F.xxhash64("text", "begin"), "text", "begin", "end").limit(sample).collect()
    return Field().fit([(r[0], r[1], r[2]) for r in rows])


def all_spans(text: str, field: Field, known: dict) -> tuple[list, list]:
    """Base spans, and all spans.  known: what the field found in regions met before."""
    own = base_spans(text)
    added = []
    for begin, end in regions(text):
        inside = [s for s in own if s[0] < end and s[2] > begin]
        key = text[max(0, begin - 1) : end + 1] if end - begin < 100 else None
        if inside and all(begin >= s[0] and end <= s[2] for s in inside[:1]):
            continue
        found = known.get(key)
        if found is None:
            found = [(s - begin, k, e - begin) for s, k, e, p in field.segment(text, begin, end) if p >= SURE]
            if key is not None and len(known) < 100_000:
                known[key] = found
        added += [(s + begin, k, e + begin) for s, k, e in found if not any(s + begin < x[2] and e + begin > x[0] for x in inside)]
    return own, sorted(own + added)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _found(field: Field):
    def run(batches):
        known: dict = {}
        for batch in base.slabs(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                own, every = all_spans(text, field, known)
                counts = [0] * len(KINDS)
                for _, k, _ in own:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(named(own).encode()).hexdigest(), named(every)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds))], names=["row", *_NAMES])

    return run


_NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def _with_spans(docs: DataFrame, columns: list[str], field: Field | None) -> DataFrame:
    field = field or fitted(docs)
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), base.text_of(docs).alias("text"))
    out = base.schema(*((n, "bigint") for n in _NAMES[:4]), *((n, "string") for n in _NAMES[4:]))
    return rows.mapInArrow(_found(field), type(out)([rows.schema["row"], *out.fields]))


def found_in(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans for every row of docs.

    Null texts count as empty; an empty text has no span and the hash of the empty string.  Rows
    are mapped one by one, so repeated rows and ids don't matter; other columns are ignored.
    Offsets are code points, ends exclusive.
    """
    return _with_spans(docs, ["doc_id"], field).select("row.doc_id", *_NAMES)


def _masked(field: Field, text_at: str):
    def run(batches):
        known: dict = {}
        for batch in base.slabs(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                out, at = [], 0
                for s, k, e in all_spans(text, field, known)[1] if text else []:
                    if e > at:
                        if s >= at:
                            out += [text[at:s], f"<{KINDS[k]}>"]
                        at = e
                texts.append("".join([*out, text[at:]]) if out else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "masked"])

    return run


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every found span replaced by its kind in angle brackets, and n_chars, if there, counted anew; null texts stay null, empty ones empty.

    Rows are mapped one by one, whole texts however long: repeated rows and ties stay as they are, in
    any order, an empty table stays empty, and other columns pass whatever their names.
    """
    field = field or fitted(docs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), base.text_of(docs).alias("text"))
    out = base.schema(("masked", "string"))
    new = rows.mapInArrow(_masked(field, "text"), type(out)([rows.schema["row"], *out.fields]))
    text = F.when(F.col("row.text").isNotNull(), F.col("masked"))
    columns = {"text": text.alias("text"), "n_chars": F.when(F.col("row.text").isNotNull(), F.char_length("masked")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)).cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long").alias("n_chars")}
    return new.select(*(columns.get(c, F.col(f"row.`{c}`")) for c in docs.columns))
