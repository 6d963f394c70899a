"""URL rules by a Bloom filter cascade.

The keys of a url are all pairs of a host suffix and a path beginning as long as some rule's; the
complete key universe is the keys of all urls of the corpus.  Level 0 of the cascade holds the
listed keys; the universe's other keys that pass it are found in one pass over the corpus and make
level 1, the listed keys that pass that one make level 2, and so on until nothing passes wrongly.
Membership of any key of the universe is then exact, and urls are judged where they are read,
without a join.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: The cascade of so many listed rules goes to every executor (about 3 bytes a rule); of more, keys are dealt into parts of about PART_RULES, each with a cascade of its own.
MOST_RULES, PART_RULES = 1_000_000, 200_000
#: Tasks that the keys of a part are dealt to.
WAYS = 16
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    begin = (url or "").find("://")
    if begin < 0:
        return "", ""
    begin += 3
    end = min((k for k in (url.find(c, begin) for c in "/?#") if k >= 0), default=len(url))
    stop = min((k for k in (url.find(c, end) for c in "?#") if k >= 0), default=len(url))
    return url[begin:end].translate(_UPPER), url[end:stop]


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Host suffixes at dots times path beginnings of the given lengths; longest first, of equal ones the longer host."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = [(s, path[:n]) for s in suffixes if s for n in lengths if n <= len(path)]
    return [s + p for s, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


class Bloom:
    def __init__(self, keys, rate: float, salt: int):
        n = max(1, len(keys))
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes, self.salt = min(max(1, round(self.size / n * math.log(2))) if n > 4 else 8, 24), salt
        bits = np.zeros(-(-self.size // 8) * 8, bool)
        pairs = np.array([self.pair(k) for k in keys], np.uint64).reshape(-1, 2)
        for i in range(self.hashes):
            bits[((pairs[:, 0] + i * pairs[:, 1]) % self.size).astype(np.int64)] = True
        self.data = np.packbits(bits, bitorder="little").tobytes()

    def pair(self, key: str) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=self.salt)
        return h & 0xFFFFFFFFFFFF, h >> 64 & 0xFFFFFFFFFFFF | 1  # 48 bits each: sums of 24 stay within 64

    def __contains__(self, key: str) -> bool:
        (a, b), data, size = self.pair(key), self.data, self.size
        return all(data[(at := (a + i * b) % size) >> 3] >> (at & 7) & 1 for i in range(self.hashes))


class Cascade:
    """Exact for every key that is listed or was among the others."""

    def __init__(self, first: Bloom, listed: set[str], passed: set[str]):
        self.levels = [first]
        inside, outside = passed, listed  # what the next level holds, and what must not pass it
        while inside:
            level = Bloom(inside, 0.5 if len(inside) > 64 else 1e-3, len(self.levels))
            self.levels.append(level)
            inside, outside = {k for k in outside if k in level}, inside
            if len(self.levels) > 200:
                raise RuntimeError("the cascade doesn't end")

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def _passing(first: Bloom, lengths: list[int]):
    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            found = {k for url in batch.column("url").to_pylist() for k in keys_of(*parts_of(url), lengths) if k in first} - seen
            seen = seen | found if len(seen) < 1 << 20 else found  # what comes out again is one key in the end
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(found), pa.string())})

    return run


def _universe(lengths: list[int]):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted({k for url in batch.column("url").to_pylist() for k in keys_of(*parts_of(url), lengths)}), pa.string())})

    return run


def cascade(urls: DataFrame, listed: set[str], lengths: list[int]) -> Cascade:
    """urls: one column `url`.  What passes level 0 wrongly is about as much as is listed; if it is more than four times that, level 0 grows.

    Only the filter goes to the executors; which of the keys that pass it are listed, the driver tells.
    """
    one = base.schema(("key", "string"))
    size = urls.mapInArrow(_universe(lengths), one).agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(1, len(listed)) / max(1, size) / math.sqrt(2))
    for _ in range(20):
        first = Bloom(listed, rate, 0)
        bound = 5 * len(listed) + 1000  # the listed keys that occur are among them
        passed = urls.mapInArrow(_passing(first, lengths), one).distinct().limit(bound + 1).toArrow()["key"].to_pylist()
        if len(passed) <= bound:
            return Cascade(first, listed, set(passed) - listed)
        rate /= 8
    raise RuntimeError("level 0 lets too many keys pass")


def _judge(listed: Cascade, blocked: Cascade, lengths: list[int], otherwise: str):
    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts_of(url)
                rule = next((k for k in keys_of(host, path, lengths) if k in listed), None)
                rows.append((host, path, rule, otherwise if rule is None else "block" if rule in blocked else "allow"))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return run


_JUDGED = base.schema(("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string"))


def _keyed(lengths: list[int]):
    def run(batches):
        for batch in batches:
            rows = []
            for page_id, uid, url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uid", "url"))):
                host, path = parts_of(url)
                rows.append((page_id, uid, host, path, keys_of(host, path, lengths)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "uid", "host", "path", "keys"])

    return run


# Rules too many for one cascade


def _files(folder: str, make):
    """Rows lie sorted by part: what `make` gives for a part's rows is put into its file."""

    def run(batches):
        files, last, held = base.Files(folder), None, []

        def put():
            files.put(f"{last}.part", pickle.dumps(make(last, held)))
            return pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != last:
                    yield put()
                    held = []
                last = row["part"]
                held.append(row)
        if held:
            yield put()

    return run


class _Parts:
    """The files of parts, one in memory at a time; a part without rules has none."""

    def __init__(self, folder: str):
        self.files, self.last, self.value = base.Files(folder), None, None

    def __getitem__(self, part: int):
        if part != self.last:
            try:
                with self.files.open(f"{part}.part") as file:
                    self.last, self.value = part, pickle.loads(file.read())
            except FileNotFoundError:
                self.last, self.value = part, None
        return self.value


def _passed(folder: str):
    def run(batches):
        parts = _Parts(folder)
        for batch in batches:
            keep = [(own := parts[part]) is not None and key in own for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _verdicts(folder: str):
    def run(batches):
        parts = _Parts(folder)
        for batch in batches:
            found = []
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist()):
                own = parts[part]
                found.append(None if own is None or key not in own[0] else "block" if key in own[1] else "allow")
            keep = pa.array([x is not None for x in found], pa.bool_())
            columns = [batch.column("uid"), batch.column("at"), batch.column("key"), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "at", "key", "verdict"]).filter(keep)

    return run


def _cascades(first: str):
    """Of a part: which keys are listed, over the filter that its universe was sifted by, and which of those are blocked."""

    def make(part: int, rows: list[dict]) -> tuple[Cascade, Cascade]:
        listed, others = {r["key"]: r["verdict"] for r in rows if r["verdict"]}, {r["key"] for r in rows if not r["verdict"]}
        blocked = {k for k, v in listed.items() if v == "block"}
        kinds = Bloom(blocked, 0.5, 1000)
        return Cascade(_Parts(first)[part], set(listed), others), Cascade(kinds, blocked, {k for k in set(listed) - blocked if k in kinds})

    return make


def _judged_in_parts(rows: DataFrame, rules: DataFrame, number: int, lengths: list[int], otherwise: str) -> DataFrame:
    """A cascade for each part of the keys, which are dealt by hash, about PART_RULES rules to a part.

    A part's universe is sifted by a first filter before it meets its rules, so a task that builds a
    cascade holds a part's rules and about as many others; a task that judges holds one cascade.  Keys
    of a part are dealt to WAYS tasks, so that one that all urls have isn't a task's alone.
    """
    spark, count = rows.sparkSession, -(-number // PART_RULES)
    part = F.pmod(F.xxhash64("key"), F.lit(count)).cast("bigint").alias("part")
    out = base.schema(("page_id", "bigint"), ("uid", "bigint"), ("host", "string"), ("path", "string"), ("keys", "array<string>"))
    pages, _ = base.written(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_keyed(lengths), out), "url-keys")
    keys = pages.select("uid", F.posexplode("keys").alias("at", "key"))
    universe, _ = base.written(keys.select("key").distinct(), "url-universe")
    rate = min(0.5, number / max(1, universe.count()) / math.sqrt(2))
    ruled, _ = base.written(rules.select(part, "key", "verdict"), "url-rules")
    first, second = base.scratch_path(spark, "url-first"), base.scratch_path(spark, "url-cascades")
    one = base.schema(("part", "bigint"))
    base.written(ruled.repartition("part").sortWithinPartitions("part").mapInArrow(_files(first, lambda _, held: Bloom({r["key"] for r in held}, rate, 2000)), one), "url-first-parts")
    near = universe.select(part, "key").repartition("part", F.pmod(F.hash("key"), F.lit(WAYS))).sortWithinPartitions("part").mapInArrow(_passed(first), base.schema(("part", "bigint"), ("key", "string")))
    others = near.join(ruled.select("key"), "key", "left_anti").select("part", "key", F.lit(None).cast("string").alias("verdict"))
    both = ruled.unionByName(others).repartition("part").sortWithinPartitions("part")
    base.written(both.mapInArrow(_files(second, _cascades(first)), one), "url-cascade-parts")
    spread = keys.select("uid", "at", "key", part).repartition("part", F.pmod("uid", F.lit(WAYS))).sortWithinPartitions("part")
    found = spread.mapInArrow(_verdicts(second), base.schema(("uid", "bigint"), ("at", "int"), ("key", "string"), ("verdict", "string")))
    best = found.groupBy("uid").agg(F.min(F.struct("at", "key", "verdict")).alias("b"))
    return pages.join(best, "uid", "left").select("page_id", "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.verdict", F.lit(otherwise)).alias("verdict"))


def judged(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; rules are (verdict, host/path), as a list or a table (verdict, rule).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    (of equally long ones that with the longer host).  Without a rule the verdict is `otherwise`.
    Null urls and urls without `://` have an empty host and path.  The same key with two verdicts
    is an error.  Rows are mapped one by one; empty tables and rule lists are fine.  A list of up to
    MOST_RULES is one cascade in every executor; a longer one, or a table, is a cascade for each part
    of the keys, with the same result.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    if isinstance(rules, list) and len(rules) > MOST_RULES:
        rules = rows.sparkSession.createDataFrame(pa.table({"verdict": pa.array([v for v, _ in rules], pa.string()), "rule": pa.array([r for _, r in rules], pa.string())}))
    if isinstance(rules, DataFrame):
        table, _ = base.written(rules.select(F.col("rule").alias("key"), "verdict").where("key is not null").distinct(), "url-listed")
        both = table.groupBy("key").count().where("count > 1").select("key").first()
        if both:
            raise ValueError(f"{both[0]} is both allowed and blocked")
        path = F.length("key") - F.when(F.instr("key", "/") > 0, F.instr("key", "/") - 1).otherwise(F.length("key"))
        lengths = sorted(r[0] for r in table.select(path.alias("n")).distinct().collect())  # as many as there are different lengths of paths
        if lengths:
            return _judged_in_parts(rows, table, table.count(), lengths, otherwise)
        rules = []
    verdicts: dict[str, str] = {}
    for verdict, rule in rules:
        if verdicts.setdefault(rule, verdict) != verdict:
            raise ValueError(f"{rule} is both allowed and blocked")
    lengths = sorted({len(r) - (r.find("/") if "/" in r else len(r)) for r in verdicts})
    listed = set(verdicts)
    blocked = {r for r, v in verdicts.items() if v == "block"}
    exact = cascade(rows.select("url"), listed, lengths)
    first = Bloom(blocked, 0.5, 1000)
    kinds = Cascade(first, blocked, {r for r in listed - blocked if r in first})
    return rows.mapInArrow(_judge(exact, kinds, lengths, otherwise), _JUDGED)


ORACLE_SQL = """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (select page_id, rh || rp as rule, verdict, row_number() over (partition by page_id order by length(rh || rp) desc, length(rh) desc) as k
         from p join r on (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from p left join fits f on f.page_id = p.page_id and f.k = 1
"""
