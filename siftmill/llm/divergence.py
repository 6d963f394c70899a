"""Source divergence audit: how a source's words differ from another's, and from its language's.

Term part: each group's most divergent terms are found by radix selection.  A row's sort key is a
sequence of 16-bit digits, first those of its value (highest first), then its term's UTF-8 bytes; a
round counts the digits of all groups' undecided rows (pre-aggregated, spread over tasks), finds the
digit in which each group's k-th row lies, takes the rows before it, drops those behind and goes on
with those in it, until few are left.  So no task sees a large group, and ties end at the bytes.

Pair part: over all kept terms a source has a baseline share for those that it doesn't use, so

    sum f(p, q) = V f(b, c) + sum of its own terms (f(p, c) - f(b, c)) + sum of the other's (f(b, q) - f(b, c))
                + sum of shared terms (f(p, q) - f(p, c) - f(b, q) + f(b, c))

with baselines b and c.  The middle sums depend on a term's count alone and are taken over the
numbers of terms by count; only the last looks at terms, those that two sources share, in numpy, and
adds up pairs of sources where the rows lie.
"""

from __future__ import annotations

import io
import json
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base
from .lexical import Numbers

LEAST_DOCUMENTS, RANKS = 3, 200
SCALE = 1_000_000_000
#: Undecided rows of a group that are sorted; of more, the next digits are counted.
FEW = 1024
#: Entries of a task's counts, and pairs of sources, that it holds before it writes them.
HELD, PAIRS = 2_000_000, 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, lower-cased, and of any characters beyond ASCII; in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


_COUNTS = base.schema(("lang", "string"), ("source", "string"), ("term", "binary"), ("n", "bigint"), ("docs", "bigint"))


def _counted(batches):
    """Of each group a task's occurrences and documents by term; and each group with the empty term.  Held as numbers, an entry for each different term of a document."""
    numbers, groups, keys, times = Numbers(), Numbers(), [], []
    size = 0

    def flush():
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([np.zeros(0, np.int64), *times])[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        where, terms = key[begins] >> 32, pa.array([*numbers, b""], pa.binary())
        n, docs = np.add.reduceat(n, begins) if len(n) else n, np.diff(np.append(begins, len(key)))
        every, zero = np.arange(len(groups)), np.zeros(len(groups), np.int64)
        own = np.concatenate([where, every])
        named = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(own)) for k in (0, 1)]
        term = terms.take(pa.array(np.concatenate([key[begins] & 0xFFFFFFFF, zero + len(numbers)])))
        return pa.RecordBatch.from_arrays([*named, term, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))], names=_COUNTS.names)

    for batch in base.slabs(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            words, group = terms_of(text), groups[lang, source] << 32
            codes, n = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            keys.append(group | codes)
            times.append(n)
            size += len(codes)
            if size > HELD:
                yield flush()
                numbers, groups, keys, times, size = Numbers(), Numbers(), [], [], 0
    yield flush()


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly, whatever the counts."""
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0)) div greatest({total} + {kept}, 1)").cast("long")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


# Radix selection


def digit(j: int) -> Column:
    """The j-th digit of a row's key: four of its value, highest first, then two bytes of its term at a time, a missing byte before any."""
    if j < 4:
        return F.shiftright(F.lit(0x7FFFFFFFFFFFFFFF) - F.col("value"), 48 - 16 * j).bitwiseAND(F.lit(0xFFFF)).cast("int")
    one, two = (F.when(F.octet_length("item") >= at, F.conv(F.hex(F.substring("item", at, 1)), 16, 10).cast("int") + 1).otherwise(0) for at in (2 * j - 7, 2 * j - 6))
    return one * 257 + two


def selected(rows: DataFrame, k: int, name: str = "radix") -> DataFrame:
    """The k rows of each group with the highest values, of equal values those with the first items: rows (a written table: group, value, item); value at least 0, item binary, not twice in a group.

    Rounds go on while some group has more than FEW undecided rows; up to FEW are sorted.
    """
    sizes, _ = base.written(rows.groupBy("group").agg(F.count("*").alias("size"), F.max("value").alias("top")), f"{name}-sizes")
    top = sizes.agg(F.max("top")).first()[0] or 0
    state = sizes.select("group", "size", F.lit(k).cast("long").alias("need"))
    parts, left = [], rows
    for j in count(next((d for d in range(4) if top >> 48 - 16 * d), 3)):  # leading digits that are 0 in all rows decide nothing
        few = state.where((F.col("size") <= FEW) | (F.col("size") <= F.col("need")))
        order = W.partitionBy("group").orderBy(F.col("value").desc(), "item")
        last = base.join_counted(left, few, "group", "size").withColumn("at", F.row_number().over(order)).where("at <= need")
        parts.append(last.select(*rows.columns))
        state, _ = base.written(state.where((F.col("size") > FEW) & (F.col("size") > F.col("need"))), f"{name}-state")
        if state.isEmpty():
            break
        digits = base.join_counted(left, state, "group", "size").select(*rows.columns, "need", digit(j).alias("digit"))
        counts = digits.groupBy("group", "need", "digit").agg(F.count("*").alias("size"))  # at most 66,049 digits a group
        upto = F.sum("size").over(W.partitionBy("group").orderBy("digit"))
        within = counts.withColumns({"upto": upto, "all": F.sum("size").over(W.partitionBy("group"))}).where("upto - size < need and upto >= need")
        facts, _ = base.written(within.select("group", F.col("digit").alias("cut"), (F.expr("need - (upto - size)")).alias("still"), "size", "all"), f"{name}-cut")
        met = base.join_counted(left, facts.select("group", "cut", "all"), "group", "all").select(*rows.columns, "cut", digit(j).alias("digit")).where("digit <= cut")
        met, _ = base.written(met, f"{name}-met")
        parts.append(met.where("digit < cut").select(*rows.columns))
        left, state = met.where("digit = cut").select(*rows.columns), facts.select("group", "size", F.col("still").alias("need"))
    return reduce(DataFrame.unionByName, parts)


# Pairs


def _put_facts(folder: str):
    """A file for each lang: its kept terms, its sources in order, and their totals."""

    def run(batches):
        files = base.Files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                files.put(f"{row['number']}.json", json.dumps({"kept": row["kept"], "totals": row["totals"]}).encode())
            yield pa.RecordBatch.from_arrays([batch.column("number")], names=["number"])

    return run


class _Lang:
    """Baselines of a lang's sources, and shares by count."""

    def __init__(self, data: bytes):
        facts = json.load(io.BytesIO(data))
        self.kept = facts["kept"]
        self.under = [max(t + self.kept, 1) for t in facts["totals"]]
        self.base = np.array([1 + SCALE // u for u in self.under], np.int64)

    def shares(self, source: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(count) or int(count.max()) < 9_000_000_000:
            return 1 + SCALE * (count + 1) // np.array(self.under, np.int64)[source]
        return np.array([1 + SCALE * (c + 1) // self.under[s] for s, c in zip(source.tolist(), count.tolist())], np.int64)


class _Langs:
    def __init__(self, folder: str):
        self.files, self.known = base.Files(folder), {}

    def __getitem__(self, number: int) -> _Lang:
        if number not in self.known:
            if len(self.known) >= 16:
                self.known.clear()
            with self.files.open(f"{number}.json") as file:
                self.known[number] = _Lang(file.read())
        return self.known[number]


def _f(p, q):
    d = p - q
    return d * d // q


_SUMS = base.schema(("number", "bigint"), ("s", "int"), ("t", "int"), ("value", "bigint"))


def _sums(number: int, s, t, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), number)), pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(value, pa.int64())], names=_SUMS.names)


def _baselines(folder: str):
    """Rows (number, s, counts, terms), one a source: what it gives to its pairs by its baseline and its own terms alone."""

    def run(batches):
        langs = _Langs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                lang, s, all_s = langs[row["number"]], row["s"], None
                b = int(lang.base[s])
                all_s = np.arange(len(lang.base))
                counts, terms = np.array(row["counts"] or [], np.int64), np.array(row["terms"] or [], np.int64)
                p = lang.shares(np.full(len(counts), s), counts)
                first, second = lang.kept * _f(b, lang.base), np.zeros(len(all_s), np.int64)
                step = max(1, PAIRS // max(len(all_s), 1))
                for k in range(0, len(p), step):
                    some, n = p[k : k + step, None], terms[k : k + step, None]
                    first = first + (n * (_f(some, lang.base) - _f(b, lang.base))).sum(0)
                    second = second + (n * (_f(lang.base, some) - _f(lang.base, b))).sum(0)
                other = all_s != s
                yield _sums(row["number"], np.full(int(other.sum()), s), all_s[other], first[other])
                yield _sums(row["number"], all_s[other], np.full(int(other.sum()), s), second[other])

    return run


def _shared(folder: str):
    """Rows (number, sources, counts), one a term: what the terms that two sources share add to the pair."""

    def run(batches):
        langs = _Langs(folder)
        held: dict[int, list] = {}
        size = 0

        def added(number, parts):
            """The parts' pairs, each once."""
            code, value = (np.concatenate(x) for x in zip(*parts))
            code, back = np.unique(code, return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, back, value)
            return code, total

        def flush():
            for number, parts in held.items():
                code, total = added(number, parts)
                n = len(langs[number].base)
                yield _sums(number, code // n, code % n, total)

        for batch in batches:
            sizes = np.diff(batch.column("sources").offsets.to_numpy())
            source, count = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("sources", "counts"))
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            numbers = batch.column("number").to_numpy()
            begins = np.cumsum(sizes) - sizes
            for number in np.unique(numbers).tolist():
                lang, own = langs[number], np.flatnonzero(numbers[row_of] == number)
                n = len(lang.base)
                p = np.zeros(len(source), np.int64)
                p[own] = lang.shares(source[own], count[own])
                each = sizes[row_of[own]]  # partners of an entry: all entries of its term
                cuts = np.searchsorted(np.cumsum(each), np.arange(PAIRS, int(each.sum()) + PAIRS, PAIRS), "right")
                lo = 0
                for hi in [*np.unique(np.maximum(cuts, 1)).tolist(), len(own)]:
                    hi = min(max(hi, lo + 1), len(own))
                    if hi <= lo:
                        continue
                    left, m = own[lo:hi], each[lo:hi]
                    lo = hi
                    a = np.repeat(left, m)
                    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    c = np.repeat(begins[row_of[left]], m) + inner
                    two = source[a] != source[c]
                    a, c = a[two], c[two]
                    s, t = source[a], source[c]
                    b, q = lang.base[s], lang.base[t]
                    value = _f(p[a], p[c]) - _f(p[a], q) - _f(b, p[c]) + _f(b, q)
                    parts = [added(number, [(s * n + t, value)])]
                    before = sum(len(x[0]) for x in held.get(number, []))
                    held[number] = [added(number, held.get(number, []) + parts)]
                    size += len(held[number][0][0]) - before
                    if size > PAIRS:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return run


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Each lang keeps the terms that are in at least `least` of its rows.  Part `pair` has a row for
    each other source of a group's lang, all of them; part `term` the `ranks` kept terms with the
    greatest divergence from the lang among those that the group has relatively more of.  Equal values
    go by the UTF-8 bytes of the item.  Null text, lang and source are ''; a source without a term is
    compared by its baseline; a lang without a kept term has values of 0; whole texts count; repeated
    rows count each; an empty table gives no row.  Other columns are ignored.  The number of sources
    of a lang bounds what a task holds for it, as the pairs of the result are its square.
    """
    slim = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts, _ = base.written(slim.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    own = counts.where("octet_length(term) > 0")
    kept, _ = base.written(own.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "audit-kept")
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0)
    used, _ = base.written(own.drop("docs").join(kept, ["lang", "term"]), "audit-used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counts.where("octet_length(term) = 0").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang").na.fill(0)
    numbered = groups.withColumns({"number": F.xxhash64("lang"), "s": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1})
    groups, _ = base.written(numbered, "audit-groups")
    if groups.groupBy("number").agg(F.count_distinct("lang").alias("n")).where("n > 1").count():
        raise RuntimeError("two langs have one hash")

    named = groups.select(F.struct("lang", "source").alias("group"), "total", "kept", "lang_total", F.col("terms").alias("size"))
    shares = base.join_counted(used.select(F.struct("lang", "source").alias("group"), "term", "n", "lang_n"), named, "group", "size")
    shares = shares.withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")}).where("p > q")
    rows, _ = base.written(shares.select("group", F.col("term").alias("item"), divergence("p", "q").alias("value")), "audit-terms")
    order = W.partitionBy("group").orderBy(F.col("value").desc(), "item")
    top = selected(rows, ranks).withColumn("rank", F.row_number().over(order))
    terms = top.select("group.lang", "group.source", F.lit("term").alias("part"), F.decode("item", "UTF-8").alias("item"), "value", "rank")

    spark, folder = docs.sparkSession, base.scratch_path(docs.sparkSession, "audit-facts")
    facts = groups.groupBy("number").agg(F.first("kept").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("s", "total"))), lambda x: x["total"]).alias("totals"))
    base.written(facts.mapInArrow(_put_facts(folder), base.schema(("number", "bigint"))), "audit-facts-names")
    places = groups.select("lang", "source", "number", "s", F.col("terms").alias("size"))
    by_count = used.groupBy("lang", "source", "n").agg(F.count("*").alias("with")).groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("n", "with"))).alias("c"))
    single = groups.select("lang", "source", "number", "s").join(by_count, ["lang", "source"], "left").select("number", "s", F.col("c.n").alias("counts"), F.col("c.with").alias("terms"))
    numbered = base.join_counted(used.select(F.struct("lang", "source").alias("g"), "term", "n"), places.select(F.struct("lang", "source").alias("g"), "number", "s", "size"), "g", "size")
    lists = numbered.groupBy("number", "term").agg(F.collect_list(F.struct("s", "n")).alias("x"))  # at most a lang's sources
    shared = lists.where(F.size("x") > 1).select("number", F.col("x.s").alias("sources"), F.col("x.n").alias("counts"))
    sums = single.mapInArrow(_baselines(folder), _SUMS).unionByName(shared.mapInArrow(_shared(folder), _SUMS))
    value = sums.groupBy("number", "s", "t").agg(F.sum("value").alias("value"))
    left = groups.select("number", "s", "lang", "source")
    right = groups.select(F.col("number").alias("n2"), F.col("s").alias("t"), F.col("source").alias("item"))
    pairs = value.join(left, ["number", "s"]).join(right, (F.col("number") == F.col("n2")) & (value["t"] == right["t"]))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(terms)


ORACLE_SQL = """
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
g as (select distinct lang, source from d),
o as (select k, lang, source, term, count(*) as n from (select k, lang, source, unnest(terms) as term from d) group by all),
kept as (select lang, term, sum(n)::hugeint as lang_n from o group by all having count(*) >= 3),
c as (select lang, source, term, sum(n)::hugeint as n from o semi join kept using (lang, term) group by all),
v as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as total from kept group by lang),
tot as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
every as (select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n,
  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (tot.total + v.v) as p,
  1 + (1000000000::hugeint * (kept.lang_n + 1)) // (v.total + v.v) as q
  from g join kept using (lang) join v using (lang) join tot using (lang, source) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0)::bigint as value
  from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every_pair as (select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from every where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from every_pair
union all
select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 200
"""
