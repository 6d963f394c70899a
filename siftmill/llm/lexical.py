"""Ranked lexical search over inverted treaps.

Rows are indexed where they are read, in blocks of bounded size.  A term's postings in a block are a
treap: a search tree by the document's place in the block (places follow doc_id) and a heap by
impact, so the root of any stretch of places has the term's greatest impact there.  A query walks the
treaps of its terms at once: a stretch's roots, weighted and summed, bound every score in it; a
stretch whose bound can't enter the k best is left, any other is split at the document of its
greatest root, whose score is computed.  Stretches of all queries of a group are walked together in
numpy, those with the highest bounds first.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

#: A block is closed when it has so many bytes of text or so many documents (places take 16 bits).
BLOCK_BYTES, BLOCK_DOCS = 24 << 20, 60_000
#: Queries that are walked together, and pairs of a stretch and a term that one step takes.
GROUP, STEP = 256, 1 << 18
#: The parts of a score that don't depend on a term's weight.
UNIT, STEEP, FLAT, SLOPE = 1_000_000_000, 1000, 25, 75
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII digits and letters, lower-cased, and of any characters beyond ASCII; in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (STEEP * tf + 8 * m)


def norm(terms: int, docs: int, total: int) -> int:
    """A document's m, from its number of terms, the number of documents and that of all terms."""
    return FLAT + SLOPE * terms * docs // total


def _sizes(batches):
    docs = total = 0
    for batch in base.slabs(batches):
        for text in batch.column("text").to_pylist():
            n = len(terms_of(text))
            docs, total = docs + (n > 0), total + n
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "total": pa.array([total], pa.int64())})


# The index


class Numbers(dict):
    """A number for each key, in order of first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def treap(impacts: list[int], begins: list[int], ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For lists that lie one after another: each entry's left and right child (1 + its place in the list, 0 for none) and each list's root.  Of equal impacts the first is above."""
    left, right, roots = [0] * len(impacts), [0] * len(impacts), []
    for b, e in zip(begins, ends):
        if e - b == 1:
            roots.append(0)
            continue
        spine: list[int] = []
        for i in range(b, e):
            x, last = impacts[i], -1
            while spine and impacts[spine[-1]] < x:
                last = spine.pop()
            if last >= 0:
                left[i] = last - b + 1
            if spine:
                right[spine[-1]] = i - b + 1
            spine.append(i)
        roots.append(spine[0] - b)
    return left, right, roots


_INDEX = base.schema(("block", "bigint"), ("term", "binary"), ("n", "int"), ("root", "int"), ("docs", "binary"), ("impacts", "binary"), ("lefts", "binary"), ("rights", "binary"), ("ids", "array<bigint>"))


class _Block:
    def __init__(self):
        self.numbers, self.docs, self.bytes = Numbers(), [], 0

    def add(self, doc_id, size: int, words: list[bytes]) -> None:
        codes, tf = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
        self.docs.append((doc_id, len(words), codes, tf))
        self.bytes += size

    def rows(self, number: int, docs: int, total: int) -> pa.RecordBatch:
        """A row for each term, and one with the empty term for the doc_ids in the order of their places, which is ascending, nulls last."""
        own = sorted(self.docs, key=lambda x: (x[0] is None, x[0] or 0))
        each = np.array([len(x[2]) for x in own])
        codes, tf = np.concatenate([x[2] for x in own]), np.concatenate([x[3] for x in own])
        m = np.repeat(np.array([norm(x[1], docs, total) for x in own], np.int64), each)
        order = np.argsort(codes, kind="stable")
        places, impacts = np.repeat(np.arange(len(own)), each)[order], impact(tf, m)[order]
        sizes = np.bincount(codes, minlength=len(self.numbers))
        ends = np.cumsum(sizes)
        left, right, roots = treap(impacts.tolist(), (ends - sizes).tolist(), ends.tolist())
        count = len(sizes)

        def cut(values, kind: str) -> pa.Array:
            data, width = np.asarray(values).astype(kind), np.dtype(kind).itemsize
            offsets = np.concatenate([[0], ends * width, [ends[-1] * width]]).astype(np.int32)  # the last row has none
            return pa.BinaryArray.from_buffers(pa.binary(), count + 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(count + 1, number)),
                pa.array([*self.numbers, b""], pa.binary()),
                pa.array([*sizes.tolist(), len(own)], pa.int32()),
                pa.array([*roots, None], pa.int32()),
                *(cut(v, k) for v, k in ((places, "<u2"), (impacts, "<u4"), (left, "<u2"), (right, "<u2"))),
                pa.array([None] * count + [[x[0] for x in own]], pa.list_(pa.int64())),
            ],
            names=_INDEX.names,
        )


def _blocks(docs: int, total: int):
    def run(batches):
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in base.slabs(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if words := terms_of(text):
                    block.add(doc_id, len(text), words)
                    if block.bytes >= BLOCK_BYTES or len(block.docs) >= BLOCK_DOCS:
                        yield block.rows(number, docs, total)
                        number, block = number + 1, _Block()
        if block.docs:
            yield block.rows(number, docs, total)

    return run


class Index:
    """A written index: its table, the number of documents with a term, and that of all their terms."""

    def __init__(self, table: DataFrame, docs: int, total: int):
        self.table, self.docs, self.total = table, docs, total


def indexed(docs: DataFrame) -> Index:
    """Indexes every row and whole text of docs (doc_id, text).  Texts are read twice, once to count, and never shuffled."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text"))
    n, total = rows.mapInArrow(_sizes, base.schema(("docs", "bigint"), ("total", "bigint"))).agg(F.sum("docs"), F.sum("total")).first()
    return Index(base.written(rows.mapInArrow(_blocks(n or 0, total or 1), _INDEX), "treaps")[0], n or 0, total or 0)


# Walking


class Treaps:
    """The treaps of some terms of a block as flat arrays; places of children count in them, -1 is none."""

    def __init__(self, rows: dict[str, list]):
        sizes = np.array(rows["n"], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.terms = {t: k for k, t in enumerate(rows["term"])}
        self.begins, self.roots = begins, begins + np.array(rows["root"], np.int64)
        shift = np.repeat(begins, sizes)
        self.doc, self.impact = (np.frombuffer(b"".join(rows[c]), k).astype(np.int64) for c, k in (("docs", "<u2"), ("impacts", "<u4")))
        self.left, self.right = (np.where(x > 0, x + shift - 1, -1) for x in (np.frombuffer(b"".join(rows[c]), "<u2").astype(np.int64) for c in ("lefts", "rights")))
        self.key = (np.repeat(np.arange(len(sizes)), sizes) << 16) + self.doc

    def at(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of documents in terms, 0 where they aren't: a search by the tree's order."""
        key = (term << 16) + doc
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[found] == key, self.impact[found], 0)

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The root of what lies under node in places lo to hi - 1, or -1."""
        node = node.copy()
        doc = self.doc[node]
        out = np.flatnonzero((doc < lo) | (doc >= hi))
        while len(out):
            here = node[out]
            below = np.where(self.doc[here] < lo[out], self.right[here], self.left[here])
            node[out] = below
            out = out[below >= 0]
            doc = self.doc[node[out]]
            out = out[(doc < lo[out]) | (doc >= hi[out])]
        return node


class _Stretches:
    """Stretches of places, each for a query, with the pairs (stretch, term) whose treaps have a document there, in the order of stretches."""

    def __init__(self, query, lo, hi, of, term, node, weight):
        # stretches without a pair go
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        kept = of[begins]
        self.query, self.lo, self.hi, self.begins = query[kept], lo[kept], hi[kept], begins
        self.of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(of))))
        self.term, self.node, self.weight = term, node, weight

    def taken(self, mask: np.ndarray) -> "_Stretches":
        pairs = mask[self.of]
        return _Stretches(self.query, self.lo, self.hi, self.of[pairs], self.term[pairs], self.node[pairs], self.weight[pairs])

    def joined(self, other: "_Stretches") -> "_Stretches":
        return _Stretches(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("query", "lo", "hi")), np.concatenate([self.of, other.of + len(self.lo)]), *(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("term", "node", "weight")))


class Best:
    """The k best of each query so far; a score must be over `least`, or equal it at a place before `before`."""

    def __init__(self, least: np.ndarray, before: np.ndarray, k: int):
        self.least, self.before, self.k = least.copy(), before.copy(), k
        self.query = self.place = self.score = np.zeros(0, np.int64)

    def may_enter(self, query, score, place) -> np.ndarray:
        least = self.least[query]
        return (score > least) | (score == least) & (place < self.before[query])

    def add(self, query, place, score) -> None:
        good = self.may_enter(query, score, place)
        if not good.any():
            return
        q, p, s = (np.concatenate(x) for x in ((self.query, query[good]), (self.place, place[good]), (self.score, score[good])))
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        rank = np.arange(len(q)) - np.repeat(np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])), np.unique(q, return_counts=True)[1])
        last = rank == self.k - 1
        self.least[q[last]], self.before[q[last]] = s[last], p[last]
        top = rank < self.k
        self.query, self.place, self.score = q[top], p[top], s[top]


def walked(treaps: Treaps, best: Best, query: np.ndarray, term: np.ndarray, weight: np.ndarray, places: int, step: int = STEP) -> Best:
    """Fills best from pairs (query, term, weight) sorted by query; memory is bounded by a few times `step` pairs."""
    count = len(best.least)
    waiting = [_Stretches(np.arange(count), np.zeros(count, np.int64), np.full(count, places), query, term, treaps.roots[term], weight)]
    while waiting:
        now = waiting.pop()
        while waiting and len(now.node) + len(waiting[-1].node) <= step // 2:
            now = now.joined(waiting.pop())
        if not len(now.node):
            continue
        value = now.weight * treaps.impact[now.node]
        bound = np.add.reduceat(value, now.begins)
        alive = best.may_enter(now.query, bound, now.lo)
        if not alive.all():
            now = now.taken(alive)
            if not len(now.node):
                continue
            value, bound = now.weight * treaps.impact[now.node], bound[alive]
        if len(now.node) > step and len(bound) > 1:  # the better half first
            high = np.zeros(len(bound), bool)
            high[np.argsort(-bound, kind="stable")[: len(bound) // 2]] = True
            waiting += [now.taken(~high), now.taken(high)]
            continue
        top = np.flatnonzero(value == np.maximum.reduceat(value, now.begins)[now.of])
        first = top[np.concatenate([[True], now.of[top][1:] != now.of[top][:-1]])]
        split = treaps.doc[now.node[first]]
        cut = split[now.of]
        best.add(now.query, split, np.add.reduceat(now.weight * treaps.at(now.term, cut), now.begins))
        halves = []
        for lo, hi in ((now.lo, split), (split + 1, now.hi)):
            node = treaps.within(now.node, lo[now.of], hi[now.of])
            some = node >= 0
            halves.append(_Stretches(now.query, lo, hi, now.of[some], now.term[some], node[some], now.weight[some]))
        waiting.append(halves[0].joined(halves[1]))
    return best


# Queries


def _query_terms(batches):
    for batch in base.slabs(batches):
        uids, terms, repeats = [], [], []
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
            found: dict[bytes, int] = {}
            for t in terms_of(text):
                found[t] = found.get(t, 0) + 1
            uids += [uid] * len(found)
            terms += found
            repeats += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(terms, pa.binary()), pa.array(repeats, pa.int64())], names=["uid", "term", "repeats"])


def _put_groups(folder: str):
    """Files of a group's queries: they are read from there, a group at a time, by every task that searches a block."""

    def run(batches):
        files, last, held = base.Files(folder), None, []

        def put():
            table = pa.Table.from_batches(held)
            out = io.BytesIO()
            with pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            files.put(f"{last}.arrow", out.getvalue())
            return pa.RecordBatch.from_pydict({"group": pa.array([last], pa.int64())})

        for batch in batches:
            groups = batch.column("group").to_numpy()
            for cut in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(groups)) + 1) if len(groups) else ():
                if held and groups[cut[0]] != last:
                    yield put()
                    held = []
                last = int(groups[cut[0]])
                held.append(batch.slice(cut[0], len(cut)).select(["uid", "term", "weight"]))
        if held:
            yield put()

    return run


class _Group:
    def __init__(self, data: bytes):
        table = pa.ipc.open_file(data).read_all()
        self.uids, self.query = np.unique(table["uid"].to_numpy(), return_inverse=True)
        self.terms, self.weight = table["term"].to_pylist(), table["weight"].to_numpy()


_HITS = base.schema(("uid", "bigint"), ("score", "bigint"), ("doc_id", "bigint"), ("block", "bigint"), ("place", "bigint"))
_FAR = np.iinfo(np.int64).max


def _searched(folder: str, groups: list[int], k: int):
    def run(batches):
        files, known = base.Files(folder), {}
        floors: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by group, of earlier blocks: the k-th score and its doc_id

        def group(g: int) -> _Group:
            if g not in known:
                if len(known) >= 4:
                    known.clear()
                with files.open(f"{g}.arrow") as file:
                    known[g] = _Group(file.read())
            return known[g]

        def search(block: int, rows: dict[str, list]):
            ids = next((x for x in rows["ids"] if x is not None), None)
            keep = [i for i, t in enumerate(rows["term"]) if t]
            if ids is None or not keep:
                return
            treaps = Treaps({c: [v[i] for i in keep] for c, v in rows.items()})
            order = np.array([_FAR if x is None else x for x in ids], np.int64)
            for g in groups:
                own = group(g)
                least, least_id = floors.get(g) or (np.ones(len(own.uids), np.int64), np.full(len(own.uids), _FAR))
                term = np.array([treaps.terms.get(t, -1) for t in own.terms], np.int64)
                met = term >= 0
                sort = np.argsort(own.query[met], kind="stable")
                best = Best(least, np.searchsorted(order, least_id), k)
                best.before[least_id == _FAR] = len(ids)
                walked(treaps, best, own.query[met][sort], term[met][sort], own.weight[met][sort], len(ids))
                full = np.flatnonzero(np.bincount(best.query, minlength=len(least)) == k)
                floors[g] = (best.least, np.copy(least_id))
                floors[g][1][full] = order[best.before[full]]
                found = [ids[p] for p in best.place.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own.uids[best.query]), pa.array(best.score), pa.array(found, pa.int64()), pa.array(np.full(len(found), block)), pa.array(best.place)], names=_HITS.names)

        last, held = None, {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for cut in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1) if len(blocks) else ():
                if held and blocks[cut[0]] != last:
                    yield from search(last, held)
                    held = {}
                last = int(blocks[cut[0]])
                for c, values in batch.slice(cut[0], len(cut)).to_pydict().items():
                    held.setdefault(c, []).extend(values)
        if held:
            yield from search(last, held)

    return run


def searched(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """uid, rank, doc_id, score: the k documents with the highest scores above 0 for each row of queries (uid, text), by descending score, then ascending doc_id (nulls last, then by place in the index).

    Only the treaps of the queries' terms move, a block's together; queries are in files of GROUP in
    the shared folder, of which a task holds a few.  A task gives at most k rows for each block and
    query, and Spark keeps the k best of a partition before they are shuffled.
    """
    spark = queries.sparkSession
    terms, _ = base.written(queries.select("uid", base.text_of(queries).alias("text")).mapInArrow(_query_terms, base.schema(("uid", "bigint"), ("term", "binary"), ("repeats", "bigint"))), "query-terms")
    wanted, _ = base.written(terms.select("term").distinct(), "query-vocabulary")
    postings = index.table.where("root is not null")
    df = postings.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.docs + 2) / (2.0 * F.col("df") + 1)))
    weights, _ = base.written(df.select("term", weight.cast("long").alias("w")).where("w > 0"), "query-weights")
    groups = -(-queries.count() // GROUP)
    dealt = terms.join(weights, "term").select(F.pmod(F.xxhash64("uid"), F.lit(max(groups, 1))).alias("group"), "uid", "term", (F.col("w") * F.col("repeats")).alias("weight"))
    folder = base.scratch_path(spark, "query-groups")
    put = dealt.repartition("group").sortWithinPartitions("group", "uid", "term").mapInArrow(_put_groups(folder), base.schema(("group", "bigint")))
    found = sorted(r["group"] for r in base.written(put, "query-group-names")[0].collect())
    own = postings.join(weights.select("term"), "term", "left_semi").select(*_INDEX.names).unionByName(index.table.where("root is null"))
    hits = own.repartition("block").sortWithinPartitions("block").mapInArrow(_searched(folder, found, k), _HITS)
    order = W.partitionBy("uid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "place")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("uid", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score for every row of items (item_id, text) against every row of docs (doc_id, text).

    Texts that are null, empty or without a term are in no result, and such items have none; whole
    texts count, however long.  Rows with the same doc_id, or the same item_id, are rows of their own;
    equal scores go by doc_id, nulls last.  Empty tables give no row.  Other columns are ignored.
    """
    rows, _ = base.written(items.select(items["item_id"], base.text_of(items).alias("text")).withColumn("uid", F.monotonically_increasing_id()), "query-rows")
    hits = searched(indexed(docs), rows.select("uid", "text"), k)
    return hits.join(rows.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
with d as (select doc_id, {_TERMS} as terms from documents),
t as (select doc_id, unnest(terms) as term from d),
p as (select doc_id, term, count(*) as tf from t group by all),
s as (select count(*) as n_docs, sum(len(terms))::bigint as total from d where len(terms) > 0),
w as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from p, s group by term, n_docs),
q as (select item_id, unnest({_TERMS}) as term from benchmark),
r as (select item_id, term, count(*) as repeats from q group by all),
m as (select doc_id, 25 + (75 * len(terms) * n_docs) // total as m from d, s where len(terms) > 0),
x as (select item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from r join w using (term) join p using (term) join m using (doc_id) group by all),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
