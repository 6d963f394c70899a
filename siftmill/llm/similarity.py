"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; texts with one set are one node.  A run splits the
nodes by the minimum hash of their sets under a function that the bucket chooses, which is a token
that two sets share with the probability of their similarity; buckets that are still large are
split again by a function of their own, up to three times.  Small buckets, and those that three
splits have not made small, are compared by brute force (large ones in blocks of bounded size, a
task for each pair of blocks, which hold about as many shingles however long the texts are).  At similarity s a pair stays together over d splits with
probability s**d, so runs are repeated until 1 - (1 - s**d)**runs reaches the target recall for the
deepest bucket seen.  Pairs are counted, never written: a bucket gives a count of links for each
node, and a spanning forest of its links.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

WORDS, SIMILAR, RECALL = 5, 0.8, 0.999
#: Fewest hash functions of a signature, deepest split, nodes of a bucket that is compared as it is, nodes of a block of a larger one.
HASHES, DEPTH, SMALL, BLOCK = 128, 3, 48, 512
#: Shingles of a block, on average: what a task holds follows the texts' lengths, not their number alone.
BLOCK_SHINGLES = 1 << 21
#: Functions that a split chooses from.
WAYS = 4
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, sorted; words are lower-case runs of word characters.  A text of fewer than five words is one shingle."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WORDS + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(h))):
            out = mixed(out * _STEP + h[k : k + n])
        return np.unique(out)


def hashes_for(similar: float, recall: float) -> int:
    """Functions enough for all the runs that the deepest split may ask for, none of them shared."""
    return max(HASHES, DEPTH * WAYS * runs_for(DEPTH, similar, recall))


@lru_cache(maxsize=4)
def functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20011)
    return rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def surely_below(similar: float, hashes: int) -> float:
    """Signatures that agree in less than this share cannot be of similar sets: five standard errors under the threshold."""
    return similar - 5 * math.sqrt(similar * (1 - similar) / hashes)


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    a, b = functions(hashes)
    low, step = np.full(hashes, np.iinfo(np.uint32).max, np.uint32), max(1, (1 << 17) // hashes)
    for k in range(0, len(shingles), step):
        low = np.minimum(low, ((shingles[k : k + step, None] * a + b) >> np.uint64(32)).min(0).astype(np.uint32))
    return low


def _signed(hashes: int):
    def run(batches):
        shingler = Shingler()
        for batch in base.slabs(batches):
            sets = [shingler(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"empty" + int(u).to_bytes(8, "big") for s, u in zip(sets, batch.column("uid").to_pylist())]
            lows = pa.array([signature(s, hashes).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("uid"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lows], names=["row", "uid", "set", "size", "low"])

    return run


def position(run: int, split: int, path: np.ndarray) -> np.ndarray:
    """The hash function that a bucket splits by: of WAYS that no other split of any run takes, so runs are independent."""
    return (run * DEPTH + split) * WAYS + (path % np.uint64(WAYS)).astype(np.int64)


def _paths(first: int, last: int, hashes: int):
    """For runs first..last-1: the nodes' buckets after one, two and three splits."""

    def run(batches):
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint32).reshape(-1, hashes).astype(np.uint64)
            uid, at = np.array(batch.column("uid").to_pylist(), np.int64), np.arange(len(batch))
            parts = []
            for r in range(first, last):
                path = np.full(len(at), mixed(np.array([r + 1], np.uint64))[0], np.uint64)
                steps = []
                for k in range(DEPTH):
                    choice = position(r, k, path)
                    path = mixed(path * _STEP + low[at, choice] + np.uint64(1))
                    steps.append(path.view(np.int64))
                parts.append([uid, *steps])
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * (DEPTH + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", *(f"b{k + 1}" for k in range(DEPTH))])

    return run


def _leaves(nodes: DataFrame, first: int, last: int, hashes: int = HASHES) -> tuple[DataFrame, int]:
    """(uid, leaf, n) for the runs' buckets of two nodes and more that are small or as deep as they get; and the depth of the deepest split, whether or not it left two nodes together."""
    left, _ = base.written(nodes.select("uid", "low").mapInArrow(_paths(first, last, hashes), base.schema(("uid", "bigint"), *((f"b{k + 1}", "bigint") for k in range(DEPTH)))), "join-paths")
    found, depth = None, 0
    for k in range(1, DEPTH + 1):
        depth = k  # from the second on, left has rows
        counts, _ = base.written(left.groupBy(f"b{k}").agg(F.count("*").alias("n")).where("n > 1"), "join-counts")
        here, _ = base.written(base.join_counted(left, counts, f"b{k}", "n"), "join-buckets")
        own = here if k == DEPTH else here.where(F.col("n") <= SMALL)
        own = own.select("uid", F.col(f"b{k}").alias("leaf"), "n")
        found = own if found is None else found.unionByName(own)
        left = here.where(F.col("n") > SMALL).drop("n")
        if k < DEPTH and left.isEmpty():
            break
    return found, depth


def runs_for(depth: int, similar: float = SIMILAR, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**depth)) if depth else 1


def _groups(batches, keys):
    """Groups of rows that lie together, as dicts of lists; one group is held at a time."""
    last, held = None, []
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _candidates(similar: float, hashes: int):
    """Nodes of a bucket whose signature is near another's."""

    def run(batches):
        least = surely_below(similar, hashes)
        for (_, low, high), rows in _groups(batches, ("leaf", "low_block", "high_block")):
            signs = np.frombuffer(b"".join(r["low"] for r in rows), np.uint32).reshape(-1, hashes)
            block, near = np.array([r["block"] for r in rows]), np.zeros(len(rows), bool)
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            for i in left.tolist():
                others = right[right > i] if low == high else right
                hits = others[(signs[others] == signs[i]).mean(1) >= least]
                if len(hits):
                    near[i] = True
                    near[hits] = True
            found = [r["uid"] for r, x in zip(rows, near.tolist()) if x]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([rows[0]["leaf"]] * len(found), pa.int64())], names=["uid", "leaf"])

    return run


class _Shared:
    """How many shingles a set of a group shares with each other one: by lists of a shingle's sets, or, where sets share most of theirs, by products of blocks of 0 and 1.  Both are exact."""

    #: Shingles of a block of columns, and list entries that take as long as one multiplication of a product.
    COLUMNS, ENTRY = 4096, 0.01

    def __init__(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
        self.m, self.sizes = len(sets), np.array([len(s) for s in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(self.m), self.sizes)
        often = np.bincount(codes) > 1  # a shingle of one set is shared with none
        met = often[codes]
        codes, owner = (np.cumsum(often) - 1)[codes[met]], owner[met]
        order = np.argsort(codes, kind="stable")
        self.posts, self.counts = owner[order], np.bincount(codes)
        self.begin = np.cumsum(self.counts) - self.counts
        self.codes, self.ends, self.table = codes, np.cumsum(np.bincount(owner, minlength=self.m)), None
        self.place = {i: k for k, i in enumerate(left.tolist())}
        lists = float(np.isin(np.arange(self.m), left)[self.posts] @ np.repeat(self.counts, self.counts))
        if float(len(left)) * len(right) * len(self.counts) * self.ENTRY < lists:
            self.table = self._products(codes[order], left, right)

    def _products(self, sorted_codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rows, table = np.full((2, self.m), -1), np.zeros((len(left), self.m), np.int64)
        rows[0][left], rows[1][right] = np.arange(len(left)), np.arange(len(right))
        for c in range(0, len(self.counts), self.COLUMNS):
            lo, hi = np.searchsorted(sorted_codes, (c, c + self.COLUMNS))
            blocks = []
            for row, side in zip(rows, (left, right)):
                block, at = np.zeros((len(side), self.COLUMNS), np.float32), row[self.posts[lo:hi]]
                block[at[at >= 0], sorted_codes[lo:hi][at >= 0] - c] = 1
                blocks.append(block)
            table[:, right] += (blocks[0] @ blocks[1].T).astype(np.int64)
        return table

    def of(self, i: int) -> np.ndarray:
        """By set of the group (in products: those of the right side)."""
        if self.table is not None:
            return self.table[self.place[i]]
        own = self.codes[self.ends[i - 1] if i else 0 : self.ends[i]]
        if not len(own):
            return np.zeros(self.m, np.int64)
        each = self.counts[own]
        stop = np.cumsum(each)
        return np.bincount(self.posts[np.repeat(self.begin[own] - (stop - each), each) + np.arange(stop[-1])], minlength=self.m)


def _links(similar: float):
    def run(batches):
        for (leaf, low, high), rows in _groups(batches, ("leaf", "low_block", "high_block")):
            m, block = len(rows), np.array([r["block"] for r in rows])
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            shares = _Shared([np.frombuffer(r["shingles"], np.uint64) for r in rows], left, right)
            sizes = shares.sizes
            earlier: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                for x in r["leaves"]:
                    if x < leaf:
                        earlier.setdefault(x, []).append(i)
            met = [set() for _ in rows]  # buckets before this one, where others of this group are too
            for x, members in earlier.items():
                if len(members) > 1:
                    for i in members:
                        met[i].add(x)
            copies = np.array([r["copies"] for r in rows], np.int64)
            total, parent = np.zeros(m, np.int64), list(range(m))

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i in left.tolist():
                shared = shares.of(i)
                others = right[right > i] if low == high else right
                s = shared[others]
                for j in others[s >= similar * (sizes[i] + sizes[others] - s) - 1e-9].tolist():
                    if met[i] and not met[i].isdisjoint(met[j]):
                        continue
                    total[i] += copies[j]
                    total[j] += copies[i]
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            found = [i for i in range(m) if total[i]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["uid"] for i in found], pa.int64()), pa.array(total[found]), pa.array([rows[root(i)]["uid"] for i in found], pa.int64())], names=["uid", "links", "to"])

    return run


def _shingled(batches):
    shingler = Shingler()
    for batch in base.slabs(batches):
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([shingler(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["uid", "shingles"])


def _in_blocks(members: DataFrame) -> DataFrame:
    """Rows for each pair of blocks they belong to; a bucket of n nodes has n / BLOCK blocks, or more if its texts are long (`weight`: its shingles), dealt by hash."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("uid", "leaf"), blocks).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return pairs.withColumn("low_block", F.least("block", "other")).withColumn("high_block", F.greatest("block", "other")).drop("other", "n", "weight")


def _together(df: DataFrame) -> DataFrame:
    keys = ["leaf", "low_block", "high_block"]
    return df.repartition(*keys).sortWithinPartitions(*keys, "uid")


def components(edges: DataFrame) -> DataFrame:
    """(uid, root) for every node of edges (uid, to): root is the smallest uid of its component.  Smallest labels spread over edges and jump over labels until none changes."""
    both, _ = base.written(edges.select("uid", "to").union(edges.select("to", "uid")).distinct(), "join-edges")
    labels = both.groupBy("uid").agg(F.least(F.min("to"), F.col("uid")).alias("root"), F.count("*").alias("n"))
    labels, path = base.written(labels, "join-labels")
    for _ in range(200):
        # edges are as many to a node as from it, and the middle of a large class has most of its edges
        around = base.join_counted(both, labels.select(F.col("uid").alias("to"), "root", "n"), "to", "n").groupBy("uid").agg(F.min("root").alias("near"))
        lower, lowered = base.written(labels.join(around, "uid").select("uid", F.least("root", "near").alias("root"), F.col("root").alias("was"), "n"), "join-lower")
        share = lower.groupBy("root").agg(F.count("*").alias("size"))
        beyond, _ = base.written(labels.select(F.col("uid").alias("root"), F.col("root").alias("beyond")).join(share, "root"), "join-beyond")
        jumped = base.join_counted(lower, beyond, "root", "size").select("uid", F.least("root", "beyond").alias("root"), "was", "n")
        after, newer = base.written(jumped, "join-labels")
        base.remove_path(edges.sparkSession, lowered)
        changed = not after.where("root <> was").isEmpty()
        labels = after.select("uid", "root", "n")
        base.remove_path(edges.sparkSession, path)
        path = newer
        if not changed:
            return labels.select("uid", "root")
    raise RuntimeError("components don't settle")


def classes(docs: DataFrame, columns: list[str], similar: float = SIMILAR, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the rows (`row` with the named columns and the text, uid, set), and for each set its copies, its n_links and the first row of its class, `head`."""
    hashes = hashes_for(similar, recall)
    carried = dict.fromkeys([*columns, "text"])  # the text once, also if it is among the columns
    rows = docs.select(F.struct(*(docs[c] for c in carried)).alias("row"), base.text_of(docs).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    table, _ = base.written(rows.mapInArrow(_signed(hashes), T.StructType([rows.schema["row"], rows.schema["uid"], *base.schema(("set", "binary"), ("size", "bigint"), ("low", "binary")).fields])), "join-rows")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("uid").alias("uid"))).alias("first")
    sets, _ = base.written(table.groupBy("set").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("low").alias("low")), "join-sets")
    nodes = sets.where(F.col("low").isNotNull()).select(F.col("first.uid").alias("uid"), "low", "copies", "size")

    found, done, depth = None, 0, 1
    while done < (need := runs_for(depth, similar, recall)):
        part, seen = _leaves(nodes, done, need, hashes)
        found = part if found is None else found.unionByName(part)
        done, depth = need, max(depth, seen)
    leaves, _ = base.written(found, "join-leaves")
    # Buckets of the same nodes, found again by another run, are compared once.
    mark = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("y"))
    kept = mark.groupBy("n", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf")
    members, _ = base.written(leaves.join(kept, "leaf"), "join-members")
    two = base.schema(("uid", "bigint"), ("leaf", "bigint"))
    some, _ = base.written(members.select("uid").distinct(), "join-some")
    some = F.broadcast(some) if some.count() <= base.BROADCAST_IDS else some  # else the signatures are shuffled, 512 bytes a node
    lows = nodes.select("uid", "low").join(some, "uid", "left_semi")  # most nodes are in no bucket with another
    marked = members.withColumn("weight", F.lit(0)).join(lows, "uid")
    near = _together(_in_blocks(marked)).mapInArrow(_candidates(similar, hashes), two).distinct()
    near, _ = base.written(near, "join-near")
    ids, _ = base.written(near.select("uid").distinct(), "join-ids")
    texts = base.at_places(table.select("uid", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text")), ids)
    shingles, _ = base.written(texts.mapInArrow(_shingled, base.schema(("uid", "bigint"), ("shingles", "binary"))), "join-shingles")
    facts = nodes.select("uid", "copies", "size")
    sizes = near.join(facts, "uid").groupBy("leaf").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    lists = near.groupBy("uid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # a leaf or none for each run
    own = near.join(sizes, "leaf").join(lists, "uid").join(facts.drop("size"), "uid").join(shingles, "uid")
    links, _ = base.written(_together(_in_blocks(own)).mapInArrow(_links(similar), base.schema(("uid", "bigint"), ("links", "bigint"), ("to", "bigint"))), "join-links")

    roots = components(links.where("uid <> to").select("uid", "to"))
    counts = links.groupBy("uid").agg(F.sum("links").alias("links")).withColumnRenamed("uid", "node")
    linked, _ = base.written(sets.select("set", "first").join(roots, F.col("first.uid") == F.col("uid")), "join-linked")
    heads, _ = base.written(linked.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n")), "join-heads")
    heads = base.join_counted(linked, heads, "root", "n").join(counts, F.col("uid") == F.col("node"), "left").select("set", "head", "links")
    every = sets.select("set", "first", "copies").join(heads, "set", "left")
    every = every.select("set", F.coalesce("head", "first").alias("head"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return table, base.written(every, "join-classes")[0]


def similarity_classes(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links.

    Texts are linked if the sets of their five-word shingles have a Jaccard similarity of at least
    `similar`; n_links counts the other rows linked to this one, copies included; a class is a
    connected component of links and has its smallest doc_id as class_id (nulls last).  Null and
    empty texts, and texts without a word, have no link and are classes of their own.  Rows with the
    same doc_id are rows of their own.  Other columns are ignored.
    """
    table, sets = classes(docs, ["doc_id"], similar, recall)
    rows = base.join_counted(table.select(F.col("row.doc_id").alias("doc_id"), "set"), sets, "set", "copies")
    return rows.select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: of each the smallest doc_id (nulls last, then in order of reading).

    Null and empty texts, and texts without a word, are classes of their own and stay; of equal rows
    one stays; an empty table gives none.  Texts are not shuffled, only the uids of the rows that go.
    """
    table, sets = classes(docs, docs.columns, similar, recall)
    heads = sets.select("set", F.col("head.uid").alias("head"), "copies")
    others = base.join_counted(table.select("uid", "set"), heads, "set", "copies").where("uid <> head").select("uid")
    others, _ = base.written(others, "join-others")
    own = F.struct(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)).alias("row")
    return base.at_places(table.select("uid", own), others, inside=False).select("row.*")
