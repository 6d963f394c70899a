"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is 64 bits, each the majority of that bit over the hashes of its three-word
shingles.  Texts with one fingerprint are one node.  The bits are grouped into partitions, correlated
ones together; with thresholds T that sum to (differing - partitions + 1), where -1 leaves a partition
out, two fingerprints within `differing` bits are within T[i] bits in some partition i.  So each
fingerprint looks for the others in each partition under a threshold of its own, which dynamic
programming chooses by the expected number of candidates: a fingerprint whose bits are frequent in one
partition leaves that out and looks further in the others.

Candidates of a key are compared (small groups), or, in larger ones, meet at points: every
fingerprint writes the points around it, and two are within `differing` bits exactly if they share
one.  So a group of n costs n rows times a constant, never n^2, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .similarity import components, mixed

BITS, WORDS, SEED, DIFFERING = 64, 3, 42, 2
#: Members of a key that are compared pair by pair; beyond it, they meet at points.
SMALL = 32
#: A key that is written and shuffled costs as much as so many comparisons.
KEY_COST = 50.0
#: Partitions that are tried beyond the fewest, and bits of a part of a partition whose values are counted.
MORE, PART = 2, 8
_SLICE = 1 << 14


def fingerprint(text: str | None) -> int:
    """Of A-Z lower-cased words between white space; repeats count, a text of fewer than three words is one shingle, one of none has 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - WORDS + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends, digest = (ends - sizes)[:n].tolist(), ends[WORDS - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _SLICE):
        part = [digest(joined[a:b], SEED) for a, b in zip(begins[k : k + _SLICE], ends[k : k + _SLICE])]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches):
    for batch in base.slabs(batches):
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy().view(np.uint64)


# Partitions: which bits go together


def _together(batches):
    """How often two bits are both set among a task's fingerprints."""
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = _fps(batch)
        for k in range(0, len(fps), _SLICE):
            bits = np.unpackbits(fps[k : k + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)  # a slice's sums are exact in 24 bits
    i, j = np.indices(both.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel())], names=["i", "j", "n"])


def correlations(both: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlations of bits, from the counts of both set (on the diagonal: of one set); 0 for a constant bit."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    cover = both / max(n, 1) - np.outer(share, share)
    return np.abs(np.divide(cover, np.outer(spread, spread), out=np.zeros_like(cover), where=np.outer(spread, spread) > 0))


def grouped_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal width, each grown from the most correlated pair left by the bit most correlated with it on average."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own: list[int] = []
        while len(own) < width:
            rest = sorted(left)
            if own:
                best = max(rest, key=lambda b: (float(related[b, own].sum()), -b))
            elif len(rest) > 1:
                block = related[np.ix_(rest, rest)].copy()
                np.fill_diagonal(block, -1)
                best = rest[int(block.max(1).argmax())]
            else:
                best = rest[0]
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _pieces(bits: list[int]) -> list[list[int]]:
    return [bits[k : k + PART] for k in range(0, len(bits), PART)]


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= (((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64)
    return out


def _values(layouts: dict[int, list[list[int]]]):
    """Counts of the values of each piece of each partition, for each number of partitions."""

    def run(batches):
        pieces = [(m, i, j, bits) for m, layout in layouts.items() for i, part in enumerate(layout) for j, bits in enumerate(_pieces(part))]
        counts = np.zeros((len(pieces), 1 << PART), np.int64)
        for batch in batches:
            fps = _fps(batch)
            for k, (*_, bits) in enumerate(pieces):
                counts[k] += np.bincount(_value(fps, bits), minlength=1 << PART)
        k, v = np.nonzero(counts)
        where = np.array([p[:3] for p in pieces], np.int32).reshape(-1, 3)[k]
        yield pa.RecordBatch.from_arrays([*(pa.array(where[:, c]) for c in range(3)), pa.array(v, pa.int32()), pa.array(counts[k, v])], names=["m", "i", "j", "v", "n"])

    return run


# Thresholds: how far to look in which partition

_DISTANCE = np.bitwise_count(np.arange(1 << PART)[:, None] ^ np.arange(1 << PART)[None, :])


class Layout:
    """Partitions with what is needed to say how many fingerprints are within how many bits of one, taking the pieces of a partition as independent."""

    def __init__(self, parts: list[list[int]], counts: dict[tuple[int, int], np.ndarray], n: int, differing: int):
        self.parts, self.n, self.differing = parts, n, differing
        self.shares = {key: np.stack([(_DISTANCE == d) @ c for d in range(differing + 1)], 1) / max(n, 1) for key, c in counts.items()}
        self.counts = counts

    @property
    def total(self) -> int:
        """What the thresholds add up to."""
        return self.differing - len(self.parts) + 1

    def _expected(self, shares: list[np.ndarray]) -> np.ndarray:
        """Rows of shares by distance, one array a piece, to the number of fingerprints within 0, 1, .. bits in the partition."""
        out = shares[0]
        for other in shares[1:]:
            out = np.stack([sum(out[:, a] * other[:, d - a] for a in range(d + 1)) for d in range(self.differing + 1)], 1)
        return np.cumsum(out, 1) * self.n

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """By fingerprint, partition and threshold -1, 0, ..: keys beyond its own, and candidates."""
        return np.stack([self._costs(i, [self.shares[i, j][_value(fps, bits)] for j, bits in enumerate(_pieces(part))], len(fps)) for i, part in enumerate(self.parts)], 1)

    def _costs(self, i: int, shares: list[np.ndarray], rows: int) -> np.ndarray:
        keys = np.cumsum([comb(len(self.parts[i]), d) for d in range(self.differing + 1)]) - 1
        return np.concatenate([np.zeros((rows, 1)), self._expected(shares) + KEY_COST * keys], 1)

    def mean_cost(self) -> float:
        """Of a fingerprint, at thresholds that are the same for all: one key for each partition, and what the thresholds cost."""
        mean = [self._costs(i, [(self.counts[i, j] @ self.shares[i, j] / max(self.n, 1))[None] for j in range(len(_pieces(part)))], 1) for i, part in enumerate(self.parts)]
        costs = np.stack(mean, 1)
        chosen = self.allocated(costs)
        return float(KEY_COST * len(self.parts) + sum(costs[0, i, t + 1] for i, t in enumerate(chosen[0])))

    def allocated(self, costs: np.ndarray) -> np.ndarray:
        """The cheapest thresholds with the right sum, by row: dynamic programming over partitions and the sum of (threshold + 1) so far."""
        rows, parts, levels = costs.shape
        goal = self.total + parts
        best = np.full((rows, goal + 1), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((parts, rows, goal + 1), np.int64)
        for i in range(parts):
            ways = np.full((rows, goal + 1, levels), np.inf)
            for t in range(min(levels, goal + 1)):
                ways[:, t:, t] = best[:, : goal + 1 - t] + costs[:, i, t, None]
            chosen[i] = ways.argmin(2)
            best = ways.min(2)
        out, at = np.zeros((rows, parts), np.int64), np.full(rows, goal)
        for i in reversed(range(parts)):
            out[:, i] = chosen[i][np.arange(rows), at]
            at = at - out[:, i]
        return out - 1


def layout_of(nodes: DataFrame, n: int, differing: int) -> Layout:
    """The cheapest of a few numbers of partitions; all counts are over every node, the driver gets 4,096 of bits and at most 2,048 of values for each number."""
    both = np.zeros((BITS, BITS), np.int64)
    for r in nodes.mapInArrow(_together, base.schema(("i", "int"), ("j", "int"), ("n", "bigint"))).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    related = correlations(both, n)
    layouts = {m: grouped_bits(related, m) for m in range(max(1, differing), differing + 1 + MORE)}
    kinds = base.schema(("m", "int"), ("i", "int"), ("j", "int"), ("v", "int"), ("n", "bigint"))
    counts = {(m, i, j): np.zeros(1 << PART, np.int64) for m, parts in layouts.items() for i, part in enumerate(parts) for j in range(len(_pieces(part)))}
    for r in nodes.mapInArrow(_values(layouts), kinds).groupBy("m", "i", "j", "v").agg(F.sum("n").alias("n")).collect():
        counts[r["m"], r["i"], r["j"]][r["v"]] = r["n"]
    found = [Layout(parts, {(i, j): c for (k, i, j), c in counts.items() if k == m}, n, differing) for m, parts in layouts.items()]
    return min(found, key=Layout.mean_cost)


# Probing and verifying


def _keys(layout: Layout):
    """A fingerprint's key in each partition, where others find it, and those where it looks (`looks` 1)."""

    def run(batches):
        for batch in batches:
            fps = _fps(batch)
            for k in range(0, len(fps), _SLICE):
                some = fps[k : k + _SLICE]
                limits = layout.allocated(layout.costs(some))
                keys, owners, looks = [], [], []
                for i, bits in enumerate(layout.parts):
                    own, salt = some & np.uint64(mask_of(bits)), mixed(np.array([i + 1], np.uint64))
                    for d in range(layout.differing + 1):
                        far = limits[:, i] >= d
                        if d and not far.any():
                            break
                        for flips in combinations(bits, d):
                            at = np.arange(len(some)) if d == 0 else np.flatnonzero(far)
                            keys.append(mixed((own[at] ^ np.uint64(mask_of(list(flips)))) ^ salt))
                            owners.append(some[at])
                            looks.append(far[at])
                columns = [np.concatenate(x) for x in (keys, owners, looks)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), pa.array(columns[2].astype(np.int32))], names=["key", "fp", "looks"])

    return run


_EDGES = base.schema(("uid", "bigint"), ("to", "bigint"))


def _edges(pairs) -> pa.RecordBatch:
    """A spanning forest of the pairs of int64 arrays."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    columns = list(zip(*out)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "to"])


def _compared(differing: int):
    """Rows lie sorted by key, at most SMALL a key: each is compared with the ones after it."""

    def links(keys, fps):
        for k in range(1, min(SMALL, len(fps))):
            same = np.flatnonzero(keys[k:] == keys[:-k])
            if not len(same):
                break
            near = same[np.bitwise_count(fps[same] ^ fps[same + k]) <= differing]
            yield fps[near].view(np.int64), fps[near + k].view(np.int64)

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys, fps = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([fps, _fps(batch)])
            yield _edges(links(keys, fps))
            keys, fps = keys[1 - SMALL :], fps[1 - SMALL :]  # what the next batch may go on with

    return run


def points(fps: np.ndarray, differing: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, point): two fingerprints share a point exactly if they are within `differing` bits.

    Points are the values within half of it; of an odd number, such a value with one bit cleared and named.
    """
    around = [np.uint64(mask_of(list(flips))) for d in range(differing // 2 + 1) for flips in combinations(range(BITS), d)]
    at, out = np.tile(np.arange(len(fps)), len(around)), np.concatenate([fps ^ x for x in around])
    if differing % 2:
        out = np.concatenate([mixed(out & ~np.uint64(1 << b)) ^ mixed(np.array([b + 1], np.uint64)) for b in range(BITS)])
        at = np.tile(at, BITS)
    return at, out


def _points(differing: int):
    step = max(1, (1 << 20) // len(points(np.zeros(1, np.uint64), differing)[0]))

    def run(batches):
        for batch in batches:
            fps = _fps(batch)
            for k in range(0, len(fps), step):
                at, out = points(fps[k : k + step], differing)
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(fps[k + at].view(np.int64))], names=["point", "fp"])

    return run


def _stars(batches):
    """Rows lie sorted by point: each is linked with the first of its point."""
    last, centre = None, 0
    for batch in batches:
        where, fps = batch.column("point").to_numpy(), batch.column("fp").to_numpy()
        if not len(where):
            continue
        first = np.concatenate([[last is None or where[0] != last], where[1:] != where[:-1]])
        begins = np.flatnonzero(first)
        own = np.concatenate([np.array([centre], np.int64), fps[begins]])
        to = own[np.cumsum(first)]
        keep = fps != to
        last, centre = where[-1], to[-1]
        yield pa.RecordBatch.from_arrays([pa.array(fps[keep]), pa.array(to[keep])], names=["uid", "to"])


def linked(nodes: DataFrame, differing: int = DIFFERING) -> DataFrame:
    """Edges (uid, to) that connect all of the different fingerprints `fp` of nodes (a written table) that are linked by steps of at most `differing` bits, and no others."""
    layout = layout_of(nodes, nodes.count(), differing)
    keys, _ = base.written(nodes.mapInArrow(_keys(layout), base.schema(("key", "bigint"), ("fp", "bigint"), ("looks", "int"))), "simhash-keys")
    groups, _ = base.written(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("looks").alias("looks")).where("n > 1 and looks = 1").drop("looks"), "simhash-groups")
    met, _ = base.written(base.join_counted(keys.select("key", "fp"), groups, "key", "n"), "simhash-met")
    few = met.where(F.col("n") <= SMALL).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    many = met.where(F.col("n") > SMALL).select("fp").distinct()
    around = many.mapInArrow(_points(differing), base.schema(("point", "bigint"), ("fp", "bigint"))).repartition("point").sortWithinPartitions("point", "fp")
    return few.mapInArrow(_compared(differing), _EDGES).unionByName(around.mapInArrow(_stars, _EDGES))


def fingerprint_classes(docs: DataFrame, differing: int = DIFFERING) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Rows whose fingerprints differ in at most `differing` bits are linked; component_id is the
    smallest doc_id that links reach, null if all of them are null.  Null and empty texts and texts
    without a word have fingerprint 0 and are linked like any others; whole texts count, however long;
    repeated rows are rows of their own with equal values; an empty table gives no row.  Other columns
    are ignored, whatever their names.  Texts are read once and never shuffled.
    """
    if not 0 <= differing <= BITS // 8:
        raise ValueError("between 0 and 8 bits may differ")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text"))
    table, _ = base.written(rows.mapInArrow(_fingerprinted, base.schema(("doc_id", "bigint"), ("fp", "bigint"))), "simhash-rows")
    nodes, _ = base.written(table.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-nodes")
    edges, _ = base.written(linked(nodes.select("fp"), differing), "simhash-links")
    own = nodes.join(components(edges).withColumnRenamed("uid", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    own, _ = base.written(own, "simhash-roots")
    heads, _ = base.written(own.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-heads")
    named, _ = base.written(base.join_counted(own, heads, "root", "n").select("fp", "copies", "component_id"), "simhash-named")
    return base.join_counted(table, named, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
