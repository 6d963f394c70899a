"""Best-fit packing of token sequences by a grouping genetic algorithm.

A genome is a list of bins.  Crossover takes whole well-filled bins of one parent into the other,
removes the other's bins that hold their items again, and puts the displaced items back by best
fit, longest first; mutation empties poorly filled bins.  Items are dealt by hash into blocks of
bounded size; several islands evolve each block in tasks of their own, and between epochs each
island's best genome migrates to the next island.  Bins left with room are broken up once more and
packed across blocks.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import slabs
from .tokens import library, with_end

LIMIT = 2048
#: Items of a block (an island's whole problem), islands of a block, epochs between which elites migrate, population, children of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 16_000, 2, 2, 3, 12
#: How much likelier than half-full bins full ones are injected: the power of their filling.
KEEN = 8
#: A bin fuller than this share of the limit stays; the others are packed once more across blocks.
FULL = 0.995


class Bins:
    """Open bins by free room; the tightest one that fits is found in a bit mask."""

    def __init__(self, limit: int):
        self.limit, self.by_room, self.mask = limit, [[] for _ in range(limit + 1)], 0
        self.members: list[list[int]] = []

    def open(self, members: list[int], room: int) -> None:
        self.members.append(members)
        self.by_room[room].append(len(self.members) - 1)
        self.mask |= 1 << room

    def put(self, item: int, length: int) -> None:
        fit = self.mask >> length
        if not fit:
            return self.open([item], self.limit - length)
        room = length + (fit & -fit).bit_length() - 1
        own = self.by_room[room]
        b = own.pop()
        if not own:
            self.mask ^= 1 << room
        self.members[b].append(item)
        room -= length
        self.by_room[room].append(b)
        self.mask |= 1 << room


class Island:
    """Evolves the packing of lengths (each 1 to limit); genomes are lists of bins, a bin its load and its item numbers."""

    def __init__(self, lengths: list[int], limit: int, seed: int):
        self.lengths, self.limit, self.rng = lengths, limit, np.random.default_rng(seed)
        self.bound = least_bins(np.asarray(lengths, np.int64), limit)

    def fitness(self, genome: list[tuple[int, list[int]]]) -> tuple[int, int]:
        """Fewer bins first, then bins of more uneven filling, which leave better room."""
        return -len(genome), sum(load * load for load, _ in genome)

    def filled(self, kept: list[tuple[int, list[int]]], items: list[int]) -> list[tuple[int, list[int]]]:
        """Bins that stay as they are, with items put in by best fit, longest first."""
        lengths, limit = self.lengths, self.limit
        bins = Bins(limit)
        for load, members in kept:
            bins.open(members, limit - load)
        for i in sorted(items, key=lengths.__getitem__, reverse=True):
            bins.put(i, lengths[i])
        return [(limit - room, bins.members[b]) for room, own in enumerate(bins.by_room) for b in own]

    def first(self, noise: float) -> list[tuple[int, list[int]]]:
        """Best fit in decreasing order, or in an order blurred by noise."""
        order = np.argsort(-np.asarray(self.lengths) * (1 + noise * self.rng.random(len(self.lengths))), kind="stable").tolist()
        bins = Bins(self.limit)
        for i in order:
            bins.put(i, self.lengths[i])
        return [(self.limit - room, bins.members[b]) for room, own in enumerate(bins.by_room) for b in own]

    def cross(self, keeper: list, giver: list) -> list[tuple[int, list[int]]]:
        """Whole bins of the giver, those well filled likelier, into the keeper, whose bins with the same items are broken up."""
        load = np.array([x for x, _ in giver])
        weight = (load / self.limit) ** KEEN
        some = max(1, len(giver) * int(self.rng.integers(5, 60)) // 100)
        chance = self.rng.random(len(giver)) ** (1 / np.maximum(weight, 1e-9))
        given = [giver[b] for b in np.argpartition(-chance, some - 1)[:some].tolist()]
        inside = set(chain.from_iterable(members for _, members in given))
        kept, loose = [(x, list(members)) for x, members in given], []
        for x, members in keeper:
            if inside.isdisjoint(members):
                kept.append((x, list(members)))
            else:
                loose += [i for i in members if i not in inside]
        return self.filled(kept, loose)

    def mutated(self, genome: list) -> list[tuple[int, list[int]]]:
        """Breaks up the worst filled bins and some others."""
        load = np.array([x for x, _ in genome])
        chance = self.rng.random(len(genome)) * (1 + self.limit - load)
        out = set(np.argsort(-chance)[: max(2, len(genome) // 25)].tolist())
        kept = [(x, list(members)) for b, (x, members) in enumerate(genome) if b not in out]
        return self.filled(kept, [i for b in out for i in genome[b][1]])

    def run(self, genomes: list[list[list[int]]], children: int = CHILDREN) -> list[list[int]]:
        """The best genome (bins of item numbers) after so many children; ends when the lower bound is met."""
        known = [[(sum(map(self.lengths.__getitem__, b)), b) for b in g] for g in genomes]
        ranked = []
        while len(ranked) < POPULATION:
            one = known[len(ranked)] if len(ranked) < len(known) else self.first(0.0 if not ranked else 0.1 * len(ranked))
            ranked.append((self.fitness(one), one))
            if len(one) <= self.bound:  # nothing can be better
                return [b for _, b in one]
        ranked.sort(key=lambda x: x[0])
        for n in range(children):
            a, b = self.rng.choice(len(ranked), 2, replace=False)
            child = self.cross(ranked[max(a, b)][1], ranked[min(a, b)][1])
            if n % 2:
                child = self.mutated(child)
            fit = self.fitness(child)
            if fit > ranked[0][0]:
                ranked = sorted([*ranked[1:], (fit, child)], key=lambda x: x[0])
            if len(child) <= self.bound:
                break
        return [b for _, b in ranked[-1][1]]


def least_bins(lengths: np.ndarray, limit: int) -> int:
    """No packing has fewer bins: by the sum of lengths, and as at most k items longer than limit / (k + 1) share a bin."""
    counts = [-(-int((lengths * (k + 1) > limit).sum()) // k) for k in range(1, 12)]
    return max(-(-int(lengths.sum()) // limit), *counts)


def _as_bytes(genome: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for b, members in enumerate(genome):
        out[members] = b
    return out.tobytes()


def _as_genome(data: bytes) -> list[list[int]]:
    bins = np.frombuffer(data, np.int32)
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)] if len(bins) else []


def _evolve(limit: int, seed: int, epoch: int):
    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):  # one block's items in memory at a time
                own = batch.slice(k, 1)
                block, number = own.column("block")[0].as_py(), own.column("island")[0].as_py()
                lengths = own.column("lengths").flatten().to_pylist()
                elites = own.column("elites").flatten().to_pylist() if epoch else []
                genome = Island(lengths, limit, seed + 7919 * epoch + 104729 * number + block).run([_as_genome(x) for x in elites])
                rows.append((block, number, len(genome), _as_bytes(genome, len(lengths))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "island", "bins", "genome"])

    return run


_EVOLVED = base.schema(("block", "bigint"), ("island", "int"), ("bins", "int"), ("genome", "binary"))


def _round(items: DataFrame, n: int, limit: int, seed: int) -> DataFrame:
    """Packs items (uid, piece, length): uid, piece, length, block, bin.  Blocks are dealt by hash, so their size is bounded whatever the data."""
    blocks = max(1, -(-n // BLOCK))
    tasks = min(blocks * ISLANDS, 20_000)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("uid", "piece", F.lit(seed)), F.lit(blocks)))
    own = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "uid", "piece"))).alias("items"))
    own, _ = base.written(own, "pack-blocks")
    problems = own.select("block", F.col("items.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    elites = None
    for epoch in range(EPOCHS):
        start = problems
        if elites is not None:  # each island goes on from its own best and from that of its neighbour
            moved = elites.select("block", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"), "genome").groupBy("block", "island").agg(F.sort_array(F.collect_list("genome")).alias("elites"))
            start = problems.join(moved, ["block", "island"])
        elites, _ = base.written(start.repartition(tasks, "block", "island").mapInArrow(_evolve(limit, seed, epoch), _EVOLVED), "pack-elites")
    best = elites.groupBy("block").agg(F.min(F.struct("bins", "island", "genome")).alias("best")).select("block", "best.genome")
    return own.join(best, "block").mapInArrow(_spread, _PLACED)


_PLACED = base.schema(("uid", "bigint"), ("piece", "int"), ("length", "int"), ("block", "bigint"), ("bin", "int"), ("load", "int"), ("offset", "bigint"))


def _spread(batches):
    """Every item with its bin, the bin's load, and its place in it."""
    for batch in batches:
        for k in range(batch.num_rows):
            own = batch.slice(k, 1)
            items, bins = own.column("items").flatten(), np.frombuffer(own.column("genome")[0].as_py(), np.int32)
            length = items.field("length").to_numpy().astype(np.int64)
            load = np.bincount(bins, length).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(length[order]) - length[order]
            offset = np.zeros(len(items), np.int64)
            offset[order] = before - (np.cumsum(load) - load)[bins[order]]
            columns = (items.field("uid"), items.field("piece"), length, np.full(len(items), own.column("block")[0].as_py()), bins, load[bins], offset)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=_PLACED.names)


def packed(items: DataFrame, limit: int = LIMIT, seed: int = 11) -> DataFrame:
    """Packs items (uid, piece, length from 1 to limit; uid and piece name an item): uid, piece, sequence_id, offset.

    Items as long as the limit have a sequence each.  Sums of lengths in a sequence are at most the
    limit; offsets are gapless.  Equal lengths are interchangeable; any number of equal items is fine.
    """
    alone = items.where(F.col("length") == limit)
    rest = items.where(F.col("length") < limit).select("uid", "piece", "length")
    done = alone.select("uid", "piece", (F.monotonically_increasing_id() * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    number = F.col("block") * (1 << 24) + F.col("bin")
    for k in (1, 2):
        placed, _ = base.written(_round(rest, rest.count(), limit, seed + k), "pack-placed")
        kept = placed
        if k == 1:  # bins with room are few: broken up, and packed once more
            kept = placed.where(F.col("load") >= FULL * limit)
            rest = placed.where(F.col("load") < FULL * limit).select("uid", "piece", "length")
        done = done.unionByName(kept.select("uid", "piece", (number * 4 + k).alias("sequence_id"), "offset"))
    return done


def _pieces(vocabulary: str, end_id: int, limit: int):
    def run(batches):
        encoder = library(vocabulary, False)
        for batch in slabs(batches):
            ids, ends = with_end(*encoder.encode(batch.column("text")), end_id)
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            counts = np.diff(ends)
            pieces = -(-counts // limit)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
            first = counts - (pieces - 1) * limit  # the first piece may be shorter, the others are full
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * limit)
            length = np.where(piece == 0, first[owner], limit)
            begin = (4 * (ends[:-1][owner] + start)).tolist()
            sums = [zlib.crc32(view[a : a + 4 * n]) for a, n in zip(begin, length.tolist())]
            taken = [batch.column(c).take(pa.array(owner)) for c in ("doc_id", "uid")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return run


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """One row per piece of every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Documents over the limit are cut from their end into
    full pieces, the first is what remains.  Rows with the same or no doc_id are packed as rows of
    their own.  An empty table gives no row; other columns are ignored.  Ids are not moved: only
    lengths and checksums are.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    out = base.schema(("doc_id", "bigint"), ("uid", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"))
    pieces, _ = base.written(rows.mapInArrow(_pieces(vocabulary, end_id, limit), out), "pack-pieces")
    placed = packed(pieces.select("uid", "piece", "length"), limit)
    return pieces.join(placed, ["uid", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
