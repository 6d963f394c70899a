"""Byte-level BPE in two tiers.

A word that the vocabulary holds whole is found by a minimal perfect hash: one slot for each entry,
checked by its bytes.  Other words are merged from linked bytes, the best pair taken from a heap.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import slabs
from .tokens import WordTable

_MULTIPLY, _LOW = 0x9E3779B1, 0xFFFFFFFF
#: Fixed value: the split pattern whose words tokens.words_of finds from the classes of bytes; any other one is left to the regex library.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PerfectHash:
    """Minimal: n keys, n slots.  Keys fall into buckets; each bucket has the first displacement that puts all its keys into free slots, and lone keys name their slot."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 4)
        self.moves = np.zeros(self.buckets, np.int64)
        self.slots: list[int] = [-1] * self.n
        self.keys = keys
        groups: dict[int, list[tuple[int, int]]] = {}
        for k, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault((h & _LOW) % self.buckets, []).append((h >> 32, k))
        taken, free = np.zeros(self.n, bool), None
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                slot = next(free)
                self.moves[bucket], self.slots[slot] = -1 - slot, members[0][1]
                continue
            highs = np.array([m[0] for m in members], np.uint64)
            move, step = 0, 256
            while True:
                moves = np.arange(move, move + step, dtype=np.uint64)
                at = self._mix(highs[None, :], moves[:, None])
                ok = ~taken[at].any(1)
                ok[ok] = [len(set(row)) == len(row) for row in at[ok].tolist()]
                if ok.any():
                    first = int(np.argmax(ok))
                    break
                move += step
            self.moves[bucket] = move + first
            for slot, (_, k) in zip(at[first].tolist(), members):
                taken[slot], self.slots[slot] = True, k
        self.moves = self.moves.tolist()

    def _mix(self, high, move):
        x = (high ^ (move * np.uint64(_MULTIPLY))) & np.uint64(_LOW)
        x = (x * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFFFFFF)
        return ((x ^ (x >> np.uint64(15))) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        move = self.moves[(h & _LOW) % self.buckets]
        if move < 0:
            slot = -1 - move
        else:
            x = ((((h >> 32) ^ (move * _MULTIPLY)) & _LOW) * 0x85EBCA6B) & 0xFFFFFFFFFFFF
            slot = (x ^ (x >> 15)) % self.n
        k = self.slots[slot]
        return k if k >= 0 and self.keys[k] == key else -1


class TwoTier(WordTable):
    """Ids by a rank file, without special tokens; pattern splits words."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as file:
            entries = [line.split() for line in file if line.strip()]
        keys = [base64.b64decode(k) for k, _ in entries]
        self.ranks = {k: int(r) for k, (_, r) in zip(keys, entries)}
        self.whole = PerfectHash(keys)
        self.numbers = [int(r) for _, r in entries]
        bytes_of = [b""] * (max(self.numbers, default=-1) + 1)
        for k, r in zip(keys, self.numbers):
            bytes_of[r] = k
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.known, self.find = pattern == KNOWN_PATTERN, regex.compile(pattern).findall

    def merge(self, word: bytes) -> list[int]:
        """Merges linked bytes; heap entries whose parts have changed meanwhile are passed over."""
        ranks, n = self.ranks, len(word)
        parts = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heap.sort()
        while heap:
            r, i, size = heappop(heap)
            a = parts[i]
            if a is None or (j := right[i]) >= n or len(a) + len(parts[j]) != size or ranks.get(a + parts[j]) != r:
                continue
            a = parts[i] = a + parts[j]
            parts[j] = None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(a + parts[k])) is not None:
                    heappush(heap, (r, i, len(a) + len(parts[k])))
            if (h := left[i]) >= 0 and (r := ranks.get(parts[h] + a)) is not None:
                heappush(heap, (r, h, len(parts[h]) + len(a)))
        return [ranks[p] for p in parts if p is not None]

    def whole_texts(self, texts):
        return super().whole_texts(texts) if self.known else np.arange(len(texts))

    def encode_words(self, words):
        found, get, numbers, merge = [], self.whole.get, self.numbers, self.merge
        for word in words:
            k = get(word)
            found.append((numbers[k],) if k >= 0 else merge(word))
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_whole(self, text):
        return self.encode_words([w.encode() for w in self.find(text)])[0]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The bytes of each text's ids."""
        chained = self.bytes_of.take(pa.array(ids))
        at = np.frombuffer(chained.buffers()[1], np.int32, len(ids) + 1)[ends].tolist() if len(ids) else [0] * len(ends)
        data = memoryview(chained.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(at, at[1:])]


_CODECS: dict = {}


def codec(path: str, pattern: str) -> TwoTier:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TwoTier(path, pattern)
    return _CODECS[path, pattern]


def _digest(path: str, pattern: str):
    def run(batches):
        tiers = codec(path, pattern)
        for batch in slabs(batches):
            ids, ends = tiers.encode(batch.column("text"))
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            hashes = [hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
            back = [hashlib.sha256(x).hexdigest() for x in tiers.decode(ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str, pattern: str):
    def run(batches):
        tiers = codec(path, pattern)
        for batch in slabs(batches):
            ids, ends = tiers.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], names=["row", "ids"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with a column `ids` (replacing one of that name); null and empty texts have an empty list.

    Rows are mapped one by one, whole texts however long: repeated rows and ties stay as they are, in
    any order, an empty table stays empty, and other columns pass whatever their names.
    """
    keep = [c for c in docs.columns if c != "ids"]
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), base.text_of(docs).alias("text"))
    out = base.schema(("ids", "array<int>"))
    out.fields.insert(0, rows.schema["row"])
    return rows.mapInArrow(_encode(path, pattern), type(out)(out.fields)).select("row.*", "ids")


def codec_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs, each text encoded and decoded again.

    Maps rows one by one: no shuffle, any order, ties and repeated rows as they come; null and empty
    texts have no id.  Other columns are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text"))
    return rows.mapInArrow(_digest(path, pattern), base.schema(("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")))
