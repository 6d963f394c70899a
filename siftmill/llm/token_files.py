"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: frames, each a whole number of documents; a skippable frame with the document index
(doc_id, its place and count of ids); a skippable frame with the seek table of the public seekable
format (compressed size, size and XXH64 checksum of every frame).  A reader takes the tail, then
decompresses only the frames of the documents it was asked for.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import base
from .base import slabs
from .tokens import library, with_end

#: Ids after which a frame is closed, and compressed bytes after which a file is.
FRAME_IDS, FILE_BYTES = 1 << 16, 32 << 20
#: Bytes of text that a range of doc_id holds about, ranges at most, documents that a writer takes at once.
PART_BYTES, MOST_PARTS, STEP = 32 << 20, 50_000, 512
_NO_ID = -(1 << 63)
_SKIP_INDEX, _SKIP_SEEK, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ROW = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])


def narrowed(ids: np.ndarray, kind: np.dtype) -> np.ndarray:
    if ids.dtype.itemsize > kind.itemsize and len(ids) and int(ids.max()) > np.iinfo(kind).max:
        raise ValueError(f"id {ids.max()} does not fit in {kind.itemsize} bytes")
    return ids.astype(kind, copy=False)


class FileWriter:
    def __init__(self, width: int):
        self.kind, self.packer = np.dtype(f"<u{width}"), zstandard.ZstdCompressor(level=3)
        self.frames, self.seek, self.rows, self.open, self.held, self.bytes, self.ids, self.docs = [], [], [], [], 0, 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend(np.array([doc_id or 0]), np.array([doc_id is not None]), ids, np.array([len(ids)]))

    def extend(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents whose ids lie one after another; a frame ends with the document that fills it."""
        ends, done, begin = np.cumsum(counts), 0, 0
        while done < len(counts):
            room = max(FRAME_IDS - self.held, 1)
            stop = min(int(np.searchsorted(ends, begin + room)) + 1, len(counts))
            part = np.zeros(stop - done, _ROW)
            part["doc_id"], part["known"], part["frame"], part["n"] = doc_ids[done:stop], known[done:stop], len(self.frames), counts[done:stop]
            part["at"] = self.held + ends[done:stop] - counts[done:stop] - begin
            self.rows.append(part)
            self.open.append(ids[begin : int(ends[stop - 1])])
            self.held += int(ends[stop - 1]) - begin
            done, begin = stop, int(ends[stop - 1])
            if self.held >= FRAME_IDS:
                self.close_frame()
        self.ids += begin
        self.docs += len(counts)

    def close_frame(self) -> None:
        raw = b"".join(narrowed(x, self.kind).tobytes() for x in self.open)
        if raw:
            frame = self.packer.compress(raw)
            self.frames.append(frame)
            self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(frame)
        self.open, self.held = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        index = self.packer.compress(bytes([self.kind.itemsize]) + b"".join(x.tobytes() for x in self.rows))
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, _SEEK_END)
        return b"".join([*self.frames, struct.pack("<II", _SKIP_INDEX, len(index) + 4), index, struct.pack("<I", len(index)), struct.pack("<II", _SKIP_SEEK, len(table)), table])


class FileReader:
    """Random access to the documents of one file; keeps the frame it read last."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEK_END:
            raise ValueError("no seek table at the end of this file")
        begin = end - 9 - 12 * n - 8
        file.seek(begin)
        if struct.unpack("<II", file.read(8)) != (_SKIP_SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.seek = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        file.seek(begin - 4)
        (size,) = struct.unpack("<I", file.read(4))
        file.seek(begin - 4 - size)
        index = zstandard.ZstdDecompressor().decompress(file.read(size))
        self.kind, self.rows = np.dtype(f"<u{index[0]}"), np.frombuffer(index[1:], _ROW)
        self.last = (-1, None)

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.file.seek(int(self.starts[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.seek[k, 2]):
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.last = (k, np.frombuffer(raw, self.kind))
        return self.last[1]

    def __len__(self):
        return len(self.rows)

    def document(self, k: int) -> tuple[int | None, np.ndarray]:
        row = self.rows[k]
        ids = self.frame(int(row["frame"]))[int(row["at"]) : int(row["at"] + row["n"])] if row["n"] else np.zeros(0, self.kind)
        return (int(row["doc_id"]) if row["known"] else None), ids

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this doc_id."""
        return [self.document(int(k))[1] for k in np.flatnonzero((self.rows["doc_id"] == doc_id) & (self.rows["known"] == 1))]


def width_of(vocabulary: str, end_id: int) -> int:
    """Bytes of an id, 2 or 4, that hold every id of the vocabulary and the end id."""
    greatest = max(end_id, *library(vocabulary, True).tokenizer.get_vocab(True).values())
    return 2 if greatest < 1 << 16 else 4


def _encode(vocabulary: str, end_id: int, width: int, bounds: np.ndarray):
    """Rows (part, doc_id, ids): the ids with the end id as bytes, and the range of doc_id they belong to.

    Rows whose id is a bound several times over are dealt to all the ranges it bounds, so a doc_id
    (or its absence) of very many rows is spread; its rows may stand in any order.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches):
        encoder, row = library(vocabulary, True), 0
        for batch in slabs(batches):
            ids, ends = with_end(*encoder.encode(batch.column("text")), end_id)
            doc_ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            low, high = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
            part = low + (row + np.arange(len(doc_ids))) % (high - low + 1)
            row += len(doc_ids)
            offsets = pa.py_buffer((ends * width).astype(np.int64))
            data = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, offsets, pa.py_buffer(narrowed(ids, kind))])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("doc_id"), data.cast(pa.binary())], names=["part", "doc_id", "ids"])

    return run


def _write(folder: str, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        files, part, made = base.Files(folder), TaskContext.get().partitionId(), 0
        out = FileWriter(width)

        def flush():
            nonlocal out, made
            name = f"part-{part:06d}-{made:04d}.ids.zst"
            docs, ids, data = out.docs, out.ids, out.finish()
            files.put(name, data)
            out, made = FileWriter(width), made + 1
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [made - 1], "name": [name], "docs": [docs], "ids": [ids], "bytes": [len(data)]}, schema=MANIFEST_ARROW)

        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                rows = batch.slice(begin, STEP)
                doc_ids, ids = rows.column("doc_id"), rows.column("ids")
                ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
                data = np.frombuffer(ids.buffers()[2], kind, int(ends[-1]) // width)[int(ends[0]) // width :]
                out.extend(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), data, np.diff(ends) // width)
                if out.bytes >= FILE_BYTES:
                    yield flush()
        if out.docs:
            yield flush()

    return run


MANIFEST = base.schema(("part", "bigint"), ("seq", "bigint"), ("name", "string"), ("docs", "bigint"), ("ids", "bigint"), ("bytes", "bigint"))
MANIFEST_ARROW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def _bounds(docs: DataFrame, part_bytes: int) -> np.ndarray:
    """Bounds between ranges of doc_id (nulls lowest) of about equally many rows, as many ranges as the texts' bytes need."""
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length(base.text_of(docs))), F.lit(0)), F.count("*")).first()
    parts = max(1, min(max(-(-size // part_bytes), parallel), MOST_PARTS, rows))
    if parts == 1:
        return np.zeros(0, np.int64)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID))
    shares = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts))).first()[0]
    return np.array(found, np.int64)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, width: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encodes every text where it is read, appends end_id, writes files in ascending doc_id order (nulls first, equal ids in any order).

    Only ids move, `width` bytes each, to ranges of doc_id; a task writes whole files of bounded size
    under names that its range gives, so a task that runs again replaces its own files.  Returns the
    manifest (a row for each file), written to the folder's _manifest.  width: bytes of a stored id,
    by default what the vocabulary needs; an id that doesn't fit is an error.
    """
    bounds, width = _bounds(docs, part_bytes), width or width_of(vocabulary, end_id)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text"))
    coded = rows.mapInArrow(_encode(vocabulary, end_id, width, bounds), base.schema(("part", "int"), ("doc_id", "bigint"), ("ids", "binary")))
    own = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id").select("doc_id", "ids")
    own.mapInArrow(_write(folder, width), MANIFEST).write.parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _digests(folder: str):
    def run(batches):
        files = base.Files(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with files.open(name) as file:
                    reader, rows = FileReader(file), []
                    for k in range(len(reader)):
                        doc_id, ids = reader.document(k)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return run


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens and ids_crc32 of every document.  Sums over files only (bounded size each) give the starts."""
    before = F.coalesce(F.sum("ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("name", before.cast("long").alias("start"))
    return files.repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(_digests(folder), base.schema(("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")))


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, width: int | None = None) -> DataFrame:
    """Round trip: one row per row of docs with its place in the files, its count and checksum of ids.

    Null and empty texts have the end id alone.  An empty table writes no file and gives no row.
    Other columns are ignored.  width: as in write_token_files.
    """
    folder = base.scratch_path(docs.sparkSession, "token-files")
    return read_digests(write_token_files(docs, folder, vocabulary, end_id, width), folder)
