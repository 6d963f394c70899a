"""Media columns: payloads as 8-bit grey images (PNG) in archives (ZIP), and a data source that reads them by byte ranges.

The source plans partitions over the archives' byte ranges from the committed list of their sizes; each task reads
an archive's directory, takes the members whose offset is in its range, and fetches each one by
that offset.  A member that fails is tried again alone, from its offset; one that keeps failing
raises, so no row is lost.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import base

UNIT = 576
#: Bytes after which an archive is closed; bytes of an archive that one task reads; bytes of an Arrow batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 4 << 20
#: Tasks that read archives, at most: with more bytes each reads more.
MOST_RANGES = 100_000
#: Archives named in one file of the committed list.
LISTED = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(data: bytes, unit: int = UNIT) -> bytes:
    """data, then bytes 255 up to a positive multiple of unit."""
    return data + b"\xff" * (unit - len(data) if len(data) < unit else -len(data) % unit)


def _section(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, width: int = UNIT) -> bytes:
    """A lossless 8-bit grey image, width samples in a row, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    return _PNG + _section(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _section(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _section(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that png() wrote, as rows; checks its sections."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, shape, data = 8, None, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a section doesn't match its checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Average hash of an 8 by 8 reduction, mean and deviation of the samples, and the shares of four sample ranges."""
    height = len(rows)
    bands = np.array([rows[height * k // 8 : max(height * k // 8 + 1, height * (k + 1) // 8)].mean(0, dtype=np.float64) for k in range(8)])
    cells = bands.reshape(8, 8, -1).mean(2)
    bits = "".join("1" if x else "0" for x in (cells > cells.mean()).ravel())
    counts = np.bincount(rows.ravel() >> 6, minlength=4)
    return f"{int(bits, 2):016x}:{rows.mean(dtype=np.float64):.3f}:{rows.std(dtype=np.float64):.3f}:" + ",".join(str(int(1000 * c // rows.size)) for c in counts)


_WRITTEN = base.schema(("name", "string"), ("members", "bigint"), ("bytes", "bigint"))


def _archive(folder: str):
    def run(batches):
        files, part, made, number = base.Files(folder), TaskContext.get().partitionId(), 0, 0
        held = io.BytesIO()
        out = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)

        def flush():
            nonlocal held, out, made
            name, members = f"part-{part:06d}-{made:04d}.zip", len(out.filelist)
            out.close()
            files.put(name, held.getbuffer())
            size, made = held.tell(), made + 1
            held = io.BytesIO()
            out = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
            return pa.RecordBatch.from_pydict({"name": [name], "members": [members], "bytes": [size]})

        for batch in base.slabs(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                member = zipfile.ZipInfo(f"{number:010d}_{'' if doc_id is None else doc_id}.png")
                out.writestr(member, png(payload_of(text.encode("utf-8", "surrogatepass"))))
                number += 1
                if held.tell() >= ARCHIVE_BYTES:
                    yield flush()
        if out.filelist:
            yield flush()

    return run


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Writes every row's payload as a member of an archive, where its rows are read (no shuffle).

    Returns the archives' names, members and bytes: the committed list, in files of about LISTED
    names, so that who plans a read opens one file for that many archives, not one for each task
    that wrote.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), base.text_of(docs).alias("text"))
    written, path = base.written(rows.mapInArrow(_archive(folder), _WRITTEN), "archives-written")
    files = max(1, -(-written.count() // LISTED))
    written.repartitionByRange(files, "name").write.parquet(f"{folder}/_archives")
    base.remove_path(docs.sparkSession, path)
    return docs.sparkSession.read.schema(_WRITTEN).parquet(f"{folder}/_archives")


class ByteRange(InputPartition):
    """Ranges (archive, begin, end) that one task reads, one after another."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.step, self.tries = options["path"], int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("tries", 3))

    def archives(self) -> list[tuple[str, int]]:
        """Names and bytes: from the table that the writer committed, so a lost attempt's files don't count; else those in the folder."""
        own = base.Files(f"{self.folder}/_archives")
        tables = [name for name in own.names() if name.endswith(".parquet")]
        if not tables:
            files = base.Files(self.folder)
            return [(name, files.size(name)) for name in files.names() if name.endswith(".zip")]
        found = []
        for name in tables:
            with own.open(name) as file:
                table = pq.read_table(io.BytesIO(file.read()), columns=["name", "bytes"])
            found += zip(table["name"].to_pylist(), table["bytes"].to_pylist())
        return sorted(found)

    def partitions(self):
        """Each of about `step` bytes, or more if they would be over MOST_RANGES: parts of a large archive, or several small ones."""
        known = self.archives()
        step = max(self.step, -(-sum(size for _, size in known) // MOST_RANGES))
        out, held, room = [], [], step
        for name, size in known:
            at = 0
            while at < max(1, size):
                end = min(at + room, max(1, size))
                held.append((name, at, end))
                room -= end - at
                at = end
                if not room:
                    out.append(ByteRange(held))
                    held, room = [], step
        return [*out, ByteRange(held)] if held or not out else out

    def fetch(self, files, name: str, entry, opened: list) -> bytes:
        """One member by its offset, checked against the directory's size and checksum; after a failure the archive is opened anew."""
        for attempt in range(1, self.tries + 1):
            try:
                if not opened:
                    opened.append(files.open(name))
                file = opened[0]
                file.seek(entry.header_offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at this offset")
                file.seek(entry.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                data = file.read(entry.compress_size)
                if entry.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                if len(data) != entry.file_size or zlib.crc32(data) != entry.CRC:
                    raise ValueError("size or checksum differ from the directory")
                return data
            except (OSError, ValueError, zlib.error) as e:
                while opened:
                    opened.pop().close()
                if attempt == self.tries:
                    raise RuntimeError(f"{name}, member {entry.filename} at {entry.header_offset}: {e}") from e
                time.sleep(0.1 * attempt)
        raise AssertionError

    def read(self, partition):
        files = base.Files(self.folder)
        names, ids, images, held = [], [], [], 0
        for name, begin, end in partition.ranges:
            with files.open(name) as file:
                entries = [x for x in zipfile.ZipFile(file).infolist() if begin <= x.header_offset < end]
            opened: list = []
            for entry in entries:
                data = self.fetch(files, name, entry, opened)
                doc_id = entry.filename.rpartition("_")[2].removesuffix(".png")
                names.append(f"{name}/{entry.filename}")
                ids.append(int(doc_id) if doc_id.lstrip("-").isdigit() else None)
                images.append(data)
                held += len(data)
                if held >= BATCH_BYTES or len(names) >= 4096:
                    yield self.batch(names, ids, images)
                    names, ids, images, held = [], [], [], 0
            while opened:
                opened.pop().close()
        if names:
            yield self.batch(names, ids, images)

    @staticmethod
    def batch(names, ids, images):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["member", "doc_id", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("siftmill_archives").load(folder): member, doc_id, media."""

    @classmethod
    def name(cls):
        return "siftmill_archives"

    def schema(self):
        return "member string, doc_id bigint, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("siftmill_archives").load(folder)


_FEATURES = base.schema(("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"))


def _features(batches):
    for batch in batches:
        rows = []
        for doc_id, image in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
            pixels = samples(image)
            payload = pixels.tobytes()
            rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(pixels)))
        columns = list(zip(*rows)) or [()] * len(_FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for c, f in zip(columns, _FEATURES)], names=_FEATURES.names)


def media_features(docs: DataFrame) -> DataFrame:
    """Round trip of every text through an archive; one row per row of docs, from the bytes read back.

    A null or empty text is one row of 255s.  UTF-8 holds no byte 255, so the unpadded length is
    read from the payload itself.  Nothing of a member depends on its row but its name, so equal
    texts give equal values.  An empty table gives no archive and no row; other columns are ignored.
    """
    folder = base.scratch_path(docs.sparkSession, "archives")
    write_archives(docs, folder)
    return read_archives(docs.sparkSession, folder).select("doc_id", "media").mapInArrow(_features, _FEATURES)
