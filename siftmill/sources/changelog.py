"""Collections as a log of changes, with an index that tells which files can hold a value.

`<root>/<name>/log/<number>.json` is one commit each: a delta (rows put or dropped, by key) or a base
(all rows).  A commit's number is taken by creating its file, which fails if it exists, so of two
writers that saw the same state one gets a Conflict, or, for a delta, the number after.  An update
writes its own rows alone; a read merges the deltas since the last base, the latest of each key;
`compact` makes a base of them.

Beside each commit's files lies an index of the chosen columns: lowest and highest value and a Bloom
filter for each file.  A lookup reads the index, then only files that can match.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits for a row of the largest file, hash functions, and bytes of a filter at most (beyond it, filters let more files through).
BITS, HASHES, LARGEST = 10, 7, 4 << 20
#: Values of a lookup that go into the plan as literals; more are a table.
LITERALS = 1000


class Conflict(RuntimeError):
    """Another writer took the version."""


def created(spark: SparkSession, target: str, body: bytes) -> bool:
    """Creates a file with its content; False if it exists: of two writers one makes it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    if fs.getScheme() == "file":  # a link is made whole, or not at all
        own = path.toUri().getPath()
        attempt = f"{own}.{uuid.uuid4().hex}"
        with open(attempt, "wb") as out:
            out.write(body)
        try:
            os.link(attempt, own)
        except FileExistsError:
            return False
        finally:
            os.unlink(attempt)
        return True
    if fs.exists(path):
        return False
    try:
        stream = fs.create(path, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    stream.write(bytearray(body))
    stream.close()
    return True


class Collection:
    """A table with a key; `indexed` columns can be looked up without reading all files."""

    def __init__(self, spark: SparkSession, root: str, name: str, key: str = "doc_id", indexed: tuple[str, ...] = ()):
        self.spark, self.folder, self.key = spark, f"{root.rstrip('/')}/{name}", key
        self.indexed = tuple(dict.fromkeys((key, *indexed)))
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the log

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _text(self, file: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/log/{file}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _entries(self, upto: int | None = None) -> list[dict]:
        """Commits since the last base, in order."""
        out: list[dict] = []
        for file in reversed([n for n in self._names("log") if n.endswith(".json")]):
            number = int(file[:-5])
            if upto is not None and number > upto:
                continue
            text = self._text(file)
            if not text:  # created, not written yet: not a commit
                continue
            out.append({**json.loads(text), "number": number})
            if out[-1]["kind"] == "base":
                break
        return out[::-1]

    def version(self) -> int:
        """0 before the first commit."""
        entries = self._entries()
        return entries[-1]["number"] if entries else 0

    def _take(self, number: int, entry: dict) -> None:
        """Creates the commit's file, or raises Conflict if it exists."""
        if not created(self.spark, f"{self.folder}/log/{number:012d}.json", json.dumps(entry).encode()):
            raise Conflict(f"version {number} is taken")

    def _commit(self, entry: dict, expected: int | None) -> int:
        """expected: the version that the change was made from; None for changes that don't depend on it."""
        while True:
            entries = self._entries()
            last = entries[-1] if entries else {"number": 0, "done": {}}
            if expected is not None and last["number"] != expected:
                raise Conflict(f"version {last['number']}, not {expected}")
            done = {**last["done"], **entry.get("done", {})}
            try:
                self._take(last["number"] + 1, {**entry, "done": done})
                return last["number"] + 1
            except Conflict:
                if expected is not None:
                    raise

    # writing

    def _write(self, rows: DataFrame, kind: str, expected: int | None, done: dict) -> int:
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{data}")
        self._index(data)
        return self._commit({"kind": kind, "data": data, "schema": rows.schema.jsonValue(), "done": done}, expected)

    def put(self, rows: DataFrame, expected: int | None = None, done: tuple[str, int] | None = None) -> int:
        """Rows by key: new ones, and whole replacements of stored ones; the version.

        Of rows with one key in `rows` one is kept, any.  done: a job and the number of its step; a step
        that is committed isn't written again, so a job may repeat its last one.
        """
        return self._change(rows.dropDuplicates([self.key]).withColumn("_drop", F.lit(False)), expected, done)

    def drop(self, keys: DataFrame, expected: int | None = None, done: tuple[str, int] | None = None) -> int:
        """Removes rows by key."""
        return self._change(keys.select(self.key).distinct().withColumn("_drop", F.lit(True)), expected, done)

    def _change(self, rows: DataFrame, expected, done) -> int:
        if done and self.done(done[0]) >= done[1]:
            return self.version()
        return self._write(rows, "delta", expected, dict([done]) if done else {})

    def done(self, job: str) -> int:
        """The last committed step of a job, -1 before the first."""
        entries = self._entries()
        return entries[-1]["done"].get(job, -1) if entries else -1

    def replace(self, rows: DataFrame, expected: int | None = None) -> int:
        return self._write(rows.withColumn("_drop", F.lit(False)), "base", self.version() if expected is None else expected, {})

    def compact(self) -> int:
        """A base of what a read gives; a Conflict if a commit came between."""
        version = self.version()
        return self.replace(self.read(version), version)

    def vacuum(self) -> int:
        """Removes files and commits before the last base, and files of failed writes.  Not while others write, or read older versions.  How many folders went."""
        entries = self._entries()
        kept, first = {e["data"] for e in entries}, entries[0]["number"] if entries else 0
        gone = [d for d in self._names("data") if d not in kept]
        for d in gone:
            for part in ("data", "index"):
                self._fs.delete(self._path(f"{self.folder}/{part}/{d}"), True)
        for file in self._names("log"):
            if file.endswith(".json") and int(file[:-5]) < first:
                self._fs.delete(self._path(f"{self.folder}/log/{file}"), False)
        return len(gone)

    # reading

    def _schema(self, entries: list[dict]) -> T.StructType:
        """All columns of the commits, the last one's type of each."""
        fields: dict[str, T.StructField] = {}
        for e in entries:
            for f in T.StructType.fromJson(e["schema"]).fields:
                fields[f.name] = T.StructField(f.name, f.dataType, True)
        return T.StructType(list(fields.values()))

    def _rows(self, entries: list[dict], files: list[str] | None = None) -> DataFrame:
        """Rows of the commits, or of some of their files, with `_version`; one scan, whatever the number of commits."""
        paths = [f"{self.folder}/data/{e['data']}" for e in entries] if files is None else files
        if not paths:
            return self.spark.createDataFrame([], self._schema(entries)).withColumn("_version", F.lit(0))
        read = self.spark.read.schema(self._schema(entries)).option("recursiveFileLookup", "true").parquet(*paths)
        versions = F.create_map(*(F.lit(x) for e in entries for x in (e["data"], e["number"])))
        return read.withColumn("_version", F.try_element_at(versions, F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version.  The base isn't shuffled but for the keys that deltas changed, where these are too many to be broadcast."""
        entries = self._entries(version)
        if not entries:
            raise KeyError(self.folder)
        deltas = [e for e in entries if e["kind"] == "delta"]
        base = self._rows([e for e in entries if e["kind"] == "base"]) if len(deltas) < len(entries) else None
        if not deltas:
            return base.drop("_version", "_drop")
        changed = self._latest(self._rows(deltas))
        whole = changed if base is None else base.join(changed.select(self.key), self.key, "left_anti").unionByName(changed, allowMissingColumns=True)
        return whole.where("not _drop").drop("_version", "_drop")

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_version").alias("r"))
        return best.select(self.key, *(F.col(f"r.`{c}`").alias(c) for c in rest)).select(rows.columns)

    # the index

    def _index(self, data: str) -> None:
        rows = self.spark.read.parquet(f"{self.folder}/data/{data}")
        columns = [c for c in self.indexed if c.split(".")[0] in rows.columns]
        if not columns:
            return
        own = rows.select(F.col("_metadata.file_path").alias("file"), *(_values_of(rows, c).alias(f"c{k}") for k, c in enumerate(columns)))
        most = own.groupBy("file").count().agg(F.max("count")).first()[0] or 1
        size = 64
        while size < most * BITS and size < LARGEST * 8:
            size *= 2
        parts = own.mapInArrow(_filters(columns, size), _INDEX)
        parts.groupBy("file", "column").applyInArrow(_merged, _INDEX).write.parquet(f"{self.folder}/index/{data}")

    def files(self, column: str, values: DataFrame, version: int | None = None) -> tuple[list[str], int]:
        """The files that can hold one of the values (one column, `value`), and how many there are."""
        if column not in self.indexed:
            raise KeyError(column)
        entries = self._entries(version)
        paths = [f"{self.folder}/index/{e['data']}" for e in entries if e["data"] in set(self._names("index"))]
        if not paths:
            return [], 0
        index = self.spark.read.schema(_INDEX).option("recursiveFileLookup", "true").parquet(*paths).where(F.col("column") == column)
        wanted = [r["value"] for r in values.select(F.col("value").cast("string").alias("value")).distinct().limit(LITERALS + 1).collect() if r["value"] is not None]
        total = index.count()
        if not wanted:
            return [], total
        if len(wanted) > LITERALS:  # so many values meet most files: only their range is compared
            low, high = values.agg(F.min(F.col("value").cast("string")), F.max(F.col("value").cast("string"))).first()
            met = index.where((F.col("low") <= high) & (F.col("high") >= low))
        else:
            met = index.mapInArrow(_meeting(wanted), _INDEX)
        return sorted(r["file"] for r in met.select("file").collect()), total

    def lookup(self, column: str, values: DataFrame, version: int | None = None) -> DataFrame:
        """Rows whose indexed column has one of the values (one column, `value`); the same as a filter of `read`, from the files that can match.

        A row of an older commit counts if no later one has its key; for that the deltas' keys are read.
        """
        entries = self._entries(version)
        if not entries:
            raise KeyError(self.folder)
        files, _ = self.files(column, values, version)
        own = values.select(F.col("value").cast("string").alias("_value")).where("_value is not null").distinct()
        found = self._rows(entries, files)
        if files and found.select(column).schema[0].dataType.typeName() == "array":
            few = F.array(*(F.lit(r["_value"]) for r in own.limit(LITERALS + 1).collect()))
            if own.count() > LITERALS:
                raise ValueError(f"at most {LITERALS} values of a list's members")
            found = found.where(F.arrays_overlap(_values_of(found, column), few))
        elif files:
            found = found.join(own, F.col(column).cast("string") == own["_value"], "left_semi")
        return self._current(found, entries, files)

    def lookup_between(self, column: str, low, high, version: int | None = None) -> DataFrame:
        """Rows whose indexed column (strings or times) is from low to high; from the files whose range meets theirs."""
        if column not in self.indexed:
            raise KeyError(column)
        entries = self._entries(version)
        if not entries:
            raise KeyError(self.folder)
        least, most = (F.lit(x).cast(self._schema(entries)[column].dataType) for x in (low, high))
        paths = [f"{self.folder}/index/{e['data']}" for e in entries if e["data"] in set(self._names("index"))]
        index = self.spark.read.schema(_INDEX).option("recursiveFileLookup", "true").parquet(*paths).where(F.col("column") == column)
        files = sorted(r["file"] for r in index.where((F.col("low") <= most.cast("string")) & (F.col("high") >= least.cast("string"))).select("file").collect())
        return self._current(self._rows(entries, files).where(F.col(column).between(least, most)), entries, files)

    def _current(self, found: DataFrame, entries: list[dict], files: list[str]) -> DataFrame:
        """Of rows found in files those that no later commit replaced or dropped."""
        deltas = [e for e in entries if e["kind"] == "delta"]
        if deltas and files:
            last = self._rows(deltas).groupBy(self.key).agg(F.max("_version").alias("_last"))
            found = found.join(last, self.key, "left").where("_last is null or _last = _version").drop("_last")
        return found.where("not _drop").drop("_version", "_drop")


def _values_of(rows: DataFrame, column: str):
    """A column, or the members of a list (also a field of its structs), as an array of strings."""
    kind = rows.select(column).schema[0].dataType.typeName()
    return F.col(column).cast("array<string>") if kind == "array" else F.array(F.col(column).cast("string"))


_INDEX = T.StructType([T.StructField(n, t, True) for n, t in (("file", T.StringType()), ("column", T.StringType()), ("low", T.StringType()), ("high", T.StringType()), ("bits", T.BinaryType()))])


def _places(values: list[str], size: int) -> np.ndarray:
    """The bits of each value: HASHES a row."""
    h = np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def _row(file: str, column: str, low, high, bits: np.ndarray) -> dict:
    return {"file": file, "column": column, "low": low, "high": high, "bits": np.packbits(bits, bitorder="little").tobytes()}


def _least(values, pick) -> str | None:
    """By UTF-8 bytes, the order of strings in Spark."""
    return pick((v for v in values if v is not None), key=lambda v: v.encode("utf-8", "surrogatepass"), default=None)


def _filters(columns: list[str], size: int):
    """Of each file that a task meets: one filter a column."""

    def run(batches):
        last, held = None, {}

        def rows():
            return pa.RecordBatch.from_pylist([_row(last, c, *held[c]) for c in columns], schema=_ARROW)

        for batch in batches:
            files = batch.column("file")
            for file in pc.unique(files).to_pylist():
                if last is not None and file != last:
                    yield rows()
                    held = {}
                last, mine = file, batch.filter(pc.equal(files, file))
                for k, c in enumerate(columns):
                    values = [v for v in pc.unique(pc.list_flatten(mine.column(k + 1))).to_pylist() if v is not None]
                    low, high, bits = held.get(c) or (None, None, np.zeros(size, bool))
                    if values:
                        bits[_places(values, size).ravel()] = True
                    held[c] = (_least((low, *values), min), _least((high, *values), max), bits)
        if last is not None:
            yield rows()

    return run


_ARROW = pa.schema([("file", pa.string()), ("column", pa.string()), ("low", pa.string()), ("high", pa.string()), ("bits", pa.binary())])


def _merged(table: pa.Table) -> pa.Table:
    """The filters of a file that several tasks read, as one."""
    rows = table.to_pylist()
    bits = np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in rows])
    low, high = _least((r["low"] for r in rows), min), _least((r["high"] for r in rows), max)
    return pa.Table.from_pylist([{"file": rows[0]["file"], "column": rows[0]["column"], "low": low, "high": high, "bits": bits.tobytes()}], schema=_ARROW)


def _meeting(wanted: list[str]):
    coded = [(v, v.encode("utf-8", "surrogatepass")) for v in wanted]

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for low, high, data in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "bits"))):
                size = 8 * len(data)
                if size not in known:
                    known[size] = _places(wanted, size)
                raw = np.frombuffer(data, np.uint8)
                at = known[size]
                here = (raw[at >> 3] >> (at & 7) & 1).all(1)
                lo, hi = (low or "").encode("utf-8", "surrogatepass"), (high or "").encode("utf-8", "surrogatepass")
                keep.append(low is not None and any(x and lo <= b <= hi for x, (_, b) in zip(here.tolist(), coded)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
