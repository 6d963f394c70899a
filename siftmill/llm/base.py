"""Shared pieces: scratch tables, global row positions and file access for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..scratch import Files
from ..scratch import root as scratch_root

#: Bytes of text that a Python worker takes at once.
SLAB_BYTES = 8 << 20


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/siftmill/{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES[-1:]:
        paths.append(path)
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators inside it wrote to the shared folder; their results are to be written elsewhere, or collected, before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Cuts lineage: writes df to the shared folder and reads it back.  Returns the table and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def slabs(batches: Iterable[pa.RecordBatch], size: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text (a longer text is a batch of its own); Spark's own limit is on rows."""
    held, bytes_held = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, total = 0, np.cumsum(lengths)
        while begin < batch.num_rows:
            before = int(total[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, before + size - bytes_held, "right")))
            held.append(batch.slice(begin, stop - begin))
            bytes_held += int(total[stop - 1]) - before
            begin = stop
            if bytes_held >= size or begin < batch.num_rows:
                yield _joined(held)
                held, bytes_held = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


#: A key is hot if it holds more than one in so many of the rows; there can't be more hot keys than this.
HOT_SHARE = 20_000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of a written table with a written table that has one row a key, whose column `size` says how many of `rows` have the key.

    Facts of hot keys are broadcast, at most HOT_SHARE of them whatever the tables' sizes, so their
    rows stay where they lie; the rows of all other keys are shuffled.
    """
    hot = F.col(size) * HOT_SHARE > rows.count()
    often = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(facts.where(~hot), key))


#: Ids that are broadcast at most (8 bytes each); of more, each partition's own go to a file that its rows meet where they are read.
BROADCAST_IDS = 2_000_000


def at_places(table: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of table whose uid is among ids (a written table of one column, uid), or those whose uid isn't.

    uid comes from monotonically_increasing_id, so it names the partition it was given in.  Rows of
    table are never shuffled, whatever the number of ids: a task needs the ids of the partitions that
    it reads, one partition's (8 bytes a row) at a time.
    """
    if ids.count() <= BROADCAST_IDS:
        return table.join(F.broadcast(ids), "uid", "left_semi" if inside else "left_anti")
    folder = scratch_path(table.sparkSession, "places")
    own = ids.select(F.shiftrightunsigned("uid", 33).alias("part"), "uid").repartition("part").sortWithinPartitions("part", "uid")
    own.mapInArrow(_put_places(folder), schema(("part", "bigint"), ("n", "bigint"))).write.parquet(f"{folder}/_parts")
    return table.mapInArrow(_meet_places(folder, inside), table.schema)


def _put_places(folder: str):
    def run(batches):
        files, last, held = Files(folder), None, []

        def flush():
            found = np.concatenate(held)
            files.put(f"{last}.uid", found.astype("<i8").tobytes())
            return pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int64()), "n": pa.array([len(found)], pa.int64())})

        for batch in batches:
            parts, uids = batch.column("part").to_numpy(), batch.column("uid").to_numpy()
            for cut in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1) if len(parts) else ():
                if held and parts[cut[0]] != last:
                    yield flush()
                    held = []
                last = int(parts[cut[0]])
                held.append(uids[cut])
        if held:
            yield flush()

    return run


def _meet_places(folder: str, inside: bool):
    def run(batches):
        files, last, found = Files(folder), None, None
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            mask = np.zeros(len(uids), bool)
            for part in np.unique(uids >> 33).tolist():
                if part != last:
                    try:
                        with files.open(f"{part}.uid") as file:
                            last, found = part, np.frombuffer(file.read(), "<i8")
                    except FileNotFoundError:  # none of this partition
                        last, found = part, np.zeros(0, np.int64)
                own = np.flatnonzero(uids >> 33 == part)
                mask[own] = np.isin(uids[own], found)
            yield batch.filter(pa.array(mask if inside else ~mask))

    return run


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ordered_table(df: DataFrame, keys: list, name: str) -> tuple[DataFrame, str]:
    """df sorted over all partitions by keys, written, with its partition and its place there.

    Partitions are cut by ranges of the keys, so the hottest leading key spreads over as many
    tasks as its rows need; no task sees a whole group.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return written(placed, name)


def with_positions(table: DataFrame, column: str) -> DataFrame:
    """Adds the gapless global position to an ordered_table; the window runs over one row a partition."""
    sizes = table.groupBy("_part").agg(F.count("*").alias("_rows"))
    starts = sizes.select("_part", (F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_start"))
    return table.join(starts, "_part").withColumn(column, F.coalesce("_start", F.lit(0)) + F.col("_local")).drop("_start", "_part", "_local")


_TYPES = {"string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType()}


def data_type(name: str) -> T.DataType:
    """A type by its SQL name, also without a session (executors import these modules)."""
    if name.startswith("array<"):
        return T.ArrayType(data_type(name[6:-1]))
    if name.startswith("struct<"):
        return schema(*(tuple(f.split(":")) for f in name[7:-1].split(",")))
    return _TYPES[name]


def schema(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, data_type(t), True) for n, t in fields])
