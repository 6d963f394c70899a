"""Tables written to the folder that all executors share, to be read again: results that several steps use, and cuts of a long lineage."""

from __future__ import annotations

import io
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  A local master, whose executors are this machine, may name none; a cluster must."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        path = f"file:///tmp/siftmill-scratch-{os.getuid()}"
    return path.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/siftmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written and read back; partitioned by a column if one is named."""
    target = path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(target)
    columns = [c for c in df.columns if c != by] + ([by] if by else [])
    return df.sparkSession.read.schema(df.select(columns).schema).parquet(target).select(df.columns)


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with the rows' numbers from 1 in order of keys, without a task that has all rows: ranges are sorted and written, then each adds the sizes of those before it."""
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    before = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")  # a row for each range
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(sizes), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Files:
    """Byte access for executors: plain folders (also file: URIs) directly, other stores by pyarrow."""

    def __init__(self, uri: str):
        self.uri, self.fs = uri.rstrip("/"), None
        if self.uri.startswith("file:"):
            self.uri = "/" + self.uri[5:].lstrip("/")
        elif "://" in self.uri:
            from pyarrow import fs

            self.fs, self.uri = fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, data) -> None:
        """Whole files only: written under a name of this attempt, then renamed, so a lost or second attempt leaves no half file."""
        target, attempt = f"{self.uri}/{name}", f"{self.uri}/.{name}-{uuid.uuid4().hex}"
        if self.fs is None:
            os.makedirs(self.uri, exist_ok=True)
            with open(attempt, "wb") as out:
                out.write(data)
            os.replace(attempt, target)
        else:
            self.fs.create_dir(self.uri, recursive=True)
            with self.fs.open_output_stream(attempt) as out:
                out.write(data)
            self.fs.move(attempt, target)

    def open(self, name: str):
        if self.fs is None:
            return open(f"{self.uri}/{name}", "rb")
        return io.BufferedReader(_Raw(self.fs.open_input_file(f"{self.uri}/{name}")))

    def size(self, name: str) -> int:
        return os.path.getsize(f"{self.uri}/{name}") if self.fs is None else self.fs.get_file_info(f"{self.uri}/{name}").size

    def names(self) -> list[str]:
        if self.fs is None:
            found = os.listdir(self.uri) if os.path.isdir(self.uri) else []
        else:
            from pyarrow import fs

            found = [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.uri, allow_not_found=True))]
        return sorted(x for x in found if not x.startswith("."))


class _Raw(io.RawIOBase):
    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        self.file.seek(at, whence)
        return self.file.tell()

    def tell(self):
        return self.file.tell()

    def readinto(self, into):
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)
