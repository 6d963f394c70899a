"""Named collections in a folder of any store that Spark writes: immutable snapshots and a pointer file.

A collection is `<root>/<name>/v=<n>` in Parquet; its pointer is the highest complete version.  For tables
that change a few rows at a time there is `changelog.Collection`.
Aliases are a small table of their own, replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.migrate import check_alias
from .changelog import Conflict, created

_ALIASES = "alias string, collection string"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[2:]) for v in self._names(f"{self.root}/{name}") if v.startswith("v=") and "_SUCCESS" in self._names(f"{self.root}/{name}/{v}"))

    def exists(self, name: str) -> bool:
        return bool(self._versions(self.backing(name)))

    def create(self, name: str, schema: T.StructType | str, replace_if_different: bool = False) -> None:
        """Idempotent; replace_if_different drops a collection of another schema, and its rows."""
        empty = self.spark.createDataFrame([], schema)
        if not self.exists(name) or replace_if_different and self.read(name).schema != empty.schema:
            self.write(name, empty)

    def version(self, name: str) -> int:
        """The number of the snapshot that is read, 0 if there is none."""
        return (self._versions(self.backing(name)) or [0])[-1]

    def _claimed(self, target: str, expected: int | None) -> int:
        """A version that no other writer has; with `expected` the one after it, or a Conflict."""
        last = (self._versions(target) or [0])[-1]
        if expected is not None and expected != last:
            raise Conflict(f"version {last}, not {expected}")
        while not created(self.spark, f"{self.root}/{target}/_claims/{last + 1}", b""):
            if expected is not None:
                raise Conflict(f"version {last + 1} is taken")
            last += 1
        return last + 1

    def write(self, name: str, df: DataFrame, keep: int = 2, expected: int | None = None) -> int:
        """A new snapshot, and its version; older ones than the last `keep` go, so running readers are not cut off.

        Two writers never write one version; which of two whole snapshots is the last is then their
        order, unless they say which version they changed (`expected`): the later one gets a Conflict.
        A claim of a writer that died stays taken, so it is to be tried again without `expected`.
        """
        target = self.backing(check_alias(name))
        version = self._claimed(target, expected)
        df.write.parquet(f"{self.root}/{target}/v={version}")
        versions = [v for v in self._versions(target) if v < version]
        for old in versions[: -keep + 1 or None] if keep > 1 else versions:
            fs, p = self._fs(f"{self.root}/{target}/v={old}")
            fs.delete(p, True)
        return version

    def read(self, name: str) -> DataFrame:
        target = self.backing(name)
        versions = self._versions(target)
        if not versions:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{target}/v={versions[-1]}")

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{check_alias(name)}")
        fs.delete(p, True)

    def names(self) -> list[str]:
        return [n for n in self._names(self.root) if not n.startswith("_")]

    def collections(self) -> DataFrame:
        """(name, points) of every collection."""
        rows = [(n, self.read(n).count()) for n in self.names()]
        return self.spark.createDataFrame(rows, "name string, points bigint")

    def aliases(self) -> DataFrame:
        versions = self._versions("_aliases")
        return self.spark.read.schema(_ALIASES).parquet(f"{self.root}/_aliases/v={versions[-1]}") if versions else self.spark.createDataFrame([], _ALIASES)

    def point(self, alias: str, collection: str) -> None:
        """Swaps an alias: one new version of the alias table."""
        kept = self.aliases().where(F.col("alias") != check_alias(alias))
        one = self.spark.createDataFrame([(alias, collection)], _ALIASES)
        kept.unionByName(one).coalesce(1).write.parquet(f"{self.root}/_aliases/v={self._claimed('_aliases', None)}")

    def backing(self, name: str) -> str:
        found = self.aliases().where(F.col("alias") == name).select("collection").first() if self._versions("_aliases") else None
        return found[0] if found else name


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    df.write.json(path)


def config_get(spark: SparkSession, store: Store, default: dict) -> dict:
    row = store.read("system_config").first() if store.exists("system_config") else None
    return row.asDict() if row else default


def config_set(spark: SparkSession, store: Store, values: dict) -> None:
    store.write("system_config", spark.createDataFrame([values]))
