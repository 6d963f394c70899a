"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes says so; a chunk's identifier is a seeded
hash of its bytes.  Each distinct chunk of a partition moves once, to be compared byte by byte with
the others of its identifier (verified identifiers); after that, documents are compared by their
ordered identifier lists alone, so a long or often copied text never moves again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

SPACES = re.compile("[\x20\t-\r]{2,}|[\t-\r]")
SMALLEST, MASK, LARGEST = 1024, (1 << 11) - 1, 16384
#: Bytes of chunk bodies that a task keeps to tell repeated chunks apart; beyond it, it starts anew and a chunk may move twice.
KEPT_BYTES = 32 << 20
_SLAB = 1 << 20
_GEAR = np.random.default_rng(1009).integers(0, 1 << 32, 256, dtype=np.uint32)
_WINDOW_STEPS = 4
#: Parts that the copies of a hot chunk are compared in first.
WAYS = 64


def normalised(text: str | None) -> str:
    return SPACES.sub(" ", text or "")


def cut_candidates(data: bytes) -> np.ndarray:
    """Ends (exclusive) where the gear hash of the 16 bytes before is 0 in the masked bits; a doubling recurrence, no Python loop over bytes."""
    reach, out = (1 << _WINDOW_STEPS) - 1, []
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, len(raw), _SLAB):
        first = max(0, lo - reach)
        h = _GEAR[raw[first : lo + _SLAB]]
        for step in range(_WINDOW_STEPS):
            w = 1 << step
            if len(h) > w:
                shifted = h.copy()
                shifted[w:] += h[:-w] << np.uint32(w)
                h = shifted
        ends = np.flatnonzero((h >> np.uint32(8)) & np.uint32(MASK) == 0) + first + 1
        out.append(ends[(ends > lo) & (ends > reach)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(data: bytes) -> list[bytes]:
    """The data, cut; no chunk is over LARGEST, none but the last under SMALLEST.  Empty data has no chunk."""
    if len(data) <= SMALLEST:
        return [data] if data else []
    cuts, last = [0], 0
    for end in cut_candidates(data).tolist():
        while end - last > LARGEST:
            last += LARGEST
            cuts.append(last)
        if end - last >= SMALLEST:
            cuts.append(end)
            last = end
    while len(data) - last > LARGEST:
        last += LARGEST
        cuts.append(last)
    if last < len(data):
        cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def identifier(chunk: bytes, width: int, seed: int) -> bytes:
    out, k = b"", 0
    while len(out) < width:
        out += xxhash.xxh3_128_digest(chunk, seed=seed + k)
        k += 1
    return out[:width]


def _recipes(width: int, seed: int):
    def run(batches):
        seen, held = {}, 0
        for batch in base.slabs(batches):
            recipes, digests, fresh = [], [], []
            for text in batch.column("text").to_pylist():
                data = normalised(text).encode("utf-8", "surrogatepass")
                ids, new = [], []
                for chunk in chunks(data):
                    h = identifier(chunk, width, seed)
                    ids.append(h)
                    if seen.get(h) != chunk:
                        seen[h] = chunk
                        held += len(chunk)
                        new.append({"id": h, "body": chunk})
                        if held > KEPT_BYTES:
                            seen, held = {}, 0
                recipes.append(b"".join(ids))
                digests.append(hashlib.sha256(data).hexdigest())
                fresh.append(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("uid"), pa.array(recipes, pa.binary()), pa.array(digests, pa.string()), pa.array(fresh, pa.list_(pa.struct([("id", pa.binary()), ("body", pa.binary())])))],
                names=["row", "uid", "recipe", "text_sha256", "fresh"],
            )

    return run


def verified(table: DataFrame) -> bool:
    """Whether no identifier stands for two different chunks, byte by byte.

    A chunk comes once from each task that met it.  Those of hot identifiers (at most HOT_SHARE) are
    first compared in WAYS parts, by the task they come from, so that a passage that all documents
    share isn't gathered in one place: only the different bodies of a part go on.
    """
    fresh = table.where(F.size("fresh") > 0)
    ids = fresh.select(F.explode("fresh.id").alias("id"))
    counts, _ = base.written(ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > WAYS), "recipe-often")
    hot = counts.where(F.col("n") * base.HOT_SHARE > ids.count()).select("id", F.lit(1).alias("hot"))
    bodies = fresh.select(F.explode("fresh").alias("c"), "uid").select("c.id", "c.body", F.pmod(F.shiftrightunsigned("uid", 33), F.lit(WAYS)).alias("part"))
    bodies = bodies.join(F.broadcast(hot), "id", "left").withColumn("part", F.when(F.col("hot") == 1, F.col("part")).otherwise(F.lit(-1)))
    distinct = bodies.repartition("id", "part").groupBy("id", "part", "body").agg(F.lit(1).alias("one"))
    cold = distinct.where("part < 0").select("id")
    warm = distinct.where("part >= 0").select("id", "body").distinct().select("id")
    return cold.unionByName(warm).groupBy("id").count().where("count > 1").isEmpty()


def recipe_table(docs: DataFrame, columns: list[str] | None = None, width: int = 16) -> DataFrame:
    """Rows of docs (struct `row`, all columns or the named ones), with uid, recipe and text_sha256; identifiers are verified.

    If two different chunks share an identifier, everything is chunked again with another seed and
    identifiers 16 bytes longer; a fourth failure raises.
    """
    rows = docs.select(F.struct(*(docs[c] for c in columns or docs.columns)).alias("row"), base.text_of(docs).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    out = T.StructType([rows.schema["row"], T.StructField("uid", T.LongType()), *base.schema(("recipe", "binary"), ("text_sha256", "string"), ("fresh", "array<struct<id:binary,body:binary>>")).fields])
    for attempt in range(4):
        table, path = base.written(rows.mapInArrow(_recipes(width + 16 * attempt, 1000 * attempt), out), "recipes")
        if verified(table):
            return table.drop("fresh")
        base.remove_path(docs.sparkSession, path)
    raise RuntimeError("chunk identifiers collide at every width")


def grouped(table: DataFrame) -> DataFrame:
    """For each recipe: its first row (smallest doc_id, nulls last, then uid) and its count."""
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("uid").alias("uid"))).alias("first")
    return table.groupBy("recipe").agg(first, F.count("*").alias("group_size"))


def exact_duplicates(docs: DataFrame, width: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts are one group (an empty recipe).  Among rows of one
    text the smallest doc_id stays, nulls last; rows with the same doc_id and text leave one kept
    row.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    table = recipe_table(docs, ["doc_id"], width)
    groups, _ = base.written(grouped(table), "recipe-groups")
    return base.join_counted(table.select("row", "uid", "recipe", "text_sha256"), groups, "recipe", "group_size").select(
        F.col("row.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256"
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns.

    Nulls, empty and long texts, ties and repeated rows are as there.  Beside the distinct chunks,
    which move once to be verified, only recipes and the uids of the rows that go move, never a whole
    text, however many rows go.
    """
    table = recipe_table(docs)
    groups, _ = base.written(grouped(table).where("group_size > 1"), "recipe-groups")
    gone = base.join_counted(table.select("uid", "recipe"), groups, "recipe", "group_size").where(F.col("uid") != F.col("first.uid")).select("uid")
    gone, _ = base.written(gone, "recipe-gone")
    return base.at_places(table.select("uid", "row"), gone, inside=False).select("row.*")


ORACLE_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""
