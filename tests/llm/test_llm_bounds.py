"""Bounds that must hold whatever the rows: samples, blocks, hot chunks, rows without an id."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftmill.llm import base, dedup, media, sharding, similarity, toxicity


# 1
def test_the_sample_of_a_fit_is_bounded_in_rows(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts = [(k % 40, " ".join(rng.sample(words, 12)) + (" vile" if k % 40 < 10 else "")) for k in range(4000)]  # 100 different texts an id
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 10)) for k in range(40)], "doc_id long, toxic int")
    seen = {}
    trained = toxicity.NonNegativePU.trained

    def watching(self, kept, positive, unlabelled):
        seen["n"] = (len(positive), len(unlabelled))
        return trained(self, kept, positive, unlabelled)

    monkeypatch.setattr(toxicity.NonNegativePU, "trained", watching)
    model = toxicity.fitted(docs, labels, max_positive=50, max_unlabelled=90)
    assert seen["n"][0] <= 50 and seen["n"][1] <= 90 and model.weights


# 9
def test_functions_are_enough_for_every_recall():
    for similar, recall in ((0.8, 0.999), (0.5, 0.999), (0.5, 0.99999), (0.3, 0.9)):
        hashes = similarity.hashes_for(similar, recall)
        path = np.arange(similarity.WAYS, dtype=np.uint64)
        used = [set(similarity.position(r, k, path).tolist()) for r in range(similarity.runs_for(similarity.DEPTH, similar, recall)) for k in range(similarity.DEPTH)]
        assert sum(map(len, used)) == len(set().union(*used)) and max(set().union(*used)) < hashes
        assert len(similarity.functions(hashes)[0]) == hashes
        assert 0 < similarity.surely_below(similar, hashes) < similar
    assert similarity.hashes_for(0.8, 0.999) == similarity.HASHES


def test_recall_at_a_lower_similarity(spark):
    rng = random.Random(4)
    rows = []
    for g in range(60):
        own = [f"g{g}w{k}" for k in range(120)]
        for _ in range(4):
            at = rng.randrange(30)
            rows.append((len(rows), " ".join(own[at : at + 90])))  # windows over one sequence: similarities of 0.5 to 1
    want = {}
    sets = [set(similarity.Shingler()(t).tolist()) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
                want[i], want[j] = want.get(i, 0) + 1, want.get(j, 0) + 1
    got = {r["doc_id"]: r["n_links"] for r in similarity.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), similar=0.5).collect()}
    assert sum(want.values()) > 300 and {k: n for k, n in got.items() if n} == want


def test_shared_counts_by_lists_and_products():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for m, near in ((3, 0.05), (90, 0.02), (90, 1.0), (40, 0.4)):
        sets = [np.unique(np.where(rng.random(900) < near, rng.integers(0, 1 << 63, 900, dtype=np.uint64), centre)) for _ in range(m)]
        order = rng.permutation(m)
        for left, right in ((np.arange(m), np.arange(m)), (np.sort(order[: m // 2]), np.sort(order[m // 2 :]))):
            shares = similarity._Shared(sets, left, right)
            tables = {shares.table is not None}
            pairs = [(i, j) for i in left.tolist() for j in right.tolist() if i != j]
            want = [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
            assert [shares.of(i)[j] for i, j in pairs] == want
            shares.table = None
            assert [shares.of(i)[j] for i, j in pairs] == want
            assert tables == {True} or near == 1.0


def test_blocks_follow_the_lengths_of_texts(spark, monkeypatch):
    """1,024 texts of 20,000 shingles are 10 blocks at least; a pair of blocks is a few million shingles, not 20."""
    members = spark.range(1024).select(F.col("id").alias("uid"), F.lit(5).alias("leaf"), F.lit(1024).alias("n"), F.lit(1024 * 20_000).alias("weight"))
    pairs = similarity._in_blocks(members).groupBy("leaf", "low_block", "high_block").count().collect()
    assert max(r["low_block"] for r in pairs) >= 8
    assert max(r["count"] for r in pairs) * 20_000 < 4 * similarity.BLOCK_SHINGLES
    # the result doesn't depend on the blocks
    rng = random.Random(8)
    own = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(w if rng.random() > 0.01 else f"x{rng.randrange(10**6)}" for w in own)) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(tuple(r) for r in similarity.similarity_classes(df).collect())
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 2000)
    assert Counter(tuple(r) for r in similarity.similarity_classes(df).collect()) == whole


# 10
@pytest.mark.parametrize("share", [1, 20_000])
def test_hot_chunks_are_verified_in_parts(spark, monkeypatch, share):
    """A chunk that every task meets is hot; two bodies under one identifier are found, hot or not."""
    monkeypatch.setattr(base, "HOT_SHARE", share)
    monkeypatch.setattr(dedup, "WAYS", 4)
    kind = "uid long, fresh array<struct<id:binary,body:binary>>"
    same = [((p << 33) + 1, [{"id": b"a" * 16, "body": b"shared"}, {"id": bytes([p]) * 16, "body": bytes([p])}]) for p in range(40)]
    assert dedup.verified(spark.createDataFrame(same, kind))
    assert dedup.verified(spark.createDataFrame([], kind))
    assert not dedup.verified(spark.createDataFrame([*same, ((41 << 33) + 1, [{"id": b"a" * 16, "body": b"other"}])], kind))
    assert not dedup.verified(spark.createDataFrame([*same, ((41 << 33) + 1, [{"id": bytes([3]) * 16, "body": b"other"}])], kind))


# 3
def test_shards_hold_every_row(spark, hard, empty, tmp_path):
    rows = hard.withColumns({"slot": F.lit("own"), "shard": F.lit("own")})
    plan = sharding.write_shards(rows, f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    columns = [c for c in rows.columns if c != "shard"]
    assert Counter(map(str, back.select(*columns).collect())) == Counter(map(str, rows.select(*columns).collect()))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {r["shard"]: r["count"] for r in plan.groupBy("shard").count().collect()}
    assert sharding.write_shards(empty, f"file://{tmp_path}/none", 3).count() == 0


# 8
def test_the_list_of_archives_is_few_files(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string").repartition(12)
    listed = media.write_archives(docs, f"{tmp_path}/a")
    names = [n for n in base.Files(f"{tmp_path}/a/_archives").names() if n.endswith(".parquet")]
    assert listed.count() == 12 and len(names) == 1
    got = media.read_archives(spark, f"{tmp_path}/a")
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(range(60))
    assert pa.__version__
