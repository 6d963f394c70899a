"""Searches for tables of queries, and the inverted lists, against the search of one query."""

import numpy as np
import pytest

from siftmill import catalogue
from siftmill.operators import many, search
from siftmill.sources import fixtures as fx
from siftmill.sources.vectorindex import VectorIndex, centres


def vectors(spark, n, width=16, seed=1, kinds=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, width))
    rows = [(k, [float(x) for x in (middle[rng.integers(kinds)] + rng.normal(scale=0.3, size=width)).astype(np.float32)]) for k in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(40)] + [(n + 40, None)]  # ties, and a row without a vector
    return spark.createDataFrame(rows, "doc_id long, dense array<float>").repartition(5)


def hits(df):
    return [(r["doc_id"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("threshold", [None, 2.0])
def test_many_queries_equal_single_ones(spark, monkeypatch, threshold):
    monkeypatch.setattr(many, "FILE_BYTES", 700)
    df = vectors(spark, 600)
    own = df.where("doc_id in (3, 5, 77, 601, 640) or doc_id % 50 = 0").selectExpr("cast(doc_id as string) as query_id", "dense")
    got = many.dense_top(df, own, 7, threshold=threshold).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for r in own.where("dense is not null").collect():
        want = hits(search.dense_top(df, search.Vectors([float(x) for x in r["dense"]]), 7, threshold=threshold))
        assert by.get(r["query_id"], []) == want  # to the last bit, ties by id
    assert many.dense_top(df, own.limit(0), 7).count() == 0 and many.dense_top(df.limit(0), own, 7).count() == 0


def test_many_queries_need_no_join_of_pairs(spark):
    df = vectors(spark, 50)
    plan = many.dense_top(df, df.selectExpr("doc_id as query_id", "dense").limit(3), 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" not in plan


def test_many_hybrid_queries_equal_single_ones(spark, sf):
    t = fx.tokens(spark, sf)
    queries = t.where("doc_id < 4").selectExpr("doc_id as query_id", "dense", "late")
    got = {}
    for r in many.hybrid(t, queries, 5, prefetch=12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9)))
    for r in queries.collect():
        q = search.Vectors([float(x) for x in r["dense"]], [[float(x) for x in v] for v in r["late"]])
        assert got[r["query_id"]] == [(k, round(s, 9)) for k, s in hits(search.hybrid(t, q, 5, prefetch=12))]


@pytest.mark.parametrize("threshold, products", [(None, 1 << 21), (1.0, 50)])
def test_many_late_queries_equal_single_ones(spark, sf, monkeypatch, threshold, products):
    monkeypatch.setattr(many._BestLate, "PRODUCTS", products)
    t = fx.tokens(spark, sf)
    extra = t.where("doc_id = 3").selectExpr("doc_id + 1000 as doc_id", "dense", "late").union(t.where("doc_id = 5").selectExpr("doc_id + 2000", "dense", "slice(late, 1, 4)"))
    odd = spark.createDataFrame([(3000, [1.0], None), (3001, [1.0], [])], "doc_id long, dense array<float>, late array<array<float>>")
    t = t.union(extra).union(odd).repartition(3)
    queries = t.where("doc_id in (1, 3, 5, 3000, 3001)").selectExpr("doc_id as query_id", "if(doc_id = 1, slice(late, 1, 3), late) as late")
    got = {}
    for r in many.late_top(t, queries, 6, threshold=threshold).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    asked = queries.where("size(late) > 0").collect()
    assert set(got) == {r["query_id"] for r in asked} == {1, 3, 5}
    for r in asked:
        q = search.Vectors([], [[float(x) for x in v] for v in r["late"]])
        assert got[r["query_id"]] == hits(search.late_top(t.where("late is null or size(late) > 0"), q, 6, threshold=threshold))
    assert many.late_top(t, queries.limit(0), 3).count() == 0


def test_lists_find_what_an_exact_search_finds(spark, tmp_path):
    df = vectors(spark, 3000, width=24, kinds=30)
    index = VectorIndex(spark, f"file://{tmp_path}/ivf").build(df, lists=30, sample=1500)
    assert index.rows().count() == df.count() and index.rows().where("list = -1").count() == 1
    assert {r["list"] for r in index.rows().select("list").distinct().collect()} <= set(range(-1, 30))
    query = search.Vectors([float(x) for x in df.where("doc_id = 9").first()["dense"]])
    assert hits(index.top(query, 15, probes=None)) == hits(search.dense_top(df, query, 15))
    plan = index.top(query, 15, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    chosen = [int(x) for x in index.nearest(np.array([query.dense]), 2)[0]]
    assert index.rows().where(f"list in ({chosen[0]}, {chosen[1]})").count() < df.count() / 4  # folders that are read
    queries = df.where("doc_id % 60 = 0").selectExpr("doc_id as query_id", "dense")
    recall = [index.recall(queries, 10, p) for p in (1, 4, 30)]
    assert recall[0] <= recall[1] <= recall[2] == 1.0 and recall[1] >= 0.9
    curve = index.recalls(queries, 10)
    assert [curve[p - 1] for p in (1, 4, 30)] == pytest.approx(recall) and curve[index.probes_for(queries, 10) - 1] >= 0.9
    with pytest.raises(ValueError):
        VectorIndex(spark, f"file://{tmp_path}/none").build(df.where("dense is null"))


def test_recall_on_the_supplied_vectors(spark, sf):
    got = catalogue.queries()["vector_index_recall"](spark, sf).collect()
    assert [r["enough"] for r in got] == [True]


def test_centres_of_few_rows():
    assert len(centres(np.array([[1.0, 0], [2, 0], [0, 3]]), 8)) == 2
    x = np.random.default_rng(0).normal(size=(50, 4))
    assert np.allclose(np.linalg.norm(centres(x, 7), axis=1), 1)
