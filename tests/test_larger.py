"""Queries against their SQL on tables with what the supplied ones lack: several pages of one url, more candidates than a prefetch, prefetched rows in the wrong order."""

import os

import duckdb
import pytest
from test_oracle import TABLES, plain

from siftmill import catalogue


@pytest.fixture
def tables(tmp_path, sf):
    """A folder of the supplied tables, some of them replaced by SQL over the others, and a connection to it."""

    def make(**replaced: str):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        for t in TABLES:
            if t in replaced:
                con.sql(f"copy ({replaced[t]}) to '{tmp_path}/{t}.parquet' (format parquet)")
            else:
                os.symlink(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        for t in replaced:
            con.sql(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet'")
        return str(tmp_path), con

    return make


def both(spark, where, con, name, columns=None):
    got, want = catalogue.queries()[name](spark, where), con.sql(catalogue.oracle_sql()[name])
    columns = columns or sorted(got.columns)
    rows = lambda found: sorted(tuple(map(plain, r)) for r in found)
    return rows(got.select(*columns).collect()), rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_pages_of_one_url_are_reached_each_in_its_place(spark, tables):
    # page 8 is the first link of page 1 and page 31 the second one of page 2; 40 and 41 are their twins
    where, con = tables(pages="select p.page_id, coalesce(t.url, p.url) as url, p.html from pages p left join pages t on (p.page_id, t.page_id) in ((40, 8), (41, 31), (42, 0))")
    for name in ("graph_bfs", "graph_link_candidates", "supporting_documents", "kb_related"):
        got, want = both(spark, where, con, name)
        assert got == want, name
    # the SQL leaves the order of twins open
    got, want = both(spark, where, con, "graph_bfs_order", ["n", "hop", "via"])
    assert got == want
    rows = catalogue.queries()["graph_bfs_order"](spark, where).collect()
    assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1))
    place = {r["n"]: r["place"] for r in rows}
    assert place[40] == place[8] + 1 and place[41] == place[31] + 1


#: Documents of one source, as many as there are tokens' ids, so no scores are equal.
MANY = {
    "documents": "select n as doc_id, 'the text of ' || n as text, 'en' as lang, 'src3' as source, 20 as n_chars from range(1500) r(n)",
    "embeddings": "select n as vec_id, [sin(n * k * k * 0.7 + k + n * n * 0.013) for k in range(1, 9)]::float[] as embedding, 0::int as label from range(15000) r(n)",
}


def test_searches_rerank_the_candidates_of_their_sql(spark, tables):
    """More than the five hundred that a search takes by itself: the best by token vectors are often far down the dense list."""
    where, con = tables(**MANY)
    for name in ("search_kb_scoped", "search_kb_full", "search_all"):
        got, want = both(spark, where, con, name)
        assert want and got == want, name


def test_documents_meet_their_token_vectors_by_equality(spark, sf):
    """By a product of both tables the search's time grew with its square."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue._whole(spark, sf)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "CartesianProduct" not in plan and "SortMergeJoin" in plan


def test_detector_of_many_texts_gives_what_each_alone_has(spark, sf):
    from siftmill.functions import language

    t = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    known = language.profiles(t.where("doc_id % 2 = 0"))
    texts = [r["text"] or "" for r in t.select("text").collect()] + ["", "12 !?", "a", "b a", "É é ß İ \U00010400", "the " * 2000]
    for some in (known, {"en": known["en"]}, {"en": {}}, {"en": {}, "fr": {}}, {}):
        detect = language._Detector(some)
        assert [detect(x) for x in texts] == [language.detected(x, some) for x in texts]


def test_rows_are_numbered_without_one_task_for_all(spark):
    from pyspark.sql import functions as F

    from siftmill import scratch

    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("a"))
        got = scratch.numbered(rows, "pos", "a", "k")
        assert got.where("pos <> k + 1").count() == 0 and got.select("pos").distinct().count() == 1000
        assert scratch.numbered(rows.limit(0), "pos", "k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
