"""Facts about the query language, predicates, graph, pairs, FAQs and stores that the catalogue's queries don't show."""

import uuid

import pytest
from pyspark.sql import functions as F

from siftmill import catalogue
from siftmill.functions import ids, text, urls, vectors
from siftmill.operators import agent, faqs, feedback, graph, ingest, migrate, queues, retention, search
from siftmill.plans import predicates
from siftmill.plans.querylang import candidate_limit, parse, scan_batch
from siftmill.sources import fixtures as fx
from siftmill.sources.embedding import TooLong, embedded, in_batches
from siftmill.sources.changelog import Conflict
from siftmill.sources.store import Store, write_jsonl

DOC = "doc_id string, url string, content string, title string, domain string, hyperlinks array<string>, indexed_at timestamp"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def docs(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], DOC)


def test_clauses_and_free_terms():
    q = parse('vector db site:docs.example.com inurl:"api" filetype:.PDF before:2025-01-01 -intext:"draft" “a b” -old +new ~x (y) c|d & numrange:1-5')
    assert q.any_of == {"site": ("docs.example.com",), "url": ("api",), "filetype": ("pdf",)}
    assert q.none_of == {"content": ("draft",)} and str(q.before) == "2025-01-01 00:00:00+00:00"
    assert q.free == ("1-5", "vector", "db", "a b", "new", "x", "y", "c", "d") and q.unwanted == ("old",)
    assert q.has_text and q.has_filters and q.semantic_text.startswith("1-5 vector db")
    only_site = parse("site:example.com")
    assert only_site.semantic_text == "" and not only_site.has_text and only_site.has_filters
    assert parse("allintext:(a b) ALLINTITLE:c|d").all_of == {"content": ("a", "b"), "title": ("c", "d")}
    assert parse("it's Unbalanced \"x").free == ("it's", "Unbalanced", '"x')
    assert parse("after:never after:2024-01-01").after.year == 2024 and parse(None).free == ()
    assert parse("A a A").free == ("A",)


def test_limits():
    assert [candidate_limit(x) for x in (1, 5, 10, 50)] == [21, 25, 50, 200] and [scan_batch(x) for x in (1, 50, 100)] == [25, 150, 200]


def test_null_fields_count_as_empty(spark):
    d = docs(spark, ("1", "https://Sub.Example.com/a.pdf", "Some draft"), ("2",), ("3", "https://www.example.com/x", "text", "T"))
    keep = lambda q: [r["doc_id"] for r in d.where(predicates.document_predicate(parse(q))).orderBy("doc_id").collect()]
    assert keep("-intext:draft") == ["2", "3"] and keep("-site:example.com") == ["1", "2"] and keep("site:example.com") == ["3"]
    assert keep("site:*.example.com") == ["1"] and keep("-filetype:pdf") == ["2", "3"] and keep("before:2030-01-01") == [] and keep("intext:(a.c|text)") == ["3"]


def test_ids_equal_the_standard(spark):
    for u in ("https://example.com/é", "", "x"):
        assert value(spark, ids.document_id(F.lit(u))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, u))
    a = value(spark, ids.faq_id(F.lit(" What  is\nit "), F.lit("That")))
    assert a == str(uuid.uuid5(uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890"), "What is it|That"))
    assert value(spark, ids.question_hash(F.lit(" A b "))) == value(spark, ids.question_hash(F.lit("a B")))


def test_url_forms(spark):
    assert value(spark, urls.variants(F.lit("HTTP://Ex.com/a/#f"))) == ["HTTP://Ex.com/a/#f", "http://ex.com/a/", "HTTP://Ex.com/a/", "HTTP://Ex.com/a"]
    assert value(spark, urls.variants(F.lit("http://ex.com/a"))) == ["http://ex.com/a", "http://ex.com/a/"]
    assert value(spark, urls.variants(F.lit(None).cast("string"))) == []
    assert urls.domains(["https://WWW.a.com:80/x", ".b.org.", "a.com", ""]) == ["a.com", "b.org"]
    assert value(spark, urls.host(F.lit("https://u:p@Ex.com:8080/x y"))) == "ex.com"
    assert [value(spark, urls.filetype(F.lit(u))) for u in ("http://a.b/c.d/e", "http://a.b/x.tar.GZ?q=1.pdf", "http://a.b")] == ["", "gz", ""]
    assert value(spark, urls.link_ids(F.array(F.lit("http://x/#a"), F.lit("http://x/"), F.lit(" ")))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "http://x/"))]
    assert urls.glob_regex("a[!b]*?.c") == r"^a[^b].*.\.c$"


def test_text_forms(spark):
    assert value(spark, text.heading(F.lit("x\n ## *A* [b](c) `d`\n# e"))) == "A b d" and value(spark, text.heading(F.lit("x"))) is None
    assert value(spark, text.embedded_part(F.lit("abc  \n"))) == "abc" and value(spark, text.embedded_part(F.lit(" \n"))) == " \n" and value(spark, text.embedded_part(F.lit("ab c d"), 3)) == "ab"
    assert [r[0] for r in spark.createDataFrame([(None,), (-1.0,), (0.5,), (20.0,), (50.0,)], "t double").select(vectors.normalised_thresholds(F.col("t"), False)).collect()] == [vectors.normalised_threshold(t, False) for t in (None, -1.0, 0.5, 20.0, 50.0)]
    assert value(spark, text.word_count(F.lit("é日本 a_b c-d"))) == 4 and value(spark, text.word_count(F.lit(None).cast("string"))) == 0
    assert value(spark, text.best_chain(F.lit("x b c y a b"), ["a", "b", "c"])) == ("a b", 1)
    assert value(spark, text.highlighted(F.lit("The there"), ["the", "there"])) == "<mark>The</mark> <mark>there</mark>"
    assert value(spark, text.token_vectors(F.array(*map(F.lit, range(7))), 3)) == [[0, 1, 2], [3, 4, 5]] and value(spark, text.token_vectors(F.array(F.lit(1)), 3)) == []
    assert tuple(value(spark, text.generated_faq(F.lit("First line\nthe rest")))) == ("First line", "the rest")


def test_contrast_of_equal_scores_is_identity(spark):
    d = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, score double")
    assert {r["score"] for r in vectors.contrasted(d).collect()} == {0.5}
    assert vectors.contrasted(d.limit(0)).count() == 0
    three = vectors.contrasted(spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0)], "id int, score double"), 2).orderBy("id").collect()
    assert [r["score"] for r in three] == [0.0, 0.25, 1.0]


def test_dense_only_search_ignores_extra_candidates(spark):
    d = spark.createDataFrame([(k, [float(k), 0.0], [[float(k), 0.0]]) for k in range(5)], "doc_id long, dense array<float>, late array<array<float>>")
    found = search.hybrid(d, search.Vectors([1.0, 0.0]), 2, extra=[d], threshold=3.5)
    assert [r["doc_id"] for r in found.collect()] == [4]
    assert [r["doc_id"] for r in search.hybrid(d, search.Vectors([1.0, 0.0], [[-1.0, 0.0]]), 1, prefetch=2, extra=[d.where("doc_id = 0")]).collect()] == [0]


def _graph(spark):
    did = lambda u: str(uuid.uuid5(uuid.NAMESPACE_DNS, u))
    links = {"http://a": ["http://b#section", "http://missing", "http://c"], "http://b": ["http://d"], "http://c": ["http://a", "http://d"], "http://d": []}
    return did, spark.createDataFrame([(did(u), u, u, None, None, x, None) for u, x in links.items()], DOC)


def test_graph_walk(spark):
    did, d = _graph(spark)
    seeds = spark.createDataFrame([(did("http://a"), 0)], "doc_id string, pos long")
    walk = lambda **k: [(r["doc_id"], r["hop"], r["via"]) for r in graph.related(d, seeds, **k).collect()]
    a, b, c, x = map(did, ("http://a", "http://b", "http://c", "http://d"))
    assert walk(max_hops=2, max_documents=10) == [(b, 1, a), (c, 1, a), (x, 2, b)]
    assert walk(max_hops=2, max_documents=2) == [(b, 1, a), (c, 1, a)] and walk(max_hops=1, max_documents=0) == []
    assert walk(max_hops=2, max_documents=9, allowed=d.where(F.col("url") != "http://b")) == [(c, 1, a), (x, 2, c)]
    assert walk(max_hops=1, max_documents=9, excluded=spark.createDataFrame([(b,)], "doc_id string"), with_seeds=True) == [(a, 0, None), (c, 1, a)]
    f = spark.createDataFrame([(0, [(None, "http://b#x"), ("id1", None)]), (1, [("id1", None)])], "pos long, source_documents array<struct<document_id:string,url:string>>")
    assert [r["doc_id"] for r in graph.faq_seeds(f).orderBy("pos").collect()] == [b, "id1"]


FEEDBACK = "id long, query string, text string, search_score double, user_rating int, ranking_score int, rating_session_id string, content_type string"


def test_pairs_of_neighbouring_stars(spark):
    rows = [(k, "q", f"t{s}", 0.1, 0, s, "s", None) for k, s in enumerate((5, 3, 2, 1))] + [(9, "q", "other", 0.1, 0, 4, None, None)]
    got = {(r["positive"], r["negative"], r["score_gap"]) for r in feedback.ranked_pairs(spark.createDataFrame(rows, FEEDBACK)).collect()}
    assert got == {("t5", "t3", 2), ("t3", "t2", 1), ("t2", "t1", 1)}
    rows = [(1, "q", "good", 0.9, 1, None, None, None), (2, "q", "bad", 0.2, -1, None, "", None), (3, "q", "star", 0.2, -1, 1, "", None)]
    df = spark.createDataFrame(rows, FEEDBACK)
    assert [(r["positive"], r["negative"], r["bucket"]) for r in feedback.pairs(df).collect()] == [("good", "bad", "legacy")]
    assert feedback.summary(df).first()["pairs"] == 1 and feedback.summary(df.limit(0)).first()["total"] == 0
    bad = spark.createDataFrame([(1, " ", "x", 0.1, 1, None, None, None), (2, "q", "x", 0.1, 7, None, None, None), (3, "q", "x", 0.1, 1, 6, None, None), (4, "q", "x", 0.1, 1, 5, None, "page"), (5, "q", "x", 0.1, 1, 5, None, None)], FEEDBACK)
    assert [r["p"] for r in bad.orderBy("id").select(feedback.problems(bad).alias("p")).collect()] == ["query", "user_rating", "ranking_score", "content_type", None]


FAQ = f"faq_id string, question string, answer string, document_id string, first_seen string, source_documents {faqs.SOURCE}"


def test_faq_sources(spark):
    one = lambda d, c=0.5: (d, f"https://x/{d}", "t", c)
    f = spark.createDataFrame([("f1", "q", "a", "d1", None, [one("d1")]), ("f2", "q", "a", None, None, [one("d1"), one("d2", None)]), ("f3", "q", "a", "d9", None, [])], FAQ)
    act = lambda df: {r["faq_id"]: (r["action"], r["source_count"]) for r in df.collect()}
    assert act(faqs.source_removed(f, "f1", "d1"))["f1"] == ("deleted", 0) and act(faqs.source_removed(f, "f1", "d1", False))["f1"] == ("removed", 0)
    assert act(faqs.source_removed(f, "f3", "d1"))["f3"] == ("source_not_found", 0) and act(faqs.source_removed(f, "f3", "d1", delete_first=True))["f3"] == ("deleted", 0)
    source = F.struct(F.lit("d2").alias("document_id"), F.lit("u").alias("url"), F.lit("t").alias("extracted_at"), F.lit(1.0).alias("confidence"))
    assert act(faqs.source_added(f, "f1", source))["f1"] == ("added", 2) and act(faqs.source_added(f, "f2", source))["f2"] == ("already_exists", 2)
    assert {r["faq_id"]: (r["source_count"], r["aggregated_confidence"]) for r in faqs.response(f).collect()} == {"f1": (1, 0.5), "f2": (2, 1.0), "f3": (1, 1.0)}
    assert faqs.source_statistics(f.limit(0)).first()["avg_sources"] == 0.0
    fates = {r["faq_id"]: r["fate"] for r in retention.faq_fates(f, spark.createDataFrame([("d2", None)], "doc_id string, indexed_at timestamp"), F.timestamp_seconds(F.lit(0))).collect()}
    assert fates == {"f1": "stale", "f2": "stale", "f3": "orphan"}
    assert tuple(retention.faq_report(spark.createDataFrame(list(fates.items()), "faq_id string, fate string")).first()) == (3, 1, 2, 3)


def test_an_answer_that_changes_is_reassigned(spark):
    old = faqs.identified(spark.createDataFrame([("d", "Q one", "old"), ("d", "Q two", "same"), ("d", "Q three", "x")], "document_id string, question string, answer string"))
    new = spark.createDataFrame([("d", 0, "Q one", "new", 2.0), ("d", 1, "q TWO ", "no", 0.3), ("d", 2, "Q two", "same", 0.3), ("d", 3, "Q four", "y", None), ("d", 4, " ", "z", 1.0)], "document_id string, pos int, question string, answer string, confidence double")
    assert sorted(r["action"] for r in faqs.sync_plan(new, old).collect()) == ["created", "reassigned", "refreshed", "stale"]


def test_sync_plan_covers_every_conversation(spark, sf):
    questions = {(r["document_id"], r["question_hash"]) for r in fx.faq_rows(spark, sf).select("document_id", "question_hash").collect()}
    got = catalogue.queries()["faq_sync_actions_all"](spark, sf).collect()
    assert len(got) == len(questions) and {(r["document_id"], r["question_hash"]) for r in got} == questions
    assert {"stale", "refreshed", "reassigned"} <= {r["action"] for r in got}


def test_upsert_returns_every_faq(spark, sf):
    every = {r["faq_id"] for r in fx.faqs(spark, sf).select("faq_id").collect()}
    got = catalogue.queries()["faq_upsert_all"](spark, sf).collect()
    assert len(got) == len(every) and {r["faq_id"] for r in got} == every
    assert {r["action"] for r in got} == {"created", "merged", "refreshed", "kept"}


def test_highlight_covers_the_whole_text(spark, sf):
    rows = catalogue.queries()["highlight_all"](spark, sf).join(fx.table(spark, sf, "documents"), "doc_id").collect()
    late = [r for r in rows if "the" in r["text"][200:].lower()]
    assert late and all(r["marked"].replace("<mark>", "").replace("</mark>", "") == r["text"] for r in rows)
    assert all(r["marked"].count("<mark>") == r["text"].lower().count("the") for r in rows)


def test_ingest_of_hard_rows(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [("u1", long, 1), ("u2", f" {long.upper()}\n", 2), ("u1", long, 3), ("u3", None, 4), ("u4", "few words", 5), ("u5", "few words", 6)]
    df = spark.createDataFrame(rows, "url string, content string, arrival int")
    st = ingest.with_status(df, F.timestamp_seconds(F.lit(0)))
    assert [(r["status"], r["duplicate_of"]) for r in st.orderBy("arrival").collect()] == [("stored", None), ("duplicate_content", "u1"), ("stored", None), ("empty", None), ("content_too_short", None), ("content_too_short", None)]
    assert [(r["arrival"], r["content"]) for r in ingest.kept(df, st).collect()] == [(3, long)]


def test_unchanged_documents_alternate(spark):
    gate = lambda status: spark.createDataFrame([("c", "h", ("r0", "h", status))], "content string, content_hash string, marker struct<last_run_id:string,content_hash:string,status:string>").select(agent.needs_processing(F.lit("r1"), F.lit(False))).first()[0]
    assert gate("processed") == "skip_unchanged" and gate("skipped_unchanged_since_last_run") == "process"


def test_store_and_aliases(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("a", "id int")
    store.create("a", "id int")
    assert store.exists("a") and store.read("a").count() == 0
    store.write("a", spark.range(3).selectExpr("cast(id as int) as id"))
    store.write("a_migration", spark.range(5).selectExpr("cast(id as int) as id"))
    store.point("live", "a")
    assert store.read("live").count() == 3
    store.point("live", "a_migration")
    assert store.read("live").count() == 5 and {tuple(r) for r in store.collections().collect()} == {("a", 3), ("a_migration", 5)}
    store.create("a", "other string", replace_if_different=True)
    assert store.read("a").columns == ["other"]
    seen = store.version("a")
    assert store.write("a", spark.range(1), expected=seen) == seen + 1
    with pytest.raises(Conflict):
        store.write("a", spark.range(2), expected=seen)
    other = Store(spark, f"file://{tmp_path}/store")
    first, second = store._claimed("a", None), other._claimed("a", None)  # both before either has written
    assert second == first + 1 and store.read("a").count() == 1
    store.drop("a")
    assert not store.exists("a")
    with pytest.raises(KeyError):
        store.read("a")
    write_jsonl(spark.range(2), f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2


def test_embedding_hook_retries_long_texts(spark):
    def model(texts):
        if any(len(t) > 600 for t in texts):
            raise TooLong(600)
        return [[float(len(t))] for t in texts]

    assert in_batches(["a", "b" * 900], model) == [[1.0], [600.0]]
    df = spark.createDataFrame([("1", "hello"), ("2", None), ("3", "x" * 700)], "doc_id string, content string")
    got = migrate.re_embedded(df.withColumn("dense", F.lit(None)), "document", lambda d: embedded(d, lambda t: [[float(len(x))] for x in t]))
    assert {r["doc_id"]: r["dense"] for r in got.collect()} == {"1": [5.0], "2": None, "3": [700.0]}


def test_queue_names():
    assert queues.kv_collection("a.b-c") == "kv_a_b_c" and migrate.family("kv_x") == "kv" and migrate.family("x_faq") == "faq"


def test_stream_keeps_the_first_query(spark, tmp_path):
    from siftmill.streaming import queue

    spark.createDataFrame([("c", " Hi "), ("c", "hi"), ("d", "hi"), ("d", " ")], "collection_name string, query string").withColumn("created_at", F.timestamp_seconds(F.lit(1704067200))).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("collection_name string, query string, created_at timestamp").parquet(f"file://{tmp_path}/in")
    job = queue.unique_queries(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_values_of_clauses():
    q = parse('before:(2024-01-01) after:"2023-01-01" intext:(\'a\'|"b") intitle:(say "the" word) site:x.de filetype:pdf inurl:docs free')
    assert (q.before.year, q.after.year) == (2024, 2023)
    assert q.any_of["content"] == ("a", "b") and q.any_of["title"] == ('say "the" word',)
    assert q.highlight_terms == (("a", "b", "free"), ("docs", "x.de", "pdf"))


def test_long_walks_keep_their_order(spark):
    n = 6
    url = "https://e.com/{}".format
    docs = spark.createDataFrame([(k, url(k), [*(f"https://none.com/{j}" for j in range(5000)), url(k + 1)]) for k in range(n)], "n long, url string, hyperlinks array<string>")
    docs = docs.withColumn("doc_id", ids.document_id(F.col("url")))
    found = graph.related(docs, docs.where("n = 0").select("doc_id", F.lit(10**12).alias("pos")), 5, 10).collect()
    assert [r["hop"] for r in found] == [1, 2, 3, 4, 5] and found[-1]["pos"] == [10**12, 5000, 5000, 5000, 5000, 5000]


def test_several_sources_of_one_faq_in_a_batch(spark):
    row = "faq_id string, question string, answer string, document_id string, url string, confidence double, extracted_at string"
    old = faqs.merged(spark.createDataFrame([("f", "q", "a", "d1", "u1", 0.5, "1")], row))
    batch = spark.createDataFrame([("f", "q", "a", "d1", "u1", 0.7, "2"), ("f", "q", "a", "d2", "u2", 0.9, "2"), ("f", "q", "a", "d2", "u2", 0.8, "3")], row)
    got = faqs.upserted(old, batch).collect()
    assert [(r["faq_id"], r["action"], r["source_count"], r["aggregated_confidence"]) for r in got] == [("f", "merged", 2, 0.8)]
    assert {(s["document_id"], s["confidence"]) for s in got[0]["source_documents"]} == {("d1", 0.7), ("d2", 0.8)}
    kept = faqs.upserted(old, batch.where("document_id = 'd1'"), keep_existing=True).first()
    assert kept["action"] == "merged" and kept["source_documents"][0]["confidence"] == 0.5


def test_a_state_comes_from_one_write(spark):
    writes = spark.createDataFrame([(1, "a", "z", 5), (1, "b", "y", 5), (1, "c", "x", 4)], "id long, key string, value string, at long")
    assert queues.kv_state(writes).collect()[0].asDict() == {"id": 1, "key": "b", "value": "y", "created_at": 4, "updated_at": 5}


def test_families_and_probes(spark, tmp_path):
    from siftmill.operators import health
    from siftmill.sources import schemas
    from siftmill.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    assert [schemas.created(store, n) for n in ("docs", "docs_faq", "kv_x", "docs_feedback", "system_config", "query_queue")] == ["document", "faq", "kv", "feedback", "config", "queue"]
    assert store.read("docs_faq").columns == schemas.schema_of("a_faq").names
    store.write("docs_feedback", spark.range(1))
    schemas.created(store, "docs_feedback")
    assert store.read("docs_feedback").columns == schemas.schema_of("x_feedback").names
    got = health.probes(spark, {"a": lambda: spark.range(3), "b": lambda: spark.table("none")})
    assert [(r["probe"], r["status"], r["found"]) for r in got.collect()] == [("a", "ok", 3), ("b", "unhealthy", None)]
    assert health.overall(got).first()["status"] == "unhealthy" and health.overall(got.where("status = 'ok'")).first()["status"] == "healthy"


def test_a_walk_has_one_plan_a_level(spark, monkeypatch):
    from siftmill import scratch

    url = "https://e.com/{}".format
    docs = spark.createDataFrame([(k, url(k), [url(k + 1), url(k // 2), "https://none.com"]) for k in range(30)], "n long, url string, hyperlinks array<string>")
    docs = docs.withColumn("doc_id", ids.document_id(F.col("url")))
    plans, written = [], scratch.written

    def watching(df, name, by=None):
        if name == "walk-level":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return written(df, name, by)

    monkeypatch.setattr(scratch, "written", watching)
    seeds = docs.where("n = 3").select("doc_id", F.lit(0).alias("pos"))
    found = graph.related(docs, seeds, 6, 1000)
    assert len(plans) == 7 and max(plans[1:]) - min(plans[1:]) <= 5  # one small table more for each level, whatever the links
    assert found._jdf.queryExecution().toString().count("FileScan") <= 8
    assert [r["hop"] for r in found.collect()][:3] == [1, 1, 2]
    plans.clear()
    assert graph.related(docs, seeds, 50, 3).count() == 3 and len(plans) == 3  # enough after two levels
    plans.clear()
    assert graph.related(docs, docs.where("n = 29").select("doc_id", F.lit(0).alias("pos")), 50, 1000, allowed=docs.where("n in (14, 29)")).count() == 1 and len(plans) == 3  # the second level is empty
    walk = graph.walkable(docs)
    assert graph.related(docs, seeds, 2, 9, links=walk).collect() == graph.related(docs, seeds, 2, 9).collect()
    assert graph.related(docs, seeds.limit(0), 3, 9).collect() == [] and graph.related(docs, seeds, 0, 9, with_seeds=True).count() == 1
