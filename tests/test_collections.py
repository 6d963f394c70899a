"""Collections with a change log and an index, and streams into them."""

import os
import shutil
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftmill.operators import ingest
from siftmill.sources import changelog
from siftmill.sources.changelog import Collection, Conflict
from siftmill.streaming import queue



def now():
    return F.timestamp_seconds(F.lit(1704067200))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def collection(spark, tmp_path):
    return Collection(spark, f"file://{tmp_path}/store", "docs", indexed=("url", "domain"))


def made(spark, ids, domain="d"):
    return spark.createDataFrame([(f"{k:05d}", f"https://{domain}.com/{k}", f"{domain}{k % 3}", k) for k in ids], "doc_id string, url string, domain string, n int")


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_puts_and_drops_are_merged_on_read(spark, collection):
    with pytest.raises(KeyError):
        collection.read()
    assert collection.version() == 0 and collection.replace(made(spark, range(100)).repartition(4)) == 1
    assert collection.put(made(spark, range(90, 110), "e")) == 2
    assert collection.drop(spark.createDataFrame([("00003",), ("00105",), ("none",)], "doc_id string")) == 3
    assert collection.put(made(spark, [3], "f").withColumn("more", F.lit("x"))) == 4
    got = {r["doc_id"]: r for r in collection.read().collect()}
    assert len(got) == 109 and "00105" not in got and got["00003"]["domain"] == "f0" and got["00003"]["more"] == "x" and got["00001"]["more"] is None
    assert got["00095"]["domain"] == "e2" and got["00089"]["domain"] == "d2"
    assert collection.read(1).count() == 100 and collection.read(3).count() == 108
    before = rows(collection.read())
    assert collection.compact() == 5 and rows(collection.read()) == before and collection.read(2).count() == 110
    assert collection.vacuum() == 4 and rows(collection.read()) == before and collection.version() == 5


def test_an_update_costs_its_own_size(spark, collection, tmp_path):
    collection.replace(made(spark, range(20_000)).repartition(4))
    whole = size(f"{tmp_path}/store/docs/data")
    collection.put(made(spark, [7]))
    assert size(f"{tmp_path}/store/docs/data") - whole < whole / 20
    plan = collection.read()._jdf.queryExecution().toString()
    collection.put(made(spark, [8]))
    collection.put(made(spark, [9]))
    assert collection.read()._jdf.queryExecution().toString().count("FileScan") == plan.count("FileScan")  # however many deltas


def test_two_writers_never_take_one_version(spark, collection, monkeypatch):
    collection.replace(made(spark, range(10)))
    seen = collection.version()
    collection.put(made(spark, [1], "x"), expected=seen)
    with pytest.raises(Conflict):
        collection.put(made(spark, [2], "y"), expected=seen)
    with pytest.raises(Conflict):
        collection.replace(made(spark, [2], "y"), expected=seen)
    read = Collection.read

    def slow(self, version=None):
        out = read(self, version)
        monkeypatch.undo()
        collection.put(made(spark, [3], "z"))  # another writer, between a compaction's read and its commit
        return out

    monkeypatch.setattr(Collection, "read", slow)
    with pytest.raises(Conflict):
        collection.compact()
    assert {r["domain"] for r in collection.read().where("n in (1, 2, 3)").collect()} == {"x1", "d2", "z0"}
    start = collection.version()
    with ThreadPoolExecutor(4) as pool:  # blind writers each get a version of their own, and nothing is lost
        got = list(pool.map(lambda k: collection.put(made(spark, [1000 + k], "w")), range(6)))
    assert sorted(got) == list(range(start + 1, start + 7)) and collection.read().where("n >= 1000").count() == 6


def test_half_written_commits_dont_count(spark, collection, tmp_path):
    collection.replace(made(spark, range(5)))
    made(spark, range(50)).write.parquet(f"file://{tmp_path}/store/docs/data/{'0' * 32}")  # a writer that died before its commit
    Path(f"{tmp_path}/store/docs/log/000000000002.json").touch()  # created, never written, as a store without links may leave it
    assert collection.read().count() == 5 and collection.version() == 1


def test_a_lookup_opens_files_that_can_match(spark, collection):
    collection.replace(made(spark, range(4000)).repartitionByRange(16, "n"))
    collection.put(made(spark, [17, 5000], "e"))
    collection.drop(made(spark, [18]))
    value = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    for column, wanted, most in (("doc_id", ["00017"], 4), ("url", ["https://d.com/2500"], 3), ("url", ["https://d.com/17"], 3), ("url", ["https://e.com/17", "https://d.com/900"], 6), ("doc_id", ["00018"], 4), ("url", ["nowhere"], 1), ("domain", ["d1"], 99), ("domain", ["e2"], 3)):
        files, total = collection.files(column, value(*wanted))
        assert total >= 17 and len(files) <= most
        got = collection.lookup(column, value(*wanted))
        assert rows(got) == rows(collection.read().where(F.col(column).isin(wanted)))
        assert len(got.inputFiles()) <= most + 2  # and the deltas' keys
    many = made(spark, range(0, 4000, 2)).select(F.col("doc_id").alias("value"))
    assert rows(collection.lookup("doc_id", many)) == rows(collection.read().join(many, F.col("doc_id") == F.col("value"), "left_semi"))
    assert collection.lookup("doc_id", value(None)).count() == 0
    with pytest.raises(KeyError):
        collection.files("n", value("1"))


def test_filters_have_no_false_negative(spark, collection, monkeypatch):
    monkeypatch.setattr(changelog, "BITS", 1)  # far too few bits: more files, the same rows
    strange = [None, "", "é", "日本", "\U0001f642", "a" * 5000, "\u0000", "z"]
    df = spark.createDataFrame([(str(k), v, None, k) for k, v in enumerate(strange)], "doc_id string, url string, domain string, n int").repartition(3, "n")
    collection.replace(df)
    for v in strange[1:]:
        assert collection.lookup("url", spark.createDataFrame([(v,)], "value string")).count() == 1
    assert collection.lookup("domain", spark.createDataFrame([("x",)], "value string")).count() == 0


def words(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_ingestion_sees_the_collection(spark):
    stored = ingest.stamped(spark.createDataFrame([("a", words(1)), ("b", words(2)), ("c", words(3))], "url string, content string"), now()).select("doc_id", "url", "content_hash")
    batch = [
        ("n1", words(9), 1),  # new
        ("n2", words(1).upper(), 2),  # a copy of a
        ("a", words(1), 3),  # refreshed, the same
        ("b", words(8), 4),  # refreshed with other content, which frees words(2)
        ("n3", words(2), 5),  # so nobody has this
        ("n4", words(2), 6),  # but now n3 has
        ("n5", words(9), 7),  # a copy of n1
        ("n6", None, 8),
        ("n7", "short", 9),
        ("n8", words(3), 0),  # a copy of c
    ]
    df = spark.createDataFrame(batch, "url string, content string, arrival int")
    got = {r["url"]: (r["status"], r["duplicate_of"]) for r in ingest.with_status(df, now(), stored=stored).collect()}
    assert got == {
        "n1": ("stored", None), "n2": ("duplicate_content", "a"), "a": ("refreshed", None), "b": ("refreshed", None), "n3": ("stored", None),
        "n4": ("duplicate_content", "n3"), "n5": ("duplicate_content", "n1"), "n6": ("empty", None), "n7": ("content_too_short", None), "n8": ("duplicate_content", "c"),
    }
    early = spark.createDataFrame([("n3", words(2), 1), ("b", words(8), 2)], "url string, content string, arrival int")
    assert {r["url"]: r["status"] for r in ingest.with_status(early, now(), stored=stored).collect()} == {"n3": "duplicate_content", "b": "refreshed"}
    assert ingest.with_status(df.limit(0), now(), stored=stored).count() == 0 and ingest.with_status(df, now(), stored=stored.limit(0)).where("status = 'refreshed'").count() == 0


def test_facts_are_read_once(spark, tmp_path):
    """The plan behind the statuses reads written facts, not the texts."""
    spark.createDataFrame([("a", words(1), 1)], "url string, content string, arrival int").write.parquet(f"file://{tmp_path}/in")
    st = ingest.with_status(spark.read.parquet(f"file://{tmp_path}/in"), now())
    assert f"{tmp_path}/in" not in st._jdf.queryExecution().toString() and "content" not in st.columns


def test_a_stream_of_documents_into_a_collection(spark, tmp_path):
    kind = "url string, content string, arrival int"
    docs = Collection(spark, f"file://{tmp_path}/store", "docs", indexed=("content_hash", "url"))
    seen = {}

    def run(part):
        if part is not None:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in")
        job = queue.ingesting(stream, docs, now(), f"file://{tmp_path}/checkpoint", lambda st, n: seen.update({(n, r["url"]): (r["status"], r["duplicate_of"]) for r in st.collect()}))
        job.processAllAvailable()
        job.stop()

    run([("a", words(1), 1), ("b", words(2), 2), ("a2", words(1), 3)])
    run([("c", words(2), 1), ("a", words(5), 2), ("d", words(7), 3), ("e", "short", 4)])
    run(None)
    assert seen == {
        (0, "a"): ("stored", None), (0, "b"): ("stored", None), (0, "a2"): ("duplicate_content", "a"),
        (1, "c"): ("duplicate_content", "b"), (1, "a"): ("refreshed", None), (1, "d"): ("stored", None), (1, "e"): ("content_too_short", None),
    }
    want = {("a", words(5)), ("b", words(2)), ("d", words(7))}
    assert {(r["url"], r["content"]) for r in docs.read().collect()} == want and docs.version() == 2
    # lost after the collection's commit, before the stream's: the batch comes again and changes nothing
    commits = Path(f"{tmp_path}/checkpoint/commits")
    last = max((int(p.name), p) for p in commits.iterdir() if p.name.isdigit())[1]
    os.unlink(last)
    crc = commits / f".{last.name}.crc"
    if crc.exists():
        os.unlink(crc)
    run(None)
    assert docs.version() == 2 and {(r["url"], r["content"]) for r in docs.read().collect()} == want


def test_a_query_is_enqueued_once_for_ever(spark, tmp_path):
    kind = "collection_name string, query string, created_at timestamp"

    def run(name, batch):
        df = spark.createDataFrame(batch, "collection_name string, query string, at long").select("collection_name", "query", F.timestamp_seconds("at").alias("created_at"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in")
        job = queue.unique_queries_for_ever(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        job.awaitTermination(120)

    run("1", [("c", " Hi ", 0), ("c", "hi", 1), ("d", "hi", 2)])
    run("2", [("c", "HI", 90_000_000), ("c", "new", 90_000_001)])  # years later, after a restart
    run("3", [("c", "hi", 190_000_000), ("d", " ", 3), ("c", "new", 190_000_001)])
    assert rows(spark.read.parquet(f"file://{tmp_path}/out").select("collection_name", F.trim(F.lower("query")))) == [("c", "hi"), ("c", "new"), ("d", "hi")]
    shutil.rmtree(tmp_path / "c")


def test_re_embedding_survives_failures_and_restarts(spark, tmp_path):
    from siftmill.operators import reembed
    from siftmill.sources.embedding import embedded

    source = spark.createDataFrame([(str(k), f"text {k}" if k % 10 else " ", [0.0]) for k in range(60)], "doc_id string, content string, dense array<double>")
    target = Collection(spark, f"file://{tmp_path}/store", "docs_new")
    calls = f"{tmp_path}/calls"
    os.mkdir(calls)

    def model(fail):
        def run(texts):
            if any(fail(t) and not os.path.exists(f"{calls}/{t}") for t in texts):
                for t in texts:
                    open(f"{calls}/{t}", "w").close()
                raise ValueError("the model is away")
            return [[float(len(t)), 1.0] for t in texts]

        return lambda df: embedded(df, run)

    swapped = []
    never = lambda t: t == "text 7"

    def away(texts):
        if "text 7" in texts:
            raise ValueError("never")
        return [[float(len(t)), 1.0] for t in texts]

    first = reembed.advance(source, target, "document", lambda df: embedded(df, away), "job", ranges=4, tries=2)
    assert not first.complete and first.done == 3 and list(first.tries.values()).count(2) == 1 and "never" in str(first.errors)
    assert not reembed.finalised(target, "job", 4, lambda: swapped.append(1)) and not swapped
    with pytest.raises(ValueError):
        reembed.advance(source, target, "document", model(never), "job", ranges=5)
    again = Collection(spark, f"file://{tmp_path}/store", "docs_new")  # another driver
    versions = again.version()
    second = reembed.advance(source, again, "document", model(never), "job", ranges=4)
    assert second.complete and len(second.tries) == 1 and max(second.tries.values()) <= 2 and again.version() == versions + 1  # only what wasn't done; a failure on the way
    assert reembed.finalised(again, "job", 4, lambda: swapped.append(1)) and swapped == [1]
    got = {r["doc_id"]: r["dense"] for r in again.read().collect()}
    assert got == {str(k): [float(len(f"text {k}")), 1.0] if k % 10 else None for k in range(60)}
    assert reembed.advance(source, again, "document", model(never), "job", ranges=4).tries == {}
    stopped = reembed.advance(source, Collection(spark, f"file://{tmp_path}/store", "other"), "document", model(never), "job", ranges=4, cancelled=lambda: True)
    assert stopped.done == 0 and not stopped.complete


def test_families_are_indexed(spark, tmp_path):
    from siftmill.sources import schemas

    faqs = schemas.collection(spark, f"file://{tmp_path}/s", "docs_faq")
    assert faqs.key == "faq_id" and faqs.read().columns == schemas.schema_of("docs_faq").names and faqs.version() == 1
    source = "array(named_struct('document_id', concat('d', id % 50), 'url', 'u', 'extracted_at', 't', 'confidence', 1.0D), named_struct('document_id', concat('e', id), 'url', 'u', 'extracted_at', 't', 'confidence', 1.0D))"
    rows = spark.range(400).selectExpr("cast(id as string) as faq_id", "concat('h', id) as question_hash", f"{source} as source_documents", "concat('2024-01-', lpad(1 + id div 20, 2, '0')) as first_seen").repartitionByRange(8, "first_seen")
    faqs.replace(rows)
    again = schemas.collection(spark, f"file://{tmp_path}/s", "docs_faq")
    value = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    ids = lambda df: sorted(int(r["faq_id"]) for r in df.collect())
    assert ids(again.lookup("source_documents.document_id", value("d7", "none"))) == list(range(7, 400, 50))
    assert ids(again.lookup("source_documents.document_id", value("e33"))) == [33] and len(again.files("source_documents.document_id", value("e33"))[0]) < again.files("source_documents.document_id", value("e33"))[1]
    again.drop(spark.createDataFrame([("33",)], "faq_id string"))
    assert again.lookup("source_documents.document_id", value("e33")).count() == 0 and ids(again.lookup("question_hash", value("h34"))) == [34]
    assert ids(again.lookup_between("first_seen", "2024-01-02", "2024-01-03")) == [k for k in range(20, 60) if k != 33]
    docs = schemas.collection(spark, f"file://{tmp_path}/s", "docs")
    docs.put(spark.range(100).selectExpr("cast(id as string) as doc_id", "timestamp_seconds(1704067200 + id * 86400) as indexed_at").repartitionByRange(5, "indexed_at"))
    late = docs.lookup_between("indexed_at", "2024-04-01 00:00:00", "2024-04-03 12:00:00")
    assert sorted(int(r["doc_id"]) for r in late.collect()) == [91, 92, 93] and len(late.inputFiles()) <= 3
