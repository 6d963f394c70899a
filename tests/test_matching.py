"""One automaton against regular expressions, and the language detector on texts that it wasn't fitted to."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftmill.functions import language, matching, text
from siftmill.operators import queues

TERMS = ["the", "of", "and", "ing", "tion", "er", "in", "an", "th", "es", "on", "re"]


def test_matches_equal_the_expressions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rng = random.Random(2)
    odd = [(-k, " ".join(rng.choice(["The", "OF", "and", "ofof", "théthe", "ĀB", "x"]) for _ in range(40))) for k in range(1, 40)] + [(-99, None), (-100, "")]
    df = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    some = ["the", "of", "and", "x"]
    found = matching.matches(F.col("text"), some)
    got = {r["doc_id"]: r for r in df.select("doc_id", found.alias("m"), matching.has_matches(found, 3).alias("many"), matching.has_matches(found, 1, "chain").alias("chain")).collect()}
    body = F.coalesce("text", F.lit(""))
    want = df.select("doc_id", F.array(*(text.term_count(body, t) for t in some)).alias("counts"), text.best_chain(body, some).alias("best"), text.has_matches(body, some, 3).alias("many"), text.has_matches(body, some, 1, "chain").alias("chain")).collect()
    for r in want:
        m = got[r["doc_id"]]["m"]
        assert list(m["counts"]) == list(r["counts"]) and (m["phrase"], m["count"]) == (tuple(r["best"]) if r["best"] else (None, None))
        assert (got[r["doc_id"]]["many"], got[r["doc_id"]]["chain"]) == (r["many"], r["chain"])


def test_occurrences_dont_overlap():
    count = matching.counter(["aa", "aba", "", "A"])
    assert count("aaaaa ababa") == [2, 1, 0, 8]
    assert matching.counter([""])("x") == [0] and matching.phrases(["a", "b", "c"]) == ["a b c", "a b", "b c"]


def test_twelve_terms_cost_about_one_pass():
    rng = random.Random(1)
    own = " ".join(rng.choice([*TERMS, "house", "garden", "yellow", "window", "paper", "music"]) for _ in range(200_000))
    plain, chains = matching.counter(TERMS), matching.counter([*TERMS, *matching.phrases(TERMS)])
    assert len(matching.phrases(TERMS)) == 66

    def seconds(f):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            f(own)
            times.append(time.perf_counter() - start)
        return min(times)

    assert seconds(chains) < 4 * seconds(plain)  # 78 patterns, not 12


def test_languages_of_held_out_texts(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    known = language.profiles(docs.where("doc_id % 2 = 0"))
    assert sorted(known) == ["de", "en", "es", "fr"] and all(len(p) <= language.RANKS for p in known.values())
    held = docs.where("doc_id % 2 = 1").select("lang", language.language(F.col("text"), known).alias("found")).select("lang", "found.*")
    rows = held.collect()
    assert sum(r["lang"] == r[1] for r in rows) / len(rows) > 0.97
    sure = [r for r in rows if r["accuracy"] >= language.LEAST]
    assert len(sure) / len(rows) > 0.8 and sum(r["lang"] == r[1] for r in sure) / len(sure) > 0.98


def test_unknown_languages(spark):
    known = {"de": {"e": 0, "n": 1, "en ": 2}, "en": {"t": 0, "th": 1, "e": 2}}
    assert language.detected("", known) == (None, 0.0) and language.detected("123 _", known) == (None, 0.0) and language.detected("the", {}) == (None, 0.0)
    assert language.detected("the", known)[0] == "en"
    df = spark.createDataFrame([("the",), (None,), ("zzz",)], "query string")
    got = df.select("query", language.language(F.col("query"), known).alias("l")).select("query", "l.lang", "l.accuracy")
    assert [r["accuracy"] for r in got.collect()][1:] == pytest.approx([0.0, 0.0])
    assert {r["query"]: r["language"] for r in queues.with_language(got).collect()} == {"the": "en", None: "Unknown", "zzz": "Unknown"}


def test_profiles_of_empty_tables(spark):
    assert language.profiles(spark.createDataFrame([], "lang string, text string")) == {}
