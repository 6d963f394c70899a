"""Fingerprints, ranked search and the divergence audit against brute force and SQL; and their hard rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftmill.llm import base, divergence, lexical, registry, simhash, similarity


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, differing=2):
    """Index of the first of each component."""
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= differing) + i + 1).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def plain_classes(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots, low = plain_components(fps), {}
    for (doc_id, _), r in zip(rows, roots):
        low[r] = min((x for x in (low.get(r), doc_id) if x is not None), default=None)
    return Counter((doc_id, f"{f:016x}", low[r]) for (doc_id, _), f, r in zip(rows, fps, roots))


def classes(df):
    return Counter(tuple(r) for r in simhash.fingerprint_classes(df).collect())


def test_fingerprints_equal_brute_force(spark, sf, hard, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), hard):
        assert classes(df) == plain_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    assert simhash.fingerprint_classes(empty).collect() == []
    one = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert classes(one) == Counter({(None, f"{plain_fingerprint('a b c d'):016x}", None): 2})


def test_the_hash_is_that_of_spark(spark):
    text = "Ünder the Bridge"
    want = spark.range(1).select(F.xxhash64(F.lit("Ünder the bridge"))).first()[0] & (1 << 64) - 1
    assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("differing", [0, 1, 2, 3])
def test_links_of_large_groups_are_whole(spark, differing, monkeypatch):
    """Clusters of many near fingerprints, in keys beyond SMALL and within it."""
    rng = np.random.default_rng(7)
    fps = []
    for size in (150, 40, 8, 3, 1, 1):
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(size):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.append(int(centre) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    nodes, _ = base.written(spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long"), "test-nodes")
    own = np.array(fps, np.uint64).view(np.int64).tolist()
    edges, _ = base.written(simhash.linked(nodes, differing), "test-edges")
    for r in edges.collect():
        assert (r["uid"] ^ r["to"]) & (1 << 64) - 1 and ((r["uid"] ^ r["to"]) & (1 << 64) - 1).bit_count() <= differing
    labels = {r["uid"]: r["root"] for r in similarity.components(edges).collect()}
    got, want = {}, {}
    for x, root in zip(own, plain_components(fps, differing)):
        got.setdefault(labels.get(x, x), set()).add(x)
        want.setdefault(root, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_are_the_cheapest_and_keep_every_pair():
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 1 << 20, dtype=np.uint64)
    fps = np.concatenate([(rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(20)) | hot, rng.integers(0, 1 << 63, 400, dtype=np.uint64)])  # half share their low 20 bits
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])
    counted = next(simhash._together([batch]))
    both = np.zeros((64, 64), np.int64)
    both[counted["i"].to_numpy(), counted["j"].to_numpy()] = counted["n"].to_numpy()
    related = simhash.correlations(both, len(fps))
    parts = simhash.grouped_bits(related, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    constant = [set(p) & set(range(20)) for p in parts]
    assert max(map(len, constant)) >= 14  # the bits that go together are in one partition
    counts = {}
    for r in next(simhash._values({4: parts})([batch])).to_pylist():
        counts.setdefault((r["i"], r["j"]), np.zeros(256, np.int64))[r["v"]] = r["n"]
    layout = simhash.Layout(parts, counts, len(fps) * 100_000, 2)
    costs = layout.costs(fps)
    chosen = layout.allocated(costs)
    assert (chosen.sum(1) == layout.total).all() and chosen.min() >= -1
    ways = [t for t in np.ndindex(4, 4, 4, 4) if sum(t) - 4 == layout.total]
    for row in range(0, 800, 37):
        best = min(sum(costs[row, i, t[i]] for i in range(4)) for t in ways)
        assert sum(costs[row, i, chosen[row, i] + 1] for i in range(4)) == pytest.approx(best)
    assert len(np.unique(chosen, axis=0)) > 1  # thresholds differ by fingerprint
    for _ in range(300):  # whatever two bits differ, one of the two partitions' thresholds lets it through
        row = rng.integers(len(fps))
        flips = {int(b) for b in rng.choice(64, 2, replace=False)}
        assert any(len(flips & set(p)) <= chosen[row, i] for i, p in enumerate(parts))


# 12
def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_ranked(docs, items, k=10):
    rows = [(d, Counter(plain_terms(t)), len(plain_terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (doc_id, tf, n) in enumerate(rows):
            s = 0
            for term in plain_terms(text):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    s += w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 8 * (25 + 75 * n * n_docs // total)))
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_ranked_search_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert found(registry.op12_ranked_search(spark, sf)) == Counter(con.sql(lexical.ORACLE_SQL).project("item_id, rank, doc_id, score").fetchall())


def test_ranked_search_over_many_blocks_and_groups(spark, sf, monkeypatch):
    """Bounds from earlier blocks, small steps and several files of queries leave the result as it is."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.unionByName(docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 100_000))  # copies tie
    plain = plain_ranked([(r["doc_id"], r["text"]) for r in rows.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    for name, value in (("BLOCK_DOCS", 9), ("GROUP", 7), ("STEP", 64)):
        monkeypatch.setattr(lexical, name, value)
    blocks = lexical._blocks(len(plain), 10_000)  # parameters reach the tasks through the functions
    assert blocks
    index = lexical.indexed(rows)
    walked = [lexical.Treaps({c: [r[c] for r in own] for c in ("term", "n", "root", "docs", "impacts", "lefts", "rights")}) for own in [index.table.where("root is not null").collect()][:1]]
    assert walked[0].doc.min() >= 0
    assert found(lexical.ranked(rows, items)) == plain


def test_ranked_search_hard_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, "seven SEVEN eight"), (2, None), (None, "ok 日本"), (1, "alpha1 beta2 mail"), (3, "nowhere"), (4, "x" * 50_000), (5, "")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    assert found(lexical.ranked(hard, items)) == plain_ranked(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert lexical.ranked(empty, items).collect() == [] and lexical.ranked(hard, items.limit(0)).collect() == []
    assert lexical.ranked(hard.where("text is null"), items).collect() == []


def test_treaps_are_trees_and_heaps():
    rng = random.Random(5)
    lists = [[rng.randrange(40) for _ in range(n)] for n in (1, 2, 3, 17, 200)]
    ends = np.cumsum([len(x) for x in lists])
    begins = ends - [len(x) for x in lists]
    left, right, roots = lexical.treap([x for own in lists for x in own], begins.tolist(), ends.tolist())
    for own, b, root in zip(lists, begins.tolist(), roots):
        def inorder(i):
            for child, side in ((left[b + i] - 1, -1), (right[b + i] - 1, 1)):
                if child >= 0:
                    assert own[child] <= own[i] and (child - i) * side > 0
            return (inorder(left[b + i] - 1) if left[b + i] else []) + [i] + (inorder(right[b + i] - 1) if right[b + i] else [])

        assert inorder(root) == list(range(len(own)))


def test_walk_leaves_most_documents_out():
    """The bounds prune: far fewer documents are scored than hold a term."""
    rng = np.random.default_rng(11)
    block = lexical._Block()
    for k in range(3000):
        words = [b"t%d" % w for w in np.minimum(rng.zipf(1.3, 60), 4000)]
        block.add(k, 100, words)
    rows = block.rows(0, 3000, 3000 * 60).to_pylist()
    treaps = lexical.Treaps({c: [r[c] for r in rows[:-1]] for c in rows[0]})
    terms = [t for t in (b"t2", b"t40", b"t300", b"t900") if t in treaps.terms]
    term = np.array([treaps.terms[t] for t in terms])
    weight = np.array([round(1000 * math.log(6002 / (2 * rows[t]["n"] + 1))) for t in term.tolist()], np.int64)
    scored = []

    class Counting(lexical.Best):
        def add(self, query, place, score):
            scored.extend(place.tolist())
            super().add(query, place, score)

    best = lexical.walked(treaps, Counting(np.ones(1, np.int64), np.full(1, 3000), 10), np.zeros(len(term), np.int64), term, weight, 3000, step=64)
    every = np.zeros(3000, np.int64)
    for t, w in zip(term.tolist(), weight.tolist()):
        own = slice(treaps.begins[t], treaps.begins[t] + rows[t]["n"])
        every[treaps.doc[own]] += w * treaps.impact[own]
    order = np.lexsort((np.arange(3000), -every))[:10]
    assert best.place.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert len(scored) == len(set(scored)) < np.count_nonzero(every) / 4


# 13
def plain_audit(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        df = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)

        def shares(terms):
            n = Counter(t for t in terms if df[t] >= least)
            return n, {t: 1 + 1_000_000_000 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        sources = {s: shares([t for _, x, terms in own if x == s for t in terms]) for s in sorted({x[1] for x in own})}
        _, whole = shares([t for *_, terms in own for t in terms])
        for s, (n, p) in sources.items():
            parts = {"pair": [(o, sum(f(p[t], q[t]) for t in kept)) for o, (_, q) in sources.items() if o != s], "term": [(t, f(p[t], whole[t])) for t in kept if n[t] and p[t] > whole[t]]}
            for part, found_ in parts.items():
                ordered = sorted(found_, key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(ordered) if part == "pair" or r < ranks]
    return Counter(out)


def audit(df, **how):
    return Counter(tuple(r) for r in divergence.audited(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = Counter(con.sql(divergence.ORACLE_SQL).project("lang, source, part, item, value, rank").fetchall())
    assert audit(spark.read.parquet(f"{sf}/documents.parquet")) == want


def test_audit_hard_rows_and_ties(spark, hard, empty):
    many = hard.union(hard).union(hard)
    rows = [(r["lang"], r["source"], r["text"]) for r in many.select("lang", "source", "text").collect()]
    assert audit(many) == plain_audit(rows)
    assert divergence.audited(empty).collect() == []
    # every term of a source has one value, so that ranks are by bytes alone, in long common beginnings and beyond ASCII
    words = [f"{'z' * 30}{a}{b}" for a in "aé日🙂" for b in "abc"] + ["z" * k for k in range(1, 9)]
    ties = [("l", s, " ".join(own)) for s, own in (("p", words), ("q", ["other"] * 9)) for _ in range(3)]
    df = spark.createDataFrame(ties, "lang string, source string, text string")
    for ranks in (1, 7, 200):
        assert audit(df, ranks=ranks) == plain_audit(ties, ranks=ranks)


def test_audit_pairs_in_small_pieces(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), f"s{min(int(rng.expovariate(0.3)), 9)}", " ".join(f"w{chr(97 + min(int(rng.expovariate(0.2)), 25))}" for _ in range(rng.randrange(40)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = plain_audit(rows)
    assert audit(df) == want
    batches = [pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "source": [r[1] for r in rows], "text": [r[2] for r in rows]})]
    whole = Counter()
    monkeypatch.setattr(divergence, "HELD", 10)
    for batch in divergence._counted(batches):
        for r in batch.to_pylist():
            whole[r["lang"], r["source"], r["term"]] += r["n"]
    assert whole["a", "s0", b"wa"] == sum(r[2].split().count("wa") for r in rows if r[:2] == ("a", "s0"))


def test_large_counts_are_exact(spark):
    row = spark.range(1).selectExpr("3000000000000L as n", "70000000000000L as total", "12345678L as kept").select(divergence.share("n", "total", "kept").alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * 3_000_000_000_001 // (70_000_000_000_000 + 12_345_678)
