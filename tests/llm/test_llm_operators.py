"""The operators against brute force, round trips and held-out labels; and the hard rows: nulls, empty, long, repeated, clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftmill.llm import base, bpe, dedup, media, packing, pii, registry, sharding, similarity, token_files, tokens, toxicity, urlfilter

WORDS5 = 5


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def keyed(rows):
    return sorted(rows, key=lambda x: json.dumps(x, default=str))


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"create view {name} as select * from '{path}'")
    return con.sql(sql).fetchall()


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"create view {name} as select * from '{path}'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = keyed([tuple(r) for r in df.select(*columns).collect()])
    assert got == keyed(want.project(", ".join(columns)).fetchall())


# 1
def test_toxicity_finds_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = registry.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75
    assert n.get((0, 1), 0) / (n.get((0, 1), 0) + n[0, 0]) < 0.05


def test_toxicity_risk_is_corrected():
    rng = np.random.default_rng(0)
    mark = 7
    noise = lambda: rng.choice(np.arange(100, 400), 20, replace=False)
    positive = [np.append(noise(), mark) for _ in range(200)]
    unlabelled = [np.append(noise(), mark) if rng.random() < 0.2 else noise() for _ in range(1000)]
    model = toxicity.NonNegativePU(0.2).fit(positive, unlabelled)
    assert set(model.weights) == {mark}
    assert 1 / (1 + np.exp(-model.bias)) < 0.2 < 0.6 < 1 / (1 + np.exp(-model.bias - model.weights[mark]))


def test_toxicity_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    model = toxicity.NonNegativePU(0.3)
    for shift in (-2.0, 4.0):  # with far-off positives the bracket is negative
        p, u = rng.normal(2 + shift, 1, 30), rng.normal(-1, 1, 50)
        clipped = model.negative_risk(p, u) < -model.SLACK
        assert clipped == (shift > 0)

        def risk(p, u):
            bracket = model.negative_risk(p, u)
            return -bracket if clipped else model.prior * float(np.mean(np.logaddexp(0, -p))) + bracket

        slope, step = model.slope(p, u), 1e-6
        for i in range(0, 80, 7):
            q, v = p.copy(), u.copy()
            (q if i < 30 else v)[i if i < 30 else i - 30] += step
            assert (risk(q, v) - risk(p, u)) / step == pytest.approx(slope[i], abs=1e-6)


def test_toxicity_fit_where_texts_are_equals_the_fit_on_the_driver(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    rows = labels.where(~toxicity.in_fold(F.col("doc_id"))).join(docs, "doc_id").select("toxic", "text").collect()
    some = [toxicity.present(r["text"] or "") for r in rows]
    plain = toxicity.NonNegativePU(model.prior).fit([x for x, r in zip(some, rows) if r["toxic"] == 1], some)
    assert set(model.weights) == set(plain.weights) and model.weights
    texts = [r["text"] or "" for r in rows]
    assert np.allclose(model.scores(texts, {}), plain.scores(texts, {}), atol=0.15)


def test_toxicity_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.scored(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert toxicity.scored(empty, labels).count() == 0
    kept = toxicity.without_toxic(hard, labels.limit(0))
    assert kept.columns == hard.columns and kept.count() == hard.count()


def test_toxicity_without_a_model_keeps_all(spark):
    docs = spark.createDataFrame([(k, f"word{k} text") for k in range(20)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fitted(docs, labels)
    assert model.prior >= 0.3 and not model.weights
    assert {r["predicted"] for r in toxicity.scored(docs, labels).collect()} == {0}
    assert toxicity.without_toxic(docs, labels).count() == 20


# 2
@lru_cache(maxsize=None)
def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_the_plain_patterns(docs):
    rng = random.Random(1)
    texts = [t for _, t in text_rows(docs)] + ["".join(rng.choices("ab@.-+_%1239 ()0", k=rng.randrange(60))) for _ in range(4000)]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)


def test_pii_keeps_base_spans_and_adds_others(docs, hard, empty):
    for df in (docs, hard):
        want = Counter((d, hashlib.sha256(pii.named(plain_spans(t)).encode()).hexdigest(), *(sum(s[1] == k for s in plain_spans(t)) for k in range(4))) for d, t in text_rows(df))
        rows = pii.found_in(df).collect()
        got = Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows)
        assert len(rows) == df.count() and got == want
    assert pii.found_in(empty).count() == 0
    masked = pii.masked(hard)
    assert masked.columns == hard.columns and masked.count() == hard.count()
    assert masked.where("text like '%<email> and <ip> or <phone>%'").count() == 1


def test_pii_adds_spans_that_the_patterns_miss(spark):
    """A card after another number: the pattern runs on from the first digit, the field chooses its bounds."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii.fitted(docs)
    for text, kind, span in (("no. 5 4539578763621486 ok", 2, "4539578763621486"), ("n 7 4111111111111111", 2, "4111111111111111"), ("call +1 (555) 555-1234 5 6 7 8 9", 3, "+1 (555) 555-1234")):
        own, every = pii.all_spans(text, field, {})
        assert plain_spans(text) == own == [] and [(k, text[s:e]) for s, k, e in every] == [(kind, span)]


def test_pii_sample_sees_late_and_long_regions(spark, monkeypatch):
    text = " and ".join([*(f"n{k}" for k in range(40)), "1" * 300])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(pii.Field, "fit", lambda self, samples: [t[b:e] for t, b, e in samples])
    assert sorted(pii.fitted(docs)) == sorted(f"n{k}" for k in range(40))
    assert "1" * 300 in pii.fitted(docs, longest=300)


def test_semi_markov_sums_equal_enumeration():
    field, text = pii.Field(), "x 1.2.3.4 5"
    field.steps = [[0.1 * (a - b) for b in range(5)] for a in range(5)]
    bounds, ends = field.lattice(text, 0, len(text))
    for own in ends:
        for k, (_, fs) in enumerate(own):
            for t in range(1, 5):
                for n, f in enumerate(fs):
                    field.weights[t, f] = 0.1 * t - 0.07 * n
    scored = field.scores(ends)
    by_start = defaultdict(list)
    for j, own in enumerate(scored):
        for i, t, s, _ in own:
            by_start[i].append((j, t, s))

    def walk(i, y):
        if i == len(bounds) - 1:
            return [(0.0, ())]
        out = [(s + field.steps[y][0], p) for s, p in walk(i + 1, 0)]
        for j, t, s in by_start[i]:
            out += [(s + field.steps[y][t] + r, ((i, j, t), *p)) for r, p in walk(j, t)]
        return out

    every = walk(0, 0)
    segments, _, total = field.marginals(bounds, scored)
    assert total == pytest.approx(np.log(sum(np.exp(s) for s, _ in every)))
    for i, j, t, p, _ in segments:
        assert p == pytest.approx(sum(np.exp(s - total) for s, path in every if (i, j, t) in path), abs=1e-9)
    found = tuple((bounds.index(a), bounds.index(b), k + 1) for a, k, b, _ in field.segment(text, 0, len(text)))
    assert {p: s for s, p in every}[found] == pytest.approx(max(every)[0])


# 3
def check_shards(df, shards=8):
    rows, source = sharding.interleaved(df, shards).collect(), df
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in text_rows(df))
    own = defaultdict(list)
    for r in rows:
        own[r["shard"]].append(r)
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(own[k]) for k in range(shards)]
    assert sum(counts) == source.count() and max(counts) - min(counts) <= 1
    for k in own:
        assert sorted(r["slot"] for r in own[k]) == list(range(len(own[k])))
    for s, n in Counter(r["source"] for r in rows).items():
        for k in own:
            assert abs(sum(r["source"] == s for r in own[k]) - n * len(own[k]) / len(rows)) <= 2


def test_shards_match_the_mixture(spark, docs, hard, empty):
    check_shards(docs)
    check_shards(hard, 3)
    assert sharding.interleaved(empty).count() == 0


def test_shard_order_equals_brute_force(docs):
    rows, place = docs.select("doc_id", "source").collect(), {}
    own = defaultdict(list)
    for r in rows:
        own[r["source"]].append((hashlib.md5(f"17|{r['doc_id']}".encode()).hexdigest(), r["doc_id"]))
    mixed = sorted(((k + 0.5) / len(x), s, *d) for s, x in own.items() for k, d in enumerate(sorted(x)))
    for at, (*_, doc_id) in enumerate(mixed):
        shard = at * 8 // len(rows)
        place[doc_id] = (shard, at - -(-shard * len(rows) // 8))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleaved(docs).collect()} == place


def test_scratch_is_removed(spark, docs, tmp_path, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(base, "scratch_root", lambda _: f"file://{tmp_path}")
    with base.cleaned(spark):
        n = dedup.without_duplicates(docs).count()
        assert n and list(Path(tmp_path, "siftmill").iterdir())
    assert not [p for p in Path(tmp_path, "siftmill").iterdir() if p.is_dir()]


def test_shard_files(docs, tmp_path, spark):
    plan = sharding.write_shards(docs, f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count()
    assert {(r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()} == {(r["doc_id"], r["shard"]) for r in plan.collect()}


# 4
ODD = [*"abzSTdmlrvELé ÀŸſĐİıȺȾǅ  \'\'\'’sstdm 0129²½.,-!?\n\t\r\x0b\x1c\x85\xa0\u2009\u3000 日本\u0301👍ɐɏ\x00", "'s", "'ll", "'re", "'ve", " '", "<|endoftext|>", "<|startoftext|>", "J\u030c", "  ", "Ⅷ"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randrange(30))) for _ in range(n)] + ["", "x" * 5000, "1" * 3000, " " * 100]


@pytest.mark.parametrize("name, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("literal", [False, True])
def test_words_of_odd_texts_equal_the_library(name, words, literal):
    from tokenizers import Tokenizer

    plain, own, texts = Tokenizer.from_file(P.path(name)), tokens.LibraryWords(P.path(name), words, literal), odd_texts(5000, 7)
    plain.encode_special_tokens = literal
    for part in (texts[:3000], texts[3000:], texts):  # the table learns between calls
        ids, ends = own.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(ends.tolist(), ends[1:].tolist())] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_the_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BYTES", 3000)
    own, rng = tokens.LibraryWords(P.path("byte_bpe_50k.json"), False), random.Random(4)
    for _ in range(20):
        own.encode(pa.array([f"word{rng.randrange(10**6)} and word{rng.randrange(10**6)}" for _ in range(rng.randrange(60))], pa.string()))
        assert own.words.nbytes + own.ids.nbytes <= 3000


def test_slabs_keep_every_row():
    rng = random.Random(6)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 10, 400]) for _ in range(500)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 70], pa.string())}) for k in range(0, 500, 70)]
    for size in (1, 100, 1000, 10**6):
        parts = [b.column("text").to_pylist() for b in base.slabs(batches, size)]
        assert [t for p in parts for t in p] == texts
        assert all(len(p) == 1 or sum(len(t or "") for t in p[:-1]) <= size for p in parts)


@lru_cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def library_ids(name, text):
    return library(name).encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_round_trip(docs, hard, empty):
    alike = hard.sparkSession.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text")).unionByName(docs.select("doc_id", "text"))
    for df, most in ((docs, 1 << 20), (docs, 20_000), (alike, 20_000), (hard, 1 << 20), (hard, 1000)):
        folder = base.scratch_path(df.sparkSession, "token-files")
        manifest = token_files.write_token_files(df, folder, P.path("word_bpe_49k.json"), part_bytes=most)
        rows = token_files.read_digests(manifest, folder).collect()
        want = sorted(((d is not None, d or 0), len(ids), crc(ids)) for d, ids in ((d, [*library_ids("word_bpe_49k.json", t), 2]) for d, t in text_rows(df)))
        assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in rows) == want
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(rows, key=lambda r: r["start"])]
        assert order == sorted(order)
    assert token_files.token_files(empty, P.path("word_bpe_49k.json")).count() == 0


def test_wide_ids_are_kept(spark):
    path, end = P.path("word_bpe_49k.json"), 70_000
    row = token_files.token_files(spark.createDataFrame([(1, "")], "doc_id long, text string"), path, end).first()
    assert (row["n_tokens"], row["ids_crc32"]) == (1, crc([end]))
    assert token_files.width_of(path, 2) == 2 and token_files.width_of(path, end) == 4
    writer = token_files.FileWriter(2)
    writer.add(1, np.array([end], np.uint32))
    with pytest.raises(ValueError, match="does not fit"):
        writer.finish()


def test_token_file_reads_one_frame_for_one_document():
    import io

    writer, rng = token_files.FileWriter(2), np.random.default_rng(0)
    kept = {k: rng.integers(0, 49_000, rng.integers(1, 30_000)).astype(np.uint32) for k in range(40)}
    for k, ids in kept.items():
        writer.add(k, ids)
    data = writer.finish()
    reader = token_files.FileReader(io.BytesIO(data))
    assert len(reader.seek) > 3
    opened = []
    plain = reader.frame
    reader.frame = lambda k: opened.append(k) or plain(k)
    assert reader.find(17)[0].tolist() == kept[17].tolist() and len(opened) == 1
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().decompressobj(read_across_frames=False).decompress(data[a:b]) for a, b in zip(reader.starts.tolist(), reader.starts[1:].tolist()))
    assert whole == np.concatenate(list(kept.values())).astype("<u2").tobytes()
    bad = bytearray(data)
    bad[int(reader.starts[1]) - 6] ^= 1
    with pytest.raises(Exception):
        token_files.FileReader(io.BytesIO(bytes(bad))).frame(0)


# 5
def test_packing(docs, hard, empty):
    for df in (docs, hard):
        rows = packing.packed_documents(df, P.path("byte_bpe_50k.json")).collect()
        want = Counter()
        for d, t in text_rows(df):
            ids = [*library_ids("byte_bpe_50k.json", t), 0]
            first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[d, k, a, b - a, crc(ids[a:b])] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        least = -(-sum(r["length"] for r in rows) // 2048)
        assert len(bins) <= least * 1.03 + 2
    assert packing.packed_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_genetic_packing_keeps_every_item_once_and_helps():
    """With the settings of production, where best fit misses the bound, the search packs strictly tighter."""
    rng = np.random.default_rng(2)
    for low, high in ((300, 900), (400, 1100)):
        lengths = rng.integers(low, high, packing.BLOCK).tolist()
        island = packing.Island(lengths, 2048, 1)
        first = island.first(0.0)
        best = island.run([])
        assert sorted(i for b in best for i in b) == list(range(packing.BLOCK))
        assert max(sum(lengths[i] for i in b) for b in best) <= 2048
        assert island.bound <= len(best) < len(first)
        assert len(packing.Island(lengths, 2048, 2).run([best])) <= len(best)  # the next epoch goes on from it
        assert sorted(map(sorted, packing._as_genome(packing._as_bytes(best, packing.BLOCK)))) == sorted(map(sorted, best))
        child = island.cross(first, island.first(0.2))
        assert sorted(i for _, b in child for i in b) == list(range(packing.BLOCK))
        assert all(load == sum(lengths[i] for i in b) for load, b in child)


def test_least_bins_is_a_bound():
    assert packing.least_bins(np.array([1025] * 10), 2048) == 10
    assert packing.least_bins(np.array([700] * 10), 2048) == 5
    assert packing.least_bins(np.array([512] * 10), 2048) == 3


def test_islands_migrate_and_pack_tighter_than_best_fit(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 900, 6000).tolist()
    items = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "uid long, piece int, length long")
    got = packing.packed(items).collect()
    own = defaultdict(list)
    for r in got:
        own[r["sequence_id"]].append((r["offset"], lengths[r["uid"]]))
    assert len(got) == 6000
    for b in own.values():
        assert [a for a, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))]).tolist()[:-1] and sum(n for _, n in b) <= 2048
    assert packing.least_bins(np.array(lengths), 2048) <= len(own) < len(packing.Island(lengths, 2048, 1).first(0.0))


def test_a_sequence_of_empty_documents(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.packed_documents(docs, P.path("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("last")).collect()
    assert sorted(r["n"] for r in got) == [904, 2048, 2048] and all(r["last"] == r["n"] - 1 for r in got)


# 6
def test_urls_equal_sql(spark, sf):
    same(registry.op6_url_filters(spark, "/root/testdata/sf0.01"), urlfilter.ORACLE_SQL, pages="/root/testdata/sf0.01/pages.parquet")


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    rng = random.Random(5)
    urls = [f"http://h{rng.randrange(400)}.example.com/p{rng.randrange(9)}/" for _ in range(3000)]
    rules = [(rng.choice(["allow", "block"]), f"h{k}.example.com/p{rng.randrange(9)}/") for k in range(300)]
    wrong = [None, "", "no scheme", "http://", "HTTP://H1.Example.COM", "x://y?z/://h", "http://h1.example.com/p1/#a"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls + wrong)], "page_id long, url string, host string")
    table = dict((r, v) for v, r in rules)
    for r in urlfilter.judged(df, rules).collect():
        key = f"{r['host']}{r['path']}"
        assert r["rule"] == (key if key in table else None) and r["verdict"] == table.get(key, "allow")
    assert urlfilter.judged(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judged(df, [], "block").collect()} == {"block"}
    want = Counter(map(tuple, urlfilter.judged(df, rules).collect()))
    monkeypatch.setattr(urlfilter, "MOST_RULES", -1)  # a cascade for each part of the keys, with the same rows
    monkeypatch.setattr(urlfilter, "PART_RULES", 40)
    for listed in (rules, []):
        assert Counter(map(tuple, urlfilter.judged(df, listed).collect())) == (want if listed else Counter((k, *urlfilter.parts_of(u), None, "allow") for k, u in enumerate(urls + wrong)))
    table = spark.createDataFrame([*rules, rules[0], ("allow", None)], "verdict string, rule string")
    assert Counter(map(tuple, urlfilter.judged(df, table).collect())) == want
    with pytest.raises(ValueError):
        urlfilter.judged(df, table.union(spark.createDataFrame([("block", "x.com/"), ("allow", "x.com/")], table.schema)))
    assert urlfilter.judged(df.limit(0), rules).count() == 0
    assert urlfilter.parts_of("x://Y.z?q") == ("y.z", "")


# 7
def test_bpe_equals_the_library(docs, hard, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, hard):
        rows = bpe.codec_digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        want = Counter()
        for d, t in text_rows(df):
            ids = codec.encode_ordinary(t)
            want[d, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in rows) == want
    assert bpe.codec_digests(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    ids = bpe.encoded(hard, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert ids.where("size(ids) = 0").count() == 2 and ids.count() == hard.count() and ids.columns == [*hard.columns, "ids"]
    assert bpe.encoded(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [P.PATTERN, r"\p{L}{1,3}|\p{N}|\s+|[^\s\p{L}\p{N}]+"])
def test_bpe_of_odd_texts_and_patterns(pattern):
    import base64

    import tiktoken

    assert bpe.KNOWN_PATTERN == P.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain, own, texts = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.TwoTier(P.path("byte_bpe_50k.tiktoken"), pattern), odd_texts(3000, 8)
    ids, ends = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends.tolist(), ends[1:].tolist())] == [plain.encode_ordinary(t) for t in texts]
    assert [bytes(x).decode() for x in own.decode(ids, ends)] == texts


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(5000)) and all(table.get(k) == i for i, k in enumerate(keys))
    assert table.get(b"other") == -1


# 8
def test_media_round_trip(spark, docs, hard, empty):
    for df in (docs, hard):
        want = Counter()
        for d, t in text_rows(df):
            data = t.encode()
            payload = data + b"\xff" * (576 - len(data) if len(data) < 576 else -len(data) % 576)
            image = media.png(payload)
            want[d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(np.frombuffer(payload, np.uint8).reshape(-1, 576))] += 1
        assert Counter(tuple(r) for r in media.media_features(df).collect()) == want
    assert media.media_features(empty).count() == 0


def plain_pixels(image):
    """Another reader of 8-bit grey PNG images: by the format's rules, all five filters."""
    import struct

    at, data, width = 8, b"", 0
    while image[at + 4 : at + 8] != b"IEND":
        (size,) = struct.unpack(">I", image[at : at + 4])
        body = image[at + 8 : at + 8 + size]
        if image[at + 4 : at + 8] == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            assert (depth, colour) == (8, 0)
        elif image[at + 4 : at + 8] == b"IDAT":
            data += body
        at += 12 + size
    raw, rows, before = zlib.decompress(data), [], [0] * width
    for y in range(height):
        kind, line = raw[y * (width + 1)], list(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, before[x], before[x - 1] if x else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))
            line[x] = (line[x] + (0, a, b, (a + b) // 2, paeth)[kind]) % 256
        rows.append(line)
        before = line
    return rows


def plain_feature(rows):
    n, flat = len(rows), [v for row in rows for v in row]
    cells = []
    for k in range(8):
        band = rows[n * k // 8 : max(n * k // 8 + 1, n * (k + 1) // 8)]
        cells += [sum(sum(row[72 * c : 72 * c + 72]) for row in band) / (72 * len(band)) for c in range(8)]
    mean = sum(flat) / len(flat)
    bits = "".join("1" if x > sum(cells) / 64 + 1e-9 else "0" for x in cells)
    spread = (sum((v - mean) ** 2 for v in flat) / len(flat)) ** 0.5
    shares = [1000 * sum(v // 64 == q for v in flat) // len(flat) for q in range(4)]
    return int(bits, 2), mean, spread, shares


def test_media_by_another_reader(spark, docs, tmp_path):
    few = docs.orderBy("doc_id").limit(25)
    folder = f"file://{tmp_path}/own"
    media.write_archives(few, folder)
    stored = {r["doc_id"]: r["media"] for r in media.read_archives(spark, folder).collect()}
    found = {r["doc_id"]: r for r in media.media_features(few).collect()}
    for d, t in text_rows(few):
        rows = plain_pixels(stored[d])
        payload = bytes(v for row in rows for v in row)
        assert payload.rstrip(b"\xff") == t.encode() and len(payload) % 576 == 0 and len(rows[0]) == 576
        assert (found[d]["media_bytes"], found[d]["media_sha256"], found[d]["payload_sha256"]) == (len(stored[d]), hashlib.sha256(stored[d]).hexdigest(), hashlib.sha256(payload).hexdigest())
        bits, mean, spread, shares = found[d]["feature"].split(":")
        want = plain_feature(rows)
        assert int(bits, 16) == want[0] and float(mean) == pytest.approx(want[1], abs=1e-3) and float(spread) == pytest.approx(want[2], abs=1e-3)
        assert list(map(int, shares.split(","))) == want[3]


def test_media_ranges_and_retries(docs, tmp_path):
    folder = f"file://{tmp_path}/archives"
    media.write_archives(docs, folder)
    (tmp_path / "archives" / "part-009999-0000.zip").write_bytes(b"of a lost attempt, not in the committed list")
    assert sum(b.num_rows for p in media.ArchiveReader({"path": folder}).partitions() for b in media.ArchiveReader({"path": folder}).read(p)) == docs.count()
    reader = media.ArchiveReader({"path": folder, "rangeBytes": 50_000})
    parts = reader.partitions()
    assert len(parts) > 2
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == docs.count()
    broken = Counter()
    plain = base.Files.open

    def flaky(self, name):
        broken[name] += 1
        if broken[name] % 3 == 2:
            raise OSError("lost")
        return plain(self, name)

    base.Files.open = flaky
    try:
        assert sum(b.num_rows for p in parts[:1] for b in reader.read(p)) > 0
    finally:
        base.Files.open = plain
    path = next((tmp_path / "archives").glob("part-000000*.zip"))
    data = bytearray(path.read_bytes())
    data[200] ^= 255
    path.write_bytes(data)
    with pytest.raises(RuntimeError, match="checksum"):
        list(reader.read(parts[0]))


# 9
def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + WORDS5]) for i in range(max(1, len(words) - WORDS5 + 1))} if words else set()


def brute_classes(rows, similar=0.8):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= similar * max(len(sets[i]), len(sets[j])):
                n = len(sets[i] & sets[j])
                if n >= similar * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (d is None, d or 0))
    return Counter((d, None if least[root(i)][0] else least[root(i)][1], links[i]) for i, (d, _) in enumerate(rows))


def test_join_equals_brute_force(spark, docs, hard, empty):
    assert Counter(tuple(r) for r in similarity.similarity_classes(hard).collect()) == brute_classes(text_rows(hard))
    assert Counter(tuple(r) for r in similarity.similarity_classes(docs).collect()) == brute_classes(text_rows(docs))
    assert similarity.similarity_classes(empty).count() == 0


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL", 8)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng, rows = random.Random(4), []
    stem = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(150):
        own = list(stem)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for k in range(50)]
    got = {r["doc_id"]: tuple(r)[1:] for r in similarity.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: (c, n) for d, c, n in brute_classes(rows)}
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, (c, _) in want.items()}
    assert sum(n for _, n in got.values()) >= 0.999 * sum(n for _, n in want.values())
    assert all(got[d][1] <= want[d][1] for d in got)
    kept = similarity.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _ in want.values()}


def test_hot_keys_join_like_others(spark, monkeypatch):
    keys = [1] * 40 + [2] * 9 + list(range(3, 30))
    rows, _ = base.written(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long"), "t")
    facts, _ = base.written(rows.groupBy("k").count().where("count > 1"), "t")
    for share in (1, 3, 12, 1000):  # none, one, two and all keys are hot
        monkeypatch.setattr(base, "HOT_SHARE", share)
        got = base.join_counted(rows, facts, "k", "count").collect()
        assert Counter(map(tuple, got)) == Counter((k, i, keys.count(k)) for i, k in enumerate(keys) if k < 3)


def test_runs_share_no_function():
    path = np.arange(100, dtype=np.uint64)
    used = [set(similarity.position(r, k, path).tolist()) for r in range(similarity.runs_for(similarity.DEPTH)) for k in range(similarity.DEPTH)]
    assert sum(map(len, used)) == len(set().union(*used)) and max(set().union(*used)) < similarity.HASHES


def test_recall_over_a_thousand_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, got = brute_classes(text_rows(df)), Counter(tuple(r) for r in similarity.similarity_classes(df).collect())
    links = lambda rows: sum(n * k for (_, _, n), k in rows.items())
    assert links(got) >= 0.999 * links(want)
    assert Counter((d, c) for d, c, _ in got.elements()) == Counter((d, c) for d, c, _ in want.elements())


@pytest.mark.parametrize("most", [0, 10**6])
def test_stages_over_hard_and_empty_tables(spark, hard, empty, monkeypatch, most):
    """With few ids broadcast, and with every partition's ids in a file of its own."""
    monkeypatch.setattr(base, "BROADCAST_IDS", most)
    rows = text_rows(hard)
    kept = similarity.one_of_each(hard)
    assert kept.columns == hard.columns and similarity.one_of_each(empty).count() == 0
    heads = {c for _, c, _ in brute_classes([(d, t) for d, t in rows if shingles(t)]) if c is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted([*heads, *(d for d, t in rows if d is not None and not shingles(t))])
    unique = dedup.without_duplicates(hard)
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t) for _, t in rows]
    assert unique.columns == hard.columns and unique.count() == len(set(norm))
    assert sorted(re.sub("[\x20\x09-\x0d]+", " ", t) for _, t in text_rows(unique)) == sorted(set(norm))
    assert dedup.without_duplicates(empty).count() == 0
    assert pii.masked(empty).count() == 0 and pii.masked(empty).columns == empty.columns


def test_pipeline_over_hard_and_empty_tables(spark, hard, empty, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for name, df in (("hard", hard), ("empty", empty)):
        folder = f"file://{tmp_path}/{name}"
        df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() == 0) == (name == "empty")


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": lambda self, k, d=None: d})()
        sparkContext = type("S", (), {"master": "spark://x:7077", "getConf": lambda self: {}})()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        base.scratch_root(Elsewhere())


def test_runs_reach_the_target():
    assert [similarity.runs_for(d) for d in (1, 2, 3)] == [5, 7, 10]


def test_depth_counts_splits_without_a_leaf(spark):
    m = similarity.SMALL + 12
    low = np.arange(m * similarity.HASHES, dtype=np.uint32).reshape(m, similarity.HASHES)
    low[:, int(similarity.position(0, 0, similarity.mixed(np.array([1], np.uint64)))[0])] = 5  # all choose this one first in run 0
    nodes = spark.createDataFrame([(k, bytearray(low[k].tobytes())) for k in range(m)], "uid long, low binary")
    found, depth = similarity._leaves(nodes, 0, 1)
    assert found.count() == 0 and depth == 2


# 10
def test_exact_dedup_equals_sql(spark):
    same(registry.op10_exact_dedup(spark, "/root/testdata/sf0.01"), dedup.ORACLE_SQL, documents="/root/testdata/sf0.01/documents.parquet")


def test_exact_dedup_hard_rows(spark, hard, empty):
    def norm(t):
        return re.sub("[\x20\x09-\x0d]+", " ", t)

    for width in (16, 1):  # with identifiers of one byte, chunks collide and longer ones are taken
        rows = dedup.exact_duplicates(hard, width).collect()
        groups = defaultdict(list)
        for d, t in text_rows(hard):
            groups[norm(t)].append(d)
        want = Counter()
        for t, own in groups.items():
            keep = min((d for d in own if d is not None), default=None)
            for d in own:
                want[d, keep, len(own), hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
        assert sum(r["kept"] for r in rows) == len(groups)
    assert dedup.exact_duplicates(empty).count() == 0
    kept = dedup.without_duplicates(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)


def test_chunks_are_content_defined():
    rng = random.Random(9)
    data = bytes(rng.randrange(97, 123) for _ in range(200_000))
    parts = dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= dedup.LARGEST and min(map(len, parts[:-1])) >= dedup.SMALLEST
    moved = dedup.chunks(b"inserted" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert dedup.chunks(b"") == []


# pipeline
def test_pipeline_stages_are_brute_force_filters(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    left = {d: t for d, t in text_rows(docs) if d not in bad}
    stage = dict(corpus_pipeline.STAGES)
    out, _ = base.written(stage["toxicity"](spark, docs, sf), "t")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(left)
    first = {}
    for d in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[d]), d)
    out, _ = base.written(stage["exact_dedup"](spark, out, sf), "t")
    left = {d: left[d] for d in first.values()}
    assert {r["doc_id"] for r in out.collect()} == set(left)
    out, _ = base.written(stage["jaccard_join"](spark, out, sf), "t")
    left = {c: left[c] for _, c, _ in brute_classes(sorted(left.items()))}
    assert {r["doc_id"] for r in out.collect()} == set(left)
    out, _ = base.written(stage["pii"](spark, out, sf), "t")
    assert out.columns == docs.columns and out.where(F.col("n_chars") != F.length("text")).count() == 0
    assert all(not plain_spans(r["text"]) for r in out.collect())
    assert out.count() == len(left)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(left)
