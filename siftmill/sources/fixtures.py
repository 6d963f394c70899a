"""Engine tables derived from the supplied ones, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..functions.urls import host
from ..operators import faqs as faq_ops

EPOCH = 1704067200  # 2024-01-01
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_uuid5(expr: str, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> str:
    h = f"sha1(unhex('{namespace}') || encode({expr}))"
    variant = f"substr('89ab', ((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4)::int + 1, 1)"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{variant}||substr({h},18,3)||'-'||substr({h},21,12))"


def texts(spark, d):
    """Documents as stored pages: n, doc_id, url, content, title, domain, indexed (seconds), indexed_at."""
    n = F.col("doc_id")
    t = table(spark, d, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), n.cast("string"), F.when(n % 10 == 0, ".pdf").otherwise(".html"))
    seconds = F.when(n % 97 != 0, F.lit(EPOCH) + n * 3600)
    return t.select(
        n.alias("n"), n.cast("string").alias("doc_id"), url.alias("url"), F.col("text").alias("content"), F.substring("text", 1, 30).alias("title"),
        F.when(n % 5 != 0, F.concat("source", F.lit(".example.com"))).alias("domain"), F.lit(None).cast("array<string>").alias("hyperlinks"),
        seconds.alias("indexed"), F.timestamp_seconds(seconds).alias("indexed_at"), "lang", "source", "n_chars",
    )


TEXTS = f"""texts as (select doc_id as n, doc_id::varchar as doc_id, 'https://'||source||'.example.com/'||lang||'/'||doc_id||case when doc_id % 10 = 0 then '.pdf' else '.html' end as url,
 text as content, substr(text, 1, 30) as title, case when doc_id % 5 <> 0 then source||'.example.com' end as domain,
 case when doc_id % 97 <> 0 then {EPOCH} + doc_id * 3600 end as indexed, lang, source, n_chars from documents)"""


def web(spark, d):
    """Pages with synthetic links between them."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("n"), "url", "html")
    total = p.agg(F.count("*").alias("total"))
    own = p.crossJoin(F.broadcast(total))
    to = lambda c: p.select(F.col("n").alias(f"{c}_n"), F.col("url").alias(c))
    own = own.join(to("a"), F.col("a_n") == (F.col("n") * 7 + 1) % F.col("total")).join(to("b"), F.col("b_n") == (F.col("n") * 13 + 5) % F.col("total"))
    links = F.array(F.when(F.col("n") % 3 == 0, F.concat("a", F.lit("#s"))).otherwise(F.col("a")), F.col("b"), F.concat(F.lit("https://external.example.net/"), F.col("n").cast("string")))
    seconds = F.lit(EPOCH) + F.col("n") * 3600
    return own.select(
        "n", document_id(F.col("url")).alias("doc_id"), "url", F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("content"),
        F.when(F.col("n") % 5 != 0, host(F.col("url"))).alias("domain"), links.alias("hyperlinks"), seconds.alias("indexed"), F.timestamp_seconds(seconds).alias("indexed_at"),
    )


SQL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)', 1))"
WEB = f"""web as (select p.page_id as n, {sql_uuid5('p.url')} as doc_id, p.url, regexp_extract(p.html, '(?i)<title>([^<]*)</title>', 1) as title, regexp_replace(p.html, '<[^>]*>', ' ', 'g') as content,
 case when p.page_id % 5 <> 0 then {SQL_HOST.replace('url', 'p.url')} end as domain,
 [case when p.page_id % 3 = 0 then a.url||'#s' else a.url end, b.url, 'https://external.example.net/'||p.page_id] as hyperlinks, {EPOCH} + p.page_id * 3600 as indexed
 from pages p join pages a on a.page_id = (p.page_id * 7 + 1) % (select count(*) from pages) join pages b on b.page_id = (p.page_id * 13 + 5) % (select count(*) from pages))"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"), "label")


def tokens(spark, d):
    """Ten vectors a document: doc_id, dense (the first), late (all)."""
    e = table(spark, d, "embeddings")
    own = e.groupBy(F.expr("vec_id div 10").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    return own.select("doc_id", F.col("v")[0]["embedding"].alias("dense"), F.col("v.embedding").alias("late"))


VECTORS = "vectors as (select vec_id as doc_id, embedding::double[] as dense, label from embeddings), q as (select embedding::double[] as dense from embeddings where vec_id = 0)"
TOKENS = """tok as (select vec_id // 10 as doc_id, vec_id, embedding::double[] as v from embeddings), qt as (select vec_id as q, embedding::double[] as v from embeddings where vec_id < 4), q as (select embedding::double[] as dense from embeddings where vec_id = 0),
 late as (select doc_id, sum(best) as score from (select t.doc_id, qt.q, max(list_inner_product(t.v, qt.v)) as best from tok t, qt group by all) group by doc_id),
 dense as (select t.doc_id, list_inner_product(t.v, q.dense) as score from tok t, q where t.vec_id % 10 = 0)"""


def query_vectors(spark, d):
    """The encoded query of all examples: four vectors, the first also as dense."""
    from ..operators.search import Vectors

    rows = table(spark, d, "embeddings").where("vec_id < 4").orderBy("vec_id").collect()
    return Vectors([float(x) for x in rows[0]["embedding"]], [[float(x) for x in r["embedding"]] for r in rows])


def pairs(spark, d):
    """Question and answer turns, one row a source: conv_id, turn, question, answer, document_id, url, confidence, extracted_at."""
    c = table(spark, d, "conversations")
    total = table(spark, d, "documents").agg(F.count("*").alias("total"))
    q, a = c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    own = q.join(a, ["conv_id", "turn"]).crossJoin(F.broadcast(total))
    sources = F.when(F.col("conv_id") % 2 == 0, F.array(F.col("conv_id") % F.col("total"), (F.col("conv_id") * 3 + 1) % F.col("total"))).otherwise(F.array(F.col("conv_id") % F.col("total")))
    rows = own.select("conv_id", "turn", F.col("text").alias("question"), "answer", F.explode(F.array_distinct(sources)).alias("k"))
    return rows.select("conv_id", "turn", "question", "answer", F.col("k").cast("string").alias("document_id"), F.concat(F.lit("https://docs.example.com/"), F.col("k").cast("string")).alias("url"), (F.lit(0.5) + (F.col("turn") % 5) / 10).alias("confidence"), F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("extracted_at"))


PAIRS = """pairs as (select conv_id, turn, question, answer, k::varchar as document_id, 'https://docs.example.com/'||k as url, 0.5::double + (turn % 5)::double / 10 as confidence, lpad(conv_id::varchar, 9, '0')||'-'||lpad(turn::varchar, 4, '0') as extracted_at
 from (select distinct q.conv_id, q.turn, q.text as question, a.text as answer, unnest(case when q.conv_id % 2 = 0 then [q.conv_id % n.total, (q.conv_id * 3 + 1) % n.total] else [q.conv_id % n.total] end) as k
 from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role = 'assistant' and q.role = 'user', (select count(*) as total from documents) n))"""
_COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
FAQ_ROWS = f"""{PAIRS}, ids as (select *, {sql_uuid5(_COLLAPSED.format('question') + "||'|'||" + _COLLAPSED.format('answer'), 'a1b2c3d4e5f67890abcdef1234567890')} as faq_id, md5(lower(trim(question))) as question_hash from pairs),
 src as (select faq_id, document_id, arg_max(url, extracted_at) as url, max(extracted_at) as extracted_at, arg_max(confidence, extracted_at) as confidence from ids group by 1, 2)"""


def faq_rows(spark, d):
    return faq_ops.identified(pairs(spark, d))


def faqs(spark, d):
    return faq_ops.merged(faq_rows(spark, d)).withColumn("document_id", F.col("source_documents")[0]["document_id"])


def feedback(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.col("doc_id")
    return t.select(
        n.alias("id"), F.col("lang").alias("query"), F.sha2("text", 256).alias("text"), (F.col("n_chars") % 100 / 100).alias("search_score"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality") == 0, -1).otherwise(0).alias("user_rating"),
        F.when(n % 2 == 0, n % 5 + 1).cast("int").alias("ranking_score"), F.when(n % 11 != 0, F.col("source")).alias("rating_session_id"),
        F.when(n % 2 == 0, "faq").otherwise("document").alias("content_type"), n.alias("created_at"),
    )


FEEDBACK = """feedback as (select doc_id as id, lang as query, sha256(text) as text, (n_chars % 100)::double / 100 as search_score, case when quality = 1 and toxic = 0 then 1 when quality = 0 then -1 else 0 end as user_rating,
 case when doc_id % 2 = 0 then (doc_id % 5 + 1)::int end as ranking_score, case when doc_id % 11 <> 0 then source end as rating_session_id, case when doc_id % 2 = 0 then 'faq' else 'document' end as content_type, doc_id as created_at
 from documents join labels using (doc_id))"""


def queue(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    at = F.col("conv_id") * 1000 + F.col("turn")
    rows = c.select(F.concat(F.lit("q"), at.cast("string")).alias("id"), F.col("text").alias("query"), F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("collection_name"), at.alias("created_at"))
    again = rows.select(F.concat(F.col("id"), F.lit("u")).alias("id"), F.translate("query", _LOWER, _LOWER.upper()).alias("query"), "collection_name", (F.col("created_at") + 1_000_000_000).alias("created_at"))
    return rows.unionByName(again)


QUEUE = """queue0 as (select 'q'||(conv_id * 1000 + turn) as id, text as query, 'c'||(conv_id % 3) as collection_name, conv_id * 1000 + turn as created_at from conversations where role = 'user'),
 queue as (select * from queue0 union all select id||'u', translate(query, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), collection_name, created_at + 1000000000 from queue0)"""


def kv_writes(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(F.expr("p_partkey div 3").cast("bigint").alias("id"), (p % 3).cast("bigint").alias("at"), F.col("p_name").alias("key"), F.col("p_brand").alias("value"))
