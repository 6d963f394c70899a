"""One query for each operator over the supplied tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import ids, language, matching, text, urls, vectors
from .operators import agent, faqs, feedback, graph, health, ingest, many, migrate, queues, retention, search
from .plans import predicates, querylang
from .sources import embedding, vectorindex
from .sources import fixtures as fx

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
NOW = fx.EPOCH + 40 * 86400


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _now():
    return F.timestamp_seconds(F.lit(NOW))


def _r(c, n: int = 6):
    return F.round(c, n)


# scans and mutations


@query("select doc_id, source, n_chars from documents")
def projected_scan(s, d):
    return fx.table(s, d, "documents").select("doc_id", "source", "n_chars")


@query("select doc_id from documents order by doc_id limit 50")
def seed_ids(s, d):
    return ingest.seed_ids(fx.table(s, d, "documents"), 50)


@query("select doc_id, lang from documents where doc_id in (3, 5, 7, 99999999)")
def point_lookup(s, d):
    return ingest.by_ids(fx.table(s, d, "documents"), [3, 5, 7, 99999999]).select("doc_id", "lang")


@query("select doc_id, source from documents where doc_id > 40 and lang = 'en' order by doc_id limit 10")
def keyset_page(s, d):
    return ingest.page(fx.table(s, d, "documents"), 40, 10, F.col("lang") == "en").select("doc_id", "source")


@query("select count(*) as n from documents where lang = 'fr'")
def filtered_count(s, d):
    return ingest.count_of(fx.table(s, d, "documents"), F.col("lang") == "fr")


@query("select id, max(k) as \"at\", arg_max(key, k) as key, arg_max(value, k) as value from (select p_partkey // 3 as id, p_partkey % 3 as k, p_name as key, p_brand as value from part) group by id")
def upsert_latest(s, d):
    return ingest.latest(fx.kv_writes(s, d), ["id"], "at")


@query("select doc_id, case when doc_id % 3 = 0 then 'xx' else lang end as lang, source from documents")
def set_fields(s, d):
    t = fx.table(s, d, "documents").select("doc_id", "lang", "source")
    return ingest.with_fields(t, t.where("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang")), "doc_id")


@query("select doc_id, case when doc_id % 4 = 0 then 'new' else source end as source from documents union all select 1000000000, 'added'")
def upsert_by_key(s, d):
    t = fx.table(s, d, "documents").select("doc_id", "source")
    changes = t.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("source")).unionByName(s.range(1).select(F.lit(1000000000).cast("bigint").alias("doc_id"), F.lit("added").alias("source")))
    return ingest.upserted(t, changes, ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def delete_anti(s, d):
    return ingest.without_ids(fx.table(s, d, "documents"), fx.table(s, d, "labels")).select("doc_id")


@query("select doc_id from documents where not (source = 'src3' and n_chars > 500)")
def delete_by_filter(s, d):
    return ingest.without_matching(fx.table(s, d, "documents"), predicates.compiled({"must": [{"key": "source", "match": {"value": "src3"}}, {"key": "n_chars", "range": {"gt": 500}}]})).select("doc_id")


_COUNTS = "select 'documents' as name, count(*) as points from documents union all select 'pages', count(*) from pages union all select 'kv_part', count(*) from part union all select 'chat_faq', count(*) from conversations union all select 'docs_migration_20240101_000000', count(*) from labels union all select 'old_migration_20230101_000000', count(*) from benchmark union all select 'notes_feedback', count(*) from labels"


def _collections(s, d):
    named = (("documents", "documents"), ("pages", "pages"), ("kv_part", "part"), ("chat_faq", "conversations"), ("docs_migration_20240101_000000", "labels"), ("old_migration_20230101_000000", "benchmark"), ("notes_feedback", "labels"))
    out = None
    for name, t in named:
        one = fx.table(s, d, t).agg(F.count("*").alias("points")).select(F.lit(name).alias("name"), "points")
        out = one if out is None else out.unionByName(one)
    return out


def _aliases(s):
    return s.range(1).select(F.lit("docs").alias("alias"), F.lit("docs_migration_20240101_000000").alias("collection"))


@query(_COUNTS)
def collection_counts(s, d):
    return _collections(s, d)


@query(f"select substr(name, 4) as name, points from ({_COUNTS}) where name like 'kv\\_%' escape '\\'")
def kv_collections(s, d):
    return queues.kv_collections(_collections(s, d))


@query(f"select name, points from ({_COUNTS}) where name in ('documents', 'pages')")
def primary_collections(s, d):
    return queues.primary(_collections(s, d))


@query(f"select count(*) as collections, sum(case when name <> 'chat_faq' then points end)::bigint as documents, sum(case when name = 'chat_faq' then points end)::bigint as faqs from ({_COUNTS})")
def admin_stats(s, d):
    return queues.totals_by_kind(queues.admin_statistics(_collections(s, d), _aliases(s)))


@query("select unnest(['documents', 'pages', 'kv_part', 'chat_faq', 'docs']) as name")
def collections_to_process(s, d):
    return migrate.collections_to_process(_collections(s, d), _aliases(s))


@query("select 'c' || d.doc_id as name, case when l.doc_id is not null and l.doc_id % 3 = 0 then 'c' || l.doc_id || '_migration_2024' else 'c' || d.doc_id end as backing from documents d left join labels l using (doc_id)")
def alias_resolution(s, d):
    """A name for every document; every third label is an alias."""
    names = fx.table(s, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("name"))
    alias = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    return migrate.resolved(names, fx.table(s, d, "labels").where("doc_id % 3 = 0").select(alias.alias("alias"), F.concat(alias, F.lit("_migration_2024")).alias("collection")))


# ingestion

_NORM = "lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))"
_WORDS = "len(regexp_extract_all(content, '[\\p{L}\\p{N}\\p{M}_]+'))"


@query("select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+'))::bigint as words from documents")
def word_count(s, d):
    return fx.table(s, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("words"))


@query("select doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as content_hash from documents")
def content_hash(s, d):
    return fx.table(s, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"select page_id, {fx.sql_uuid5('url')} as id from pages")
def url_to_id(s, d):
    return fx.table(s, d, "pages").select("page_id", ids.document_id(F.col("url")).alias("id"))


@query(f"with {fx.FAQ_ROWS} select conv_id, turn, document_id, faq_id, question_hash from ids")
def faq_id(s, d):
    return fx.faq_rows(s, d).select("conv_id", "turn", "document_id", "faq_id", "question_hash")


_STATUS = f"""{fx.TEXTS}, h as (select *, {fx.sql_uuid5('url')} as uid, sha256({_NORM}) as ch, {_WORDS} as w from texts),
 first as (select ch, arg_min(uid, n) as uid0, arg_min(url, n) as url0 from h where w >= 32 group by ch),
 st as (select h.n, case when trim(content) = '' then 'empty' when w < 32 then 'content_too_short' when uid0 <> uid then 'duplicate_content' else 'stored' end as status, h.url, url0 from h left join first using (ch))"""


def _incoming(s, d):
    return fx.texts(s, d).select("n", "url", "content", F.col("n").alias("arrival"))


def _statuses(s, d):
    return ingest.with_status(_incoming(s, d), _now())


@query(f"with {_STATUS} select n, status, case when status = 'duplicate_content' then url0 end as duplicate_of from st")
def ingest_dedup(s, d):
    return _statuses(s, d).select("n", "status", "duplicate_of")


@query(f"with {_STATUS} select status, count(*) as n from st group by status")
def ingest_status_counts(s, d):
    return _statuses(s, d).groupBy("status").agg(F.count("*").alias("n"))


_AGAINST = f"""{fx.TEXTS}, st as (select {fx.sql_uuid5('url')} as uid, url, sha256({_NORM}) as ch from texts where n % 3 = 0 and {_WORDS} >= 32),
 raw as (select n, case when n % 5 = 0 then url || '?v=2' else url end as url, case when n % 7 = 0 then content || ' and more' else content end as content from texts),
 i as (select n, url, {fx.sql_uuid5('url')} as uid, sha256({_NORM}) as ch, case when trim(content) = '' then 'empty' when {_WORDS} < 32 then 'content_too_short' end as early from raw),
 hold as (select ch, min(uid) as huid, arg_min(url, uid) as hurl from st group by ch),
 rel as (select st.uid, min(i.n) as until from st join i on i.uid = st.uid and i.early is null and i.ch <> st.ch group by 1),
 p as (select i.*, st.ch as own, st.uid is not null as known, case when i.early is null and hold.huid <> i.uid and st.ch is distinct from i.ch and (rel.until is null or rel.until > i.n) then hurl end as held
  from i left join hold on hold.ch = i.ch left join rel on rel.uid = hold.huid left join st on st.uid = i.uid),
 f as (select ch, arg_min(uid, n) as uid0, arg_min(url, n) as url0 from p where early is null and held is null group by ch),
 a as (select p.*, case when early is null and held is null and own is distinct from p.ch and uid0 <> uid then url0 end as later from p left join f using (ch)),
 st2 as (select n, uid, case when early is not null then early when held is not null or later is not null then 'duplicate_content' when known then 'refreshed' else 'stored' end as status, coalesce(held, later) as duplicate_of from a)"""


def _against(s, d):
    """A collection of every third text, and a batch of all texts: one in five under a new url, one in seven with more content."""
    t, n = fx.texts(s, d), F.col("n")
    stored = ingest.stamped(t.where("n % 3 = 0").select("n", "url", "content"), _now()).where("words >= 32").select("doc_id", "url", "content_hash")
    url, content = F.when(n % 5 == 0, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url")), F.when(n % 7 == 0, F.concat("content", F.lit(" and more"))).otherwise(F.col("content"))
    return stored, t.select("n", url.alias("url"), content.alias("content"), n.alias("arrival"))


@query(f"with {_AGAINST} select n, status, duplicate_of from st2")
def ingest_against_stored(s, d):
    """What becomes of a batch beside what the collection already has."""
    stored, batch = _against(s, d)
    return ingest.with_status(batch, _now(), stored=stored).select("n", "status", "duplicate_of")


@query(f"with {_AGAINST} select max(n) as n, uid as doc_id from st2 where status in ('stored', 'refreshed') group by uid")
def ingest_kept_against_stored(s, d):
    stored, batch = _against(s, d)
    return ingest.kept(batch, ingest.with_status(batch, _now(), stored=stored)).select("n", "doc_id")


@query("select doc_id, nullif(regexp_replace(regexp_replace(trim(regexp_extract(h, '^#{1,6}\\s+(.+)$', 1)), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_`]', '', 'g'), '') as heading from (select doc_id, list_filter(list_transform(string_split(case when doc_id % 2 = 0 then 'intro' || chr(10) || '## *' || substr(text, 1, 12) || '* [x](y)' || chr(10) || text else replace(text, ' ', chr(10) || '# ') end, chr(10))[1:50], lambda x: trim(x)), lambda x: regexp_matches(x, '^#{1,6}\\s+\\S'))[1] as h from documents)")
def title_extract(s, d):
    """Every other text under a heading with marks; in the rest each word but the first of a line is one."""
    t = fx.table(s, d, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n## *"), F.substring("text", 1, 12), F.lit("* [x](y)\n"), "text")).otherwise(F.replace("text", F.lit(" "), F.lit("\n# ")))
    return t.select("doc_id", text.heading(body).alias("heading"))


@query("select doc_id, length(case when tight = '' then cut else tight end)::bigint as kept, whole = '' or not regexp_matches(whole, '\\s$') as ends_well from (select doc_id, cut, regexp_replace(cut, '\\s+$', '') as tight, regexp_replace(whole, '\\s+$', '') as whole from (select doc_id, substr(t, 1, 500) as cut, t as whole from (select doc_id, text || case when doc_id % 3 = 0 then '  ' || chr(10) else '' end as t from documents)))")
def embedding_truncation(s, d):
    """Texts cut at 500, and whole ones; every third has white space at its end."""
    t = fx.table(s, d, "documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "  \n").otherwise("")))
    return t.select("doc_id", F.length(text.embedded_part(F.col("text"), 500)).cast("bigint").alias("kept"), (~text.embedded_part(F.col("text"), 10**7).rlike(r"\s\z")).alias("ends_well"))


@query("select vec_id, len(embedding) // 16 as n, round(embedding[17]::double, 6) as second_first from embeddings")
def multivector_reshape(s, d):
    v = text.token_vectors(F.col("embedding"), 16)
    return fx.table(s, d, "embeddings").select("vec_id", F.size(v).cast("bigint").alias("n"), _r(v[1][0].cast("double")).alias("second_first"))


@query("select doc_id, 'Key: ' || source || chr(10) || 'Value: ' || lang as t from documents")
def kv_text(s, d):
    return fx.table(s, d, "documents").select("doc_id", text.kv_text(F.col("source"), F.col("lang")).alias("t"))


# urls


@query("""with p as (select page_id, url, split_part(url, '#', 1) as bare from pages), v as (select page_id, bare, 'http' || substr(url, 5) as u from p)
 select page_id, url, split_part(url, '#', 1) as without_fragment, replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+')), 'x', 'x') || regexp_replace(split_part(url, '#', 1), '^[a-z]+://[^/?#]+', '') as lowered from pages""")
def url_variants(s, d):
    v = urls.variants(F.col("url"))
    low = F.filter(v, lambda x: ~x.contains("#"))[0]
    return fx.table(s, d, "pages").select("page_id", "url", F.split_part("url", F.lit("#"), F.lit(1)).alias("without_fragment"), low.alias("lowered"))


_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\\?[^#]*)?(#.*)?$"
_URL_PARTS = ", ".join(f"regexp_extract(url, '{_URL}', {k}) as {c}" for k, c in enumerate("shpqf", 1))
_URL_FORMS = """[url, case when h <> '' then lower(s) || '://' || lower(h) || p || q end, case when h <> '' and f <> '' then s || '://' || h || p || q end,
 case when h <> '' and ends_with(p, '/') and p <> '/' then s || '://' || h || rtrim(p, '/') || q when h <> '' and p <> '' and not ends_with(p, '/') and q = '' then s || '://' || h || p || '/' end,
 case when ends_with(url, '/') and url <> '/' then rtrim(url, '/') end]"""


@query(f"""with w as (select distinct case page_id % 4 when 0 then 'HTTPS' || substr(url, strpos(url, ':')) when 1 then url || '#zz' when 2 then url || '/' else url end as url from pages),
 f as (select url, unnest({_URL_FORMS}) as form, unnest([1, 2, 3, 4, 5]) as k from (select url, {_URL_PARTS} from w)),
 best as (select f.url, arg_min(stored.url, k) as matched_url from f join (select distinct url from pages) stored on stored.url = f.form where f.form <> '' group by f.url)
 select url, {fx.sql_uuid5('matched_url')} as doc_id, matched_url from best""")
def url_variants_resolve(s, d):
    """Urls of all pages with an upper-case scheme, a fragment, a slash or nothing more, among the stored ones."""
    n, url = F.col("page_id"), F.col("url")
    pages = fx.table(s, d, "pages")
    wanted = F.when(n % 4 == 0, F.concat(F.lit("HTTPS"), F.expr("substring(url, instr(url, ':'))"))).when(n % 4 == 1, F.concat(url, F.lit("#zz"))).when(n % 4 == 2, F.concat(url, F.lit("/"))).otherwise(url)
    return urls.resolved(pages.select(wanted.alias("url")), pages.select(ids.document_id(url).alias("doc_id"), "url"))


@query(f"with {fx.WEB} select n from web where regexp_replace(coalesce(nullif(domain, ''), {fx.SQL_HOST}), '^www\\.', '') in ('example.org') or ends_with(coalesce(nullif(domain, ''), {fx.SQL_HOST}), '.example.org')")
def allowed_domains_semi(s, d):
    web = fx.web(s, d)
    return web.join(urls.allowed_documents(web, ["https://www.Example.org:443/x"]), "doc_id", "left_semi").select("n")


@query("select page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '\\.([^./]+)$', 1)) as filetype from pages")
def filetypes(s, d):
    return fx.table(s, d, "pages").select("page_id", urls.filetype(F.col("url")).alias("filetype"))


@query(f"with {fx.WEB} select n, list_aggregate(list_transform(hyperlinks, lambda x: split_part(x, '#', 1)), 'string_agg', ' ') as targets from web")
def link_targets(s, d):
    return graph.nodes(fx.web(s, d)).select("n", F.array_join("hyperlinks", " ").alias("targets"))


# the query language

_H = "lower(coalesce(nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), ''), domain))"
_C, _T, _U = "lower(content)", "lower(title)", "lower(url)"
_EVERY = "lower(content || chr(10) || title || chr(10) || url)"
DORKS = {
    "dork_intext": ("intext:idiot|stupid", f"contains({_C}, 'idiot') or contains({_C}, 'stupid')"),
    "dork_allintext": ('allintext:"the of"', f"contains({_C}, 'the') and contains({_C}, 'of')"),
    "dork_intitle": ("intitle:the", f"contains({_T}, 'the')"),
    "dork_allintitle": ('allintitle:"the i"', f"contains({_T}, 'the') and contains({_T}, 'i')"),
    "dork_allinurl": ("allinurl:(/en/ src1)", f"contains({_U}, '/en/') and contains({_U}, 'src1')"),
    "dork_dates_in_parentheses": ('after:(2024-01-05) before:"2024-01-20"', f"coalesce(indexed > {fx.EPOCH + 4 * 86400} and indexed < {fx.EPOCH + 19 * 86400}, false)"),
    "dork_quoted_alternatives": ("intext:('tion'|\"ter\")", f"contains({_C}, 'tion') or contains({_C}, 'ter')"),
    "dork_inurl": ("inurl:/de/", f"contains({_U}, '/de/')"),
    "dork_site": ("site:*3.example.com", f"regexp_matches({_H}, '^.*3\\.example\\.com$')"),
    "dork_filetype": ("filetype:pdf", "ends_with(url, '.pdf')"),
    "dork_before_after": ("after:2024-01-05 before:2024-01-20T12:00:00", f"coalesce(indexed > {fx.EPOCH + 4 * 86400} and indexed < {fx.EPOCH + 19 * 86400 + 43200}, false)"),
    "dork_negative": ("-site:src3.example.com -filetype:pdf -intext:the", f"not contains({_C}, 'the') and not ends_with(url, '.pdf') and {_H} <> 'src3.example.com'"),
    "dork_free_terms": ("“the” -idiot site:*.example.com or|and", f"contains({_EVERY}, 'the') and not contains({_EVERY}, 'idiot') and contains({_EVERY}, 'or') and contains({_EVERY}, 'and') and ends_with({_H}, '.example.com')"),
    "dork_combined": ('intitle:("it"|"the") inurl:en ext:.HTML after:2024-01-02 -intext:loser numrange:a', f"(contains({_T}, 'it') or contains({_T}, 'the')) and contains({_U}, 'en') and ends_with(url, '.html') and coalesce(indexed > {fx.EPOCH + 86400}, false) and not contains({_C}, 'loser') and contains({_EVERY}, 'a')"),
}


def _dork(q):
    return lambda s, d: fx.texts(s, d).where(predicates.document_predicate(querylang.parse(q))).select("n")


for _name, (_q, _where) in DORKS.items():
    query(f"with {fx.TEXTS} select n from texts where {_where}", _name)(_dork(_q))


@query(f"with {fx.WEB} select n from web where list_aggregate(list_transform(hyperlinks, lambda x: contains(lower(x), 'external.example.net/1')), 'bool_or')")
def dork_link(s, d):
    return fx.web(s, d).where(predicates.document_predicate(querylang.parse("link:external.example.net/1"))).select("n")


@query(f"with {fx.FAQ_ROWS}, f as (select src.faq_id, lower(string_agg(distinct src.url, ' ')) as urls, lower(min(question || chr(10) || answer)) as t from src join ids using (faq_id) group by 1) select faq_id from f where contains(t, 'the') and contains(urls, '/1') and not contains(t, 'ing')")
def faq_predicate(s, d):
    return fx.faqs(s, d).where(predicates.faq_predicate(querylang.parse('intext:the inurl:/1 -intext:"ing "'))).select("faq_id")


@query(f"with {fx.TEXTS} select n, 0.0::double as score from texts where contains({_U}, '/fr/') order by doc_id limit 20")
def scan_search(s, d):
    return search.scanned(fx.texts(s, d), querylang.parse("inurl:/fr/"), 20).select("n", "score")


@query("select doc_id from documents where (lang = 'en' or source in ('src1', 'src2')) and not contains(lower(text), 'the')")
def filter_dictionary(s, d):
    node = {"should": [{"key": "lang", "match": {"value": "en"}}, {"key": "source", "match": {"any": ["src1", "src2"]}}], "must_not": [{"key": "text", "match": {"text": "THE"}}]}
    return fx.table(s, d, "documents").where(predicates.compiled(node)).select("doc_id")


@query(f"with {fx.TEXTS} select n from texts where url not in ('https://src1.example.com/en/1.html', 'https://src0.example.com/en/0.pdf')")
def exclude_urls(s, d):
    return search.without_urls(fx.texts(s, d), ["https://src1.example.com/en/1.html", "https://src0.example.com/en/0.pdf"]).select("n")


# vectors

_DENSE = f"with {fx.VECTORS}, s as (select v.doc_id, list_inner_product(v.dense, q.dense) as score, v.label from vectors v, q)"


@query(f"{_DENSE} select doc_id, round(score, 6) as score from s order by s.score desc, doc_id limit 20")
def dense_topk(s, d):
    return search.dense_top(fx.vectors(s, d), fx.query_vectors(s, d), 20).select("doc_id", _r("score").alias("score"))


@query(f"{_DENSE} select doc_id, round(score, 6) as score from s where score >= 0.1 and label <> 3 order by s.score desc, doc_id limit 50")
def dense_threshold(s, d):
    return search.dense_top(fx.vectors(s, d), fx.query_vectors(s, d), 50, F.col("label") != 3, 0.1).select("doc_id", _r("score").alias("score"))


def _queries(s, d):
    return fx.vectors(s, d).where("doc_id < 10").select(F.col("doc_id").alias("query_id"), "dense")


_MANY = f"with {fx.VECTORS}, s as (select a.doc_id as query_id, v.doc_id, list_inner_product(v.dense, a.dense) as score from vectors v, vectors a where a.doc_id < 10), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, rank::int as rank, doc_id, round(score, 6) as score from r"


@query(f"{_MANY} where rank <= 20")
def dense_topk_many(s, d):
    """Ten queries in one scan."""
    return many.dense_top(fx.vectors(s, d), _queries(s, d), 20).select("query_id", "rank", "doc_id", _r("score").alias("score"))


@query(f"with {fx.TOKENS.replace('where vec_id < 4', 'where vec_id < 40').replace('where vec_id = 0', 'where vec_id < 0')}, v as (select doc_id, v as dense from tok where vec_id % 10 = 0), pairs as (select a.doc_id as query_id, b.doc_id, list_inner_product(a.dense, b.dense) as ds from v a, v b where a.doc_id < 4),"
       " pre as (select * from (select *, row_number() over (partition by query_id order by ds desc, doc_id) as k from pairs) where k <= 30), best as (select p.query_id, p.doc_id, qt.q, max(list_inner_product(t.v, qt.v)) as b from pre p join tok t on t.doc_id = p.doc_id join qt on qt.q // 10 = p.query_id group by all),"
       " s as (select query_id, doc_id, sum(b) as score from best group by all), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, rank::int as rank, doc_id, round(score, 6) as score from r where rank <= 10")  # fmt: skip
def hybrid_many(s, d):
    """Dense candidates of four queries, reranked by their token vectors."""
    t = fx.tokens(s, d)
    got = many.hybrid(t, t.where("doc_id < 4").select(F.col("doc_id").alias("query_id"), "dense", "late"), 10, prefetch=30)
    return got.select("query_id", "rank", "doc_id", _r("score").alias("score"))


@query(f"with {fx.TOKENS.replace('where vec_id < 4', 'where vec_id < 40').replace('where vec_id = 0', 'where vec_id < 0')}, best as (select qt.q // 10 as query_id, t.doc_id, qt.q, max(list_inner_product(t.v, qt.v)) as b from tok t, qt group by all),"
       " s as (select query_id, doc_id, sum(b) as score from best group by all), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, rank::int as rank, doc_id, round(score, 6) as score from r where rank <= 10")  # fmt: skip
def maxsim_topk_many(s, d):
    """Four queries by their token vectors, over the whole collection in one scan."""
    t = fx.tokens(s, d)
    got = many.late_top(t, t.where("doc_id < 4").select(F.col("doc_id").alias("query_id"), "late"), 10)
    return got.select("query_id", "rank", "doc_id", _r("score").alias("score"))


def _index(s, d):
    return vectorindex.VectorIndex(s, scratch.path(s, "vector-index")).build(fx.vectors(s, d), lists=32)


@query(f"{_DENSE} select doc_id, round(score, 6) as score from s order by s.score desc, doc_id limit 20")
def vector_index_all_lists(s, d):
    """Through the lists, all of them: the exact result."""
    return _index(s, d).top(fx.query_vectors(s, d), 20, probes=None).select("doc_id", _r("score").alias("score"))


@query("select true as enough")
def vector_index_recall(s, d):
    """Whether as many lists as reach a recall of 0.9 by measure do find so much of the ten best of ten queries, and one less doesn't."""
    index, queries = _index(s, d), _queries(s, d)
    probes = index.probes_for(queries, 10, 0.9)
    found = index.recall(queries, 10, probes)
    less = index.recall(queries, 10, probes - 1) if probes > 1 else 0.0
    return s.range(1).select(F.lit(found >= 0.9 > less).alias("enough"))


@query(f"with {fx.TOKENS} select doc_id, round(score, 6) as score from late order by late.score desc, doc_id limit 10")
def maxsim_topk(s, d):
    return search.late_top(fx.tokens(s, d), fx.query_vectors(s, d), 10).select("doc_id", _r("score").alias("score"))


_PRE = "pre as (select doc_id from dense order by dense.score desc, doc_id limit 30)"


@query(f"with {fx.TOKENS}, {_PRE} select doc_id, round(score, 6) as score from late semi join pre using (doc_id) order by late.score desc, doc_id limit 10")
def hybrid_rerank(s, d):
    return search.hybrid(fx.tokens(s, d), fx.query_vectors(s, d), 10, prefetch=30).select("doc_id", _r("score").alias("score"))


@query(f"with {fx.TOKENS}, {_PRE}, u as (select doc_id from pre union select doc_id from late where doc_id % 7 = 0) select doc_id, round(score, 6) as score from late semi join u using (doc_id) order by late.score desc, doc_id limit 10")
def hybrid_multi_prefetch(s, d):
    t = fx.tokens(s, d)
    return search.hybrid(t, fx.query_vectors(s, d), 10, prefetch=30, extra=[t.where("doc_id % 7 = 0")]).select("doc_id", _r("score").alias("score"))


def _timed(s, d):
    return fx.tokens(s, d).withColumn("indexed_at", F.when(F.col("doc_id") % 5 != 0, F.timestamp_seconds(F.lit(fx.EPOCH) + F.col("doc_id") * 43200)))


_DECAY = f"pow(0.5, abs({NOW} - coalesce(case when doc_id % 5 <> 0 then {fx.EPOCH} + doc_id * 43200 end, 0)) / 864000.0)"


@query(f"with {fx.TOKENS}, pre as (select doc_id from dense order by dense.score desc, doc_id limit 30), mid as (select * from late semi join pre using (doc_id) order by score desc, doc_id limit 30) select doc_id, round(score + {_DECAY}, 4) as score from mid order by mid.score + {_DECAY} desc, doc_id limit 10")
def recency_boost(s, d):
    boost = {"now": _now(), "days": 10, "midpoint": 0.5}
    return search.hybrid(_timed(s, d), fx.query_vectors(s, d), 10, prefetch=30, boost=boost).select("doc_id", _r("score", 4).alias("score"))


@query(f"with {fx.TOKENS}, top as (select * from late order by score desc, doc_id limit 20), r as (select min(score) as lo, max(score) - min(score) as w from top) select doc_id, round(lo + pow((score - lo) / w, 2.5) * w, 4) as score from top, r")
def score_contrast(s, d):
    return vectors.contrasted(search.late_top(fx.tokens(s, d), fx.query_vectors(s, d), 20)).select("doc_id", _r("score", 4).alias("score"))


@query("select id, case when t is not null then case when greatest(t, 0) <= 1 then greatest(t, 0) else least(t, 37) / 37.0 end end::double as dense, greatest(case when t is not null then 0 end, t)::double as late from (select doc_id as id, case when doc_id % 7 <> 0 then (doc_id % 101 - 10) / 2.0 end::double as t from documents)")
def threshold_normalise(s, d):
    """Thresholds from -5 to 45, and none."""
    t = fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 101 - 10) / 2.0).alias("t"))
    return t.select("id", vectors.normalised_thresholds(F.col("t"), False).alias("dense"), vectors.normalised_thresholds(F.col("t"), True).alias("late"))


_FAQ_HITS = f"with {fx.TOKENS}, {_PRE}, hits as (select * from late semi join pre using (doc_id) order by score desc, doc_id limit 20)"


@query(f"{_FAQ_HITS} select doc_id as faq_id, round(score, 6) as score from hits where score >= 0.9")
def faq_search(s, d):
    return search.faq_search(fx.tokens(s, d).withColumnRenamed("doc_id", "faq_id"), fx.query_vectors(s, d), 20, 0.9).select("faq_id", _r("score").alias("score"))


@query(f"with {fx.TOKENS}, pre as (select doc_id from dense order by dense.score desc, doc_id limit 50) select doc_id as id, round(score, 6) as score from (select * from late semi join pre using (doc_id) order by score desc, doc_id limit 5) where score >= 0.7")
def kv_search(s, d):
    return search.kv_search(fx.tokens(s, d).withColumnRenamed("doc_id", "id"), fx.query_vectors(s, d)).select("id", _r("score").alias("score"))


@query(f"with {fx.TOKENS}, pre as (select doc_id from dense order by dense.score desc, doc_id limit 100), x as (select * from late semi join pre using (doc_id) order by score desc, doc_id limit 10) select doc_id, round(score, 6) as score from x where doc_id % 3 <> 0 order by x.score desc, doc_id limit 5")
def agent_search(s, d):
    t = fx.tokens(s, d).withColumns({"url": F.lit("u"), "content": F.lit("c")})
    return search.agent_search(t, fx.query_vectors(s, d), 5, t.where("doc_id % 3 = 0")).select("doc_id", _r("score").alias("score"))


def _answers(s, d):
    t = fx.tokens(s, d)
    source = F.array(F.struct((F.col("doc_id") * 2).cast("bigint").alias("document_id"), F.lit("https://x.example.com/a.html").alias("url")))
    return t.select((F.col("doc_id") + 1000).alias("faq_id"), "dense", "late", F.lit("the question").alias("question"), F.lit("an answer").alias("answer"), source.alias("source_documents"))


def _sourced(s, d):
    return _answers(s, d).withColumn("source_documents", F.transform("source_documents", lambda x: F.struct(x["document_id"].cast("string").alias("document_id"), x["url"].alias("url"))))


def _with_tokens(rows, t):
    """Every row, the n-th with the token vectors of n modulo their number; this is on the rows' side, so they meet by equality."""
    own = rows.crossJoin(F.broadcast(t.agg(F.count("*").alias("total")))).withColumn("v", F.col("n") % F.col("total"))
    return own.join(t.withColumnRenamed("doc_id", "v"), "v").drop("v", "total")


def _whole(s, d):
    """Every document, the n-th with the token vectors of n modulo their number; and FAQs about some of them."""
    docs = _with_tokens(fx.texts(s, d).drop("doc_id"), fx.tokens(s, d))
    return docs.withColumn("doc_id", F.col("n").cast("string")), _sourced(s, d)


_SEARCH = f"""with {fx.TOKENS}, {fx.TEXTS}, c as (select l.doc_id, l.score, d.score as ds, t.* exclude (doc_id) from late l join dense d using (doc_id) join texts t on t.n = l.doc_id),
 fp as (select doc_id from dense order by score desc, doc_id limit 30), fh as (select doc_id * 2 as src from (select * from late semi join fp using (doc_id) order by score desc, doc_id limit {{limit}}) where score >= 0.9),
 f0 as (select c.doc_id from c semi join fh on c.doc_id = fh.src), pre as (select doc_id from c order by ds desc, doc_id::varchar limit 1000),
 u as (select doc_id from pre union select doc_id from f0), hits as (select c.*, exists (select 1 from fh where fh.src = c.doc_id) as boosted_by_faqs from c semi join u using (doc_id) order by score desc, doc_id::varchar limit {{wide}} + (select count(*) from fh)), kept as (select * from hits where {{where}} order by score desc, doc_id::varchar limit {{limit}})"""


# FAQs are scoped before their top 30 are taken: only those with a source in the allowed domains compete
_SEARCH_KB = _SEARCH.replace("fp as (select doc_id from dense order by", "fp as (select doc_id from dense where doc_id * 2 in (select doc_id from c) order by")


def _over_all(sql):
    """The SQL of a search over _whole."""
    was = "select l.doc_id, l.score, d.score as ds, t.* exclude (doc_id) from late l join dense d using (doc_id) join texts t on t.n = l.doc_id"
    assert was in sql
    return sql.replace(was, "select t.n as doc_id, l.score, d.score as ds, t.* exclude (doc_id) from late l join dense d using (doc_id) join texts t on t.n % (select count(*) from late) = l.doc_id")


_SEARCH_ALL = _over_all(_SEARCH).format(limit=10, wide=50, where=f"contains({_EVERY}, 'e') and not contains({_U}, '/es/')") + ", r as (select min(score) as lo, max(score) - min(score) as w from kept) select doc_id::varchar as doc_id, round(case when w > 0 then lo + pow((score - lo) / w, 5.0) * w else score end, 4) as score, boosted_by_faqs from kept, r"


@query(_SEARCH_ALL, "search_full")
@query(_SEARCH_ALL)
def search_all(s, d):
    """Every document is a candidate."""
    docs, faq_table = _whole(s, d)
    got = search.search(docs, faq_table, "e -inurl:/es/", fx.query_vectors(s, d), 10, now=_now(), least_faq=0.9, prefetch=1000)
    return got.documents.select("doc_id", _r("score", 4).alias("score"), "boosted_by_faqs")


@query(_over_all(_SEARCH_KB).format(limit=10, wide=50, where="true") + " select doc_id::varchar as doc_id, round(score, 6) as score, boosted_by_faqs from kept")
def search_kb_full(s, d):
    """Every document, in a domain that all are in."""
    docs, faq_table = _whole(s, d)
    got = search.knowledge_base(docs, faq_table, "anything at all", fx.query_vectors(s, d), 10, allowed=["example.com"], least_faq=0.9, prefetch=1000)
    return got.documents.select("doc_id", _r("score").alias("score"), "boosted_by_faqs")


_KB_SCOPED = _over_all(_SEARCH_KB).replace("% (select count(*) from late) = l.doc_id)", "% (select count(*) from late) = l.doc_id where source = 'src3')")


@query(_KB_SCOPED.format(limit=10, wide=50, where="true") + " select doc_id::varchar as doc_id, round(score, 6) as score, boosted_by_faqs from kept")
def search_kb_scoped(s, d):
    """search_kb_full with every document, and a domain that leaves most of them out."""
    docs, faq_table = _whole(s, d)
    got = search.knowledge_base(docs, faq_table, "anything at all", fx.query_vectors(s, d), 10, allowed=["https://www.src3.example.com/x"], least_faq=0.9, prefetch=1000)
    return got.documents.select("doc_id", _r("score").alias("score"), "boosted_by_faqs")


_FLAG = f"""{_over_all(_SEARCH).split(' fp as')[0]} pre as (select * from c order by ds desc, doc_id::varchar limit 500),
 aged as (select * replace (score + pow(0.5, abs({NOW} - coalesce(indexed, 0)) / 86400.0) as score) from pre), top as (select * from aged order by score desc, doc_id::varchar limit 50),
 kept as (select * from top where contains({_EVERY}, 'the') and coalesce(indexed > {fx.EPOCH + 86400}, false) and {_H} <> 'src3.example.com' order by score desc, doc_id::varchar limit 10),
 r as (select min(score) as lo, max(score) - min(score) as w from kept)
 select doc_id::varchar as doc_id, url, round(case when w > 0 then lo + pow((score - lo) / w, 5.0) * w else score end, 4) as score, false as boosted_by_faqs from kept, r"""


@query(_FLAG, "flagship")
def _flagship_row(s, d):
    return flagship(s, d).withColumn("score", _r("score", 4))


def flagship(s, d):
    docs, faq_table = _whole(s, d)
    got = search.search(docs, faq_table, "the after:2024-01-02 -site:src3.example.com", fx.query_vectors(s, d), 10, now=_now(), least_faq=0.9)
    return got.documents.select("doc_id", "url", "score", "boosted_by_faqs")


# graph


def _pages(s, d):
    """The pages, also those with one url told apart by doc_id (the url's id and n), and the links between them."""
    web = fx.web(s, d).withColumn("url_id", F.col("doc_id"))
    web = web.withColumn("doc_id", F.concat("url_id", F.lit(" "), F.lpad(F.col("n").cast("string"), 19, "0")))
    return web, graph.walkable(web, "url_id")


_EDGES = f"{fx.WEB}, e as (select w.n as src, t.n as dst, k from (select n, unnest(hyperlinks) as l, unnest([0, 1, 2]) as k from web) w join web t on split_part(w.l, '#', 1) = t.url)"


@query(f"with recursive {_EDGES}, bfs as (select n, 0 as hop from web where n < 3 union select e.dst, hop + 1 from bfs join e on e.src = bfs.n where hop < 2) select n, min(hop) as hop from bfs group by n having min(hop) > 0")
def graph_bfs(s, d):
    web, links = _pages(s, d)
    found = graph.related(web, web.where("n < 3").select("doc_id", F.col("n").alias("pos")), 2, 1_000_000, links=links)
    return found.join(web.select("doc_id", "n"), "doc_id").select("n", "hop")


@query(f"with {_EDGES} select e.dst as n, min_by(e.src, e.src * 10 + e.k) as via from e where e.src < 4 and e.dst >= 4 and e.dst % 2 = 0 group by e.dst")
def graph_link_candidates(s, d):
    web, links = _pages(s, d)
    inspected = web.where("n < 4").select("doc_id", F.lit(0).alias("hop"), F.col("n").alias("pos"))
    found = graph.link_candidates(web, inspected, web.where("n % 2 = 1").select("doc_id"), 1, 1000, links)
    n, v = web.select("doc_id", "n"), web.select(F.col("doc_id").alias("via"), F.col("n").alias("v"))
    return found.join(n, "doc_id").join(v, "via").select("n", F.col("v").alias("via"))


# questions and answers


@query(f"with {fx.FAQ_ROWS} select faq_id, count(*)::bigint as source_count, round(max(confidence), 6) as aggregated_confidence, string_agg(document_id, ',' order by document_id) as documents from src group by 1")
def faq_merge_sources(s, d):
    return fx.faqs(s, d).select("faq_id", F.col("source_count").cast("bigint").alias("source_count"), _r("aggregated_confidence").alias("aggregated_confidence"), F.array_join(F.sort_array("source_documents.document_id"), ",").alias("documents"))


@query(f"with {fx.FAQ_ROWS}, g as (select faq_id, count(*) filter (where document_id <> '7') as rest, count(*) filter (where document_id = '7') as hit from src group by 1) select faq_id, case when hit > 0 and rest = 0 then 'deleted' when hit > 0 then 'updated' else 'kept' end as action, rest::bigint as source_count from g")
def faq_remove_source(s, d):
    return faqs.url_removed(fx.faqs(s, d), "https://docs.example.com/7").select("faq_id", "action", F.col("source_count").cast("bigint").alias("source_count"))


@query(f"with {fx.FAQ_ROWS}, g as (select faq_id, count(*) filter (where url <> 'https://docs.example.com/5') as rest, count(*) filter (where url = 'https://docs.example.com/5') as hit from src group by 1) select case when hit > 0 and rest = 0 then 'deleted' when hit > 0 then 'updated' else 'kept' end as action, count(*) as n from g group by 1")
def faq_remove_url_everywhere(s, d):
    return faqs.url_removed(fx.faqs(s, d), "https://docs.example.com/5").groupBy("action").agg(F.count("*").alias("n"))


_GENERATED_ALL = "gen as (select document_id, extracted_at as pos, question, answer || case when conv_id % 2 = 1 then ' v2' else '' end as answer, confidence from pairs where conv_id % 5 <> 0)"


_SYNC_ACTIONS = f"""with {fx.FAQ_ROWS}, {_GENERATED_ALL}, g as (select document_id, md5(lower(trim(question))) as question_hash, arg_max({fx.sql_uuid5("trim(regexp_replace(trim(question), '\\s+', ' ', 'g'))||'|'||trim(regexp_replace(trim(answer), '\\s+', ' ', 'g'))", 'a1b2c3d4e5f67890abcdef1234567890')}, (confidence, pos)) as new_id from gen where trim(question) <> '' and trim(answer) <> '' group by 1, 2),
 o as (select document_id, question_hash, min(faq_id) as old_id from ids group by 1, 2)
 select document_id, question_hash, case when new_id is null then 'stale' when old_id is null then 'created' when new_id = old_id then 'refreshed' else 'reassigned' end as action from g full join o using (document_id, question_hash)"""


@query(_SYNC_ACTIONS, "faq_sync_actions")
@query(_SYNC_ACTIONS)
def faq_sync_actions_all(s, d):
    """Every conversation; one in five isn't generated again, every other one has new answers."""
    rows = fx.faq_rows(s, d)
    gen = rows.where("conv_id % 5 <> 0").select("document_id", F.col("extracted_at").alias("pos"), "question", F.when(F.col("conv_id") % 2 == 1, F.concat("answer", F.lit(" v2"))).otherwise(F.col("answer")).alias("answer"), "confidence")
    return faqs.sync_plan(gen, rows.select("document_id", "faq_id", "question_hash")).select("document_id", "question_hash", "action")


@query(f"with {fx.FAQ_ROWS}, g as (select faq_id, count(*) as k from src group by 1) select count(*) as total_faqs, sum(k)::bigint as total_sources, round(avg(k), 2) as avg_sources, count(*) filter (where k > 1) as multi_source_faqs, round(100.0 * count(*) filter (where k > 1) / count(*), 1) as multi_source_percent from g")
def faq_source_stats(s, d):
    return faqs.source_statistics(fx.faqs(s, d))


@query(f"with {fx.FAQ_ROWS} select source_count, count(*) as faqs from (select count(*)::bigint as source_count from src group by faq_id) group by 1")
def faq_source_histogram(s, d):
    return faqs.source_histogram(fx.faqs(s, d)).select(F.col("source_count").cast("bigint").alias("source_count"), "faqs")


@query(f"with {fx.FAQ_ROWS} select d.doc_id::varchar as doc_id, count(distinct faq_id) as faq_count from documents d left join src on src.document_id = d.doc_id::varchar group by 1")
def faq_count_per_document(s, d):
    return faqs.counts_per_document(fx.texts(s, d), fx.faqs(s, d))


@query(f"with {fx.FAQ_ROWS} select '4' as doc_id, (select string_agg(distinct faq_id, ',' order by faq_id) from src where document_id = '4') as faqs")
def document_detail(s, d):
    return faqs.document_detail(fx.texts(s, d), fx.faqs(s, d), "4").select("doc_id", F.array_join("faqs", ",").alias("faqs"))


_UPSERT = f"""with {fx.FAQ_ROWS}, old as (select * from src where faq_id < '8'),
 new as (select faq_id, case when faq_id >= '8' or substr(faq_id, 2, 1) < '4' then document_id else 'new-' || document_id end as document_id from (select faq_id, min(document_id) as document_id from ids group by 1) where faq_id >= '8' or substr(faq_id, 2, 1) < '8'),
 put as (select faq_id, document_id, confidence from old anti join new using (faq_id, document_id) union all select faq_id, document_id, 0.25::double from new)
 select faq_id, case when faq_id not in (select faq_id from new) then 'kept' when faq_id not in (select faq_id from old) then 'created' when (faq_id, any_value(document_id) filter (where (faq_id, document_id) in (select faq_id, document_id from new))) in (select faq_id, document_id from old) then 'refreshed' else 'merged' end as action,
 count(*)::bigint as source_count, round(max(confidence), 6) as aggregated_confidence, string_agg(document_id, ',' order by document_id) as documents from put group by 1"""


@query(_UPSERT, "faq_upsert")
@query(_UPSERT)
def faq_upsert_all(s, d):
    """Every FAQ: those from '8' on are new; of the others a quarter gets a known source again, a quarter a new one, and half nothing."""
    rows, sure = fx.faq_rows(s, d), F.lit(0.25)
    same = (F.col("faq_id") >= "8") | (F.substring("faq_id", 2, 1) < "4")
    one = rows.groupBy("faq_id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"), F.min("document_id").alias("document_id")).where("faq_id >= '8' or substring(faq_id, 2, 1) < '8'")
    new = one.withColumn("document_id", F.when(same, F.col("document_id")).otherwise(F.concat(F.lit("new-"), "document_id"))).select("*", F.concat(F.lit("https://docs.example.com/"), "document_id").alias("url"), F.lit("z").alias("extracted_at"), sure.alias("confidence"))
    got = faqs.upserted(fx.faqs(s, d).where("faq_id < '8'"), new)
    return got.select("faq_id", "action", F.col("source_count").cast("bigint").alias("source_count"), _r("aggregated_confidence").alias("aggregated_confidence"), F.array_join(F.sort_array("source_documents.document_id"), ",").alias("documents"))


@query(f"with {fx.PAIRS}, g as (select *, row_number() over (order by extracted_at, document_id) as pos from pairs) select min(pos) as pos, arg_max(question, pos) as question, arg_max(answer, pos) as answer, round(arg_max(confidence, pos), 6) as confidence from (select pos, trim(question) as question, trim(answer) as answer, confidence from g) where question <> '' and answer <> '' group by lower(question)")
def faq_normalise_generated(s, d):
    rows = scratch.numbered(fx.pairs(s, d), "pos", "extracted_at", "document_id").select("question", "answer", "confidence", "pos")
    return faqs.normalised_generated(rows).select("pos", "question", "answer", _r("confidence").alias("confidence"))


@query(f"with {fx.TEXTS} select n from texts order by indexed desc nulls last, doc_id desc limit 25 offset 10")
def recent_first_page(s, d):
    return ingest.recent_first(fx.texts(s, d), 25, 10).select("n")


# feedback


@query(f"with {fx.FEEDBACK} select count(*) as total, count(*) filter (where user_rating = 1) as positive, count(*) filter (where user_rating = 0) as neutral, count(*) filter (where user_rating = -1) as negative, case when count(*) >= 10 and count(*) filter (where user_rating = -1) > 0 then min(search_score) filter (where user_rating = -1) end as recommended_min_score from feedback")
def feedback_stats(s, d):
    return feedback.statistics(fx.feedback(s, d))


_B = "coalesce(nullif({0}.rating_session_id, ''), 'legacy')"


@query(f"with {fx.FEEDBACK} select a.query, {_B.format('a')} as bucket, a.text as positive, b.text as negative, a.search_score as positive_score, b.search_score as negative_score from feedback a join feedback b on a.query = b.query and {_B.format('a')} = {_B.format('b')} where a.ranking_score is null and b.ranking_score is null and a.user_rating = 1 and b.user_rating = -1")
def feedback_pairs_binary(s, d):
    return feedback.binary_pairs(fx.feedback(s, d)).select("query", "bucket", "positive", "negative", "positive_score", "negative_score")


_RANKED = f"{fx.FEEDBACK}, f as (select *, {_B.format('feedback')} as bucket, max((ranking_score = 4)::int) over (partition by query, {_B.format('feedback')}) as has4 from feedback where ranking_score is not null), rp as (select a.query, a.bucket, a.text as positive, b.text as negative, (a.ranking_score - b.ranking_score)::int as score_gap from f a join f b on a.query = b.query and a.bucket = b.bucket and (b.ranking_score = a.ranking_score - 1 or a.ranking_score = 5 and b.ranking_score = 3 and a.has4 = 0))"


@query(f"with {_RANKED} select * from rp")
def feedback_pairs_ranked(s, d):
    return feedback.ranked_pairs(fx.feedback(s, d)).select("query", "bucket", "positive", "negative", "score_gap")


@query(f"with {_RANKED}, bp as (select count(*) as n from feedback a join feedback b on a.query = b.query and {_B.format('a')} = {_B.format('b')} where a.ranking_score is null and b.ranking_score is null and a.user_rating = 1 and b.user_rating = -1) select (select count(*) from feedback) as total, (select count(*) from feedback where user_rating = 1) as positive, (select count(*) from feedback where user_rating = -1) as negative, (select n from bp) as binary_pairs, (select count(*) from rp) as ranked_pairs, (select n from bp) + (select count(*) from rp) as pairs")
def feedback_export_summary(s, d):
    return feedback.summary(fx.feedback(s, d), include_neutral=True)


@query(f"with {fx.FEEDBACK} select id, text, user_rating from feedback where rating_session_id = 'src2' and user_rating <> 0")
def feedback_export(s, d):
    return feedback.exported(fx.feedback(s, d), "src2").select("id", "text", "user_rating")


@query(f"with {fx.FEEDBACK} select id, query from feedback where user_rating = -1 and content_type = 'faq' order by id limit 30")
def feedback_list(s, d):
    return feedback.listed(fx.feedback(s, d), rating=-1, content_type="faq", limit=30).select("id", "query")


@query("with o as (select doc_id as option_id, row_number() over (order by doc_id) as pos from labels) select o.option_id, case when o.option_id % 3 = 0 then 3 else least(greatest(quality * 6 - toxic, 1), 5) end::int as stars, case when o.option_id % 3 = 0 then pos else greatest(quality, 1) end::int as rank, case when o.option_id % 3 = 0 then 'No reason provided' else 'because' end as reason from o join labels on doc_id = option_id")
def llm_hint_fill(s, d):
    from pyspark.sql import Window

    t = fx.table(s, d, "labels")
    options = t.select(F.col("doc_id").alias("option_id"), F.row_number().over(Window.orderBy("doc_id")).alias("pos"))
    hints = t.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("option_id"), F.lit(1).alias("n"), (F.col("quality") * 6 - F.col("toxic")).cast("string").alias("stars"), F.col("quality").cast("string").alias("rank"), F.lit(" because ").alias("reason"))
    return feedback.filled_hints(options, hints)


@query("select doc_id, case when k >= 4 then 1 when k <= 2 then -1 else 0 end as rating from (select doc_id, doc_id % 5 + 1 as k from documents)")
def star_rating(s, d):
    return fx.table(s, d, "documents").select("doc_id", text.rating_of_stars(F.col("doc_id") % 5 + 1).alias("rating"))


# queue, key/value, agent


@query(f"with {fx.QUEUE} select collection_name, lower(trim(query)) as query_normalized, arg_min(id, (created_at, id)) as id from queue where trim(query) <> '' group by 1, 2")
def queue_dedupe(s, d):
    return queues.enqueued(fx.queue(s, d)).select("collection_name", "query_normalized", "id")


@query(f"with {fx.QUEUE} select id, query from queue where collection_name = 'c1' order by created_at desc, id desc limit 40")
def queue_newest(s, d):
    return queues.newest(fx.queue(s, d), 40, "c1").select("id", "query")


@query("select case when lang in ('de', 'en') then lang else 'Unknown' end as language, count(*) as queries from documents group by 1")
def queue_by_language(s, d):
    return queues.by_language(fx.table(s, d, "documents").select("lang", F.lit(0.9).alias("accuracy")))


@query("select id, arg_max(key, k) as key, arg_max(value, k) as value, min(k) as created_at, max(k) as updated_at from (select p_partkey // 3 as id, p_partkey % 3 as k, p_name as key, p_brand as value from part) group by id")
def kv_upsert_state(s, d):
    return queues.kv_state(fx.kv_writes(s, d))


@query("select p_partkey as id, p_brand as value from part where p_name = 'red widget'")
def kv_find_by_key(s, d):
    return queues.kv_by_key(fx.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key"), F.col("p_brand").alias("value")), "red widget").select("id", "value")


@query("select n, case when trim(text) = '' then 'skip_empty' when n % 7 = 0 then 'skip_same_run' when n % 3 <> 0 and n % 4 < 2 then 'skip_unchanged' else 'process' end as gate from (select doc_id as n, text from documents)")
def needs_processing(s, d):
    t = fx.table(s, d, "documents").select(F.col("doc_id").alias("n"), F.col("text").alias("content"), text.content_hash(F.col("text")).alias("content_hash"))
    status = F.element_at(F.array(*(F.lit(x) for x in ("processed", "skipped_unchanged", "skipped_unchanged_since_last_run", "failed"))), (F.col("n") % 4 + 1).cast("int"))
    marker = F.struct(F.when(F.col("n") % 7 == 0, "r1").otherwise("r0").alias("last_run_id"), F.when(F.col("n") % 3 != 0, F.col("content_hash")).otherwise("old").alias("content_hash"), status.alias("status"))
    return t.withColumn("marker", marker).select("n", agent.needs_processing(F.lit("r1"), F.lit(False)).alias("gate"))


@query("select doc_id, 'done' as status, 'r' || (doc_id % 2) as last_run_id from documents")
def agent_marker(s, d):
    t = fx.table(s, d, "documents").withColumn("marker", F.struct(F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")).alias("last_run_id"), F.lit("new").alias("status")))
    return agent.marked(t, status=F.lit("done")).select("doc_id", "marker.status", "marker.last_run_id")


@query("select doc_id, len(regexp_extract_all(lower(text), 'the'))::bigint as n from documents")
def match_term_counts(s, d):
    return fx.table(s, d, "documents").select("doc_id", text.term_count(F.col("text"), "The").cast("bigint").alias("n"))


@query("""select doc_id, case when contains(t, 'of the and') then 'of the and' when contains(t, 'of the') then 'of the' when contains(t, 'the and') then 'the and' end as phrase,
 case when contains(t, 'of the and') then len(regexp_extract_all(t, 'of the and')) when contains(t, 'of the') then len(regexp_extract_all(t, 'of the')) when contains(t, 'the and') then len(regexp_extract_all(t, 'the and')) end::bigint as n from (select doc_id, lower(text) as t from documents)""")
def match_best_chain(s, d):
    c = text.best_chain(F.col("text"), ["of", "the", "and"])
    return fx.table(s, d, "documents").select("doc_id", c["phrase"].alias("phrase"), c["count"].cast("bigint").alias("n"))


_TWELVE = ["the", "of", "and", "ing", "tion", "er", "in", "an", "th", "es", "on", "re"]
_PHRASES = "[" + ", ".join(f"'{p}'" for p in matching.phrases(_TWELVE)) + "]"


@query(f"""select doc_id, array_to_string(list_transform([{', '.join(f"'{t}'" for t in _TWELVE)}], lambda x: (length(t) - length(replace(t, x, ''))) // length(x)), ' ') as counts, phrase, ((length(t) - length(replace(t, phrase, ''))) // length(phrase))::bigint as n
 from (select doc_id, t, list_filter({_PHRASES}, lambda x: contains(t, x))[1] as phrase from (select doc_id, lower(text) as t from documents))""")
def match_twelve_terms(s, d):
    """Twelve terms and their 66 phrases in one pass."""
    m = matching.matches(F.col("text"), _TWELVE)
    got = fx.table(s, d, "documents").select("doc_id", m.alias("m"))
    return got.select("doc_id", F.array_join("m.counts", " ").alias("counts"), "m.phrase", F.col("m.count").cast("bigint").alias("n"))


@query()
def detected_languages(s, d):
    """The language of every document by profiles of the even ones; no SQL, its accuracy on the odd ones is tested."""
    t = fx.table(s, d, "documents")
    known = language.profiles(t.where("doc_id % 2 = 0"))
    found = t.select("doc_id", language.language(F.col("text"), known).alias("l")).select("doc_id", "l.lang", "l.accuracy")
    return queues.with_language(found, known=tuple(known)).select("doc_id", "language", _r("accuracy").alias("accuracy"))


@query("select doc_id from documents where greatest(len(regexp_extract_all(lower(text), 'idiot')), len(regexp_extract_all(lower(text), 'ring'))) >= 3")
def match_filter(s, d):
    return fx.table(s, d, "documents").where(text.has_matches(F.col("text"), ["idiot", "ring"], 3)).select("doc_id")


_HIGHLIGHT = "select doc_id, regexp_replace(text, '(there|the)', '<mark>\\1</mark>', 'gi') as marked, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end as preview from documents"


@query(_HIGHLIGHT, "highlight_preview")
@query(_HIGHLIGHT)
def highlight_all(s, d):
    """The whole text is marked; the preview alone is cut."""
    return fx.table(s, d, "documents").select("doc_id", text.highlighted(F.col("text"), ["the", "there"]).alias("marked"), text.preview(F.col("text")).alias("preview"))


@query(f"select doc_id, case when x < 60 then x || 's ago' when x < 3600 then x // 60 || 'm ago' when x < 86400 then x // 3600 || 'h ago' else x // 86400 || 'd ago' end as said from (select doc_id, doc_id * 977 as x from documents)")
def relative_times(s, d):
    return fx.table(s, d, "documents").select("doc_id", text.relative_time(F.timestamp_seconds(F.lit(NOW) - F.col("doc_id") * 977), _now()).alias("said"))


@query("select status, count(*) as runs, round(avg(p), 4) as progress from (select case when doc_id % 3 = 0 then 'done' else 'running' end as status, round_even(doc_id % 100 * 100.0 / 100, 0) as p from documents) group by 1")
def run_dashboard(s, d):
    t = fx.table(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "done").otherwise("running").alias("status"), (F.col("doc_id") % 100).alias("processed"), F.lit(100).alias("total"))
    return queues.run_dashboard(t).select("status", "runs", _r(F.col("progress").cast("double"), 4).alias("progress"))


@query("select doc_id, 'Q: ' || source as question, 'A: ' || lang as answer from documents")
def parse_generated_faq(s, d):
    reply = F.concat(F.lit("QUESTION: Q: "), "source", F.lit("\n\nAnswer: A: "), "lang", F.lit("\n"))
    g = text.generated_faq(reply)
    return fx.table(s, d, "documents").select("doc_id", g["question"].alias("question"), F.trim(F.regexp_replace(g["answer"], r"\s+$", "")).alias("answer"))


# retention


@query(f"with {fx.TEXTS}, f as (select *, coalesce(indexed < {NOW} - 30 * 86400, false) as old, coalesce(case when ends_with(url, '.pdf') then indexed < {NOW} - 365 * 86400 else indexed < {NOW} - 30 * 86400 end, false) as gone from texts) select count(*) as total, count(*) filter (where old) as dry_run, count(*) filter (where gone) as deleted from f")
def doc_gc(s, d):
    return retention.document_report(fx.texts(s, d), _now())


@query(f"with {fx.FAQ_ROWS}, {fx.TEXTS} select faq_id, case when bool_or(coalesce(t.indexed >= {fx.EPOCH} + 10 * 86400, false)) then 'fresh' else 'stale' end as fate from src left join texts t on t.doc_id = src.document_id group by 1")
def faq_gc(s, d):
    return retention.faq_fates(fx.faqs(s, d), fx.texts(s, d), F.timestamp_seconds(F.lit(fx.EPOCH + 10 * 86400)))


@query("select doc_id, case when doc_id % 3 = 0 then 'Q: ' || source || chr(10) || 'A: ' || lang when doc_id % 3 = 1 then 'Key: ' || source || chr(10) || 'Value: ' || lang else source end as t from documents")
def reembed_text(s, d):
    t = fx.table(s, d, "documents").withColumns({"question": F.col("source"), "answer": F.col("lang"), "key": F.col("source"), "value": F.col("lang"), "content": F.col("source")})
    k = F.col("doc_id") % 3
    return t.select("doc_id", F.when(k == 0, migrate.text_to_embed("faq")).when(k == 1, migrate.text_to_embed("kv")).otherwise(migrate.text_to_embed("document")).alias("t"))


# operators on their own


@query(f"with {_STATUS} select n from st where status = 'stored'")
def ingest_stored(s, d):
    return ingest.kept(_incoming(s, d), _statuses(s, d)).select("n")


@query("select doc_id, nullif(regexp_replace(regexp_replace(trim(regexp_extract(h, '^#{1,6}\\s+(.+)$', 1)), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_`]', '', 'g'), '') as heading from (select doc_id, list_filter(list_transform(string_split(replace(text, '. ', chr(10) || '## '), chr(10))[1:50], lambda x: trim(x)), lambda x: regexp_matches(x, '^#{1,6}\\s+\\S'))[1] as h from documents)")
def title_of_text(s, d):
    """Headings of whole texts whose sentences after the first are headings: none for texts of one sentence."""
    t = fx.table(s, d, "documents")
    return t.select("doc_id", text.heading(F.replace("text", F.lit(". "), F.lit("\n## "))).alias("heading"))


@query("select vec_id as doc_id from embeddings where vec_id % 9 = 0", "dimension_mismatch")
@query("select vec_id as doc_id from embeddings where vec_id % 9 = 0")
def dimension_mismatch_found(s, d):
    v = fx.vectors(s, d)
    return migrate.mismatched(v.withColumn("dense", F.when(F.col("doc_id") % 9 == 0, F.slice("dense", 1, 60)).otherwise(F.col("dense"))), 64).select("doc_id")


@query(f"select name, points from ({_COUNTS}) where name in ('documents', 'pages') union all select 'docs_migration_20240101_000000', count(*) from labels")
def primary_collections_of_kind(s, d):
    """By alias and kind: a migration that has an alias is one, a collection of another kind isn't."""
    typed = queues.admin_statistics(_collections(s, d), _aliases(s))
    odd = s.range(1).select(F.lit("odd").alias("name"), F.lit(3).cast("bigint").alias("points"), F.lit(None).cast("string").alias("alias"), F.lit("faq").alias("kind"))
    return queues.primary(typed.select("name", "points", "alias", "kind").unionByName(odd)).select("name", "points")


@query(f"""with {_EDGES}, r1 as (select dst as n, min([src, k]) as p, arg_min(src, [src, k]) as via from e where src < 3 and dst >= 3 group by dst),
 r2 as (select e.dst as n, min(list_append(r1.p, k)) as p, arg_min(r1.n, list_append(r1.p, k)) as via from r1 join e on e.src = r1.n where e.dst >= 3 and e.dst not in (select n from r1) group by e.dst)
 select n, 1 as hop, via, row_number() over (order by p) as place from r1 union all select n, 2, via, (select count(*) from r1) + row_number() over (order by p) from r2""")
def graph_bfs_order(s, d):
    """The walk with what led to each page, and the order of discovery."""
    from pyspark.sql import Window

    web, links = _pages(s, d)
    found = graph.related(web, web.where("n < 3").select("doc_id", F.col("n").alias("pos")), 2, 1_000_000, links=links).withColumn("place", F.row_number().over(Window.orderBy("hop", "pos", "doc_id")))
    n, v = web.select("doc_id", "n"), web.select(F.col("doc_id").alias("via"), F.col("n").alias("v"))
    return found.join(n, "doc_id").join(v, "via").select("n", "hop", F.col("v").alias("via"), "place")


@query(f"""with {fx.FAQ_ROWS}, old as (select * from src where faq_id < '8' and document_id < '5')
 select faq_id, case when faq_id not in (select faq_id from old) then 'created' when count(*) = count(*) filter (where (faq_id, document_id) in (select faq_id, document_id from old)) then 'refreshed' else 'merged' end as action,
 count(*)::bigint as source_count, string_agg(document_id, ',' order by document_id) as documents from src group by 1""")
def faq_upsert_batch(s, d):
    """All sources of all FAQs in one batch, into FAQs that know some of them."""
    rows = fx.faq_rows(s, d)
    got = faqs.upserted(faqs.merged(rows.where("faq_id < '8' and document_id < '5'")), rows)
    return got.select("faq_id", "action", F.col("source_count").cast("bigint").alias("source_count"), F.array_join(F.sort_array("source_documents.document_id"), ",").alias("documents"))


_NEW_ID = fx.sql_uuid5("trim(regexp_replace(trim(question), '\\s+', ' ', 'g'))||'|'||trim(regexp_replace(trim(answer), '\\s+', ' ', 'g'))", "a1b2c3d4e5f67890abcdef1234567890")
_SYNC = f"""with {fx.FAQ_ROWS}, {_GENERATED_ALL.replace("confidence from", "confidence, url, extracted_at from")},
 g as (select document_id as d, md5(lower(trim(question))) as h, arg_max({_NEW_ID}, (confidence, pos)) as new_id from gen where trim(question) <> '' and trim(answer) <> '' group by 1, 2),
 q as (select faq_id, md5(lower(trim(arg_min(question, (extracted_at, question, answer))))) as h from ids group by 1),
 held as (select src.faq_id, src.document_id as d, q.h from src join q using (faq_id) where src.document_id in (select document_id from gen)),
 gone as (select held.faq_id, held.d from held left join g on g.d = held.d and g.h = held.h where g.new_id is null or g.new_id <> held.faq_id),
 put as (select distinct new_id as faq_id, d from g)"""


@query(f"""{_SYNC}, every as (select faq_id, document_id as d from src union select * from put), rest as (select * from every anti join gone using (faq_id, d)),
 act as (select faq_id, case when faq_id not in (select faq_id from put) then 'kept' when faq_id not in (select faq_id from src) then 'created' when exists (select 1 from put p where p.faq_id = x.faq_id and (p.faq_id, p.d) not in (select faq_id, document_id from src)) then 'merged' else 'refreshed' end as a from (select distinct faq_id from every) x)
 select act.faq_id, case when act.faq_id not in (select faq_id from gone) then a when count(rest.d) = 0 then 'deleted' when a = 'kept' then 'removed_source' else a end as fate, coalesce(string_agg(rest.d, ',' order by rest.d), '') as documents from act left join rest on rest.faq_id = act.faq_id group by act.faq_id, a""")
def faq_sync_applied(s, d):
    """The FAQs after a new generation for every document: one conversation in five isn't asked again, every other has new answers."""
    got = faqs.synced(fx.faqs(s, d), _generated_all(s, d))
    return got.select("faq_id", "fate", F.array_join(F.sort_array("source_documents.document_id"), ",").alias("documents"))


def _generated_all(s, d):
    return fx.faq_rows(s, d).where("conv_id % 5 <> 0").select("document_id", F.col("extracted_at").alias("pos"), "question", F.when(F.col("conv_id") % 2 == 1, F.concat("answer", F.lit(" v2"))).otherwise(F.col("answer")).alias("answer"), "confidence", "url", "extracted_at")


@query(f"""{_SYNC}, o as (select d, h, min(faq_id) as old_id from held group by 1, 2), x as (select coalesce(g.d, o.d) as d, new_id, old_id from g full join o on g.d = o.d and g.h = o.h)
,
 every as (select faq_id, document_id as d from src union select * from put), rest as (select * from every anti join gone using (faq_id, d)), empty as (select distinct faq_id from gone where faq_id not in (select faq_id from rest)),
 lasts as (select faq_id, max(d) as d from gone where faq_id in (select faq_id from empty) group by 1), out as (select g.d, count(*) filter (where l.d is null) as removed_sources, count(*) filter (where l.d is not null) as deleted from gone g left join lasts l on l.faq_id = g.faq_id and l.d = g.d group by 1),
 asked as (select d as document_id, count(*) filter (where new_id is not null and new_id not in (select faq_id from src)) as created,
 count(*) filter (where new_id in (select faq_id from src) and (new_id, d) not in (select faq_id, document_id from src)) as merged, count(*) filter (where (new_id, d) in (select faq_id, document_id from src)) as refreshed,
 count(*) filter (where new_id <> old_id) as reassigned, count(*) filter (where new_id is null) as stale from x group by 1)
 select coalesce(document_id, out.d) as document_id, coalesce(created, 0) as created, coalesce(merged, 0) as merged, coalesce(refreshed, 0) as refreshed, coalesce(reassigned, 0) as reassigned, coalesce(stale, 0) as stale, coalesce(removed_sources, 0) as removed_sources, coalesce(deleted, 0) as deleted from asked full join out on out.d = asked.document_id""")
def faq_sync_counters(s, d):
    return faqs.sync_counters(fx.faqs(s, d), _generated_all(s, d))


_REVIEWED = f"""{fx.FAQ_ROWS}, one as (select faq_id, min(document_id) as low from src group by 1), s as (select faq_id as submission, case when faq_id < '4' then faq_id when faq_id < '5' then 'none' else {fx.sql_uuid5("trim('Q ' || faq_id) || '|' || 'A'", 'a1b2c3d4e5f67890abcdef1234567890')} end as target, faq_id < '5' as asked, case when faq_id < '2' then low else {fx.sql_uuid5("'https://docs.example.com/r' || low")} end as document_id from one where faq_id < '6'),
 a as (select submission, target as faq_id, document_id, case when target = 'none' then 'not_found' when faq_id is null then 'created' when (target, s.document_id) in (select faq_id, document_id from src) then 'refreshed' else 'merged' end as action from s left join (select distinct faq_id from src) k on k.faq_id = s.target)"""


def _reviewed(s, d):
    f, id = fx.faqs(s, d), F.col("faq_id")
    low = F.array_min("source_documents.document_id")
    rows = f.where("faq_id < '6'").select(
        id.alias("submission"), F.when(id < "4", F.lit(" kept ")).otherwise(F.concat(F.lit("Q "), id)).alias("question"), F.lit("A").alias("answer"), F.when(id < "4", id).when(id < "5", "none").otherwise(" ").alias("merge_with_id"),
        F.when(id < "2", F.concat(F.lit("https://docs.example.com/"), low)).otherwise(F.concat(F.lit("https://docs.example.com/r"), low)).alias("source_url"), F.when(id < "2", low).alias("document_id"), F.lit("z").alias("extracted_at"),
    )
    return faqs.reviewed(f, rows)


@query(f"with {_REVIEWED} select submission, faq_id, action from a")
def faq_reviewed(s, d):
    """Reviewed entries: some with a known source or a new one for a chosen FAQ, some for one that isn't there, some new."""
    return _reviewed(s, d)[1]


@query(f"with {_REVIEWED}, put as (select faq_id, document_id from src union select faq_id, document_id from a where action <> 'not_found') select faq_id, count(*)::bigint as source_count, string_agg(document_id, ',' order by document_id) as documents from put group by 1")
def faq_reviewed_applied(s, d):
    return _reviewed(s, d)[0].select("faq_id", F.col("source_count").cast("bigint").alias("source_count"), F.array_join(F.sort_array("source_documents.document_id"), ",").alias("documents"))


@query(f"with {fx.FAQ_ROWS}, t as (select min(faq_id) as id from src) select faq_id, case when faq_id <> (select id from t) then 'kept' when bool_or(document_id = 'new') then 'already_exists' else 'added' end as action, (count(*) + (faq_id = (select id from t))::int)::bigint as source_count from src group by 1")
def faq_add_source(s, d):
    f = fx.faqs(s, d)
    target = f.agg(F.min("faq_id")).first()[0]
    source = F.struct(F.lit("new").alias("document_id"), F.lit("https://docs.example.com/new").alias("url"), F.lit("z").alias("extracted_at"), F.lit(0.5).alias("confidence"))
    return faqs.source_added(f, target or "", source).select("faq_id", "action", F.col("source_count").cast("bigint").alias("source_count"))


@query(f"with {fx.FAQ_ROWS}, t as (select min(faq_id) as id from src where document_id = '7'), g as (select faq_id, count(*) as n, count(*) filter (where document_id = '7') as hit from src group by 1) select faq_id, case when faq_id <> coalesce((select id from t), '') then 'kept' when n = hit then 'deleted' else 'removed' end as action, (n - case when faq_id = coalesce((select id from t), '') then hit else 0 end)::bigint as source_count from g")
def faq_take_source(s, d):
    f = fx.faqs(s, d)
    target = f.where(F.array_contains("source_documents.document_id", "7")).agg(F.min("faq_id")).first()[0]
    return faqs.source_removed(f, target or "", "7").select("faq_id", "action", F.col("source_count").cast("bigint").alias("source_count"))


@query(f"with {fx.FAQ_ROWS} select 'document' as kind, doc_id::varchar as id from documents where doc_id <> 5 union all select distinct 'faq', faq_id from src where url <> 'https://docs.example.com/5'")
def faq_cascade(s, d):
    docs = fx.table(s, d, "documents").select("doc_id").withColumn("n", F.col("doc_id").cast("string")).withColumn("doc_id", ids.document_id(F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))))
    left, f = faqs.cascade(docs, fx.faqs(s, d), "https://docs.example.com/5")
    return left.select(F.lit("document").alias("kind"), F.col("n").alias("id")).unionByName(f.select(F.lit("faq").alias("kind"), F.col("faq_id").alias("id")))


@query(f"with {fx.FAQ_ROWS} select faq_id, case when faq_id < '8' then count(*) else 1 end::bigint as source_count, case when faq_id < '8' then round(max(confidence), 6) else 1.0::double end as aggregated_confidence from src group by 1")
def faq_response(s, d):
    """FAQs of the old form, without sources, answer with their one document."""
    f = fx.faqs(s, d).withColumn("source_documents", F.when(F.col("faq_id") < "8", F.col("source_documents")))
    return faqs.response(f).select("faq_id", F.col("source_count").cast("bigint").alias("source_count"), _r("aggregated_confidence").alias("aggregated_confidence"))


@query(f"with {fx.FAQ_ROWS} select distinct faq_id from src where document_id = '4' order by faq_id limit 20")
def faq_list_of_document(s, d):
    return faqs.listed(fx.faqs(s, d), "4", limit=20).select("faq_id")


@query(f"with {fx.TOKENS}, {_PRE} select doc_id + 1000 as faq_id, round(score, 6) as score from late semi join pre using (doc_id) order by late.score desc, doc_id limit 5")
def faq_duplicates(s, d):
    return search.duplicate_faqs(_answers(s, d), fx.query_vectors(s, d)).select("faq_id", _r("score").alias("score"))


@query(f"with {fx.TOKENS}, {_PRE} select doc_id + 1000 as faq_id, round(score, 6) as score from (select * from late semi join pre using (doc_id) order by late.score desc, doc_id limit 10) where score >= 1.0")
def faq_tool(s, d):
    return search.faq_tool(_whole(s, d)[0], _sourced(s, d), fx.query_vectors(s, d), 10, least=1.0).select("faq_id", _r("score").alias("score"))


@query(f"with {fx.TOKENS}, pre as (select doc_id from dense order by dense.score desc, doc_id limit 100) select doc_id, round(score, 6) as score from late semi join pre using (doc_id) order by late.score desc, doc_id limit 7")
def admin_search(s, d):
    return search.admin_search(fx.tokens(s, d), fx.query_vectors(s, d), 7).select("doc_id", _r("score").alias("score"))


@query(f"with {fx.FAQ_ROWS} select distinct faq_id, 0.0::double as score from src where contains(url, '/1') order by faq_id limit 20")
def faq_scan(s, d):
    f = fx.faqs(s, d).withColumn("url", F.lit(""))
    return search.scanned(f, querylang.parse(""), 20, predicate=predicates.faq_predicate(querylang.parse("site:docs.example.com inurl:/1 -filetype:pdf")), key="faq_id").select("faq_id", "score")


@query(f"with {fx.FAQ_ROWS} select faq_id from src group by 1 having not bool_or(url in ('https://docs.example.com/4', 'https://docs.example.com/8'))")
def faq_exclude_urls(s, d):
    return search.faqs_without_urls(fx.faqs(s, d), ["https://docs.example.com/4", "https://docs.example.com/8"]).select("faq_id")


@query(f"""with {fx.WEB}, {fx.TOKENS}, c as (select web.*, l.score, d.score as ds from web join late l on l.doc_id = web.n % (select count(*) from late) join dense d on d.doc_id = l.doc_id),
 pre as (select * from c order by ds desc, doc_id limit 500), hits as (select * from pre order by score desc, doc_id limit 3),
 seeds as (select n, doc_id, row_number() over (order by doc_id) as pos from hits),
 r as (select t.n, min([s.pos, k]) as p, arg_min(s.n, [s.pos, k]) as via from seeds s join (select n, unnest(hyperlinks) as l, unnest([0, 1, 2]) as k from web) w on w.n = s.n join web t on split_part(w.l, '#', 1) = t.url where t.n not in (select n from seeds) group by t.n)
 select n, 1 as hop, via from r order by p limit 4""")
def kb_related(s, d):
    """The pages that the three best hits link to, in order of discovery."""
    web, links = _pages(s, d)
    docs = _with_tokens(web, fx.tokens(s, d))
    none = _sourced(s, d).limit(0)
    got = search.knowledge_base(docs, none, "anything", fx.query_vectors(s, d), 3, follow_links=True, max_hops=1, max_related=4, links=links).related
    n, v = web.select("doc_id", "n"), web.select(F.col("doc_id").alias("via"), F.col("n").alias("v"))
    return got.join(n, "doc_id").join(v, "via").select("n", "hop", F.col("v").alias("via"))


@query(f"with {fx.FEEDBACK} select id, case when id % 7 = 0 then 'user_rating' when id % 5 = 0 then 'ranking_score' when id % 11 = 0 then 'content_type' when id % 13 = 0 then 'query' end as problem from feedback")
def feedback_problems(s, d):
    n = F.col("id")
    rows = fx.feedback(s, d).withColumns({
        "user_rating": F.when(n % 7 == 0, 5).otherwise(F.col("user_rating")), "ranking_score": F.when(n % 5 == 0, 9).otherwise(F.col("ranking_score")),
        "content_type": F.when(n % 11 == 0, "x").otherwise(F.col("content_type")), "query": F.when(n % 13 == 0, " ").otherwise(F.col("query")),
    })
    return rows.select("id", feedback.problems(rows).alias("problem"))


@query("select doc_id as id, 'Key: ' || source || chr(10) || 'Value: ' || lang as text, 'kv' as content_type from documents")
def feedback_kv_rows(s, d):
    t = fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kv_key"), F.col("lang").alias("kv_value"))
    return feedback.kv_rows(t).select("id", "text", "content_type")


@query("select doc_id as run_id from documents order by n_chars desc, doc_id desc limit 25")
def recent_runs(s, d):
    return queues.recent_runs(fx.table(s, d, "documents").select(F.col("doc_id").alias("run_id"), F.col("n_chars").alias("started_at"))).select("run_id")


@query(f"""with {fx.TEXTS}, p as (select doc_id, 'Document: ' || url || chr(10) || case when length(content) > 5000 then rtrim(substr(content, 1, 5000), ' ') || '...' else content end as body from texts),
 u as (select b.n // 7 as g, string_agg('Source: ' || url || chr(10) || case when length(content) > 3200 then rtrim(substr(content, 1, 3200), ' ') || '...' else content end, chr(10) || chr(10) order by n) as t from texts b where n % 7 between 1 and 5 group by 1)
 select p.doc_id, md5(case when u.t is null then body else body || chr(10) || chr(10) || u.t end) as prompt from p left join u on p.doc_id = (u.g * 7)::varchar""")
def agent_prompt(s, d):
    """Every seventh document with the five after it."""
    t = fx.texts(s, d)
    n = F.col("n")
    supporting = t.where((n % 7 >= 1) & (n % 7 <= 6)).select((n - n % 7).cast("string").alias("doc_id"), (n % 7).alias("pos"), "url", "content")
    return agent.prompt(t, supporting).select("doc_id", F.md5(F.encode("prompt", "utf-8")).alias("prompt"))


@query("select 'dense_search' as probe, 'ok' as status, 1::bigint as found union all select 'hybrid_search', 'ok', 1 union all select 'faq_search', 'ok', 1 union all select 'count', 'ok', 1 union all select 'scroll', 'ok', 1 union all select 'broken', 'degraded', null")
def health_probes(s, d):
    checks = {**health.standard(fx.tokens(s, d), _answers(s, d), fx.query_vectors(s, d)), "broken": lambda: s.table("no_such_table")}
    return health.probes(s, checks, optional=("broken",)).select("probe", "status", "found")


@query("select max(doc_id) as next, (select count(*) from documents) as total from (select doc_id from documents where doc_id > 40 order by doc_id limit 10)")
def keyset_cursor(s, d):
    t = fx.table(s, d, "documents")
    return ingest.cursor_of(ingest.page(t, 40, 10), t, 10)


@query("select doc_id, case when lang in ('de', 'en') and doc_id % 3 <> 0 then lang else 'Unknown' end as language from documents")
def queue_languages(s, d):
    t = fx.table(s, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(0.9).alias("accuracy"))
    return queues.with_language(t).select("doc_id", "language")


@query(f"""with u as (select page_id, case page_id % 3 when 0 then url || '/' when 1 then 'HTTPS' || substr(url, strpos(url, ':')) else url end as url from pages), p as (select page_id, url, {_URL_PARTS} from u)
 select page_id, array_to_string(list_sort(list_distinct(list_filter({_URL_FORMS}, lambda x: x is not null and x <> ''))), ' ') as forms from p""")
def url_forms(s, d):
    """All forms of urls with added slashes and upper-case schemes."""
    n, url = F.col("page_id"), F.col("url")
    given = F.when(n % 3 == 0, F.concat(url, F.lit("/"))).when(n % 3 == 1, F.concat(F.lit("HTTPS"), F.expr("substring(url, instr(url, ':'))"))).otherwise(url)
    return fx.table(s, d, "pages").select("page_id", F.array_join(F.array_sort(urls.variants(given)), " ").alias("forms"))


@query(f"with {fx.TOKENS}, pre as (select doc_id, score + {_DECAY} as score from (select * from dense order by dense.score desc, doc_id limit 10)) select doc_id, round(score, 4) as score from pre")
def dense_recency(s, d):
    """Without late vectors recency reorders the dense page."""
    query_vectors = search.Vectors(fx.query_vectors(s, d).dense)
    got = search.hybrid(_timed(s, d), query_vectors, 10, boost={"now": _now(), "days": 10, "midpoint": 0.5})
    return got.select("doc_id", _r("score", 4).alias("score"))


@query(f"""with {_EDGES}, r1 as (select dst as n, min([0, k]) as p from e where src = 5 and dst <> 5 group by dst),
 r2 as (select e.dst as n, min(list_append(r1.p, k)) as p from r1 join e on e.src = r1.n where e.dst <> 5 and e.dst not in (select n from r1) group by e.dst)
 select n, hop from (select n, 1 as hop, p from r1 union all select n, 2, p from r2) order by hop, p limit 3""")
def supporting_documents(s, d):
    """What a generation for one page also reads: the first three pages within two links."""
    web, links = _pages(s, d)
    found = graph.related(web, web.where("n = 5").select("doc_id", F.lit(0).alias("pos")), 2, 3, links=links)
    return found.join(web.select("doc_id", "n"), "doc_id").select("n", "hop")


@query("""with recursive total as (select count(*) as n from documents), q as (select doc_id, [doc_id] as place from documents where doc_id in (0, 3) union all
 select c.doc_id, list_append(q.place, c.k) from q join (select doc_id, (doc_id - 4) // 30 as parent, (doc_id - 4) % 30 as k from documents where doc_id >= 4) c on c.parent = q.doc_id and q.doc_id % 5 <> 1),
 o as (select doc_id, row_number() over (order by place) as position from q) select doc_id::varchar as doc_id, position::int as position, case when doc_id % 5 = 1 then 'skipped' else 'processed' end as status from o where position <= 150""")
def agent_run_order(s, d):
    """The first 150 documents of a run from two seeds: each names thirty others, but one in five is skipped."""
    t = fx.table(s, d, "documents").select("doc_id")
    n, total = F.col("doc_id").cast("bigint"), t.count()

    def process(some):
        named = F.filter(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: n * 30 + 4 + k), lambda x: x < total)
        status = F.when(n % 5 == 1, "skipped").otherwise("processed")
        return some.select("doc_id", status.alias("status"), F.when(n % 5 != 1, F.transform(named, lambda x: x.cast("string"))).alias("supporting"))

    seeds = t.where("doc_id in (0, 3)").select("doc_id", F.col("doc_id").alias("pos"))
    return agent.run(seeds, process, 150, batch=50).documents


@query("select doc_id, length(text)::bigint as n from documents")
def embedding_batches(s, d):
    """The embedding hook, in batches of eight, with a model that counts characters."""

    def model(texts):
        return [[float(len(t))] for t in texts]

    t = fx.table(s, d, "documents").select("doc_id", F.col("text").alias("text_to_embed"))
    return embedding.embedded(t, model).select("doc_id", F.col("dense")[0].cast("bigint").alias("n"))
