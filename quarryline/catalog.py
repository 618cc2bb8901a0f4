"""All queries of the library's own operators, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .functions import text as T
from .operators import evidence, generation, guards, ingest, retrieval, sessions, store
from .plans import answering
from .providers import embed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# White space of a text, as RE2 writes it.
W = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[{W}]+', ' ', 'g')")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[{W}]+'), lambda w: w <> '')"


def _terms(x: str) -> str:
    marks = T.TERM_PUNCTUATION.replace("'", "''")
    return f"list_distinct(list_transform(list_filter(list_transform({_words(x)}, lambda w: trim(w, '{marks}')), lambda w: length(w) > 2), lambda w: lower(w)))"


def _any(x: str, values: list[str]) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(x, v.replace("'", "''")) for v in values) + ")"


# Ingestion ----------------------------------------------------------------------------------------------------------


@query(f"""select article_id, cleaned_at, {_strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, 'http[^{W}]+', '', 'g'), '[^{W}]+@[^{W}]+', '', 'g'), 'Page last reviewed.*?[0-9]{{4}}', '', 'g'), 'Next review due.*?[0-9]{{4}}', '', 'g'), '(?m)^[{W}]*Contents[{W}]*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")} as content from articles""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "articles")
    return a.select("article_id", "cleaned_at", T.clean_text(F.col("content"), F.col("source_dir")).alias("content"))


CLEANED = f"""{_strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, 'http[^{W}]+', '', 'g'), '[^{W}]+@[^{W}]+', '', 'g'), 'Page last reviewed.*?[0-9]{{4}}', '', 'g'), 'Next review due.*?[0-9]{{4}}', '', 'g'), '(?m)^[{W}]*Contents[{W}]*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")}"""


@query(f"""select article_id, cleaned_at, case when length({_strip('content')}) > 0 and length({_strip('c')}) / length({_strip('content')}) < 0.5 then content else c end as content from (select article_id, cleaned_at, content, case when article_id % 2 = 0 then {CLEANED} else array_to_string(list_filter(string_split(content, chr(10)), lambda x: length(x) > 60), chr(10)) end as c from articles)""")
def clean_guard(spark: SparkSession, d: str) -> DataFrame:
    """The guard on whole texts: cleaned by the rules, or cut to their long lines, which some of them don't survive."""
    a = _t(spark, d, "articles")
    long = F.array_join(F.filter(F.split("content", "\n"), lambda x: F.length(x) > 60), "\n")
    cleaned = F.when(F.col("article_id") % 2 == 0, T.clean_text(F.col("content"), F.col("source_dir"))).otherwise(long)
    return a.select("article_id", "cleaned_at", T.clean_guard(F.col("content"), cleaned).alias("content"))


@query()
def clean_guard_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The guard on the rules' cleaning of all texts."""
    a = _t(spark, d, "articles")
    return a.select("article_id", "cleaned_at", T.clean_guard(F.col("content"), T.clean_text(F.col("content"), F.col("source_dir"))).alias("content"))


PAGE = "concat('<html><head><title>t</title><style>p{}</style></head><body><nav><a href=\"/conditions/', article_id, '-of-the-day/\">x</a></nav><article><h1>', coalesce(title, ''), '</h1><p>', replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '</p><script>x()</script></article></body></html>')"


@query(f"""with l as (select article_id, cleaned_at, title, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') as l from articles)
    select article_id, cleaned_at, coalesce(nullif({_squeeze("coalesce(title, '')")}, ''), 'Unknown') as title, array_to_string(list_concat(case when {_strip("coalesce(title, '')")} = '' then [] else [{_strip('title')}] end, l), chr(10)) as content from l""")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "articles").select(F.struct("article_id", "cleaned_at").alias("k"), F.expr(PAGE).alias("html"))
    return ingest.html_extract(pages, "k", "html", "nhs").select("k.*", "title", "content")


@query("""select distinct 'https://leaf.example/conditions/' || article_id || '-of-the-day/' as url from articles""")
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    return ingest.link_discovery(_t(spark, d, "articles").select(F.expr(PAGE).alias("html")), "html", base="https://leaf.example")


@query(r"""select distinct url, regexp_extract(regexp_replace(url, '[?#](?s:.*)$', ''), '([^/]+)/*$', 1) as slug from articles where url is not null""")
def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "articles").where("url is not null").select("url", T.url_slug(F.col("url")).alias("slug")).distinct()


SECTIONS = f"""with l as (select rid, article_id, cleaned_at, unnest(l) as line, generate_subscripts(l, 1) as i from (select row_number() over () as rid, article_id, cleaned_at, string_split(content, chr(10)) as l from articles where content is not null)),
    b as (select *, case when i > 2 and lag(line) over (partition by rid order by i) = '' and regexp_matches(line, '^[A-Z][a-zA-Z{W},()\\-]+$') then 1 else 0 end as f from l),
    g as (select *, sum(f) over (partition by rid order by i) as section_no from b),
    p as (select rid, article_id, cleaned_at, section_no, {_strip('string_agg(line, chr(10) order by i)')} as part from g group by all),
    h as (select *, {_strip("split_part(part, chr(10), 1)")} as first from p where part <> ''),
    s as (select article_id, cleaned_at, section_no::int as section_no, length(first) < 40 and not ends_with(first, '.') and not starts_with(first, '-') as heading, first, part from h)"""


@query(f"""{SECTIONS} select article_id, cleaned_at, section_no, case when heading then first else 'General' end as section, case when heading then {_strip("substr(part, length(split_part(part, chr(10), 1)) + 2)")} else part end as body from s""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sections(_t(spark, d, "articles").select("article_id", "cleaned_at", "content"))


@query(f"select doc_id, len({_words('text')})::int as n_words from documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_words"))


@query()
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.token_chunks(_t(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("body")))


@query()
def chunk_render(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_articles(_t(spark, d, "articles"))


@query("select doc_id, 'chunk_' || (row_number() over (order by doc_id) - 1) as chunk_id from documents where text is not null")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.numbered(_t(spark, d, "documents").where("text is not null").select("doc_id"), ["doc_id"])
    return rows.select("doc_id", F.concat(F.lit("chunk_"), "chunk_no").alias("chunk_id"))


@query("""select 'articles' as kind, article_id::varchar as id, source from articles union all select 'evidence', evidence_id, source from evidence_records""")
def chunk_union(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "articles").select(F.col("article_id").cast("string").alias("id"), "source")
    return ingest.chunk_union({"articles": a, "evidence": _t(spark, d, "evidence_records").select(F.col("evidence_id").alias("id"), "source")})


@query("""select case when doc_type = 'guideline' then 'medical' else 'other' end as part, count(*) as n from documents group by 1""")
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    a, b = ingest.chunk_split(docs.withColumn("kind", F.when(F.col("doc_type") == "guideline", "medical_kb").otherwise(F.col("doc_type"))), F.col("kind"))
    return a.select(F.lit("medical").alias("part")).union(b.select(F.lit("other").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


POINT_SQL = f"""substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query(f"""select doc_id, {POINT_SQL} as point_id from (select doc_id, sha1(unhex('{T.POINT_NAMESPACE}') || encode(text)) as h from documents where text is not null)""")
def point_id(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.point_id(F.col("text")).alias("point_id"))


@query("""with f as (select text, source, min(doc_id) as o from documents where text is not null group by text, source)
    select md5(text) as text_hash, array_to_string(list(source order by o) filter (where source is not null), '|') as sources, (select count(*) from documents x where x.text = f.text) as n from f group by text""")
def dedup_sources(spark: SparkSession, d: str) -> DataFrame:
    points = ingest.dedup_sources(_t(spark, d, "documents"), order=["doc_id"])
    return points.select(F.md5("text").alias("text_hash"), F.nullif(F.array_join("sources", "|"), F.lit("")).alias("sources"), "n")


@query("""with a as (select text, count(*) as n from documents where text is not null and doc_type = 'leaflet' group by text), b as (select text, count(*) as n from documents where text is not null and doc_type <> 'leaflet' group by text)
    select md5(coalesce(a.text, b.text)) as text_hash, coalesce(a.n, 0) + coalesce(b.n, 0) as n, case when a.text is null then 'new' when b.text is null then 'kept' else 'updated' end as state from a full join b on a.text = b.text""")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    stored, incoming = (ingest.dedup_sources(docs.where(f"doc_type {op} 'leaflet'"), order=["doc_id"]) for op in ("=", "<>"))
    return ingest.index_upsert(stored, incoming).select(F.md5("text").alias("text_hash"), "n", "state")


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    return ingest.incremental_pending(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""select 'articles' as collection, count(*) as n, count(distinct article_id) as n_ids from articles union all select 'documents', count(*), count(distinct doc_id) from documents union all select 'evidence', count(*), count(distinct evidence_id) from evidence_records""")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_stats({n: (_t(spark, d, t), k) for n, t, k in (("articles", "articles", "article_id"), ("documents", "documents", "doc_id"), ("evidence", "evidence_records", "evidence_id"))})


@query(f"""select article_id, cleaned_at, {_strip("regexp_replace(c, '\\n{3,}', chr(10) || chr(10), 'g')")} as content from (select article_id, cleaned_at, {"regexp_replace(" * len(T.SOURCE_RULES["mayo"])}{"regexp_replace(" * 5}content{"".join(f", '{p.replace('%s', W).replace('(?d)', '').replace('(?md)', '(?m)')}', '', 'g')" for p, _ in T.GENERAL_RULES + T.SOURCE_RULES["mayo"])} as c from articles)""")
def clean_text_mayo(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "articles").select("article_id", "cleaned_at", T.clean_text(F.col("content"), F.lit("mayo")).alias("content"))


@query(f"""select article_id, cleaned_at, 'Unknown' as title, array_to_string(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) as content from (select article_id, cleaned_at, replace(content, '&', 'and') as content from articles)""")
def html_extract_ads(spark: SparkSession, d: str) -> DataFrame:
    html = F.expr("concat('<main><div class=\"ad\">', coalesce(url, ''), '</div><header>x</header>', replace(replace(coalesce(content, ''), '&', 'and'), '<', '&lt;'), '</main>')")
    return ingest.html_extract(_t(spark, d, "articles").select(F.struct("article_id", "cleaned_at").alias("k"), html.alias("html")), "k", "html", "mayo").select("k.*", "title", "content")


@query()
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", embed(F.col("text")).alias("vector"))


@query(f"""select doc_id, case when n = '' then '{settings.DEFAULT_MODEL}' when {' or '.join(f"starts_with(lower(n), '{x}')" for x in settings.PROVIDERS)} then n when starts_with(lower(n), 'gemini-') then 'gemini/' || n else n end as model
    from (select doc_id, trim(coalesce(case doc_id % 5 when 0 then 'gemini-' || source when 1 then 'Groq/' || source when 2 then ' ' else source end, '')) as n from documents)""")
def normalize_model(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("gemini-"), "source")).when(k == 1, F.concat(F.lit("Groq/"), "source")).when(k == 2, " ").otherwise(F.col("source"))
    return _t(spark, d, "documents").select("doc_id", settings.model_id(name).alias("model"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(source, ''), 'e'), lambda x: trim(x)), lambda x: x <> ''), ',') as k, len(list_distinct(list_filter(list_transform(string_split(coalesce(source, '') || ', ' || coalesce(source, ''), ','), lambda x: trim(x)), lambda x: x <> '')))::int as n_keys from documents")
def key_list(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce("source", F.lit(""))
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.filter(F.transform(F.split(source, "e"), lambda x: F.trim(x)), lambda x: x != ""), ",").alias("k"), F.size(settings.keys_of(F.concat(source, F.lit(", "), source))).alias("n_keys"))


@query("""select source_dir, case when contains(lower(source_dir), 'mayo') then 'mayo' else lower(source_dir) end as name, count(*) as n from articles group by all""")
def source_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "articles").groupBy("source_dir", ingest.source_name(F.col("source_dir")).alias("name")).agg(F.count("*").alias("n"))


@query(f"""select article_id, cleaned_at, coalesce(length({_strip('content')}) > 2000, false) as too_long from articles""")
def context_warning(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "articles").select("article_id", "cleaned_at", ingest.too_long(F.col("content"), 2000).alias("too_long"))


def _page(title: str, root: str, inside: str = "") -> str:
    return f"concat('<html><head><title>t</title></head><body><div>', coalesce(url, ''), '</div>{root}<h1>', {title}, '</h1>{inside}<p>', replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '</p></div></body></html>')"


LINES = f"array_to_string(list_concat(case when {_strip('coalesce(h, {q})')} = '' then [] else [{_strip('h')}] end, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')), chr(10))".replace("{q}", "''")


@query(f"""select article_id, cleaned_at, coalesce(nullif({_squeeze("coalesce(h, '')")}, ''), 'Unknown') as title, {LINES} as content from (select *, title as h from articles)""")
def html_extract_medline(spark: SparkSession, d: str) -> DataFrame:
    html = F.expr(_page("coalesce(title, '')", '<div id="topic">', "<nav>away</nav>"))
    return ingest.html_extract(_t(spark, d, "articles").select(F.struct("article_id", "cleaned_at").alias("k"), html.alias("html")), "k", "html", "medline").select("k.*", "title", "content")


@query(f"""select article_id, cleaned_at, case when h = 'Recommendations' then 'NG' || article_id || ' Recommendations' else coalesce(nullif({_squeeze("coalesce(h, '')")}, ''), 'NICE Guideline NG' || article_id) end as title, {LINES} as content
    from (select *, case when article_id % 3 = 0 then 'Recommendations' else title end as h from articles) where coalesce({_squeeze('h')}, '') <> 'Unknown'""")
def html_extract_nice(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "articles").withColumn("h", F.when(F.col("article_id") % 3 == 0, "Recommendations").otherwise(F.col("title"))).where(F.coalesce(T.squeeze(F.col("h")), F.lit("")) != "Unknown")
    html = F.expr(_page("coalesce(h, '')", '<div class="wide chapter">', "<aside>away</aside>"))
    got = ingest.html_extract(a.select(F.struct("article_id", "cleaned_at").alias("k"), html.alias("html")), "k", "html", "nice")
    return got.select("k.*", ingest.nice_title(F.col("title"), F.concat(F.lit("ng"), F.col("k.article_id"))).alias("title"), "content")


@query("""select count(*) as total, count(*) filter (where url is not null and content <> '') as processed, count(*) filter (where url is not null and coalesce(content, '') = '') as skipped, count(*) filter (where url is null) as failed from articles""")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "articles")
    status = F.when(F.col("url").isNull(), "failed").when(F.coalesce("content", F.lit("")) == "", "skipped").otherwise("processed")
    return store.outcome_counts(a, status)


@query(f"""select doc_id, {POINT_SQL} as point_id, {POINT_SQL} as chunk_id, title as doc_title, 'abc1234' as git_commit, '1' as script_version, 'hash' as embed_model_id, '' as embed_revision from (select doc_id, title, sha1(unhex('{T.POINT_NAMESPACE}') || encode(text)) as h from documents where text is not null)""")
def payload_build(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "documents").where("text is not null").select("doc_id", T.point_id(F.col("text")).alias("point_id"), F.lit(None).cast("string").alias("chunk_id"), F.col("title").alias("doc_title"), "source")
    return ingest.payload_build(p, "hash", git_commit="abc1234").drop("indexed_at")


@query("""select doc_id as id, coalesce(text, '') as text, coalesce(title, '') as doc_title, coalesce(case when doc_id % 2 = 0 then lang end, source, '') as source, '' as section, coalesce(url, '') as url, coalesce(doc_type, '') as type from documents""")
def payload_normalize(spark: SparkSession, d: str) -> DataFrame:
    sources = F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text", F.col("title").alias("doc_title"), "source", "url", F.col("doc_type").alias("type"), sources.alias("sources"))
    return ingest.payload_normalize(p)


@query("""select doc_id as point_id, title from documents where doc_type = 'leaflet' union all select doc_id, 'new ' || doc_id from documents where doc_type = 'faq'""")
def collection_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A collection is created, filled, and filled again with some points replaced."""
    docs = _t(spark, d, "documents")
    known = store.Collections(spark, store.fresh_dir(spark, "collections"))
    name = "leaflets"
    known.create(name, "point_id bigint, title string", "clean")
    known.upsert(name, docs.where("doc_type in ('leaflet', 'faq')").select(F.col("doc_id").alias("point_id"), "title"))
    known.upsert(name, docs.where("doc_type = 'faq'").select(F.col("doc_id").alias("point_id"), F.concat(F.lit("new "), "doc_id").alias("title")))
    return known.read(name)


@query("""select vec_id as id, title from embeddings join documents on doc_id = vec_id where vec_id % 50 = 0""")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    points = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", F.array(F.lit(0.0)).alias("vector"))
    return store.looked_up(points, _t(spark, d, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("id")), "id")


@query("select doc_id, title from documents order by doc_id limit 100")
def scroll_scan(spark: SparkSession, d: str) -> DataFrame:
    return store.scrolled(_t(spark, d, "documents").select("doc_id", "title"), 100, "doc_id")


# Guards and routing -------------------------------------------------------------------------------------------------


@query()
def pii_mask(spark: SparkSession, d: str) -> DataFrame:
    masked, kinds = T.mask_pii(F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", masked.alias("masked"), F.array_join(kinds, ",").alias("kinds"))


@query()
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    r = guards.sanitized(_t(spark, d, "chat_requests").distinct())
    return r.select("request_id", "received_at", "original_length", "sanitized_text", F.array_join("findings", ",").alias("findings"), "allowed")


@query(r"""select doc_id, regexp_matches(text, '(?is)\b(ignore|disregard|override)\b.{0,80}\b(previous| acima|system|developer|instructions?)\b') or regexp_matches(text, '(?i)\b(system|developer)\s*(prompt|message)\b') or regexp_matches(text, '(?i)\b(jailbreak| DAN mode|do anything now)\b') or regexp_matches(text, '(?is)\b(reveal|print|show|leak)\b.{0,50}\b(prompt|instructions?|secret|api key)\b') or regexp_matches(text, '(?i)<\s*(system|instruction|prompt)\b') as injected from documents where text is not null""")
def injection_flag(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.injected(F.col("text")).alias("injected"))


@query(r"""select doc_id, concat_ws(',', case when regexp_matches(text, '(?i)<\s*/?\s*script\b|javascript\s*:') then 'malicious:script' end, case when regexp_matches(text, '(?i)\bon\w+\s*=') then 'malicious:event_handler' end, case when regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') then 'malicious:control_character' end) as findings from documents where text is not null""")
def malicious_flag(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.malicious(F.col("text")), ",").alias("findings"))


@query(r"""select doc_id, case when length(regexp_replace(text, '[^\x{0600}-\x{06ff}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) then 'ar' else 'en' end as detected from documents where text is not null""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@query("""select doc_id, md5(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) as folded from documents where text is not null""")
def digit_fold(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.fold_digits(F.col("text"))).alias("folded"))


@query(f"""with q as (select distinct request_id, lower({_squeeze("coalesce(text, '')")}) as q from chat_requests) select request_id, case when {_any('q', guards.EMERGENCY)} then 'emergency' when {_any('q', guards.CLINIC)} then 'clinic_query' else 'medical_query' end as query_class, count(*) as n from q group by all""")
def classify(spark: SparkSession, d: str) -> DataFrame:
    q = guards.classified(_t(spark, d, "chat_requests").select("request_id", F.lower(T.squeeze(F.coalesce("text", F.lit("")))).alias("text")).distinct())
    return q.groupBy("request_id", "query_class").agg(F.count("*").alias("n"))


@query(f"""with q as (select distinct request_id, lower({_strip("coalesce(text, '')")}) as q from chat_requests) select request_id, {_any('q', guards.SYMPTOM)} and ({_any('q', guards.PERSONAL)} or not {_any('q', guards.GENERAL)}) as is_personal, count(*) as n from q group by all""")
def clarify(spark: SparkSession, d: str) -> DataFrame:
    q = guards.clarified(_t(spark, d, "chat_requests").select("request_id", F.lower(T.strip(F.coalesce("text", F.lit("")))).alias("text")).distinct())
    return q.groupBy("request_id", "is_personal").agg(F.count("*").alias("n"))


@query()
def route(spark: SparkSession, d: str) -> DataFrame:
    return guards.routed(_t(spark, d, "chat_requests").distinct()).groupBy("lang", "route").agg(F.count("*").alias("n"))


OPEN = f"""with q as (select distinct request_id, user_ref, requested_at, lower({_squeeze("coalesce(text, '')")}) as q, lower({_strip("coalesce(text, '')")}) as p, {_strip("coalesce(text, '')")} <> '' as allowed from chat_requests),
    n as (select context_key, max({{'s': saved_at, 't': status}}) as v from patient_contexts where context_key is not null group by 1),
    c as (select q.*, {_any('q', guards.EMERGENCY)} as e, {_any('q', guards.CLINIC)} as c, {_any('p', guards.SYMPTOM)} and ({_any('p', guards.PERSONAL)} or not {_any('p', guards.GENERAL)}) as own,
        coalesce(n.v.t = 'collecting' and not coalesce(requested_at - n.v.s > interval 30 minutes, false), false) as open from q left join n on n.context_key = substr(sha256({_strip('user_ref')}), 1, 32))
    select request_id, case when not allowed then 'blocked' when e then 'emergency' when open and not c then 'inquiry' when c then 'clinic' when own then 'inquiry' else 'medical' end as route,
        case when open and not c and not e then 'active_inquiry' else 'classifier' end as decided_by, count(*) as n from c group by all"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """(context_key, saved_at, status): the users' latest contexts."""
    rows = _t(spark, d, "patient_contexts").where("context_key is not null")
    return rows.groupBy("context_key").agg(F.max(F.struct("saved_at", "status")).alias("v")).select("context_key", "v.*")


@query(OPEN)
def route_open(spark: SparkSession, d: str) -> DataFrame:
    """Routing beside open inquiries: the users' latest contexts."""
    asked = _t(spark, d, "chat_requests").select("request_id", "user_ref", "requested_at", F.coalesce("text", F.lit("")).alias("text")).distinct()
    out = guards.decided(asked.withColumn("allowed", T.strip(F.col("text")) != ""), "text", inquiries=_contexts(spark, d))
    return out.groupBy("request_id", "route", "decided_by").agg(F.count("*").alias("n"))


# Retrieval ----------------------------------------------------------------------------------------------------------

EVERY = 50
SCORES = f"""p as (select coalesce(doc_id, vec_id) as id, embedding::double[] as v, text, coalesce(title, '') as title from documents d full join embeddings e on d.doc_id = e.vec_id),
    q as (select id as query_id, v, title as query_text from p where id % {EVERY} = 0),
    dense as (select * from (select query_id, id, round(list_inner_product(q.v, p.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(p.v, p.v)), 6) as score, row_number() over (partition by query_id order by score desc, id)::int as dense_rank from q, p where query_text_ok q.v is not null and p.v is not null) where dense_rank <= 15),
    m as (select query_id, id, len(list_filter(list_distinct({_words('lower(query_text)')}), lambda w: contains(lower(p.text), w))) as matches from q, p where p.text is not null),
    lexical as (select * from (select *, row_number() over (partition by query_id order by matches desc, id)::int as lexical_rank from m where matches > 0) where lexical_rank <= 15),
    fused as (select query_id, id, dense_rank, lexical_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0), 9) as rrf_score from dense full join lexical using (query_id, id)),
    ranked as (select *, row_number() over (partition by query_id order by rrf_score desc, dense_rank nulls last, lexical_rank)::int as fused_rank from fused)"""
ALL = SCORES.replace("where query_text_ok", "where")
ASKED = SCORES.replace("where query_text_ok", f"where {_strip('query_text')} <> '' and")


def _kb(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries, points) of all documents and vectors, joined by id where there are both; queries are those of ids that 50 divides."""
    both = _t(spark, d, "embeddings").join(_t(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"), "full_outer")
    points = both.select(F.coalesce("doc_id", "vec_id").alias("id"), "text", F.coalesce("title", F.lit("")).alias("title"), F.col("embedding").alias("vector"))
    return points.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("title").alias("text"), "vector"), points.select("id", "text", "vector")


@query(f"with {ALL} select query_id, id, score, dense_rank from dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_topk(*_kb(spark, d))


@query(f"with {ALL} select query_id, id, matches, lexical_rank from lexical")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_topk(*_kb(spark, d))


@query()
def dense_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same by the index; what it misses of dense_topk is measured in the tests and the README."""
    q, p = _kb(spark, d)
    return retrieval.indexed_topk(q, p)


@query(f"""with {ALL} select count(*) as n_true, true as enough from dense""")
def dense_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact neighbours there are and whether the index finds nine tenths of them."""
    q, p = _kb(spark, d)
    found = retrieval.indexed_topk(q, p).select("query_id", "id", F.lit(1).alias("f"))
    both = retrieval.dense_topk(q, p).join(found, ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n_true"), (F.count("f") >= 0.9 * F.count("*")).alias("enough"))


@query(f"with {ALL}, s as (select * from p order by id limit 100), x as (select query_id, s.id, len(list_filter(list_distinct({_words('lower(query_text)')}), lambda w: contains(lower(s.text), w))) as matches from q, s where s.text is not null) select query_id, id, matches, row_number() over (partition by query_id order by matches desc, id)::int as lexical_rank from x where matches > 0 qualify lexical_rank <= 15")
def lexical_scan(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_topk(*_kb(spark, d), scan_limit=100)


@query(f"with {ALL} select query_id, id, dense_rank, lexical_rank, rrf_score, fused_rank from ranked where fused_rank <= 10")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    q, p = _kb(spark, d)
    return retrieval.rrf_fuse(retrieval.dense_topk(q, p), retrieval.lexical_topk(q, p), top_n=10)


GATED = f"""with {ASKED}, g as (select r.query_id, r.id, r.rrf_score, r.fused_rank, len(list_intersect({_terms('q.query_text')}, {_terms('p.text')}))::int as lexical_overlap
    from ranked r join q using (query_id) join p on p.id = r.id where fused_rank <= 5)"""


@query(f"{GATED} select query_id, id, rrf_score, fused_rank, lexical_overlap, case when rrf_score >= 0.03 and lexical_overlap > 0 then 'relevant' else 'unrelated' end as relevance_status from g")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_retrieve(*_kb(spark, d)).select("query_id", "id", "rrf_score", "fused_rank", "lexical_overlap", "relevance_status")


@query(f"""{GATED} select query_id, count(*) as candidate_count, count(*) filter (where rrf_score >= 0.03 and lexical_overlap > 0) as relevant_count, bool_or(rrf_score >= 0.03 and lexical_overlap > 0) as passed,
    coalesce(string_agg(case when rrf_score >= 0.03 and lexical_overlap > 0 then id end, '|' order by fused_rank), '') as selected_ids, coalesce(string_agg(case when not (rrf_score >= 0.03 and lexical_overlap > 0) then id end, '|' order by fused_rank), '') as rejected_ids from g group by query_id""")
def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    lists = [F.array_join(c, "|").alias(c) for c in ("selected_ids", "rejected_ids")]
    return retrieval.gate_summary(retrieval.hybrid_retrieve(*_kb(spark, d)), order="fused_rank").select("query_id", "candidate_count", "relevant_count", "passed", *lists)


@query(f"{GATED} select query_id, id, rrf_score as rerank_score, 'rrf' as rerank_score_type, row_number() over (partition by query_id order by rrf_score desc, fused_rank)::int as rerank_rank from g qualify rerank_rank <= 3")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(retrieval.hybrid_retrieve(*_kb(spark, d)), top_k=3).select("query_id", "id", "rerank_score", "rerank_score_type", "rerank_rank")


@query(f"""select evidence_id, len(list_intersect({_terms('document_title')}, {_terms('text')}))::int as overlap, count(*) as n from evidence_records where document_title is not null and text is not null group by all""")
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "evidence_records").where("document_title is not null and text is not null")
    return e.select("evidence_id", T.lexical_overlap(F.col("document_title"), F.col("text")).alias("overlap")).groupBy("evidence_id", "overlap").agg(F.count("*").alias("n"))


@query(f"""with s as (select evidence_id, coalesce(rerank_score, retrieval_score) as score, rerank_score is null as fused, len(list_intersect({_terms('document_title')}, {_terms('text')})) as o from evidence_records)
    select evidence_id, case when fused and score >= 0.03 and o > 0 or not fused and score >= 0.2 then 'relevant' else 'unrelated' end as relevance_status, count(*) as n from s group by all""")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("rerank_score").isNull(), "rrf").otherwise("cross_encoder")
    e = _t(spark, d, "evidence_records").select("evidence_id", F.col("document_title").alias("query_text"), "text", "rerank_score", F.col("retrieval_score").alias("relevance_score"), kind.alias("rerank_score_type"))
    return retrieval.relevance_gate(e).groupBy("evidence_id", "relevance_status").agg(F.count("*").alias("n"))


@query("""select doc_id, try_cast(case doc_id % 4 when 0 then n_chars::varchar when 1 then lang when 2 then n_chars || '.5' end as double) as score from documents""")
def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.col("n_chars").cast("string")).when(k == 1, F.col("lang")).when(k == 2, F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
    return _t(spark, d, "documents").select("doc_id", T.number(raw).alias("score"))


# Evidence and answers -----------------------------------------------------------------------------------------------


@query(f"""select distinct evidence_id, case when {_strip('chunk_id')} <> '' then chunk_id else 'evidence_' || substr(sha256(coalesce(source, '') || '|' || coalesce(document_title, '') || '|' || coalesce(section, '') || '|' || coalesce(text, '')), 1, 20) end as stable_id from evidence_records""")
def evidence_id(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "evidence_records").select("evidence_id", T.evidence_id(*[F.col(c) for c in ("chunk_id", "source", "document_title", "section", "text")]).alias("stable_id")).distinct()


@query("select distinct evidence_id as id, document_title as doc_title, source, section, url from evidence_records where relevance_status = 'relevant'")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return evidence.citations(_t(spark, d, "evidence_records"))


@query("""select distinct request_id, evidence_id as id, document_title as doc_title, source, section, url from evidence_records where relevance_status = 'relevant' and (request_id, evidence_id) in (select request_id, evidence_id from evidence_records where retrieval_score >= 0.5)""")
def cited_citations(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "evidence_records")
    claim = F.struct(F.col("evidence_id").alias("claim_id"), F.lit("x").alias("text"), F.array("evidence_id").alias("evidence_ids"))
    claims = e.where("request_id is not null and retrieval_score >= 0.5").groupBy("request_id").agg(F.collect_list(claim).alias("claims"))
    return evidence.cited_citations(e, claims)


@query(f"""with b as (select distinct request_id, evidence_id, '[EVIDENCE_ID: ' || evidence_id || '] Source: ' || coalesce(source, 'Medical Reference') || ' | Document: ' || coalesce(document_title, 'Medical Doc') || case when coalesce(section, '') <> '' then ' | Section: ' || section else '' end || chr(10) || {_strip("coalesce(text, '')")} as b from evidence_records where request_id is not null)
    select request_id, md5(string_agg(b, chr(10) || chr(10) order by evidence_id, b)) as context_hash from b group by request_id""")
def format_context(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "evidence_records").select("request_id", "evidence_id", "source", "document_title", "section", "text").distinct()
    return evidence.format_context(e).select("request_id", F.md5("context").alias("context_hash"))


# Answers of four kinds by the request's number: claims in prose, the same fenced with one id for a list, claims that are no list, and no JSON.
KIND = "cast(regexp_extract(request_id, '([0-9]+)$', 1) as bigint) % 4"
_CLAIM = """replace(replace(replace(coalesce(user_ref, ''), '\\\\', ''), '"', ''), chr(10), ' ')"""
CLAIMS = f"""case {KIND} when 0 then concat('note {{"claims": [{{"text": "', {_CLAIM}, '", "evidence_ids": ["', request_id, '", "x"]}}, 7, {{"claim_id": "c", "text": " ", "evidence_ids": "', request_id, '"}}]}} end')
    when 1 then concat('```json', chr(10), '{{"status": "answered", "claims": [{{"claim_id": "", "text": "', {_CLAIM}, '", "evidence_ids": "', request_id, '"}}, {{"text": "none of ours", "evidence_ids": ["y", "", null]}}]}}', chr(10), '```')
    when 2 then '{{"claims": "none"}}' else 'no claims' end"""
SAID = f"""r as (select distinct request_id, {KIND} as k, replace(replace(replace(coalesce(user_ref, ''), chr(92), ''), '"', ''), chr(10), ' ') as t from chat_requests where request_id is not null)"""


@query(f"""with {SAID} select request_id, (case when k < 2 and trim(t) <> '' then 1 else 0 end)::int as n_valid, case when k < 2 then 2 else 0 end as n_claims, case when k < 2 and trim(t) <> '' then 'claim_001' end as first_id from r""")
def validate_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = _claims(spark, d)
    valid = claims.select("request_id", "claims", evidence.valid_claims(F.col("claims"), F.array("request_id")).alias("v"))
    return valid.select("request_id", F.size("v").alias("n_valid"), F.size("claims").alias("n_claims"), F.get("v", F.lit(0))["claim_id"].alias("first_id"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "chat_requests").where("request_id is not null").select("request_id", F.expr(CLAIMS).alias("payload")).distinct()
    return rows.select("request_id", evidence.claims_of(F.col("payload")).alias("claims"))


@query(f"""with {SAID} select request_id, 'claim_001' as claim_id, t as text, case k when 0 then request_id || '|x' else request_id end as ids from r where k < 2
    union all select request_id, 'c', ' ', request_id from r where k = 0 union all select request_id, 'claim_002', 'none of ours', 'y' from r where k = 1""")
def claims_parse(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("request_id", F.explode("claims").alias("c")).select("request_id", "c.claim_id", "c.text", F.array_join("c.evidence_ids", "|").alias("ids"))


@query(f"""with {SAID}, b as (select *, case k when 0 then 'c' else 'claim_002' end as other from r) select request_id, case when k < 2 then 2 else 0 end as input_claim_count, (case when k < 2 and trim(t) <> '' then 1 else 0 end)::int as valid_claim_count,
    case when k > 1 then '' when trim(t) <> '' then other else 'claim_001|' || other end as invalid_claim_ids, k > 1 as passed from b""")
def claim_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _claims(spark, d).select("request_id", evidence.claim_summary(F.col("claims"), F.array("request_id")).alias("s")).select("request_id", "s.*")
    return s.withColumn("invalid_claim_ids", F.array_join("invalid_claim_ids", "|"))


@query(f"""with s as (select doc_id, case when doc_id % 3 = 0 then 'answered' else 'clinic' end as status, text as answer, case when lang = 'ar' then 'ar' else 'en' end as language, doc_id % 2 as n_evidence from documents)
    select doc_id, case when status = 'answered' and (n_evidence <= 0 or {_strip("coalesce(answer, '')")} = '') then 'insufficient_evidence' else status end as status,
        md5(case when status = 'answered' and n_evidence <= 0 then '{evidence.INSUFFICIENT.replace("'", "''")}' when status = 'answered' then
            case when contains(t, n) then t else t || chr(10) || chr(10) || n end else answer end) as answer_hash
    from (select *, case when {_strip("coalesce(answer, '')")} = '' then '{evidence.INSUFFICIENT.replace("'", "''")}' else {_strip('answer')} end as t, case when language = 'ar' then '{evidence.DISCLAIMER['ar']}' else '{evidence.DISCLAIMER['en']}' end as n from s)""")
def output_guard(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "answered").otherwise("clinic").alias("status"), F.col("text").alias("answer"), F.when(F.col("lang") == "ar", "ar").otherwise("en").alias("language"), (F.col("doc_id") % 2).alias("n_evidence"))
    return evidence.guarded(s).select("doc_id", "status", F.md5("answer").alias("answer_hash"))


@query(f"""select doc_id, md5(case when {_strip("coalesce(text, '')")} = '' then '{evidence.APOLOGY}' else {_strip('text')} end) as shown from documents""")
def render(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(evidence.rendered(F.col("text"))).alias("shown"))


@query("""select doc_id, i::int as piece_no, md5(substr(coalesce(text, ''), (i * 4096 + 1)::int, 4096)) as piece_hash from (select doc_id, text, unnest(range(0, greatest(1, ((length(coalesce(text, '')) + 4095) // 4096)))) as i from documents)""")
def reply_pieces(spark: SparkSession, d: str) -> DataFrame:
    return evidence.reply_pieces(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "piece_no", F.md5("piece").alias("piece_hash"))


def _said(kind: str, ar: str) -> str:
    r = generation.REPLIES[kind]
    return f"case when {ar} then '{r['ar']}' else '{r['en']}' end"


@query(f"""select doc_id, case doc_id % 4 when 0 then {_said('blocked', "coalesce(lang, '') = 'ar'")} when 1 then {_said('clarification', "coalesce(lang, '') = 'ar'")} when 2 then {_said('limit_reached', "coalesce(lang, '') = 'ar'")} end as reply,
    {_said('emergency', "coalesce(lang, '') = 'ar'")} || case when coalesce(source, '') = '' then '' else chr(10) || case when coalesce(lang, '') = 'ar' then '{generation.PHONE_LINE['ar']}' else '{generation.PHONE_LINE['en']}' end || source end as urgent from documents""")
def fixed_replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "blocked").when(k == 1, "clarification").when(k == 2, "limit_reached").otherwise("other")
    lang = F.coalesce("lang", F.lit(""))
    return _t(spark, d, "documents").select("doc_id", generation.reply(kind, lang).alias("reply"), generation.emergency_reply(lang, F.col("source")).alias("urgent"))


@query(f"""select distinct request_id, {_strip("coalesce(text, '')")} as own from chat_requests""")
def guard_text(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "chat_requests").select("request_id", F.coalesce("text", F.lit("")).alias("t"))
    asked = F.concat(F.lit(" User question: "), "t", F.lit("\nStructured patient context: "), "t")
    return r.select("request_id", generation.guard_text(asked).alias("own")).distinct()


@query(f"""with r as (select distinct request_id, coalesce(text, '') as t, user_ref from chat_requests), p as (select request_id, 'Q {{context}} ' || t || ' P ' || case when user_ref is null then '{{}}' else '{{"user_ref":"' || user_ref || '"}}' end || ' C ' || case when t = '' then '{generation.NO_CONTEXT}' else t end as p from r)
    select request_id, sha256(p) as prompt_hash, length(p)::int as prompt_length from p""")
def format_prompt(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "chat_requests").select("request_id", F.concat(F.lit("{context} "), F.coalesce("text", F.lit(""))).alias("q"), F.coalesce("text", F.lit("")).alias("t"), "user_ref").distinct()
    prompt = generation.format_prompt(F.col("q"), F.col("t"), generation.patient_json(["user_ref"]), "Q {query} P {patient_context} C {context}")
    return r.select("request_id", *[c.alias(n) for n, c in generation.prompt_facts(prompt).items()])


@query(f"""select distinct request_id, case when {_strip("coalesce(text, '')")} = '' then '' else text end as expanded_query, 0 as n_keywords, '' as hyde_passage from chat_requests""")
def rewrite_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = generation.rewritten(_t(spark, d, "chat_requests").select("request_id", "text").distinct())
    return r.select("request_id", "expanded_query", F.size("medical_keywords").alias("n_keywords"), "hyde_passage").distinct()


EXTRACTED = f"""with e as (select distinct request_id, evidence_id, document_title, source, section, url, text, relevance_status from evidence_records where request_id is not null),
    b as (select request_id, first(evidence_id order by evidence_id, text) as id, first(text order by evidence_id, text) as t from e where relevance_status in ('relevant', 'unknown') group by request_id),
    r as (select distinct request_id from e)
    select request_id, case when {_strip("coalesce(t, '')")} <> '' then 'answered' else 'insufficient_evidence' end as status, case when id is null or {_strip("coalesce(t, '')")} = '' then '{generation.REPLIES['insufficient_evidence']['en']}' else {_strip('t')} end as answer, case when {_strip("coalesce(t, '')")} <> '' then id else '' end as evidence_ids from r left join b using (request_id)"""


@query(EXTRACTED)
def generate_extractive(spark: SparkSession, d: str) -> DataFrame:
    """The answer that needs no model: the first relevant record of each request is its claim."""
    e = _t(spark, d, "evidence_records").where("request_id is not null").select("request_id", F.struct("evidence_id", "text", "document_title", "source", "section", "url", "relevance_status").alias("e")).distinct()
    rows = e.groupBy("request_id").agg(F.array_sort(F.collect_list("e")).alias("evidence")).select("request_id", "evidence", F.lit("q").alias("text"), F.lit("c").alias("context"), F.lit("en").alias("language"))
    return generation.generated(rows, None).select("request_id", "status", "answer", F.array_join("evidence_ids", "|").alias("evidence_ids"))


@query("""select doc_id, coalesce(nullif(lang, 'en'), 'medical') as status, coalesce(nullif(title, ''), text, '') as answer, coalesce(nullif(title, ''), text, '') as user_response, 0 as n_claims from documents""")
def result_normalize(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("status"), F.col("title").alias("user_response"), F.col("text").alias("answer"))
    return generation.internal(generation.normalized_results(r, F.lit("medical"))).select("doc_id", "status", "answer", "user_response", F.size("claims").alias("n_claims"))


@query("""select true as ready, 'medical_kb' as collection, 'hash' as embedder, 'gemini/gemini-2.5-flash' as model, 0.2::double as threshold""")
def status_report(spark: SparkSession, d: str) -> DataFrame:
    return settings.status_report(spark, settings.load({}), ["medical_kb"])


# Sessions -----------------------------------------------------------------------------------------------------------


@query(f"select distinct user_ref, substr(sha256({_strip('user_ref')}), 1, 32) as context_key from chat_requests where user_ref is not null")
def context_key(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chat_requests").where("user_ref is not null").select("user_ref", T.context_key(F.col("user_ref")).alias("context_key")).distinct()


@query("""with g as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 30 minutes then 1 else 0 end as f from events)
    select event_id, (sum(f) over (partition by user_id order by ts range between unbounded preceding and current row))::int as session_no from g""")
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionized(_t(spark, d, "events"), "user_id", "ts").select("event_id", "session_no")


@query("""select request_id, min(received_at) as received_at, count(*) as n from (select distinct * from chat_requests) where request_id is not null group by request_id""")
def update_dedup(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "chat_requests").where("request_id is not null").distinct()
    first = sessions.first_of_each(r.select("request_id", "received_at"), ["request_id"], [F.col("received_at")])
    return first.join(r.groupBy("request_id").agg(F.count("*").alias("n")), "request_id")


@query("""select record_id, session_version, status from (select *, row_number() over (partition by record_id order by saved_at desc) as nth from patient_contexts) where nth = 1""")
def latest_contexts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_of_each(_t(spark, d, "patient_contexts").select("record_id", "saved_at", "session_version", "status"), ["record_id"], ["saved_at"]).select("record_id", "session_version", "status")


QUESTIONS = {g: " ".join(f"when '{k}' then '{v}'" for k, v in sessions.QUESTIONS[g].items()) for g in ("en", "ar")}
MISSING = f"list_filter([case when coalesce(len(symptoms), 0) = 0 then 'symptoms' end, case when {_strip("coalesce(onset_or_duration, '')")} = '' then 'onset_or_duration' end, case when {_strip("coalesce(severity, '')")} = '' then 'severity' end, case when coalesce(len(associated_symptoms), 0) = 0 then 'associated_symptoms' end, case when {_strip("coalesce(relevant_context, '')")} = '' then 'relevant_context' end], lambda x: x is not null)"


@query(f"""select record_id, saved_at, case when language = 'ar' then case coalesce(m[1], 'relevant_context') {QUESTIONS['ar']} end else case coalesce(m[1], 'relevant_context') {QUESTIONS['en']} end end as question from (select *, {MISSING} as m from patient_contexts)""")
def next_question(spark: SparkSession, d: str) -> DataFrame:
    _, missing = sessions.scored(*[F.col(c) for c in ("symptoms", "onset_or_duration", "severity", "associated_symptoms", "relevant_context")])
    return _t(spark, d, "patient_contexts").select("record_id", "saved_at", sessions.question(missing, F.col("language")).alias("question"))


@query("""select record_id, saved_at, 'User question: ' || coalesce(array_to_string(symptoms, ', '), '') || case when len(x) > 0 then ' (' || array_to_string(x, ', ') || ')' else '' end || ' - ' || coalesce(next_question, '') as query
    from (select *, list_filter(['duration: ' || nullif(onset_or_duration, ''), 'severity: ' || nullif(severity, ''), 'context: ' || nullif(relevant_context, '')], lambda y: y is not null) as x from patient_contexts)""")
def augmented_query(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "patient_contexts")
    return p.select("record_id", "saved_at", sessions.augmented(F.coalesce("next_question", F.lit("")), *[F.col(c) for c in ("symptoms", "onset_or_duration", "severity", "relevant_context")]).alias("query"))


@query("""with recursive e as (select user_id, case when event_id % 9 < 6 then 'claim' when event_id % 9 < 8 then 'fail' else 'complete' end as event, ts, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null),
    f as (select user_id, n, event, ts, true as granted, case event when 'claim' then 'processing' when 'fail' then 'failed' else 'completed' end as status, case when event = 'claim' then ts end as claimed, case when event = 'claim' then 1 else 0 end as attempts from e where n = 1
        union all select user_id, n, event, ts, granted, case when not granted then status when event = 'claim' then 'processing' when event = 'fail' then 'failed' else 'completed' end, case when granted and event = 'claim' then ts else claimed end, case when granted and event = 'claim' then attempts + 1 else attempts end
            from (select e.*, f.status, f.claimed, f.attempts, e.event <> 'claim' or not (f.status = 'completed' or f.status = 'processing' and e.ts - f.claimed < interval 300 seconds) as granted from f join e on e.user_id = f.user_id and e.n = f.n + 1))
    select user_id as update_id, event, ts as at, granted, status, attempts from f""")
def update_lease(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    k = F.col("event_id") % 9
    event = F.when(k < 6, "claim").when(k < 8, "fail").otherwise("complete")
    return sessions.lease_fold(e.select(F.col("user_id").alias("update_id"), event.alias("event"), F.col("ts").cast("timestamp").alias("at"), "event_id"), ["at", "event_id"])


@query("""select record_id, saved_at, coalesce(epoch_us(saved_at) - epoch_us(try_cast(updated_at as timestamptz)) > 1800000000, false) as stale from patient_contexts""")
def session_stale(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "patient_contexts")
    return c.select("record_id", "saved_at", sessions.stale(F.col("updated_at"), F.col("saved_at")).alias("stale"))


@query("""with n as (select record_id, session_id, session_version from (select *, row_number() over (partition by record_id order by saved_at desc) as nth from patient_contexts) where nth = 1)
    select p.record_id, p.saved_at from patient_contexts p join n on p.record_id = n.record_id and p.session_id = n.session_id and p.session_version = n.session_version""")
def stale_response(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "patient_contexts").select("record_id", "saved_at", "session_id", "session_version")
    return sessions.discard_stale(c, sessions.latest_of_each(c, ["record_id"], ["saved_at"]).drop("saved_at"), ["record_id"]).select("record_id", "saved_at")


@query(f"""select record_id, saved_at, round((case when len(symptoms) > 0 then 0.25 else 0 end + case when {_strip('onset_or_duration')} <> '' then 0.20 else 0 end + case when {_strip('severity')} <> '' then 0.20 else 0 end + case when len(associated_symptoms) > 0 then 0.20 else 0 end + case when {_strip('relevant_context')} <> '' then 0.15 else 0 end)::double, 2) as score from patient_contexts""")
def inquiry_score(spark: SparkSession, d: str) -> DataFrame:
    score, _ = sessions.scored(*[F.col(c) for c in ("symptoms", "onset_or_duration", "severity", "associated_symptoms", "relevant_context")])
    return _t(spark, d, "patient_contexts").select("record_id", "saved_at", score.alias("score"))


@query()
def inquiry_extract(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chat_requests").where("text is not null").select("request_id", "received_at", *[c.alias(n) for n, c in sessions.extracted(F.col("text")).items()]).distinct()


@query()
def inquiry_fold(spark: SparkSession, d: str) -> DataFrame:
    return sessions.inquiry_fold(_t(spark, d, "chat_requests").distinct(), "user_ref", "requested_at", "text")


STATE = """s as (select language as namespace, context_key as key, max({'a': saved_at, 'g': status = 'completed', 'v': '{"status":"' || status || '","flow":"' || coalesce(active_flow, '') || '"}'}) as v from patient_contexts where language is not null and context_key is not null group by all)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit('{"status":"'), "status", F.lit('","flow":"'), F.coalesce("active_flow", F.lit("")), F.lit('"}'))
    return store.state_now(_t(spark, d, "patient_contexts").select(F.col("language").alias("namespace"), F.col("context_key").alias("key"), value.alias("value"), F.col("saved_at").alias("at"), (F.col("status") == "completed").alias("deleted")))


@query(f"with {STATE} select namespace, key, v.v as value from s where not coalesce(v.g, false)")
def state_now(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)


@query(f"""with {STATE} select key, v.v as value from s where not coalesce(v.g, false) and namespace = 'en' and contains(v.v, '"status":"collecting"')""")
def state_list(spark: SparkSession, d: str) -> DataFrame:
    return store.state_list(_state(spark, d), "en", status="collecting")


@query(f"""with {STATE}, k as (select distinct context_key as key from patient_contexts where context_key is not null) select k.key, x.v.v as value from k left join (select * from s where not coalesce(v.g, false) and namespace = 'ar') x on k.key = x.key""")
def state_get(spark: SparkSession, d: str) -> DataFrame:
    return store.state_get(_state(spark, d), "ar", _t(spark, d, "patient_contexts").where("context_key is not null").select(F.col("context_key").alias("key")))


@query("""select status, active_flow, count(*) as n from patient_contexts where language = 'en' and status = 'collecting' group by all""")
def equal_list(spark: SparkSession, d: str) -> DataFrame:
    return store.listed(_t(spark, d, "patient_contexts"), language="en", status="collecting").groupBy("status", "active_flow").agg(F.count("*").alias("n"))


# Whole plans --------------------------------------------------------------------------------------------------------


@query()
def build_index(spark: SparkSession, d: str) -> DataFrame:
    return answering.build_index(_t(spark, d, "articles")).select("id", "text", F.array_join("sources", "|").alias("sources"), "n", F.size("vector").alias("dimension"))


@query()
def answer(spark: SparkSession, d: str) -> DataFrame:
    asked = sessions.first_of_each(_t(spark, d, "chat_requests").where("request_id is not null").select("request_id", "text"), ["request_id"], [F.col("text")])
    searched = F.regexp_extract("request_id", r"(\d+)$", 1).try_cast("long") % EVERY == 0
    return answering.answer(asked.where(searched), answering.build_index(_t(spark, d, "articles")))


@query()
def handle(spark: SparkSession, d: str) -> DataFrame:
    """Requests from guards to results, beside the users' open inquiries and without a model."""
    asked = sessions.first_of_each(_t(spark, d, "chat_requests").where("request_id is not null").select("request_id", "user_ref", "requested_at", "text"), ["request_id"], [F.col("requested_at")])
    searched = F.regexp_extract("request_id", r"(\d+)$", 1).try_cast("long") % EVERY == 0
    return answering.handle(asked.where(searched), answering.build_index(_t(spark, d, "articles")), _contexts(spark, d)).select("request_id", "route", "agent", "status", "answer", F.array_join("evidence_ids", "|").alias("evidence_ids"))
