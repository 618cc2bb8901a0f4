"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import main_content, near_duplicates, packing, personal_info, repeated_lines, residue, splitting, token_budget
from .common import shared_dir, table
from .encoding import encode

Query = Callable[[SparkSession, str], DataFrame]


def p1_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.token_budget(spark, table(spark, d, "articles"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.totals(p1_token_budget(spark, d))


def p1_articles(spark: SparkSession, d: str) -> DataFrame:
    return p1_token_budget(spark, d).select("source", "lang", "host", "n_articles")


def _second_load(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    i = F.col("article_id")
    earlier = articles.where(i % 5 != 0).withColumns({"source": F.when(i % 3 == 0, F.concat("source", F.lit(" old"))).otherwise(F.col("source")), "content": F.when(i % 4 == 0, F.concat("content", F.lit(" as it was"))).otherwise(F.col("content"))})
    path = f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    token_budget.save(token_budget.update(token_budget.Ledger(), earlier), path)
    return token_budget.update(token_budget.open_ledger(spark, path), articles.where(i % 7 != 0)).cube


def p1_update(spark: SparkSession, d: str) -> DataFrame:
    """The budget after a second load into a ledger that was saved and opened again: some articles are new, some have changed, every seventh has been removed."""
    return _second_load(spark, d).select("source", "lang", "host", "n_articles")


def p1_update_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The same with tokens, beside a budget made afresh: the slices where they differ, which are none."""
    fresh = token_budget.token_budget(spark, table(spark, d, "articles").where("article_id % 7 <> 0"))
    return _second_load(spark, d).exceptAll(fresh)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, d, "evidence_records"), every_copy=True)
    return pairs.select(F.col("id_a").alias("evidence_id_a"), F.col("id_b").alias("evidence_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, d, "evidence_records")).withColumnRenamed("id", "evidence_id")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Groups of copies of the very same text: with p2_found, where more than 32 copies are paired with their first one only, all pairs."""
    return near_duplicates.copy_classes(table(spark, d, "evidence_records")).withColumnRenamed("id", "evidence_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "articles"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "articles").select("article_id", "source", "content", "cleaned_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.page_furniture(table(spark, d, "articles"))


def p4_articles(spark: SparkSession, d: str) -> DataFrame:
    return main_content.main_content(table(spark, d, "articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_info.found(table(spark, d, "patient_contexts"), table(spark, d, "person_names"))


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal_info.masked(table(spark, d, "patient_contexts"), table(spark, d, "person_names"))


def p5_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return personal_info.surrogates(table(spark, d, "patient_contexts"), table(spark, d, "person_names"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return splitting.article_sections(table(spark, d, "articles")).unionByName(splitting.evidence_sections(table(spark, d, "evidence_records")))


#: No item of these tables reaches a range of the usual size; these are so small that each oversized one is stitched of several.
SMALL_RANGES = splitting.Limits(range_chars=1 << 11)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(splitting.ranges(_items(spark, d), SMALL_RANGES), SMALL_RANGES).select("item_kind", "item_id", "section_no")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(splitting.ranges(_items(spark, d), SMALL_RANGES), SMALL_RANGES)


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of texts, by byte ranges: how many words their pieces have without the overlaps, and whether all are within the limit."""
    path = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    table(spark, d, "documents").where("text is not null").select("text").write.text(path)
    paths = splitting.files_in(spark, path)
    limits = splitting.Limits(range_chars=1 << 14)
    pieces = splitting.split(splitting.file_ranges(spark, paths, limits), limits, keep_small=True, with_text=False)
    whole = F.sum(F.col("n_words") - F.when(F.col("piece_no") > 0, limits.overlap).otherwise(0))
    return pieces.agg(whole.alias("n_words"), (F.max("n_words") <= limits.words).alias("within"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean_corpus(table(spark, d, "documents").select("doc_id", "title", "text", "lang", "source")).select("doc_id", "lang", "source", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_token_budget, p1_totals, p1_articles, p1_update, p1_update_tokens, p2_found, p2_groups, p2_classes, p3_found, p3_cleaned, p4_found, p4_articles, p5_found, p5_masked, p5_surrogates, p6_found, p6_pieces, p6_files, p7_ids, p8_containers, p9_found, p9_clean)}

# White space with the no-break space, as RE2 writes it.
_W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ORACLE: dict[str, str] = {
    "p2_classes": "with r as (select distinct evidence_id, text from evidence_records where evidence_id is not null and text is not null) select evidence_id, min(evidence_id) over (partition by text) as class_id, count(*) over (partition by text) as class_size from r",
    "p1_update_tokens": "select '' as source, '' as lang, '' as host, 0::bigint as n_articles, 0::bigint as n_tokens where false",
    "p6_files": rf"select sum(len(list_filter(string_split_regex(text, '{_W}+'), lambda w: w <> '')))::bigint as n_words, true as within from documents",
    "p1_articles": rf"""
        with v as (
            select article_id,
                coalesce(nullif(lower(trim(regexp_replace(source, '{_W}+', ' ', 'g'))), ''), 'unknown') as source,
                regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})(?:[-_].*)?$', 1) as tag,
                lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) as h,
                row_number() over (partition by article_id order by cleaned_at desc nulls last, unhex(sha256(content)) desc nulls last) as nth
            from articles)
        select source, case when tag is null or tag in ('', 'und') then 'unknown' else tag end as lang,
            coalesce(nullif(regexp_replace(regexp_replace(h, '\.$', ''), '^(?:www|m)\.([^.]+\.)', '\1'), ''), 'unknown') as host, count(*) as n_articles
        from v where nth = 1 group by all""",
    "p1_update": rf"""
        with v as (
            select article_id,
                coalesce(nullif(lower(trim(regexp_replace(source, '{_W}+', ' ', 'g'))), ''), 'unknown') as source,
                regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})(?:[-_].*)?$', 1) as tag,
                lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) as h,
                row_number() over (partition by article_id order by cleaned_at desc nulls last, unhex(sha256(content)) desc nulls last) as nth
            from articles where article_id % 7 <> 0)
        select source, case when tag is null or tag in ('', 'und') then 'unknown' else tag end as lang,
            coalesce(nullif(regexp_replace(regexp_replace(h, '\.$', ''), '^(?:www|m)\.([^.]+\.)', '\1'), ''), 'unknown') as host, count(*) as n_articles
        from v where nth = 1 group by all""",
    "p3_found": rf"""
        with l as (
            select article_id, generate_subscripts(string_split(content, chr(10)), 1) - 1 as line_no, unnest(string_split(content, chr(10))) as line,
                lower(trim(regexp_replace(source, '{_W}+', ' ', 'g'))) as s
            from articles where source is not null and content is not null),
        k as (select article_id, line_no, s, regexp_replace(lower(trim(regexp_replace(line, '{_W}+', ' ', 'g'))), '\p{{Nd}}+', '0', 'g') as k from l),
        c as (select * from k where length(k) - length(replace(k, ' ', '')) >= 4),
        r as (select s, k from c group by s, k having count(distinct article_id) >= 6)
        select distinct article_id, line_no::int as line_no from c join r using (s, k)""",
}
