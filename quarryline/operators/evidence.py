"""Evidence, claims and what is shown of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CLAIM = "array<struct<claim_id:string,text:string,evidence_ids:array<string>>>"
#: What patients are told.
INSUFFICIENT = "I don't have enough reliable evidence to answer that safely. Please consult a qualified clinician."
APOLOGY = "I could not produce a safe response. Please try again or contact a healthcare professional."
DISCLAIMER = {"ar": "هذه المعلومات تعليمية وليست تشخيصًا طبيًا.", "en": "Educational information only; not a medical diagnosis."}
REPLY_CHARS = 4096


def json_object(c: Column) -> Column:
    """From the first brace to the last, fences and prose around it left out; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def claims_of(payload: Column) -> Column:
    """Claims of a JSON answer: [] if there are none or they aren't a list; default ids claim_001, ...; single ids become lists.

    Entries that aren't objects are left out but keep their number.
    """
    raw = F.from_json(F.get_json_object(json_object(payload), "$.claims"), "array<string>", {"mode": "PERMISSIVE"})
    entries = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    entries = F.filter(entries, lambda e: F.substring(T.strip(e["x"]), 1, 1) == "{")

    def claim(e: Column) -> Column:
        field = lambda name: F.get_json_object(e["x"], f"$.{name}")
        ids = F.coalesce(F.from_json(field("evidence_ids"), "array<string>"), F.when(F.coalesce(field("evidence_ids"), F.lit("")) != "", F.array(field("evidence_ids"))), F.array().cast("array<string>"))
        name = F.coalesce(F.nullif(field("claim_id"), F.lit("")), F.format_string("claim_%03d", e["i"]))
        return F.struct(name.alias("claim_id"), F.coalesce(field("text"), F.lit("")).alias("text"), F.filter(ids, lambda x: T.strip(F.coalesce(x, F.lit(""))) != "").alias("evidence_ids"))

    return F.transform(entries, claim)


def allowed_ids(evidence: Column) -> Column:
    """Ids of the records of an array of (evidence_id, relevance_status, ...) that claims may cite."""
    return F.transform(F.filter(evidence, lambda e: e["relevance_status"].isin("relevant", "unknown")), lambda e: e["evidence_id"])


def valid_claims(claims: Column, allowed: Column) -> Column:
    """Claims with a text and at least one allowed id, cut to their allowed ids in the given order."""
    kept = F.transform(claims, lambda c: F.struct(c["claim_id"].alias("claim_id"), T.strip(c["text"]).alias("text"), F.filter(c["evidence_ids"], lambda x: F.array_contains(allowed, x)).alias("evidence_ids")))
    return F.filter(kept, lambda c: (c["text"] != "") & (F.size(c["evidence_ids"]) > 0))


def claim_summary(claims: Column, allowed: Column) -> Column:
    valid = valid_claims(claims, allowed)
    good = F.transform(valid, lambda c: c["claim_id"])
    bad = F.filter(F.transform(claims, lambda c: c["claim_id"]), lambda x: ~F.array_contains(good, x))
    return F.struct(F.size(claims).alias("input_claim_count"), F.size(valid).alias("valid_claim_count"), bad.alias("invalid_claim_ids"), (F.size(bad) == 0).alias("passed"))


def cited(evidence: Column, claims: Column) -> Column:
    """The records of an array that some claim names, in their order."""
    ids = F.flatten(F.transform(claims, lambda c: c["evidence_ids"]))
    return F.filter(evidence, lambda e: F.array_contains(ids, e["evidence_id"]))


def citations_of(evidence: Column) -> Column:
    """Relevant records of an array as they are cited, each once."""
    relevant = F.filter(evidence, lambda e: e["relevance_status"] == "relevant")
    return F.array_distinct(F.transform(relevant, lambda e: F.struct(e["evidence_id"].alias("id"), e["document_title"].alias("doc_title"), e["source"].alias("source"), e["section"].alias("section"), e["url"].alias("url"))))


def cited_citations(evidence: DataFrame, claims: DataFrame, group: str = "request_id") -> DataFrame:
    """(group, id, doc_title, source, section, url) of the relevant records that a valid claim of their request names, each once.

    claims: group, claims (array). Ids are joined, not records, so that a request with very many records costs its ids.
    """
    named = claims.select(group, F.explode("claims").alias("c")).select(group, F.explode("c.evidence_ids").alias("evidence_id")).distinct()
    rows = evidence.where(F.col("relevance_status") == "relevant").join(named, [group, "evidence_id"], "left_semi")
    return rows.select(group, F.col("evidence_id").alias("id"), F.col("document_title").alias("doc_title"), "source", "section", "url").distinct()


def citations(evidence: DataFrame) -> DataFrame:
    """Relevant records as they are cited, each once."""
    return evidence.where(F.col("relevance_status") == "relevant").select(F.col("evidence_id").alias("id"), F.col("document_title").alias("doc_title"), "source", "section", "url").distinct()


def context_block(evidence_id: Column, source: Column, title: Column, section: Column, text: Column) -> Column:
    head = F.concat(F.lit("[EVIDENCE_ID: "), evidence_id, F.lit("] Source: "), F.coalesce(source, F.lit("Medical Reference")), F.lit(" | Document: "), F.coalesce(title, F.lit("Medical Doc")))
    head = F.when(F.coalesce(section, F.lit("")) != "", F.concat(head, F.lit(" | Section: "), section)).otherwise(head)
    return F.concat(head, F.lit("\n"), T.strip(F.coalesce(text, F.lit(""))))


def format_context(evidence: DataFrame, group: str = "request_id", order: str = "evidence_id") -> DataFrame:
    """(group, context): the blocks of each request's records in order, an empty line between them."""
    block = context_block(F.col("evidence_id"), F.col("source"), F.col("document_title"), F.col("section"), F.col("text"))
    rows = evidence.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("l"))
    return rows.select(group, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))


def guarded(df: DataFrame) -> DataFrame:
    """Passes status, answer, language and n_evidence through the last check: answered only with evidence and words, once disclaimed."""
    answered = F.col("status") == "answered"
    blank = T.strip(F.coalesce("answer", F.lit(""))) == ""
    bare = answered & ((F.col("n_evidence") <= 0) | F.col("n_evidence").isNull())
    note = F.when(F.col("language") == "ar", DISCLAIMER["ar"]).otherwise(DISCLAIMER["en"])
    said = F.when(blank, INSUFFICIENT).otherwise(T.strip(F.col("answer")))
    full = F.when(F.contains(said, note), said).otherwise(F.concat(said, F.lit("\n\n"), note))
    return df.withColumns({"status": F.when(bare | answered & blank, "insufficient_evidence").otherwise(F.col("status")), "answer": F.when(bare, INSUFFICIENT).when(answered, full).otherwise(F.col("answer"))})


def rendered(answer: Column) -> Column:
    return F.when(T.strip(F.coalesce(answer, F.lit(""))) == "", APOLOGY).otherwise(T.strip(answer))


def reply_pieces(df: DataFrame, text: str, size: int = REPLY_CHARS) -> DataFrame:
    """A row for each piece of at most `size` characters, numbered by piece_no; an empty or null text is one empty piece."""
    t = F.coalesce(df[text], F.lit(""))
    rest = [c for c in df.columns if c != text]
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")))
    return df.select(*rest, F.posexplode(F.transform(starts, lambda i: F.substring(t, i * size + 1, F.lit(size)))).alias("piece_no", "piece"))
