"""From articles to an index, and from requests to answers: one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, generation, guards, ingest, retrieval, sessions
from ..operators.store import materialize
from ..providers import LLM, Embedder, embed


def build_index(articles: DataFrame, embedder: Embedder | None = None, key: str = "article_id") -> DataFrame:
    """(id, text, sources, n, vector): cleaned articles cut into chunks, one point for each different chunk text."""
    dirs = F.col("source_dir") if "source_dir" in articles.columns else None
    cleaned = articles.withColumn("content", T.clean_text(F.col("content"), dirs))
    chunks = ingest.chunk_articles(cleaned, key, keep=("source",))
    points = ingest.dedup_sources(chunks, order=[key, "section_no", "part_no"])
    return points.select(F.col("point_id").alias("id"), "text", "sources", "n", embed(F.col("text"), embedder).alias("vector"))


def answer(requests: DataFrame, points: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(request_id, route, status, language, answer, n_evidence, evidence_ids) of each request (request_id, text).

    Blocked, urgent and clinic requests end before retrieval; medical ones are answered by their best evidence's text,
    as far as the gate lets it pass. request_id is unique.
    """
    routed = guards.routed(requests)
    medical = routed.where(F.col("route").isin("medical", "inquiry"))
    asked = medical.select(F.col("request_id").alias("query_id"), F.col("sanitized_text").alias("text"), embed(F.col("sanitized_text"), embedder).alias("vector"))
    found = retrieval.hybrid_retrieve(asked, points).where("relevance_status = 'relevant'")
    best = found.groupBy("query_id").agg(F.min(F.struct("fused_rank", "text")).alias("b"), F.count("*").alias("n_evidence"), F.array_sort(F.collect_list("id")).alias("evidence_ids"))
    joined = routed.join(best.withColumnRenamed("query_id", "request_id"), "request_id", "left")
    retrieved = F.col("route").isin("medical", "inquiry")
    status = F.when(~retrieved, F.col("route")).when(F.coalesce("n_evidence", F.lit(0)) > 0, "answered").otherwise("insufficient_evidence")
    drafted = joined.withColumns({"status": status, "answer": F.col("b.text"), "n_evidence": F.coalesce("n_evidence", F.lit(0))})
    final = evidence.guarded(drafted)
    none = F.array().cast("array<string>")
    return final.select("request_id", "route", "status", "language", F.when(F.col("status") == "answered", F.col("answer")).alias("answer"), "n_evidence", F.coalesce("evidence_ids", none).alias("evidence_ids"))


#: Who answers a route.
AGENTS = {"blocked": "guardrails", "emergency": "safety_agent", "clarification": "orchestrator", "clinic": "clinic_agent", "inquiry": "inquiry_agent", "medical": "documentation_agent"}
_EVIDENCE = ("evidence_id", "text", "document_title", "source", "section", "url", "relevance_status")


def documented(asked: DataFrame, points: DataFrame, llm: LLM | None = None, embedder: Embedder | None = None) -> DataFrame:
    """(request_id, status, answer, claims, evidence_ids, citations, validation, prompt_hash, prompt_length) of medical questions (request_id, text, language).

    The question is rewritten, its evidence retrieved and gated, the model asked for claims that this evidence supports.
    Without a model the question stands for itself and the best record is the answer. points: id, text, vector, and sources.
    """
    rewritten = generation.rewritten(asked.select("request_id", "text", "language"), "text", llm)
    queries = rewritten.select(F.col("request_id").alias("query_id"), F.col("expanded_query").alias("text"), embed(F.concat_ws(" ", "expanded_query", F.nullif("hyde_passage", F.lit(""))), embedder).alias("vector"))
    found = retrieval.hybrid_retrieve(queries, points).where("relevance_status = 'relevant'")
    found = found.join(points.select("id", F.get("sources", F.lit(0)).alias("source")), "id")
    null = F.lit(None).cast("string")
    record = F.struct("fused_rank", F.col("id").cast("string").alias("evidence_id"), "text", null.alias("document_title"), "source", null.alias("section"), null.alias("url"), "relevance_status")
    held = found.groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(record)).alias("l"))  # at most the best few
    block = lambda e: evidence.context_block(e["evidence_id"], e["source"], e["document_title"], e["section"], e["text"])
    rows = asked.select("request_id", "text", "language").join(held, "request_id", "left").select("request_id", "text", "language", F.array_join(F.transform("l", block), "\n\n").alias("context"), F.transform("l", lambda e: F.struct(*[e[c].alias(c) for c in _EVIDENCE])).alias("evidence"))
    return generation.generated(rows, llm).select("request_id", "status", "answer", "claims", "evidence_ids", "citations", "validation", "prompt_hash", "prompt_length")


def handle(requests: DataFrame, points: DataFrame, inquiries: DataFrame | None = None, llm: LLM | None = None, embedder: Embedder | None = None, phone: str = "") -> DataFrame:
    """One result a request (request_id, user_ref, requested_at, text): route, agent, status, answer, claims, evidence_ids, citations, language.

    Requests that are blocked, urgent, unclear or about the clinic, and replies in an inquiry, end with their fixed reply or
    next question; what is left is documented. request_id is unique. inquiries as in guards.decided.
    """
    routed = materialize(guards.routed(requests, inquiries=inquiries).select("request_id", "sanitized_text", "language", "route"), "routed")
    said = sessions.extracted(F.col("sanitized_text"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(c != "", F.array(c)).otherwise(none)
    _, missing = sessions.scored(listed(said["symptom"]), said["onset_or_duration"], said["severity"], listed(said["associated"]), said["relevant_context"])
    kind = F.when(F.col("route") == "emergency", generation.emergency_reply(F.col("language"), F.lit(phone))).when(F.col("route") == "inquiry", sessions.question(missing, F.col("language"))).otherwise(generation.reply(F.col("route"), F.col("language")))
    status = F.when(F.col("route") == "clarification", "clarification_needed").when(F.col("route") == "inquiry", "collecting").otherwise(F.col("route"))
    fixed = routed.where("route <> 'medical'").select("request_id", "route", "language", status.alias("status"), kind.alias("answer"), F.lit(0).alias("n_evidence"))
    medical = routed.where("route = 'medical'")
    answers = documented(medical.select("request_id", F.col("sanitized_text").alias("text"), "language"), points, llm, embedder)
    answered = medical.select("request_id", "route", "language").join(answers, "request_id").select("request_id", "route", "language", "status", "answer", F.size("evidence_ids").alias("n_evidence"), "claims", "evidence_ids", "citations")
    whole = evidence.guarded(answered).unionByName(fixed, allowMissingColumns=True)
    agent = F.create_map(*[F.lit(x) for kv in AGENTS.items() for x in kv])
    return generation.normalized_results(whole, F.col("route")).select("request_id", "route", F.element_at(agent, F.col("route")).alias("agent"), "status", "language", "answer", "claims", "evidence_ids", "citations")
