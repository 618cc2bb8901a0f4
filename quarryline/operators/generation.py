"""From evidence to an answer: prompts, the language model's place, what its answer becomes, fixed replies."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..providers import LLM
from . import evidence, sessions

#: What is said where nothing is generated, by language.
REPLIES = {
    "blocked": {"en": "I cannot process that request. Please rephrase your medical question safely and directly.", "ar": "لا أستطيع معالجة هذا الطلب. اكتب سؤالك الطبي بصياغة آمنة ومباشرة."},
    "clarification": {"en": "To help you safely, please describe the symptom or concern, where it is, and how long it has been present.", "ar": "لأساعدك بأمان، اذكر العرض أو المشكلة التي تريد مناقشتها، مع مكانها ومدة وجودها."},
    "emergency": {
        "en": "This may be a medical emergency. Call your local emergency number or go to the nearest emergency department immediately. Do not wait for an online response.",
        "ar": "هذه قد تكون حالة طارئة. اتصل برقم الطوارئ المحلي أو توجه إلى أقرب قسم طوارئ فوراً. لا تنتظر رداً عبر الإنترنت.",
    },
    "limit_reached": {"en": "I do not have enough information to assess this safely. Please provide more detail or consult a healthcare professional.", "ar": "لا أملك معلومات كافية لتقييم الحالة بأمان. يرجى تقديم مزيد من التفاصيل أو استشارة طبيب مختص."},
    "insufficient_evidence": {"en": "I do not have enough reliable medical information in the available sources to answer this safely.", "ar": "لا أملك معلومات طبية موثوقة كافية للإجابة عن هذا السؤال بأمان ضمن المصادر المتاحة حالياً."},
}
#: The line with the clinic's number that may follow an urgent reply, and what stands for an empty context.
PHONE_LINE = {"en": "Clinic emergency phone: ", "ar": "رقم طوارئ العيادة: "}
NO_CONTEXT = "(No relevant evidence retrieved)"
PROMPT = """Answer the question from the evidence below and from nothing else, in the question's language.
Give one JSON object: answer (text), status ("answered" or "insufficient_evidence"), claims (list of claim_id, text, evidence_ids).
Each claim names the evidence blocks that support it by their ids as given. Where they don't suffice, say so and make no claims.

Patient: {patient_context}

Evidence:
{context}

Question:
{query}
"""
REWRITE = """Rewrite the question for a search in medical texts. Give one JSON object: expanded_query (text), medical_keywords (list of words), hyde_passage (a passage that could answer it).

Question:
{query}
"""


def reply(kind: Column | str, language: Column) -> Column:
    """The fixed reply of a kind in Arabic or English; null for other kinds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    table = lambda g: F.create_map(*[F.lit(x) for k, v in REPLIES.items() for x in (k, v[g])])
    return F.when(language == "ar", F.try_element_at(table("ar"), kind)).otherwise(F.try_element_at(table("en"), kind))


def emergency_reply(language: Column, phone: Column) -> Column:
    """The urgent reply, with the phone line if there is a number."""
    line = F.when(language == "ar", PHONE_LINE["ar"]).otherwise(PHONE_LINE["en"])
    return F.when(F.coalesce(phone, F.lit("")) != "", F.concat(reply("emergency", language), F.lit("\n"), line, phone)).otherwise(reply("emergency", language))


def guard_text(query: Column) -> Column:
    """The user's own words of an augmented query: before the structured context, without the prefix."""
    own = T.strip(F.substring_index(query, "\nStructured patient context:", 1))
    return F.when(own.startswith("User question:"), T.strip(F.substring(own, len("User question:") + 1, 1 << 30))).otherwise(own)


def format_prompt(query: Column, context: Column, patient: Column | None = None, template: str = PROMPT) -> Column:
    """The template with its three places filled in one pass, so that braces in the values stay as they are. patient is JSON with sorted keys, {} if it is null.

    An empty or null context is said to be none.
    """
    values = {"context": F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(context), "patient_context": F.coalesce(patient, F.lit("{}")) if patient is not None else F.lit("{}"), "query": F.coalesce(query, F.lit(""))}
    parts: list[Column] = []
    rest = template
    while rest:
        at = {name: rest.find("{" + name + "}") for name in values}
        at = {name: i for name, i in at.items() if i >= 0}
        if not at:
            parts.append(F.lit(rest))
            break
        name = min(at, key=at.get)
        parts += [F.lit(rest[: at[name]]), values[name]]
        rest = rest[at[name] + len(name) + 2 :]
    return F.concat(*parts)


def patient_json(columns: list[str]) -> Column:
    """The given columns as a JSON object with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]))


def prompt_facts(prompt: Column) -> dict[str, Column]:
    """prompt_hash and prompt_length, which may be kept where the prompt may not."""
    return {"prompt_hash": F.sha2(prompt, 256), "prompt_length": F.length(prompt)}


def completed(prompt: Column, llm: LLM, as_json: bool = True) -> Column:
    """(text, error) of the model's answer to each prompt, a batch at a time; one client serves a task.

    If the model refuses the JSON form it is asked again without; a failing batch gives null texts with the error.
    """

    @F.pandas_udf("text string, error string")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        wanted = prompts.fillna("").tolist()
        error = ""
        for form in (True, False) if as_json else (False,):
            try:
                return pd.DataFrame({"text": llm.complete(wanted, as_json=form), "error": ""})
            except Exception as e:  # noqa: BLE001 - whatever a provider raises
                error = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"text": [None] * len(wanted), "error": error})

    return ask(prompt)


def rewritten(df: DataFrame, query: str = "text", llm: LLM | None = None) -> DataFrame:
    """Adds expanded_query, medical_keywords and hyde_passage.

    Blank queries have empty ones. Without a model, or where it fails or gives no JSON, the query stands for itself.
    """
    own = F.coalesce(df[query], F.lit(""))
    none = F.array().cast("array<string>")
    if llm is None:
        out = df.withColumns({"__p": F.lit(None).cast("string")})
    else:
        out = df.withColumn("__c", completed(F.replace(F.lit(REWRITE), F.lit("{query}"), own), llm)).withColumn("__p", evidence.json_object(F.col("__c.text"))).drop("__c")
    blank = T.strip(own) == ""
    field = lambda name: F.get_json_object("__p", f"$.{name}")
    words = F.coalesce(F.from_json(field("medical_keywords"), "array<string>"), none)
    return out.withColumns({
        "expanded_query": F.when(blank, "").otherwise(F.coalesce(field("expanded_query"), own)),
        "medical_keywords": F.when(blank, none).otherwise(words),
        "hyde_passage": F.when(blank, "").otherwise(F.coalesce(field("hyde_passage"), F.lit(""))),
    }).drop("__p")


EXTRACT = """Say what the message tells of the sender's complaint. Give one JSON object with symptom, onset_or_duration, trajectory, severity, associated, relevant_context and next_question; leave empty what it doesn't say.

Message:
{query}
"""


def extracted(df: DataFrame, text: str = "text", llm: LLM | None = None) -> DataFrame:
    """Adds what each message says by field, and next_question (null without a model): what the model says where it says something, else what the rules find."""
    found = sessions.extracted(F.coalesce(df[text], F.lit("")))
    if llm is None:
        return df.withColumns({**found, "next_question": F.lit(None).cast("string")})
    out = df.withColumn("__c", completed(F.replace(F.lit(EXTRACT), F.lit("{query}"), F.coalesce(df[text], F.lit(""))), llm)).withColumn("__p", evidence.json_object(F.col("__c.text"))).drop("__c")
    told = lambda name: F.nullif(T.strip(F.get_json_object("__p", f"$.{name}")), F.lit(""))
    return out.withColumns({**{name: F.coalesce(told(name), c) for name, c in found.items()}, "next_question": told("next_question")}).drop("__p")


def judged_answers(df: DataFrame, payload: str = "payload") -> DataFrame:
    """What becomes of a model's answers: adds status, answer, claims, evidence_ids, citations and validation.

    df has language, evidence (array of evidence_id, document_title, source, section, url, relevance_status, ...) and the
    payload, JSON or null. Only claims on allowed evidence stand; without one nothing is answered. No evidence, or no
    JSON, gives the fixed reply and no claims. Cited evidence is a semi-join of the evidence on the ids of valid claims.
    """
    none = F.array().cast("array<string>")
    object_ = evidence.json_object(F.col(payload))
    ok = (F.size(F.coalesce("evidence", F.array())) > 0) & F.coalesce(F.json_array_length(F.concat(F.lit("["), object_, F.lit("]"))) == 1, F.lit(False))
    claims = F.when(ok, evidence.claims_of(F.col(payload))).otherwise(F.array().cast(evidence.CLAIM))
    out = df.withColumns({"__ok": ok, "__object": object_, "__claims": claims, "__allowed": F.coalesce(evidence.allowed_ids(F.col("evidence")), none)})
    out = out.withColumns({"claims": evidence.valid_claims(F.col("__claims"), F.col("__allowed")), "validation": evidence.claim_summary(F.col("__claims"), F.col("__allowed"))})
    said = F.coalesce(T.strip(F.get_json_object("__object", "$.answer")), F.lit(""))
    stated = F.nullif(F.get_json_object("__object", "$.status"), F.lit(""))
    status = F.coalesce(stated, F.when(F.size("claims") > 0, "answered").otherwise("insufficient_evidence"))
    status = F.when(~F.col("__ok") | (status == "answered") & (F.size("claims") == 0), "insufficient_evidence").otherwise(status)
    out = out.withColumn("status", status)
    answer = F.when(~F.col("__ok") | (F.col("status") == "insufficient_evidence") & (said == ""), reply("insufficient_evidence", F.col("language"))).otherwise(said)
    cited = evidence.cited(F.col("evidence"), F.col("claims"))
    out = out.withColumns({"answer": answer, "__cited": F.coalesce(cited, F.array().cast(df.schema["evidence"].dataType))})
    out = out.withColumns({"evidence_ids": F.transform("__cited", lambda e: e["evidence_id"]), "citations": evidence.citations_of(F.col("__cited"))})
    return out.drop("__ok", "__object", "__claims", "__allowed", "__cited")


def generated(df: DataFrame, llm: LLM | None, query: str = "text", context: str = "context", patient: str | None = None) -> DataFrame:
    """Asks the model for each row (query, context, language, evidence) and judges what it says; adds the prompt's facts too.

    Without a model the answer is extractive: the first relevant record is the one claim and the text.
    """
    prompt = format_prompt(F.col(query), F.col(context), F.col(patient) if patient else None)
    rows = df.withColumns(prompt_facts(prompt))
    if llm is None:
        best = F.get(F.filter("evidence", lambda e: e["relevance_status"].isin("relevant", "unknown")), F.lit(0))
        payload = F.when(best.isNotNull(), F.to_json(F.struct(best["text"].alias("answer"), F.array(F.struct(best["text"].alias("text"), F.array(best["evidence_id"]).alias("evidence_ids"))).alias("claims"))))
        return judged_answers(rows.withColumn("payload", payload)).drop("payload")
    asked = rows.withColumn("__c", F.when(F.size(F.coalesce("evidence", F.array())) > 0, completed(prompt, llm)))
    return judged_answers(asked.withColumns({"payload": F.col("__c.text"), "generation_error": F.coalesce("__c.error", F.lit(""))}).drop("__c")).drop("payload")


RESULT = {"status": "string", "user_response": "string", "answer": "string", "claims": evidence.CLAIM, "evidence_ids": "array<string>", "citations": "array<struct<id:string,doc_title:string,source:string,section:string,url:string>>"}


def normalized_results(df: DataFrame, default_status: Column) -> DataFrame:
    """The contract that all routes share: status by default the route's, answer and user_response the same text, empty lists for missing ones."""
    has = set(df.columns)
    got = lambda name: F.col(name) if name in has else F.lit(None).cast(RESULT[name])
    said = F.coalesce(F.nullif(got("user_response"), F.lit("")), got("answer"), F.lit(""))
    lists = {n: F.coalesce(got(n), F.array().cast(RESULT[n])) for n in ("claims", "evidence_ids", "citations")}
    return df.withColumns({"status": F.coalesce(got("status"), default_status), "user_response": said, "answer": said, **lists})


def internal(df: DataFrame) -> DataFrame:
    """What reviewers see of a result: all of it."""
    return df.select("*")


def fingerprint(template: str) -> str:
    """The identity of a prompt template."""
    return hashlib.sha256(template.encode()).hexdigest()
