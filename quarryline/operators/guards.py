"""Requests: sanitising, routing, clarification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Phrases that make a request an emergency, and those that concern the clinic.
EMERGENCY = [
    "can't breathe", "cannot breathe", "difficulty breathing", "chest pain", "unconscious", "not responding", "severe bleeding", "stroke", "seizure", "suicide", "overdose", "anaphylaxis", "vomiting blood", "heart attack",
    "لا أستطيع التنفس", "صعوبة في التنفس", "ألم في الصدر", "نزيف شديد", "نزيف حاد", "فاقد الوعي", "فاقد للوعي", "سكتة دماغية", "جلطة", "جلطه", "تشنج", "جرعة زائدة", "حساسية شديدة", "أزمة قلبية", "ازمة قلبية", "توقف القلب", "مش قادر اتنفس", "مش عارف اتنفس", "إغماء", "اغماء",
]
CLINIC = [
    "appointment", "book", "booking", "cancel", "reschedule", "clinic", "doctor availability", "opening hours", "hours", "price", "pricing", "cost", "insurance", "location", "address",
    "موعد", "مواعيد", "حجز", "احجز", "إلغاء", "الغاء", "إعادة الحجز", "عيادة", "العياده", "سعر", "أسعار", "اسعار", "تكلفة", "تأمين", "التأمين", "عنوان", "موقع", "ساعات العمل", "مواعيد الأطباء", "تخصصات", "تخصص", "دكاترة", "دكتور", "أطباء", "طبيب", "متاح", "المتاح",
]
#: Marks of personal, symptom and general questions.
PERSONAL = ["i have", "i'm having", "i am having", "my ", "for me", "عندي", "لدي", "أعاني", "اعاني", "أشعر", "اشعر", "ابني", "ابنتي"]
SYMPTOM = ["pain", "ache", "fever", "cough", "rash", "swelling", "dizzy", "vomit", "headache", "breath", "bleeding", "ألم", "وجع", "حمى", "حرارة", "سعال", "تورم", "دوخة", "قيء", "صداع", "تنفس", "نزيف", "عرض", "أعراض"]
GENERAL = [
    "what is", "what are", "common", "causes of", "symptoms of", "how does", "how to", "treatment", "treat", "cure", "remedies", "prevention", "definition",
    "ما هو", "ما هي", "ما هى", "أسباب", "اسباب", "اعراض", "أعراض مرض", "كيف يحدث", "علاج", "طرق علاج", "كيفية علاج", "الوقاية", "تعريف", "معلومات عن", "شرح",
]


def sanitized(df: DataFrame, text: str = "text", normalize: bool = True) -> DataFrame:
    """Adds original_length, sanitized_text, findings, allowed and the three flags; a null text is treated as empty.

    Texts of ASCII letters are their own compatibility form, so Python gets the others' texts only.
    """
    raw = F.coalesce(df[text], F.lit(""))
    out = df.withColumn("original_length", F.length(raw))
    if normalize:
        out = out.withColumn("__n", T.strip(F.coalesce(T.nfkc(F.when(raw.rlike(r"[^\x00-\x7f]"), raw)), raw)))
    else:
        out = out.withColumn("__n", T.strip(raw))
    masked, kinds = T.mask_pii(F.col("__n"))
    out = out.withColumns({"__m": masked, "__k": kinds, "prompt_injection_detected": T.injected(F.col("__n"))})
    out = out.withColumns({"__x": T.malicious(F.col("__m")), "sanitized_text": T.without_tags(F.col("__m"))})
    findings = F.concat(F.when(F.col("prompt_injection_detected"), F.array(F.lit("prompt_injection"))).otherwise(F.array().cast("array<string>")), F.col("__k"), F.col("__x"))
    out = out.withColumns({"findings": findings, "pii_detected": F.size("__k") > 0, "malicious_content_detected": F.size("__x") > 0})
    allowed = (F.col("sanitized_text") != "") & ~F.col("prompt_injection_detected") & ~F.col("pii_detected") & ~F.col("malicious_content_detected")
    return out.withColumn("allowed", allowed).drop("__n", "__m", "__k", "__x")


def classified(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds query_class, confidence and matched_terms: emergency phrases before clinic terms, medical otherwise."""
    q = F.col("__q")  # of a projection before, so that it is worked out once for all terms
    df = df.withColumn("__q", F.lower(T.squeeze(F.coalesce(df[text], F.lit("")))))
    df = df.withColumns({"__e": T.which_of(q, EMERGENCY), "__c": T.which_of(q, CLINIC)})
    emergency, clinic = F.col("__e"), F.col("__c")
    urgent, local = F.size(emergency) > 0, F.size(clinic) > 0
    return df.withColumns({
        "query_class": F.when(urgent, "emergency").when(local, "clinic_query").otherwise("medical_query"),
        "confidence": F.when(urgent, 0.99).when(local, 0.92).otherwise(0.70),
        "matched_terms": F.when(urgent, emergency).when(local, clinic).otherwise(F.array().cast("array<string>")),
    }).drop("__q", "__e", "__c")


def clarified(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_personal, confidence and language: a symptom in one's own case, not a general question."""
    q = F.col("__q")
    df = df.withColumn("__q", F.lower(T.strip(F.coalesce(df[text], F.lit("")))))
    personal = T.any_of(q, SYMPTOM) & (T.any_of(q, PERSONAL) | ~T.any_of(q, GENERAL))
    return df.withColumns({"is_personal": personal, "confidence": F.when(personal, 0.85).otherwise(0.8), "language": T.detect_language(F.coalesce(df[text], F.lit("")))}).drop("__q")


def routed(df: DataFrame, text: str = "text", least_confidence: float = 0.55, inquiries: DataFrame | None = None, user: str = "user_ref", at: str = "requested_at") -> DataFrame:
    """Sanitises, clarifies and classifies requests and adds what `decided` does."""
    return decided(sanitized(df, text), "sanitized_text", least_confidence, inquiries, user, at)


def decided(df: DataFrame, text: str, least_confidence: float = 0.55, inquiries: DataFrame | None = None, user: str = "user_ref", at: str = "requested_at", minutes: int = 30) -> DataFrame:
    """Adds route: blocked, emergency, clarification, clinic, inquiry or medical, in this order of precedence, and decided_by.

    df has `allowed`. inquiries (context_key, status, saved_at), a row a key, are the users' open inquiries: a reply to one
    that is still collecting and was saved at most `minutes` before goes on with it, whatever it looks like, unless it is
    urgent or about the clinic. Without them, or for a null user, each request stands for itself.
    """
    seen = classified(clarified(df, text), text)  # the class's confidence replaces the other
    if inquiries is None:
        seen = seen.withColumn("__open", F.lit(False))
    else:
        known = inquiries.where("status = 'collecting'").select(F.col("context_key").alias("__key"), F.col("saved_at").alias("__saved"))
        seen = seen.withColumn("__own", T.context_key(F.col(user))).join(known, F.col("__own") == F.col("__key"), "left")
        idle = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__saved").cast("timestamp")) > minutes * 60_000_000
        seen = seen.withColumn("__open", F.coalesce(F.col("__key").isNotNull() & ~idle & (F.col("query_class") == "medical_query"), F.lit(False))).drop("__own", "__key", "__saved")
    kept = F.col("__open")
    seen = seen.withColumns({"confidence": F.when(kept, 1.0).otherwise(F.col("confidence")), "decided_by": F.when(kept, "active_inquiry").otherwise("classifier")})
    route = (
        F.when(~F.col("allowed"), "blocked").when(F.col("query_class") == "emergency", "emergency").when(kept, "inquiry").when(F.col("confidence") < least_confidence, "clarification")
        .when(F.col("query_class") == "clinic_query", "clinic").when(F.col("is_personal"), "inquiry").otherwise("medical")
    )
    return seen.withColumn("route", route).drop("__open")
