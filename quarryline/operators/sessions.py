"""Keyed state over time, as batches: sessions, deduplication, the inquiry's fold."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of what an inquiry has to know.
WEIGHTS = {"symptoms": 0.25, "onset_or_duration": 0.20, "severity": 0.20, "associated_symptoms": 0.20, "relevant_context": 0.15}
READY, TURNS = 0.7, 5
#: Patterns of durations, changes, severities and circumstances.
DURATION = (
    r"(?:for|since)\s+[^,.!?]+|(?:منذ|من|لمدة|بقال(?:ي|ه|ها|و)?)\s*[^،,.!?]+"
    r"|\d+\s*(?:minute|minutes|hour|hours|day|days|week|weeks|month|months|دقيقة|دقائق|ساعة|ساعات|يوم|يومين|يومان|أيام|ايام|أسبوع|أسابيع|اسابيع|شهر|شهور)|\b(?:today|yesterday|اليوم|أمس|امس)\b"
)
TRAJECTORY = r"(?:improving|improved|better|worse|worsening|getting worse|same|stable|unchanged|يتحسن|تحسن|أفضل|افضل|يزداد سوءا|بيزيد|يزيد|أسوأ|اسوا|ثابت|مستمر|كما هو)"
SEVERITY = r"severe|mild|moderate|شديد|خفيف|متوسط"
NUMERIC = r"\b(?:[1-9]|10)\s*(?:/\s*10)?\b"
ASSOCIATED = r"\bwith\b|\bother symptoms?\b|\bأعراض أخرى\b|\bمع\b"
RELEVANT = r"\bage\b|\bpregnan|\bmedication|\bhistory\b|\bمرض مزمن\b|\bحامل\b|\bأدوية\b|\bتاريخ مرضي\b"
OPENING = r"^(i have|i'm having|i am having|عندي|لدي|أعاني|اعاني)\s*"


def sessionized(df: DataFrame, user: str, at: str, minutes: int = 30, span: int = 86_400) -> DataFrame:
    """Adds session_no: from 0, the next one where more than `minutes` lie between two events of a user.

    Events of one moment belong together; null moments come first and open a session of their own. Events are ordered
    within spans of `span` seconds of a user, and spans are stitched by their first and last moments, so that a user with
    a third of all events is shared out among tasks.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    base = df.withColumns({"__m": micros, "__b": F.when(micros.isNull(), F.lit(-(1 << 40))).otherwise(F.floor(micros / (span * 1_000_000)))})
    w = Window.partitionBy(user, "__b").orderBy("__m")
    longer = lambda gap: F.when(gap > minutes * 60_000_000, 1).otherwise(0)
    local = base.withColumn("__f", longer(F.col("__m") - F.lag("__m").over(w)))
    spans = local.groupBy(user, "__b").agg(F.min("__m").alias("__lo"), F.max("__m").alias("__hi"), F.sum("__f").alias("__s"))
    # A row a span; the span of null moments is a session of its own.
    by = Window.partitionBy(user).orderBy("__b")
    first = F.when(F.lag("__b").over(by).isNull(), 0).when(F.lag("__hi").over(by).isNull(), 1).otherwise(longer(F.col("__lo") - F.lag("__hi").over(by)))
    starts = spans.withColumn("__first", first).select(F.col(user).alias("__u"), F.col("__b").alias("__c"), (F.sum(F.col("__first") + F.col("__s")).over(by) - F.col("__s")).alias("__start"))
    joined = local.join(starts, F.col(user).eqNullSafe(F.col("__u")) & (F.col("__b") == F.col("__c")))
    inside = F.sum("__f").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("session_no", (F.col("__start") + inside).cast("int")).select(*df.columns, "session_no")


def stale(updated_at: Column, now: Column, minutes: int = 30) -> Column:
    """Whether more than `minutes` lie between an ISO moment and now; false if it is blank or no moment."""
    at = F.coalesce(F.try_to_timestamp(updated_at), F.lit(None))
    return F.coalesce(F.unix_micros(now) - F.unix_micros(at) > minutes * 60_000_000, F.lit(False))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by a partial aggregation before the shuffle, so that hot keys cost one row a task."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ranks, *rest)).alias("__v"))
    return picked.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_of_each(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The last row of each key by the columns `at`, nulls first; ties by the other columns' values."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(at)], *rest)).alias("__v"))
    return picked.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest]).select(*df.columns)


def discard_stale(answers: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Answers whose session still has the id and version with which they were computed (columns session_id, session_version)."""
    now = sessions.select(*keys, F.col("session_id").alias("__id"), F.col("session_version").alias("__version"))
    joined = answers.join(now, keys, "left")
    return joined.where(F.col("session_id").eqNullSafe(F.col("__id")) & F.col("session_version").eqNullSafe(F.col("__version")) & F.col("__id").isNotNull()).select(*answers.columns)


def scored(symptoms: Column, duration: Column, severity: Column, associated: Column, relevant: Column) -> tuple[Column, Column]:
    """(sufficiency score, missing fields in order)."""
    some = lambda c: F.coalesce(T.strip(c) != "", F.lit(False))
    any_ = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    has = {"symptoms": any_(symptoms), "onset_or_duration": some(duration), "severity": some(severity), "associated_symptoms": any_(associated), "relevant_context": some(relevant)}
    total = sum((F.when(c, WEIGHTS[n]).otherwise(0.0) for n, c in has.items()), F.lit(0.0))
    missing = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in has.items()]), lambda x: x.isNotNull())
    return F.round(total, 2), missing


#: What a message tells of a field: the pattern that says so, where it is looked for (the folded text or the text itself) and
#: what is taken (what matched, or all of the message). A later rule of a field goes before an earlier one.
RULES = (
    ("onset_or_duration", DURATION, "folded", "match"),
    ("trajectory", TRAJECTORY, "folded", "all"),
    ("severity", SEVERITY, "folded", "all"),
    ("severity", NUMERIC, "own", "match"),
    ("associated_symptoms", ASSOCIATED, "folded", "all"),
    ("relevant_context", RELEVANT, "folded", "all"),
)


def extracted(c: Column) -> dict[str, Column]:
    """What one message says, as columns; empty where it says nothing."""
    texts = {"folded": T.fold_digits(F.lower(c)), "own": c}
    found: dict[str, Column] = {"symptom": F.btrim(F.regexp_replace(c, "(?Ui)" + OPENING, ""), F.lit(" .؟?"))}
    for name, pattern, where, take in RULES:
        held = found.get(name, F.lit(""))
        match = F.regexp_extract(texts[where], "(?Ui)" + pattern, 0)
        found[name] = F.when(match != "", T.strip(match if take == "match" else c)).otherwise(held)
    found["associated"] = found.pop("associated_symptoms")
    return found


#: What is asked for a missing field.
QUESTIONS = {
    "en": {
        "symptoms": "What symptom or concern should I focus on?",
        "onset_or_duration": "How long have you had this symptom, and is it getting better or worse?",
        "severity": "How severe is it, for example mild, moderate, severe, or on a scale from 1 to 10?",
        "associated_symptoms": "Do you have any other symptoms along with it?",
        "relevant_context": "Is there any relevant context, such as your age group, pregnancy, medicines, or a medical history?",
    },
    "ar": {
        "symptoms": "ما العرض أو المشكلة التي تريد مني التركيز عليها؟",
        "onset_or_duration": "منذ متى بدأ العرض؟ وهل يتحسن أم يزداد سوءاً؟",
        "severity": "ما شدة العرض: خفيف أم متوسط أم شديد، أو من 1 إلى 10؟",
        "associated_symptoms": "هل توجد أعراض أخرى مصاحبة؟",
        "relevant_context": "هل توجد معلومات مهمة مثل الفئة العمرية أو الحمل أو الأدوية أو تاريخ مرضي؟",
    },
}


def question(missing: Column, language: Column) -> Column:
    """What to ask next: for the first missing field, in Arabic or English."""
    first = F.coalesce(F.get(missing, F.lit(0)), F.lit("relevant_context"))
    table = lambda g: F.create_map(*[F.lit(x) for kv in QUESTIONS[g].items() for x in kv])
    return F.when(language == "ar", F.element_at(table("ar"), first)).otherwise(F.element_at(table("en"), first))


def augmented(asked: Column, symptoms: Column, duration: Column, severity: Column, relevant: Column) -> Column:
    """The question with what is known of the case: symptoms, then what else is known, in brackets."""
    known = [F.concat(F.lit(f"{n}: "), F.nullif(c, F.lit(""))) for n, c in (("duration", duration), ("severity", severity), ("context", relevant))]
    details = F.filter(F.array(*known), lambda x: x.isNotNull())
    summary = F.concat(F.coalesce(F.array_join(symptoms, ", "), F.lit("")), F.when(F.size(details) > 0, F.concat(F.lit(" ("), F.array_join(details, ", "), F.lit(")"))).otherwise(""))
    return F.concat(F.lit("User question: "), summary, F.lit(" - "), asked)


def lease_step(held: tuple[str, float, int], event: str, at: float, seconds: int) -> tuple[tuple[str, float, int], bool]:
    """(state, whether granted): a claim fails while another one holds or after completion; failed ones may be claimed again."""
    status, claimed, attempts = held
    if event == "claim":
        if status == "completed" or status == "processing" and at - claimed < seconds:
            return held, False
        return ("processing", at, attempts + 1), True
    if event in ("complete", "fail"):
        return ("completed" if event == "complete" else "failed", claimed, attempts), True
    return held, False


def lease_fold(events: DataFrame, order: list[str], seconds: int = 300) -> DataFrame:
    """(update_id, event, at, granted, status, attempts) of each event (update_id, event, at), in order within its update."""
    kind = events.schema["update_id"].dataType.simpleString()
    ordered = events.where("update_id is not null").repartition("update_id").sortWithinPartitions("update_id", *order)

    def run(frames):
        now, held = None, ("", 0.0, 0)
        for frame in frames:
            out = []
            for u, e, a in zip(frame["update_id"], frame["event"], frame["at"]):
                if u != now:
                    now, held = u, ("", 0.0, 0)
                held, granted = lease_step(held, e, a.timestamp(), seconds)
                out.append((u, e, a, granted, held[0], held[2]))
            yield pd.DataFrame(out, columns=["update_id", "event", "at", "granted", "status", "attempts"])

    return ordered.select("update_id", "event", "at").mapInPandas(run, f"update_id {kind}, event string, at timestamp, granted boolean, status string, attempts int")


# The fold: one transition function for batches and streams ------------------------------------------------------------


@dataclass
class Inquiry:
    symptoms: list[str] = field(default_factory=list)
    onset_or_duration: str = ""
    trajectory: str = ""
    severity: str = ""
    associated_symptoms: list[str] = field(default_factory=list)
    relevant_context: str = ""
    turn_count: int = 0
    status: str = ""
    session_version: int = 0
    score: float = 0.0


_digits = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_rules = [(name, re.compile(pattern, re.I), where, take) for name, pattern, where, take in RULES]
_opening = re.compile(OPENING, re.I)
CLOSED = ("ready", "completed", "limit_reached")
IDLE_MINUTES = 30


def told(text: str) -> dict[str, str]:
    """What one message says, by field, as `extracted` finds it."""
    texts = {"folded": text.lower().translate(_digits), "own": text}
    hits = ((name, take, pattern.search(texts[where])) for name, pattern, where, take in _rules)
    return {name: (m.group(0) if take == "match" else text).strip() for name, take, m in hits if m}


def advance(state: Inquiry, text: str | None, idle: bool = False) -> Inquiry:
    """The state after one more message. A closed inquiry begins anew under the next version; one that was idle for too long is forgotten, as after /new and /reset."""
    text = text or ""
    command = text.strip().split(" ")[0]
    if command in ("/new", "/reset"):
        return Inquiry(session_version=0 if idle else state.session_version)
    if idle:
        state = Inquiry()
    elif state.status in CLOSED:
        state = Inquiry(session_version=state.session_version)
    fields = asdict(state)
    if not state.symptoms and (complaint := _opening.sub("", text).strip(" .؟?")):
        fields["symptoms"] = [complaint]
    for name, value in told(text).items():
        fields[name] = [value] if name == "associated_symptoms" else value
    fields["score"] = round(sum(weight for name, weight in WEIGHTS.items() if fields[name]), 2)
    fields["turn_count"] += 1
    fields["session_version"] += 1
    fields["status"] = "ready" if fields["score"] >= READY else "limit_reached" if fields["turn_count"] >= TURNS else "collecting"
    return Inquiry(**fields)


FOLDED = "at timestamp, turn_no int, symptoms array<string>, onset_or_duration string, severity string, score double, status string, turn_count int, session_version int"


def folded_row(at, turn: int, x: Inquiry) -> tuple:
    return at, turn, list(x.symptoms), x.onset_or_duration, x.severity, x.score, x.status, x.turn_count, x.session_version


def inquiry_fold(messages: DataFrame, user: str, at: str, text: str, minutes: int = IDLE_MINUTES) -> DataFrame:
    """(user, at, turn_no, ...): the state of each user's inquiry after each message, in the order of time, ties by text.

    After more than `minutes` without a message all is forgotten, and turns count from 0 again. So a user's sessions don't
    depend on each other, and each is folded by itself: a user with a third of all messages is shared out by sessions.
    Within one, a batch at a time is read: state is kept, messages are not. Null users are left out.
    """
    kind = messages.schema[user].dataType.simpleString()
    rows = messages.where(F.col(user).isNotNull()).select(F.col(user).alias("u"), F.col(at).cast("timestamp").alias("at"), F.col(text).alias("t"))
    ordered = sessionized(rows, "u", "at", minutes).repartition("u", "session_no").sortWithinPartitions("u", "session_no", "at", "t")

    def run(frames):
        now, state, turn = None, Inquiry(), 0
        for frame in frames:
            out = []
            for u, n, a, t in zip(frame["u"], frame["session_no"], frame["at"], frame["t"]):
                if (u, n) != now:
                    now, state, turn = (u, n), Inquiry(), 0
                state = advance(state, t)
                out.append((u, *folded_row(a, turn, state)))
                turn += 1
            yield pd.DataFrame(out, columns=[user, *(c.split()[0] for c in FOLDED.split(", "))])

    return ordered.select("u", "session_no", "at", "t").mapInPandas(run, f"`{user}` {kind}, {FOLDED}")
