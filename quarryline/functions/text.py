"""Column functions over text. All run inside the JVM except nfkc()."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space, in a character class.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Fixed value: the name space of point ids.
POINT_NAMESPACE = "a3f1b2c4d5e67890abcdef1234567890"
#: Fixed value: stripped from the ends of terms.
TERM_PUNCTUATION = ".,!?؟؛،:()[]{}\"'"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends. Looks at the ends only, unlike a pattern."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def words(c: Column) -> Column:
    """Parts between white space; none of a blank or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(words(c))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility form. The only function here that leaves the JVM."""
    return _nfkc(c)


# Cleaning -----------------------------------------------------------------------------------------------------------

#: What is cut from every article, in this order.
GENERAL_RULES = [
    (r"http[^%s]+", ""),
    (r"[^%s]+@[^%s]+", ""),
    (r"(?d)Page last reviewed.*?\d{4}", ""),
    (r"(?d)Next review due.*?\d{4}", ""),
    (r"(?md)^[%s]*Contents[%s]*$", ""),
]
#: What is cut in addition from the articles of one source.
SOURCE_RULES = {
    "mayo": [
        (r"(?is)Are you fully protected\?.*?Create my plan", ""),
        (r"(?is)Products & Services.*?Home Remedies", ""),
        (r"(?is)From Mayo Clinic to your inbox.*?Subscribe!", ""),
        (r"(?is)Thank you for subscribing!.*?couple of minutes", ""),
        (r"(?is)Request an appointment.*?resubmit the form\.", ""),
        (r"(?is)Show references.*", ""),
        (r"(?is)Request an appointment[%s]+Diagnosis & treatment.*", ""),
        (r"By Mayo Clinic Staff", ""),
        (r"Print\n", ""),
    ],
}


def _apply(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern.replace("%s", SPACE), new)
    return c


def clean_text(c: Column, source_dir: Column | None = None) -> Column:
    """Without addresses, review dates and contents lines; sources with rules of their own by source_dir."""
    # Texts without any part that a rule needs are told by plain search, which is much faster than the patterns.
    parts = ["http", "@", "Page last reviewed", "Next review due", "Contents"]
    out = F.when(any_of(c, parts), _apply(c, GENERAL_RULES)).otherwise(c)
    if source_dir is not None:
        for name, rules in SOURCE_RULES.items():
            out = F.when(F.lower(source_dir) == name, _apply(out, rules)).otherwise(out)
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_guard(original: Column, cleaned: Column, least: float = 0.5) -> Column:
    """The cleaned text, unless it lost more than half of a non-blank original."""
    before, after = F.length(strip(original)), F.length(strip(cleaned))
    return F.when((before > 0) & (after / F.greatest(before, F.lit(1)) < least), original).otherwise(cleaned)


# Guarding -----------------------------------------------------------------------------------------------------------

#: Signs of an attempt to steer the system.
INJECTION = [
    r"(?Uis)\b(ignore|disregard|override)\b.{0,80}\b(previous| acima|system|developer|instructions?)\b",
    r"(?Ui)\b(system|developer)\s*(prompt|message)\b",
    r"(?Ui)\b(jailbreak| DAN mode|do anything now)\b",
    r"(?Uis)\b(reveal|print|show|leak)\b.{0,50}\b(prompt|instructions?|secret|api key)\b",
    r"(?Ui)<\s*(system|instruction|prompt)\b",
]
#: Personal data and their masks, in this order; dates that look like phone numbers are passed over.
PII = [
    ("email", r"(?Ui)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("phone", r"(?U)(?<!\w)(?!(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}-\d{1,2}-\d{2,4})(?!\w)(?![\d ()-]*\d(?!\w)))(?:\+?\d[\d ()-]{7,}\d)(?!\w)"),
    ("ssn", r"(?U)(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    ("card", r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"),
]
#: Executable content.
MALICIOUS = [("script", r"(?Ui)<\s*/?\s*script\b|javascript\s*:"), ("event_handler", r"(?Ui)\bon\w+\s*="), ("control_character", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")]


def injected(c: Column) -> Column:
    out = F.lit(False)
    for pattern in INJECTION:
        out = out | c.rlike(pattern)
    return out


def mask_pii(c: Column) -> tuple[Column, Column]:
    """(masked text, kinds found); each kind is looked for in what the ones before left."""
    found = []
    for kind, pattern in PII:
        found.append(F.when(c.rlike(pattern), F.lit(f"pii:{kind}")))
        c = F.regexp_replace(c, pattern, f"[REDACTED_{kind.upper()}]")
    return c, F.filter(F.array(*found), lambda x: x.isNotNull())


def malicious(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(f"malicious:{k}")) for k, p in MALICIOUS]), lambda x: x.isNotNull())


def without_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]*>", " "))


def detect_language(c: Column) -> Column:
    """ar if a text has more Arabic letters than Latin ones, else en."""
    arabic = F.length(F.regexp_replace(c, r"[^\x{0600}-\x{06ff}]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when(arabic > latin, "ar").otherwise("en")


def fold_digits(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


# Identity -----------------------------------------------------------------------------------------------------------


def point_id(c: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based identifier (version 5) of a text: equal texts, equal points."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def evidence_id(chunk_id: Column, source: Column, title: Column, section: Column, text: Column) -> Column:
    """The chunk's own id, or one made of its fields."""
    parts = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source, title, section, text)])
    made = F.concat(F.lit("evidence_"), F.substring(F.sha2(parts, 256), 1, 20))
    return F.when(strip(chunk_id) != "", chunk_id).otherwise(made)


def context_key(user: Column) -> Column:
    return F.substring(F.sha2(strip(user), 256), 1, 32)


def url_slug(c: Column) -> Column:
    """Last non-empty step of a URL's path."""
    return F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]+)/*$", 1)


# Terms --------------------------------------------------------------------------------------------------------------


def terms(c: Column) -> Column:
    """Different words of more than two letters, stripped of punctuation, in lower case."""
    stripped = F.transform(words(c), lambda w: F.btrim(w, F.lit(TERM_PUNCTUATION)))
    return F.array_distinct(F.transform(F.filter(stripped, lambda w: F.length(w) > 2), F.lower))


def lexical_overlap(query: Column, text: Column) -> Column:
    return F.size(F.array_intersect(terms(query), terms(text)))


def any_of(c: Column, values: list[str]) -> Column:
    """Whether the text holds one of the values."""
    out = F.lit(False)
    for v in values:
        out = out | c.contains(v)
    return out


def which_of(c: Column, values: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(c, v))


def number(c: Column) -> Column:
    """A number, or null where it is none."""
    return c.try_cast("double")
