"""Problem 5: personal items in free text, found and replaced.

Detection reads a text once in a folded form of equal length (other scripts'
digits as ASCII, wide signs as plain ones). E-mail addresses, street addresses,
identity numbers and telephone numbers are recognised by their shape and, where
shapes are shared, by what stands before them; names by the words around them,
a list of known names and the corpus's own ordinary words.

Replacements are keyed: the same item gets the same surrogate everywhere
(coreference), of its own type, script and format. Surrogates of one type that
would fall on two different items, or on an item that occurs, are found by a
join and drawn anew, so that different items stay different.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

FIELDS = ("symptoms", "associated_symptoms", "relevant_context")
TYPES = ("name", "email", "phone", "id_number", "address")

_fold_map = {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)} | {0xFF10 + i: str(i) for i in range(10)}
_fold_map |= {0xFF20: "@", 0xFE6B: "@", 0xFF0E: ".", 0xFF0B: "+", 0xFF0D: "-", 0xFF08: "(", 0xFF09: ")", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0xA0: " ", 0x202F: " ", 0x2009: " ", 0x2019: "'"}


def folded(text: str) -> str:
    return text.translate(_fold_map)


_user = r"[^\W_][\w.+\-]*"
_at = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|arroba)\s?[)\]}]\s?|\s(?:at|arroba)\s)"
_dot = r"(?:\.|\s?[(\[{]\s?(?:dot|punto)\s?[)\]}]\s?|\s(?:dot|punto)\s)"
_email = re.compile(rf"(?<![\w.+\-])({_user}){_at}([^\W_][\w\-]*(?:{_dot}[^\W_][\w\-]*)+)", re.I)
_unit = r"(?:(?:flat|apt|apartment|unit|suite|room|piso)\.?\s?\d+[a-z]?,?\s)?"
_kind = r"(?:street|st|avenue|ave|lane|ln|road|rd|crescent|cres|close|terrace|ter|drive|dr|court|ct|place|pl|way|square|sq|hill|row|gardens|grove|walk|parade|boulevard|blvd|mews|quay)"
_town = r"(?:,\s(?!until\b|please\b)[^\W\d_]+(?:\s[^\W\d_]+)?(?=[\s.,;]|$))?"
_post = r"(?:,?\s[a-z]{1,2}\d{1,2}[a-z]?\s\d[a-z]{2}\b)?"
_address = re.compile(
    rf"(?<![\w/.\-])(?:{_unit}\d{{1,5}}[a-z]?,?\s(?:[^\W\d_]+(?:['\-][^\W\d_]+)?\s){{1,3}}{_kind}\b\.?(?:,\s[^\W\d_]+)?{_post}"
    rf"|p\.?\s?o\.?\s?box\s\d+(?:,\s[^\W\d_]+)?{_post}"
    r"|(?:calle|avenida|avda\.?|av\.|plaza|camino|paseo|carretera|ronda)\s(?:de(?:l|\slas?|\slos)?\s)?[^\W\d_]+(?:\s[^\W\d_]+){0,3},?\s(?:n\.?º?\s?)?\d+[a-z]?"
    r"|apartado(?:\sde\scorreos)?\s\d+(?:,\s[^\W\d_]+)?"
    r"|\d{1,5}\s(?:شارع|حي|طريق)\s[^\W\d_]+|(?:شارع|حي|طريق|ميدان)\s[^\W\d_]+(?:\s[^\W\d_]+)?\s(?:رقم|مبنى|عمارة|بناية|منزل)\s\d+|(?:ص\.?\s?ب\.?|صندوق\s(?:ال)?بريد)\s?\d+)",
    re.I,
)
_id_cue = re.compile(
    r"(?:\bnational id(?:entity)?(?: (?:card|number|no\.?))?|\bid(?: (?:card|number|no\.?))?(?=[\s:])|\bssn\b|\bsocial security(?: (?:number|no\.?))?|\bpassport(?: (?:number|no\.?))?|\bhealth (?:card|insurance)(?: (?:number|no\.?))?|\binsurance (?:member|number|no\.?|card)(?: (?:number|no\.?|id))?|\bnhs(?: (?:number|no\.?))?"
    r"|\bdni\b|\bnie\b|\bpasaporte\b|\bseguridad social\b|\btarjeta sanitaria\b|\bn\.?º de (?:afiliado|asegurado)\b|\bafiliado\b|\bnúmero de (?:afiliado|identidad)\b|الرقم القومي|رقم الهوية|الهوية|جواز السفر|جواز|رقم التأمين|التأمين)\s*(?:is|es|هو|:|n\.?º|no\.?|number|#)?\s*:?\s*",
    re.I,
)
_id_value = re.compile(r"[a-z]{0,3}[ \-]?\d(?:[ .\-]?\d){3,13}(?:[ \-]?[a-z](?![^\W_]))?(?!\w)|[a-z]{2,4}-\d{3,5}-\d{3,6}", re.I)
_id_shape = re.compile(r"(?<![\w\-/])(?:[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d]|INS-\d{4}-\d{5}|[xyz]\d{7,8}[a-z]?|[a-z]{2}\d{7}|\d{3}-\d{2}-\d{4})(?![\w\-/])", re.I)
_phone = re.compile(
    r"(?<![\w/.\-+])(?:\+1[ .\-]\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|\+\d{1,3} ?\(\d{1,4}\) ?\d{1,4}[ .\-/]{1,3}\d{4,8}|\+\d{8,15}|\+\d{1,3}(?:[ .\-]\d{2,4}){3}(?![ .\-]?\d)|\+\d{1,3}(?:[ .\-/]\d{1,8}){1,3}|00[1-9]\d{7,13}|\(\d{2,5}\)\s?\d{3,4}[\-.\s]?\d{3,4}|\d{3}[\-.\s]\d{3}[\-.\s]\d{4}|0\d{4}\s\d{6}|0\d{3}\s\d{3}\s\d{3,4}|0\d{9,10}|\d{3}[\-.]\d{4})(?:,?\s?(?:ext\.?|extn\.?|x|int\.?|تحويلة)\s?\d{1,5})?(?![\w/]|[\-.]\d)",
    re.I,
)
_masked = re.compile(r"\[[A-Za-z_]{4,}(?: [A-Za-z_]+)*\]|<[A-Z_]{4,}>", re.I)

_tok = r"[^\W\d_]+(?:['\-][^\W\d_]+)*"
_token = re.compile(rf"{_tok}")
_digit = re.compile(r"\d")
_particles = set("van von bin bint ibn abu al el de del der den la da dos di ter ben ten zu le بن بنت أبو ابو آل عبد".split())
_before = re.compile(
    r"(?:\bmy name is|\bi'm|\bi am|\bthis is|\bcalled|\bpatient name:|\bpatient:|\bname:|\bsigned,|\bask for|\basked for|\b(?:dr|mr|mrs|ms|miss|prof|sister|nurse|doctor)\.?(?=\s)|\bmy (?:daughter|son|wife|husband|mother|father|sister|brother|carer|partner|neighbour|friend)(?: is called| is named| is|,)?(?=\s)|\b(?:husband|wife|daughter|son|mother|father|brother|sister)\s\(|\bregards,|\byours,|\bcare of|\bc/o"
    r"|\bme llamo|\bmi nombre es|\bsoy|\bpaciente:|\bnombre:|\bfirmado:?,?|\bpregunten por|\b(?:el|la) doctora?\b|\b(?:dr|dra|sr|sra|srta)\.(?=\s)|\bmi (?:hija|hijo|esposa|esposo|marido|mujer|madre|padre|hermana|hermano|vecina|vecino|cuidadora|cuidador)(?: se llama|,)?(?=\s)|\bla señora|\bel señor|\b(?:marido|esposa|esposo|mujer|hija|hijo)\s\("
    r"|اسمي|أنا|الدكتورة|الدكتور|السيدة|السيد|ابنتي|ابني|زوجتي|زوجي|والدتي|والدي|أخي|أختي|جارتي|جاري|المريضة:|المريض:|الاسم:|اسأل عن|اسألوا عن|التوقيع:?|مقدم الرعاية)\s*",
    re.I,
)
_after = re.compile(r"\s*(?:said\b|says\b|noticed\b|told me\b|wrote\b|called me\b|saw me\b|brings me\b|takes me\b|dijo\b|lo notó\b|me vio\b|me acompaña\b|لاحظ|لاحظت|قال|قالت)", re.I)
_not_after = re.compile(r"(?:'s\s+(?:\w+\s+)?(?:disease|syndrome|palsy|sign|test|stone|rash|cyst|tremor|phenomenon|tear|\w+itis)|\s+(?:ward|unit|wing|general hospital|hospital|clinic|pharmacist|pharmacy|centre|center|street|road|lane|avenue|disease|syndrome)\b)", re.I)
_right = re.compile(r"\s*(?:[.)\n]|$|  |,? ?(?:born|said|says|noticed|brings|takes|saw me|at the desk|from next|had the|writing|dijo|lo notó|me vio|me acompaña|y escribo|en recepción|وأكتب|ترافقني|يرافقني|فحصني|لاحظ|قال))", re.I)
_not_before = re.compile(r"(?:\bat|\bin|\bto|\bfrom|\bon|\ben|\bby|\bof|\bthe|\btakes|\btomo|\bother|\bapart from|قسم|مستشفى|دواء)\s*$", re.I)
#: Parts one of which every match of _before has, and those of _after; looked for first, in one pass.
_BEFORE_PARTS = (
    "name is", "i'm", "i am", "this is", "called", "patient", "name:", "signed,", "ask for", "asked for", "dr", "mr", "ms", "miss", "prof", "sister", "nurse", "doctor", "my ", "husband", "wife", "daughter", "son", "mother", "father", "brother", "regards,", "yours,", "care of", "c/o", "me llamo", "mi ", "soy", "paciente", "nombre", "firmado", "pregunten por",
    "sr", "la señora", "el señor", "marido", "esposa", "esposo", "mujer", "hija", "hijo", "اسمي", "أنا", "الدكتور", "السيد", "ابنتي", "ابني", "زوجتي", "زوجي", "والدتي", "والدي", "أخي", "أختي", "جارتي", "جاري", "المريض", "الاسم:", "اسأل", "التوقيع", "مقدم الرعاية",
)
_AFTER_PARTS = ("said", "says", "noticed", "told me", "wrote", "called me", "saw me", "brings me", "takes me", "dijo", "lo notó", "me vio", "me acompaña", "لاحظ", "قال")
_cues = ahocorasick.Automaton()
for _group, _list in ((1, _BEFORE_PARTS), (2, _AFTER_PARTS)):
    for _p in _list:
        _cues.add_word(_p, _group | _cues.get(_p, 0))
_cues.make_automaton()
_initial = re.compile(r"(?<![^\W\d_])[^\W\d_]\. ")
#: Words that begin or end sentences about other things and are never part of a name.
_ordinary = set(
    "my our the a an and or is was were he she it i i'm we you they this that who with for from at on in to of by not no since until after before when please thanks call tel mobile text ring whatsapp reach mail email results passport ssn id health insurance social national dr mr mrs ms signed patient ask husband wife home moved delivery send staying lives live age called named takes seen told smokes "
    "mi me soy el la los las y con por para desde llame móvil escriban vivo tomo edad alergia ingreso tensión correo resultados paciente pasaporte dirección tel embarazo teléfono su يوم منذ في من على إلى مع هاتف جوالي بريدي رقم العنوان أسكن اتصلوا راسلوني أرسلوا جواز الرقم العمر حامل دخلت لا الضغط مرض أتناول عندي وأكتب فحصني فحصتني ترافقني يرافقني عن".split()
)


@dataclass(frozen=True)
class Lexicon:
    names: frozenset[str]
    ordinary: frozenset[str]


_blank = re.compile(r"\s*\Z")


def _blank_from(text: str, at: int) -> bool:
    return _blank.match(text, at) is not None


def _flat(text: str) -> bool:
    """Whether the letters of a text don't differ in case."""
    letters = [c for c in text if c.isalpha()]
    return bool(letters) and (sum(c.isupper() for c in letters) in (0, len(letters)) or not any(c.isupper() or c.islower() for c in letters))


def _token_before(text: str, end: int) -> tuple[int, str] | None:
    """(start, token) of the name's token that ends at `end` after white space, a bracket or nothing."""
    at = end
    while at and (text[at - 1].isalpha() or text[at - 1] in "'-"):
        at -= 1
    m = _token.match(text, at, end) if at < end and (not at or text[at - 1].isspace() or text[at - 1] == "(") else None
    return (at, m.group(0)) if m and m.end() == end else None


def _name_tokens(text: str, at: int, lex: Lexicon, cued: bool, flatness: list[bool]) -> int:
    """End of the name that begins at `at`, or `at` if none does; flatness keeps what _flat says of the text, once that is asked."""
    if not flatness:
        flatness.append(_flat(text))
    flat = flatness[0]
    end, pos, words, commas = at, at, 0, 0
    while words < 5:
        m = _token.match(text, pos)
        if not m:
            break
        word = m.group(0)
        low = word.lower()
        stop = m.end()
        known = low in lex.names or any(p in lex.names for p in low.split("-"))
        rest = text[stop : stop + 2]
        closed = _blank_from(text, stop) or text[stop : stop + 1] in ".,;)\n:" or text[stop : stop + 2] == "  "
        if len(word) == 1 and text[stop : stop + 1] == "." and (not word.islower() or flat and (words or cued)):
            stop += 1
        elif low.split("-")[0] in _particles and "-" in low and words:
            pass
        elif low in _particles and words:
            nxt = _token.match(text, stop + 1) if rest[:1] == " " else None
            if not nxt or nxt.group(0).lower() in _ordinary:
                break
            pos = stop + 1
            continue
        elif low in _ordinary and not known:
            break
        elif low in lex.ordinary or low in _ordinary:
            # An ordinary word that is also a name: where one may begin, or where the name ends.
            if not known or not (closed or words == 0 and cued and word[:1].isupper()):
                break
        elif known:
            pass
        elif not cued or not (word[:1].isupper() or flat or not word.isascii() and not word[:1].islower()):
            break
        elif words and not (word[:1].isupper() or closed or _after.match(text, stop)) and not known and flat and text.isascii():
            break
        end = stop
        words += 1
        if text[stop : stop + 1] == " " and text[stop + 1 : stop + 2] != " ":
            pos = stop + 1
        elif text[stop : stop + 2] == ", " and not commas and words == 1:
            nxt = _token.match(text, stop + 2)
            second = nxt.group(0).lower() if nxt else ""
            if not nxt or second in _ordinary or second in lex.ordinary or not (second in lex.names or (nxt.group(0)[:1].isupper() or flat) and _right.match(text, nxt.end())):
                break
            commas += 1
            pos = stop + 2
        else:
            break
    return end


def find(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal items, in order and apart."""
    if not text:
        return []
    t = folded(text)
    taken: list[tuple[int, int, str]] = []
    blocked = [(m.start(), m.end()) for m in _masked.finditer(t)] if "[" in t or "<" in t else []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, *_ in taken) and all(b <= x or a >= y for x, y in blocked)

    def take(a: int, b: int, kind: str) -> None:
        if free(a, b):
            taken.append((a, b, kind))

    low_text = t.lower()
    if "@" in t or " at " in low_text or "(at" in low_text or "[at" in low_text or "{at" in low_text or "( at" in low_text or "[ at" in low_text or "{ at" in low_text or "arroba" in low_text:
        for m in _email.finditer(t):
            if not m.group(1).isdigit() and re.search(r"[^\W\d_]", m.group(2)):
                take(m.start(), m.end(), "email")
    if _digit.search(t):
        for m in _address.finditer(t):
            take(m.start(), m.end(), "address")
        for m in _id_cue.finditer(t):
            v = _id_value.match(t, m.end())
            if v and sum(c.isdigit() for c in v.group(0)) >= 5:
                a = v.start() + (len(v.group(0)) - len(v.group(0).lstrip()))
                take(a, v.end(), "id_number")
        for m in _id_shape.finditer(t):
            take(m.start(), m.end(), "id_number")
        for m in _phone.finditer(t):
            digits = sum(c.isdigit() for c in m.group(0))
            if 7 <= digits <= 20:
                take(m.start(), m.end(), "phone")
    cues = 0
    for _, group in _cues.iter(low_text):
        cues |= group
    flat: list[bool] = []
    for m in _before.finditer(t) if cues & 1 else ():
        a = m.end()
        b = _name_tokens(t, a, lex, True, flat)
        if b > a and not t.startswith("'s ", b):
            word = m.group(0).strip().lower()
            loose = word in ("i'm", "i am", "this is", "called", "soy", "أنا")
            first = _token.match(t, a).group(0).lower() if _token.match(t, a) else ""
            sure = first in lex.names or t[b : b + 6].lower().startswith((", born", " writ", " y esc", " وأكت")) or not loose or t[a].isupper() and b < len(t) and t[b] in ",.;"
            if sure:
                take(a, b, "name")
    seen = set(_token.findall(low_text))
    listed = not lex.names.isdisjoint(seen) or any("-" in x and not lex.names.isdisjoint(x.split("-")) for x in seen)
    for m in _token.finditer(t) if listed or cues & 2 or _initial.search(t) else ():  # names without a word before: known ones, followed by a verb or by another name
        if m.group(0).lower() not in lex.names and not any(p in lex.names for p in m.group(0).lower().split("-")) and not (m.group(0)[:1].isupper() and _after.match(t, m.end())):
            if not (len(m.group(0)) == 1 and t[m.end() : m.end() + 2] == ". " and m.group(0).isupper()):
                continue
        a = m.start()
        if not free(a, m.end()) or a and (t[a - 1].isalnum() or t[a - 1] in "-'@_."):
            continue
        said = None
        b = _name_tokens(t, a, lex, False, flat)
        if b == a and (m.group(0)[:1].isupper() or m.group(0).lower() in lex.names) and _after.match(t, m.end()):
            b = m.end()
        wide = _name_tokens(t, a, lex, True, flat)
        if wide > b and _after.match(t, wide):
            b = wide
        if b > a:
            said = _after.match(t, b)
        if b == a or _not_after.match(t, b):
            continue
        parts = [p.lower() for p in _token.findall(t[a:b])]
        several = sum(p in lex.names or any(q in lex.names for q in p.split("-")) for p in parts) >= 2 and not all(p in lex.ordinary for p in parts)
        while said and t[a - 1 : a] == " " and (front := _token_before(t, a - 1)) and front[1][:1].isupper() and (low := front[1].lower()) not in lex.ordinary and low not in _ordinary and free(front[0], a):
            a = front[0]
            parts.insert(0, low)
        back = _token_before(t, a - 2) if said and a > 1 and t[a - 2 : a] == ", " else None
        if back and back[1][:1].isupper() and len(parts) == 1:  # family name first
            low = back[1].lower()
            if low not in lex.ordinary and low not in _ordinary and free(back[0], a):
                a = back[0]
        if (said and (parts[0] not in lex.ordinary or len(parts) > 1 or parts[0] in lex.names)) or (several and not _not_before.search(t[:a].rstrip()[-24:]) and (t[a].isupper() or not t[a].isascii() or t.islower())):
            take(a, b, "name")
    return sorted(taken)


def _texts(row: tuple) -> list[tuple[str, int, str]]:
    out = []
    for field, value in zip(FIELDS, row):
        if value is None:
            continue
        if isinstance(value, str):
            out.append((field, 0, value))
        else:
            out += [(field, i, x) for i, x in enumerate(value) if x is not None]
    return out


def _rows(batch: pa.RecordBatch, first: int):
    return zip(*(batch.column(first + i).to_pylist() for i in range(len(FIELDS))))


#: Names of a list at most.
LARGEST_LIST = 1_000_000


def learn(df: DataFrame, names: DataFrame, share: float = 0.0015, least: int = 8) -> Lexicon:
    """The list of names and the words of more than `share` of the texts, which are at most a text's words over that share."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

        for batch in batches:
            for row in _rows(batch, 0):
                for _, _, text in _texts(row):
                    held[""] += 1
                    held.update({w.lower() for w in _token.findall(folded(text))})
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    counts = materialize(df.select(*FIELDS).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    total = sum(r["n"] for r in counts.where("w = ''").collect())
    common = {r["w"] for r in counts.where((F.col("n") >= max(least, share * total)) & (F.col("w") != "")).collect()}
    if names.count() > LARGEST_LIST:
        raise ValueError(f"a list of more than {LARGEST_LIST} names is no list to be sent to the tasks")
    listed = {folded(r[0]).strip().lower() for r in names.select("name_text").where("name_text is not null").collect()}
    return Lexicon(frozenset(n for n in listed if n), frozenset(common))


def _found(df: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    schema = f"`{key}` bigint, field_name string, item_no int, start_pos int, end_pos int, pii_type string, item string"

    def make():
        lex = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [], [], [], [], [], [], []
            for k, row in zip(batch.column(0).to_pylist(), _rows(batch, 1)):
                for field, no, text in _texts(row):
                    for a, b, kind in find(text, lex):
                        for to, x in zip(out, (k, field, no, a, b, kind, text[a:b])):
                            to.append(x)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=[key, "field_name", "item_no", "start_pos", "end_pos", "pii_type", "item"])

        return step

    return map_batches(df.select(df[key].cast("long"), *FIELDS), schema, make)


def found(df: DataFrame, names: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, field_name, item_no, start_pos, pii_type) of each personal item; repeated rows of a record count once.

    item_no counts null items; null and empty texts and null arrays hold none. Extra columns are ignored. Positions
    count code points.
    """
    return _found(df, learn(df, names), key).select(key, "field_name", "item_no", "start_pos", "pii_type").distinct()


def _replaced(df: DataFrame, lexicon: Lexicon, put) -> DataFrame:
    """df with the three fields rewritten by put(item, type) and n_items; every row comes back."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    rest = [c for c in df.columns if c not in FIELDS and c != "n_items"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def make():
        lex = shared.value

        def rewrite(text: str | None) -> tuple[str | None, int]:
            if not text:
                return text, 0
            out, at, items = [], 0, find(text, lex)
            for a, b, kind in items:
                out += [text[at:a], put(text[a:b], kind)]
                at = b
            return "".join(out) + text[at:], len(items)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns, n = [[], [], []], []
            for row in _rows(batch, len(rest)):
                total = 0
                for to, value in zip(columns, row):
                    if isinstance(value, list):
                        done = [rewrite(x) for x in value]
                        to.append([x for x, _ in done])
                        total += sum(k for _, k in done)
                    else:
                        x, k = rewrite(value)
                        to.append(x)
                        total += k
                n.append(total)
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(n, pa.int32())], names=[*rest, *FIELDS, "n_items"])

        return step

    source = df.select(*rest, *FIELDS)
    return map_batches(source, schema + ", symptoms array<string>, associated_symptoms array<string>, relevant_context string, n_items int", make)


def masked(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with [NAME], [EMAIL], [PHONE], [ID_NUMBER] and [ADDRESS] for the items; all else as it was. Nulls stay null."""
    return _replaced(df, learn(df, names), lambda item, kind: f"[{kind.upper()}]")


# Surrogates ---------------------------------------------------------------------------------------------------------

_onsets = "b br d dr f g gr h j k kl l m n p pr r s st t tr v w".split()
_vowels = "a e i o u".split()
_codas = ["n", "l", "r", "s", "th", "nd", "m", "x"]
_arabic = "بتجدرزسشطعفقكلمنهوي"
#: Attempts that keep the exact format; each later one has a sign more than the one before, so that any number of items finds room.
EXACT = 4
_streets = "Alderfield Bramhope Corley Dunmere Eastby Fernhill Gladewater Hazelbeck Ivyside Juniper Kingsmead Larkrise Millbrook Northgate Oakhurst Priory".split()


def same_item(item: str, kind: str) -> str:
    """The form in which two spellings are one item: digits for numbers, letters for the rest."""
    t = folded(item).lower()
    if kind == "phone":
        return re.sub(r"\D", "", re.split(r"ext|x|int|تحويلة", t)[0])
    if kind == "id_number":
        return re.sub(r"[^0-9a-z]", "", t)
    if kind == "email":
        t = re.sub(r"\s*[(\[{]?\b(?:at|arroba)\b[)\]}]?\s*", "@", t) if "@" not in t else t
        return re.sub(r"\s*[(\[{]?\b(?:dot|punto)\b[)\]}]?\s*", ".", t).replace(" ", "")
    if kind == "name":
        family, comma, given = t.partition(", ")
        return " ".join((f"{given} {family}" if comma else t).split())
    return " ".join(t.replace(",", " ").split())


class _Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, *what: str):
        self.state = hmac.new(key, "\x1f".join(what).encode(), hashlib.sha256).digest()
        self.at = 0

    def below(self, n: int) -> int:
        if self.at + 4 > len(self.state):
            self.state, self.at = hashlib.sha256(self.state).digest(), 0
        x = int.from_bytes(self.state[self.at : self.at + 4], "big")
        self.at += 4
        return x % n

    def pick(self, xs):
        return xs[self.below(len(xs))]


def _word(draw: _Draw, like: str, feminine: bool | None = None) -> str:
    if not like.isascii() and any("؀" <= c <= "ۿ" for c in like):
        word = "".join(draw.pick(_arabic) for _ in range(max(4, min(7, len(like)))))
        return word + ("ة" if feminine else "")
    word = "".join(draw.pick(_onsets) + draw.pick(_vowels) for _ in range(2)) + draw.pick(_onsets) + draw.pick(["a", "ia"] if feminine else ["o", "en", "or"] if feminine is False else ["e", "ey", "in"])
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def surrogate(item: str, kind: str, entity: str, key: bytes, attempt: int = 0, families: frozenset[str] = frozenset()) -> str:
    """An invented item of the same type, script and format; the same for all spellings of one entity.

    From attempt `EXACT` on it is longer than its format: digits more in its number, syllables more in a name.
    """
    draw = _Draw(key, kind, entity, str(attempt))
    more = max(0, attempt - EXACT + 1)
    if kind in ("phone", "id_number"):
        canon = same_item(item, kind)
        swap = iter([(draw.pick("0123456789") if c.isdigit() else c.upper() if c.isupper() else c) for c in canon])
        keep = 0
        out = []
        lead = len(canon) - 7 if kind == "phone" else 0  # the country and area code say where, not who
        seen, zero = 0, ord("0")
        for c, f in zip(item, folded(item)):
            if f.isdigit() and seen < len(canon) or kind == "id_number" and f.isalnum() and seen < len(canon):
                new = next(swap)
                seen += 1
                if not f.isdigit() or seen <= lead:
                    out.append(c)
                else:
                    zero = ord(c) - int(f)
                    out.append(chr(zero + int(new)) if new.isdigit() else c)
                if seen == len(canon):
                    out += [chr(zero + draw.below(10)) for _ in range(more)]
            else:
                out.append(c)
        del keep
        return "".join(out)
    if kind == "email":
        parts = re.match(_email, folded(item))
        user = parts.group(1) if parts else item
        new = re.sub(r"[^\W\d_]+", lambda m: _word(draw, m.group(0)), user)
        new = re.sub(r"\d", lambda m: draw.pick("0123456789"), new)
        new += "".join(draw.pick("0123456789") for _ in range(more))
        return new + item[len(user) :] if parts else new
    if kind == "address":
        out = re.sub(r"\d", lambda m: draw.pick("123456789"), folded(item))
        words = [m for m in _token.finditer(out)]
        plain = [m for m in words if not re.fullmatch(rf"{_kind}|flat|apt|unit|box|p|o|calle|avenida|plaza|camino|paseo|de|del|la|las|los|شارع|حي|طريق|ميدان|رقم|مبنى|عمارة|بناية|منزل|[a-z]{{1,3}}", m.group(0), re.I)]
        for m in reversed(plain):
            w = m.group(0)
            new = _word(draw, w) if not w.isascii() else draw.pick(_streets) if not attempt and w[:1].isupper() and not w.isupper() else _word(draw, w)
            out = out[: m.start()] + new + out[m.end() :]
        if more:
            extra = "".join(draw.pick("123456789") for _ in range(more))
            number = re.search(r"\d+", out)
            out = out[: number.end()] + extra + out[number.end() :] if number else f"{out} {extra}"
        return out
    # Tokens of a name are drawn by token, in the order of given and family name, so that both orders agree.
    tokens = list(_token.finditer(item))
    order = entity.split()
    new_of: dict[str, str] = {}
    for word in order:
        if word.strip(".") in _particles:
            continue
        # Drawn by the token alone, so that a given or family name by itself is that of the full name.
        feminine = True if word[-1:] in "aةى" and len(word) > 1 else None
        new_of.setdefault(word.strip("."), _word(_Draw(key, kind, word.strip("."), str(attempt)), "Xx" if word.isascii() or not any("؀" <= c <= "ۿ" for c in word) else word, feminine))
    longest, grown = max(new_of, key=len, default=""), False
    if more and longest:
        new_of[longest] += "".join(draw.pick(_arabic) if "؀" <= longest[0] <= "ۿ" else draw.pick(_onsets) + draw.pick(_vowels) for _ in range(more))
    out = item
    for m in reversed(tokens):
        low = folded(m.group(0)).lower()
        new = new_of.get(low)
        if new is None:
            continue
        grown = grown or low == longest
        if len(low) == 1:
            new = new[: 1 + more * (low == longest)]
        w = m.group(0)
        new = new.upper() if w.isupper() and len(w) > 1 else new.lower() if w.islower() and w.isascii() else new
        out = out[: m.start()] + new + out[m.end() :]
    if more and not grown:  # no word of it is free to grow
        out += " " + "".join(_word(draw, item) for _ in range(more))
    return out


def surrogate_table(items: DataFrame, key: str) -> DataFrame:
    """(pii_type, entity, attempt): for each different item the draw whose surrogate is no other's and no real item's, in any of its spellings.

    A round draws for the items that are still open; of those that meet, the first by name keeps its draw, and what is
    settled stays. Rounds end when none is open: surrogates get longer with the attempts, so room never runs out.
    """
    secret = key.encode()
    entity = F.udf(same_item, "string", useArrow=True)
    spelt = materialize(items.select("pii_type", entity("item", "pii_type").alias("entity"), "item").distinct(), "entities")
    real = materialize(spelt.select("pii_type", F.col("entity").alias("new")).distinct(), "real")

    def draw(kind: str, ent: str, item: str, attempt: int) -> str:
        return same_item(surrogate(item, kind, ent, secret, attempt), kind)

    drawn = F.udf(draw, "string", useArrow=True)
    taken, open_, settled, attempt = real, spelt, None, 0
    while True:
        named = materialize(open_.withColumn("new", drawn("pii_type", "entity", "item", F.lit(attempt))), "draws")
        first = named.groupBy("pii_type", "new").agg(F.min("entity").alias("keeps"))
        held = taken.withColumn("held", F.lit(True))
        judged = named.join(first, ["pii_type", "new"]).join(held, ["pii_type", "new"], "left")
        again = F.max(F.coalesce("held", F.lit(False)) | (F.col("keeps") != F.col("entity")))
        state = materialize(judged.groupBy("pii_type", "entity").agg(again.alias("again")), "judged")
        fixed = state.where("not again").select("pii_type", "entity")
        done = fixed.withColumn("attempt", F.lit(attempt))
        settled = done if settled is None else settled.unionByName(done)
        lost = state.where("again").select("pii_type", "entity")
        if lost.isEmpty():
            return settled
        taken = taken.unionByName(materialize(named.join(fixed, ["pii_type", "entity"], "left_semi").select("pii_type", "new").distinct(), "taken"))
        open_ = materialize(open_.join(lost, ["pii_type", "entity"], "left_semi"), "open")
        attempt += 1


def surrogates(df: DataFrame, names: DataFrame, key: str = "record_id", secret: str = "quarryline") -> DataFrame:
    """(key, field_name, item_no, start_pos, pii_type, surrogate) of each item: what stands in its place if texts are to stay natural.

    Two spellings of an item get surrogates of one entity, each in its own spelling; different items get different
    ones, and none equals an item of its type that occurs. Without the secret they can't be drawn again.
    """
    items = materialize(_found(df, learn(df, names), key).distinct(), "items")
    drawn = surrogate_table(items, secret)
    entity = F.udf(same_item, "string", useArrow=True)
    data = secret.encode()
    final = F.udf(lambda item, kind, ent, attempt: surrogate(item, kind, ent, data, attempt), "string", useArrow=True)
    joined = items.withColumn("entity", entity("item", "pii_type")).join(drawn, ["pii_type", "entity"])
    return joined.select(key, "field_name", "item_no", "start_pos", "pii_type", final("item", "pii_type", "entity", "attempt").alias("surrogate"))
