"""Problem 9: template residue, filler and error pages.

Records of one template share their fixed words and differ in its slots. A
segment (a sentence or a line) in which something stands between marks, or a
technical empty value, gives a frame: the six words before it, fewer near the
segment's beginning, and the next word after it. Frames are aligned with every
place in the segments of all other records that has the same words before it:
where those have other values at that place, the frame is a slot. What slots
hold between marks are names of variables, which tell slots in ambiguous marks
([x], <x>, ...) from brackets of the text; an empty value is residue in a slot
and an ordinary word elsewhere.

Error pages are whole-page templates: segments that several different texts
have and that, where they occur, mostly make up the page. No list of words is
needed for them where they repeat; one (`_NOTICE`) helps with rare ones. Filler
is known by fixed sentences and by the words that stand around them.

Each text is read twice. The first reading writes down its segments as hashes,
its frames and its marks; the second counts how other records fill the frames.
All that is decided over the corpus is decided by aggregations and joins on
these hashes; nothing is collected but the words of filler, of which there are
at most those of a segment over `FILLER_SHARE`.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

_digits = re.compile(r"\d+")
_space = re.compile(r"\s+")
#: Slot syntaxes that are nothing else.
_SURE = [
    r"\{\{[#/^&>]?\s*(?:if\s+|each\s+|unless\s+)?([^{}\n]{1,60}?)\s*\}\}",
    r"\{%-?\s*\w+\s+['\"]?([^%\n]{1,60}?)['\"]?\s*-?%\}",
    r"<%[=-]?\s*([^%\n]{1,60}?)\s*-?%>",
    r"\$\{\s*([^{}\n]{1,60}?)\s*\}",
    r"\$\[\s*([^\[\]\n]{1,60}?)\s*\]",
    r"(?<!%)%%([^%\n]{1,60}?)%%(?!%)",
    r"@@([^@\n]{1,60}?)@@",
    r"(?<![#\w])##([^#\s][^#\n]{0,60}?)##(?!#)",
    r"\*\|([^|\n]{1,60}?)\|\*",
    r"%\(([^()\n]{1,60}?)\)[sdif]\b",
    r"(?<!\[)\[\[([^\[\]\n]{1,60}?)\]\](?!\])",
    r"(?<!\w)__([^\W_][\w .]{0,60}?)__(?!\w)",
]
#: Brackets that may be a slot, depending on what they hold.
_MAYBE = [
    r"«\s*([^«»\n]{1,60}?)\s*»",
    r"<<\s*([^<>\n]{1,60}?)\s*>>",
    r"(?<!<)<\s*([^<>%/=\n]{1,60}?)\s*>(?!>)",
    r"&lt;\s*([^&<>\n]{1,60}?)\s*&gt;",
    r"(?<!\[)(?<!\$)\[\s*([^\[\]\n]{1,60}?)\s*\](?!\])",
    r"(?<![{$])\{\s*([^{}%\n]{1,60}?)\s*\}(?!\})",
    r"\(\s*((?:insert|enter|your)\b[^()\n]{1,60}?)\s*\)",
    r"(?<![%\w])%([^\W\d_][\w .]{1,40}?)%(?![%\w])",
]
_sure = re.compile("|".join(_SURE))
_maybe = re.compile("|".join(_MAYBE))
_any_mark = re.compile(r"[{}\[\]<>%$@#*_«»|]|&lt;|\((?:insert|enter|your)", re.I)
_asked = re.compile(r"^(?:insert|enter|your|add|type|put)\s+|\s+here$", re.I)
_snake = re.compile(r"^[^\W\d]\w*[_.][\w.]*$")
_tags = set("a b i u p br hr em li ol ul td th tr h1 h2 h3 h4 h5 h6 div img pre sub sup span code html head body link meta table thead tbody strong small script style title form input".split())

#: Values that only a program writes where a value is missing.
_broken = re.compile(
    r"(?i:\[object \w+\]|\bInvalid Date\b|\$(?:NaN|undefined|null)\b|\bNaN\b(?=\s*(?:mg|ml|%|kg|€|\$))|\bN/A_\w+)|#(?:REF|NAME|VALUE|N/A|DIV/0|NULL|NUM)[!?]?(?!\w)|\bX{4,}\b|(?<![!?])(?:: *)\?{4,}|\{\d\}|\b(?:MISSING|EMPTY)_[A-Z_]+\b|\bTODO\b[:\s](?!o\b)",
)
#: Words that are an empty value in a slot and an ordinary word elsewhere.
_empty = re.compile(r"(?<![\w.-])(?:\(none\)|\(null\)|\(empty\)|\(blank\)|undefined|null|none|nan|nil|n/a|tbc|tbd|todo|fixme|xxx|unknown_\w+|placeholder|untitled)(?![\w-])", re.I)
#: A greeting whose name is blank, or two blanks in a row.
_blank = re.compile(r"(?:^|[\n.!?؟]\s*)(?:hello|hi|dear|guten tag|hallo|liebe[r]?|hola|estimad[oa]|querid[oa]|bonjour|cher|chère|عزيزي|مرحبا)\s+[,،]|\bon\s{2,}at\s*[.,]|\bat\s+\.(?:\s|$)|:\s*_{4,}|\bby\s{2,}on\b", re.I)

#: Text that only fills a layout.
_filler = re.compile(
    r"lorem\s+ipsum|dolor\s+sit\s+amet|\b(?:placeholder|dummy|sample|filler)\s+(?:copy|text|paragraph|headline|heading|content)\b(?!\s+(?:was|were|is used))|\b(?:text|heading|title|headline|caption|copy|content)\b[^.\n]{0,30}\bgoes here\b|\bto be supplied\b|\breplace (?:it|this|me) before\b|\blines? about [^.\n]{1,40} here\b|\b(?:text|copy|content) to follow\b"
    r"|\bblindtext\b|\bplatzhaltertext\b|\btexte (?:provisoire|factice|d'exemple|à remplacer)|\bfaux texte\b|\btexto (?:de ejemplo|de relleno|provisional|simulado)|نص (?:تجريبي|مؤقت|بديل)|هذا النص هو مثال|\basdf\b|\bqwer(?:ty)?\b\s+\bqwer",
    re.I,
)
#: Parts of words without which a pattern can't match; they are looked for first, as that is much faster.
#: Parts of lower-cased text, parts of the text as it is, and beginnings with white space or digits in them, in lower-cased text.
_BROKEN_PARTS = ("[object ", "invalid date", "$nan", "$undefined", "$null", "n/a_"), ("#REF", "#NAME", "#VALUE", "#N/A", "#DIV/0", "#NULL", "#NUM", "XXXX", "????", "MISSING_", "EMPTY_", "TODO"), (r"\{\d\}", r"nan(?=\s*(?:mg|ml|%|kg|€|\$))")
_EMPTY_PARTS = ("(none)", "(null)", "(empty)", "(blank)", "undefined", "null", "none", "nan", "nil", "n/a", "tbc", "tbd", "todo", "fixme", "xxx", "unknown_", "placeholder", "untitled")
_FILLER_PARTS = (
    ("placeholder", "dummy", "filler", "goes here", "be supplied", "replace it before", "replace this before", "replace me before", "lines about", "line about", "to follow", "blindtext", "platzhalter", "texte prov", "texte fact", "texte d'ex", "texte à rem", "faux texte", "texto de ejemplo", "texto de relleno", "texto prov", "texto sim")
    + ("نص تجريبي", "نص مؤقت", "نص بديل", "هذا النص هو مثال", "asdf", "qwer"),
    (),
    (r"lorem\s", r"sit\s+amet", r"sample\s+(?:copy|text|para|head|cont)"),
)
_BLANK_PARTS = (), ("____",), (r"[,،.](?<=\s.)", r"at(?<=\s\sat)", r"on(?<=\s\son)")


def _lowered(text: str) -> str:
    """Lower case of the same length, in which all that a pattern takes for an s or i without regard to case is one."""
    low = text.lower()
    if text.isascii():
        return low
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c.lower()[0] for c in text)
    return low.replace("ſ", "s").replace("ı", "i")


def _places(text: str, parts: tuple[str, ...]):
    for part in parts:
        at = text.find(part)
        while at >= 0:
            yield at
            at = text.find(part, at + 1)


def _rule(pattern: re.Pattern, parts: tuple):
    """rule(text, low, hit): whether the pattern occurs; searched for in full only where one of its parts is. hit: whether one of those of lower-cased text is, if that is known."""
    folded, exact, begun = parts
    begun = [re.compile(x) for x in begun]

    def rule(text: str, low: str, hit: bool | None = None) -> bool:
        if hit is None:
            hit = any(x in low for x in folded)
        return (hit or any(x in text for x in exact) or any(x.search(low) for x in begun)) and pattern.search(text) is not None

    return rule


_is_broken, _is_blank, _is_filler = _rule(_broken, _BROKEN_PARTS), _rule(_blank, _BLANK_PARTS), _rule(_filler, _FILLER_PARTS)


def repeats(text: str) -> bool:
    """Whether one or two words of three letters or more stand three times in a row."""
    w = text.split()
    for i in [i for i, (a, c) in enumerate(zip(w, w[2:])) if a == c]:  # both begin so
        a, b = w[i], w[i + 1]
        if a == b and len(a) > 2 and a.isalpha():
            return True
        if w[i + 4 : i + 5] == [a] and w[i + 3] == b and w[i + 5 : i + 6] and w[i + 5].rstrip(".!") in (b, b.rstrip(".!")) and len(a) > 2 and len(b) > 2 and a.isalpha() and b.isalpha():
            return True
    return False

#: What notices served in place of a page speak of, anywhere in a word and as words of their own.
_NOTICE = (
    "javascript", "java script", "noscript", "scripting", "browser", "navigateur", "navegador", "متصفح", "جافا", "البرامج النصية", "erreur", "fehler", "خطأ", "not found", "not be found", "can't find", "cannot find", "introuvable", "no encontr", "nicht gefunden", "غير موجود", "denied", "forbidden", "permission", "accès refusé", "acceso denegado", "zugriff", "صلاحية",
    "session", "sesión", "sitzung", "الجلسة", "gateway", "unavailable", "indisponible", "no disponible", "nicht verfügbar", "غير متاح", "maintenance", "mantenimiento", "wartung", "صيانة", "timeout", "time-out", "time out", "timed out", "too many requests", "traceback", "exception", "undefined index", "undefined variable", "warning:", "fatal", "went wrong",
    "not load", "could not reach", "could not connect", "cannot start", "no longer valid", "moved or been deleted", "are human", "are a human", "captcha", "in your region", "out of date", "log in again", "sign in", "not available",
)
_NOTICE_WORDS = ("script", "scripts", "cookies", "error", "400", "401", "403", "404", "429", "500", "502", "503", "504")
_notice = re.compile("|".join(map(re.escape, _NOTICE)) + r"|\b(?:" + "|".join(_NOTICE_WORDS) + r")\b", re.I)
#: All parts that are looked for in lower-cased text, in one pass over it.
_NOTICED, _FILLS, _BREAKS, _EMPTIES = 1, 2, 4, 8
_parts = ahocorasick.Automaton()
for _group, _words_of in ((_NOTICED, _NOTICE + _NOTICE_WORDS), (_FILLS, _FILLER_PARTS[0]), (_BREAKS, _BROKEN_PARTS[0]), (_EMPTIES, _EMPTY_PARTS)):
    for _p in _words_of:
        _parts.add_word(_p, _group | _parts.get(_p, 0))
_parts.make_automaton()


def _groups(low: str) -> int:
    """The groups of which a part occurs."""
    found = 0
    for _, group in _parts.iter(low):
        found |= group
    return found


_token = re.compile(r"\S+")
_wordish = re.compile(r"[^\W_]")
_edges = ".,;:!?،؛()\"'"
#: Words that a frame may have before its slot, and words after it among which the frame's next word must be.
HEAD, REACH = 6, 7
#: Different texts that share a segment before it counts as a template's.
TEXTS = 5
#: Share of the segments with fixed filler sentences in which a word must stand to count as one of filler.
FILLER_SHARE = 0.01
_BLOOM_BITS = 1 << 23
#: What a head's hash is multiplied by before the next word's is added.
_FACTOR = 0x9E3779B97F4A7C15
#: Kinds of words: one that ends a sentence, one that a slot may hold in place of an empty value, one of filler.
_ENDS, _FITS, _IN_FILLER = 1, 2, 4
#: What tells a whole head from the pairs of a head and a next word in the bit set.
_WHOLE = 0x5BD1E995
_MARKS = "{}[]<>%$@#*_«»|("


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _longer(head: int, word: str) -> int:
    """The hash of some words and one more; 0 words have 0."""
    return (head * _FACTOR + _words[word]) & 0xFFFFFFFFFFFFFFFF


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Vocabulary(dict):
    """Numbers of words; what is to be known of a word is worked out once and stands in columns at its number."""

    def __init__(self, filler: frozenset[str]):
        self.filler = filler
        self.hashes, self.tails, self.kinds = array("Q"), array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        bare = word.strip(_edges)
        fits = not _any_mark.search(word) and not _empty.match(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.tails.append(xxhash.xxh3_64_intdigest(bare) if bare else 0)
        self.kinds.append(_ENDS * (word[-1] in ".!?؟") | _FITS * fits | _IN_FILLER * (bare in self.filler))
        n = self[word] = len(self)
        return n

    def columns(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, hash without the punctuation around it (0 if there is nothing else) and kinds of each word."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.hashes, np.uint64)[at], np.frombuffer(self.tails, np.uint64)[at], np.frombuffer(self.kinds, np.uint8)[at]


def _heads(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What `_longer` gives for the words before each word: `HEAD` of them, or as many as `before` says there are in its segment."""
    heads, factor = np.zeros(len(hashes), np.uint64), 1
    for i in range(1, min(HEAD, len(hashes) - 1) + 1):
        heads[i:] += np.where(before[i:] >= i, hashes[:-i] * np.uint64(factor), np.uint64(0))
        factor = factor * _FACTOR & 0xFFFFFFFFFFFFFFFF
    return heads


def sentences(line: str) -> list[str]:
    """A squeezed line cut after each full stop, exclamation or question mark that a blank follows."""
    return line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").replace("؟ ", "؟\n").split("\n")


def _fold(name: str) -> str:
    return _space.sub(" ", re.sub(r"[\s_.\-]+", " ", _asked.sub("", name.strip()).lower())).strip()


def _held(m: re.Match) -> str:
    return next(g for g in m.groups() if g is not None)


def spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, name, whether it can be nothing else) of what stands between marks and may be a variable."""
    out: list[tuple[int, int, str, bool]] = []
    if not (any(c in text for c in _MARKS) or "&lt;" in text) or not _any_mark.search(text):
        return out
    for m in _sure.finditer(text):
        out.append((m.start(), m.end(), _fold(_held(m)), True))
    for m in _maybe.finditer(text):
        held = _held(m)
        name = _fold(held)
        if name and name not in _tags and not name.replace(" ", "").replace(",", "").isdigit():
            out.append((m.start(), m.end(), name, bool(_asked.search(held) or _snake.match(held))))
    return out


def frame_at(text: str, start: int, end: int) -> str:
    """Up to six words before, from the segment's beginning if they are that few (digits as 0), a slot, the next word after it within the segment."""
    a = max(text.rfind("\n", 0, start), *(text.rfind(x, 0, start) for x in (". ", "! ", "? ", "؟ ")))
    before = _token.findall(_digits.sub("0", text[a + 1 : start].lower()))[-HEAD:]
    if before and before[0] in (".", "!", "?", "؟"):
        before = before[1:]
    word = ""
    stop = text.find("\n", end)
    for m in _token.finditer(text, end, len(text) if stop < 0 else stop):
        word = m.group(0).lower().strip(_edges)
        if word or m.group(0)[-1] in ".!?؟":
            break
    return " ".join(before) + "\x1f" + _digits.sub("0", word)


def frames(text: str, low: str | None = None) -> list[str]:
    """Frames of the empty-looking words."""
    low = _lowered(text) if low is None else low
    return [frame_at(text, m.start(), m.end()) for m in filter(None, (_empty.match(text, at) for at in _places(low, _EMPTY_PARTS)))]


def fixed_reason(text: str, low: str | None = None, groups: int | None = None) -> str | None:
    """What a text is by fixed values alone: values that only programs write, blanks, sentences and repetitions that only fill."""
    low = _lowered(text) if low is None else low
    groups = _groups(low) if groups is None else groups
    if _is_broken(text, low, groups & _BREAKS > 0) or _is_blank(text, low, False):
        return "empty"
    if _is_filler(text, low, groups & _FILLS > 0) or repeats(low):
        return "filler"
    return None


def _speaks(low: str) -> int:
    """How often a lower-cased segment speaks of what notices do."""
    return len(_notice.findall(low)) if _groups(low) & _NOTICED else 0


def page_segments(text: str, title: str | None) -> list[tuple[str, bool]]:
    """(folded segment, whether it may be missing) of a text without its title and the short lines of menus.

    A heading in front and segments of up to three words may be missing: a page is a notice with or without them.
    """
    kept: list[tuple[str, bool]] = []
    name = _digits.sub("0", " ".join(title.split()).lower()) if title else None
    for line in _digits.sub("0", text.lower()).split("\n"):
        x = " ".join(line.split())
        if not x or x == name:
            continue
        n = x.count(" ") + 1
        if n <= 4 and x[-1] not in ".!?؟:;)" and "0" not in x and not _speaks(x):
            continue
        heading = not kept and n <= 12 and x[-1] not in ".!?؟"
        kept += [(s, heading or s.count(" ") < 3) for s in sentences(x)]
    return kept


def _is_label(frame: str) -> bool:
    head = frame.split("\x1f")[0]
    return head.endswith(":") and head.count(" ") < 3


_EVIDENCE = "kind string, d bigint, h bigint, tail bigint, key string, n int"


def _evidence(df: DataFrame) -> DataFrame:
    """What each text (d, its hash with the title) has that may matter.

    kind seg, soft: a segment h of the page, n hits of notices in it (1 if half of its page has some), the text's own hash in
    tail; soft ones may be missing. span: something between
    marks in the frame (h, tail), its name in key, n = 1 if it can be nothing else. none: an empty value in the frame, n = 1
    after a label; frames at the beginning of a segment have h = 0 and aren't aligned. word: a word of a segment of filler
    (none of a single text). own: decided by fixed values, reason in key.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for d, text, title in zip(*(c.to_pylist() for c in batch.columns)):
                low = _lowered(text)
                groups = _groups(low)
                cued = groups & _NOTICED > 0
                segments = page_segments(text, title)
                cues = [min(2, _speaks(x)) if cued else 0 for x, _ in segments]
                page = cued and 2 * sum(c > 0 for c in cues) >= len(cues)  # the others go on with what half of them say
                own = _hash(text)
                rows += [("soft" if soft else "seg", d, h, own, None, max(c, int(page))) for h, (soft, c) in {_hash(x): (soft, c) for (x, soft), c in zip(segments, cues)}.items()]
                found = [("span", frame_at(text, start, end), name, int(sure)) for start, end, name, sure in spans(text)]
                found += [("none", frame, None, int(_is_label(frame))) for frame in (set(frames(text, low)) if groups & _EMPTIES else ())]
                for kind, frame, name, n in found:
                    head, tail = frame.split("\x1f")
                    h = 0
                    for word in head.split():
                        h = _longer(h, word)
                    rows.append((kind, d, _signed(h), _signed(_words[tail]) if tail else 0, name, n))
                why = fixed_reason(text, low, groups)
                if why:
                    rows.append(("own", d, 0, 0, why, 0))
                    if why == "filler":
                        for s in (x for line in low.split("\n") for x in sentences(" ".join(line.split()))):
                            if _is_filler(s, s):
                                rows += [("word", 0, 0, 0, w, 0) for w in {w.strip(_edges) for w in s.split()} if w] + [("word", 0, 0, 0, "", 0)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "d", "h", "tail", "key", "n"])

        return step

    return materialize(map_batches(df, _EVIDENCE, make), "evidence")


def _bits(spark, hashes: DataFrame) -> bytes:
    """A set of hashes as bits at their remainders; its size is fixed."""
    bits = np.zeros(_BLOOM_BITS // 8, np.uint8)
    places = hashes.select(F.pmod(hashes.columns[0], F.lit(_BLOOM_BITS)).cast("int").alias("p"))
    for r in places.groupBy(F.floor(F.col("p") / 8).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, p % 8)")).alias("b")).toLocalIterator():  # at most the bytes of the set
        bits[r["at"]] = r["b"]
    return bits.tobytes()


def _others(df: DataFrame, asked: DataFrame, filler: set[str], at_once: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """((h, tail, other): texts that somewhere have a frame's words and something else in its place; d of texts with a segment of filler words).

    Every word of every segment is looked at as what may stand in a slot. Which frames are asked for comes as a bit set of
    fixed size; what passes it by chance is dropped by the join later. Lines are taken until they have `at_once` words.
    """
    spark = df.sparkSession
    pair = F.col("h").bitwiseXOR(F.shiftleft("tail", 1))
    frames_at = asked.select(F.explode(F.array(pair, F.col("h").bitwiseXOR(F.lit(_WHOLE)))).alias("x")).distinct()
    shared = spark.sparkContext.broadcast((_bits(spark, frames_at), frozenset(filler)))

    def run(batches):
        packed, filler = shared.value
        bits = np.frombuffer(packed, np.uint8)
        vocabulary = _Vocabulary(filler)
        held: Counter = Counter()

        def asked_for(x):
            x = (x & np.uint64(_BLOOM_BITS - 1)).astype(np.int64)
            return bits[x >> 3] >> (x & 7).astype(np.uint8) & 1 > 0

        def out(h, tail, other, d):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, tail, other, d)], names=["h", "tail", "other", "d"])

        def counted():
            keys = list(held)
            return out([_signed(k[0]) for k in keys], [_signed(k[1]) for k in keys], [held[k] for k in keys], [None] * len(keys))

        def aligned(words, stops, rows):
            """((row, head, tail) of frames with something else in their place, rows with a segment of filler); line i is of rows[i], ends before stops[i]."""
            hashes, tails, kinds = vocabulary.columns(words)
            last = kinds & _ENDS > 0
            last[np.array(stops) - 1] = True
            ends = np.flatnonzero(last) + 1
            sizes = np.diff(ends, prepend=0)
            row = np.repeat(rows, np.diff(stops, prepend=0))
            fills = np.add.reduceat(kinds & _IN_FILLER > 0, ends - sizes, dtype=np.int64)
            filled = np.unique(row[ends[(sizes > 3) & (fills >= 0.8 * sizes)] - 1]).tolist()
            before = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
            heads = _heads(hashes, before)
            at = np.flatnonzero((before > 0) & (kinds & _FITS > 0))
            at = at[asked_for(heads[at] ^ np.uint64(_WHOLE))]
            here, left = heads[at], np.repeat(ends, sizes)[at] - at
            found = set()
            for j in range(REACH):
                inside = np.flatnonzero(left > j)
                next_ = tails[at[inside] + j] if j else np.zeros(len(inside), np.uint64)
                ok = ((next_ > 0) | (j == 0)) & asked_for(here[inside] ^ next_ << np.uint64(1))
                found.update(zip(row[at[inside[ok]]].tolist(), here[inside[ok]].tolist(), next_[ok].tolist()))
            return found, filled

        def pieces(texts):
            """(words, where lines end, their rows) of some lines at a time."""
            words, stops, rows = [], [], []
            for row, text in enumerate(texts):
                for line in _digits.sub("0", text.lower()).split("\n"):
                    split = line.split()
                    if split:
                        words += split
                        stops.append(len(words))
                        rows.append(row)
                        if len(words) >= at_once:
                            yield words, stops, rows
                            words, stops, rows = [], [], []
            if words:
                yield words, stops, rows

        for batch in batches:
            ids, seen = batch.column(0).to_pylist(), set()
            for words, stops, rows in pieces(batch.column(1).to_pylist()):
                found, filled = aligned(words, stops, rows)
                found -= seen
                held.update((h, tail) for _, h, tail in found)
                seen = {x for x in seen | found if x[0] == rows[-1]}  # a text counts once, also if it goes on in the next piece
                if filled:
                    none = [None] * len(filled)
                    yield out(none, none, none, [ids[row] for row in filled])
                if len(held) > 200_000:
                    yield counted()
                    held.clear()
                if len(vocabulary) > 500_000:
                    vocabulary = _Vocabulary(filler)
        yield counted()

    both = materialize(df.mapInArrow(run, "h bigint, tail bigint, other bigint, d bigint"), "others")
    return both.where("d is null").groupBy("h", "tail").agg(F.sum("other").alias("other")), both.where("d is not null").select("d").distinct()


def _notices(ev: DataFrame, fixed: bool) -> DataFrame:
    """d of the texts that are whole pages of templates: all their segments recur, and recur mostly on such pages.

    A segment recurs if `TEXTS` different texts have it, or two documents if it speaks of what notices do; one that does so
    twice counts alone. With `fixed` a page has to speak of such things once, as forms that only differ in numbers are
    templates too.
    """
    seg = ev.where("kind in ('seg', 'soft')").select("d", "h", F.col("kind") == "soft", "n", "tail").toDF("d", "h", "soft", "cues", "text")
    counted = seg.groupBy("h").agg(F.count_distinct("text").alias("texts"), F.count("*").alias("docs"), F.max("cues").alias("cue"))
    recurring = materialize(counted.where((F.col("texts") >= TEXTS) | (F.col("cue") > 0) & (F.col("docs") > 1)).select("h", "docs"), "recurring")
    known = seg.drop("text").join(recurring, "h", "left")
    fits = F.col("soft") | F.col("docs").isNotNull() | (F.col("cues") > 1)
    pages = known.groupBy("d").agg(F.bool_and(fits).alias("fits"), F.bool_or(F.col("docs").isNotNull() | (F.col("cues") > 1)).alias("any")).where("fits and any").select("d")
    pages = materialize(seg.drop("text").join(pages, "d", "left_semi"), "pages")
    whole = pages.groupBy("h").agg(F.count("*").alias("whole")).join(recurring, "h").where("whole >= 0.5 * docs").select("h", F.lit(True).alias("template"))
    own = F.coalesce("template", F.col("cues") > 1)
    spoken = F.bool_or(own & ((F.col("cues") > 0) | F.lit(not fixed)))
    return pages.join(whole, "h", "left").groupBy("d").agg(F.bool_and(F.col("soft") | own).alias("all"), spoken.alias("any")).where("all and any").select("d")


def reasons(df: DataFrame, text: str = "text", fixed: bool = True) -> DataFrame:
    """(d, reason) of the texts with residue, by the hash d that `_texts` gives them; reason is slot, empty, filler or notice.

    Without `fixed` nothing is residue by the form of its marks or by fixed values alone: only aligned slots count, names
    of variables that stand in them, and repeated whole pages.
    """
    texts = _texts(df, text).where(F.length(F.btrim("t")) > 0)
    ev = _evidence(texts)
    words = ev.where("kind = 'word'").groupBy("key").agg(F.count("*").alias("n"))
    segments = (words.where("key = ''").agg(F.sum("n")).first()[0] or 0) if fixed else 0
    filler = {r["key"] for r in words.where((F.col("key") != "") & (F.col("n") >= max(3, FILLER_SHARE * segments))).collect()} if segments else set()
    asked = ev.where("kind in ('span', 'none') and h <> 0")
    others, filled = _others(texts, asked, filler)
    frame = asked.groupBy("h", "tail").agg(F.count_distinct("d").alias("here"), F.max(F.when(F.col("kind") == "none", F.col("n")).otherwise(0)).alias("label")).join(others, ["h", "tail"], "left").na.fill(0, ["other"])
    # After a label the value is a slot's if another record has another one, or where too few have any to tell.
    aligned = (F.col("other") >= 1) & (F.col("other") >= 0.2 * F.col("here"))
    label = (F.col("label") == 1) & ((F.col("other") >= 1) | (F.col("here") < 3)) if fixed else F.lit(False)
    slots = materialize(frame.where(aligned | label).select("h", "tail"), "slots")
    marked = ev.where("kind = 'span'")
    named = marked.join(slots, ["h", "tail"], "left_semi").groupBy("key").agg(F.count_distinct("d").alias("n"), F.count_distinct("h", "tail").alias("frames")).where("n > 1 and frames > 1").select("key")
    if fixed:
        named = named.union(marked.where("n = 1").select("key")).distinct()
    residue_ = [
        marked.join(named, "key", "left_semi").select("d", F.lit(0).alias("r")),
        ev.where("kind = 'none'").join(slots, ["h", "tail"], "left_semi").select("d", F.lit(1).alias("r")),
        filled.select("d", F.lit(2).alias("r")),
        _notices(ev, fixed).select("d", F.lit(3).alias("r")),
    ]
    if fixed:
        residue_ += [marked.where("n = 1").select("d", F.lit(0).alias("r")), ev.where("kind = 'own'").select("d", F.when(F.col("key") == "empty", 1).otherwise(2).alias("r"))]
    found = residue_[0]
    for x in residue_[1:]:
        found = found.unionByName(x)
    return found.groupBy("d").agg(F.min("r").alias("r")).select("d", F.element_at(F.array(*map(F.lit, ("slot", "empty", "filler", "notice"))), F.col("r") + 1).alias("reason"))


def _texts(df: DataFrame, text: str) -> DataFrame:
    title = df["title"] if "title" in df.columns else F.lit(None).cast("string")
    return df.select(F.xxhash64(df[text], title).alias("d"), df[text].alias("t"), title.alias("title")).where("t is not null")


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", fixed: bool = True) -> DataFrame:
    """(key, reason) of each row: slot, empty, filler or notice, or null for content.

    Null, empty and blank texts hold no residue: reason null. Repeated rows come back as often as they are there. A
    `title` column, if there is one, tells a page's title from its text; other columns are ignored. See `reasons` for `fixed`.
    """
    title = df["title"] if "title" in df.columns else F.lit(None).cast("string")
    rows = df.select(df[key].alias("__key"), F.when(df[text].isNotNull(), F.xxhash64(df[text], title)).alias("d"))
    return rows.join(reasons(df, text, fixed), "d", "left").select(F.col("__key").alias(key), "reason")


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", fixed: bool = True) -> DataFrame:
    """Keys of the documents with residue, each once."""
    return judged(df, key, text, fixed).where("reason is not null").select(key).distinct()


def clean_corpus(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows whose text holds residue; rows with a null key stay."""
    return df.join(residue(df, key, text), key, "left_anti").select(*df.columns)
