"""Problem 4: the article of a page without the page around it.

The composite text density of a node is its characters a tag, adjusted by how
many of them are links. Where the pages are text already, their tree is rebuilt
from it: the body holds blocks, a block a heading with its paragraphs and lists
or a run of short lines, and each line is a leaf and a tag. What counts as link
text is learnt from the corpus: lines, and frames around page titles, that many
pages carry and that don't head paragraphs or lists. The subtree of the largest
sum of its children's densities is the article's, and the threshold of the path
from it to the body leaves out short lines that text, counts and place leave
open. Whole blocks aren't left out by density: without tags a list of short
items is as thin as a menu (the README has figures).

The corpus contributes a table of the lines that more than a fixed share of its
pages carry; since a page has some fifty lines, the table's size is bounded by
fifty over that share, whatever the corpus's size. Lines of any length that only
a source's own pages repeat are counted by source and hash, where a small fixed
number of pages is enough; their table grows with the sources and is joined to
the pages.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

_digits = re.compile(r"\d+")
_bullet = re.compile(r"^(?:[•·‣▪◦*–—-]\s*|\d{1,2}[.)]\s+)\S")
_end = ".!?؟。"
_related = re.compile(r"^(?:see also|related|more (?:on|like|about|from)|keep reading|read (?:more|next|also)|popular|most read|in this section|you may also|also on)\b|^(?:lire aussi|à lire|pages liées|voir aussi)|^(?:más temas|páginas relacionadas|ver también|lea también)|^(?:mehr (?:dazu|zum)|ähnliche|lesen sie auch|siehe auch)|^(?:اقرأ أيضا|صفحات ذات صلة|مواضيع ذات صلة)", re.I)
#: What pages say around an article, in the languages of the corpus.
_cue = re.compile(
    r"©|\bcopyright\b|all rights reserved|derechos reservados|droits réservés|rechte (?:sind )?vorbehalten|جميع الحقوق"
    r"|(?:uses?|use of|accept|manage|reject|allow|optional) (?:\w+ )?cookies|cookies (?:to|para|pour|um)\b|(?:gestionar|gérer les|tout accepter|aceptar) ?(?:cookies)?$|cookies verwalten|ملفات (?:تعريف )?الارتباط"
    r"|sign\s+up for|subscribe to|newsletter|suscríbase|abonnez-vous|abonnieren sie|اشترك في"
    r"|share this (?:page|article)|send to a friend|comparta esta|partagez cette|teilen sie diese|شارك هذه"
    r"|^advertisement\b|^sponsored\b|^publicidad\b|^publicité\b|^anzeige\b|^إعلان\b"
    r"|was this page|did the page|page useful|help you\?|esta página|هل كانت هذه الصفحة"
    r"|(?:page|last) (?:checked|reviewed|updated)|última revisión|dernière relecture|zuletzt geprüft|آخر مراجعة"
    r"|written by the|editorial desk|escrito por la redacción|écrit par la rédaction|verfasst von der redaktion|كتب هذا النص|reading time \d|last edited by"
    r"|(?:does not|do not|don't) replace (?:\w+ )?advice|no sustituye|ne remplacent pas|ersetzen keinen|لا تغني عن|terms of use|opinions of guest|registered\s+charity|photo library"
    r"|^(?:up next|most read this week|you are reading|our campaign|next talk)\b|^(?:siguiente|está leyendo|lo más leído|vous lisez|les plus lus|als nächstes|sie lesen|meistgelesen)\b"
    r"|^(?:skip to|back to top|log ?in$|site ?map$|follow us|my basket|print this|book online)|^(?:saltar al|volver arriba|mapa del sitio|síganos|iniciar sesión)|^(?:aller au contenu|haut de page|plan du site|suivez-nous)|^(?:zum inhalt|nach oben|seitenübersicht|folgen sie)",
    re.I,
)
#: Parts one of which every match of _cue has; looked for first, as that is much faster.
_CUE_PARTS = (
    "©", "copyright", "rights reserved", "reservados", "droits réserv", "vorbehalten", "جميع الحقوق", "cookies", "الارتباط", "sign up", "sign\xa0up", "subscribe to", "newsletter", "suscríbase", "abonnez", "abonnieren", "اشترك", "share this", "send to a friend", "comparta esta", "partagez cette", "teilen sie diese", "شارك هذه", "advertisement", "sponsored",
    "publicidad", "publicité", "anzeige", "إعلان", "was this page", "did the page", "page useful", "help you?", "esta página", "هذه الصفحة", "page checked", "page reviewed", "page updated", "last checked", "last reviewed", "last updated", "last edited", "última revisión", "dernière relecture", "zuletzt geprüft", "آخر مراجعة", "written by", "editorial desk",
    "la redacción", "la rédaction", "der redaktion", "كتب هذا", "reading time", "replace", "sustituye", "remplacent", "ersetzen", "لا تغني", "terms of use", "opinions of guest", "registered charity", "photo library", "up next", "you are reading", "our campaign", "next talk", "siguiente", "está leyendo", "más leído", "vous lisez", "plus lus", "als nächstes",
    "sie lesen", "meistgelesen", "skip to", "back to top", "log in", "login", "site map", "sitemap", "follow us", "my basket", "print this", "book online", "saltar al", "volver arriba", "mapa del", "síganos", "iniciar ses", "aller au", "haut de page", "plan du site", "suivez-nous", "zum inhalt", "nach oben", "seitenüber", "folgen sie", "accepter", "aceptar", "most read", "redaktion",
)
_parts = ahocorasick.Automaton()
for _p in _CUE_PARTS:
    _parts.add_word(_p, True)
_parts.make_automaton()


def cued(line: str, low: str) -> bool:
    return len(line) <= 2 * SHORT and next(_parts.iter(low), None) is not None and _cue.search(line) is not None


LONG = 100
SHORT = 150
#: Share of its density that link text must leave a line, the share of list places that a bullet counts for, and the pages that a share of a half is worth.
STANDING, LISTED, DRAWN = 0.05, 0.5, 4


def squeezed(line: str) -> str:
    return " ".join(line.split())


def leaf_key(line: str, title: str, source: str) -> str:
    """A line in compared form: lower case, digits 0, the page's own title <t> and source <s>."""
    x = line.lower()
    if title and title in x:
        x = x.replace(title, "<t>")
    if source and source in x:
        x = x.replace(source, "<s>")
    return _digits.sub("0", x)


def label(key: str) -> str | None:
    """What stands before a colon or the first two steps of a trail, if something follows."""
    if " > " in key:
        parts = key.split(" > ")
        return " > ".join(parts[:2]) + " >" if len(parts) > 2 else parts[0] + " >"
    head, colon, rest = key.partition(": ")
    return head + ":" if colon and rest and len(head) <= 48 and head.count(" ") <= 6 else None


def _title_like(line: str) -> bool:
    return len(line) <= 90 and line.count(" ") >= 2 and line[-1] not in _end + ":" and not _bullet.match(line) and " > " not in line and " | " not in line and " · " not in line


@dataclass
class Site:
    """How pages use a line: on how many, how often before a long line, in a list after a lead-in, before a title-like line."""

    lines: dict[str, tuple[int, float, float, float]] = field(default_factory=dict)
    labels: dict[str, tuple[int, float]] = field(default_factory=dict)
    frames: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.kinds: dict[str, str] = {}

    def kind(self, key: str) -> str | None:
        """Of a line that many pages carry: L list item, H heading, ? either heading or menu, P paragraph, F furniture."""
        if key not in self.lines:
            return None
        kind = self.kinds.get(key)
        if kind is None:
            _, long, inside, _ = self.lines[key]
            sentence = key[-1] in _end and key.count(" ") >= 5
            plain = not sentence and len(key) < 40 and "<" not in key and not cued(key, key)
            kind = "L" if inside >= 0.5 else "H" if long >= 0.75 and not sentence else "?" if long >= 0.4 and plain else "P" if long >= 0.75 else "F"
            self.kinds[key] = kind
        return kind


def _page(content: str, title: str | None, source: str | None) -> tuple[list[tuple[int, str, bool]], str, str]:
    rows, blank = [], True
    for no, raw in enumerate(content.split("\n")):
        line = squeezed(raw)
        if line:
            rows.append((no, line, blank))
        blank = not line
    t = squeezed(title).lower() if title else ""
    return rows, "" if t == "unknown" or len(t) < 8 else t, squeezed(source).lower() if source else ""


def _hash(source: str, key: str) -> int:
    return (xxhash.xxh3_64_intdigest(f"{source}\x1d{key}") ^ 1 << 63) - (1 << 63)


_PAGES, _FRAMES = "\x1e", "\x1c"


def _count(content: str, title: str | None, source: str | None, held: dict) -> None:
    rows, t, s = _page(content, title, source)
    held.setdefault((s, _PAGES), [0, 0, 0, 0])[0] += 1
    lead, seen = False, set()
    last = len(rows) - 1
    for i, (_, line, blank) in enumerate(rows):
        n = len(line)
        key = leaf_key(line, t, s)
        if n > SHORT:
            inside = lead = False
        elif line[-1] == ":":
            inside, lead = False, True
        else:
            inside = lead = lead and not blank and n < 60
        follower = rows[i + 1][1] if i < last else ""
        for k in (key, n <= SHORT and (lb := label(key)) and "\x1f" + lb):
            if k and k not in seen:
                seen.add(k)
                v = held.get((s, k))
                if v is None:
                    v = held[s, k] = [0, 0, 0, 0]
                v[0] += 1
                v[1] += len(follower) >= LONG
                v[2] += inside
                v[3] += bool(follower) and len(follower) < LONG and _title_like(follower) and follower.lower() != t


def _frame(key: str) -> tuple[str, str] | None:
    a, mark, b = key.partition("<t>")
    return (a, b) if mark and (a or b) and len(a.strip()) + len(b.strip()) >= 5 and "<" not in a + b else None


def _learnt(df: DataFrame, content: str, share: float = 5e-4, least: int = 6) -> tuple[Site, DataFrame]:
    """What learn() gives, and (h, n, long, inside, title, frames): lines of at least `least` pages of a source, by hash."""

    def run(batches):
        held: dict[tuple[str, str], list[int]] = {}

        def out():
            # Texts are given for short lines and labels only.
            keys = [k if len(k) <= 2 * SHORT else None for _, k in held]
            cols = list(zip(*held.values())) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array([_hash(s, _FRAMES) for s, _ in held], pa.int64()), pa.array([_hash(s, k) for s, k in held], pa.int64()), pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["site", "h", "key", "n", "long", "inside", "title"])

        for batch in batches:
            for c, t, s in zip(*(x.to_pylist() for x in batch.columns)):
                _count(c, t, s, held)
            if len(held) > 300_000:
                yield out()
                held.clear()
        yield out()

    sums = [F.sum(c).alias(c) for c in ("n", "long", "inside", "title")]
    source = _columns(df, content).where("c is not null and c <> ''")
    counted = materialize(source.mapInArrow(run, "site bigint, h bigint, key string, n bigint, long bigint, inside bigint, title bigint").groupBy("site", "h", "key").agg(*sums), "lines")
    pages = counted.where(F.col("key") == _PAGES).agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("key").isNotNull() & (F.col("key") != _PAGES)).groupBy("key").agg(*sums).where(F.col("n") >= max(least, share * pages)).collect()
    site = Site()
    for r in rows:
        k, n = r["key"], r["n"]
        if k[0] == "\x1f":
            site.labels[k[1:]] = (n, r["long"] / n)
        else:
            site.lines[k] = (n, r["long"] / n, r["inside"] / n, r["title"] / n)
            if r["long"] / n < 0.75 and (frame := _frame(k)):
                site.frames.append(frame)
    own = counted.where((F.col("n") >= least) & (F.col("key").isNull() | (F.col("key") != _PAGES)))
    frames = own.where(F.col("key").contains("<t>") & (F.col("long") < 0.75 * F.col("n"))).groupBy("site").agg(F.collect_set("key").alias("frames"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("n", "long", "inside", "title")]
    own = own.select("h", "n", "long", "inside", "title", F.lit(None).cast("array<string>").alias("frames")).unionByName(frames.select(F.col("site").alias("h"), *none, "frames"))
    return site, materialize(own, "own")


def learn(df: DataFrame, content: str = "content", share: float = 5e-4, least: int = 6) -> Site:
    """Counts the lines of all pages; keeps those on at least `least` pages and at least `share` of all."""
    return _learnt(df, content, share, least)[0]


def _view(site: Site, own: list[dict], source: str, keys: list[str]) -> Site:
    """What is known of a page's lines: by all pages, else by those of its source."""
    by = {r["h"]: r for r in own}
    view = Site({}, {}, site.frames)
    for k in keys:
        if k in site.lines:
            view.lines[k] = site.lines[k]
            view.kinds[k] = site.kind(k)
        elif r := by.get(_hash(source, k)):
            view.lines[k] = (r["n"], r["long"] / r["n"], r["inside"] / r["n"], r["title"] / r["n"])
        if lb := label(k):
            if lb in site.labels:
                view.labels[lb] = site.labels[lb]
            elif r := by.get(_hash(source, "\x1f" + lb)):
                view.labels[lb] = (r["n"], r["long"] / r["n"])
    if r := by.get(_hash(source, _FRAMES)):
        view.frames = [*site.frames, *(x for k in r["frames"] if k not in site.lines and (x := _frame(k)))]
    return view


def _read(df: DataFrame, content: str, site: Site | None, columns: list) -> tuple[DataFrame, Site]:
    """(*columns, c, t, s, own) of each row and what all pages know; own is what only its source's pages know of its lines."""
    rows = df.select(*columns, *_texts(df, content))
    if site is not None:
        return rows.withColumn("own", F.lit(None).cast(_OWN)), site
    site, own = _learnt(df, content)
    shared = df.sparkSession.sparkContext.broadcast((frozenset(site.lines), frozenset(site.labels)))

    def make():
        lines, labels = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pages, hashes = [], []
            for page, c, title, source in zip(*(x.to_pylist() for x in batch.columns)):
                found, t, s = _page(c, title, source)
                keys = {leaf_key(line, t, s) for _, line, _ in found}
                asked = [k for k in keys if k not in lines] + ["\x1f" + lb for lb in {label(k) for k in keys} if lb and lb not in labels] + [_FRAMES]
                pages += [page] * len(asked)
                hashes += [_hash(s, k) for k in asked]
            return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(hashes, pa.int64())], names=["page", "h"])

        return step

    # Rows of one page id are of one page, or share what they are given, which does no harm: it is looked up by hash.
    rows = rows.withColumn("page", F.xxhash64("c", "t", "s"))
    asked = map_batches(rows.where("c is not null and c <> ''").select("page", "c", "t", "s"), "page bigint, h bigint", make)
    given = asked.join(own, "h").groupBy("page").agg(F.collect_set(F.struct("h", "n", "long", "inside", "title", "frames")).alias("own"))
    return rows.join(given, "page", "left").drop("page"), site


_OWN = "array<struct<h:bigint,n:bigint,long:bigint,inside:bigint,title:bigint,frames:array<string>>>"


def _texts(df: DataFrame, content: str) -> list:
    null = F.lit(None).cast("string")
    return [df[content].alias("c"), (df["title"] if "title" in df.columns else null).alias("t"), (df["source"] if "source" in df.columns else null).alias("s")]


def _columns(df: DataFrame, content: str) -> DataFrame:
    return df.select(*_texts(df, content))


def density(chars: float, tags: float, link_chars: float, link_tags: float, body_share: float) -> float:
    """Composite text density. Nodes without links count as having one link character and tag."""
    if not chars:
        return 0.0
    lc, lt = max(link_chars, 1.0), max(link_tags, 1.0)
    base = math.log(chars / max(chars - link_chars, 1.0) * link_chars + body_share * chars + math.e)
    inner = chars / lc * tags / lt
    return chars / tags * (math.log(inner) / base if inner > 1 else 0.0)


def furniture(content: str, title: str | None, source: str | None, site: Site, own: list[dict] | None = None) -> list[int]:
    """Numbers of the non-empty lines that aren't part of the article; own is what only the pages of its source know."""
    rows, t, s = _page(content, title, source)
    n = len(rows)
    if not n:
        return []
    kinds = [""] * n
    lists = [0.0] * n  # of a line that only counts call furniture: the share of its occurrences that are in lists
    keys = [leaf_key(line, t, s) for _, line, _ in rows]
    if own:
        site = _view(site, own, s, keys)
    for i, (_, line, _) in enumerate(rows):  # leaves that their text decides
        key = keys[i]
        if len(line) > 2 * SHORT:
            kinds[i] = "F" if site.kind(key) == "F" and line[-1] != ":" else "P"
            continue
        sentence = line[-1] in _end and line.count(" ") >= 5
        known = site.kind(key)
        if len(line) > SHORT and known != "F":
            known = None
        if key == "<t>":
            kinds[i] = "H"
        elif known == "F" and line[-1] != ":":
            kinds[i] = "F"
            if not cued(line, key) and not _related.match(line) and "<" not in key:
                # The share is drawn to a half where few pages have the line.
                seen, inside = site.lines[key][0], site.lines[key][2]
                lists[i] = max((seen * inside + DRAWN / 2) / (seen + DRAWN), LISTED if _bullet.match(line) else 0.0)
        elif _bullet.match(line) and not cued(line, key):
            kinds[i] = "L"
        elif line[-1] == ":" and not _related.match(line):
            kinds[i] = "I"
        elif known:
            kinds[i] = "F" if known == "L" and cued(line, key) else known
        elif (lb := label(key)) and (stat := site.labels.get(lb)) and stat[1] < 0.6:
            kinds[i] = "F"
        elif any(key.startswith(a) and key.endswith(b) and len(key) > len(a) + len(b) for a, b in site.frames):
            kinds[i] = "F"
        elif len(line) <= 2 * SHORT and (cued(line, key) or _related.match(line)):
            kinds[i] = "F"
        elif sentence or len(line) >= LONG:
            kinds[i] = "P"
        else:
            kinds[i] = "U"
    related = False
    for i, (_, line, blank) in enumerate(rows):  # leaves that their place decides
        k = kinds[i]
        before = kinds[i - 1] if i else ""
        if k == "?":
            menu = any(kinds[j] == "F" and rows[j][1].count(" ") < 4 for j in (i - 1, i + 1) if 0 <= j < n)
            j = i + 1
            while j < n and kinds[j] == "F":
                j += 1
            kinds[i] = k = "H" if not menu and j < n and kinds[j] in ("P", "I") else "F"
        if k == "U":
            if before in ("I", "L") and not blank and len(line) < 70:
                k = "L"
            elif related:
                k = "F"
            else:
                j = i + 1
                while j < n and kinds[j] == "F":
                    j += 1
                k = "H" if j < n and kinds[j] in ("P", "I") else "U"
            kinds[i] = k
        if k == "F":
            known = site.lines.get(keys[i])
            related = related and keys[i] not in site.lines or bool(_related.match(line)) or bool(known and known[3] >= 0.75 and known[0] >= 6 and line.count(" ") <= 4)
        elif k in ("P", "H", "I"):
            related = False
    # Link text is what is furniture wherever it occurs; a line that is known by counts alone is so but for the share of its
    # occurrences in lists. The line stands if links leave it a part of the density that it would have without them.
    size = [len(line) for _, line, _ in rows]
    link = [size[i] * (1 - lists[i]) if kinds[i] == "F" else 0 for i in range(n)]
    share = sum(link) / sum(size)
    for i in range(n):
        if lists[i] and kinds[i] == "F" and density(size[i], 1, link[i], 1, share) >= STANDING * density(size[i], 1, 0, 0, share):
            kinds[i], link[i] = "L", 0
    total, linked = sum(size), sum(link)
    share = linked / total if total else 0.0
    # The tree: a block is a heading with what follows, or a run of short lines; its leaves are its tags.
    blocks: list[list[int]] = []
    for i, k in enumerate(kinds):
        fresh = not blocks or k == "H" or (k in "FU") != (kinds[i - 1] in "FU")
        if fresh:
            blocks.append([])
        blocks[-1].append(i)
    body = density(total, n, linked, sum(k == "F" for k in kinds), share)
    of = [density(sum(size[i] for i in b), len(b), sum(link[i] for i in b), sum(kinds[i] == "F" for i in b), share) for b in blocks]
    # A leaf of link text alone has density 0.
    sums = [sum(size[i] * math.log(size[i]) / math.log(share * size[i] + math.e) for i in b if kinds[i] != "F") for b in blocks]
    best = max(range(len(blocks)), key=lambda j: sums[j])
    whole = sum(of) >= sums[best]  # the body has the largest sum unless one block outweighs all blocks together
    threshold = min(body, of[best])
    out = []
    for j, b in enumerate(blocks):
        article = any(kinds[i] in "PIL" or kinds[i] == "H" for i in b) and (whole or j == best or of[j] >= 0.05 * threshold)
        for i in b:
            if kinds[i] == "F" or not article and (kinds[i] == "U" and of[j] < threshold or kinds[i] == "F"):
                out.append(rows[i][0])
    return out


def page_furniture(df: DataFrame, key: str = "article_id", content: str = "content", site: Site | None = None) -> DataFrame:
    """(key, line_no) of the non-empty lines that aren't part of the article, each once.

    Null and empty contents have none. Columns `title` and `source` help if they are there; others are ignored. Repeated
    rows count once; rows with a null key are left out of the result.
    """
    source, site = _read(df.where(df[content].isNotNull() & df[key].isNotNull()), content, site, [df[key].cast("long").alias("k")])
    shared = df.sparkSession.sparkContext.broadcast(site)

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, nos = [], []
            for i, c, t, s, own in zip(*(x.to_pylist() for x in batch.columns)):
                found = furniture(c, t, s, known, own)
                ids += [i] * len(found)
                nos += found
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=[key, "line_no"])

        return step

    return map_batches(source, f"`{key}` bigint, line_no int", make).distinct()


def main_content(df: DataFrame, key: str = "article_id", content: str = "content", site: Site | None = None) -> DataFrame:
    """(key, text, n_left_out) of each row: its content without the page around it; a null content gives a null text."""
    source, site = _read(df, content, site, [df[key].alias("k")])
    shared = df.sparkSession.sparkContext.broadcast(site)
    kind = df.schema[key].dataType.simpleString()

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, left = [], []
            for c, t, s, own in zip(*(x.to_pylist() for x in batch.columns[1:])):
                gone = set(furniture(c, t, s, known, own)) if c else set()
                left.append(len(gone))
                texts.append(None if c is None else "\n".join(x for no, x in enumerate(c.split("\n")) if no not in gone).strip())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(left, pa.int32())], names=[key, "text", "n_left_out"])

        return step

    return map_batches(source, f"`{key}` {kind}, text string, n_left_out int", make)
