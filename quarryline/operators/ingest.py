"""From pages to an index: extraction, sections, chunks, identities, provenance."""

from __future__ import annotations

import shutil
import subprocess
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .store import materialize

# HTML ---------------------------------------------------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(frozen=True)
class Site:
    """Where a site's pages have their article: the first of `roots` that occurs, as (tag, attribute, value); what is cut out of it."""

    roots: tuple[tuple[str, str, str], ...]
    drop_tags: frozenset[str]
    drop_classes: frozenset[str] = frozenset()
    titles: tuple[str, ...] = ("h1", "title")


#: The page layouts of the four supported sites.
SITES = {
    "nhs": Site((("article", "", ""), ("div", "class", "nhsuk-main-wrapper")), frozenset({"script", "style", "nav", "footer", "aside"}), frozenset({"nhsuk-review-date", "nhsuk-contents-list", "nhsuk-pagination"})),
    "mayo": Site((("div", "class", "content"), ("main", "", ""), ("article", "", ""), ("div", "role", "main")), frozenset({"script", "style", "nav", "footer", "aside", "header"}), frozenset({"ad", "advertisement", "promo", "newsletter"}), ("h1",)),
    "medline": Site((("article", "id", "main-content"), ("div", "class", "main"), ("main", "", ""), ("div", "id", "topic")), frozenset({"script", "style", "nav"}), titles=("h1",)),
    "nice": Site((("*", "class", "chapter"), ("main", "", "")), frozenset({"script", "style", "nav", "footer", "aside"})),
}


class _Tree(HTMLParser):
    """A flat tree: nodes are (tag, attributes, parent); texts are (node, text) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict[str, str], int]] = [("", {}, -1)]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self.open[-1]))
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self.open[-1]))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.texts.append((self.open[-1], data))


def extract_page(html: str, site: Site) -> tuple[str, str | None]:
    """(title, text): h1, else title, else Unknown; the root's lines, trimmed, without empty ones; null if there is no root."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = tree.nodes
    root = None
    for tag, attribute, value in site.roots:
        root = next((i for i, (t, a, _) in enumerate(nodes) if i and (tag == "*" or t == tag) and (not attribute or value in a.get(attribute, "").split())), None)
        if root is not None:
            break
    title = "Unknown"
    for wanted in site.titles:
        first = next((i for i, (t, _, _) in enumerate(nodes) if t == wanted), None)
        if first is not None:
            title = " ".join("".join(x for at, x in tree.texts if at == first or nodes[at][2] == first).split()) or "Unknown"
            break
    if root is None:
        return title, None
    inside = [False] * len(nodes)
    for i, (tag, attrs, parent) in enumerate(nodes):
        if i == root:
            inside[i] = True
        elif i > root and parent >= 0 and inside[parent]:
            inside[i] = tag not in site.drop_tags and not site.drop_classes & set(attrs.get("class", "").split())
    lines = [line.strip() for at, x in tree.texts if inside[at] for line in x.split("\n")]
    return title, "\n".join(x for x in lines if x)


def html_extract(pages: DataFrame, key: str, html: str, site: str | Site) -> DataFrame:
    """(key, title, content) of each page; a null page gives nulls."""
    spec = SITES[site] if isinstance(site, str) else site
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None) if h is None else extract_page(h, spec) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([c for _, c in done], pa.string())], names=[key, "title", "content"])

    return pages.select(pages[key], pages[html].alias("__html")).mapInArrow(run, f"`{key}` {kind}, title string, content string")


def nice_title(title: Column, guideline: Column) -> Column:
    """The title of a guideline's page: one that only says Recommendations gets the guideline's id in front, Unknown becomes its name."""
    name = F.upper(guideline)
    return F.when(F.lower(title) == "recommendations", F.concat(name, F.lit(" Recommendations"))).when(title == "Unknown", F.concat(F.lit("NICE Guideline "), name)).otherwise(title)


def source_name(folder: Column) -> Column:
    """The name of a source's folder: lower case, and mayo for all of that clinic's."""
    low = F.lower(folder)
    return F.when(F.contains(low, F.lit("mayo")), "mayo").otherwise(low)


def too_long(content: Column, chars: int = 500_000) -> Column:
    """Whether a trimmed text may not fit a model's context."""
    return F.coalesce(F.length(T.strip(content)) > chars, F.lit(False))


def page_specs(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """(source, url) of the pages that are to be read, from a list of addresses a source."""
    return spark.createDataFrame([(s, u) for s, urls in lists.items() for u in urls], "source string, url string")


def scraped(specs: DataFrame, fetch: Callable[[str], str | None], attempts: int = 3) -> DataFrame:
    """(source, url, html, status, error) of each page: processed, skipped if fetch gives nothing, failed if it raises `attempts` times.

    fetch turns an address into a page; it is sent to the tasks. One page's failure is its own.
    """

    def run(frames):
        for frame in frames:
            out = []
            for source, url in zip(frame["source"], frame["url"]):
                html, status, error = None, "failed", ""
                for _ in range(attempts):
                    try:
                        html = fetch(url)
                        status, error = ("processed" if html else "skipped"), ""
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a transport raises
                        error = f"{type(e).__name__}: {e}"
                out.append((source, url, html, status, error))
            yield pd.DataFrame(out, columns=["source", "url", "html", "status", "error"])

    return specs.select("source", "url").mapInPandas(run, "source string, url string, html string, status string, error string")


def link_discovery(pages: DataFrame, html: str, prefix: str = "/conditions/", base: str = "", least: int = 12) -> DataFrame:
    """Different absolute links whose address begins with the prefix and is longer than `least`."""
    found = F.explode(F.regexp_extract_all(pages[html], F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["'](%s[^"']*)["']""" % prefix), F.lit(1)))
    return pages.select(found.alias("href")).where(F.length("href") > least).select(F.concat(F.lit(base), "href").alias("url")).distinct()


# Sections and chunks ------------------------------------------------------------------------------------------------

#: Fixed value: a section begins where, after an empty line, a line of letters, blanks, commas, brackets or hyphens does.
SECTION_BREAK = r"\n\n(?=[A-Z][a-zA-Z%s,()\-]+(?:\n|$))" % T.SPACE


def sections(articles: DataFrame, content: str = "content") -> DataFrame:
    """A row a non-empty section: the article's other columns, section_no, section (its heading or General) and body."""
    rest = [c for c in articles.columns if c != content]
    parts = articles.select(*rest, F.posexplode(F.split(articles[content], SECTION_BREAK)).alias("section_no", "__part")).withColumn("__part", T.strip(F.col("__part"))).where("__part <> ''")
    first = T.strip(F.substring_index("__part", "\n", 1))
    heading = (F.length(first) < 40) & ~first.endswith(".") & ~first.startswith("-")
    body = F.when(heading, T.strip(F.expr("substring(__part, length(substring_index(__part, '\n', 1)) + 2)"))).otherwise(F.col("__part"))
    return parts.select(*rest, "section_no", F.when(heading, first).otherwise("General").alias("section"), body.alias("body"))


SEPARATORS = ("\n\n", "\n", ". ", " ")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` words: divided at the coarsest separator that occurs, small parts joined again up to the
    size, each piece beginning with parts of up to `overlap` words of the one before; a part that is too long is divided
    at the next finer separator. A single word stays whole."""
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return [text.strip()] if text.strip() else []
    mark, finer = separators[at], separators[at + 1 :]
    pieces: list[str] = []
    held: deque[tuple[str, int]] = deque()
    words = 0  # of what is held; counted once a part

    def close() -> None:
        whole = "".join(p for p, _ in held).strip()
        if whole:
            pieces.append(whole)

    for i, part in enumerate(text.split(mark)):
        part = part if i == 0 else mark + part
        if not part:
            continue
        n = len(part.split())
        if n > size:
            close()
            held.clear()
            words = 0
            pieces += split_text(part, size, overlap, finer) if finer else [part.strip()]
            continue
        if held and words + n > size:
            close()
            while held and (words > overlap or words + n > size):
                words -= held.popleft()[1]
        held.append((part, n))
        words += n
    close()
    return pieces


def token_chunks(rows: DataFrame, body: str = "body", size: int = 500, overlap: int = 50) -> DataFrame:
    """A row a piece: the other columns, part_no and the piece in place of the body. Short bodies reach Python as nulls only, the others by Arrow batches."""
    rest = [c for c in rows.columns if c != body]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, size, overlap) for t in texts], dtype=object)

    # A condition around the function wouldn't spare it a row, one within does spare it the text.
    pieces = F.coalesce(cut(F.when(T.token_count(F.col(body)) > size, F.col(body))), F.array(F.col(body)))
    return rows.select(*rest, F.posexplode(pieces).alias("part_no", body))


def chunk_render(title: Column, source: Column, section: Column, body: Column) -> Column:
    """The text of a chunk; null if the body is empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.when(T.strip(body) != "", F.concat(F.lit("Document: "), e(title), F.lit(" | Source: "), e(source), F.lit(" | Section: "), e(section), F.lit("\n\nContent:\n"), body))


def chunk_articles(articles: DataFrame, key: str = "article_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, section_no, section, part_no, text): articles cut into sections and these into chunks of at most 500 words."""
    cut = token_chunks(sections(articles.select(*dict.fromkeys((key, "title", "source", *keep, "content")))))
    return cut.select(key, *keep, "section_no", "section", "part_no", chunk_render(F.col("title"), F.col("source"), F.col("section"), F.col("body")).alias("text")).where("text is not null")


def numbered(rows: DataFrame, order: list[str], name: str = "chunk_no", parts: int = 64) -> DataFrame:
    """Numbers all rows from 0 in an order, without sorting them in one task: within ranges, plus what the ranges before hold.

    `order` must tell all rows apart.
    """
    # Written down once: a range that is worked out again after a loss could hold other rows.
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1)
    sizes = local.groupBy("__p").count()
    before = sizes.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row a range
    return local.join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__n")).cast("long")).drop("__p", "__n", "__b")


# The index ----------------------------------------------------------------------------------------------------------


def dedup_sources(chunks: DataFrame, text: str = "text", source: str = "source", order: list[str] | None = None) -> DataFrame:
    """(point_id, text, sources, n): one point a text with its different non-null sources, in order of first appearance.

    Partial sets of (source, first place) are merged before the shuffle, so that a text with very many copies costs its
    different sources only.
    """
    place = F.struct(*order) if order else F.lit(0)
    base = chunks.where(chunks[text].isNotNull()).select(T.point_id(chunks[text]).alias("point_id"), chunks[text].alias("text"), chunks[source].alias("s"), place.alias("o"))
    first = base.groupBy("point_id", "s").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    merged = first.groupBy("point_id").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("o", "s")))).alias("l"), F.sum("n").alias("n"))
    # The text goes along once a point and task: it is the same for all rows of an id.
    texts = base.groupBy("point_id").agg(F.first("text").alias("text"))
    return merged.join(texts, "point_id").select("point_id", "text", F.transform("l", lambda x: x["s"]).alias("sources"), "n")


#: What is built into a point besides its chunk, and what is read back of it.
PAYLOAD = ("doc_title", "source", "section", "url", "type")


def payload_build(points: DataFrame, embed_model_id: str, embed_revision: str = "", git_commit: str = "", script_version: str = "1", indexed_at: Column | None = None) -> DataFrame:
    """Points with their provenance and without `source`, which `sources` replaces; chunk_id is the point's id if it is null."""
    rest = [c for c in points.columns if c not in ("source", "chunk_id")]
    chunk = F.coalesce("chunk_id", "point_id") if "chunk_id" in points.columns else F.col("point_id")
    facts = {"git_commit": git_commit, "script_version": script_version, "embed_model_id": embed_model_id, "embed_revision": embed_revision}
    return points.select(*rest, chunk.alias("chunk_id"), (F.current_timestamp() if indexed_at is None else indexed_at).alias("indexed_at"), *[F.lit(v).alias(k) for k, v in facts.items()])


def payload_normalize(points: DataFrame) -> DataFrame:
    """(id, text, doc_title, source, section, url, type) of stored points: the first of the sources, else the source; what is missing is empty."""
    has = set(points.columns)
    got = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    source = F.coalesce(F.get("sources", F.lit(0)), got("source")) if "sources" in has else got("source")
    fields = {c: got(c) for c in PAYLOAD} | {"source": source}
    return points.select(F.col("point_id").alias("id"), got("text").alias("text"), *[v.alias(k) for k, v in fields.items()])


def git_commit(folder: str = ".") -> str:
    """The short hash of what a folder has checked out; empty if it isn't known."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False) if shutil.which("git") else None
    return done.stdout.strip() if done and done.returncode == 0 else ""


def index_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Points after an upsert by id: incoming ones replace stored ones, sources of both are united, stored first.

    Both have point_id, text, sources (array) and n; ids are different within each.
    """
    a, b = existing.alias("a"), incoming.alias("b")
    joined = a.join(b, F.col("a.point_id") == F.col("b.point_id"), "full_outer")
    none = F.array().cast("array<string>")
    sources = F.array_distinct(F.concat(F.coalesce("a.sources", none), F.coalesce("b.sources", none)))
    state = F.when(F.col("a.point_id").isNull(), "new").when(F.col("b.point_id").isNull(), "kept").otherwise("updated")
    return joined.select(F.coalesce("b.point_id", "a.point_id").alias("point_id"), F.coalesce("b.text", "a.text").alias("text"), sources.alias("sources"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), state.alias("state"))


def incremental_pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key has no output yet; null keys are always pending."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def chunk_union(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of the tables with `kind`, their table's name; columns that one lacks are null there."""
    parts = [df.select(F.lit(kind).alias("kind"), *df.columns) for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def chunk_split(chunks: DataFrame, kind: Column) -> tuple[DataFrame, DataFrame]:
    """(medical, clinic): what is of the medical type, and all else, null types among it."""
    medical = kind.eqNullSafe(F.lit("medical_kb"))
    return chunks.where(medical), chunks.where(~medical)
