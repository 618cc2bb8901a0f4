"""Problem 4, pages with tags: the main body of an HTML page by composite text density.

Every node of the page's tree has the characters and tags below it, and how many
of them are links. Its composite text density is its characters a tag, adjusted
by its links in relation to those of the whole body. The node with the largest
sum of its children's densities holds the main body; the least density on the
path from it to the body is the threshold. An article may lie in several nodes:
of the other subtrees that reach the threshold, from the body downwards, the
node of the largest sum is kept too if its sum is a good part of the chosen
one's.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .main_content import density

#: Elements without an end, elements that hold no text of the page, and those that begin a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template head svg select option button textarea iframe".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul br".split())


#: Part of the largest sum that another node's sum must reach to be kept beside it.
SISTER = 0.2


class _Reader(HTMLParser):
    """Nodes in the order of their beginnings: tag, parent; texts by node in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents = ["#root"], [-1]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]
        self.unseen = 0
        self.link_chars: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
            return
        if self.unseen:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.tags[self.open[-1]] == tag:
            self.open.pop()  # an end tag that may be left out
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        if tag not in UNSEEN and not self.unseen:
            self.tags.append(tag)
            self.parents.append(self.open[-1])

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif not self.unseen:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.tags[self.open[depth]] == tag:
                    del self.open[depth:]
                    return

    def handle_data(self, data):
        if not self.unseen:
            self.texts.append((self.open[-1], data))


def measured(html: str) -> tuple[_Reader, list[float], list[float]]:
    """(tree, density of each node, sum of its children's densities)."""
    tree = _Reader()
    tree.feed(html)
    tree.close()
    n = len(tree.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tree.tags[i] == "a" or linked[tree.parents[i]]
    for at, text in tree.texts:
        size = len("".join(text.split()))
        chars[at] += size
        if linked[at]:
            link_chars[at] += size
    for i in range(n - 1, 0, -1):  # parents come before their children
        up = tree.parents[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (tree.tags[i] == "a")
    body = next((i for i in range(n) if tree.tags[i] == "body"), 0)
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    own = [density(chars[i], max(tags[i], 1), link_chars[i], link_tags[i] or int(linked[i]), share) for i in range(n)]
    tree.link_chars = link_chars
    sums = [0.0] * n
    for i in range(1, n):
        sums[tree.parents[i]] += own[i]
    return tree, own, sums


def page_text(html: str) -> str:
    """The main body's text, a line for each block element; empty if the page has no text."""
    tree, own, sums = measured(html)
    n = len(tree.tags)
    if not any(text.strip() for _, text in tree.texts):
        return ""
    body = next((i for i in range(n) if tree.tags[i] == "body"), 0)
    last = list(range(n))  # the last node below each
    for i in range(n - 1, 0, -1):
        last[tree.parents[i]] = max(last[tree.parents[i]], last[i])

    def best(at: int) -> int:
        return max(range(at, last[at] + 1), key=lambda i: (sums[i], -i))

    chosen = best(body)
    threshold, at = own[chosen], chosen
    while at != body and at > 0:
        at = tree.parents[at]
        threshold = min(threshold, own[at])
    kept = [False] * n
    todo = [body]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[tree.parents[i]].append(i)
    while todo:
        node = todo.pop()
        top = best(node) if own[node] >= threshold else -1
        if top >= 0 and sums[top] > 0 and sums[top] >= SISTER * sums[chosen] or node == chosen:
            kept[top : last[top] + 1] = [True] * (last[top] + 1 - top)
            while top != node:  # what lies beside it
                up = tree.parents[top]
                todo += [x for x in children[up] if x != top]
                top = up
        else:
            todo += children[node]
    block = [0] * n  # the nearest block element around each node
    for i in range(1, n):
        block[i] = i if tree.tags[i] in BLOCKS or tree.tags[i] in ("body", "html", "#root") else block[tree.parents[i]]
    # A block that is nothing but links isn't part of the body even within it.
    parts: list[str] = []
    before = -1
    for at, text in tree.texts:
        if not kept[at] or tree.link_chars[block[at]] and own[block[at]] <= 0:
            continue
        up, down = before, at
        seen = set()
        while down > 0:
            seen.add(down)
            down = tree.parents[down]
        broken = False
        while up > 0 and up not in seen:
            broken |= tree.tags[up] in BLOCKS
            up = tree.parents[up]
        down = at
        while down > 0 and down != up:
            broken |= tree.tags[down] in BLOCKS
            down = tree.parents[down]
        if before >= 0 and broken:
            parts.append("\n")
        parts.append(text if tree.tags[at] == "pre" else " ".join(("x" + text + "x").split())[1:-1])
        before = at
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


def html_content(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, text) of each row: the main body of its page; null for a null page, empty for one without text.

    Pages are taken as they are, however long or broken; repeated rows come back as often, extra columns are ignored.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if h is None else page_text(h) for h in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

        return step

    return map_batches(df.select(df[key].alias("k"), df[html].alias("h")), f"`{key}` {df.schema[key].dataType.simpleString()}, text string", make)
