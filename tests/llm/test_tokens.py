import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import bpe, encoding, token_budget

PATH = encoding.BYTE_BPE_50K
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    t = bpe.Tokenizer(PATH)
    return t, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


CASES = ["", " ", "a", "I'm, you're", "x²+y² ½ Ⅳ ①②③", "مرحبا ٠١٢", "a\x1cb\x1d \x85\xa0", "👩‍⚕️ 日本語の薬", "A" * 40_000, "ab " * 20_000, "\n\n\n  \t x", "<|endoftext|>", "naïve ﬁbre soft\xadhyphen", "𝟘𝟙 𐍈"]


@pytest.mark.parametrize("text", CASES)
def test_cases(reference, text):
    ours, theirs = reference
    assert ours.ids(text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.ids(text)) == text
    assert ours.count(text) == len(ours.ids(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_any_text(reference, text):
    ours, theirs = reference
    assert ours.ids(text) == theirs.encode_ordinary(text)


def test_merges_by_brute_force():
    """On a small vocabulary, against merging the lowest pair anew each time."""
    rng = random.Random(5)
    ranks = {bytes([c]): c for c in range(97, 101)}
    while len(ranks) < 40:
        a, b = rng.choices(list(ranks), k=2)
        ranks.setdefault(a + b, 200 + len(ranks))
    for _ in range(500):
        part = bytes(rng.choices(range(97, 101), k=rng.randint(1, 30)))
        parts = [part[i : i + 1] for i in range(len(part))]
        while part not in ranks:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want = [ranks[part]] if part in ranks else [ranks[p] for p in parts]
        assert bpe.merge(part, ranks) == want


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_PARTS", 10)
    t = bpe.Tokenizer(PATH)
    t.ids(" ".join(f"word{i}x" for i in range(100)))
    assert len(t.parts) <= 10


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "Fever of 39", "x"), (2, "", "x"), (3, None, None), (1, "Fever of 39", "y")], "doc_id long, text string, ids string")
    rows = [(r["doc_id"], r["ids"]) for r in encoding.encode(df, "doc_id", "text").orderBy("doc_id").collect()]
    t = bpe.Tokenizer(PATH)
    assert rows == [(1, t.ids("Fever of 39"))] * 2 + [(2, []), (3, [])]
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0
    back = encoding.decode(encoding.encode(df, "doc_id", "text"), "doc_id", "ids").orderBy("doc_id").collect()
    assert [r["text"] for r in back] == ["Fever of 39", "Fever of 39", "", ""]
    counted = encoding.count_tokens(df, "text", count="ids").orderBy("doc_id").collect()
    assert [r["ids"] for r in counted] == [len(t.ids("Fever of 39"))] * 2 + [0, 0]


ARTICLES = "article_id long, title string, url string, source string, content string, lang string, cleaned_at timestamp_ntz, host string"


def articles(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(i, "t", u, s, c, g, None if d is None else dt.datetime(2026, 1, d), "clash") for i, u, s, c, g, d in rows], ARTICLES)


ROWS = [
    (1, "https://www.A.example/x?y", " The  Site ", "one two", "EN", 1),
    (1, "https://www.A.example/x?y", " The  Site ", "one two three", "EN", 2),
    (2, "//m.a.example:80/", "the site", "one two", "en-GB", None),
    (3, None, None, None, "und", 3),
    (4, "no host", "", "", None, 3),
    (None, "http://b.example", "b", "x", "ar", 1),
    (None, "http://b.example", "b", "x", "ar", 1),
]


def cube(ledger):
    return {tuple(r)[:3]: (r["n_articles"], r["n_tokens"]) for r in ledger.cube.collect()}


def test_budget(spark):
    t = bpe.Tokenizer(PATH)
    got = cube(token_budget.update(token_budget.Ledger(), articles(spark, ROWS)))
    assert got == {("the site", "en", "a.example"): (2, t.count("one two three") + t.count("one two")), ("unknown", "unknown", "unknown"): (2, 0), ("b", "ar", "b.example"): (1, t.count("x"))}


def test_signed_deltas(spark, monkeypatch):
    full = articles(spark, ROWS)
    base = token_budget.update(token_budget.Ledger(), full)
    changed = articles(spark, [ROWS[1], (2, "//m.a.example", "the site", "one two four", "en", 5), (7, None, "new", "one two", "ar", 1)])
    seen = []
    real = token_budget.count_tokens
    monkeypatch.setattr(token_budget, "count_tokens", lambda df, *a, **k: seen.append(sorted(r["t"] for r in df.collect())) or real(df, *a, **k))
    after = token_budget.update(base, changed)
    assert seen == [["one two four"]], "known contents are not encoded again"
    assert cube(after) == cube(token_budget.update(token_budget.Ledger(), changed))
    gone = token_budget.update(after, full.limit(0))
    assert cube(gone) == {}
    assert token_budget.totals(base.cube).where("source = '*' and lang = '*' and host = '*'").first()["n_articles"] == 5


def test_ledger_is_saved_and_opened(spark, tmp_path):
    path = str(tmp_path / "ledger")
    full = articles(spark, ROWS)
    assert token_budget.open_ledger(spark, path).cube is None
    token_budget.save(token_budget.update(token_budget.Ledger(), full), path)
    changed = full.limit(3)
    opened = token_budget.open_ledger(spark, path)
    after = token_budget.update(opened, changed)
    assert after.fresh.count() == 0  # all contents were counted before
    token_budget.save(after, path, opened=path)
    again = token_budget.open_ledger(spark, path)
    assert cube(again) == cube(token_budget.update(token_budget.Ledger(), changed))
    assert again.counts.count() == opened.counts.count()
    gone = token_budget.update(again, full.limit(0))
    assert gone.cube.count() == 0


def test_repeated_contents_are_counted_once_a_task(spark):
    rows = spark.createDataFrame([(b"a", "x y"), (b"a", "x y"), (b"b", "")], "h binary, t string").coalesce(1)
    assert sorted((bytes(r["h"]), r["n_tokens"]) for r in token_budget.count_tokens(rows, "t", PATH).collect()) == [(b"a", 2), (b"b", 0)]
