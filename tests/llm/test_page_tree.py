from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import page_tree

NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(12)) + "</ul></nav>"
COOKIE = "<div class='c'><p>We use cookies. <a href='/c'>Manage cookies</a> <a href='/r'>Reject</a></p></div>"
P = "<p>This is paragraph {} of the article, which speaks about one thing at length and has a <a href='/x'>link</a> in it. It goes on for another sentence.</p>"
SIDE = "<aside><h3>Related</h3><ul>" + "".join(f"<li><a href='/r{i}'>Another page about something {i}</a></li>" for i in range(8)) + "</ul></aside>"
FOOT = "<footer><a href='/a'>About</a> <a href='/t'>Terms</a><p>Copyright <a href='/l'>legal</a></p></footer>"


def page(article, after=""):
    return f"<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body>{COOKIE}{NAV}<div><div>{article}</div>{SIDE}</div>{after}{FOOT}</body></html>"


def lines(first, count):
    return [f"This is paragraph {i} of the article, which speaks about one thing at length and has a link in it. It goes on for another sentence." for i in range(first, first + count)]


def test_article_alone():
    article = "<div><h1>The title</h1>" + "".join(P.format(i) for i in range(6)) + "<h2>Symptoms</h2><ul><li>a dull pain in the knee<li>a fever at night</ul>" + P.format(6) + "</div>"
    got = page_tree.page_text(page(article)).split("\n")
    assert got == ["The title", *lines(0, 6), "Symptoms", "a dull pain in the knee", "a fever at night", *lines(6, 1)]


def test_article_in_two_parts():
    article = "<div>" + "".join(P.format(i) for i in range(4)) + f"</div><div class='ad'><a href='/ad'>Buy this</a></div><div>" + "".join(P.format(i) for i in range(4, 8)) + "</div>"
    assert page_tree.page_text(page(article)).split("\n") == lines(0, 8)


def test_density_decides(monkeypatch):
    """With all densities alike the article can't be told from what is around it."""
    article = "<div>" + "".join(P.format(i) for i in range(6)) + "</div>"
    right = page_tree.page_text(page(article))
    monkeypatch.setattr(page_tree, "density", lambda *a: 1.0)
    assert page_tree.page_text(page(article)) != right


def test_measures():
    tree, own, sums = page_tree.measured("<body><div><p>abcd</p><p>efgh</p></div><a>links</a></body>")
    at = {t: i for i, t in enumerate(tree.tags)}
    assert own[at["a"]] == 0 and own[at["div"]] > 0 and abs(sums[at["div"]] - 2 * own[at["p"]]) < 1e-9


def test_odd_pages(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no tags <at all", "x"), (4, "<p>one<p>two <b>bold</b> word", "x"), (4, "<p>one<p>two <b>bold</b> word", "x"), (5, "<div>" * 3000 + "deep" + "</div>" * 3000, "x"), (None, "<p>k</p>", "x"), (6, "<script>only()</script>", "x")]
    df = spark.createDataFrame(rows, "id long, html string, text string")
    got = [tuple(r) for r in page_tree.html_content(df, "id").collect()]
    assert len(got) == 8 and dict(got)[1] is None and dict(got)[2] == "" and dict(got)[6] == "" and dict(got)[5] == "deep" and dict(got)[None] == "k"
    assert got.count((4, "one\ntwo bold word")) == 2 and dict(got)[3].startswith("no tags")
    assert page_tree.html_content(df.limit(0), "id").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<ul>", "<li>", "some text here", "<br/>", "<script>", "</script>", "&amp;", "<"]), max_size=40))
def test_any_markup(parts):
    assert isinstance(page_tree.page_text("".join(parts)), str)
