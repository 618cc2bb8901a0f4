import random
import re
from collections import defaultdict

from quarryline.llm import main_content, repeated_lines


def brute(rows, spread=6):
    occurs, lines = defaultdict(set), []
    for a, s, c in rows:
        if a is None or s is None or c is None:
            continue
        for no, line in enumerate(c.split("\n")):
            key = re.sub(r"\d+", "0", " ".join(line.split()).lower())
            if len(key.split()) >= 5:
                occurs[" ".join(s.split()).lower(), key].add(a)
                lines.append((a, no, (" ".join(s.split()).lower(), key)))
    return {(a, n) for a, n, k in lines if len(occurs[k]) >= spread}


def sample(seed=1, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("Alpha beta gamma delta 17 epsilon zeta".split(), k=rng.randint(3, 8))) for _ in range(25)]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool).replace(" ", rng.choice([" ", "\xa0", "  "])).replace("17", str(rng.randint(1, 99))) for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice(["One", " one ", "TWO", None, "three"]), rng.choice(["\n", "\r\n"]).join(lines)))
    return rows + [(5, "One", rows[5][2]), (None, "One", rows[3][2]), (99, "One", None), (98, "two", "")]


def test_repeated_lines(spark):
    for seed in (1, 2):
        rows = sample(seed)
        df = spark.createDataFrame([(*r, "clash") for r in rows], "article_id long, source string, content string, line_no string").repartition(5)
        got = [tuple(r) for r in repeated_lines.repeated_lines(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def test_blocks_meet_across_tasks(spark):
    """A line once in each of six tasks is found, in five it isn't; blocks of two lines likewise."""
    rows = [(i, "s", "a b c d e\nf g h i j" if i < 6 else f"a b c d e\nx y z w {'v' * i}") for i in range(8)] + [(20 + i, "s", "k l m n o") for i in range(5)]
    df = spark.createDataFrame(rows, "article_id long, source string, content string").repartition(13, "article_id")
    lengths = [r["length"] for r in repeated_lines.repeated_blocks(df, "article_id", "source", "content", 6, 5, 3).collect()]
    assert sorted(lengths) == [1, 1, 2]


def test_cleaned(spark):
    rows = [(i, "s", f"a b c d e\nown line number {chr(97 + i)}\nshort") for i in range(6)] + [(9, None, "a b c d e"), (10, "s", None)]
    df = spark.createDataFrame(rows, "article_id long, source string, content string")
    got = {r["article_id"]: (r["content"], r["n_removed"]) for r in repeated_lines.without_repeated_lines(df).collect()}
    assert got[0] == ("own line number a\nshort", 1) and got[9] == ("a b c d e", 0) and got[10] == (None, 0) and len(got) == 8


def test_blocks_decide_what_is_cleaned(spark):
    """Short lines go with a block of several; a line of it alone, or the block in five documents, stays."""
    rows = [(i, "s", f"Home\n\nAbout us {i}\nLog in\nown text of {'v' * i}\nHome\nown line {'w' * i}") for i in range(6)] + [(20 + i, "s", f"Share\nSend to a friend\nend {'x' * i}") for i in range(5)]
    df = spark.createDataFrame(rows, "article_id long, source string, content string").repartition(7, "article_id")
    clean = lambda depth: {r["article_id"]: (r["content"], r["n_removed"]) for r in repeated_lines.without_repeated_lines(df, depth=depth).collect()}
    whole, single = clean(None), clean(1)
    assert whole[2] == ("own text of vv\nHome\nown line ww", 4) and whole[21] == (rows[7][2], 0)
    assert single[2] == (rows[2][2], 0)
    assert repeated_lines.repeated_lines(df).count() == 0


def test_depth_loses_no_block(spark):
    """The parts of at most `least_words` lines cover what all blocks of any length cover."""
    rng = random.Random(7)
    pool = [" ".join(rng.choices("a b c d e f".split(), k=rng.randint(1, 6))) for _ in range(6)]
    rows = [(i, rng.choice("st"), "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    occurs = defaultdict(set)
    for a, s, c in rows:
        lines = c.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= 5:
                    occurs[s, tuple(lines[i:j])].add(a)
    want = {}
    for a, s, c in rows:
        lines = c.split("\n")
        gone = {n for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if len(occurs[s, tuple(lines[i:j])]) >= 6 for n in range(i, j)}
        want[a] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    df = spark.createDataFrame(rows, "article_id long, source string, content string").repartition(9, "article_id")
    assert {r["article_id"]: r["content"] for r in repeated_lines.without_repeated_lines(df).collect()} == want


HEAD = ["Menu", "Home", "Log in", "Home > Conditions > {t}"]
FOOT = ["© 2024 {s}. All rights reserved worldwide.", "Up next: {o}", "Site map", "Keep reading", "{o}", "{p}"]
PARA = "This is a paragraph about {} that goes on for quite a while, so that it is longer than any line of a menu would ever be. Rest well."


def pages(n=40):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=3)) + "a" + "".join(rng.choices("bcdlmnrst", k=4))
    out, truth = [], set()
    for i in range(n):
        t, o, p = (f"{word().title()} disease in {rng.choice(['adults', 'winter', 'children'])}" for _ in range(3))
        body = [t, PARA.format(word()), "", "Symptoms", PARA.format(word()), "These may include:", "- fever", "- cough", "", "Treatment", PARA.format(word())]
        fill = lambda x: x.format(t=t, o=o, p=p, s="Harbour")
        head, foot = [fill(x) for x in HEAD], [fill(x) for x in FOOT]
        lines = head + body[:5] + ["Share this page with family, friends or a carer"] + body[5:] + foot
        out.append((i, t, "Harbour", "\n".join(lines)))
        truth |= {(i, k) for k in range(4)} | {(i, 9)} | {(i, 16 + k) for k in range(6)}
    return out, truth


def test_page_furniture(spark):
    rows, truth = pages()
    df = spark.createDataFrame([*rows, (100, "x", "y", None), (101, None, None, ""), (102, None, "z", "Only a word"), rows[0], (None, "t", "s", "x")], "article_id long, title string, source string, content string").repartition(4)
    got = [tuple(r) for r in main_content.page_furniture(df).where("article_id < 100").collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    texts = {r["article_id"]: r["text"] for r in main_content.main_content(df).collect()}
    assert texts[100] is None and texts[101] == "" and texts[3].startswith(rows[3][1]) and texts[3].endswith("Rest well.")
    assert main_content.page_furniture(df.limit(0)).count() == 0


def test_furniture_of_a_small_source(spark):
    """Lines of 8 pages of a small site, one of them over 300 characters, are learnt beside 30,000 other pages."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=3)) + "a" + "".join(rng.choices("bcdlmnrst", k=4))
    consent = "We and our partners keep small files on the device that you read this with, " + "and they tell us which of the pages are read and for how long that is, " * 5 + "which you may decline at any time."
    rows = [(i, f"{word()} {word()}", "big", f"{word()} {word()}") for i in range(30_000)]
    for i in range(8):
        t = f"{word().title()} disease"
        rows.append((90_000 + i, t, " Small  site", "\n".join(["Everything that the valley reads.", "Wards and doctors of the valley", t, PARA.format(word()), PARA.format(word()), "", consent])))
    df = spark.createDataFrame(rows, "article_id long, title string, source string, content string").repartition(4)
    got = {tuple(r) for r in main_content.page_furniture(df).where("article_id >= 90000").collect()}
    assert got == {(90_000 + i, n) for i in range(8) for n in (0, 1, 6)}
    left = {r["n_left_out"] for r in main_content.main_content(df).where("article_id >= 90000").collect()}
    assert left == {3}


def test_list_items_that_counts_take_for_furniture(spark):
    """A list's item that many pages have, often with a banner in between, is no menu: its links leave it a density of its own."""
    rows = []
    for i in range(60):
        items = ["- a dull ache", "- a short fever"] if i % 2 else ["- a short fever", "- a dull ache"]
        lines = ["Menu", "Log in", "Title of page " + "x" * i, PARA.format("y" * i + "a"), "These may include:", items[0], "Advertisement - the text goes on", items[1], "Self care", PARA.format("z" * i + "b"), "Site map"]
        rows.append((i, "Title of page " + "x" * i, "Site", "\n".join(lines)))
    df = spark.createDataFrame(rows, "article_id long, title string, source string, content string")
    gone = {(r["article_id"], r["line_no"]) for r in main_content.page_furniture(df).collect()}
    assert gone == {(i, n) for i in range(60) for n in (0, 1, 6, 10)}


def test_few_pages_of_a_source_are_enough(spark):
    """Whatever share of all pages a line must be on to be known to all, its own source knows it from six pages on."""
    legal = "The trustees of this house answer for nothing that is written in these leaflets"
    rows = [(i, "Title number " + "x" * i, "Small" if i < 6 else "Large", "\n".join([PARA.format("y" * i), *([legal] if i < 6 else []), PARA.format("z" * i)])) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id long, title string, source string, content string")
    site, own = main_content._learnt(df, "content", share=0.9)
    known = {r["h"] for r in own.collect()}
    assert main_content.leaf_key(legal, "", "") not in site.lines and main_content._hash("small", main_content.leaf_key(legal, "", "")) in known
