import random

from quarryline.llm import residue

NORMAL = "Keep the {} supported and avoid bright light for 27 days. A specialist may suggest a hearing test to rule out {} infection."


def corpus():
    docs, bad = [], set()

    def add(text, is_bad=False, title=None):
        docs.append((len(docs), text, title))
        if is_bad:
            bad.add(len(docs) - 1)

    for i in range(40):
        add(NORMAL.format(f"part{i}", f"kind{i}"))
        add(f"Author: the ward team\n{NORMAL.format('x', 'y')}")
        add(f"The null hypothesis was kept in {i} trials. In {i} cases the cause stayed undefined. " + NORMAL.format("c" + "x" * i, "d" + "y" * i))
        add("The portal works best with JavaScript, but every leaflet can be read without it. " + NORMAL.format("e" + "x" * i, "f" + "y" * i))
    for i in range(5):
        add(f"Author: null\n{NORMAL.format('x', 'y')}", True)
        add(f"JavaScript is turned off in your browser. Switch it on and reload to read this leaflet.\nMenu\nHome", True)
        add(f"{i} Internal Server Error. The server met an unexpected condition (ref {i}).", True)
    for slot in ["{{ date }}", "${ward}", "%%DATE%%", "[[ward]]", "__DATE__", "{% include 'date' %}", "[DATE]", "«date»", "<WARD>", "&lt;ward&gt;", "{0} {1}", "[Insert ward here]", "*|DATE|*", "%(date)s"]:
        add(f"Next visit: {slot}. {NORMAL.format('x', 'y')}", True)
    for text in ["Lorem ipsum nisti fluvent ut exa.", "This is placeholder copy, replace it before going live.", "asdf asdf asdf qwer qwer", "See [object Object] for the full leaflet.", "Ward: #REF!", "Your dose is NaN mg twice a day.", "Hello , your visit is on  at ."]:
        add(text + "\n" + NORMAL.format("p", "q"), True)
    for text in ["Readings [1], [2] and [sic] are quoted as printed.", "Let the set of doses be {5, 10, 20} mg.", "A pressure < 90 or > 140 mmHg needs care.", "<br/> line", "Price: $12", "!!!???", "Set the pump mode to %BASAL only after 24 h.", "The word lorem in old labels means strap.", "Placeholder pills were given to 185 people.", "", " \n", None, "a few words", "x" * 100_000]:
        add(text)
    return docs, bad


def test_residue(spark):
    docs, bad = corpus()
    df = spark.createDataFrame([(*d, "clash") for d in docs] + [(*docs[0], "again")], "doc_id long, text string, title string, reason string").repartition(4)
    got = [r["doc_id"] for r in residue.residue(df).collect()]
    assert len(got) == len(set(got))
    assert {docs[i][1] for i in set(got) ^ bad} == set()
    kept = residue.clean_corpus(df)
    assert kept.count() == len(docs) + 1 - len(bad) and kept.columns == df.columns
    assert residue.residue(df.limit(0)).count() == 0


def test_without_titles(spark):
    df = spark.createDataFrame([(1, "{{ x }}"), (2, "fine text"), (None, "fine")], "doc_id long, text string")
    assert [r["doc_id"] for r in residue.residue(df).collect()] == [1]
    assert sorted(r["doc_id"] or 0 for r in residue.clean_corpus(df).collect()) == [0, 2]


def test_frames():
    assert residue.frames("Author: null") == ["author:\x1f"]
    assert residue.frames("x. Reading time: undefined minutes") == ["reading time:\x1fminutes"]


def test_parts_and_rules_agree():
    """What is looked for first leaves out nothing that a rule alone would find."""
    lost_once = ["from {3} to {9}", "due invalid Date", "got [Object object]", "see n/a_x", "takes nan ml", "up nan %", "dolor sit\namet", "sample\xa0text", "a sample\ntext", "stay at  .", "Hello\u2003, come", "seen on\t\tat .", "by\xa0 on", "İnvalıd date", "ſample text", "nan " + " " * 120 + "mg"]
    others = ["{10}", "finance mg", "blood sample", "dolor", "todo bien", "TODO: x", "#VALUE!", "#3", "XXXX", "xxxx", "wait ????", ": ____", "lorem ipsum", "at home.", "on at"]
    rng = random.Random(3)
    mixed = ["".join(rng.choices([*lost_once, *others, " ", ". ", "\n", "\xa0", "İ"], k=4)) for _ in range(2000)]
    for text in [*lost_once, *others, *mixed, *(f"x {{{d}}}" for d in range(10))]:
        low = residue._lowered(text)
        assert len(low) == len(text)
        for rule, bare in ((residue._is_broken, residue._broken), (residue._is_blank, residue._blank), (residue._is_filler, residue._filler)):
            assert rule(text, low) == bool(bare.search(text)), text
    assert all(residue.spans(text) or residue.fixed_reason(text) for text in lost_once)


def test_alignment_alone_finds_template_cases(spark):
    """Without any fixed value: names of variables are induced from slots that other records fill, pages from their repetition."""
    rows, bad = [], set()
    heads = ["Next visit: {}", "Take {} with water.", "Dear {}, your results are ready.", "For more about {}, see below."]
    marks = ["{{{{{}}}}}", "[{}]", "<{}>", "%{}%", "«{}»"]
    names = ["ward_name", "dose", "clinic name"]
    for i in range(120):
        rows.append((i, heads[i % 4].format(f"value{chr(97 + i % 26)} of {i}") + "\n" + NORMAL.format("a" + "x" * i, "b" + "y" * i)))
    for i in range(60):
        rows.append((1000 + i, heads[i % 4].format(marks[i % 5].format(names[i % 3])) + "\n" + NORMAL.format("c" + "x" * i, "d" + "y" * i)))
        bad.add(1000 + i)
    words = "zero one two three four five six seven eight nine".split()
    for i in range(20):  # a page of more than 60 words, met with different menus
        rows.append((2000 + i, words[i % 10] + " home\n" + "The server was asked for a leaflet that it could not hand out. " + "Nothing is wrong with your own device, and nothing that you wrote was lost on the way to us. " * 3 + "Come back later.\n" + words[i // 10] + " map"))
        bad.add(2000 + i)
    rows += [(3000 + i, f"Values in [brackets] are medians [{i}]. " + NORMAL.format("e" + "x" * i, "f" + "y" * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in residue.residue(df, fixed=False).collect()}
    assert not got - bad and len(got & bad) >= 0.9 * len(bad)


def test_long_notice_and_learnt_filler(spark):
    """Pages of any length are judged; words of filler are learnt from its fixed sentences."""
    latin = "velum ode caram silpa nisti fluvent"
    rows = [(i, f"Lorem ipsum {latin}.") for i in range(5)] + [(10, "Ode velum nisti caram silpa.\n" + NORMAL.format("x", "y")), (11, NORMAL.format("p", "q"))]
    page = "Traceback (most recent call last):\n" + "\n".join(f'File "view{i}.py" raised an exception while the session was not found' for i in range(12))
    rows += [(20, page), (21, page)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["reason"] for r in residue.judged(df).collect()} == {**{i: "filler" for i in range(5)}, 10: "filler", 11: None, 20: "notice", 21: "notice"}


def test_copies_under_other_titles_are_no_template(spark):
    text = "Sessions of exercise may end in an error of posture. " + NORMAL.format("knee", "joint")
    rows = [(i, text, f"Title {'x' * i}") for i in range(9)] + [(20 + i, f"Your session has ended. Sign in again.\nmenu {'y' * i} of this site.", None) for i in range(6)]
    got = {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, title string")).collect()}
    assert not got & set(range(9))


def test_slots_anywhere_in_a_segment(spark):
    """Frames are aligned at every place of a segment, in every line of a text, also where a text goes on in another piece."""
    deep = "We would like to tell all of our patients that the clinic on floor {} is closed today"
    more = "Please remember for the whole of the coming winter that the ward named {} has moved to the new building beside the river"
    lines = "\n".join(f"Line {'z' * (i % 50)} says that the ward is open." for i in range(3000))  # many lines before the slot
    rows = [(i, f"{NORMAL.format('z' * i, 'y')} {deep.format('abcdefgh'[i])}.\n{more.format('elm oak ash fir yew may box bay'.split()[i])}.", None) for i in range(8)]
    rows += [(100, deep.format("none"), "empty"), (101, f"{lines}\n{deep.format('undefined')}.", "empty"), (102, NORMAL.format("p", "q") + " " + more.format("null"), "empty")]
    rows += [(103, "In the trial that they had begun a year before, none was harmed by it", None), (104, "A word at the end of a sentence that stands alone is none", None)]
    rows += [(110, more.format("[ward_x]"), "slot"), (111, deep.format("[ward_x]"), "slot")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = {i: reason for i, _, reason in rows}
    assert {r["doc_id"]: r["reason"] for r in residue.judged(df).collect()} == want
    assert {r["doc_id"]: r["reason"] for r in residue.judged(df, fixed=False).collect()} == want


def test_alignment_agrees_with_brute_force(spark):
    """Counts of texts by frame, with pieces so small that texts are cut, against words compared one by one."""
    rng = random.Random(5)
    texts = ["\n".join("".join(rng.choice("abc") + rng.choice([" ", " ", " ", ". ", ", ", "! "]) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    want, asked = {}, {}
    for text in texts:
        keys = set()
        for segment in (s for line in text.split("\n") for s in residue.sentences(" ".join(line.split()))):
            words = segment.split()
            for k in range(1, len(words)):
                head, rest = words[max(0, k - residue.HEAD) : k], words[k + 1 : k + residue.REACH]
                keys.update((tuple(head), t) for t in ("", *(w.strip(residue._edges) for w in rest)))
        for key in keys:
            want[key] = want.get(key, 0) + 1
    for head, tail in want:
        h = 0
        for word in head:
            h = residue._longer(h, word)
        asked[head, tail] = residue._signed(h), residue._signed(residue._words[tail]) if tail else 0
    others, _ = residue._others(residue._texts(spark.createDataFrame([(t,) for t in texts], "text string"), "text"), spark.createDataFrame(list(asked.values()), "h long, tail long"), set(), at_once=7)
    got = {(r["h"], r["tail"]): r["other"] for r in others.collect()}
    assert {k: got.get(v, 0) for k, v in asked.items()} == want


def test_filler_behind_a_word_that_is_none(spark):
    rows = [(i, "Lorem ipsum velum ode caram silpa fluvent.") for i in range(5)] + [(10, f"{NORMAL.format('x', 'y')}\nNisti fluvent fluvent ode caram velum silpa."), (11, "Nisti fluvent ward open caram.")]
    got = {r["doc_id"]: r["reason"] for r in residue.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: "filler" for i in range(5)}, 10: "filler", 11: None}
