import random
import re

import numpy as np

from quarryline.llm import near_duplicates as nd


def shingles(t, width=3):
    w = re.findall(r"[^\W_]+", t.lower())
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= 12 else None


def brute(rows, similarity=0.6):
    sets = {k: s for k, t in rows if k is not None and t and (s := shingles(t))}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def sample(n=60, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        base = rng.choices(words, k=rng.randint(8, 60))
        for v in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"e{g:03d}_{v}", " ".join(t)))
    return rows + [("n", None), ("m", ""), (None, rows[0][1]), rows[0], ("short", "a b c")]


def test_design():
    lines = nd.design(4)
    assert lines.shape == (64, 4) and all(len(set(x)) == 4 for x in lines.tolist())
    assert max(len(set(a) & set(b)) for i, a in enumerate(lines.tolist()) for b in lines.tolist()[:i]) <= 1
    assert nd.miss_rate(0.7) < 0.0005


def test_fingerprints_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    agree = []
    for k in range(40):
        x, y = np.unique(nd._mix(a + np.uint64(k))), np.unique(nd._mix(b + np.uint64(k)))
        p = nd.fingerprints(np.concatenate([x, y]), np.array([0, len(x)]))
        agree.append((p[0] == p[1]).mean())
    assert abs(np.mean(agree) - 0.6) < 0.03


def test_pairs_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "evidence_id string, text string, digest string").repartition(3)
    got = [tuple(r) for r in nd.similar_pairs(df).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want) and len(want) > 50
    assert nd.similar_pairs(df.limit(0)).count() == 0


def test_crowded_anchors_are_split(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(80)] = f"x{i}"
        rows.append((f"a{i:02d}", " ".join(t)))
    df = spark.createDataFrame(rows, "evidence_id string, text string")
    for block in (7, 1000):
        assert {tuple(r) for r in nd.similar_pairs(df, crowded=8, block=block).collect()} == brute(rows)


def test_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"c{i:02d}", text) for i in range(10)] + [("z", text + " more")]
    df = spark.createDataFrame(rows, "evidence_id string, text string")
    assert {tuple(r) for r in nd.similar_pairs(df).collect()} == brute(rows)
    star = {tuple(r) for r in nd.similar_pairs(df, copies=4).collect()}
    assert star == {("c00", f"c{i:02d}") for i in range(1, 10)} | {("c00", "z")}
    groups = {r["id"]: (r["group_id"], r["n_links"]) for r in nd.classes_of(nd.similar_pairs(df, copies=4), df.select("evidence_id")).collect()}
    assert {g for g, _ in groups.values()} == {"c00"} and groups["z"] == ("c00", 1)


def test_only_exact_copies_form_a_star(spark):
    """Texts that differ in case and marks share a class, but give all their pairs; links are counted whole."""
    text = " ".join(f"w{i}" for i in range(30))
    copies = [(f"c{i:02d}", text) for i in range(6)]
    rows = copies + [(f"d{i}", text.upper().replace(" ", "," * (i + 1))) for i in range(5)] + [("z", text + " more"), ("q", "too short")]
    df = spark.createDataFrame(rows, "evidence_id string, text string")
    inner = {(a, b) for a, b in brute(copies) if a != "c00"}
    assert {tuple(r) for r in nd.similar_pairs(df, copies=4, every_copy=True).collect()} == brute(rows) - inner
    later = {(a, b) for a, b in brute(rows) if len({a, b} & {k for k, _ in copies[1:]}) == 1 and "c00" not in (a, b)}
    assert {tuple(r) for r in nd.similar_pairs(df, copies=4).collect()} == brute(rows) - inner - later
    groups = {r["id"]: (r["group_id"], r["n_links"]) for r in nd.similar_groups(df).collect()}
    assert groups == {k: ("q", 0) if k == "q" else ("c00", 11) for k, _ in rows}


def test_groups_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i != 30], "id_a string, id_b string")
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(62)] + [(None,)], "id string")
    got = {r["id"]: r["group_id"] for r in nd.classes_of(pairs, ids).collect()}
    assert got["030"] == "000" and got["060"] == "031" and got["061"] == "061" and len(got) == 62


def test_hot_anchors_change_no_pair(spark, monkeypatch):
    rows = sample(20, seed=5)
    df = spark.createDataFrame(rows, "evidence_id string, text string").repartition(3)
    monkeypatch.setattr(nd, "HOT_SAMPLE", 1)
    monkeypatch.setattr(nd, "HOT_LEAST", 3)
    marked = nd._fingerprinted(df, "evidence_id", "text", 3, 12)
    assert len(nd._hot(marked, 3)) > 0
    assert {tuple(r) for r in nd.similar_pairs(df, classes=21, floor=0).collect()} == brute(rows)


def test_every_line_loses_nothing(spark):
    """At the threshold itself: with all lines and no floor each pair is found."""
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = [f"v{g}_{i}" for i in range(40)]
        other = base[:]
        for at in rng.sample(range(4, 36), 3):
            other[at] = f"o{g}_{at}"
        rows += [(f"a{g:02d}", " ".join(base)), (f"b{g:02d}", " ".join(other))]
    df = spark.createDataFrame(rows, "evidence_id string, text string")
    assert {tuple(r) for r in nd.similar_pairs(df, classes=21, floor=0).collect()} == brute(rows)


def test_copy_classes(spark):
    rows = [("a", "t"), ("b", "t"), ("b", "t"), ("c", "u"), ("d", ""), (None, "t"), ("e", None)]
    got = nd.copy_classes(spark.createDataFrame([(*r, "clash") for r in rows], "evidence_id string, text string, class_id string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("d", "d", 1)]


def test_covering_by_a_perfect_code_costs_half_of_all_pairs():
    assert nd.code_cost(0) == (1.0, 2048 / 2**23)
    spread, share = nd.code_cost(8)  # a third of 25 of 69 bits, which similarity 0.6 asks for
    assert spread > 2000 and share > 0.49


def test_two_groups_of_many_copies(spark):
    """Two near texts of many copies each: no product of both, but each record has the other text's first one, and the classes tell the rest."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"a{i}", text) for i in range(8)] + [(f"b{i}", text + " more") for i in range(7)] + [("c", text + " else")]
    df = spark.createDataFrame(rows, "evidence_id string, text string")
    got = {tuple(r) for r in nd.similar_pairs(df, copies=4, every_copy=True).collect()}
    group = lambda p, n: [f"{p}{i}" for i in range(n)]
    want = {("a0", x) for x in group("a", 8)[1:]} | {("b0", x) for x in group("b", 7)[1:]} | {(x, "c") for x in group("a", 8) + group("b", 7)}
    want |= {(x, "b0") for x in group("a", 8)} | {("a0", y) for y in group("b", 7)}
    assert got == want
    classes = {r["id"]: r["class_id"] for r in nd.copy_classes(df).collect()}
    links = {(classes[x], classes[y]) for x, y in got}
    assert {(x, y) for x, y in brute(rows) if classes[x] == classes[y] or (classes[x], classes[y]) in links} == brute(rows)
