import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import packing, splitting
from quarryline.llm.splitting import Limits


def items(spark, texts):
    return spark.createDataFrame([("article", str(i), 0, t) for i, t in enumerate(texts)], "item_kind string, item_id string, section_no int, text string")


def make(rng, words):
    return "".join(rng.choice(["wörd", "a", "x" * 30, "كلمة", "b."]) + rng.choice([" ", "  ", "\n", "\n\n", "\xa0", ". "]) for _ in range(words))


@pytest.mark.parametrize("limits", [Limits(), Limits(range_chars=500, halo=32), Limits(words=50, overlap=10, slack=10, range_chars=64, halo=16)])
def test_pieces(spark, limits):
    rng = random.Random(3)
    texts = [make(rng, n) for n in (0, 1, 50, 499, 500, 501, 700, 1500, 4000)] + [" " * 3000, "y" * 5000, None, "  " + "z " * 600 + "\n\n"]
    df = items(spark, texts)
    pieces = splitting.split(splitting.ranges(df.union(df.limit(3)), limits), limits).collect()
    big = {str(i) for i, t in enumerate(texts) if t and len(t.split()) > limits.words}
    assert {p["item_id"] for p in pieces} == big
    assert {r["item_id"] for r in splitting.oversized(splitting.ranges(df, limits), limits).collect()} == big
    for i in big:
        text, got = texts[int(i)], []
        for n, p in enumerate(sorted((p for p in pieces if p["item_id"] == i), key=lambda p: p["piece_no"])):
            words = p["text"].split()
            assert p["piece_no"] == n and text[p["start_pos"] : p["end_pos"]] == p["text"] and len(words) == p["n_words"] <= limits.words
            assert n == 0 or words[: limits.overlap] == got[-limits.overlap :]
            got += words[limits.overlap :] if n else words
        assert got == text.split()


def test_natural_cuts(spark):
    text = "\n\n".join(" ".join(["w"] * 119 + [f"end{i}."]) for i in range(10))
    pieces = splitting.split(splitting.ranges(items(spark, [text]))).orderBy("piece_no").collect()
    assert all(p["text"].endswith(".") for p in pieces)


def test_small_items_are_kept_on_request(spark):
    got = splitting.split(splitting.ranges(items(spark, ["a b", "", None])), keep_small=True).orderBy("item_id").collect()
    assert [(r["item_id"], r["text"], r["n_words"]) for r in got] == [("0", "a b", 2), ("1", "", 0)]
    assert splitting.split(splitting.ranges(items(spark, ["a"]).limit(0))).count() == 0


def test_files(spark, tmp_path):
    text = ("Satz über Äpfel nach 日本 oben. " * 25 + "\n\n") * 60
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    limits = Limits(range_chars=4096)
    got = []
    for n, p in enumerate(splitting.split(splitting.file_ranges(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], limits), limits).orderBy("piece_no").collect()):
        assert text[p["start_pos"] : p["end_pos"]] == p["text"]
        got += p["text"].split()[50:] if n else p["text"].split()
    assert got == text.split()


def test_sections():
    text = "Title of it\nbody one\n\nSelf care, more (x)\nbody two\n\nnot a header\nx\n\nAlso 1 not\ny\n\nEnd"
    assert splitting.sections(text) == ["body one", "body two\n\nnot a header\nx\n\nAlso 1 not\ny", ""]
    assert splitting.sections("a long first line that ends with a full stop.\nb") == ["a long first line that ends with a full stop.\nb"]
    assert splitting.sections("- no heading\nb") == ["- no heading\nb"]
    assert splitting.sections("A\r\n\r\nHeader\r\nb")[0].startswith("Header")


def check(rows, sizes, capacity):
    by, load = {}, {}
    for r in rows:
        by.setdefault(r["k"], []).append((r["offset"], r["size"], r["piece_no"]))
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
    assert set(by) == set(sizes) and max(load.values(), default=0) <= capacity
    for k, parts in by.items():
        parts.sort(key=lambda p: p[2])
        n = sizes[k] or 0
        assert sum(s for _, s, _ in parts) == n and [o for o, _, _ in parts] == [i * capacity for i in range(len(parts))]
        assert len(parts) == max(1, -(-n // capacity))
    full = [v for v in load.values() if v]
    return sum(full) / len(full) / capacity if full else 1.0


@pytest.mark.parametrize("case", ["mixed", "large", "small", "equal", "huge", "empty"])
def test_packing(spark, case):
    rng = np.random.default_rng(6)
    n = {"mixed": rng.integers(0, 900, 3000), "large": rng.integers(1000, 2049, 300), "small": rng.integers(0, 40, 3000), "equal": np.full(500, 512), "huge": rng.integers(0, 30_000, 50), "empty": np.zeros(0, int)}[case]
    sizes = {i: int(x) for i, x in enumerate(n)} | ({-1: None} if case == "mixed" else {})
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "k long, n long, size string").repartition(3)
    fill = check(packing.pack(df, "k", "n").collect(), sizes, 2048)
    assert fill > {"large": 0.6, "huge": 0.9, "small": 0.95}.get(case, 0.97)  # 3,000 small items need 29 containers, one of them half empty


def test_configurations_cover():
    widths, demand = np.array([1900, 1100, 700, 300]), np.array([10, 33, 70, 5])
    got = packing.configurations(widths, demand, 2048)
    assert all((c * widths).sum() <= 2048 for c, _ in got) and (sum(c * t for c, t in got) >= demand).all()


def test_ranks_are_whole(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("size"))
    got = packing._ranked(df, "size", ["k"], 7).collect()
    for s in range(3):
        assert sorted(r["rank"] for r in got if r["size"] == s) == list(range(len([r for r in got if r["size"] == s])))


def test_sums_by_blocks_of_ranges(spark, monkeypatch):
    """An item of many blocks of ranges gives the same pieces as one of a single range."""
    text = "\n".join(f"word{i} and more. Next" for i in range(3000))
    df = spark.createDataFrame([("a", "x", 0, text), ("a", "y", 1, "short one"), ("a", "x", 1, text[:9000])], "item_kind string, item_id string, section_no int, text string")
    monkeypatch.setattr(splitting, "BLOCK", 3)
    rows = []
    for limits in (splitting.Limits(range_chars=700, halo=64), splitting.Limits()):
        rows.append(sorted(map(tuple, splitting.split(splitting.ranges(df, limits), limits).collect())))
    assert rows[0] == rows[1] and len(rows[0]) > 30
