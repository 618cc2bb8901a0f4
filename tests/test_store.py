import pytest
from pyspark.sql import functions as F

from quarryline import settings
from quarryline.operators import ingest, store
from quarryline.sources import files


def test_collections(spark, tmp_path):
    known = store.Collections(spark, str(tmp_path / "kb"))
    assert known.names() == [] and not known.exists("a")
    with pytest.raises(store.MissingCollection, match="there are"):
        known.read("a")
    known.create("a", "point_id string, text string, vector array<float>")
    points = spark.createDataFrame([("1", "x", [1.0]), ("2", "y", [2.0]), (None, "n", None)], "point_id string, text string, vector array<float>")
    assert {r["state"]: r["n"] for r in known.upsert("a", points).collect()} == {"new": 2}
    more = spark.createDataFrame([("2", "z", [3.0]), ("3", None, None)], points.schema)
    assert {r["state"]: r["n"] for r in known.upsert("a", more, dry_run=True).collect()} == {"new": 1, "updated": 1, "kept": 1}
    assert known.read("a").count() == 2
    known.upsert("a", more)
    assert sorted((r["point_id"], r["text"]) for r in known.read("a").collect()) == [("1", "x"), ("2", "z"), ("3", None)]
    found = known.lookup("a", spark.createDataFrame([("2",), ("9",)], "point_id string"))
    assert found.columns == ["point_id", "text"] and [tuple(r) for r in found.collect()] == [("2", "z")]
    assert [r["point_id"] for r in known.scroll("a", 2).collect()] == ["1", "2"] and known.scroll("a").count() == 3
    known.create("a", "point_id string, text string", "upsert")
    assert known.read("a").count() == 3
    known.create("a", "point_id string, text string", "clean")
    assert known.read("a").count() == 0 and known.names() == ["a"]
    with pytest.raises(ValueError):
        known.create("a", "x int", "other")


def test_state(spark):
    log = [("n", "k", '{"s":"a"}', 1, False), ("n", "k", '{"s":"b"}', 2, None), ("n", "gone", '{"s":"a"}', 1, False), ("n", "gone", None, 2, True), ("m", "k", '{"s":"b"}', 1, False), (None, "k", "{}", 1, False), ("n", "again", None, 1, True), ("n", "again", "broken", 2, False)]
    now = store.state_now(spark.createDataFrame(log, "namespace string, key string, value string, at int, deleted boolean"))
    assert sorted(map(tuple, now.collect())) == [("m", "k", '{"s":"b"}'), ("n", "again", "broken"), ("n", "k", '{"s":"b"}')]
    assert [r["key"] for r in store.state_list(now, "n", s="b").collect()] == ["k"]
    got = store.state_get(now, "n", spark.createDataFrame([("k",), ("gone",)], "key string"))
    assert dict(map(tuple, got.collect())) == {"k": '{"s":"b"}', "gone": None}


def test_counts_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("processed",), ("failed",), ("x",), (None,)], "s string")
    assert tuple(store.outcome_counts(rows, F.col("s")).first()) == (4, 1, 0, 1)
    path = str(tmp_path / "t")
    assert files.write_points(rows, path, dry_run=True) == 4 and not files.exists(spark, path)
    assert files.write_points(rows, path) == 4
    files.replace_table(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_files_in_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.json").write_text('{"title": "%s"}' % name)
    rows = files.in_file_order(files.read_articles(spark, str(tmp_path))).collect()
    assert [r["title"] for r in sorted(rows, key=lambda r: r["file_no"])] == ["a", "b", "c"]


def test_scraped(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("down")
        return None if "none" in url else f"<article>{url}</article>"

    got = ingest.scraped(ingest.page_specs(spark, {"s": ["u1", "bad", "none"]}), fetch).collect()
    assert sorted((r["url"], r["status"], r["html"], r["error"]) for r in got) == [("bad", "failed", None, "OSError: down"), ("none", "skipped", None, ""), ("u1", "processed", "<article>u1</article>", "")]


def test_settings(spark):
    assert settings.load({}) == settings.Settings()
    got = settings.load({"QUARRYLINE_TOP_K": "7", "QUARRYLINE_TRACING": "on", "QUARRYLINE_MODEL": " "}, "QUARRYLINE_MODEL='m'\n# c\nQUARRYLINE_TOP_K=9")
    assert (got.top_k, got.tracing, got.model) == (7, True, "m")
    for bad in ({"QUARRYLINE_TRACING": "maybe"}, {"QUARRYLINE_EMBEDDER": "other"}):
        with pytest.raises(ValueError):
            settings.load(bad)
    assert settings.key_list(" a, b,,a ") == settings.key_list([" a", "b", "a"]) == ["a", "b"] and settings.key_list(None) == []
    seen = []
    with settings.span("s", True, seen.append, x=1) as state:
        state["n"] = 2
        state["skipped"] = object()
    with settings.span("t", False, seen.append):
        pass
    assert seen == [{"span": "s", "x": 1, "n": 2}]
    df, seen = settings.observed(spark.range(5), "o")
    df.collect()
    assert seen.get["rows"] == 5
    assert settings.status_report(spark, settings.Settings(), ["medical_kb"]).first()["ready"]


def test_titles_and_lengths(spark):
    df = spark.createDataFrame([("Recommendations", "ng1"), ("Unknown", "ng2"), ("Own", "ng3")], "t string, g string")
    assert [r[0] for r in df.select(ingest.nice_title(F.col("t"), F.col("g"))).collect()] == ["NG1 Recommendations", "NICE Guideline NG2", "Own"]
    assert [r[0] for r in spark.createDataFrame([("Mayo Clinic",), ("NHS",), (None,)], "f string").select(ingest.source_name(F.col("f"))).collect()] == ["mayo", "nhs", None]


def test_pieces_count_each_part_once():
    text = " ".join(f"w{i}" for i in range(50_000))
    pieces = ingest.split_text(text, 500, 50)
    assert all(len(p.split()) <= 500 for p in pieces) and pieces[1].split()[:50] == pieces[0].split()[-50:] and pieces[-1].endswith("w49999")
