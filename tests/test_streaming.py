import datetime as dt
import os

from pyspark.sql import functions as F

from quarryline.operators import sessions
from quarryline.sources import files
from quarryline.streaming import state


def drain(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_lease_steps():
    s, ok = state.lease_step(("", 0.0, 0), "claim", 10.0, 300)
    assert ok and s == ("processing", 10.0, 1)
    assert state.lease_step(s, "claim", 100.0, 300)[1] is False
    assert state.lease_step(s, "claim", 611.0, 300) == (("processing", 611.0, 2), True)
    failed, _ = state.lease_step(s, "fail", 20.0, 300)
    assert state.lease_step(failed, "claim", 21.0, 300)[0] == ("processing", 21.0, 2)
    done, _ = state.lease_step(s, "complete", 20.0, 300)
    assert state.lease_step(done, "claim", 9999.0, 300)[1] is False


def test_stream_fold_equals_batch(spark, tmp_path):
    state.use_rocksdb(spark)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f"u{i % 3}", t0 + dt.timedelta(seconds=i), ["I have a headache", "for 2 days", "with nausea", "age 40"][i // 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "u string, at timestamp, t string")
    for i in range(2):
        df.where((F.col("at") < t0 + dt.timedelta(seconds=6)) == (i == 0)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(state.inquiry_stream(stream, "u", "at", "t"), "folded", str(tmp_path / "ck"))
    want = sessions.inquiry_fold(df, "u", "at", "t")
    key = lambda r: (r["u"], r["turn_no"], tuple(r["symptoms"]), r["severity"], r["score"], r["status"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_dedup_stream(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("a", t0), ("a", t0), ("b", t0)], "k string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r["k"] for r in drain(state.deduplicated(stream, "k", "at"), "deduped", str(tmp_path / "ck")).collect()) == ["a", "b"]


def test_json_articles(spark, tmp_path):
    os.makedirs(tmp_path / "raw/mayo")
    (tmp_path / "raw/mayo/a.json").write_text('{\n"title": "T", "url": "u", "source": "S", "content": "c"}')
    (tmp_path / "raw/mayo/b.json").write_text("{broken")
    rows = sorted(files.read_articles(spark, str(tmp_path / "raw")).collect(), key=lambda r: r["file"])
    assert rows[0]["title"] == "T" and rows[0]["source_dir"] == "mayo" and rows[1]["title"] is None
    files.write_articles(files.read_articles(spark, str(tmp_path / "raw")).drop("file"), str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out/source_dir=mayo") and files.exists(spark, str(tmp_path / "out"))


def test_silent_users_are_forgotten(spark, tmp_path):
    """After 30 minutes an inquiry begins anew, in batch and stream alike, and the state leaves the store."""
    state.use_rocksdb(spark)
    t0 = dt.datetime(2026, 1, 1)
    said = [(0, "I have a headache"), (10, "for 2 days"), (50, "with nausea"), (75, "age 40"), (200, "again"), (300, "end")]
    df = spark.createDataFrame([("u", t0 + dt.timedelta(minutes=m), t) for m, t in said], "u string, at timestamp, t string")
    for m, _ in said:
        df.where(F.col("at") == F.lit(t0 + dt.timedelta(minutes=m))).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.inquiry_stream(stream, "u", "at", "t").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    key = lambda r: (r["at"], r["turn_no"], tuple(r["symptoms"]), r["score"], r["session_version"])
    want = sorted(map(key, sessions.inquiry_fold(df, "u", "at", "t").collect()))
    assert sorted(map(key, spark.table("silent").collect())) == want
    assert [w[1] for w in want] == [0, 1, 0, 1, 0, 0]


def test_sessions_of_a_hot_user(spark):
    """Spans are stitched: the same numbers whatever the span, ties and null moments too."""
    import random

    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"u{i % 7}", None if i % 50 == 0 else dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randint(0, 6000)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "u string, at timestamp, i int")
    want = {}
    for u in {r[0] for r in rows}:
        no, last, first = 0, None, True
        for _, at, i in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1] is not None, r[1] or dt.datetime.min)):
            if not first and at is not None and (last is None or at - last > dt.timedelta(minutes=30)):
                no += 1
            want[i], last, first = no, at, False
    for span in (600, 86_400, 10**9):
        assert {r["i"]: r["session_no"] for r in sessions.sessionized(df, "u", "at", span=span).collect()} == want
