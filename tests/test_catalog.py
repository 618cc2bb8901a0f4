import __spark_entry__ as entry
from quarryline import catalog


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_plans(spark, data):
    index = catalog.QUERIES["build_index"](spark, data)
    assert index.count() > 0 and index.where("dimension <> 256").count() == 0
    routes = catalog.QUERIES["route"](spark, data)
    assert routes.where("n <= 0").count() == 0


def test_guard_judges_cleaned_texts(spark, data):
    rows = spark.read.parquet(f"{data}/articles.parquet").select("article_id", "cleaned_at", "content")
    cleaned = catalog.QUERIES["clean_text"](spark, data)
    want = []
    for (i, at, old), (j, _, new) in zip(rows.collect(), cleaned.collect(), strict=True):
        assert i == j
        want.append((i, at, old if old and old.strip() and len(new.strip()) < 0.5 * len(old.strip()) else new))
    got = [tuple(r) for r in catalog.QUERIES["clean_guard_cleaned"](spark, data).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(c and len(c) > 400 for _, _, c in got)
