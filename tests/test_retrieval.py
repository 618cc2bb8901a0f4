import numpy as np

from quarryline.operators import retrieval


def table(spark, n=300, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    words = "pain knee fever child dose night rash cold".split()
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 6))), [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", [0.0] * dim), (None, "pain", [1.0] * dim), (n + 2, "PAIN " * 50, None)]
    return spark.createDataFrame(rows, "id long, text string, vector array<double>"), rows


def brute_dense(queries, rows, limit):
    out = set()
    for q, _, v in queries:
        if q is None or v is None:
            continue
        scores = []
        for i, _, p in rows:
            if i is not None and p is not None:
                norm = np.linalg.norm(v) * np.linalg.norm(p)
                scores.append((-round(float(np.dot(v, p) / norm) if norm else 0.0, 6) + 0.0, i))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:limit])}
    return out


def brute_lexical(queries, rows, limit):
    out = set()
    for q, t, _ in queries:
        words = set((t or "").lower().split())
        found = sorted((-sum(w in p.lower() for w in words), i) for i, p, _ in rows if i is not None and p is not None)
        out |= {(q, i, -n, r + 1) for r, (n, i) in enumerate([x for x in found if x[0]][:limit])} if q is not None else set()
    return out


def test_both_legs_in_one_scan_and_in_several(spark, monkeypatch):
    points, rows = table(spark)
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] >= 300]
    queries = spark.createDataFrame(asked, "query_id long, text string, vector array<double>")
    for size, block in ((64 << 20, 2000), (1500, 3)):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        dense = retrieval.dense_topk(queries, points.repartition(5), limit=4)
        assert {(r["query_id"], r["id"], r["dense_rank"]) for r in dense.collect()} == brute_dense(asked, rows, 4)
        lexical = retrieval.lexical_topk(queries, points.repartition(5), limit=4)
        assert {(r["query_id"], r["id"], r["matches"], r["lexical_rank"]) for r in lexical.collect()} == brute_lexical(asked, rows, 4)
    assert retrieval.dense_topk(queries.limit(0), points).count() == retrieval.lexical_topk(queries, points.limit(0)).count() == 0


def test_points_are_scanned_once(spark, tmp_path):
    """One scan of the points however many blocks of queries there are, and each task passes on at most `limit` rows a query."""
    points, rows = table(spark, 2000)
    points.repartition(4).write.parquet(str(tmp_path / "points"))
    stored = spark.read.parquet(str(tmp_path / "points"))
    queries = points.where("id < 40").withColumnRenamed("id", "query_id")
    plan = retrieval.dense_topk(queries, stored, limit=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tmp_path") <= 1 and plan.count("MapInArrow") == 1
    assert retrieval.dense_topk(queries, stored, limit=3).where("dense_rank > 3").count() == 0


def test_strings_as_ids(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("bb", [1.0, 0.0]), ("ccc", [0.0, 1.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>")
    got = [(r["id"], r["dense_rank"]) for r in retrieval.dense_topk(queries, points.repartition(3), limit=2).collect()]
    assert sorted(got) == [("a", 1), ("bb", 2)]


def test_index_recall(spark):
    """Clustered vectors: few probes find nine tenths of the exact neighbours; every point is indexed, crowded cells in parts."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centers[i % 20] + 0.3 * rng.normal(size=16)]) for i in range(2000)]
    points = spark.createDataFrame([*rows, (5000, None)], "id long, vector array<double>")
    queries = points.where("id % 49 = 0").withColumnRenamed("id", "query_id")
    centroids, probes = retrieval.fit_index(points, cells=40)
    index = retrieval.dense_index(points, centroids, cell=30)
    assert index.count() == 2000 and index.agg({"part": "max"}).first()[0] > 0 and probes < 20
    found = {(r["query_id"], r["id"]) for r in retrieval.dense_search(queries, index, centroids, probes, limit=10).collect()}
    exact = {(r["query_id"], r["id"]) for r in retrieval.dense_topk(queries, points, limit=10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert retrieval.indexed_topk(queries, points.limit(0)).count() == 0
