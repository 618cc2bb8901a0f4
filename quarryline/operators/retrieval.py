"""Hybrid retrieval for a table of queries.

Queries are what is asked of all points, so they are held by the tasks and the
points stream past, once for as many queries as fit `QUERY_BYTES`. A task keeps
a running best list for each query; what it passes on is `limit` rows a query,
however many points it reads. Where all points are too many to be compared,
`dense_index` places them by centroids and `dense_search` compares a query with
the nearest cells only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .store import materialize

#: Fixed values of the reference configuration.
RRF_K, LIST_LIMIT, TOP_K, FLOOR, THRESHOLD = 60, 15, 5, 0.03, 0.2
#: Bytes of queries that one scan of the points takes with it, as they lie in memory.
QUERY_BYTES = 64 << 20
#: Queries and points that are compared at a time; what this costs is a matrix of both.
QUERY_BLOCK, POINT_BLOCK = 2_000, 2_048


def _scans(queries: DataFrame, cost) -> list[DataFrame]:
    """The queries in parts of at most about QUERY_BYTES, by hash; cost is the bytes of one query. They are written down first, to be worked out once."""
    held = materialize(queries.where("query_id is not null"), "queries")
    total = held.agg(F.sum(cost)).first()[0] or 0
    parts = max(1, -(-total // QUERY_BYTES))
    return [held.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [held]


class _Best:
    """The best `limit` points of each of n queries so far: highest score, ties by id."""

    def __init__(self, n: int, limit: int):
        self.limit = limit
        self.scores = np.full((n, 0), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores (queries from `first` on x points); -inf is no match."""
        n, m = scores.shape
        if not m:
            return
        if self.ids is None:
            self.ids = np.zeros((len(self.scores), self.limit), ids.dtype)
            self.scores = np.full((len(self.scores), self.limit), -np.inf)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        rows = slice(first, first + n)
        # Who reaches the limit-th score of these points and of the list so far, ties among it; few of a matrix do.
        floor = self.scores[rows, -1]
        if m > self.limit:
            floor = np.maximum(floor, np.partition(scores, m - self.limit, axis=1)[:, m - self.limit])
        r, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        old, at = np.nonzero(self.scores[rows] > -np.inf)
        query = np.concatenate([old, r])
        score = np.concatenate([self.scores[rows][old, at], scores[r, c]])
        name = np.concatenate([self.ids[rows][old, at], ids[c]])
        order = np.lexsort((name, -score, query))
        query, score, name = query[order], score[order], name[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.limit
        query, place = query[keep] + first, place[keep]
        self.scores[query, place], self.ids[query, place] = score[keep], name[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of all lists."""
        if self.ids is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, c = np.nonzero(self.scores > -np.inf)
        return q, self.ids[q, c], self.scores[q, c]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _best(df: DataFrame, score: str, limit: int, rank: str) -> DataFrame:
    """The best rows of each query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dense_topk(queries: DataFrame, points: DataFrame, limit: int = LIST_LIMIT, digits: int = 6) -> DataFrame:
    """(query_id, id, score, dense_rank): nearest points by cosine, exactly.

    queries: query_id, vector; points: id, vector. Scores are rounded, ties go to the smaller id. Null vectors and null
    ids never match; a zero vector has score 0.
    """
    spark = queries.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    parts = []
    for part in _scans(queries.where("vector is not null").select("query_id", "vector"), F.size("vector") * 8 + 64):
        rows = part.collect()  # at most about QUERY_BYTES
        if not rows:
            continue
        batch_type = _arrow(points, "id")
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], _unit(np.array([r["vector"] for r in rows], np.float64))))

        def run(batches, shared=shared):
            ids, q = shared.value
            best = _Best(len(ids), limit)
            for batch in batches:
                if batch.num_rows:
                    v, keys = _unit(_vectors(batch.column(1))), np.array(batch.column(0).to_pylist())
                    for at in range(0, len(ids), QUERY_BLOCK):
                        for low in range(0, len(v), POINT_BLOCK):
                            best.add(at, np.round(q[at : at + QUERY_BLOCK] @ v[low : low + POINT_BLOCK].T, digits) + 0.0, keys[low : low + POINT_BLOCK])
            i, found, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(i)), pa.array(found.tolist(), batch_type), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

        parts.append(points.where("vector is not null and id is not null").select("id", "vector").mapInArrow(run, schema))
    return _best(_union(spark, parts, schema), "score", limit, "dense_rank")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def lexical_topk(queries: DataFrame, points: DataFrame, limit: int = LIST_LIMIT, scan_limit: int | None = None) -> DataFrame:
    """(query_id, id, matches, lexical_rank): points whose text holds most of a query's words.

    Words are what lies between white space, lower-cased, and are looked for anywhere in the text. All words of a scan's
    queries form one automaton, so a text is read once; from a word found, a list leads to the queries that have it.
    scan_limit keeps the first points by id only, as the reference configuration does.
    """
    spark = queries.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, matches bigint"
    if scan_limit:
        points = points.orderBy("id").limit(scan_limit)
    worded = queries.select("query_id", F.array_distinct(T.words(F.lower("text"))).alias("w")).where(F.size("w") > 0)
    parts = []
    for part in _scans(worded, F.length(F.array_join("w", " ")) + F.size("w") * 80):
        rows = part.collect()  # at most about QUERY_BYTES, lists and automaton among it
        if not rows:
            continue
        lists: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for w in r["w"]:
                lists.setdefault(w, []).append(i)
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], list(lists), [np.array(x, np.int64) for x in lists.values()]))
        id_type = _arrow(points, "id")

        def run(batches, shared=shared):
            import ahocorasick

            ids, words, asked = shared.value
            machine = ahocorasick.Automaton()
            for i, w in enumerate(words):
                machine.add_word(w, i)
            machine.make_automaton()
            best = _Best(len(ids), limit)
            size = max(1, min(1024, (4 << 20) // min(len(ids), QUERY_BLOCK)))
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    some = batch.slice(at, size)
                    keys = np.array(some.column(0).to_pylist())
                    met = [np.concatenate([asked[j] for j in hits]) if t and (hits := {j for _, j in machine.iter(t.lower())}) else np.empty(0, np.int64) for t in some.column(1).to_pylist()]
                    row = np.repeat(np.arange(len(met)), [len(m) for m in met])
                    query = np.concatenate(met)
                    for first in range(0, len(ids), QUERY_BLOCK):
                        n = min(QUERY_BLOCK, len(ids) - first)
                        here = (query >= first) & (query < first + n)
                        scores = np.bincount((query[here] - first) * len(met) + row[here], minlength=n * len(met)).reshape(n, len(met)).astype(np.float64)
                        scores[scores == 0] = -np.inf
                        best.add(first, scores, keys)
            i, found, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(i)), pa.array(found.tolist(), id_type), pa.array(score.astype(np.int64))], names=["query_id", "id", "matches"])

        parts.append(points.where("text is not null and id is not null").select("id", "text").mapInArrow(run, schema))
    return _best(_union(spark, parts, schema), "matches", limit, "lexical_rank")


# An index -----------------------------------------------------------------------------------------------------------

#: Vectors that the centroids are fitted on at most, and points of a cell that one task compares at most about.
SAMPLE, CELL = 20_000, 20_000


def fit_index(points: DataFrame, cells: int | None = None, recall: float = 0.95, limit: int = LIST_LIMIT, sample: int = SAMPLE, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, int]:
    """(centroids, probes): unit centroids of spherical k-means, and how many of a query's nearest cells hold `recall` of its neighbours.

    Both are found on at most `sample` vectors, the first by a hash of their id; every point is indexed all the same.
    Probes are counted on 256 of them against all others by brute force: among more points neighbours are nearer, so
    that the share found only grows. By default there are as many cells as the square root of the points.
    """
    held = points.where("vector is not null and id is not null")
    if cells is None:
        cells = max(1, int(held.count() ** 0.5))
    rows = held.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").collect()
    v = _unit(np.array([r["vector"] for r in rows], np.float64)) if rows else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centers = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(v @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, v)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = centers[empty]
        centers = _unit(sums)
    of = np.argmax(v @ centers.T, axis=1)
    asked = v[:256]
    near = np.argsort(-(asked @ v.T), axis=1, kind="stable")[:, 1 : limit + 1]
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, of[near], 1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1
    return centers, probes


def indexed_topk(queries: DataFrame, points: DataFrame, limit: int = LIST_LIMIT, cells: int | None = None, recall: float = 0.95) -> DataFrame:
    """dense_topk by an index made on the way."""
    centroids, probes = fit_index(points, cells, recall, limit)
    return dense_search(queries, dense_index(points, centroids), centroids, probes, limit)


def dense_index(points: DataFrame, centroids: np.ndarray, cell: int = CELL) -> DataFrame:
    """(id, vector, cell, part): each point with a vector at its nearest centroid; crowded cells are split into parts by hash."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        centers = shared.value
        for batch in batches:
            if batch.num_rows:
                of = np.argmax(_unit(_vectors(batch.column(1))) @ centers.T, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of.astype(np.int32))], names=["id", "vector", "cell"])

    id_type, vector = (points.schema[c].dataType.simpleString() for c in ("id", "vector"))
    placed = materialize(points.where("vector is not null and id is not null").select("id", "vector").mapInArrow(run, f"id {id_type}, vector {vector}, cell int"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))  # a row a centroid
    return placed.join(F.broadcast(sizes), "cell").select("id", "vector", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts")


def dense_search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, probes: int, limit: int = LIST_LIMIT, digits: int = 6) -> DataFrame:
    """(query_id, id, score, dense_rank): the best of the points in the `probes` nearest cells of each query.

    Each part of a cell meets the queries that probe it in a task of its own.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(centroids)
    q_type, v_type, id_type = queries.schema["query_id"].dataType.simpleString(), queries.schema["vector"].dataType.simpleString(), index.schema["id"].dataType.simpleString()

    def probe(batches):
        centers = shared.value
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(_vectors(batch.column(1))) @ centers.T), axis=1, kind="stable")[:, :probes]
                of = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "cell"])

    asked = queries.where("vector is not null and query_id is not null").select("query_id", "vector").mapInArrow(probe, f"query_id {q_type}, vector {v_type}, cell int")
    parts = index.groupBy("cell").agg(F.max("parts").alias("parts"))
    asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    q_arrow, id_arrow = _arrow(queries, "query_id"), _arrow(index, "id")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q, score, found = left["query_id"].to_pylist(), [], [], []
        if left.num_rows and right.num_rows:
            best = _Best(len(ids), limit)
            v, keys = _unit(_vectors(right["vector"].combine_chunks())), np.array(right["id"].to_pylist())
            asked_ = _unit(_vectors(left["vector"].combine_chunks()))
            for at in range(0, len(ids), QUERY_BLOCK):
                for low in range(0, len(v), POINT_BLOCK):
                    best.add(at, np.round(asked_[at : at + QUERY_BLOCK] @ v[low : low + POINT_BLOCK].T, digits) + 0.0, keys[low : low + POINT_BLOCK])
            i, found, score = best.rows()
            q, found = [ids[x] for x in i], found.tolist()
        return pa.table([pa.array(q, q_arrow), pa.array(found, id_arrow), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    met = asked.groupBy("cell", "part").cogroup(index.groupBy("cell", "part")).applyInArrow(compare, f"query_id {q_type}, id {id_type}, score double")
    return _best(met, "score", limit, "dense_rank")


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, top_n: int | None = None) -> DataFrame:
    """(query_id, id, dense_rank, lexical_rank, rrf_score, fused_rank) of both lists: sums of 1 / (k + rank).

    Ties keep the order in which the lists name the points, the dense list first.
    """
    both = dense.select("query_id", "id", "dense_rank").join(lexical.select("query_id", "id", "lexical_rank"), ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", F.round(part("dense_rank") + part("lexical_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), "lexical_rank")
    fused = scored.withColumn("fused_rank", F.row_number().over(w))
    return fused.where(F.col("fused_rank") <= top_n) if top_n else fused


def rerank(candidates: DataFrame, top_k: int = TOP_K, scorer=None) -> DataFrame:
    """Adds rerank_score, rerank_score_type and rerank_rank and keeps the best; without a scorer the fused order stands.

    scorer is a column function of (query_text, text).
    """
    score = scorer(F.col("query_text"), F.col("text")) if scorer else F.coalesce("rrf_score", 1.0 / F.col("fused_rank"))
    out = candidates.withColumns({"rerank_score": score, "rerank_score_type": F.lit("cross_encoder" if scorer else "rrf")})
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    return out.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= top_k)


def relevance_gate(candidates: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """Adds lexical_overlap, relevance_score and relevance_status (relevant, unrelated).

    Fused scores must reach the floor and share a term with the query; scores of a model must reach the threshold.
    """
    has = set(candidates.columns)
    score = F.coalesce(*[T.number(F.col(c)) for c in ("rerank_score", "relevance_score", "rrf_score") if c in has])
    overlap = T.lexical_overlap(F.col("query_text"), F.col("text"))
    kind = F.coalesce("rerank_score_type", F.lit("cross_encoder")) if "rerank_score_type" in has else F.lit("cross_encoder")
    out = candidates.withColumn("lexical_overlap", overlap).withColumn("relevance_score", score)
    passed = F.when(kind == "rrf", (F.col("relevance_score") >= floor) & (F.col("lexical_overlap") > 0)).otherwise(F.col("relevance_score") >= threshold)
    return out.withColumn("relevance_status", F.when(passed, "relevant").otherwise("unrelated"))


def gate_summary(gated: DataFrame, id_column: str = "id", order: str | None = None) -> DataFrame:
    """A row a query: candidate_count, relevant_count, passed, selected_ids and rejected_ids in the candidates' order, or in that of ids."""
    relevant = F.col("relevance_status") == "relevant"
    entry = F.struct(F.col(order or id_column).alias("o"), F.col(id_column).alias("i"))
    ids = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, entry))), lambda x: x["i"])
    return gated.groupBy("query_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(relevant).alias("relevant_count"), F.bool_or(relevant).alias("passed"), ids(relevant).alias("selected_ids"), ids(~relevant).alias("rejected_ids"),
    )


def hybrid_retrieve(queries: DataFrame, points: DataFrame, top_k: int = TOP_K, limit: int = LIST_LIMIT) -> DataFrame:
    """(query_id, id, dense_rank, lexical_rank, rrf_score, fused_rank, query_text, text, lexical_overlap, relevance_status).

    queries: query_id, text, vector; points: id, text, vector. Blank queries find nothing.
    """
    asked = queries.where(T.strip(F.col("text")) != "")
    fused = rrf_fuse(dense_topk(asked, points, limit), lexical_topk(asked, points, limit), top_n=top_k)
    full = fused.join(points.select("id", "text"), "id").join(asked.select("query_id", F.col("text").alias("query_text")), "query_id")
    return relevance_gate(full.withColumns({"rerank_score": F.col("rrf_score"), "rerank_score_type": F.lit("rrf")})).drop("rerank_score", "rerank_score_type")
