"""Problem 8: documents into containers of a fixed number of tokens.

Linear grouping: the large sizes, in descending order, form groups of equal
cardinality and are rounded up to the largest of their group, which leaves a few
sizes. Configurations of these are chosen by column generation (the dual prices
are a knapsack's values); the configurations' slots then take the actual
documents, and small ones go best-fit into what room is left.

Nothing that grows with the corpus reaches the driver: it sees how many items
each size has (sizes are at most the capacity) and how many containers each gap
has, and answers with intervals of ranks. A document finds its container from
its rank within its size, in parallel.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .encoding import BYTE_BPE_50K, count_tokens

#: Rows that one rank bucket holds on average.
BUCKET_ROWS = 250_000


def _best_pattern(widths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of widths within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    useful = [(int(w), float(v), i) for i, (w, v) in enumerate(zip(widths, values)) if v > 1e-12]
    w = np.array([u[0] for u in useful], int)
    v = np.array([u[1] for u in useful])
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        fit = w <= c
        if fit.any():
            gain = np.where(fit, best[np.maximum(c - w, 0)] + v, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], pick[c] = gain[k], k
    counts, c = np.zeros(len(widths), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[useful[pick[c]][2]] += 1
            c -= useful[pick[c]][0]
    return float(best[capacity]), counts


def configurations(widths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns over few widths and how often each is used; together they cover the demand.

    The linear programme is solved by column generation with an explicit basis; what rounding down leaves
    over is filled best-fit decreasing, at most one container for each width beyond the optimum.
    """
    n = len(widths)
    basis = np.diag(capacity // widths).astype(float)
    use = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = _best_pattern(widths, prices, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[:, out] = column
    patterns, left = [], demand.copy()
    for j in np.argsort(-use):
        column = np.rint(basis[:, j]).astype(int)
        times = int(use[j] + 1e-9)
        if times:
            patterns.append((column, times))
            left -= column * times
    left = np.maximum(left, 0)
    while left.any():
        room, column = capacity, np.zeros(n, int)
        for i in np.argsort(-widths, kind="stable"):
            k = min(int(left[i]), room // int(widths[i]))
            column[i] += k
            room -= k * int(widths[i])
        times = max(1, int(min(left[i] // column[i] for i in range(n) if column[i])))
        patterns.append((column, times))
        left = np.maximum(left - column * times, 0)
    return patterns


def plan_large(sizes: np.ndarray, counts: np.ndarray, capacity: int, groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (from, to, container, each, 0) over the ranks of large items by descending size, and the containers used.

    Rank r of an interval lies in container + (r - from) // each. sizes are descending.
    """
    total = int(counts.sum())
    if not total:
        return [], 0
    ends = np.cumsum(counts)
    each = -(-total // min(groups, total))
    starts = np.arange(0, total, each)
    widths = sizes[np.searchsorted(ends, starts, side="right")]
    demand = np.diff(np.append(starts, total))
    uniq, group = np.unique(-widths, return_inverse=True)  # groups that round to one width are one
    need = np.zeros(len(uniq), np.int64)
    np.add.at(need, group, demand)
    first = np.array([starts[group == k][0] for k in range(len(uniq))])
    taken = np.zeros(len(uniq), np.int64)
    intervals, container = [], 0
    for column, times in configurations((-uniq).astype(int), need.astype(int), capacity):
        used = 0
        for k in np.flatnonzero(column):
            n = min(int(column[k]) * times, int(need[k] - taken[k]))
            if n <= 0:
                continue
            a = int(first[k] + taken[k])
            intervals.append((a, a + n, container, int(column[k]), 0))
            taken[k] += n
            used = max(used, -(-n // int(column[k])))
        container += used
    return intervals, container


def plan_small(sizes: np.ndarray, counts: np.ndarray, gaps: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over classes of equal gaps.

    Intervals (size, from, to, gap, at): ranks of a size go, one each, to the containers of ranks at, at + 1, ... of
    that original gap; gap -1 stands for new containers, whose number comes second.
    """
    heap: dict[int, list[list[int]]] = defaultdict(list)
    for g, n in gaps.items():
        if g > 0 and n:
            heap[g].append([g, 0, n])
    open_gaps = np.zeros(capacity + 1, bool)
    for g in heap:
        open_gaps[g] = True
    volume, new, out = int((sizes * counts).sum()), 0, []
    for size, count in sorted(zip(map(int, sizes), map(int, counts)), reverse=True):
        rank = 0
        while rank < count:
            fits = np.flatnonzero(open_gaps[size:])
            if not len(fits):
                n = max(1, -(-volume // capacity))
                heap[capacity].append([-1, new, new + n])
                open_gaps[capacity] = True
                new += n
                continue
            gap = size + int(fits[0])
            origin, a, b = heap[gap].pop()
            n = min(count - rank, b - a)
            out.append((size, rank, rank + n, origin, a))
            if a + n < b:
                heap[gap].append([origin, a + n, b])
            if not heap[gap]:
                open_gaps[gap] = False
            if gap - size:
                heap[gap - size].append([origin, a, a + n])
                open_gaps[gap - size] = True
            rank += n
            volume -= n * size
    return out, new


def _ranked(df: DataFrame, by: str, order: list[str], buckets: int, alias: str = "rank") -> DataFrame:
    """Numbers the rows of each value of `by` from 0, with no value's rows in one task: within hashed buckets, plus what the buckets before hold."""
    rows = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    held = rows.groupBy(by, "__b").count()
    before = held.select(by, "__b", (F.sum("count").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    inner = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)) - 1)
    return inner.join(before, [by, "__b"]).select(*df.columns, (F.col("__n") + F.coalesce("__before", F.lit(0))).cast("long").alias(alias))


def _placed(df: DataFrame, columns: list[str], plan: list[tuple[int, int, int, int, int]], ahead: np.ndarray | None = None) -> DataFrame:
    """Adds to rows of (class, rank) what their interval says: v (third number) and o (offset // each + fifth number).

    With `ahead` ranks are within a size, and that many items of other sizes come before. The plan's size depends on the
    capacity alone, not on the number of rows.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((np.array(sorted(plan), np.int64).reshape(-1, 6), ahead))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", v bigint, o bigint"
    source = df.select(*columns, F.col("class").cast("long").alias("__c"), F.col("rank").cast("long").alias("__r"))

    def make():
        table, ahead = shared.value
        begin = table[:, 0] * (1 << 44) + table[:, 1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            c, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (len(columns), len(columns) + 1))
            if ahead is not None:
                r = r + ahead[batch.column(columns.index("size")).to_numpy(zero_copy_only=False)]
            row = table[np.searchsorted(begin, c * (1 << 44) + r, side="right") - 1]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(row[:, 3]), pa.array((r - row[:, 1]) // row[:, 4] + row[:, 5])], names=[*columns, "v", "o"])

        return step

    return map_batches(source, schema, make)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048, groups: int = 48, small: int = 128) -> DataFrame:
    """Places items into containers of the capacity.

    sizes has a row for each item; key is unique. Returns `key`, piece_no (int), offset, size and container (all
    bigint). An item beyond the capacity, and no other, is cut: full pieces, then the rest. Items of size 0 or null
    take no room; they are spread over the containers by their key's hash (container 0 if there is none else).
    Null and repeated keys are kept: each row is placed by itself. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    base = sizes.select(sizes[key].alias("k"), F.coalesce(sizes[size].cast("long"), F.lit(0)).alias("n"))
    pieces = base.select("k", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n") - 1) / capacity).cast("int")))).alias("piece_no"))
    pieces = pieces.select("k", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("offset"), F.least(F.col("n") - F.col("piece_no").cast("long") * capacity, F.lit(capacity)).cast("long").alias("size"))
    items = materialize(pieces, "items")
    tally = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    buckets = max(1, -(-sum(tally.values()) // BUCKET_ROWS))
    split = [(s, n) for s, n in sorted(tally.items(), reverse=True) if s > 0]
    large = [(s, n) for s, n in split if s > small]
    tiny = [(s, n) for s, n in split if s <= small]

    intervals, containers = plan_large(np.array([s for s, _ in large], np.int64), np.array([n for _, n in large], np.int64), capacity, groups)
    ahead, at = np.zeros(capacity + 1, np.int64), 0
    for s, n in large:
        ahead[s] = at
        at += n
    cols = ["k", "piece_no", "offset", "size"]
    out = []
    placed = None
    if large:
        ranked = _ranked(items.where(F.col("size") > small), "size", ["k", "piece_no"], buckets).withColumn("class", F.lit(0))
        # (class, from, to, value, each, plus)
        placed = materialize(_placed(ranked, cols, [(0, a, b, 0, each, c) for a, b, c, each, _ in intervals], ahead).select(*cols, F.col("o").alias("container")), "large")
        out.append(placed)
    new = 0
    if tiny:
        if placed is not None:
            gaps = placed.groupBy("container").agg((F.lit(capacity) - F.sum("size")).alias("gap"))
            gaps = materialize(_ranked(gaps, "gap", ["container"], max(1, -(-containers // BUCKET_ROWS)), "slot"), "gaps")
            room = {r["gap"]: r["count"] for r in gaps.groupBy("gap").count().collect()}  # at most capacity rows
        else:
            room = {}
        plan, new = plan_small(np.array([s for s, _ in tiny], np.int64), np.array([n for _, n in tiny], np.int64), room, capacity)
        ranked = _ranked(items.where((F.col("size") > 0) & (F.col("size") <= small)), "size", ["k", "piece_no"], buckets).withColumn("class", F.col("size"))
        where = materialize(_placed(ranked, cols, [(s, a, b, g, 1, at) for s, a, b, g, at in plan]), "small")
        out.append(where.where("v = -1").select(*cols, (F.col("o") + containers).alias("container")))
        if placed is not None:
            # There are as many gaps as containers: never to be broadcast.
            out.append(where.where("v >= 0").join(gaps.hint("merge"), (F.col("v") == F.col("gap")) & (F.col("o") == F.col("slot"))).select(*cols, "container"))
    every = containers + new
    out.append(items.where("size = 0").select(*cols, (F.pmod(F.xxhash64("k"), F.lit(every)) if every else F.lit(0)).cast("long").alias("container")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.select(F.col("k").alias(key), "piece_no", "offset", "size", F.col("container").cast("long"))


def pack_documents(df: DataFrame, key: str, text: str, capacity: int = 2048, path: str = BYTE_BPE_50K) -> DataFrame:
    """The same for whole texts measured in tokens; empty and null texts have size 0."""
    counted = count_tokens(df.select(df[key].alias("k"), df[text].alias("t")), "t", path)
    return pack(counted, "k", "n_tokens", capacity).withColumnRenamed("k", key)
