"""Exact top-k by inner product with a pivot table.

Vectors are whole numbers. With one component more, sqrt(M - |x|^2), all have the same norm, and the
order by inner product is that by distance. Distances to pivots, worked out once for each vector, then
bound every distance from below: |d(q, p) - d(x, p)| <= d(q, x). Whole cells whose bound exceeds a
query's threshold are never sent to it; in a cell, candidates are evaluated in the order of their
bounds until no bound is left that could do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphfold.llm.common import map_batches
from graphfold.plans.lineage import cut, drop

#: Distances are rounded; bounds give way by so much.
SLACK = 1e-6


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x). Vectors null or with null or non-finite components are left out."""
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return raw.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector is one with zeros after it."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in floating point where no sum can leave its whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    """With the component that brings the squared norm to square."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, of all rows of x to all rows of y."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: rows of the sample, each the farthest from those before it."""
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def rows_of(column: pa.Array, dtype) -> np.ndarray:
    """A list column as a matrix; a shorter list is one with zeros after it."""
    offsets = column.offsets.to_numpy()
    flat, widths = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    width = int(widths.max(initial=0))
    if (widths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(column), width).astype(dtype, copy=False)
    out = np.zeros((len(column), width), dtype)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def top_k(vectors: DataFrame, is_query, k: int = 5, pivots: int = 32, sample_rows: int = 8192, block_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other rows, ties to the smaller vec_id.

    vectors: (vec_id, v). is_query: a condition on vec_id. Only pivots and a sample of sample_rows rows,
    by a hash of their ids, are held by the driver; the sample's k-th best score is a query's first
    threshold. A block of block_rows vectors lies in one task once, the queries that its cell can't be
    ruled out for pass by it in batches. Rows that repeat an id count as one, by the vector that sorts
    first. A table of one vector, or none, has no result. A score must fit in a long.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    base = vectors.groupBy("vec_id").agg(F.min("v").alias("v")).where(F.col("vec_id").isNotNull())
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = cut(base.withColumn("square", square), "vectors")
    known = base.agg(F.max("square").alias("square"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if not known["n"]:
        return spark.createDataFrame([], schema)
    width, most = known["width"], float(known["square"])
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "v").collect()
    sample_ids, sample_v = np.array([r["vec_id"] for r in sample]), matrix([r["v"] for r in sample], width)
    pivot_v = spread_out(augmented(sample_v, most), pivots)
    sent = spark.sparkContext.broadcast((sample_ids, sample_v, pivot_v))

    def tabulate():
        """The pivot table: each vector's distances, and its cell, the nearest pivot's."""

        def step(batch: pa.RecordBatch):
            d = distances(augmented(widened(rows_of(batch["v"], np.int64), width), most), sent.value[2])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(d.argmin(1).astype(np.int32)), listed(d)], names=["vec_id", "v", "cell", "d"])

        return step

    tabled = cut(map_batches(base.select("vec_id", "v"), tabulate, "vec_id long, v array<long>, cell int, d array<double>"), "pivots")
    drop(base)
    cells = tabled.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.get("d", F.lit(i))).alias(f"{label}{i}") for i in range(len(pivot_v)) for label, f in (("lo", F.min), ("hi", F.max))]).orderBy("cell").collect()  # a row for each pivot at most
    cell_ids = np.array([c["cell"] for c in cells], np.int32)
    low, high = (np.array([[c[f"{label}{i}"] for i in range(len(pivot_v))] for c in cells]) for label in ("lo", "hi"))

    def route():
        """Each query to the cells that its threshold can't rule out."""
        ids, points, _ = sent.value

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                q, own_ids = widened(rows_of(some["v"], np.int64), width), some["vec_id"].to_numpy()
                scores = products(q, points).astype(np.float64)
                scores[own_ids[:, None] == ids[None, :]] = -np.inf
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(q), -np.inf)
                farthest = np.sqrt(np.maximum(most + (q.astype(np.float64) ** 2).sum(1) - 2 * kth, 0))
                # A query's own component is 0, so that its distances to the pivots are those of that point.
                own = distances(np.column_stack([q, np.zeros(len(q))]).astype(np.float64), sent.value[2])
                bound = np.maximum(low[None] - own[:, None], own[:, None] - high[None]).max(2)
                query, cell = np.nonzero(bound <= (farthest * (1 + SLACK) + SLACK)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[query]), listed(q[query]), pa.array(cell_ids[cell]), listed(own[query]), pa.array(kth[query])], names=["vec_id", "v", "cell", "d", "kth"])

        return step

    part = F.element_at(F.create_map(*[F.lit(int(x)) for c in cells for x in (c["cell"], -(-c["n"] // block_rows))]), F.col("cell")).cast("long")
    routed = map_batches(tabled.where(is_query).select("vec_id", "v"), route, "vec_id long, v array<long>, cell int, d array<double>, kth double")
    routed = routed.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), part - 1)).alias("part"), F.lit(1).alias("role"), "vec_id", "v", "d", "kth")
    blocks = tabled.select("cell", F.pmod(F.xxhash64("vec_id"), part).alias("part"), F.lit(0).alias("role"), "vec_id", "v", "d", F.lit(0.0).alias("kth"))
    rows = blocks.unionByName(routed).repartition("cell", "part").sortWithinPartitions("cell", "part", "role", "vec_id")

    def search():
        state: dict = {"key": None, "parts": [], "block": None}

        def step(batch: pa.RecordBatch):
            keys = np.column_stack([batch[c].to_numpy() for c in ("cell", "part", "role")])
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if a == b:
                    continue
                some, (cell, number, role) = batch.slice(a, b - a), keys[a]
                own = some["vec_id"].to_numpy(), widened(rows_of(some["v"], np.int64), width), rows_of(some["d"], np.float64)
                if state["key"] != (cell, number):
                    state.update(key=(cell, number), parts=[], block=None)
                if role == 0:
                    state["parts"].append(own)
                    continue
                if state["block"] is None:
                    if not state["parts"]:
                        continue
                    state.update(block=tuple(np.concatenate(x) for x in zip(*state["parts"], strict=True)), parts=[])
                kth = some["kth"].to_numpy()
                for at in range(0, b - a, QUERIES):
                    found = nearest(*(x[at : at + QUERIES] for x in own), kth[at : at + QUERIES], *state["block"], most, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

        return step

    found = map_batches(rows, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Queries that pass by a block at once; their bounds to a block of 65536 take some 30 MB.
QUERIES = 64


def listed(x: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def nearest(own_ids: np.ndarray, queries: np.ndarray, dq: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, square: float, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block, or fewer that can matter, for each query: candidates in the order of their bounds until none can do.

    kth: scores that k other rows are known to reach. Bounds are the greatest over all pivots.
    """
    bound = np.zeros((len(queries), len(ids)))
    for p in range(dx.shape[1]):
        np.maximum(bound, np.abs(dx[None, :, p] - dq[:, None, p]), out=bound)
    norms = (queries.astype(np.float64) ** 2).sum(1)
    out: list[list[np.ndarray]] = [[], [], []]
    for i, own_id in enumerate(own_ids):
        limit = lambda score: np.sqrt(max(square + norms[i] - 2 * score, 0)) * (1 + SLACK) + SLACK if np.isfinite(score) else np.inf  # noqa: B023, E731
        order = np.flatnonzero((bound[i] <= limit(kth[i])) & (ids != own_id))
        order = order[np.argsort(bound[i, order], kind="stable")]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, size = 0, step
        while at < len(order):
            if len(best) == k and bound[i, order[at]] > limit(max(float(best[-1]), kth[i])):
                break
            take = order[at : at + size]
            at, size = at + size, 2 * size
            best, best_ids = np.append(best, products(queries[i : i + 1], x[take])[0]), np.append(best_ids, ids[take])
            keep = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[keep], best_ids[keep]
        for column, value in zip(out, (np.full(len(best), own_id), best_ids, best), strict=True):
            column.append(value)
    return tuple(np.concatenate([np.zeros(0, np.int64), *column]) for column in out)
