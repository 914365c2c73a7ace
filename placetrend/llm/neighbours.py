"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrend.storage import materialise

K = 10
EVERY = 100
#: Bound on the vectors that the partition and the classifier are fitted on.
SAMPLE = 8192
#: Vectors that a partition aims at, and most partitions.
PART_ROWS = 500
MOST_PARTS = 256
GRAPH_DEGREE = 10
HIDDEN = 64
#: Share of the sample's neighbours that the probed partitions must hold.
TARGET_RECALL = 0.98
#: Vectors and queries that one task compares at once.
CANDIDATE_ROWS, QUERY_ROWS = 4096, 2048


def _nearest(points: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the ``degree`` nearest others of each point, in blocks."""
    norms = (points**2).sum(axis=1)
    out = np.empty((len(points), degree), np.int64)
    for a in range(0, len(points), 1024):
        block = norms[None, :] - 2 * points[a : a + 1024] @ points.T
        block[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        out[a : a + 1024] = np.argpartition(block, degree - 1, axis=1)[:, :degree]
    return out


def _halves(points: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by repeated halving at the median of the direction of greatest spread."""
    part = np.zeros(len(points), np.int64)
    step = parts
    while step > 1:
        for p in range(0, parts, step):
            at = np.flatnonzero(part == p)
            centred = points[at] - points[at].mean(axis=0)
            along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            part[at[np.argsort(along, kind="stable")[len(at) // 2 :]]] += step // 2
        step //= 2
    return part


def balanced_partition(points: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.2, rounds: int = 12) -> np.ndarray:
    """A part for each vertex of the neighbour graph, with few edges between parts and none larger
    than ``slack`` times its share: equal halves, then moves to the part of most neighbours, those of
    the greatest gain first."""
    n = len(points)
    part, most = _halves(points, parts), int(np.ceil(slack * n / parts))
    ends = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()))
    others = np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    for _ in range(rounds):
        votes = np.bincount(ends * parts + part[others], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < most and sizes[part[v]] > 1:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier with one hidden layer: scores of the parts for vectors."""

    centre: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int = 1

    def scores(self, points: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((points - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2


def fit_router(points: np.ndarray, parts: int, degree: int = GRAPH_DEGREE, epochs: int = 60) -> Router:
    """Partition the neighbour graph of ``points`` and learn to which parts a vector's neighbours
    belong. ``probes`` is the least number of parts that holds ``TARGET_RECALL`` of them."""
    rng = np.random.default_rng(3)
    graph = _nearest(points, min(degree, len(points) - 1))
    part = balanced_partition(points, graph, parts)
    goal = np.zeros((len(points), parts))
    np.add.at(goal, (np.arange(len(points))[:, None], part[graph]), 1.0)
    goal[np.arange(len(points)), part] += graph.shape[1]
    goal /= goal.sum(axis=1, keepdims=True)
    router = Router(points.mean(axis=0), float(points.std()) or 1.0, [
        rng.normal(0, np.sqrt(2 / points.shape[1]), (points.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts),
    ])
    x = (points - router.centre) / router.scale
    mean, spread, step = [0 * w for w in router.layers], [0 * w for w in router.layers], 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            w1, b1, w2, b2 = router.layers
            hidden = np.maximum(x[at] @ w1 + b1, 0)
            raw = hidden @ w2 + b2
            chance = np.exp(raw - raw.max(axis=1, keepdims=True))
            error = (chance / chance.sum(axis=1, keepdims=True) - goal[at]) / len(at)
            back = (error @ w2.T) * (hidden > 0)
            slopes = [x[at].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, slope in enumerate(slopes):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                spread[k] = 0.999 * spread[k] + 0.001 * slope**2
                router.layers[k] = router.layers[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    scores = router.scores(points)
    home, order = scores.argmax(axis=1), np.argsort(-scores, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    reached = np.sort(np.take_along_axis(rank, home[graph], axis=1).ravel())
    router.probes = int(reached[min(len(reached) - 1, int(np.ceil(TARGET_RECALL * len(reached))))]) + 1
    return router


def usable_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` of the vectors that take part, as doubles; equal rows once."""
    vector = F.col("vector")
    picked = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    sound = picked.where(
        F.col("vec_id").isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    return sound.distinct()


def _points(table: pa.Table, column: str = "vector") -> np.ndarray:
    chunks = table.column(column).combine_chunks()
    return chunks.flatten().to_numpy(zero_copy_only=False).reshape(len(chunks), -1)


def _top(queries: pa.Table, candidates: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the candidates of its ``k`` nearest other ids: query rows, candidate rows, distances.

    Products pick those that may be among them, with all that lie as near as rounding can tell; their
    distances are then taken from the differences in double precision."""
    q, c = _points(queries), _points(candidates)
    q_id, c_id = queries.column("query_id").to_numpy(), candidates.column("vec_id").to_numpy()
    by_id = np.argsort(c_id, kind="stable")
    c, c_id = c[by_id], c_id[by_id]
    heads = np.flatnonzero(np.concatenate(([True], c_id[1:] != c_id[:-1])))
    norms, rows, found, scores = (c**2).sum(axis=1), [], [], []
    for a in range(0, len(q), 256):
        block = q[a : a + 256]
        near = norms[None, :] + (block**2).sum(axis=1)[:, None] - 2 * block @ c.T
        near[q_id[a : a + 256, None] == c_id[None, :]] = np.inf
        ids = near if len(heads) == len(c) else np.minimum.reduceat(near, heads, axis=1)
        kth = np.partition(ids, min(k, len(heads)) - 1, axis=1)[:, min(k, len(heads)) - 1]
        tolerance = 1e-9 * (norms.max() + (block**2).sum(axis=1))
        at, who = np.nonzero((near <= (kth + tolerance)[:, None]) & np.isfinite(near))
        exact = np.sqrt(((block[at] - c[who]) ** 2).sum(axis=1))
        order = np.lexsort((c_id[who], exact, at))
        at, who, exact = at[order], who[order], exact[order]
        if len(heads) < len(c):
            _, nearest = np.unique(np.stack((at, c_id[who])), axis=1, return_index=True)
            nearest.sort()  # rows are in order of distance, so the first of an id is its nearest
            at, who, exact = at[nearest], who[nearest], exact[nearest]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < k
        rows.append(at[keep] + a)
        found.append(by_id[who[keep]])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def nearest_neighbours(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, every: int = EVERY, sample: int = SAMPLE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every``, the ``k`` nearest other
    vectors found, nearest first, ties to the smaller id; all there are, if fewer.

    A neighbour graph of up to ``sample`` vectors, chosen by a hash of their ids, is cut into balanced
    parts, and a small classifier learns them. Every vector is indexed under its likeliest part; a
    query is compared with all vectors of its several likeliest parts, at least until they hold
    ``k`` others. Distances are Euclidean, in double precision on the vectors as given.

    Vectors that are null, zero, empty or hold a null or non-finite component take no part, nor do
    null ids; vectors of another length than most are left out. An id with several vectors is near by
    the nearest of them, as a candidate and as a query. Of equal vectors the ``k + 1`` smallest ids are indexed, as no others can be
    among the nearest, so a very common vector stays small. Parts and queries are compared in slices
    of bounded size. Other columns are not read; an empty table gives none.
    """
    spark = table.sparkSession
    vectors = materialise(usable_vectors(table, id_column, vector_column), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    width = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("vector") == width["n"])
    total = width["count"]
    fitted = _points(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow())
    fitted = np.unique(fitted, axis=0)
    parts = 1 << int(np.clip(np.round(np.log2(max(total / PART_ROWS, 1))), 0, np.log2(MOST_PARTS)))
    while parts > 1 and parts * 8 > len(fitted):
        parts //= 2
    router = fit_router(fitted, parts) if parts > 1 else None

    def assign(batches):
        for batch in batches:
            points = _points(pa.Table.from_batches([batch])) if batch.num_rows else np.zeros((0, width["n"]))
            home = router.scores(points).argmax(axis=1) if router else np.zeros(len(points), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], ["vec_id", "vector", "part"])

    copies = Window.partitionBy("vector").orderBy("vec_id")
    distinct = vectors.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).drop("nth")
    index = materialise(distinct.mapInArrow(assign, f"vec_id {kind}, vector array<double>, part int"), "vector-index")
    held = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():  # one row per part
        held[r["part"]] = r["count"]

    def route(batches):
        for batch in batches:
            points = _points(pa.Table.from_batches([batch])) if batch.num_rows else np.zeros((0, width["n"]))
            order = np.argsort(-router.scores(points), axis=1, kind="stable") if router else np.zeros((len(points), 1), np.int64)
            before = np.cumsum(held[order], axis=1) - held[order]
            probed = (np.arange(order.shape[1])[None, :] < (router.probes if router else 1)) | (before <= k)
            asked = pa.array([o[p].tolist() for o, p in zip(order, probed, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, asked], ["query_id", "vector", "parts"])

    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    routed = queries.mapInArrow(route, f"query_id {kind}, vector array<double>, parts array<int>").select(
        "query_id", "vector", F.explode("parts").alias("part")
    )
    routed = materialise(routed, "vector-queries")
    asked = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    slices = F.array(*[F.lit(int(-(-n // CANDIDATE_ROWS)) or 1) for n in held])[F.col("part")]
    groups = F.array(*[F.lit(int(-(-n // QUERY_ROWS)) or 1) for n in asked])[F.col("part")]
    left = routed.withColumn("grp", F.pmod(F.xxhash64("query_id", "vector"), groups).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    right = index.withColumn("slice", F.pmod(F.xxhash64("vec_id", "vector"), slices).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), groups - 1)))

    def compare(asking: pa.Table, candidates: pa.Table) -> pa.Table:
        if not asking.num_rows or not candidates.num_rows:
            at, who, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            at, who, score = _top(asking, candidates, k)
        return pa.table({"query_id": asking.column("query_id").take(pa.array(at)), "vec_id": candidates.column("vec_id").take(pa.array(who)), "score": score})

    keys = ("part", "slice", "grp")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")
    # an id with several vectors, as query or candidate, counts by the two that are nearest
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
