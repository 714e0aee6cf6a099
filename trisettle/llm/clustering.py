"""Centroid clustering with Elkan's bounds, exact in integers.

Vectors become integers, centroids are integers, so squared distances are exact in 64 bits. Each vector keeps its
cluster, an upper bound of the distance to that centroid and a lower bound to each of the k. A centroid is skipped if
its lower bound, or half the distance between the two centroids, is strictly above the upper bound; bounds are rounded
away from a wrong skip, so equal distances are always calculated and go to the smaller number.

The bounds live in a table: every round reads it, moves the bounds by how far the centroids went, and writes it anew,
so a lost executor costs part of a round. Only k rows of sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import written

#: Components of a kept vector, and what they are multiplied with before the floor.
DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Integers beyond this are set to it: with it, squared distances of 64 components fit in 64 bits.
LARGEST = 1 << 27
#: Wider than the rounding of an integer to a double, of a square root and of one sum.
SLACK = 2.0**-48
#: The same for bounds that are stored in single precision.
SLACK_SINGLE = 2.0**-20
STATE = "vec_id long, x array<int>, cluster int, upper float, lower array<float>, computed int"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x, the components as integers floor(64 * component), of every vector that is kept: with ``dimensions``
    components, none null or non-finite. Integers beyond 2**27 are set to 2**27 with their sign."""
    finite = F.forall(vector, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))
    floor = F.transform(vector, lambda e: F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return df.filter((F.size(vector) == dimensions) & finite).select(F.col(key).cast("long").alias("vec_id"), floor.alias("x"))


def start_order(key: str = "vec_id") -> Column:
    """Vectors with the smallest values become the first centroids; a null id hashes as the empty text."""
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def reassigned(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, exact: bool = False
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, distance, computed) against centroids that moved by at most ``moved`` since the bounds
    were made. ``distance`` is the exact square where it was calculated (everywhere if ``exact``), else -1;
    ``computed`` counts calculated distances."""
    n, k = len(x), len(centroids)
    cluster, lower = cluster.copy(), np.maximum((lower - moved) * (1 - SLACK) - SLACK, 0)
    upper = (upper + moved[cluster]) * (1 + SLACK)
    gaps = centroids[:, None, :] - centroids[None, :, :]
    half = np.sqrt(np.einsum("abj,abj->ab", gaps, gaps).astype(np.float64)) / 2 * (1 - SLACK)
    distance, computed = np.full(n, -1, np.int64), np.zeros(n, np.int32)

    def calculate(rows: np.ndarray) -> None:
        own = cluster[rows]
        distance[rows] = squared(x[rows], centroids[own])
        root = np.sqrt(distance[rows].astype(np.float64))
        upper[rows], lower[rows, own] = root * (1 + SLACK), root * (1 - SLACK)
        computed[rows] += 1

    if exact:
        calculate(np.arange(n))
    for j in range(k):
        def near() -> np.ndarray:
            return np.flatnonzero((cluster != j) & (upper >= lower[:, j]) & (upper >= half[cluster, j]))

        stale = near()
        stale = stale[distance[stale] < 0]
        if len(stale):
            calculate(stale)
        rows = near()
        if not len(rows):
            continue
        other = squared(x[rows], centroids[j])
        computed[rows] += 1
        root = np.sqrt(other.astype(np.float64))
        lower[rows, j] = root * (1 - SLACK)
        wins = (other < distance[rows]) | ((other == distance[rows]) & (j < cluster[rows]))
        won = rows[wins]
        cluster[won], distance[won], upper[won] = j, other[wins], root[wins] * (1 + SLACK)
    return cluster, upper, lower, distance, computed


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1), kind))


def cluster_step(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """One assignment of all vectors: the state for the next round, or vec_id, cluster, distance and computed of the last."""
    outside = np.float32(SLACK_SINGLE)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = matrix(batch.column(1), np.int64)
            if not len(x):
                continue
            upper, lower = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64), matrix(batch.column(4), np.float64)
            cluster, upper, lower, distance, computed = reassigned(x, centroids, batch.column(2).to_numpy(zero_copy_only=False), upper, lower, moved, exact=last)
            total = pa.array(batch.column(5).to_numpy(zero_copy_only=False) + computed, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance), total], ["vec_id", "cluster", "distance", "computed"])
            else:
                above, below = (upper * (1 + outside)).astype(np.float32), (lower * (1 - outside)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(above), lists(below, pa.float32()), total],
                                                 ["vec_id", "x", "cluster", "upper", "lower", "computed"])

    return state.mapInArrow(batches, "vec_id long, cluster int, distance long, computed int" if last else STATE)


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS
        ) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, computed) of every kept vector after ``rounds`` rounds and a last assignment, and the
    centroids. With fewer than k kept vectors there are as many centroids; without any the table is empty. Repeated rows
    each count; rows of one id with several vectors are ordered by these. Clusters that lost all vectors keep their centroid."""
    base = quantised(df, key, vector, dimensions)
    first = base.orderBy(start_order("vec_id"), "x").limit(k).select("x").collect()
    centroids = np.array([row.x for row in first], np.int64).reshape(len(first), dimensions)
    k = len(first)
    if not k:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, computed int"), centroids
    unknown = float(np.sqrt(dimensions) * 2 * LARGEST)
    state = base.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(unknown * 2).cast("float").alias("upper"), F.array_repeat(F.lit(0.0).cast("float"), k).alias("lower"), F.lit(0).alias("computed"))
    moved = np.zeros(k)
    for _ in range(rounds):
        state = written(cluster_step(state, centroids, moved, last=False), "clusters")
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dimensions)])
        new = centroids.copy()
        for row in sums.collect():
            new[row.cluster] = [row[f"s{i}"] // row.n for i in range(dimensions)]
        moved = np.sqrt(squared(new, centroids).astype(np.float64)) * (1 + SLACK)
        centroids = new
    return written(cluster_step(state, centroids, moved, last=True), "clustered"), centroids


def clustered(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, the inertia of its cluster and of all, and the digest of its centroid."""
    rows, centroids = fit(df)
    inertia = {row.cluster: row.inertia for row in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    by_cluster = F.array(*[F.lit(inertia.get(j, 0)).cast("long") for j in range(len(centroids))] or [F.lit(0).cast("long")])
    texts = F.array(*[F.lit(",".join(map(str, c.tolist()))) for c in centroids] or [F.lit("")])
    return rows.select("vec_id", "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"),
                       F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.sha2(texts[F.col("cluster")], 256).alias("centroid_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL, by all distances."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} as (select vec_id, c, d from (select v.vec_id, c.c, cast(sum((v.x - c.x) * (v.x - c.x)) as bigint) d from parts v join cent{r} c using (i) group by v.vec_id, c.c)
  qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            steps.append(f"""mean{r} as (select c, i, cast(floor(sum(x)::decimal(38,0) / count(*)) as bigint) approx, cast(sum(x) as bigint) s, count(*) n from parts join near{r} using (vec_id) group by c, i),
cent{r + 1} as (select o.c, o.i, case when m.n is null then o.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end x from cent{r} o left join mean{r} m on m.c = o.c and m.i = o.i)""")
    return f"""with kept as (select vec_id, list_transform(embedding, lambda e: cast(floor(64 * e::double) as bigint)) x from embeddings
  where len(embedding) = {DIMENSIONS} and not list_contains(list_transform(embedding, lambda e: coalesce(isfinite(e), false)), false)),
parts as (select vec_id, unnest(x) x, unnest(range(1, {DIMENSIONS + 1})) i from kept),
firsts as (select vec_id, row_number() over (order by sha256('1:' || vec_id::varchar)) - 1 c from kept qualify c < {CENTROIDS}),
cent0 as (select c, i, x from parts join firsts using (vec_id)),
{", ".join(steps)},
digest as (select c, sha256(string_agg(x::varchar, ',' order by i)) centroid_sha256 from cent{rounds} group by c)
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, centroid_sha256 from near{rounds} join digest using (c)"""
