"""Centroid clustering in whole numbers, with block norms that spare most distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import materialise, release
from tessera.llm.vectors import whole_vectors

#: Production parameters: components, their scale, centroids, rounds, and the seed of the first centroids.
WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components of a segment.
SEGMENT = 8
#: Largest component: squared distances of 64 such components fit a long.
LARGEST = 1 << 27
#: Rows whose distances are computed at a time.
ROWS = 8192


def compressed(v: np.ndarray) -> np.ndarray:
    """Two numbers for each segment of a vector: its sum over the root of its size, and the norm of what differs from its mean.

    The squared distance of two compressed vectors is at most that of the vectors: the sums' part is exact, and of the rest
    the Cauchy-Schwarz inequality leaves at least the difference of the norms.
    """
    cuts = np.arange(0, v.shape[1], SEGMENT)
    sizes = np.diff(np.r_[cuts, v.shape[1]])
    x = v.astype(np.float64)
    sums = np.add.reduceat(x, cuts, axis=1) / np.sqrt(sizes)
    squares = np.add.reduceat(x * x, cuts, axis=1)
    return np.hstack([sums, np.sqrt(np.maximum(squares - sums * sums, 0))])


def nearest(v: np.ndarray, small: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each row's nearest centroid, the smaller number on ties, and how many exact distances that took.

    small: the compressed rows. A centroid whose lower bound exceeds the least distance found so far is skipped.
    """
    c_small = compressed(centroids)
    sums = (small * small).sum(axis=1)[:, None] + (c_small * c_small).sum(axis=1)
    # What rounding can add to a bound is taken off.
    lower = sums - 2 * (small @ c_small.T) - (1e-9 * sums + 1)
    number = lower.argmin(axis=1)
    best = ((v - centroids[number]) ** 2).sum(axis=1)
    exact = len(v)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero((lower[:, j] <= best) & (number != j))
        if len(rows):
            d = ((v[rows] - c) ** 2).sum(axis=1)
            exact += len(rows)
            had = best[rows]
            won = (d < had) | ((d == had) & (j < number[rows]))
            best[rows[won]], number[rows[won]] = d[won], j
    return number, best, exact


def _prepare(kind: pa.DataType, width: int, scale: int):
    """Kept vectors as whole numbers, with their compressed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, sizes, x = whole_vectors(batch.column(1), scale)
            long = sizes[valid] == width
            x = x[np.repeat(long, sizes[valid])].reshape(-1, width)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling: its distances don't fit a long")
            rows, v = np.flatnonzero(valid & (sizes == width)), x.astype(np.int32)
            lists = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(v, pa.int32()), lists(compressed(v), pa.float64())], names=["vec_id", "v", "small"])

    return run


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch, ROWS at a time: where they begin, the vectors and their compressed form."""
    if not batch.num_rows:
        return
    v = batch.column("v").flatten().to_numpy().reshape(-1, width).astype(np.int64)
    small = batch.column("small").flatten().to_numpy().reshape(len(v), -1)
    for at in range(0, len(v), ROWS):
        yield at, v[at : at + ROWS], small[at : at + ROWS]


def _partial_sums(centroids: np.ndarray):
    """For each centroid that has rows in this partition: the sum of its rows, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, small in _parts(batch, centroids.shape[1]):
                number = nearest(v, small, centroids)[0]
                for j in np.unique(number):
                    sums[j] += v[number == j].sum(axis=0)
                counts += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(counts[some])], names=["cluster", "sums", "n"])

    return run


def _assign(centroids: np.ndarray):
    """Each row's id, centroid and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v, small in _parts(batch, centroids.shape[1]):
                number, distance, _ = nearest(v, small, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(v)), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept row of vectors (vec_id, embedding).

    A vector is kept if it has ``width`` components, none null or non-finite; each becomes floor(scale * x). The first centroids
    are the ``clusters`` kept vectors (all, if fewer) with the smallest sha256 of "seed:vec_id". Each round assigns every vector to the nearest centroid
    and moves every centroid that has vectors to their mean, rounded down; then vectors are assigned once more.

    Every round is one pass over the written whole numbers and their precomputed block norms; tasks send one
    sum for each centroid, which Spark adds up, and clusters x width sums reach the driver.

    Null ids are kept and come last among first centroids; rows of equal id are ordered by their components. Equal vectors fall in one
    cluster. An empty table gives no rows, and other columns are ignored. A component beyond 2**27 after scaling is an error, as its
    distances may not fit a long.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType
    as_rows = f"vec_id {kind.simpleString()}, v array<int>, small array<double>"
    kept = materialise(vectors.select("vec_id", "embedding").mapInArrow(_prepare(to_arrow_type(kind), width, scale), as_rows), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, width)
    for _ in range(rounds if first else 0):
        sums = kept.mapInArrow(_partial_sums(centroids), "cluster int, sums array<long>, n long").select("cluster", "n", F.posexplode("sums").alias("at", "x"))
        for r in sums.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect():
            centroids[r.cluster, r.at] = int(r.x) // r.n
    assigned = materialise(kept.mapInArrow(_assign(centroids), f"vec_id {kind.simpleString()}, cluster int, distance long"), "clusters")
    release(kept)
    # One row for each centroid.
    inertia = {r.cluster: int(r.x) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(j, inertia[j], sum(inertia.values()), digests[j]) for j in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rows in SQL, without screening: one pair of expressions for each round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept)",
        f"""c0 AS (SELECT number, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS number FROM kept) WHERE number < {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT row, min_by(number, (d, number)) AS cluster, min(d) AS distance FROM (SELECT row, number, sum((x - y) * (x - y)) AS d FROM parts JOIN c{r} USING (pos) GROUP BY row, number) GROUP BY row)")
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT cluster AS number, pos, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM parts JOIN a{r} USING (row) GROUP BY cluster, pos),
c{r + 1} AS (SELECT c.number, c.pos, CASE WHEN m.n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{r} c LEFT JOIN m{r} m ON m.number = c.number AND m.pos = c.pos)"""
            )
    return f"""WITH {', '.join(steps)},
sha AS (SELECT number, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY number)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (row) JOIN sha ON number = cluster"""


ORACLE = oracle()
