"""Exact top-k search by inner product: score histograms locate each query's k-th score, then rows are filtered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release
from tessera.llm.vectors import whole_vectors

#: Production parameters: hits of a query, the scale of components, and which ids are queries.
K, SCALE, EVERY = 10, 1024, 100
#: Queries of a block, and bits of the score that one round of histograms settles.
QUERY_BLOCK, BITS = 256, 12
BINS = 1 << BITS


def _pack(scale: int, most: int | None = None):
    """Valid vectors in blocks of one size of vectors each: ids, row numbers, which are queries, the largest component and norm, and the doubles of the whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, sizes, x = whole_vectors(batch.column("embedding"), scale)
            rows, sizes = np.flatnonzero(valid), sizes[valid]
            ends = np.r_[0, np.cumsum(sizes)]
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                m = x[(ends[of][:, None] + np.arange(size)).ravel()].reshape(len(of), size)
                take = pa.array(rows[of])
                column = lambda name: batch.column(name).take(take)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([column(n).to_pylist()], t) for n, t in (("vec_id", pa.list_(pa.int64())), ("row", pa.list_(pa.int64())), ("asks", pa.list_(pa.bool_())))]
                    + [pa.array([int(size)], pa.int32()), pa.array([len(of)], pa.int64()), pa.array([float(np.abs(m).max(initial=0))]), pa.array([float(np.sqrt((m * m).sum(axis=1)).max(initial=0))]), pa.array([m.tobytes()], pa.binary())],
                    names=["ids", "rows", "asks", "size", "n", "largest", "norm", "m"],
                )

    return run


_BLOCK = "ids array<long>, rows array<long>, asks array<boolean>, size int, n long, largest double, norm double, m binary"


def _matrix(body: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(body, np.float64).reshape(n, size)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of blocks, in blocks of QUERY_BLOCK: number, ids, rows, and their matrix."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for r in batch.to_pylist():
            m = _matrix(r["m"], r["n"], r["size"])
            asks = np.flatnonzero(r["asks"])
            for at in range(0, len(asks), QUERY_BLOCK):
                of = asks[at : at + QUERY_BLOCK]
                ids, rows = ([r[c][i] for i in of] for c in ("ids", "rows"))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.int64())), pa.array([r["size"]], pa.int32()), pa.array([m[of].tobytes()], pa.binary())], names=["block", "q_ids", "q_rows", "q_size", "q_m"])
                number += 1


_QUERIES = "block long, q_ids array<long>, q_rows array<long>, q_size int, q_m binary"


def _scored(batches: Iterator[pa.RecordBatch], largest: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each pair of blocks with the scores of all its queries and rows, and where a query meets its own row.

    Vectors of different sizes are compared over the components that both have. Doubles are exact while
    all sums stay below 2**53; beyond, longs are multiplied.
    """
    kind = np.float64 if largest < 1 << 53 else np.int64
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            q, d = _matrix(r["q_m"], len(r["q_ids"]), r["q_size"]), _matrix(r["m"], r["n"], r["size"])
            both = min(r["q_size"], r["size"])
            scores = (q[:, :both].astype(kind) @ d[:, :both].astype(kind).T).astype(np.int64)
            own = np.asarray(r["q_rows"])[:, None] == np.asarray(r["rows"]) if np.intersect1d(r["q_rows"], r["rows"]).size else None
            yield r, scores, own


def _histograms(bound: int, largest: int, shift: int):
    """Counts of scores by bins of 1 << shift from each query's lowest possible k-th score on.

    Bins below that in which this pair's own count from the top reaches what the query still needs can't hold its k-th score, and stay here.
    """
    out = pa.schema({"block": pa.int64(), "q": pa.int32(), "low": pa.int64(), "need": pa.int64(), "bin": pa.int32(), "n": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, scores, own in _scored(batches, largest):
            low, need = (np.array([s[c] for s in r["state"]], np.int64) for c in ("low", "need"))
            scores += (bound - low)[:, None]
            scores >>= shift
            held = (scores >= 0) & (scores < BINS)
            if own is not None:
                held &= ~own
            scores += (np.arange(len(low)) * BINS)[:, None]
            counts = np.bincount(scores[held], minlength=len(low) * BINS).reshape(len(low), BINS)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), r["block"])), pa.array(q.astype(np.int32)), pa.array(low[q]), pa.array(need[q]), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], schema=out)

    return run


def _hits(bound: int, largest: int, k: int):
    """Rows of at least each query's k-th score; of those of exactly that score no more than k of the smallest ids of each pair of blocks."""
    out = pa.schema({"q_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "row": pa.int64(), "score": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, scores, own in _scored(batches, largest):
            least = np.array([s["low"] for s in r["state"]], np.int64) - bound
            held = scores >= least[:, None]
            if own is not None:
                held &= ~own
            q, d = np.nonzero(held)
            null = np.array([x is None for x in r["ids"]])
            ids = np.array([x or 0 for x in r["ids"]], np.int64)
            score, rows = scores[q, d], np.asarray(r["rows"], np.int64)
            order = np.lexsort((rows[d], ids[d], null[d], -score, q))
            q, d, score = q[order], d[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, d, score = q[rank < k], d[rank < k], score[rank < k]
            q_rows, q_ids = np.asarray(r["q_rows"], np.int64), pa.array(r["q_ids"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q_rows[q]), q_ids.take(pa.array(q)), pa.array(ids[d], mask=null[d]), pa.array(rows[d]), pa.array(score)], schema=out)

    return run


def exact_topk(vectors: DataFrame, asks: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of vectors (vec_id long, embedding) for which ``asks`` holds, the k other rows with the highest inner product of floor(scale * x).

    All scores are computed block by block, and only counts leave a task: each round adds up one histogram for each query over the
    whole table and keeps the bin that holds its k-th score, which the next round divides further, until that score
    is known. A last pass keeps rows of at least that score; ties go to the smaller vec_id, then to the earlier row. Scores aren't stored.

    Null vectors and vectors with null or non-finite components take no part. Vectors of different sizes are compared over the components that
    both have. A null vec_id comes after all others on ties. Only a query's own row is left out: another row of its id or with its
    vector is a hit like any other. With fewer than k other rows all are returned; an empty table gives no rows, and other
    columns are ignored. Scores that might not fit a long are an error.
    """
    numbered = vectors.select("vec_id", "embedding", F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    blocks = materialise(numbered.mapInArrow(_pack(scale), _BLOCK), "blocks")
    found = blocks.agg(F.sum("n"), F.max("largest"), F.max("norm"), F.max("size")).first()
    k = min(k, (found[0] or 0) - 1)
    if k < 1:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    largest = int(found[1]) ** 2 * found[3]
    bound = min(largest, int(found[2] ** 2 * (1 + 1e-9)) + 1)
    if largest >= 1 << 62:
        raise OverflowError("scores may not fit a long")
    queries = materialise(blocks.where(F.exists("asks", lambda x: x)).select("rows", "ids", "asks", "size", "n", "m").mapInArrow(_queries, _QUERIES), "queries")
    kind = "array<struct<q:int,low:long,need:long>>"
    state = queries.select("block", F.transform("q_ids", lambda _, i: F.struct(i.cast("int").alias("q"), F.lit(0).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))).cast(kind).alias("state"))
    # Blocks against blocks: the stated queries against all rows.
    rows = blocks.select("ids", "rows", "size", "n", "m")
    pairs = lambda: rows.crossJoin(queries.join(state, "block"))
    written = []
    for shift in reversed(range(0, (2 * bound).bit_length(), BITS)):
        counts = pairs().mapInArrow(_histograms(bound, largest, shift), "block long, q int, low long, need long, bin int, n long")
        counts = counts.groupBy("block", "q", "low", "need", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("block", "q").orderBy(F.desc("bin"))) - F.col("n")
        kth = counts.withColumn("above", above).where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        settled = F.struct("q", (F.col("low") + F.shiftleft(F.col("bin").cast("long"), shift)).alias("low"), (F.col("need") - F.col("above")).alias("need"))
        state = materialise(kth.groupBy("block").agg(F.sort_array(F.collect_list(settled)).cast(kind).alias("state")), "kth")
        written.append(state)
    hits = materialise(pairs().mapInArrow(_hits(bound, largest, k), "q_row long, query_id long, vec_id long, row long, score long"), "hits")
    release(blocks, queries, *written)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""WITH kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT row, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept),
summed AS (SELECT q.row AS q_row, d.row AS d_row, CAST(sum(q.x * d.x) AS BIGINT) AS score FROM parts q JOIN parts d ON q.pos = d.pos AND q.row <> d.row AND q.vec_id % {EVERY} = 0 GROUP BY q.row, d.row),
scored AS (SELECT q.row AS q_row, q.vec_id AS query_id, d.vec_id AS vec_id, d.row AS row, coalesce(score, 0) AS score FROM kept q JOIN kept d ON q.row <> d.row AND q.vec_id % {EVERY} = 0 LEFT JOIN summed s ON s.q_row = q.row AND s.d_row = d.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id NULLS LAST, row) AS rank FROM scored) WHERE rank <= {K}"""
