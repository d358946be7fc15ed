"""An inverted-file index for search by vector: rows in cells around centroids, written once, of which a search reads the nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.retrieval import k_best, ranked

#: Cells at most, rows of the sample that centroids are fitted on for each cell, and rounds of fitting.
MAX_CELLS, SAMPLE, ROUNDS = 16_384, 256, 8
#: Rows and queries of a block.
ROW_BLOCK, QUERY_BLOCK = 1024, 256
#: Rows times cells that are held at a time, and rows of a batch that searches are sent on in.
HELD, SENT = 1 << 19, 8192
#: Cells that an exact search probes before it knows how far it must go.
FIRST = 4


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    m = m.astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The rows, as many at a time as meet all cells within the bound."""
    step = max(1, HELD // max(1, cells))
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _partial_sums(centroids: np.ndarray):
    """Sums of the unit vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in _slices(batches, len(centroids)):
            u = unit(_matrix(batch.column(0)))
            cell = (u @ centroids.T).argmax(axis=1)
            np.add.at(sums, cell, u)
            counts += np.bincount(cell, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _lists(sums[some])], names=["cell", "sums"])

    return run


def fit_centroids(rows: DataFrame, cells: int | None = None, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of rows (id, vector), fitted on a sample of about ``sample`` rows for each cell, chosen by a hash of the id.

    The sample is the documented bound of fitting; each round is one pass over it, and cells x components sums reach the driver.
    """
    n = rows.count()
    cells = min(cells or int(np.ceil(np.sqrt(n))), n, MAX_CELLS)
    if not cells:
        return np.zeros((0, 0))
    key = F.xxhash64("id")
    most = cells * sample
    held = rows.where(F.pmod(key, F.lit(n)) < most) if n > most else rows
    first = held.orderBy(key, "id").limit(cells).select("vector").collect()
    centroids = unit(np.array([r.vector for r in first]))
    for _ in range(rounds):
        sums = held.select("vector").mapInArrow(_partial_sums(centroids), "cell int, sums array<double>").select("cell", F.posexplode("sums").alias("at", "x"))
        moved = centroids.copy()
        for r in sums.groupBy("cell", "at").agg(F.sum("x").alias("x")).collect():
            moved[r.cell, r.at] = r.x
        centroids = unit(moved)
    return centroids


def _cells(centroids: np.ndarray):
    """Each row's nearest cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(centroids)):
            cell = (unit(_matrix(batch.column("vector"))) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), batch.column("vector")], names=["cell", "id", "vector"])

    return run


def _packed(rows_per_block: int, centroids: np.ndarray | None = None):
    """Rows sorted by cell in blocks of one cell each: ids, the vectors' bytes, and how far the farthest is from the centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held = -1, [], []

        def block() -> pa.RecordBatch:
            m = np.concatenate(held)
            far = float(np.linalg.norm(unit(m) - centroids[cell], axis=1).max()) if centroids is not None else 0.0
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([m.astype(np.float64).tobytes() if m.dtype != np.float32 else m.tobytes()]), pa.array([m.dtype == np.float32]), pa.array([far])], names=["cell", "ids", "m", "short", "radius"])

        for batch in batches:
            of = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for at, end in zip(cuts, [*cuts[1:], len(of)], strict=True):
                while at < end:
                    n = sum(map(len, ids))
                    if ids and (of[at] != cell or n == rows_per_block):
                        yield block()
                        ids, held, n = [], [], 0
                    cell = int(of[at])
                    take = batch.slice(at, min(end - at, rows_per_block - n))
                    ids.append(take.column("id").to_numpy())
                    held.append(_matrix(take.column("vector")))
                    at += take.num_rows
        if ids:
            yield block()

    return run


_BLOCK = "cell int, ids array<long>, m binary, short boolean, radius double"


def _in_blocks(df: DataFrame, rows_per_block: int, centroids: np.ndarray | None = None) -> DataFrame:
    """Rows (cell, id, vector) as blocks. Ranges are cut by cell and id, so a cell that very many rows have goes over many tasks."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(ranges, "cell", F.xxhash64("id")).sortWithinPartitions("cell").mapInArrow(_packed(rows_per_block, centroids), _BLOCK)


def build_index(rows: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> None:
    """Write an index of rows (id, vector) under path: blocks of rows, one folder for each cell, and the centroids with their cells' sizes and radii.

    All rows with an id and a vector are indexed; vectors have one length. Without ``cells``, there are about as many as the root of the rows.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col("id").cast("long").alias("id"), "vector").where("id IS NOT NULL AND vector IS NOT NULL")
    centroids = fit_centroids(kept, cells, rounds)
    kind = rows.schema["vector"].dataType.simpleString()
    blocks = _in_blocks(kept.mapInArrow(_cells(centroids), f"cell int, id long, vector {kind}"), ROW_BLOCK, centroids)
    blocks.write.partitionBy("cell").parquet(f"{path}/blocks")
    # The folders are named, not discovered, so that an empty index can be read too.
    sizes = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.max("radius").alias("radius"))
    made = spark.createDataFrame([(j, c) for j, c in enumerate(centroids.tolist())], "cell int, centroid array<double>")
    made.join(F.broadcast(sizes), "cell", "left").select("cell", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius")).coalesce(1).write.parquet(f"{path}/centroids")


def _probes(centroids: np.ndarray, radius: np.ndarray, filled: np.ndarray, most: int | None):
    """Cells to search for each query: the ``most`` nearest, or all that may hold a row as good as the query's least score.

    By the triangle inequality a row of a cell is no nearer to the query than the centroid is, less the cell's radius.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(centroids)):
            u = unit(_matrix(batch.column("vector")))
            near = u @ centroids.T
            if most is not None:
                near[:, ~filled] = -np.inf
                order = np.argsort(-near, axis=1, kind="stable")[:, :most]
                row, cell = np.repeat(np.arange(len(u)), order.shape[1]), order.ravel()
                row, cell = row[filled[cell]], cell[filled[cell]]
            else:
                least = batch.column("least").fill_null(0.0).to_numpy(zero_copy_only=False)
                apart = np.sqrt(np.maximum((u * u).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * near, 0))
                best = 1 - np.maximum(apart - radius - 1e-7, 0) ** 2 / 2
                row, cell = np.nonzero((np.maximum(best, 0) + 1e-6 >= least[:, None]) & filled)
            for at in range(0, len(row), SENT):
                take = pa.array(row[at : at + SENT])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + SENT].astype(np.int32)), batch.column("query_id").take(take), batch.column("vector").take(take)], names=["cell", "id", "vector"])

    return run


def _best(k: int):
    """The k best rows of each pair of blocks for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, q_ids = (batch.column(c)[at].values.to_numpy() for c in ("ids", "q_ids"))
                q, d = (unit(np.frombuffer(batch.column(m)[at].as_buffer(), np.float32 if batch.column(s)[at].as_py() else np.float64).reshape(n, -1)) for m, s, n in (("q_m", "q_short", len(q_ids)), ("m", "short", len(ids))))
                query, row, score = k_best(np.round(np.maximum(q @ d.T, 0), 9), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(ids[row]), pa.array(score)], names=["query_id", "id", "score"])

    return run


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k best rows of the index for each query (query_id, vector): query_id, id, rank, score = max(0, cosine).

    With ``probes``, each query is held against the rows of so many nearest cells, and better rows elsewhere may be missed. Without, the
    result is exact: the k-th score among the first few cells tells which others can hold a better row, and only those are read.
    Queries and rows meet in blocks of one cell, which Spark joins by cell; folders of cells that no query probes aren't read.
    Ties go to the smaller id.
    """
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # bounded by MAX_CELLS
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector")
    if not table:
        return spark.createDataFrame([], "query_id long, id long, rank long, score double")
    centroids, radius, filled = np.array([r.centroid for r in table]), np.array([r.radius for r in table]), np.array([r.n > 0 for r in table])
    kind = queries.schema["vector"].dataType.simpleString()

    def hits(of: DataFrame, most: int | None) -> DataFrame:
        wanted = of.mapInArrow(_probes(centroids, radius, filled, most), f"cell int, id long, vector {kind}")
        q = _in_blocks(wanted, QUERY_BLOCK).select("cell", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("short").alias("q_short"))
        read = blocks
        if most is not None and most < len(table):
            cells = [r.cell for r in wanted.select("cell").distinct().collect()]
            read = blocks.where(F.col("cell").isin(cells))
        pairs = read.select("cell", "ids", "m", "short").join(q, "cell")
        return ranked(pairs.mapInArrow(_best(k), "query_id long, id long, score double"), k, F.desc("score"), "id")

    if probes is not None:
        return hits(asked, probes)
    least = hits(asked, FIRST).where(F.col("rank") == k).select("query_id", F.col("score").cast(DoubleType()).alias("least"))
    return hits(asked.join(least, "query_id", "left"), None)


def _places(centroids: np.ndarray, filled: np.ndarray):
    """The place of a cell among a query's cells, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(centroids)):
            near = unit(_matrix(batch.column("vector"))) @ centroids.T
            near[:, ~filled] = -np.inf
            own = near[np.arange(len(near)), batch.column("cell").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((near > own[:, None]).sum(axis=1) + 1)], names=["place"])

    return run


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int, target: float = 0.95) -> int:
    """The fewest cells to probe with which ``target`` of the exact hits of sample queries (query_id, vector) are found.

    An exact hit is found once its cell is probed, so the places of the hits' cells tell the recall of every number of probes at once.
    """
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    if not table:
        return 0
    centroids, filled = np.array([r.centroid for r in table]), np.array([r.n > 0 for r in table])
    where = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("cell", F.explode("ids").alias("id"))
    exact = search_index(spark, path, queries, k).select("query_id", "id")
    hits = where.join(exact, "id").join(queries, "query_id").select("cell", "vector")
    places = hits.mapInArrow(_places(centroids, filled), "place long").groupBy("place").count().orderBy("place").collect()  # one row a cell at most
    total, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= target * total:
            return r.place
    return len(table)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """For each query of ``exact``: how many of its hits are there (wanted), and how many of them were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
