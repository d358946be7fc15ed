"""Search by vector and by keyword, and fusion of ranked lists, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import index_tokens, keyword_fraction, query_terms

#: Rows of a block of vectors, and scores of a block that are held at a time.
QUERY_BLOCK, ROW_BLOCK, SCORES = 512, 4096, 262_144
K1, B = 1.2, 0.75
RRF_K = 60
MAX_TOP_K = 200


def pool_size(k: int) -> int:
    """Candidates of each list before fusion."""
    return min(5 * k, MAX_TOP_K)


def ranked(df: DataFrame, k: int, *order, by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their 1-based rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _blocks(df: DataFrame, id_col: str, vector: str, side: str, rows: int, group: str | None = None) -> DataFrame:
    """Vectors packed into blocks of bounded size, with their ids and whole-number groups."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                ids = part[id_col].to_numpy(np.int64)
                m = np.stack([np.asarray(v, np.float64) for v in part[vector]])
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                yield pd.DataFrame({f"{side}_ids": [ids.tobytes()], f"{side}_m": [m.tobytes()], f"{side}_groups": [part["_group"].to_numpy(np.int64).tobytes()]})

    groups = F.col(group) if group else F.lit(0)
    kept = df.select(id_col, vector, groups.cast("long").alias("_group")).where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.col("_group").isNotNull())
    return kept.mapInPandas(pack, f"{side}_ids binary, {side}_m binary, {side}_groups binary")


def k_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row, column) and scores of each row's k highest, ties to the smaller id."""
    low = -score
    # What isn't a number comes last.
    row, column = np.nonzero(~(low > np.partition(low, k - 1, axis=1)[:, k - 1, None])) if k < score.shape[1] else (x.ravel() for x in np.indices(score.shape))
    held = score[row, column]
    order = np.lexsort((ids[column], -held, row))
    # Rows keep their order, so an entry's rank is its distance from its row's first.
    kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return row[kept], column[kept], held[kept]


_BYTES = (("q_ids", np.int64), ("q_m", np.float64), ("d_ids", np.int64), ("d_m", np.float64), ("d_groups", np.int64))


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vector: str = "vector", group: str | None = None) -> DataFrame:
    """Exact top k by cosine: query_id, id, rank, score = max(0, cosine); with a group column, the k best of each group.

    Both sides are packed into blocks; each block of rows meets each block of
    queries once, as one matrix product that keeps its k best per query. Only
    those are shuffled. Null vectors are left out, a zero vector scores 0; all
    vectors have one length. Ties go to the smaller id.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The blocks are read where they lie in the batch; of their scores, few are held at a time.
            for q_ids, q_m, every, d_m, groups in zip(*([np.frombuffer(x.as_buffer(), t) for x in batch.column(c)] for c, t in _BYTES), strict=True):
                d = d_m.reshape(len(every), -1)
                parts = [(g, np.flatnonzero(groups == g)) for g in np.unique(groups)]
                step = max(1, SCORES // len(every))
                for lo in range(0, len(q_ids), step):
                    scores = np.round(np.maximum(q_m.reshape(len(q_ids), -1)[lo : lo + step] @ d.T, 0), 9)
                    for g, at in parts:
                        query, row, score = k_best(scores if len(parts) == 1 else scores[:, at], every[at], k)
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[lo + query]), pa.array(every[at[row]]), pa.array(score), pa.array(np.full(len(row), g))], names=["query_id", "id", "score", "_group"])

    q = _blocks(queries, "query_id", vector, "q", QUERY_BLOCK)
    d = _blocks(rows, id_col, vector, "d", ROW_BLOCK, group)
    # Blocks against blocks: the stated queries against all rows.
    found = d.crossJoin(q.drop("q_groups")).mapInArrow(best, "query_id long, id long, score double, _group long")
    if group is None:
        return ranked(found.drop("_group"), k, F.desc("score"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).withColumnRenamed("_group", group)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best texts of each query by BM25: query_id, id, rank, score.

    queries: query_id, query; docs: id, text. Each distinct term of a query counts once.
    Ties go to the smaller id; texts without any term aren't returned.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("term"))
    tokens = docs.select("id", index_tokens(F.col("text")).alias("tokens"))
    sizes = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    postings = (
        tokens.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
        .join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy("id", "term")
        .agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    )
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # sizes is one row.
    scored = terms.join(df, "term").join(postings, "term").crossJoin(F.broadcast(sizes)).groupBy("query_id", "id").agg(F.round(F.sum(weight * gain), 9).alias("score"))
    return ranked(scored, k, F.desc("score"), "id")


def rescored(found: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (query_id, id, rank) with the share of query terms they hold (query_id, id, bm25_rank, score); those that hold none go."""
    terms = queries.select("query_id", query_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    held = found.select("query_id", "id", F.col("rank").alias("bm25_rank")).join(terms, "query_id").join(docs.select("id", "text"), "id")
    return held.select("query_id", "id", "bm25_rank", keyword_fraction(F.col("text"), F.col("terms")).alias("score")).where(F.col("score") > 0)


def by_keyword(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of rescored candidates; ties keep the BM25 order."""
    return ranked(candidates, k, F.desc("score"), "bm25_rank").drop("bm25_rank")


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int, pool: int | None = None) -> DataFrame:
    """BM25 candidates rescored by the share of query terms they hold; ties keep the BM25 order."""
    return by_keyword(rescored(bm25_topk(queries, docs, pool or k), queries, docs), k)


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a list that lacks an id adds nothing. Ties: the first list's order, then the second's."""
    lists = first.select("query_id", "id", F.col("rank").alias("r1"), F.lit(None).cast("long").alias("r2")).unionByName(second.select("query_id", "id", F.lit(None).cast("long").alias("r1"), F.col("rank").alias("r2")))
    per_id = lists.groupBy("query_id", "id").agg(F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    gain = sum((F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0)) for r in ("r1", "r2")), F.lit(0.0))
    best = ranked(per_id.withColumn("raw", F.round(gain, 12)), k, F.desc("raw"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"))
    return best.select("query_id", "id", "rank", F.round(F.col("raw") * (RRF_K + 1) / 2, 6).alias("score"))


def hybrid_topk(queries: DataFrame, vectors: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Vector and keyword search over pools of candidates, fused. queries: query_id, query, vector; vectors: id, vector; texts: id, text."""
    pool = pool_size(k)
    return fuse(vector_topk(queries, vectors, pool), keyword_topk(queries, texts, pool), k)


#: Most queries of a batch, most cases of an evaluation, most ids of a status request.
MAX_BATCH, MAX_CASES, MAX_IDS = 20, 500, 100


def at_most(values: list, most: int, what: str) -> list:
    """The values, if there aren't too many of them."""
    if len(values) > most:
        raise ValueError(f"at most {most} {what}, not {len(values)}")
    return values


def with_defaults(queries: DataFrame, collections: DataFrame) -> DataFrame:
    """queries (query_id, collection_id, top_k, min_score, mode) with their collection's defaults where they are null; any other mode is semantic."""
    named = collections.select("collection_id", "default_top_k", "default_min_score", "default_mode")
    joined = queries.join(named, "collection_id", "left")
    mode = F.coalesce("mode", "default_mode", F.lit("semantic"))
    filled = joined.withColumn("top_k", F.coalesce("top_k", "default_top_k", F.lit(10))).withColumn("min_score", F.coalesce("min_score", "default_min_score"))
    return filled.withColumn("mode", F.when(mode.isin("keyword", "hybrid"), mode).otherwise("semantic")).drop("default_top_k", "default_min_score", "default_mode")


def retrieve(queries: DataFrame, vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank, score) of queries that each have a mode, top_k and min_score.

    queries: query_id, query, vector, mode, top_k, min_score. Each mode searches for its own queries: by keyword, each query's own top_k BM25
    candidates are rescored; hybrid search fuses pools of 5 x its own top_k. No top_k or pool goes beyond MAX_TOP_K. Then each query's
    first top_k stay, and last those of its least score, so fewer may be left.
    """
    asked = queries.withColumn("top_k", F.least(F.col("top_k"), F.lit(MAX_TOP_K)))
    of = lambda mode: asked.where(F.col("mode") == mode)

    def first(hits: DataFrame, times: int = 1) -> DataFrame:
        """Each query's own number of hits."""
        own = asked.select("query_id", F.least(F.col("top_k") * times, F.lit(MAX_TOP_K)).alias("own"))
        return hits.join(own, "query_id").where(F.col("rank") <= F.col("own")).drop("own")

    def keyword(q: DataFrame, times: int = 1) -> DataFrame:
        return by_keyword(rescored(first(bm25_topk(q, texts, MAX_TOP_K), times), q, texts), MAX_TOP_K)

    hybrid = fuse(first(vector_topk(of("hybrid"), vectors, MAX_TOP_K), 5), keyword(of("hybrid"), 5), MAX_TOP_K)
    shape = ("query_id", "id", "rank", "score")
    hits = vector_topk(of("semantic"), vectors, MAX_TOP_K).select(*shape).unionByName(keyword(of("keyword")).select(*shape)).unionByName(hybrid.select(*shape))
    cut = first(hits).join(asked.select("query_id", "min_score"), "query_id")
    return cut.where(F.col("min_score").isNull() | (F.col("score") >= F.col("min_score"))).select(*shape)


def multi_topk(queries: DataFrame, rows: DataFrame, k: int, min_score: float | None = None, collection: str = "collection") -> DataFrame:
    """The k best hits of each query over several collections, each of which is searched alone first: query_id, collection, id, rank, score.

    queries: query_id, vector; rows: id, vector, collection. Each collection gives its k best of at least min_score; those are
    merged, and scores are compared as they are.
    """
    pooled = vector_topk(queries, rows, k, group=collection)
    if min_score is not None:
        pooled = above(pooled, min_score)
    return ranked(pooled.drop("rank"), k, F.desc("score"), collection, "id").select("query_id", collection, "id", "rank", "score")


def above(hits: DataFrame, min_score: float) -> DataFrame:
    """Hits of at least that score. It comes after the top k, so a query may keep fewer."""
    return hits.where(F.col("score") >= min_score)


def evaluate(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Recall, reciprocal rank and nDCG of each case.

    hits: query_id, rank, id, relevant; cases: query_id, n_relevant. A repeated
    id counts once in recall and each time in the gain. A case without hits or
    relevant ids scores 0.
    """
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per_case = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        F.countDistinct(F.when(F.col("relevant"), F.col("id"))).alias("found"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(gain).alias("dcg"),
    )
    joined = cases.join(per_case, "query_id", "left").fillna(0, ["n_hits", "found", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_relevant", "n_hits")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.least("n_relevant", "n_hits") > 0
    return joined.select(
        "query_id",
        F.when(F.col("n_relevant") > 0, F.round(F.col("found") / F.col("n_relevant"), 4)).otherwise(0.0).alias("recall"),
        F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(some, F.round(F.col("dcg") / ideal, 4)).otherwise(0.0).alias("ndcg"),
    )


def averages(per_case: DataFrame) -> DataFrame:
    """One row over all cases of ``evaluate``: their number and the mean of each measure to 4 places; means of no cases are 0."""
    mean = lambda c: F.coalesce(F.round(F.round(F.avg(c), 9), 4), F.lit(0.0)).alias(f"avg_{c}")
    return per_case.agg(F.count("*").alias("n_cases"), mean("recall"), mean("reciprocal_rank"), mean("ndcg"))
