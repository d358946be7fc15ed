"""A stored keyword index: postings in blocks of one term and one range of documents, with what a block can score at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import index_tokens
from tessera.operators.retrieval import K1, B, ranked

#: Documents of a range, folders of terms, and tasks that the blocks of a folder are dealt to.
RANGE_DOCS, BUCKETS, SALT = 2048, 64, 8
#: Ranges that a search scores for each query before it knows which others can matter.
FIRST = 4
_BLOCK = "term string, range long, ids array<long>, tfs array<int>, lens array<int>, max_tf int, min_len int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each range of documents, grouped by term; one more block, of no term, holds the lengths of all its documents."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for whole in batches:
        for at in range(0, whole.num_rows, RANGE_DOCS):
            batch = whole.slice(at, RANGE_DOCS)
            ids, tokens = batch.column(0).to_numpy(), batch.column(1)
            lens = pc.list_value_length(tokens).to_numpy().astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lens), return_counts=True)
            term, doc = pairs // len(ids), pairs % len(ids)
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            ends = pa.array(np.r_[0, starts[1:], len(term), len(term) + len(ids)] if len(term) else [0, len(ids)], pa.int32())
            lists = lambda x, every, t: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x, every]), t))  # noqa: E731, B023
            least = lambda f, x: f.reduceat(x, starts) if len(starts) else x  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*coded.dictionary.take(pa.array(term[starts])).to_pylist(), None], pa.string()), pa.array(np.full(len(starts) + 1, number)),
                    lists(ids[doc], ids, pa.int64()), lists(tf, np.zeros(len(ids), np.int64), pa.int32()), lists(lens[doc], lens, pa.int32()),
                    pa.array(np.r_[least(np.maximum, tf), 0], pa.int32()), pa.array(np.r_[least(np.minimum, lens[doc]), 0], pa.int32()),
                ],
                names=["term", "range", "ids", "tfs", "lens", "max_tf", "min_len"],
            )
            number += 1


def bucket(term: Column) -> Column:
    """The folder that a term's blocks are in."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_keyword_index(docs: DataFrame, path: str) -> None:
    """Write an index of docs (id, text) under path: ``blocks`` and ``terms`` in one folder for each bucket of terms, and ``stats``.

    Each text is tokenized once. Its postings are grouped where they arise, a range of documents at a time, so no
    posting is shuffled alone and a frequent term has one block for each range, over many tasks. Texts without tokens
    count as documents of length 0; rows without an id are left out.
    """
    spark = docs.sparkSession
    tokens = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), index_tokens(F.col("text")).alias("tokens"))
    made = tokens.mapInArrow(_blocks, _BLOCK).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket(F.col("term"))))
    dealt = made.repartition("bucket", F.pmod("range", F.lit(SALT))).sortWithinPartitions("bucket", "term", "range")
    dealt.write.partitionBy("bucket").parquet(f"{path}/blocks")
    held = _read(spark, path)
    sizes = held.where("bucket = -1").select(F.size("ids").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("len"))
    sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("len") / F.sum("n")).alias("avg_len")).write.parquet(f"{path}/stats")
    held.where("bucket >= 0").groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_BLOCK}, bucket int").parquet(f"{path}/blocks")


def _gain(tf: Column, length: Column) -> Column:
    """What a term adds to a document's score, before its weight; it grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))


def search_keyword_index(spark: SparkSession, path: str, queries: DataFrame, k: int, skip: bool = True) -> DataFrame:
    """The k best documents of each query (query_id, query) by BM25: query_id, id, rank, score; the same rows as ``bm25_topk``.

    A block's highest tf and least length bound what its documents gain. The ranges with the highest bounds are scored first; then
    only ranges whose bound reaches the k-th score so far, and other blocks are never opened. Folders without a term of any query aren't read.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("term")).withColumn("bucket", bucket(F.col("term")))
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # BUCKETS at most
    stats = F.broadcast(spark.read.parquet(f"{path}/stats"))  # one row
    df = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms").where(F.col("bucket").isin(buckets))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, ["bucket", "term"]).crossJoin(stats).select("query_id", "bucket", "term", weight.alias("weight"), "avg_len")
    blocks = _read(spark, path).where(F.col("bucket").isin(buckets))

    heads = asked.join(blocks.select("bucket", "term", "range", "max_tf", "min_len"), ["bucket", "term"])
    bounds = heads.groupBy("query_id", "range").agg(F.sum(F.col("weight") * _gain(F.col("max_tf"), F.col("min_len"))).alias("bound"))

    def scored(ranges: DataFrame | None) -> DataFrame:
        wanted = asked if ranges is None else asked.join(ranges.select("query_id", "range"), "query_id")
        on = ["bucket", "term"] if ranges is None else ["bucket", "term", "range"]
        postings = wanted.join(blocks.select("bucket", "term", "range", "ids", "tfs", "lens"), on)
        each = postings.select("query_id", "weight", "avg_len", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
        gain = F.col("weight") * _gain(F.col("p.tfs"), F.col("p.lens"))
        return each.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum(gain), 9).alias("score"))

    best = lambda hits: ranked(hits, k, F.desc("score"), "id")
    if not skip:
        return best(scored(None))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    placed = bounds.withColumn("place", order)
    first = best(scored(placed.where(F.col("place") <= FIRST)))
    least = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    more = placed.where(F.col("place") > FIRST).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least")))
    return best(first.drop("rank").unionByName(scored(more)))
