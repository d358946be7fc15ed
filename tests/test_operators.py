"""Small cases of the operators: filters, edges of search, quantiles, chunks, sync and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.filters import compile_filter, tenant_filter
from tessera.operators import analytics, catalog, ingest, retrieval, sync
from tessera.streaming.timelines import daily_counts


def test_filters_hold_for_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "b", 5.0)], "id int, s string, x double")

    def kept(f):
        return sorted(r.id for r in df.where(compile_filter(f)).collect())

    assert kept({"s": "a"}) == [1]
    assert kept({"s": {"$ne": "a"}}) == [2, 3]
    assert kept({"x": {"$gt": 1, "$lte": 2}}) == [1]
    assert kept({"s": {"$in": []}}) == []
    assert kept({"s": {"$gt": 0}}) == []
    assert compile_filter({}) is None
    assert tenant_filter({"t": "x", "s": "a"}, "t", "y") == {"t": "y", "s": "a"}


@pytest.mark.parametrize("bad", [{"1x": 1}, {"s": {}}, {"s": None}, {"s": [1]}, {"s": {"$like": 1}}, {"s": {"$gt": True}}, {"s": {"$in": "a"}}])
def test_bad_filters_are_refused(spark, bad):
    with pytest.raises(ValueError):
        compile_filter(bad)


def test_vectors_with_ties_zeros_and_nulls(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "id long, vector array<double>")
    q = rows.where("id = 1").select(F.col("id").alias("query_id"), "vector")
    found = [(r.id, r.rank, r.score) for r in retrieval.vector_topk(q, rows, 4).orderBy("rank").collect()]
    assert found == [(1, 1, 1.0), (3, 2, 1.0), (2, 3, 0.0), (5, 4, 0.0)]
    assert retrieval.vector_topk(q, rows.limit(0), 4).count() == 0


def test_fusion_of_one_empty_list_scores_half(spark):
    one = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank long")
    found = retrieval.fuse(one, one.limit(0), 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [(7, 0.5), (8, round(61 / 62 / 2, 6))]


def test_evaluation_counts_repeats_in_the_gain(spark):
    hits = spark.createDataFrame([(1, 1, 5, True), (1, 2, 5, True), (2, 1, 9, False)], "query_id long, rank long, id long, relevant boolean")
    cases = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "query_id long, n_relevant long")
    found = {r.query_id: (r.recall, r.reciprocal_rank, r.ndcg) for r in retrieval.evaluate(hits, cases).collect()}
    assert found == {1: (1.0, 1.0, 1.6309), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_quantile_narrows_to_the_exact_value(spark, p):
    for values in ([float(i * i % 10_007) for i in range(9_000)], [1.0] * 8_000 + [2.0] * 20, [3.0], [1.0, 2.0]):
        df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(4)
        assert analytics.exact_quantile(df, "x", p, small=100) == pytest.approx(pd.Series(values).quantile(p))
    assert analytics.exact_quantile(df.limit(0), "x", p) is None


def test_chunks_overlap_at_a_space(spark):
    docs = spark.createDataFrame([(1, "abcd efgh ijkl"), (2, " \n"), (3, None)], "doc_id long, text string")
    found = [(r.id, r.text, r.char_start, r.char_end) for r in ingest.window_chunks(docs, 8, 5).orderBy("id").collect()]
    assert found == [("1_0", "abcd efg", 0, 8), ("1_1", "efgh ijkl", 5, 14)]


def test_copies_within_a_scope(spark):
    docs = spark.createDataFrame([(2, "s", "x"), (1, "s", "x"), (3, "t", "x"), (4, "s", None), (5, "s", None)], "doc_id long, source string, text string")
    found = {r.doc_id: (r.first_id, r.deduped) for r in catalog.content_duplicates(docs, "source").collect()}
    assert found == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False)}


def test_cache_cut_keeps_ties(spark):
    cache = spark.createDataFrame([(1, 9), (2, 8), (3, 8), (4, 7)], "k int, at int")
    assert sorted(r.k for r in catalog.recent_cut(cache, "at", 2).collect()) == [1, 2, 3]


def test_sync_states_and_guard(spark):
    cols = "remote_id long, signature string, content_hash string"
    old = spark.createDataFrame([(1, "a", "h", "ready"), (2, "a", "h", "failed"), (3, "a", "h", None), (4, "a", "h", "ready"), (5, "a", "h", "ready")], cols + ", status string")
    new = spark.createDataFrame([(1, "a", "z"), (2, "a", "h"), (3, "a", "h"), (4, "b", "h"), (6, "a", "h")], cols)
    diff = sync.sync_diff(old, new)
    assert {r.remote_id: r.state for r in diff.collect()} == {1: "skipped", 2: "updated", 3: "updated", 4: "skipped", 5: "deleted", 6: "created"}
    assert not sync.sync_counters(diff).first().guarded
    many = spark.range(12).select(F.col("id").alias("remote_id"), F.lit("deleted").alias("state"))
    assert sync.sync_counters(many).first().guarded


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_counts(events).collect()))
