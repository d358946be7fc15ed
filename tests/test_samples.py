"""Seeded samples: bounds, reruns, and groups of every size."""

from pyspark.sql import functions as F

from tessera.operators import samples


def test_samples_agree_between_runs_and_differ_between_seeds(spark):
    docs = spark.createDataFrame([(k, "big" if k % 10 else None, k % 9) for k in range(500)] + [(None, "big", 3), (900, "one", 2)], "doc_id long, place_of string, chunk_count long")
    drawn = lambda seed, parts: {(r.place_of, r.place): r.doc_id for r in samples.sample_documents(docs.repartition(parts), seed, "place_of", 5).collect()}
    first = drawn(1, 3)
    assert first == drawn(1, 11) and first != drawn(2, 3)
    assert len(first) == 11 and first[("one", 1)] == 900
    assert len({v for v in first.values()}) == 11


def test_runs_of_chunks_are_neighbours_within_the_document(spark):
    docs = spark.createDataFrame([(k, k % 9) for k in range(200)], "doc_id long, chunk_count long")
    runs = samples.chunk_runs(docs, 3).groupBy("doc_id", "chunk_count").agg(F.count("*").alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high")).collect()
    assert len(runs) == sum(k % 9 > 0 for k in range(200))
    for r in runs:
        assert r.n == min(4, r.chunk_count) == r.high - r.low + 1 and 0 <= r.low and r.high < r.chunk_count
    assert len({r.low for r in runs if r.chunk_count == 8}) > 2
    assert samples.chunk_runs(docs.limit(0), 3).count() == 0
