"""The stored indexes against the exact searches, on skewed, tied and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword_index, retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 16))
    # A third of all rows are copies of one vector, so one cell is much larger than a block.
    rows = [(k, [float(np.float32(x)) for x in (centres[0] if k % 3 == 0 else centres[k % 12] + rng.normal(0, 0.15, 16))]) for k in range(4000)]
    rows += [(5000, [0.0] * 16), (5001, [0.0] * 16), (5002, None), (None, rows[1][1]), (5003, [-x for x in rows[0][1]])]
    return spark.createDataFrame(rows, "id long, vector array<float>")


def asked(vectors):
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "rank", "score").collect())


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}/index"
    vector_index.build_index(vectors, path, cells=20)
    return path


def test_exact_search_of_the_index_equals_the_search_of_all_rows(spark, vectors, index):
    assert sorted_rows(vector_index.search_index(spark, index, asked(vectors), 7)) == sorted_rows(retrieval.vector_topk(asked(vectors), vectors, 7))


def test_every_row_is_indexed_once_in_bounded_blocks(spark, vectors, index):
    blocks = spark.read.parquet(f"{index}/blocks")
    ids = blocks.select(F.explode("ids").alias("id"))
    assert sorted(r.id for r in ids.collect()) == sorted(r.id for r in vectors.where("id IS NOT NULL AND vector IS NOT NULL").collect())
    assert blocks.agg(F.max(F.size("ids"))).first()[0] <= vector_index.ROW_BLOCK
    assert blocks.groupBy("cell").count().agg(F.max("count")).first()[0] > 1


def test_probes_reach_the_recall_that_they_were_tuned_for(spark, vectors, index):
    exact = retrieval.vector_topk(asked(vectors), vectors, 10)
    others = vectors.where("id % 50 = 25").select(F.col("id").alias("query_id"), "vector")
    probes = vector_index.probes_for(spark, index, others, 10)
    assert 1 <= probes < 20
    found = vector_index.search_index(spark, index, asked(vectors), 10, probes)
    share = vector_index.recall(found, exact).agg(F.sum("found") / F.sum("wanted")).first()[0]
    assert share >= 0.9
    # Folders of other cells aren't read.
    plan = vector_index.search_index(spark, index, asked(vectors).limit(1), 10, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters: [")[1]


def test_an_index_of_no_rows(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build_index(vectors.limit(0), path)
    assert vector_index.search_index(spark, path, asked(vectors), 3).count() == 0
    assert vector_index.probes_for(spark, path, asked(vectors), 3) == 0


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    share = 1 / np.arange(1, 401)
    rows = [(k, " ".join(["common", *rng.choice(words, int(rng.integers(0, 60)), p=share / share.sum())])) for k in range(9000)]
    rows += [(k, "common w3 w3") for k in range(9000, 9500)] + [(20000, None), (20001, ""), (None, "w1 w2"), (20002, "W7 w7, É w7!"), (20003, "rare " * 5000)]
    return spark.createDataFrame(rows, "id long, text string")


def test_the_keyword_index_equals_the_search_of_all_texts(spark, texts, tmp_path):
    path = f"file://{tmp_path}/index"
    keyword_index.build_keyword_index(texts, path)
    queries = spark.createDataFrame([(1, "common w3 w3"), (2, "w7 w390 w250"), (3, "rare"), (4, "unheard"), (5, ""), (6, None), (7, "w1 w2 w3 w4 common")], "query_id long, query string")
    wanted = sorted_rows(retrieval.bm25_topk(queries, texts.where("id IS NOT NULL"), 10))
    assert sorted_rows(keyword_index.search_keyword_index(spark, path, queries, 10)) == wanted
    assert sorted_rows(keyword_index.search_keyword_index(spark, path, queries, 10, skip=False)) == wanted
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max(F.size("ids"))).first()[0] <= keyword_index.RANGE_DOCS
    assert blocks.where("term = 'common'").count() > 4


def test_a_keyword_index_of_no_texts(spark, texts, tmp_path):
    path = f"file://{tmp_path}/index"
    keyword_index.build_keyword_index(texts.limit(0), path)
    assert keyword_index.search_keyword_index(spark, path, spark.createDataFrame([(1, "w1")], "query_id long, query string"), 3).count() == 0
