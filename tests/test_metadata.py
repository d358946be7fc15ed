"""Metadata as VARIANT: kinds never mix, nested values survive the store, odd payloads have defined results."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import metadata as meta

ROWS = [
    (1, '{"a": 7, "b": "7", "c": {"z": 1, "a": [1, {"q": null}]}, "n": null, "t": true}'),
    (2, "[1, 2]"),
    (3, None),
    (4, '{"a": 7.0, "b": 7, "t": 1, "c": "__tessera_json_v1__:{bad"}'),
    (5, '{"a": "7", "big": 9007199254740993}'),
    (6, "{}"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k long, j string").withColumn("metadata", F.parse_json("j")).cache()


@pytest.mark.parametrize(
    ("filters", "found"),
    [
        (None, {1, 2, 3, 4, 5, 6}), ({"a": 7}, {1, 4}), ({"a": "7"}, {5}), ({"b": {"$ne": 7}}, {1, 2, 3, 5, 6}), ({"t": True}, {1}), ({"t": 1}, {4}), ({"a": {"$gte": 7}}, {1, 4}),
        ({"a": {"$in": ["7", 7]}}, {1, 4, 5}), ({"a": {"$in": []}}, set()), ({"big": 9007199254740993}, {5}), ({"big": 9007199254740992}, set()), ({"n": {"$ne": 1}}, {1, 2, 3, 4, 5, 6}), ({"id": {"$lt": 3}}, {1, 2}),
    ],
)
def test_filters_keep_kinds_apart(rows, filters, found):
    kept = rows.where(meta.metadata_filter(filters, F.col("metadata"), {"id": F.col("k")}))
    assert {r.k for r in kept.select("k").collect()} == found


@pytest.mark.parametrize("filters", [{"a": None}, {"a": {"$gt": "x"}}, {"a": {"$gt": True}}, {"a": {"$in": 3}}, {"a": {}}, {"a b": 1}, {"a": {"$like": 1}}])
def test_malformed_filters_are_errors_and_match_no_document(rows, filters):
    with pytest.raises(ValueError):
        meta.metadata_filter(filters, F.col("metadata"))
    assert rows.where(meta.matches(filters, F.col("metadata"))).count() == 0


@pytest.mark.parametrize(
    ("wanted", "found"),
    [({"c": {"a": [{"q": None}]}}, {1}), ({"c": {"a": [1, 2]}}, set()), ({}, {1, 4, 5, 6}), ([2], {2}), ({"c": {"a": []}}, {1}), ({"n": None}, {1}), ({"c": {"z": 1, "a": [1]}, "t": True}, {1}), ({"a'b": 1}, set())],
)
def test_containment(rows, wanted, found):
    assert {r.k for r in rows.where(meta.contains(F.col("metadata"), wanted)).select("k").collect()} == found


def test_attributes_come_back(rows):
    read = rows.select("k", meta.encode_attributes(F.col("metadata")).alias("e")).select("k", "e", F.to_json(meta.decode_attributes(F.col("e"))).alias("back"), F.expr("CAST(e['c'] AS STRING)").alias("c"))
    back = {r.k: (r.back, r.c) for r in read.collect()}
    assert back[1] == ('{"a":7,"b":"7","c":{"a":[1,{"q":null}],"z":1},"t":true}', '__tessera_json_v1__:{"a":[1,{"q":null}],"z":1}')
    assert back[4] == ('{"a":7,"b":7,"c":"__tessera_json_v1__:{bad","t":1}', "__tessera_json_v1__:{bad")
    assert back[2] == back[3] == back[6] == ("{}", None)


def test_payloads_and_hits_of_odd_rows(spark, rows):
    hits = meta.split_payload(rows.select("k", F.col("k").alias("point_id"), F.col("metadata").alias("payload")))
    assert {r.k: (r.id, r.text, r.chunk_index) for r in hits.select("k", "id", "text", "chunk_index").collect()} == {k: (str(k), "", None) for k, _ in ROWS}
    shown = meta.shape_hits(hits.withColumn("page_no", F.lit(None).cast("long")).withColumn("embedding", F.array(F.lit(1.0))))
    assert "embedding" not in shown.columns and shown.where("page_no is not null").count() == 0
    assert meta.shape_hits(hits.limit(0), True).count() == 0
