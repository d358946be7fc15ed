"""Overlapping spans by bins, against all pairs."""

import random

from pyspark.sql import functions as F

from tessera.operators import chunkers


def _spans(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        low = draw.choice([0, 10, 64, draw.randrange(2000)])
        rows.append((draw.randrange(3), k, low, low + draw.choice([0, 1, 54, 64, draw.randrange(1500)])))
    return rows + [(0, n, None, 5), (1, n + 1, 5, None), (None, n + 2, 0, 9)]


def test_pairs_equal_all_pairs_and_come_once(spark):
    left, right = _spans(1, 150), _spans(2, 150)
    found = chunkers.span_pairs(spark.createDataFrame(left, "doc_id long, l long, l0 long, l1 long"), spark.createDataFrame(right, "doc_id long, r long, r0 long, r1 long"), width=64)
    real = [x for x in left if None not in x], [x for x in right if None not in x]
    wanted = sorted((a[1], b[1]) for a in real[0] for b in real[1] if a[0] == b[0] and b[2] < a[3] and b[3] > a[2])
    assert sorted((r.l, r.r) for r in found.select("l", "r").collect()) == wanted and len(wanted) > 1000


def test_elements_without_a_span_go_to_the_first_chunk(spark):
    chunks = spark.createDataFrame([(1, k, k * 5000, k * 5000 + 5000) for k in range(40)], "doc_id long, chunk_index long, char_start long, char_end long")
    elements = spark.createDataFrame([(1, 0, "image", None, None), (1, 1, "table", 4999, 5001), (1, 2, "text", 0, 9), (1, 3, "heading", 199_999, 200_000), (2, 0, "image", 0, 9)] + [(1, 10 + k, "image", 100, 120) for k in range(9)], "doc_id long, element_index long, kind string, char_start long, char_end long")
    refs = {r.chunk_index: (r.content_kinds, r.refs) for r in chunkers.element_refs(elements, chunks).collect()}
    assert refs == {0: ("image,table", "0,1,10,11,12,13,14,15"), 1: ("table", "1"), 39: ("heading", "3")}
    assert chunkers.element_refs(elements.limit(0), chunks).count() == chunkers.element_refs(elements, chunks.where(F.lit(False))).count() == 0
