"""What a Python worker holds doesn't grow with the rows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.operators import chunkers, html_blocks, retrieval, vector_index


def peak(rows) -> int:
    """The most that is allocated while each result is read and dropped."""
    tracemalloc.start()
    for _ in rows:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_k_best_matches_a_full_sort():
    rng = np.random.default_rng(4)
    for n, k in ((50, 7), (5, 9), (1, 1), (40, 40)):
        score = np.round(np.maximum(rng.normal(size=(30, n)), 0), 1)
        score[rng.random(score.shape) < 0.1] = np.nan
        ids = rng.permutation(n) * 7
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        row, column, held = retrieval.k_best(score, ids, k)
        assert np.array_equal(row, np.repeat(np.arange(30), order.shape[1])) and np.array_equal(column, order.ravel())
        assert np.array_equal(held, np.take_along_axis(score, order, 1).ravel(), equal_nan=True)


def test_texts_go_in_groups():
    texts = pa.array(["x" * 400_000, None, "y" * 700_000, "é" * 900_000, "", "z"])
    assert [len(g) for g in chunkers.in_groups(texts)] == [2, 1, 1, 2]
    assert pa.concat_arrays(list(chunkers.in_groups(texts))).equals(texts)
    assert [g.to_pylist() for g in chunkers.in_groups(texts.slice(4))] == [["", "z"]]
    assert list(chunkers.in_groups(texts.slice(0, 0))) == []


def test_blocks_of_many_pages_come_in_parts():
    pages = pa.array(["<p>a<p>b" * 20_000] * 40)
    parts = list(html_blocks._blocks_of.func(iter([pages])))
    assert len(parts) == 7 and sum(map(len, parts)) == 40 and len(parts[0][0]) == 40_000


def test_probes_are_sent_in_parts():
    rng = np.random.default_rng(5)
    centroids = vector_index.unit(rng.normal(size=(500, 64)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), vector_index._lists(rng.normal(size=(2000, 64)).astype(np.float32)), pa.array(np.zeros(2000))], names=["query_id", "vector", "least"])
    run = vector_index._probes(centroids, np.full(500, 2.0), np.ones(500, bool), None)
    parts = [b.num_rows for b in run(iter([batch]))]
    assert sum(parts) == 2000 * 500 and max(parts) <= vector_index.SENT
    assert peak(run(iter([batch]))) < 60 << 20
