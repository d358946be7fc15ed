"""Embedding with a cache: each text once, no call for what is known, nothing kept of a run that fails."""

import pytest

from tessera.operators.embedding import checked_vectors, embed_texts, read_cache
from tessera.plans.embedding import DigestProvider


class Counted(DigestProvider):
    """Counts the texts that it is given in an accumulator."""

    batch, tokens = 3, 2

    def __init__(self, seen, spoil=None):
        self.seen, self.spoil = seen, spoil

    def embed(self, texts):
        assert len(texts) <= self.batch
        self.seen.add(len(texts))
        return self.spoil(super().embed(texts)) if self.spoil else super().embed(texts)


ROWS = [(1, "a"), (2, "a"), (3, "12345678 and more"), (4, "12345678 or less"), (5, None), (6, " \n"), (7, "b"), (7, "c"), (None, "d")]


def test_known_texts_are_not_embedded_again(spark, tmp_path):
    path, texts = f"file://{tmp_path}/cache", spark.createDataFrame(ROWS, "id long, text string")
    seen = spark.sparkContext.accumulator(0)
    first = sorted((tuple(r) for r in embed_texts(texts, path, Counted(seen), calls=2).collect()), key=repr)
    assert seen.value == 5 and len(first) == len(ROWS)
    by_id = {r[0]: r for r in first}
    assert by_id[1][1] == by_id[2][1] and by_id[3] == (3, by_id[4][1], True) and by_id[5] == (5, None, False) and by_id[6] == (6, None, False)
    again = spark.sparkContext.accumulator(0)
    assert sorted((tuple(r) for r in embed_texts(texts, path, Counted(again)).collect()), key=repr) == first and again.value == 0
    more = spark.sparkContext.accumulator(0)
    embed_texts(spark.createDataFrame([*ROWS, (8, "new")], "id long, text string"), path, Counted(more))
    assert more.value == 1 and read_cache(spark, path, "another").count() == 0
    assert embed_texts(texts.limit(0), path, Counted(more)).count() == 0


@pytest.mark.parametrize("spoil", [lambda v: v[:-1], lambda v: [x[:2] for x in v], lambda v: [[float("nan")] * 4 for _ in v]])
def test_wrong_answers_are_errors(spoil):
    class Seen:
        def add(self, n):
            pass

    with pytest.raises(ValueError):
        checked_vectors(Counted(Seen(), spoil), ["a", "b"])


def test_a_failed_run_keeps_nothing(spark, tmp_path):
    path, texts = f"file://{tmp_path}/cache", spark.createDataFrame(ROWS, "id long, text string")
    seen = spark.sparkContext.accumulator(0)
    with pytest.raises(Exception, match="isn't finite"):
        embed_texts(texts, path, Counted(seen, lambda v: [[float("inf")] * 4 if x[0] == v[-1][0] else x for x in v]), calls=1)
    assert read_cache(spark, path, Counted.model_key).count() == 0
