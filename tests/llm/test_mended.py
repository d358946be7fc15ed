"""Cases that once went wrong: clashing names, wide whole numbers, blocks of no size, runs over many ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_copies, passages, sharding


def test_a_column_named_row_keeps_its_values(spark):
    docs = spark.createDataFrame([(1, "one two three", 77, "p"), (2, "clean words here", 88, "q"), (3, "clean words here", 99, "r")], "doc_id long, text string, _row long, doc string")
    benchmark = spark.createDataFrame([(1, "one two three"), (2, "something else"), (3, "x y z w")], "item_id long, text string")
    for limit in (8, 10**6):
        kept = decontaminate.drop_contaminated(docs, benchmark, limit=limit)
        assert kept.columns == docs.columns
        assert sorted(tuple(r) for r in kept.collect()) == [(2, "clean words here", 88, "q"), (3, "clean words here", 99, "r")]
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "one two three", 77, "p"), (2, "clean words here", 88, "q")]


def test_a_block_holds_something(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for drop in (decontaminate.drop_contaminated, decontaminate.contamination):
        with pytest.raises(ValueError):
            drop(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"), limit=0)


def test_shards_of_very_wide_and_negative_numbers(spark):
    rng = np.random.default_rng(3)
    ids = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 300)] + [-(1 << 63), (1 << 63) - 1, -1, None]
    docs = spark.createDataFrame([(i, "x" * 20) for i in ids], "doc_id long, text string")
    found = sharding.shard_documents(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i in ids)
    loads = [sum(r.size for r in found if r.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 2 * 21
    (low, null), = spark.createDataFrame([(-5,), (None,), (7,)], "n long").select(*[sharding.coordinates(spark.createDataFrame([(-5,), (None,), (7,)], "n long"), ["n"])[0].alias("c")]).agg(F.min("c"), F.count_if(F.col("c") == -1)).collect()
    assert (low, null) == (-1, 1)


def test_runs_over_many_ranges_and_groups(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP_ROWS", 3)
    rng = np.random.default_rng(1)
    keys = [5] * 40 + [9] * 25 + [int(k) for k in rng.integers(10, 60, 60)] + [100, 101]
    rows = [(k, n, n % 7, None if k == 9 else (n * 37) % 100) for n, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key long, row long, place int, holder long")
    for per_range in (4, 30, 1000):
        found = {(r.row, r.place): r.first for r in passages.neighbours(df, per_range).collect()}
        held = {}
        for k, _, _, h in rows:
            held.setdefault(k, []).append(h)
        wanted = {(n, p): min((h for h in held[k] if h is not None), default=None) for k, n, p, _ in rows if len(held[k]) > 1}
        assert found == wanted


def test_a_text_may_end_with_one_space():
    import public_tokenizers

    from tessera.llm import alignment

    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    whole = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    whole.cut = False
    texts = ["word ", "two words ", "line\n ", "a\0 ", " ", "  ", "é  ", "x \t "]
    got, want = ([(*r[:5], r[5].tolist(), r[6].tolist()) for r in p.documents(texts)] for p in (pair, whole))
    assert got == want
    assert all(r[0] > 0 for r in got[:3])


@pytest.mark.parametrize(
    ("html", "target"),
    [
        ('<link rel="canonical" href="../z">', "http://a.b/z"),
        ('<link rel=canonical href="../../../../../../z/./y?q=../1">', "http://a.b/z/y?q=../1"),
        ('<link rel=canonical href="/x/../en/..">', "http://a.b/"),
        ('<link rel=canonical href="http://c.d/x/../en/1">', "http://c.d/en/1"),
        ('<base href="http://c.d/e/f"><link rel=canonical href="g">', "http://c.d/e/g"),
        ('<base target=_top><base href="/e/"><meta http-equiv=refresh content="0 url=g">', "http://a.b/e/g"),
        ('<!-- <link rel=canonical href="/en/1"> --><script>"<link rel=canonical href=/en/2>"</script>', None),
        ('<link title="a > b" rel=canonical href="/en/1">', "http://a.b/en/1"),
        (f'<meta name={"x" * 50_000}><link rel=canonical href="/en/1">', "http://a.b/en/1"),
    ],
)
def test_targets_of_links(spark, html, target):
    from tessera.llm import urls

    found = [r.target for r in urls.page_links(spark.createDataFrame([(1, "http://a.b/k", html)], "page_id long, url string, html string")).collect()]
    assert found == ([target] if target else [])


def test_a_rule_goes_before_an_alias(spark):
    from tessera.llm import urls

    rows = [(1, "http://example.com/en/7", '<link rel=canonical href="http://x.org/es/1">'), (2, "http://x.y/a/b", '<link rel=canonical href="../../../es/2"><base href="http://x.org/">'), (3, "http://z.y/", '<!--<link rel=canonical href="http://x.org/es/1">-->')]
    got = {r.page_id: (r.verdict, r.rule) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("allow", "example.com/en/7"), 2: ("block", None), 3: ("allow", None)}
