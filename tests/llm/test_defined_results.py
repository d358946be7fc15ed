"""Defined results on odd rows: nulls, empty and blank texts, repeated rows and ids, large ids, empty tables and clashing columns."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, graph, licenses, mixing, near_copies, passages, quality, sharding, simhash, tokens, toxicity, urls

BIG = (1 << 53) + 1


def text_of(rng, n, vocabulary=10**6):
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    long = text_of(rng, 3000)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, long), (5, long), (None, long + " tail"), (BIG, "é ü x ß\x00y"), (7, text_of(rng, 60, 5) + " # $"), (None, "a b c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns that operators use for themselves.
    return spark.createDataFrame([(*r, "s", 1, 2, 0.5) for r in rows], "doc_id long, text string, source string, _row long, size int, score double")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, "one"), (9, "x y z"), (None, None), (8, "")], "item_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ids(found):
    return sorted(found, key=lambda x: (x is None, x))


def test_mix(docs, rows):
    got = mixing.mix_sources(docs.select("doc_id", "text", "source")).collect()
    assert ids(r.doc_id for r in got) == ids(r[0] for r in rows)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t in rows)
    total = sum(len(words(t)) for _, t in rows)
    assert {(r.source_size, r.target) for r in got} == {(total, 1.5 * total)}
    assert all(r.taken in (r["size"], 2 * r["size"]) for r in got)


def test_sample_is_what_the_mix_takes(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(k, text_of(rng, int(rng.integers(0, 40))), [None, "a", "b"][k % 3]) for k in range(200)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(table).collect()}
    drawn = {}
    for r in mixing.sample_mix(table).collect():
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + len(words(r.text))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in drawn.items() if v}


def test_decontamination(docs, rows, benchmark):
    got = decontaminate.contamination(docs.select("doc_id", "text"), benchmark).collect()
    assert ids(r.doc_id for r in got) == ids(r[0] for r in rows)
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got if r.doc_id in (1, 2, 3, 4)} == {(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 1, 1, 1, True)}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id <> 4").collect()))


def test_licences(docs, rows):
    got = licenses.scan_licenses(docs).collect()
    assert ids(r.doc_id for r in got) == ids(r[0] for r in rows)
    assert all((r.licenses, r.primary_license, r.permitted) == ("", None, None) for r in got)


def test_the_longest_rule_takes_a_place(spark):
    rules = (("short", (1,), True), ("long", (1, 2), False), ("end", (2,), True))
    table = {"one": 1, "two": 2}
    texts = ["one. two.", "one. two. one.", "two. one.", "one. three. two."]
    got = {r.doc_id: (r.licenses, r.permitted) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table, rules, {}).collect()}
    assert got == {0: ("long", False), 1: ("short,long", False), 2: ("short,end", True), 3: ("short,end", True)}


def test_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in (1, 3, 4, 5, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert ids(r.doc_id for r in got) == ids(r[0] for r in rows)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    kept = toxicity.drop_toxic(docs, labels, threshold=2.0)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_shards(docs, rows):
    got = sharding.shard_documents(docs).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_one_row_many_times_fills_all_shards(spark):
    table = spark.createDataFrame([(1, "the same text of every row", "https://www.example.com/a")] * 800 + [(k, f"text {k}", f"https://www.example.com/{k % 7}") for k in range(200)], "doc_id long, text string, source string")
    sizes = [r.n for r in sharding.shard_documents(table).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * min(sizes)


def test_shared_prefixes_dont_hide_a_dimension(spark):
    table = spark.createDataFrame([(k, f"https://www.example.com/{'ab'[k % 2]}") for k in range(10)], "doc_id long, source string")
    place = sharding.coordinates(table, ["source"])[0]
    assert table.select(place.alias("x")).distinct().count() == 2


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert ids(r.doc_id for r in got) == ids(r[0] for r in rows)
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {("0" * 16, 1)}
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]


def test_near_copies_go_by_row(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "other words stand here in a row"
    table = spark.createDataFrame([(3, a), (5, b), (5, a), (7, b), (7, c), (None, a), (None, None), (None, "")], "doc_id long, text string")
    kept = sorted(map(str, (tuple(r) for r in near_copies.drop_near_copies(table).collect())))
    assert kept in (sorted(map(str, [(3, a), (5, b), (7, c), x])) for x in ((None, None), (None, "")))
    assert near_copies.drop_near_copies(table.limit(0)).count() == 0


def test_quality(docs, rows):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for k, t in rows:
        if k in (1, 2, 3, 4, 7, BIG):
            ws, r = words(t), got[k]
            triples = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
            often = {p for i, x in enumerate(triples) if triples.count(x) > 1 for p in range(i, i + 3)}
            lines = [x for x in (t or "").split("\n") if words(x)]
            base = len(ws) < 50 or 100 * len(often) > 50 * len(ws)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(often), base)
            assert not (r.base_failed and r.kept)


def test_passages(docs, rows):
    got = sorted(((r.doc_id or 0, r.n_words, r.n_dup_words, r.n_spans, r.longest, r.n_later_words, r.first_doc_ids) for r in passages.passage_duplicates(docs).collect()))
    want = [(k or 0, len(words(t)), *((3000, 1, 3000, 0, "") if len(words(t)) > 2000 else (0, 0, 0, 0, ""))) for k, t in rows]
    assert got == sorted(want)


def test_later_passages_name_their_first_holder(spark):
    rng = np.random.default_rng(5)
    one, two = text_of(rng, 60), text_of(rng, 70)
    table = spark.createDataFrame([(1, one), (2, f"{text_of(rng, 9)} {one} x {two}"), (3, two)], "doc_id long, text string")
    got = {r.doc_id: (r.n_dup_words, r.n_spans, r.longest, r.n_later_words, r.first_doc_ids) for r in passages.passage_duplicates(table).collect()}
    assert got == {1: (60, 1, 60, 0, ""), 2: (130, 2, 70, 60, "1"), 3: (70, 1, 70, 70, "2")}


def test_large_ids_beside_nulls_stay_whole(spark, docs, benchmark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for found in (decontaminate.contamination(docs, benchmark), toxicity.toxicity(docs, labels), simhash.near_duplicates(docs), quality.quality_rules(docs), tokens.token_table(docs, path), passages.passage_duplicates(docs)):
        assert BIG in [r.doc_id for r in found.select("doc_id").collect()]


@pytest.mark.parametrize(
    ("url", "html", "target"),
    [
        ("http://a.b/x/y?q", '<link rel="canonical" href="z">', "http://a.b/x/z"),
        ("http://a.b/x/y", "<link rel=canonical href='../z?k=1&amp;m=2'>", "http://a.b/z?k=1&m=2"),
        ("http://a.b/x/y?q", '<link href="?p=1" rel="alternate canonical">', "http://a.b/x/y?p=1"),
        ("http://a.b", '<link rel="canonical" href="./z">', "http://a.b/z"),
        ("https://a.b/x", '<link rel="canonical" href="//c.d/e">', "https://c.d/e"),
        ("http://a.b/x", '<link rel="canonical" href="/out?u=http://example.com/en/1">', "http://a.b/out?u=http://example.com/en/1"),
        ("http://a.b/x", """<meta http-equiv="refresh" content="0; url='http://c.d/e'">""", "http://c.d/e"),
        ("http://a.b/x", "<META content=5;URL=/e HTTP-EQUIV=refresh>", "http://a.b/e"),
        ("http://a.b/x", '<link rel="canonical" data-href="http://c.d/e">', None),
        ("http://a.b/x", '<link rel="noncanonical" href="http://c.d/e">', None),
        ("http://a.b/x", '<link rel="canonical" href="javascript:void(0)">', None),
        ("http://a.b/x", '<meta http-equiv="refresh" content="30">', None),
    ],
)
def test_link_targets(spark, url, html, target):
    found = [r.target for r in urls.page_links(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).collect()]
    assert found == ([target] if target else [])


def test_all_links_of_a_page_count(spark):
    html = '<link rel="canonical" href="http://c.d/1"><link rel="canonical" href="http://c.d/2"><meta http-equiv="refresh" content="0;url=http://c.d/3">'
    assert urls.page_links(spark.createDataFrame([(1, "http://a.b/", html)], "page_id long, url string, html string")).count() == 3


def test_a_long_chain_of_aliases_takes_the_block(spark):
    n = 3000
    chain = [(k, f"http://h{k}.xyz/", f'<link rel="canonical" href="http://h{k + 1}.xyz/">') for k in range(n)] + [(n, f"http://h{n}.xyz/", '<link rel="canonical" href="http://example.com/en/1">'), (n + 1, "http://apart.xyz/", None)]
    got = urls.judge_urls(spark.createDataFrame(chain, "page_id long, url string, html string")).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": n + 1, "allow": 1}


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))] + [(None, 1), (2, None), (3, 3)]
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)


def test_pipeline_keeps_what_its_stages_keep(spark, tmp_path):
    rng = np.random.default_rng(7)
    item = text_of(rng, 30)
    texts = [text_of(rng, 80, 500) for _ in range(60)]
    table = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    table += [(100, texts[0], "en", "s0", 1), (101, f"{texts[1]} tail", "en", "s1", 1), (102, item, "en", "s2", 1), (None, text_of(rng, 50, 500), None, None, None), (None, None, None, None, None), (103, "", "en", "s0", 0)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Labels of one kind: nobody is toxic, and the stage keeps everything.
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.doc_id, r["size"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    left = [r for r in table if r[0] not in (100, 101, 102)]
    blank = [r for r in left if not words(r[1])]
    assert len(blank) == 2
    left.remove((None, None, None, None, None))
    mixed = mixing.mix_sources(spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    taken = sorted((r.doc_id or -1) for r in mixed if r["size"] for _ in range(r.taken // r["size"]))
    assert sorted((k or -1) for k, n in got if n > 1) == taken


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
