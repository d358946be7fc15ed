"""Operators against brute force, and their defined results on odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licenses, mixing, passages, quality, sharding, simhash, tokens, toxicity, urls

ODD = "doc_id long, text string, source string, lang string, n_chars long, score double, row long"


def rng_text(rng, n, vocabulary=200):
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    long = rng_text(rng, 3000, 10**6)
    rows = [(1, None, None, None, None), (2, "", "a", "en", 0), (3, " \n\t", "a", "en", 3), (4, "one", "a", None, 3), (5, long, "b", "en", 9), (5, long, "b", "en", 9), (None, long + " tail", None, "en", 9), (6, "é ü x ß\x00y", "b", "fr", 5), (7, rng_text(rng, 60, 5), "b", "en", 9)]
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, k % 2) for k in range(1, 8)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, "one"), (9, "x y z"), (None, None), (8, ""), (7, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")


def test_odd_rows_and_empty_tables(spark, odd, labels, benchmark):
    pages = spark.createDataFrame([(1, None, None), (None, "nope", ""), (2, "http://A.com/en/x?q#f", "<p>"), (2, "http://A.com/en/x?q#f", "<p>")], "page_id long, url string, html string")
    runs = {
        "mix": lambda d: mixing.mix_sources(d), "decontaminate": lambda d: decontaminate.contamination(d, benchmark), "licenses": licenses.scan_licenses, "toxicity": lambda d: toxicity.toxicity(d, labels),
        "shards": sharding.shard_documents, "simhash": simhash.near_duplicates, "quality": quality.quality_rules, "passages": passages.passage_duplicates,
    }
    for name, run in runs.items():
        assert run(odd).count() == odd.count(), name
        assert run(odd.limit(0)).count() == 0, name
    assert urls.judge_urls(pages).count() == 4
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    items = [(k, rng_text(rng, n, 30)) for k, n in enumerate([1, 2, 5, 13, 14, 40, 0])] + [(100, None)]
    docs = [(k, rng_text(rng, 30, 30).upper() + "! " + (items[k % 6][1] if k % 2 else "")) for k in range(40)]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")

    def brute(text):
        ws, hit, found = re.findall(decontaminate.WORD, text.lower()), set(), set()
        for item, body in items:
            b = re.findall(decontaminate.WORD, body or "")
            n = min(13, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for at in range(len(ws) - n + 1):
                    if ws[at : at + n] == b[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)

    want = {k: brute(t) for k, t in docs}
    for limit in (decontaminate.BLOCK_CHARS, 60):
        rows = decontaminate.contamination(table, bench, limit=limit).collect()
        assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
    assert set(r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()) == {k for k, v in want.items() if not v[4]}


def test_repetition_matches_brute_force():
    rng = np.random.default_rng(2)
    for n, v in ((0, 2), (1, 2), (40, 2), (200, 3), (300, 40), (60, 1)):
        texts = [[b"%d" % x for x in rng.integers(0, v, n)] for _ in range(3)]
        for words, got in zip(texts, quality.repetition(texts, 3, 4), strict=True):

            def inside(width, words=words):
                seen = {}
                for k in range(len(words) - width + 1):
                    seen.setdefault(tuple(words[k : k + width]), []).append(k)
                return {p for places in seen.values() if len(places) > 1 for k in places for p in range(k, k + width)}

            longest = max((w for w in range(1, n) if inside(w)), default=0)
            assert got == (len(inside(3)), len(inside(4)), longest)


def test_passages_match_brute_force(spark):
    rng = np.random.default_rng(4)
    shared = [rng_text(rng, n, 10**6) for n in (50, 51, 49, 120)]
    texts = [rng_text(rng, 200, 10**6) for _ in range(30)]
    for k in range(20):
        texts[k] = f"{texts[k]} {shared[k % 4]} {rng_text(rng, int(rng.integers(0, 60)), 10**6)}"
    texts += [texts[25], shared[0], "short", "", " ".join(["same"] * 130)]
    rows, spans = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {k: set() for k in range(len(texts))}
    for r in spans.join(rows, "row").collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    where = {}
    split = [t.split() for t in texts]
    for d, ws in enumerate(split):
        for k in range(len(ws) - 49):
            where.setdefault(tuple(ws[k : k + 50]), []).append((d, k))
    want = {k: set() for k in range(len(texts))}
    for places in where.values():
        if len(places) > 1:
            for d, k in places:
                want[d] |= set(range(k, k + 50))
    assert got == want


def test_simhash_groups_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [rng_text(rng, 80, 1000).split() for _ in range(15)]
    texts = ["", " "] + [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            c = list(b)
            c[int(rng.integers(0, 80))] = "changed"
            texts.append(" ".join(c))
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    parent = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    parent[i] = min(parent[i], parent[j])
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{p:016x}", parent[k]) for k, p in enumerate(prints)}


def test_blocks_come_back_and_damage_is_seen(spark):
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, m, n).astype(np.uint32) for m, n in ((2, 500), (50257, 300), (1 << 32, 50), (1, 0), (5, 1))]
    coded = tokens.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, tokens.decode_blocks(coded), strict=True))
    assert all(np.array_equal(tokens.decode_blocks([c])[0], b) for c, b in zip(coded, blocks, strict=True))
    damaged = bytearray(coded[0])
    damaged[tokens.HEAD.size + 4] ^= 1
    for body in (bytes(damaged), coded[0][:-2], b"TTK2"):
        with pytest.raises(ValueError):
            tokens.decode_blocks([body])


def test_words_learnt_one_by_one_give_the_same_ids():
    import public_tokenizers

    known = tokens._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(12)
    signs = list("ab é\n\t.,'12") + [" ", " ", "\x00", "\x1c", "\u00a0", "\u3000", "<|endoftext|>"]
    texts = ["", " a", "a ", "a  b", "a\n\nb", "a\n b", "a \nb", "don't we'll 12 3a,b\nc'd"] + ["".join(signs[k] for k in rng.integers(0, len(signs), n)) for n in rng.integers(0, 40, 400)]
    want = [np.array(e.ids, "<u4").tobytes() for e in known.whole.encode_batch(texts, add_special_tokens=False)]
    assert known.encode(texts) == want


def test_token_table_matches_tokenizer(spark, odd):
    import zlib

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted((tuple(r) for r in tokens.token_table(odd, path).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*tokens._tokenizer(path).whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.token_table(odd.limit(0), path).count() == 0


def test_aliases_take_blocks_and_allows_precede(spark):
    rows = [
        (1, "http://blog.example.xyz/a", '<link rel="canonical" href="http://example.com/en/1">'), (2, "http://example.com/en/7", ""), (3, "http://other.xyz/b", '<meta http-equiv="refresh" content="0; url=http://blog.example.xyz/a">'),
        (4, "http://mixed.xyz/", '<link href="https://example.com/en/7x" rel=canonical>'), (5, "http://alone.xyz/", "<link rel=canonical href=/c>"),
    ]
    got = {r.page_id: (r.verdict, r.rule, r.via_alias) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("block", None, True), 2: ("allow", "example.com/en/7", False), 3: ("block", None, True), 4: ("allow", None, False), 5: ("allow", None, False)}


def test_license_rules_need_their_order(spark):
    rows = [(1, "Intro text.\nReleased under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (4, "The MIT license is released")]
    got = {r.doc_id: (r.licenses, r.primary_license, r.permitted) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT", True), 2: ("GPL-3.0", "GPL-3.0", False), 3: ("Apache-2.0,CC-BY-NC-4.0", "Apache-2.0", False), 4: ("", None, None)}


def test_shards_are_near_equal_and_slots_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for s in range(16):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r["size"] for r in mine)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(7)
    bad = ["vile", "nasty", "rotten"]
    rows, marks = [], []
    for k in range(900):
        words = rng_text(rng, 60, 400).split()
        if k % 3 == 0:
            for _ in range(3):
                words[int(rng.integers(0, 60))] = bad[int(rng.integers(0, 3))]
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(k % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).where("held_out").collect()
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_gradients_are_those_of_the_loss():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    rng = np.random.default_rng(0)
    ids, y = rng.integers(0, 4, (5, toxicity.WINDOW)), np.array([0.0, 1, 1, 0, 1])
    mask = (np.arange(toxicity.WINDOW) < rng.integers(1, toxicity.WINDOW, 5)[:, None]).astype(float)
    words = [b"the", b"", b"word", b"other"]
    _, grads = toxicity.gradients(p, words, ids, mask, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        near = []
        for d in (1e-3, -1e-3):
            q = p | {k: p[k].copy()}
            q[k][at] += d
            near.append(toxicity.gradients(q, words, ids, mask, y)[0])
        assert abs((near[0] - near[1]) / 2e-3 - g[at]) < 1e-4, k
