"""Cross-tokenizer alignment, clustering and exact search against brute force, and their defined results on odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, clustering, topk

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts: list) -> list[tuple]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    byte = alignment.byte_level()
    docs = []
    for text in texts:
        groups, links = [], []
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            a_bytes = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b_tok.id_to_piece(i)) else p.replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                spans = [np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes)]
                links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if spans[0][i] < spans[1][j + 1] and spans[1][j] < spans[0][i + 1]]
                cuts = sorted(set(spans[0]) & set(spans[1]))
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    inside = [[str(t) for t, s in zip(ids, at, strict=False) if lo <= s < hi] for ids, at in ((a, spans[0]), (b, spans[1]))]
                    groups.append("|".join(map(",".join, inside)))
                docs.append((len(a), len(b), groups, links))
                continue
        docs.append((0, 0, [], []))
    count = Counter(p for d in docs for p in set(d[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [(n_a, n_b, len(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, ls in docs]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    parts = ["the", " ", "  ", "\n", "\n ", " \n", "\t", "naïve", "café", "你好", "　", " ", " ", "\x1c", "\x85", "don't", "it's", "1234567", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\U0001f600", "\x00", "x" * 90, "Supercalifragilistic", "!!", "_", "ﬁ"]
    made = ["".join(rng.choice(parts, int(n))) for n in rng.integers(1, 40, 150)]
    words = [" ".join(f"w{k}rd{k % 7}" for k in rng.integers(0, 50, 60)) for _ in range(20)]
    return [*made, *words, words[0], words[0], None, "", " ", "\n", "a▁b c", "▁ x", "a", " a", "你" * 3000]


def test_alignment_matches_brute_force(spark, texts):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, keys long")
    found = {r.doc_id: tuple(r)[1:] for r in alignment.align_tokenizers(docs, A, B).collect()}
    wanted = brute_alignment(texts)
    assert len(found) == len(texts)
    for k, w in enumerate(wanted):
        assert found[k] == w, repr(texts[k])
    assert sum(w[0] > 0 for w in wanted) > 150


def test_alignment_of_null_and_repeated_ids_and_of_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id int, text string")
    found = alignment.align_tokenizers(docs, A, B)
    assert found.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in found.collect()) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_counts_are_the_same_over_many_shards(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    pair = alignment._pair(A, B)
    aligned = alignment.aligned_documents(docs, A, B)
    few, many = (alignment.count_pairs(aligned, len(pair.a_bytes), pair.n_b, range_rows=n) for n in (10**6, 20))
    assert len(many.shards) > 10
    keys = np.unique(np.concatenate([alignment._keys(r["keys"]) for r in aligned.select("keys").collect()]))
    assert len(keys) > 200
    assert np.array_equal(few.of(keys), many.of(keys))
    assert np.array_equal(few.most, many.most)
    with pytest.raises(ValueError):
        many.of(np.array([keys[0] + 1]) if keys[0] + 1 != keys[1] else keys[-1:] + 1)


def test_a_long_text_and_a_tokenizer_without_cuts(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{k}" for k in rng.integers(0, 3000, 300_000))
    pair = alignment._pair(A, B)
    n_a, n_b, n_groups, n_links, _, keys, many = next(iter(pair.documents([long])))
    assert many.sum() == n_links and len(keys) > 1000
    whole = alignment.Pair(A, B)
    whole.cut = False
    part = long[:200_000]
    cut, uncut = next(iter(pair.documents([part]))), next(iter(whole.documents([part])))
    assert cut[:5] == uncut[:5]
    assert all(np.array_equal(x, y) for x, y in zip(cut[5:], uncut[5:], strict=True))


def whole(v, scale):
    return [math.floor(scale * float(x)) for x in v]


def brute_clusters(rows, clusters, rounds, width):
    kept = [(i, np.array(whole(v, 256), object)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", list(r[1])))
    centroids = [c for _, c in first[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [int(((v - c) ** 2).sum()) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (n, _) in zip(kept, of, strict=True) if n == j]
            if own:
                centroids[j] = np.array([int(x) // len(own) for x in sum(own)], object)
    of = assign()
    inertia = Counter()
    for n, d in of:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (n, d) in zip(kept, of, strict=True)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")


def odd_vectors(rng, width):
    base = rng.normal(0, 0.3, (6, width))
    rows = [(k, [float(np.float32(x)) for x in base[k % 6] + rng.normal(0, 0.05, width)]) for k in range(150)]
    same = rows[3][1]
    return rows + [(k, same) for k in range(200, 240)] + [(300, None), (301, []), (302, [None] + [0.5] * (width - 1)), (303, [math.nan] * width), (304, [math.inf] + [0.0] * (width - 1)), (305, [0.0] * width), (306, [0.1] * (width + 1)), (307, [0.2] * (width - 1)), (None, same), (3, same), (3, same), (3, [-1.5] * width)]


@pytest.mark.parametrize("width", [64, 5])
def test_clusters_match_brute_force(spark, width):
    rows = odd_vectors(np.random.default_rng(4), width)
    found = clustering.cluster_vectors(vectors(spark, rows), clusters=12, rounds=4, width=width)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_clusters(rows, 12, 4, width)


def test_clusters_of_few_and_of_no_rows(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-1.0] * 64)]
    found = {r.vec_id: (r.cluster, r.distance, r.inertia) for r in clustering.cluster_vectors(vectors(spark, rows)).collect()}
    assert found[1][:1] == found[2][:1] != found[3][:1] and all(v[1:] == (0, 0) for v in found.values())
    assert clustering.cluster_vectors(vectors(spark, rows).limit(0)).count() == 0
    assert clustering.cluster_vectors(vectors(spark, [(1, None), (2, [1.0])])).count() == 0
    with pytest.raises(Exception, match="don't fit"):
        clustering.cluster_vectors(vectors(spark, [(1, [1e30] * 64)])).count()


def test_screening_is_exact_and_spares_distances():
    rng = np.random.default_rng(8)
    centroids = rng.integers(-300, 300, (40, 64))
    v = centroids[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 64))
    v[:200] = centroids[7]
    number, distance, exact = clustering.nearest(v, clustering.compressed(v), centroids)
    every = ((v[:, None, :] - centroids) ** 2).sum(axis=2)
    assert np.array_equal(number, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))
    assert exact < len(v) * 4
    big = rng.integers(-(1 << 27), 1 << 27, (500, 64))
    number, distance, _ = clustering.nearest(big, clustering.compressed(big), big[:40])
    every = ((big[:, None, :] - big[:40]) ** 2).sum(axis=2)
    assert np.array_equal(number, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))


def brute_topk(rows, asks, k, scale=1024):
    kept = [(i, whole(v, scale)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (qid, q) in enumerate(kept):
        if qid is not None and asks(qid):
            scored = sorted((-sum(x * y for x, y in zip(q, d, strict=False)), i is None, i or 0) for b, (i, d) in enumerate(kept) if b != a)
            out += [(qid, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 9])
def test_topk_matches_brute_force(spark, partitions):
    rows = odd_vectors(np.random.default_rng(6), 16)
    found = topk.exact_topk(vectors(spark, rows).repartition(partitions), F.col("vec_id") % 3 == 0, k=10)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_topk(rows, lambda i: i % 3 == 0, 10)


def test_topk_of_large_components_few_and_no_rows(spark):
    rng = np.random.default_rng(2)
    big = [(k, [float(np.float32(x)) for x in rng.normal(0, 3e4, 8)]) for k in range(40)]
    found = topk.exact_topk(vectors(spark, big), F.col("vec_id") % 5 == 0, k=3)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_topk(big, lambda i: i % 5 == 0, 3)
    few = vectors(spark, [(100, [1.0]), (2, [3.0]), (3, [3.0])])
    assert [tuple(r) for r in topk.exact_topk(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(100, 1, 2, 3 << 20), (100, 2, 3, 3 << 20)]
    assert topk.exact_topk(few.limit(0), F.lit(True)).count() == 0
    assert topk.exact_topk(few.where("vec_id = 100"), F.lit(True)).count() == 0
    assert topk.exact_topk(few, F.lit(False)).count() == 0
    with pytest.raises(OverflowError):
        topk.exact_topk(vectors(spark, [(1, [1e12]), (2, [1e12])]), F.lit(True))


def test_stretches_of_many_texts_are_learnt_once(monkeypatch):
    texts = [" ".join(f"w{k}x" for k in range(at, at + 16_000)) for at in range(0, 160_000, 16_000)]
    pair = alignment.Pair(A, B)
    first = [(*x[:5], x[5].tobytes(), x[6].tobytes()) for x in pair.documents(texts)]
    monkeypatch.setattr(pair, "learn", lambda parts: pytest.fail("learnt again"))
    assert [(*x[:5], x[5].tobytes(), x[6].tobytes()) for x in pair.documents(texts)] == first
