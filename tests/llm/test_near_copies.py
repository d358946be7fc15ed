"""The near-duplicate stage against brute force."""

import itertools

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies, simhash


def kept(texts):
    """Row numbers that stay, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return {k for k, v in enumerate(label) if k == v}


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", " \n", "one two", "One  two", "three"]
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 1000, 120)]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 8):
            words = list(words)
            for at in rng.integers(0, 120, changes):
                words[at] = "changed"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept(texts)


def test_divided_buckets_keep_pairs_at_larger_distances():
    for distance in (2, 3, 6):
        masks = simhash._refine(0, distance)
        rng = np.random.default_rng(distance)
        for _ in range(50):
            differ = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
            assert any(not m & differ for m in masks)


def apart(n):
    """Copies of one text that isn't there, four words changed in each: nearly all pairs are just below the similarity."""
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(300)]
    out = []
    for copy in range(n):
        words = list(base)
        for at in rng.choice(300, 4, replace=False):
            words[at] = f"x{copy}-{at}"
        out.append(" ".join(words))
    return out


def test_group_of_texts_just_below_the_similarity_makes_no_square_of_rows(spark, monkeypatch):
    passage = " ".join(f"w{k}" for k in range(300))
    # 300 shared words and 44 of its own put every pair at 0.77; the last text is near one other.
    texts = [" ".join([passage, *(f"x{copy}-{k}" for k in range(44))]) for copy in range(120)]
    texts.append(texts[7] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, write = [], near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df, name: (made.append((write(df, name), name)), made[-1][0])[1])
    monkeypatch.setattr(near_copies, "release", lambda *tables: None)
    found = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    assert found == kept(texts)
    rows = {name: df.count() for df, name in made}
    # Of 7,260 pairs nearly all share a bucket and look alike; no table holds more rows than the buckets have members.
    assert max(rows.values()) <= rows["members"] <= len(texts) * near_copies.BANDS


def test_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    texts = apart(60)
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == kept(texts)
