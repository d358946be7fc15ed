"""Results that don't depend on a text's length or on the size of the benchmark."""

import numpy as np

from tessera.llm import decontaminate, toxicity


def test_line_is_calibrated_on_all_windows(spark, monkeypatch):
    """The line sees the same highest logits as scoring does, of long texts too."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 1500 if k % 2 else 60)) + (" vile" if k % 3 == 0 else "")) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    seen = {}
    whole = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda p, highest, label, share: seen.update(p=p, highest=highest) or whole(p, highest, label, share))
    toxicity.train(docs, labels)
    want = toxicity.highest_logits(toxicity.Model(seen["p"]), iter([t for _, t in rows]))
    assert len(seen["highest"]) > 5
    assert all(np.abs(want - h).min() < 1e-4 for h in seen["highest"])


def test_every_row_is_judged_by_its_own_text(spark):
    rng = np.random.default_rng(10)
    items = [(k, " ".join(f"i{k}x{x}" for x in range(20))) for k in range(6)]
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 500, 40)) for _ in range(4)]
    rows = [(None, items[0][1]), (None, clean[0]), (1, clean[1]), (1, items[5][1] + " tail"), (2, clean[2]), (2, clean[3]), (3, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, [rows[k] for k in (1, 2, 4, 5, 6)]))
    for limit in (decontaminate.BLOCK_CHARS, 150):
        assert sorted(str(tuple(r)) for r in decontaminate.drop_contaminated(docs, bench, limit=limit).collect()) == want
