"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_values, map_values, materialise

#: Words of a window, and from one window's start to the next; windows overlap by the difference.
WINDOW, STRIDE = 32, 16
#: Buckets of hashed words and of hashed character triples, and the sizes of inputs and states.
WORD_BUCKETS, CHAR_BUCKETS, INPUT, STATE = 1 << 15, 1 << 12, 16, 16
#: The network is fitted on at most so many documents of each label, and so many windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 24
EPOCHS, BATCH, RATE = 6, 256, 4e-3
#: A small sample is passed over more often, until the network has been updated so often.
LEAST_UPDATES = 300
#: Share of words whose own embedding a training step sees; rare words are learnt by heart otherwise.
SHOWN = 0.5
THRESHOLD = 0.3
#: Windows scored together, and words whose inputs are computed together.
GROUP, KEPT_WORDS = 1024, 20_000


#: Punctuation counts as space.
_SPACED = bytes.maketrans(b".,;:!?\"()*#%$&|<>", b" " * 17)


def split_words(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation; at least one word, empty for an empty text."""
    return (text.lower().encode("utf-8", "replace").translate(_SPACED).split() if text else None) or [b""]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all words' character triples one after the other, and where each word's begin."""
    bucket = np.fromiter((zlib.crc32(w) & WORD_BUCKETS - 1 for w in words), np.int64, len(words))
    body = np.frombuffer(b"\x00".join([b"", *words, b""]), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # A word of n bytes has n triples with the bounds around it, and the empty word one.
    counts = np.maximum(lengths, 1)
    begins = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    at = np.repeat(begins - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    body = np.r_[body, np.zeros(2, np.uint32)]
    triple = (body[at] << 16 | body[at + 1] << 8 | body[at + 2]) * np.uint32(2654435761)
    return bucket, (triple >> np.uint32(20)).astype(np.int64) & CHAR_BUCKETS - 1, np.r_[0, np.cumsum(counts)[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"words": draw(WORD_BUCKETS, INPUT, s=0.1), "chars": draw(CHAR_BUCKETS, INPUT, s=0.1), "wa": draw(2 * STATE, STATE, s=0.2), "ba": np.zeros(STATE, np.float32), "va": draw(STATE, s=0.3), "w": draw(2 * STATE, s=0.3), "b": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"x{d}": draw(INPUT, 3 * STATE, s=0.3), f"c{d}": np.zeros(3 * STATE, np.float32), f"u{d}": draw(STATE, 3 * STATE, s=0.25)}
    return p


def word_inputs(p: dict, words: list[bytes]) -> np.ndarray:
    bucket, triples, begins = hashed(words)
    sums = np.add.reduceat(p["chars"][triples], begins, axis=0)
    return p["words"][bucket] + sums / np.diff(np.r_[begins, len(triples)])[:, None].astype(np.float32)


def _steps(direction: str, n: int) -> range:
    return range(n) if direction == "f" else range(n - 1, -1, -1)


def _recur(p: dict, d: str, x: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States of one direction over projected inputs x (windows, places, 3 states)."""
    n, places, _ = x.shape
    s = STATE
    h = np.zeros((n, s), np.float32)
    out = np.empty((n, places, s), np.float32)
    for t in _steps(d, places):
        a = h @ p[f"u{d}"]
        gates = _sigmoid(x[:, t, : 2 * s] + a[:, : 2 * s])
        r, z = gates[:, :s], gates[:, s:]
        c = np.tanh(x[:, t, 2 * s :] + r * a[:, 2 * s :])
        m = mask[:, t, None]
        after = h + m * (1 - z) * (c - h)
        if tape is not None:
            tape.append((t, h, r, z, c, a[:, 2 * s :], m))
        h = after
        out[:, t] = h
    return out


def _pool(p: dict, g: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attention over the states: hidden scores, weights, pooled state and logit."""
    e = np.tanh(g @ p["wa"] + p["ba"])
    score = np.where(mask > 0, e @ p["va"], np.float32(-1e9))
    weight = np.exp(score - score.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = (weight[:, :, None] * g).sum(axis=1)
    return e, weight, pooled, pooled @ p["w"] + p["b"]


def logits(p: dict, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows of word numbers, with the words' projected inputs."""
    g = np.concatenate([_recur(p, d, projected[d][ids], mask) for d in "fb"], axis=2)
    return _pool(p, g, mask)[3]


def project(p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}


def windows_of(n: int) -> np.ndarray:
    """Starts of all overlapping windows over n words."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = starts[:, None] + np.arange(WINDOW)
    mask = (at < ends[:, None]).astype(np.float32)
    return flat[np.minimum(at, len(flat) - 1)], mask


def gradients(p: dict, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of windows and its gradient in every parameter; rng, if given, hides words of which the characters must then tell."""
    used, local = np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape)
    bucket, triples, begins = hashed([words[i] for i in used])
    counts = np.diff(np.r_[begins, len(triples)])
    shown = np.ones((len(used), 1), np.float32) if rng is None else (rng.random((len(used), 1)) < SHOWN).astype(np.float32) / np.float32(SHOWN)
    x = shown * p["words"][bucket] + np.add.reduceat(p["chars"][triples], begins, axis=0) / counts[:, None].astype(np.float32)
    xs = x[local]
    tapes: dict[str, list] = {"f": [], "b": []}
    g = np.concatenate([_recur(p, d, xs @ p[f"x{d}"] + p[f"c{d}"], mask, tapes[d]) for d in "fb"], axis=2)
    e, weight, pooled, logit = _pool(p, g, mask)
    prob = _sigmoid(logit)
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    dl = ((prob - y) / len(y)).astype(np.float32)
    out = {"w": pooled.T @ dl, "b": np.array([dl.sum()], np.float32)}
    dp = dl[:, None] * p["w"]
    dw = (g * dp[:, None, :]).sum(axis=2)
    ds = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
    de = ds[:, :, None] * p["va"] * (1 - e * e)
    out |= {"va": (e * ds[:, :, None]).sum(axis=(0, 1)), "ba": de.sum(axis=(0, 1)), "wa": g.reshape(-1, 2 * STATE).T @ de.reshape(-1, STATE)}
    dg = weight[:, :, None] * dp[:, None, :] + de @ p["wa"].T
    s, dx = STATE, np.zeros_like(xs)
    for k, d in enumerate("fb"):
        carry = np.zeros((len(y), s), np.float32)
        dproj = np.empty((*ids.shape, 3 * s), np.float32)
        du = np.zeros_like(p[f"u{d}"])
        for t, h, r, z, c, an, m in reversed(tapes[d]):
            total = carry + dg[:, t, k * s : (k + 1) * s]
            dc = total * m * (1 - z) * (1 - c * c)
            dz = total * m * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            dproj[:, t] = np.concatenate([dr, dz, dc], axis=1)
            da = np.concatenate([dr, dz, dc * r], axis=1)
            du += h.T @ da
            carry = total * (1 - m * (1 - z)) + da @ p[f"u{d}"].T
        flat = dproj.reshape(-1, 3 * s)
        out |= {f"u{d}": du, f"x{d}": xs.reshape(-1, INPUT).T @ flat, f"c{d}": flat.sum(axis=0)}
        dx += dproj @ p[f"x{d}"].T
    per_word = np.zeros_like(x)
    np.add.at(per_word, local.ravel(), dx.reshape(-1, INPUT))
    out["words"], out["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(out["words"], bucket, shown * per_word)
    np.add.at(out["chars"], triples, np.repeat(per_word / counts[:, None].astype(np.float32), counts, axis=0))
    return loss, out


@dataclass
class Model:
    """Network parameters, and the line from a text's highest window logit to its log odds."""

    params: dict[str, np.ndarray] | None
    slope: float = 1.0
    shift: float = 0.0

    def score(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -30, 30)))


def fit(rows: list[tuple[int, int, list[bytes]]], share: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit to rows (document number, label, words of a window); share is the share of label 1 among all labels.

    Four fifths of the documents train the network on windows with their document's
    label, by Adam; after a third and two thirds of the passes only telling windows of toxic documents go on. The others, whose windows the network
    hasn't seen, are left to ``calibrate``. With one label only, every score is
    the share.
    """
    if len({y for _, y, _ in rows}) < 2:
        return Model(None, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    numbers: dict[bytes, int] = {}
    ids = np.zeros((len(rows), WINDOW), np.int64)
    mask = np.zeros((len(rows), WINDOW), np.float32)
    for k, (_, _, words) in enumerate(rows):
        ids[k, : len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        mask[k, : len(words)] = 1
    words, doc, y = list(numbers), np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)
    p, rng = initial(seed), np.random.default_rng(seed)
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    held = np.array([in_calibration(d) for d in doc])
    train, step = np.flatnonzero(~held), 0
    per_epoch = max(1, -(-len(train) // BATCH))
    passes = max(epochs, -(-LEAST_UPDATES // per_epoch))
    for k in range(passes):
        if k in (passes // 3, 2 * passes // 3):
            kept = train[_telling(p, words, ids[train], mask[train], y[train], doc[train])]
        order = rng.permutation(kept if k >= passes // 3 else train)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            _, grads = gradients(p, words, ids[pick], mask[pick], y[pick], rng)
            for k, v in grads.items():
                one[k] += np.float32(0.1) * (v - one[k])
                two[k] += np.float32(0.001) * (v * v - two[k])
                p[k] -= np.float32(RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)) * one[k] / (np.sqrt(two[k]) + np.float32(1e-7))
    return Model(p)


def _telling(p: dict, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows go on: those of label 0, and of each document of label 1 its highest and the others that speak for it.

    A toxic document has clean windows too, which its label would teach wrongly.
    """
    projected = project(p, word_inputs(p, words))
    found = np.concatenate([logits(p, projected, ids[at : at + GROUP], mask[at : at + GROUP]) for at in range(0, len(ids), GROUP)])
    highest = np.full(int(doc.max()) + 1, -np.inf)
    np.maximum.at(highest, doc, found)
    return np.flatnonzero((y == 0) | (found >= highest[doc]) | (found > 0))


def in_calibration(doc: int) -> bool:
    """Whether a document, by its number, gives the line and not the network."""
    return zlib.crc32(str(doc).encode()) % 5 == 0


def calibrate(params: dict[str, np.ndarray], highest: np.ndarray, label: np.ndarray, share: float) -> Model:
    """The network with the line from highest logits of whole texts to log odds, weighted to the share of label 1."""
    weight = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))
    design = np.c_[highest, np.ones(len(highest))]
    line = np.array([0.5, -1.0])
    prior = line.copy()

    def cost(line: np.ndarray) -> float:
        z = design @ line
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + 0.05 * ((line - prior) ** 2).sum())

    # Newton steps, halved until the loss falls: whole steps can run away where few rows are undecided.
    for _ in range(50):
        prob = _sigmoid(design @ line)
        hess = (design * (weight * prob * (1 - prob))[:, None]).T @ design + 0.1 * np.eye(2)
        step_by = np.linalg.solve(hess, design.T @ (weight * (prob - label)) + 0.1 * (line - prior))
        while cost(line - step_by) > cost(line) and np.abs(step_by).max() > 1e-9:
            step_by = step_by / 2
        line = line - step_by
    return Model(params, float(max(line[0], 1e-3)), float(line[1]))


def held_out():
    """Rows whose label is never learnt: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, toxic, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True):
            words = split_words(text)
            starts = windows_of(len(words))
            chosen = sorted(starts, key=lambda s: zlib.crc32(f"{doc}:{s}".encode()))[:SAMPLE_WINDOWS]
            out += [(str(doc), int(toxic), b" ".join(words[s : s + WINDOW])) for s in sorted(chosen)]
        yield pd.DataFrame(out, columns=["doc", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model fitted to at most sample_docs documents of each label, which a hash of their ids chooses among the rows not held out."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        chosen = part if chosen is None else chosen.union(part)
    # At most twice sample_docs rows of two numbers, so the broadcast is bounded.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Of rows with one id one is learnt from, so the sample stays bounded.
    texts = materialise(joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    rows = texts.mapInPandas(_sample_windows, "doc string, toxic int, words binary").collect()
    names = sorted({r.doc for r in rows})
    place = {d: k for k, d in enumerate(names)}
    model = fit(sorted((place[r.doc], r.toxic, bytes(r.words).split(b" ")) for r in rows), share)
    if model.params is None:
        return model
    held = {r.doc: r.toxic for r in rows if in_calibration(place[r.doc])}
    if len(set(held.values())) < 2:
        held = {r.doc: r.toxic for r in rows}
    # The line is that of whole texts, as they are scored: one logit a document comes back.
    found = texts.mapInPandas(_highest(docs.sparkSession.sparkContext.broadcast((model, frozenset(held)))), "doc string, toxic int, highest double").collect()
    found = sorted((r.doc, r.highest, r.toxic) for r in found)
    return calibrate(model.params, np.array([h for _, h, _ in found]), np.array([y for _, _, y in found], np.float64), share)


def _highest(broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = broadcast.value
        for pdf in batches:
            mine = pdf[[str(d) in held for d in pdf["doc_id"]]]
            yield pd.DataFrame({"doc": mine["doc_id"].astype(str), "toxic": mine["toxic"], "highest": _by_text(lambda t: highest_logits(model, t), list(mine["text"]))})

    return run


def highest_logits(model: Model, texts: Iterator[str | None]) -> np.ndarray:
    """Highest logit among all windows of each text; zeros without a network."""
    known = _Numbers()
    starts, ends, owner, flat, n = [], [], [], [], 0
    count = 0
    for k, text in enumerate(texts):
        words = split_words(text)
        flat.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        s = windows_of(len(words))
        starts.append(n + s)
        ends.append(np.full(len(s), n + len(words)))
        owner.append(np.full(len(s), k))
        n += len(words)
        count = k + 1
    if not count:
        return np.zeros(0)
    highest = np.zeros(count)
    if model.params is not None:
        words = list(known)
        parts = [project(model.params, word_inputs(model.params, words[a : a + KEPT_WORDS])) for a in range(0, len(words), KEPT_WORDS)]
        projected = {d: np.concatenate([x[d] for x in parts]) for d in "fb"}
        flat_ids, s, e, who = (np.concatenate(x) for x in (flat, starts, ends, owner))
        highest = np.full(count, -np.inf)
        for at in range(0, len(s), GROUP):
            ids, mask = _gather(flat_ids, s[at : at + GROUP], e[at : at + GROUP])
            np.maximum.at(highest, who[at : at + GROUP], logits(model.params, projected, ids, mask))
    return highest


def score_texts(model: Model, texts: Iterator[str | None]) -> np.ndarray:
    """Scores of whole texts."""
    return model.score(highest_logits(model, texts))


def _by_text(value, texts: list) -> np.ndarray:
    """value of every text, about two million characters at a time."""
    out, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t) if t else 0
        if size > 2_000_000:
            out.append(value(iter(group)))
            group, size = [], 0
    return np.concatenate([*out, value(iter(group))])


def _scores(shared, texts: list) -> np.ndarray:
    return _by_text(lambda t: score_texts(shared.value, t), texts)


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs (doc_id, text).

    A text's score follows from the highest logit among all its overlapping
    windows. Words enter by a hashed embedding of the word and by the mean of those
    of its character triples. Only texts are scored: ids, labels and metadata are
    no inputs.

    Null, empty and blank texts are one window with one empty word and get its score. Rows of equal
    text have equal scores. A null id isn't held out. Without labels of both kinds
    every score is the share of label 1. Other columns are ignored, and an empty
    table gives no rows. A task holds one batch of texts, and the windows of about two million characters at a time.
    """
    model = model or train(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_values(rows, "text", "score double", lambda texts: [_scores(shared, texts)])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, columns as in docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return filter_values(docs, "text", lambda texts: _scores(shared, texts) < threshold)
