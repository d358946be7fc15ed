"""Near-duplicate groups by SimHash: unequal pigeonhole thresholds over correlated bits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_values, materialise, n_partitions, release, utf8
from tessera.llm.graph import connected_components

#: Fingerprint bits, and at most how many may differ between linked fingerprints.
BITS, DISTANCE = 64, 2
#: Buckets above this many distinct fingerprints are divided by further bits.
MAX_BUCKET = 2000
#: What one emitted probe costs, in verified pairs: a probe is shuffled, a pair is one numpy operation.
PROBE_COST = 20
#: Shingles hashed at a time, so that a very long text needs no more memory than others.
SLICE = 1 << 15


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles, repeats included; zero without words.

    A text of fewer words than the width is one shingle.
    """
    return of_hashes(shingle_hashes(text, width, seed))


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) words, in order, repeats included; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    n = len(words) - width + 1
    rows = map(b" ".join, zip(*(words[k : k + n] for k in range(width)), strict=True))
    return np.fromiter((digest(s, seed) for s in rows), np.uint64, n)


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), SLICE):
        ones += np.unpackbits(h[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed long) of every row of docs."""
    make = lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]
    return map_values(docs.select("doc_id", utf8().alias("text")), "text", "fp long", make)


def _bit_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both = np.zeros((BITS, BITS))
    for pdf in batches:
        bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
        both += bits.T @ bits
    i, j = np.triu_indices(BITS)
    yield pd.DataFrame({"i": i, "j": j, "n": both[i, j]})


def bit_statistics(distinct: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each bit and absolute correlation of each pair of bits over all fingerprints.

    Bit 0 is the highest. Only 2,080 sums reach the driver, whatever the input.
    """
    n = distinct.count()
    both = np.zeros((BITS, BITS))
    for r in distinct.select("fp").mapInPandas(_bit_pairs, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = both[r.j, r.i] = r.n
    mean = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    return mean, corr


def partition_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of near-equal size; a group is grown with the bits most correlated to it.

    Correlated bits say the same thing, so they are kept together: the other
    groups then stay selective.
    """
    free = set(range(len(corr)))
    groups = []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(free, key=lambda b: (sum(corr[b, x] for x in free), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (sum(corr[b, x] for x in group), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(mean: np.ndarray, bits: list[int], t: int) -> float:
    """By how much a threshold of t multiplies the pairs that agree on all bits of the group, bits taken as independent."""
    agree = mean[bits] ** 2 + (1 - mean[bits]) ** 2
    odds = (1 - agree) / np.maximum(agree, 1e-9)
    return 1 + (odds.sum() if t else 0) + ((odds.sum() ** 2 - (odds**2).sum()) / 2 if t > 1 else 0)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost with the given sum, by dynamic programming over the groups.

    costs[i][t] is what group i costs at threshold t; -1 means that the group is not probed.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for (s, (c, ts)), (t, cost) in itertools.product(best.items(), group.items()):
            if s + t not in after or c + cost < after[s + t][0]:
                after[s + t] = (c + cost, [*ts, t])
        best = after
    return best[total]


def _probes(mask_bits: list[int], t: int) -> list[int]:
    """Masks under which two values that differ in at most t of the bits agree at least once."""
    if t < 0:
        return []
    return [_mask(set(mask_bits) - set(out)) for out in itertools.combinations(mask_bits, t)]


def plan_probes(distinct: DataFrame, distance: int = DISTANCE) -> list[int]:
    """Masks to probe with: any two fingerprints within the distance agree under at least one.

    For 2 to distance + 2 groups of bits, the pairs that agree on a group are
    counted over all fingerprints; what a threshold above zero adds is estimated
    from the bits' means. Thresholds sum to distance - groups + 1, the least that
    loses no pair, and the cheapest allocation of all wins.
    """
    mean, corr = bit_statistics(distinct)
    layouts = {m: partition_bits(corr, m) for m in range(2, distance + 3)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits)))).alias("v")) for m, groups in layouts.items() for k, bits in enumerate(groups)]
    sizes = distinct.select(F.explode(F.array(*keys)).alias("x")).groupBy("x.m", "x.k", "x.v").agg(F.count("*").alias("c"))
    found = {(r.m, r.k): r for r in sizes.groupBy("m", "k").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs"), F.sum("c").alias("n")).collect()}
    plans = []
    for m, groups in layouts.items():
        costs = []
        for k, bits in enumerate(groups):
            r = found.get((m, k))
            pairs, n = (float(r.pairs), int(r.n)) if r else (0.0, 0)
            costs.append({-1: 0.0} | {t: pairs * _within(mean, bits, t) + PROBE_COST * n * len(_probes(bits, t)) for t in range(distance + 1)})
        cost, ts = allocate(costs, distance - m + 1)
        plans.append((cost, m, [p for bits, t in zip(groups, ts, strict=True) for p in _probes(bits, t)]))
    return min(plans)[2]


def _refine(mask: int, distance: int) -> list[int]:
    """Masks with more bits: pairs within the distance that agree under mask agree under at least one of them."""
    rest = [b for b in range(BITS) if not mask >> (BITS - 1 - b) & 1]
    return [mask | _mask(rest[k :: distance + 1]) for k in range(distance + 1)]


def _buckets(distinct: DataFrame, masks: list[int], distance: int = DISTANCE) -> DataFrame:
    """Rows (mask, key, fp): each fingerprint once for each mask, buckets bounded by MAX_BUCKET.

    A larger bucket is divided by more bits, in a way that keeps every pair
    within the distance together somewhere; this ends, as few free bits allow few
    distinct values.
    """
    probe = lambda df, values: df.select(F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), F.col("fp").alias("fp")) for m in values])).alias("x")).select("x.*")
    rows = probe(distinct, masks)
    done = []
    while True:
        full = materialise(rows.groupBy("mask", "key").agg(F.count("*").alias("c")).where(F.col("c") > MAX_BUCKET).drop("c"), "full")
        over = [r.mask & (1 << 64) - 1 for r in full.select("mask").distinct().collect()]
        if not over:
            done.append(rows)
            break
        done.append(rows.join(full, ["mask", "key"], "left_anti"))
        hot = rows.join(full, ["mask", "key"], "left_semi")
        finer = {m: _refine(m, distance) for m in over}
        choice = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in xs])) for m, xs in finer.items()])
        rows = materialise(hot.select(F.explode(choice).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct(), "divided")
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with fewer links: each value but the smallest of its component, and a smaller value."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = label != np.arange(len(values))
    return values[own], values[label[own]]


def _linked(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets that lie together in the arrays, contracted."""
    new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
    starts = np.flatnonzero(new)
    left = np.repeat(np.r_[starts[1:], len(fp)], np.diff(np.r_[starts, len(fp)])) - np.arange(len(fp))
    a, b, lag, at = [], [], 1, np.flatnonzero(left > 1)
    while len(at):
        near = np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance
        a.append(fp[at[near]])
        b.append(fp[at[near] + lag])
        lag += 1
        at = at[left[at] > lag]
    if not a or not sum(map(len, a)):
        return fp[:0], fp[:0]
    return _contract(np.concatenate(a), np.concatenate(b))


def _verify(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                kept = [np.concatenate([k, pdf[c].to_numpy(np.int64)]) for k, c in zip(kept, ("mask", "key", "fp"), strict=True)]
            n = len(kept[0])
            # The last bucket may go on in the next batch.
            end = n if pdf is None else int(np.argmax((kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1]))) if n else 0
            if end:
                a, b = _linked(kept[0][:end], kept[1][:end], kept[2][:end].view(np.uint64), distance)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            kept = [k[end:] for k in kept]

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within the distance.

    Buckets are compared inside a task, in numpy; a task puts out a spanning
    forest of what it verified, at most one link for each row that it read.
    """
    rows = _buckets(distinct, plan_probes(distinct, distance), distance)
    n = n_partitions(distinct.sparkSession)
    dealt = rows.repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInPandas(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs.

    component_id is the smallest doc_id whose fingerprint can be reached over
    links of at most ``distance`` differing bits, the document itself included.
    Null and empty texts, and texts of white space only, have fingerprint zero and
    link like any other. Equal texts meet as one fingerprint before anything is
    compared. Rows with equal doc_id are each returned; a null doc_id never names
    a group unless the group has no other (then component_id is null). Other
    columns of docs are ignored. An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    parts = connected_components(links(distinct, distance))
    labelled = materialise(distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "labelled")
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = materialise(labelled.join(least, "component").select("fp", "component_id"), "names")
    release(distinct, labelled)
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
