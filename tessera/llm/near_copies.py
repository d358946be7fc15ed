"""Near copies by exact Jaccard similarity of word shingles, compared where SimHash or, beyond its reach, MinHash says so."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, n_partitions, release, utf8
from tessera.llm.graph import connected_components
from tessera.llm.simhash import links, of_hashes, shingle_hashes

#: Words of a shingle, and the similarity from which two texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints are probed to this distance. Near copies may differ in more bits (at 0.8 in ten of 64), so bands follow.
DISTANCE = 3
#: Bands and minima of each: a pair at similarity 0.8 shares no band in (1 - 0.8^4)^24 = 3 of a million cases.
BANDS, ROWS = 24, 4
#: Bins of a sketch, a byte each, and by how many standard errors a pair's sketches may fall short of the similarity.
BINS, ERRORS = 512, 4.5
#: Members of a bucket, and shingles of theirs, that lie in one block about; a task holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 4096, 4 << 20
#: Likely partners of a member that are verified at a time.
PARTNERS = 16
#: Shingles hashed at a time.
SLICE = 1 << 12

_rng = np.random.default_rng(11)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of lower-cased (A-Z) words; a text of fewer words is one shingle, one without words none."""
    return np.unique(shingle_hashes(text, width))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of the shingles under each hash function."""
    low = np.full(len(_FLIP), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        np.minimum(low, ((found[at : at + SLICE, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return low


def sketch(found: np.ndarray) -> bytes:
    """A byte for each bin of sorted hashes, from the smallest hash in it; 0 for an empty bin. Short texts lose next to nothing."""
    out = np.zeros(BINS, np.uint8)
    bins = (found >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else bins
    out[bins[first]] = (found[first] * _TIMES[0] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def likely(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Estimated similarity of one sketch to others; 0 where it falls so short that the sets can hardly have the similarity.

    The bins are a sample of the union without replacement, so the error vanishes where it is small.
    """
    used = np.maximum(((others > 0) | (one > 0)).sum(axis=1), 1)
    share = ((others == one) & (one > 0)).sum(axis=1) / used
    union = np.maximum((sizes + size) / (1 + similarity), 1)
    error = np.sqrt(similarity * (1 - similarity) / used * np.clip(1 - used / union, 0, 1))
    return np.where(share >= similarity - ERRORS * error - 2 / used, share, 0)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; of two empty ones it is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signatures(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                every = shingle_hashes(text, width)
                found = np.unique(every)
                low = minima(found)
                bands = [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)] if len(found) else []
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), np.uint64(of_hashes(every)).view(np.int64), np.array(bands, np.uint64).view(np.int64), sketch(found), len(found)))
            yield pd.concat([pdf[["_row"]].reset_index(drop=True), pd.DataFrame(rows, columns=["content", "fp", "bands", "low", "size"])], axis=1)

    return run


def _linked(width: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, np.zeros(0, np.uint64)
        for pdf in batches:
            keep = []
            for a, x, y in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if a != last:
                    last, left = a, shingles(x, width)
                keep.append(jaccard(left, shingles(y, width)) >= similarity)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the similarity."""
    used = materialise(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge"), "node", "left_semi"), "compared")
    two = pairs.join(used.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    two = two.join(used.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    found = materialise(two.select("a", "b", "text_a", "text_b").mapInPandas(_linked(width, similarity), "a long, b long"), "verified")
    release(used)
    return found


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each pair of blocks (key, i, j), which lie together, members by block, those outside the largest component first."""
    held = None
    for pdf in itertools.chain(batches, [None]):
        held = pdf if held is None else held if pdf is None else pd.concat([held, pdf], ignore_index=True)
        if held is None or not len(held):
            continue
        at = held[["key", "i", "j"]].to_numpy()
        new = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        # The last group may go on in the next batch.
        cuts = np.r_[0, new, len(held)] if pdf is None else np.r_[0, new]
        for start, stop in itertools.pairwise(cuts):
            part = held.iloc[start:stop]
            _, back, count = np.unique(part["component"].to_numpy(), return_inverse=True, return_counts=True)
            yield part.assign(inner=back == count.argmax()).sort_values(["block", "inner"], kind="stable", ignore_index=True)
        held = held.iloc[cuts[-1] :].reset_index(drop=True)


def _meetings(part: pd.DataFrame) -> Iterator[tuple[int, slice]]:
    """Members with ranges of others: each pair of the two blocks, or of the only one, that has a member outside the largest component."""
    outer, n = ~part["inner"].to_numpy(), len(part)
    if part["i"][0] == part["j"][0]:
        yield from ((k, slice(k + 1, n)) for k in range(int(outer.sum())))
        return
    cut = int(np.searchsorted(part["block"].to_numpy(), part["j"][0]))
    first = int(outer[:cut].sum())
    yield from ((k, slice(cut, n)) for k in range(first))
    yield from ((k, slice(first, cut)) for k in range(cut, cut + int(outer[cut:].sum())))


def _flagged(similarity: float):
    """Members that have a likely partner in another component, each once for a pair of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches):
            comp, size = part["component"].to_numpy(), part["size"].to_numpy()
            low = np.frombuffer(b"".join(part["low"]), np.uint8).reshape(len(part), -1)
            keep = np.zeros(len(part), bool)
            for k, others in _meetings(part):
                near = (comp[others] != comp[k]) & (likely(low[k], size[k], low[others], size[others], similarity) > 0)
                keep[others] |= near
                keep[k] |= near.any()
            if keep.any():
                yield part.loc[keep, ["key", "i", "j", "block", "component", "node"]]

    return run


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of each of the other sorted sets, none of them empty, are in the one."""
    flat = np.concatenate(others)
    hit = one.take(np.searchsorted(one, flat), mode="clip") == flat
    return np.add.reduceat(hit, np.r_[0, np.cumsum([len(x) for x in others])[:-1]], dtype=np.int64)


def _joined(similarity: float):
    """Verified links that join components: every likely pair of a pair of blocks is verified, or was joined by other links before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches):
            node, comp = part["node"].to_numpy(), part["component"].to_numpy().copy()
            sets = [np.frombuffer(x, np.uint64) for x in part["found"]]
            size = np.array([len(x) for x in sets])
            low = np.frombuffer(b"".join(map(sketch, sets)), np.uint8).reshape(len(part), -1)
            made = []
            for k, others in _meetings(part):
                share = likely(low[k], size[k], low[others], size[others], similarity)
                near = others.start + np.argsort(-share, kind="stable")[: np.count_nonzero(share)]
                while len(near := near[comp[near] != comp[k]]):
                    now, near = near[:PARTNERS], near[PARTNERS:]
                    both = _shared(sets[k], [sets[x] for x in now])
                    for x in now[both / (size[k] + size[now] - both) >= similarity]:
                        if comp[x] != comp[k]:
                            made.append((min(node[k], node[x]), max(node[k], node[x])))
                            comp[comp == comp[x]] = comp[k]
            if made:
                yield pd.DataFrame(made, columns=["a", "b"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "found": [shingles(t, width).tobytes() for t in pdf["text"]]})

    return run


def _joining(members: DataFrame, parts: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) after which no two likely partners of a bucket lie in different components, unless their texts differ too much.

    A bucket above BLOCK members is dealt into blocks, and each two of them meet. What
    is put out are members and the links that join components, never all pairs: no more rows than were read.
    """
    n = n_partitions(nodes.sparkSession)
    placed = materialise(members.select("key", "node", "size").join(parts.hint("merge"), "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component")), "placed")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), blocks).where("x <> y").select("key", "blocks")
    own = placed.join(mixed.hint("merge"), "key").join(nodes.select("node", "low").hint("merge"), "node").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = met.select("key", "i", "j", "block", "component", "node", "low", "size").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    kind = "key long, i int, j int, block int, component long, node long"
    flagged = materialise(dealt.mapInPandas(_flagged(similarity), kind), "flagged")
    sets = materialise(texts.join(flagged.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "text").mapInPandas(_sets(width), "node long, found binary"), "sets")
    again = flagged.join(sets.hint("merge"), "node").select("key", "i", "j", "block", "component", "node", "found").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialise(again.mapInPandas(_joined(similarity), "a long, b long").distinct(), "joining")
    release(placed, flagged, sets)
    return found


def _fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints SimHash links: each with the first of its fingerprint, and the firsts of linked ones."""
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "distinct")
    same = nodes.select("node", "fp").join(firsts.where("n > 1").select("fp", F.col("node").alias("a")).hint("merge"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    ends = links(firsts.select("fp"), distance)
    for end, fp in (("x", "a"), ("y", "b")):
        ends = ends.join(firsts.select(F.col("fp").alias(fp), F.col("node").alias(end)).hint("merge"), fp)
    return same.union(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay when each group of near copies keeps one row; columns as in docs.

    Two rows are linked if the Jaccard similarity of their sets of shingles is at
    least ``similarity``; a group is a connected component. It keeps the row of its
    smallest doc_id, nulls last; of rows with equal doc_id any one.
    Null and empty texts, and texts of white space only, are one group. An empty table gives no rows.

    Every link is verified on the texts. Compared are the pairs that SimHash links, by the
    probes of unequal thresholds, up to ``distance`` bits, and, as that many bits can't reach all texts of the similarity,
    each member of a MinHash bucket with two others of it, the smallest and the one in most company; then, where that left a bucket in several
    components, members with all their likely partners in other components by sketches, inside the tasks that hold their shingles.
    """
    # Columns of docs stay in a struct, so that none can clash with the row's number.
    rows = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    if rows.isEmpty():
        return rows.select("doc.*")
    signed = materialise(rows.select("_row", utf8("doc.text").alias("text")).mapInPandas(_signatures(width), "_row long, content binary, fp long, bands array<long>, low binary, size long"), "signatures")
    ids = rows.select("_row", F.col("doc.doc_id").alias("doc_id"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    # Rows of equal shingles are one node, named by the row that they keep.
    named = signed.join(ids.hint("merge"), "_row").groupBy("content").agg(F.min(who).alias("who"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("size").alias("size"))
    nodes = materialise(named.select(F.col("who.row").alias("node"), "who", "fp", "bands", "low", "size"), "nodes")
    texts = rows.select(F.col("_row").alias("node"), utf8("doc.text").alias("text"))

    keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = materialise(keys.join(pivots.hint("merge"), "key"), "members")
    # The text from which copies were made shares more buckets with them than they share with each other.
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.select("key", "node").join(weight.hint("merge"), "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    ends = members.select("node", F.col("pivot").alias("end")).union(members.join(hubs.hint("merge"), "key").select("node", F.col("hub").alias("end")))
    pairs = ends.where("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    # Both kinds of pairs are verified together, so that texts are shuffled once.
    tried = materialise(_fingerprint_pairs(nodes, distance).union(pairs).distinct(), "pairs")
    verified = _verified(tried, texts, width, similarity)

    parts = materialise(connected_components(verified), "components")
    more = _joining(members, parts, nodes, texts, width, similarity)
    if not more.isEmpty():
        parts = materialise(connected_components(verified.union(more)), "components")
    groups = nodes.select("node", "who").join(parts.hint("merge"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("who").alias("who"))
    stay = materialise(groups.select(F.col("who.row").alias("_row")), "stay")
    release(signed, nodes, members)
    return rows.join(stay.hint("merge"), "_row", "left_semi").select("doc.*")
