"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the pairs of ids that overlap."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import materialise, n_partitions, release, scratch_root
from tessera.llm.tokens import by_words

#: Pair keys that a task merges at a time, distinct pairs that it holds at most, and rows of a sorted range about.
MERGED, HELD, RANGE_ROWS = 4_000_000, 8_000_000, 2_000_000
#: Characters that are tokenized together, distinct stretches that a Python worker remembers at most, and characters of one that is worth it.
GROUP_CHARS, KNOWN, WORTH = 1_000_000, 400_000, 64
#: Where no token of either tokenizer goes on: before a space after what isn't white space. A text's last space stays where it is, for B has no token for it alone.
_BREAK, _LOOSE = re.compile(r"(?s)(?<=\S)(?= .)"), re.compile(r"\s |\0| \Z")
#: Stretches that may be tokenized in one go with a line end between them, which then is a token of its own.
_PLAIN = re.compile(r" \S+")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: visible Latin-1 characters for themselves, then the rest in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64)


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of x over groups of n each, one behind the other."""
    total = np.r_[0, np.cumsum(x)]
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def piece_bytes(piece: str) -> bytes:
    """The bytes of a sentence piece: U+2581 is a space, <0xHH> one byte."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Two tokenizers, and the alignments of stretches of text that they have seen.

    A text is cut before single spaces, where neither tokenizer has a token that goes on, so that each distinct
    stretch is tokenized and aligned once. Where a tokenizer's rules don't ensure that, a whole text is one stretch.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = byte_level()
        self.a_bytes = [b"" if (t := self.a.id_to_token(i)) is None or not set(t) <= byte.keys() else bytes(map(byte.__getitem__, t)) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.n_b = len(pieces)
        #: Every id of A with a comma and with a bar behind it, then every id of B with a comma and with a semicolon.
        self.signs = np.array([f"{i}{sign}" for n, end in ((len(self.a_bytes), "|"), (self.n_b, ";")) for i in range(n) for sign in (",", end)], object)
        newline = self.a.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if by_words(self.a) and len(newline) == 1 else None
        self.cut = by_words(self.a) and not any(re.search("[^▁]▁", p) for p in pieces)
        #: By stretch: the numbers of ids of A and of B, of groups and of links (int64 each), the links' keys (int64), and the groups as text, with a semicolon after each.
        self.known: dict[str, tuple | None] = {}

    def stretches(self, text: str) -> list[str]:
        """Space and text, cut where no token goes on."""
        if not self.cut:
            return [f" {text}"]
        if _LOOSE.search(text) or text[0] == " ":
            return _BREAK.split(f" {text}")
        return f" {text}".replace(" ", "\0 ").split("\0")[1:]

    def learn(self, parts: list[str]) -> None:
        """Tokenize and align stretches; those that a tokenizer doesn't give back byte by byte are kept as None."""
        plain = [p for p in parts if _PLAIN.fullmatch(p)] if self.newline is not None else []
        if plain:
            ids = np.array(self.a.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(ids == self.newline)
            self._learn(plain, ids[ids != self.newline], np.diff(np.r_[0, ends, len(ids)]) - np.r_[0, np.ones(len(ends), np.int64)])
        odd = [p for p in parts if not _PLAIN.fullmatch(p)] if plain else parts
        if odd:
            ids = [e.ids for e in self.a.encode_batch_fast(odd, add_special_tokens=False)]
            self._learn(odd, _flat(ids), np.array([len(x) for x in ids]))

    def _learn(self, parts: list[str], a: np.ndarray, n_a: np.ndarray) -> None:
        """Align stretches whose ids of A are known; where any fails, each is held against its own bytes."""
        lists = self.b.encode([p[1:] for p in parts], num_threads=1)
        b, n_b = _flat(lists), np.array([len(x) for x in lists])
        size = np.array([len(p.encode()) for p in parts])
        same = all(np.array_equal(_sums(sizes[ids], n), size) for sizes, ids, n in ((self.a_size, a, n_a), (self.b_size, b, n_b)))
        body = "".join(parts).encode()
        if same and body == b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            self._align(parts, a, n_a, b, n_b, size)
            return
        if len(parts) == 1:
            self.known[parts[0]] = None
            return
        half = len(parts) // 2
        for lo, hi in ((0, half), (half, len(parts))):
            at, end = (int(n_a[:k].sum()) for k in (lo, hi))
            self._learn(parts[lo:hi], a[at:end], n_a[lo:hi])

    def _align(self, parts: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, size: np.ndarray) -> None:
        """All stretches at once, one behind the other: each end of a token of A or B ends one link, each end of both one group."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        every = np.concatenate([a_ends, b_ends])
        every.sort(kind="stable")
        again = every[1:] == every[:-1]
        ends, both = every[np.r_[True, ~again]], every[1:][again]
        keys = a[np.searchsorted(a_ends, ends)] * self.n_b + b[np.searchsorted(b_ends, ends)]
        # The groups as text: each token's number with the sign behind it, A's before B's in every group.
        a_of, b_of = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        shut = [np.r_[of[1:] != of[:-1], True] for of in (a_of, b_of)]
        marks = np.r_[a * 2 + shut[0], 2 * len(self.a_bytes) + b * 2 + shut[1]]
        text = self.signs[marks[np.argsort(np.r_[a_of * 2, b_of * 2 + 1], kind="stable")]].tolist()
        last = np.cumsum(size)
        link_at, group_at, text_at = np.searchsorted(ends, last, "right"), np.searchsorted(both, last, "right"), np.cumsum(n_a + n_b).tolist()
        body, link_ends = keys.tobytes(), (link_at * 8).tolist()
        counts = np.stack([n_a, n_b, np.diff(group_at, prepend=0), np.diff(link_at, prepend=0)], axis=1).astype(np.int64).tobytes()
        link, at = 0, 0
        for k, (p, n, end) in enumerate(zip(parts, link_ends, text_at, strict=True)):
            self.known[p] = (counts[32 * k : 32 * k + 32], body[link:n], "".join(text[at:end]))
            link, at = n, end

    def documents(self, texts: Sequence[str | None]) -> Iterator[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct keys in order, and how many links have each."""
        cut = [self.stretches(t) if t else [] for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        for at in range(0, len(new), 8192):
            self.learn(new[at : at + 8192])
        for parts in cut:
            times = Counter(parts)
            found = [self.known[p] for p in times]
            if not found or None in found:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            n = np.fromiter(times.values(), np.int64, len(times))
            four = np.frombuffer(b"".join([f[0] for f in found]), np.int64).reshape(-1, 4)
            sums = (n @ four).tolist()
            links = np.frombuffer(b"".join([f[1] for f in found]), np.int64)
            keys, of = np.unique(links, return_inverse=True)
            many = np.bincount(of, np.repeat(n, four[:, 3]), len(keys)).astype(np.int64)
            text = "".join([self.known[p][2] for p in parts])[:-1]
            yield *sums, hashlib.sha256(text.encode()).hexdigest(), keys, many
        if len(self.known) > KNOWN:
            self.known.clear()
        else:
            for p in [p for p in new if len(p) > WORTH]:
                del self.known[p]


@functools.cache
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _deltas(x: np.ndarray) -> bytes:
    """Ascending keys as differences of 32 or 64 bits; a leading byte says which."""
    d = np.diff(x, prepend=0)
    return b"\4" + d.astype("<u4").tobytes() if d.max(initial=0) < 1 << 32 else b"\10" + d.astype("<i8").tobytes()


def _keys(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(body, "<u4" if body[0] == 4 else "<i8", offset=1), dtype=np.int64)


_TOTALS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(a_path: str, b_path: str, kind: pa.DataType):
    """Each document's totals and its distinct pair keys."""
    out = pa.schema([("doc_id", kind), *((c, pa.int64()) for c in _TOTALS), ("groups_sha256", pa.string()), ("keys", pa.binary()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum([len(t) if t else 0 for t in texts.to_pylist()])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_CHARS, "right")))
                found = list(pair.documents(texts.slice(at, end - at).to_pylist()))
                columns = [pa.array([f[k] for f in found], t) for k, t in enumerate([pa.int64()] * 4 + [pa.string()])]
                columns += [pa.array([_deltas(f[5]) for f in found], pa.binary()), pa.array([f[6].astype("<u4").tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *columns], schema=out)
                at = end

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts added up, run by run."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair keys of this partition with the number of its documents that hold each."""
    keys, counts, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge() -> None:
        nonlocal keys, counts, waiting, n
        more, times = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
        keys, counts = np.concatenate([keys, more]), np.concatenate([counts, times])
        order = np.argsort(keys, kind="stable")
        keys, counts = _summed(keys[order], counts[order])
        waiting, n = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500_000]), pa.array(counts[at : at + 500_000])], names=["key", "n"])

    for batch in batches:
        for body in batch.column(0).to_pylist():
            waiting.append(_keys(body))
            n += len(waiting[-1])
            if n > MERGED:
                merge()
                if len(keys) > HELD:
                    yield from rows()
                    keys, counts = keys[:0], counts[:0]
    merge()
    yield from rows()


def _write_shard(folder: str, n_b: int):
    """One sorted range as a file of all its keys and then all their counts; a row tells its place, its ends, and each A id's highest count in it."""
    out = pa.schema({"path": pa.string(), "first": pa.int64(), "last": pa.int64(), "n": pa.int64(), "a": pa.list_(pa.int64()), "most": pa.list_(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        keys, counts = _summed(held.column("key").to_numpy(), held.column("n").to_numpy())
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        # A name of its own for each attempt: only the row of the one that succeeds counts.
        name = f"shard-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(keys.astype("<i8").tobytes())
            f.write(counts.astype("<i8").tobytes())
        a = keys // n_b
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        most = np.maximum.reduceat(counts, starts)
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([int(x)]) for x in (keys[0], keys[-1], len(keys))), pa.array([a[starts].tolist()], pa.list_(pa.int64())), pa.array([most.tolist()], pa.list_(pa.int64()))], schema=out)

    return run


@functools.lru_cache(maxsize=64)
def _shard(folder: str, name: str, n: int) -> np.ndarray:
    """Keys and counts of a shard: mapped into memory where the shared folder is a mounted path, else read."""
    store, root = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", "<i8", "r", shape=(2, n))
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), "<i8").reshape(2, n)


class PairCounts:
    """How many documents hold a pair of ids, from sorted shards in the shared folder; and each A id's highest count."""

    def __init__(self, folder: str, shards: list[tuple[str, int, int]], most: np.ndarray, n_b: int):
        self.folder, self.n_b, self.most = folder, n_b, most
        self.shards = sorted(shards, key=lambda s: s[1])
        self.firsts = np.array([s[1] for s in self.shards], np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending keys."""
        out, at = np.zeros(len(keys), np.int64), 0
        shard = np.searchsorted(self.firsts, keys, "right") - 1
        for s in np.unique(shard):
            end = int(np.searchsorted(shard, s, "right"))
            name, _, n = self.shards[s]
            held = _shard(self.folder, name, n)
            place = np.minimum(np.searchsorted(held[0], keys[at:end]), n - 1)
            if not np.array_equal(held[0][place], keys[at:end]):
                raise ValueError("a pair has no count")
            out[at:end] = held[1][place]
            at = end
        return out


def _looked_up(counts, kind: pa.DataType):
    """Each document's links weighed by the corpus-wide counts."""
    names = ["doc_id", *_TOTALS, "groups_sha256", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: PairCounts = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                each = [_keys(x) for x in part.column("keys").to_pylist()]
                ends = np.r_[0, np.cumsum([len(x) for x in each])]
                links = np.frombuffer(b"".join(part.column("links").to_pylist()), "<u4").astype(np.int64)
                keys, of = np.unique(np.concatenate(each), return_inverse=True)
                held = table.of(keys)
                best = held == table.most[keys // table.n_b]
                sums = [np.r_[0, np.cumsum(links * x[of])] for x in (best, held)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-2]), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=names)

    return run


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A written table with one row for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the document's distinct pair keys (keys) with their links (links), packed."""
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, links binary"
    return materialise(docs.select("doc_id", "text").mapInArrow(_aligned(a_path, b_path, to_arrow_type(kind)), schema), "aligned")


def count_pairs(aligned: DataFrame, n_a: int, n_b: int, range_rows: int = RANGE_ROWS) -> PairCounts:
    """Document counts of all pairs of aligned_documents, as sorted shards in the shared folder.

    Tasks count their own documents' keys, the counts are sorted over all ranges and added up run by run, so each key
    comes from a task once at most. Only the list of shards and one number for each A id reach the driver: both are bounded by the vocabularies.
    """
    spark = aligned.sparkSession
    folder = f"{scratch_root(spark)}/pairs-{uuid.uuid4().hex[:12]}"
    partial = materialise(aligned.select("keys").mapInArrow(_partial_counts, "key long, n long"), "partial")
    ranges = max(n_partitions(spark), -(-partial.count() // range_rows))
    ordered = partial.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    shards = materialise(ordered.mapInArrow(_write_shard(folder, n_b), "path string, first long, last long, n long, a array<long>, most array<long>"), "shards")
    release(partial)
    most = np.zeros(n_a, np.int64)
    for r in shards.select(F.explode(F.arrays_zip("a", "most")).alias("x")).groupBy("x.a").agg(F.max("x.most").alias("most")).collect():
        most[r.a] = r.most
    return PairCounts(folder, [(r.path, r.first, r.n) for r in shards.select("path", "first", "n").collect()], most, n_b)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of docs (doc_id, text).

    a_path: a byte-level BPE of the tokenizers library, applied to space and text; b_path: a sentencepiece model, which adds the space. Special
    tokens' strings are plain text. A token of A and one of B are linked where their bytes overlap; groups are the smallest runs of both that
    cover the same bytes. A pair of ids counts the documents that hold it linked. n_best: links whose count is the highest that
    their A id has with any id of B, ties included; count_sum: the counts of all links.

    Null and empty texts, and those whose tokens don't give back space and text byte by byte, have no tokens: zeros and an empty digest. Repeated
    rows count each; null ids are returned. Other columns are ignored, and an empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    pair = _pair(a_path, b_path)
    aligned = aligned_documents(docs, a_path, b_path)
    counts = spark.sparkContext.broadcast(count_pairs(aligned, len(pair.a_bytes), pair.n_b))
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(_looked_up(counts, to_arrow_type(kind)), schema).select("doc_id", *_TOTALS, "n_best", "count_sum", "groups_sha256")
