"""Repeated passages across documents by sparse suffix arrays at minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import map_values, materialise, n_partitions, release, utf8

#: Words of a repeated passage at least, and of the grams among which minimisers are chosen.
MIN_WORDS, GRAM = 50, 8
#: A minimiser lies among the first FIRST places of every passage, so MIN_WORDS - FIRST + 1 words follow it within the passage.
FIRST = 18
#: Words hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 19
#: Rows of a group at most, which is one row of an intermediate table.
GROUP_ROWS = 1 << 16
#: About how many rows of a sorted range one task compares.
RANGE_ROWS = 1_000_000
_EVEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * _EVEN
    return x ^ (x >> np.uint64(29))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; places too near the end are left out."""
    out, width, at = None, 0, 0
    power = h
    size = 1
    while size <= n:
        if n & size:
            m = len(h) - (width + size) + 1
            if m <= 0:
                return h[:0]
            out = power[:m] if out is None else _mix(out[:m] * _ODD + power[width : width + m])
            width += size
        size *= 2
        if size <= n:
            k = len(power) - size // 2
            if k <= 0:
                return h[:0]
            power = _mix(power[:k] * _ODD + power[size // 2 : size // 2 + k])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def minimisers(h: np.ndarray, gram: int = GRAM, window: int = FIRST) -> np.ndarray:
    """Places, ascending, each the last place of the smallest gram hash of some ``window`` neighbouring places."""
    g = gram_hashes(h, gram)
    if len(g) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    out = []
    for at in range(0, len(view), CHUNK):
        part = view[at : at + CHUNK]
        out.append(np.unique(at + np.arange(len(part)) + part.argmin(axis=1)))
    return np.unique(np.concatenate(out))


def _suffixes(least: int, first: int):
    """Rows of suffixes kept: the row's number, the place, and the hash of the words that any passage holds from there on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, places, keys = [], [], []
            for row, body in zip(pdf["row"], pdf["body"], strict=True):
                h = word_hashes(body.split())
                if len(h) < least:
                    continue
                keyed = gram_hashes(h, least - first + 1)
                at = minimisers(h, GRAM, first)
                at = at[at < len(keyed)]
                rows.append(np.full(len(at), row))
                places.append(at)
                keys.append(keyed[at].view(np.int64))
            if rows:
                yield pd.DataFrame({"row": np.concatenate(rows), "place": np.concatenate(places).astype(np.int32), "key": np.concatenate(keys)})

    return run


def _candidates(least: int, first: int):
    """Passages of ``least`` words that hold a repeated suffix among their first places: place and hash of each."""

    def make(batch: list[dict]) -> list[pa.Array]:
        places, keys, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [0]
        for x in batch:
            passage = gram_hashes(word_hashes(x["body"].split()), least)
            at = np.unique((np.asarray(x["places"], np.int64)[:, None] - np.arange(first)).ravel())
            at = at[(at >= 0) & (at < len(passage))]
            places.append(at.astype(np.int32))
            keys.append(passage[at].view(np.int64))
            ends.append(ends[-1] + len(at))
        found = pa.StructArray.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(keys))], names=["place", "key"])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]

    return make


def _runs(kind: pa.DataType):
    """Rows of one range, sorted by key, in groups: those with an equal neighbour, with the least holder of their run.

    A run at an end of the range may go on in another one: it is pending, even if it is a single row, in groups of its own with
    its key, their sizes and its least holder. All other runs' rows are packed together, each with its least holder.
    """
    lists = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(kind)
    out = pa.schema({"rows": lists[0], "places": lists[1], "firsts": lists[2], "key": pa.int64(), "n": pa.int64(), "least": kind})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        key, row, place = (held.column(c).to_numpy() for c in ("key", "row", "place"))
        # Holders by number, in their order; a null one comes after all.
        names = pc.unique(held.column("holder").drop_null())
        names = names.take(pc.sort_indices(names))
        number = pc.fill_null(pc.index_in(held.column("holder"), value_set=names), len(names)).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        least = np.minimum.reduceat(number, starts)
        inside = np.ones(len(starts), bool)
        inside[[0, -1]] = False
        sure = np.flatnonzero(np.repeat(inside & (sizes > 1), sizes))
        first = lambda k: names.take(pa.array(k, mask=k == len(names)))

        def group(rows: np.ndarray, firsts: np.ndarray, end: int | None) -> pa.RecordBatch:
            x = first(firsts)
            values = (row[rows], place[rows].astype(np.int32), x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)
            cut = pa.array([0, len(rows)], pa.int32())
            known = [pa.array([None if end is None else int(v)], pa.int64()) for v in ((0, 0) if end is None else (key[starts[end]], len(rows)))]
            held_by = first(least[[end]]) if end is not None else pa.nulls(1, kind)
            return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(cut, v if isinstance(v, pa.Array) else pa.array(v)) for v in values), *known, held_by.combine_chunks() if isinstance(held_by, pa.ChunkedArray) else held_by], schema=out)

        of = np.repeat(least, sizes)
        for at in range(0, len(sure), GROUP_ROWS):
            part = sure[at : at + GROUP_ROWS]
            yield group(part, of[part], None)
        for end in np.unique([0, len(starts) - 1]):
            for at in range(starts[end], starts[end] + sizes[end], GROUP_ROWS):
                rows = np.arange(at, min(at + GROUP_ROWS, starts[end] + sizes[end]))
                yield group(rows, of[rows], end)

    return run


def neighbours(df: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Rows (row, place, first) of df (key, row, place, holder) whose key another row has; first is the least holder of the key.

    Rows are sorted over all ranges by key, then place in the corpus, so a key that very many rows have goes over many ranges, and each row is
    compared with its neighbours. Only the runs at the ends of ranges, two of each, are joined with what other ranges hold of their keys.
    """
    spark, kind = df.sparkSession, df.schema["holder"].dataType
    ranges = max(n_partitions(spark), -(-df.count() // rows_per_range))
    dealt = df.repartitionByRange(ranges, "key", "row", "place").sortWithinPartitions("key")
    name = kind.simpleString()
    marked = materialise(dealt.mapInArrow(_runs(to_arrow_type(kind)), f"rows array<long>, places array<int>, firsts array<{name}>, key long, n long, least {name}"), "marked")
    pending = marked.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("all_least"), F.lit(True).alias("again"))
    ends = materialise(pending.where("n > 1").drop("n"), "ends")
    settled = marked.join(ends, "key", "left").where("key IS NULL OR again")
    each = settled.select(F.inline(F.arrays_zip("rows", "places", "firsts")), "key", "all_least")
    return each.select(F.col("rows").alias("row"), F.col("places").alias("place"), F.when(F.col("key").isNull(), F.col("firsts")).otherwise(F.col("all_least")).alias("first"))


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id, n_words), one for each row of docs, and spans (row, start, end, first_doc_id), in words.

    spans are the places whose words occur somewhere else too, in the same text
    or another one, as passages of at least ``least`` words; they are maximal, and
    first_doc_id is the smallest doc_id that holds one of the span's passages.

    Each text's sparse suffix array holds its suffixes at minimisers only. Every passage has a minimiser
    among its first places, chosen by content alone, so equal passages keep the same suffix. All suffixes are
    sorted by a hash of the words that any passage holds from there on, and those without an equal neighbour go. The rest are
    extended to the left and right: all passages around them are sorted and compared over their whole length in the same way.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8().alias("body")), "texts")
    kept = materialise(texts.select("row", "body").mapInPandas(_suffixes(least, first), "row long, place int, key long"), "suffixes")
    twice = neighbours(kept.withColumn("holder", F.lit(0).cast("int")))
    near = twice.groupBy("row").agg(F.collect_list("place").alias("places"))
    passages = materialise(map_values(texts.join(near, "row").select("row", F.col("doc_id").alias("holder"), F.struct("body", "places").alias("x")), "x", "found array<struct<place:int,key:long>>", _candidates(least, first)).select("row", "holder", F.inline("found")), "passages")
    release(kept)
    hits = neighbours(passages).select("row", F.col("place").alias("start"), F.col("first").alias("first_doc_id"))
    w = Window.partitionBy("row").orderBy("start")
    gap = (F.col("start") > F.lag("start").over(w) + least).cast("int")
    runs = hits.withColumn("run", F.sum(F.coalesce(gap, F.lit(1))).over(w))
    spans = runs.groupBy("row", "run").agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    rows = texts.select("row", F.col("doc_id").cast(kind).alias("doc_id"), F.coalesce(F.regexp_count(F.col("body").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words"))
    return rows, spans.select("row", "start", "end", "first_doc_id")


def passage_duplicates(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, n_dup_words, n_spans, longest, n_later_words, first_doc_ids), one for each row of docs.

    n_dup_words are words in passages of at least ``least`` words that occur
    elsewhere, longest is the longest span of them. n_later_words are those of
    spans first held by a smaller doc_id, which a de-duplicated corpus drops;
    first_doc_ids lists those holders, sorted and comma-joined.

    Words are those of the white-space rule, compared exactly. Null, empty and
    short texts have no passage. Repeated rows repeat each other; null ids are
    returned and name no holder. Other columns are ignored, and an empty table
    gives no rows.
    """
    rows, spans = repeated_passages(docs, least)
    spans = spans.join(rows.select("row", "doc_id"), "row").withColumn("long", (F.col("end") - F.col("start")).cast("long"))
    later = F.col("first_doc_id") < F.col("doc_id")
    per = spans.groupBy("row").agg(
        F.sum("long").alias("n_dup_words"), F.count("*").alias("n_spans"), F.max("long").alias("longest"), F.sum(F.when(later, F.col("long"))).alias("n_later_words"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(later, F.col("first_doc_id")))), lambda x: x.cast("string")), ",").alias("first_doc_ids"),
    )
    zero = F.lit(0).cast("long")
    found = rows.join(per, "row", "left")
    return found.select("doc_id", "n_words", *[F.coalesce(c, zero).alias(c) for c in ("n_dup_words", "n_spans", "longest", "n_later_words")], F.coalesce("first_doc_ids", F.lit("")).alias("first_doc_ids"))
