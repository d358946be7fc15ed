"""Chunks by paragraphs or by ever finer separators, with overlap; blocks of a text as elements, and which chunks they touch."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A stretch of text and where it begins.
Piece = tuple[str, int]
#: Separators of the recursive chunker, coarse to fine; pieces keep theirs.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Characters of context on each side of a block, references of a chunk, characters of a heading.
CONTEXT, MAX_REFS, MAX_HEADING = 600, 8, 1000
#: Characters of a bin in which spans meet; a chunk lies in one or two.
BIN = 4096
#: Bytes of texts whose pieces are held at a time; a text is held whole.
GROUP_BYTES = 1_000_000


def pack(pieces: Iterable[Piece], size: int, glue: str, divide: Callable[[str, int], list[Piece]]) -> list[Piece]:
    """Pieces joined with glue as long as they fit; the last one is still open.

    A piece above the size is divided, and what divide leaves last is packed on.
    """
    done: list[Piece] = []
    held, at = "", 0
    for text, start in pieces:
        if len(held) + len(glue) + len(text) <= size:
            held, at = (held + glue + text, at) if held else (text, start)
            continue
        if held.strip():
            done.append((held, at))
        held, at = text, start
        if len(text) > size:
            *parts, (held, at) = divide(text, start)
            done += parts
    return [*done, (held, at)]


def windows(text: str, start: int, size: int) -> list[Piece]:
    return [(text[k : k + size], start + k) for k in range(0, len(text), size)]


def _located(parts: Iterable[str], text: str, start: int) -> Iterator[Piece]:
    """Each part with its first place in text after the part before it."""
    at = 0
    for part in parts:
        at = max(at, text.find(part, at))
        yield part, start + at
        at += len(part)


def sentences(text: str, start: int, size: int) -> list[Piece]:
    """A long paragraph by its sentences and lines."""
    parts = text.replace(". ", ".\n").split("\n")
    return pack(_located(parts, text, start), size, " ", lambda s, at: windows(s, at, size))


def _stripped(pieces: Iterable[Piece]) -> Iterator[Piece]:
    for text, start in pieces:
        yield text.strip(), start + len(text) - len(text.lstrip())


def paragraph_pieces(text: str, size: int) -> list[Piece]:
    """Paragraphs packed to the size; long ones by sentences, long sentences by windows."""
    parts = _stripped(p for p in _located(text.split("\n\n"), text, 0) if p[0].strip())
    *done, last = pack(parts, size, "\n\n", lambda p, at: sentences(p, at, size))
    return list(_stripped([*done, last] if last[0].strip() else done))


def recursive_pieces(text: str, size: int) -> list[Piece]:
    """Spans of at most the size that end at the coarsest separator possible."""

    def spans(low: int, high: int, level: int) -> Iterator[tuple[int, int]]:
        if high - low <= size:
            yield low, high
        elif level == len(SEPARATORS):
            yield from ((k, min(k + size, high)) for k in range(low, high, size))
        else:
            ends = [low + m.end() for m in re.finditer(re.escape(SEPARATORS[level]), text[low:high])] + [high]
            while low < high:
                # The farthest end that fits, or else the nearest one.
                k = bisect_right(ends, low + size) - 1
                end = ends[k] if k >= 0 and ends[k] > low else ends[bisect_right(ends, low)]
                yield from spans(low, end, level + 1)
                low = end

    if size <= 0:
        return []
    return [p for p in _stripped((text[a:b], a) for a, b in spans(0, len(text), 0)) if p[0]]


_CHUNKS = "array<struct<text:string,char_start:long,char_end:long>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())]))


def in_groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Neighbouring texts of about so many bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, end - at)
        at = end


def chunk_arrays(docs: DataFrame, size: int, strategy: str = "paragraph") -> DataFrame:
    """docs (doc_id, text) with ``chunks`` for the text, a bounded group of texts at a time; null and blank texts have none."""
    pieces = recursive_pieces if strategy == "recursive" else paragraph_pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_groups(batch.column(1)):
                found = [[{"text": t, "char_start": start, "char_end": start + len(t)} for t, start in (pieces(text, size) if text and text.strip() else [])] for text in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(found, _ARROW)], names=["doc_id", "chunks"])
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunks {_CHUNKS}")


def overlapped(chunks: Column, overlap: int) -> Column:
    """Chunks that begin with the end of the chunk before them, from its first space on; starts are moved by as much."""
    if overlap <= 0:
        return chunks

    def joined(chunk: Column, index: Column) -> Column:
        before = F.get(chunks, index - 1)["text"]
        raw = F.when(F.length(before) > overlap, F.substring(before, F.length(before) - overlap + 1, F.lit(overlap))).otherwise(before)
        tail = F.when(F.instr(raw, " ") > 0, F.substring(raw, F.instr(raw, " ") + 1, F.length(raw))).otherwise(raw)
        some = F.length(tail) > 0
        moved = F.struct(
            F.when(some, F.concat(tail, F.lit(" "), chunk["text"])).otherwise(chunk["text"]).alias("text"),
            F.greatest(F.lit(0), chunk["char_start"] - F.length(raw) - some.cast("int")).cast("long").alias("char_start"),
            chunk["char_end"].alias("char_end"),
        )
        return F.when(index == 0, chunk).otherwise(moved)

    return F.transform(chunks, joined)


def chunk_documents(docs: DataFrame, size: int, overlap: int = 0, strategy: str = "paragraph") -> DataFrame:
    """Rows (id, doc_id, chunk_index, text, char_start, char_end); any strategy but ``recursive`` is by paragraphs.

    A document's chunks stay together in one row until they have their overlap, so
    nothing is shuffled. Null and blank texts have no chunks.
    """
    made = chunk_arrays(docs, size, strategy).select("doc_id", F.posexplode(overlapped(F.col("chunks"), overlap)).alias("chunk_index", "c"))
    index = F.col("chunk_index").cast("long")
    return made.select(F.concat_ws("_", "doc_id", index).alias("id"), "doc_id", index.alias("chunk_index"), "c.text", "c.char_start", "c.char_end")


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk, which ingestion reports as an error."""
    return docs.join(chunks.select("doc_id"), "doc_id", "left_anti")


def block_kind(block: Column) -> Column:
    """Kind of a stripped block; the first rule that fits: image, heading, table, equation, text."""
    lines = F.filter(F.transform(F.split(block, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    bars = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    table = F.exists(F.zip_with(bars, F.slice(bars, 2, F.greatest(F.size(bars), F.lit(1))), lambda a, b: a & F.coalesce(b, F.lit(False))), lambda x: x)

    def equation(x: Column) -> Column:
        return (F.length(x) <= 500) & ~F.contains(x, F.lit("\n")) & F.regexp_like(x, F.lit(r"[=^_]|\\(?:frac|sum|int|le|ge)")) & F.regexp_like(x, F.lit(r"\p{L}"))

    math = F.regexp_like(block, F.lit(r"^\s*(?:\$\$|\\\[|\\begin\{equation\})"))
    return (
        F.when(F.regexp_like(block, F.lit(r"!\[[^\]]*\]\([^)]+\)")), "image").when(F.startswith(block, F.lit("#")), "heading")
        .when(table, "table").when(math | equation(block) | F.exists(lines, equation), "equation").otherwise("text")
    )


def block_elements(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, element_index, kind, caption, text, char_start, char_end, context): the blocks between blank lines.

    Spans come from the running length of the blocks before. The caption is an
    image's alternative text or a heading's text; context is the text around the block, null if blank.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    blocks = docs.where("text is not null").select("doc_id", "text", F.posexplode(F.split("text", "\n\n")).alias("place", "raw"))
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("raw") + 2).over(before), F.lit(0))
    blocks = blocks.withColumn("start", at + F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))).withColumn("block", strip(F.col("raw"))).where("block <> ''")
    kind = block_kind(F.col("block"))
    end = F.col("start") + F.length("block")
    low, high = F.greatest(F.lit(0), F.col("start") - CONTEXT), F.least(F.length("text"), end + CONTEXT)
    caption = F.when(kind == "image", F.trim(F.regexp_extract("block", r"!\[([^\]]*)\]\([^)]+\)", 1))).when(kind == "heading", F.substring(strip(F.regexp_replace("block", "^#+", "")), 1, MAX_HEADING))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return blocks.select(
        "doc_id", index.cast("long").alias("element_index"), kind.alias("kind"), F.nullif(caption, F.lit("")).alias("caption"), F.col("block").alias("text"),
        F.col("start").cast("long").alias("char_start"), end.cast("long").alias("char_end"), F.nullif(strip(F.substring("text", (low + 1).cast("int"), (high - low).cast("int"))), F.lit("")).alias("context"),
    )


def span_pairs(left: DataFrame, right: DataFrame, on: str = "doc_id", width: int = BIN) -> DataFrame:
    """All pairs of a span (l0, l1) of ``left`` and a span (r0, r1) of ``right`` of one document that overlap, each once.

    Spans go into bins of ``width`` characters and meet within a bin only, so a long document is spread over many
    keys, and no chunk meets all the elements of its document. Of several bins that a pair shares, the one with the later begin keeps it.
    Spans with a null end meet nothing.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(F.col(low), F.col(high) - 1) / width)))
    met = left.withColumn("_bin", bins("l0", "l1")).join(right.withColumn("_bin", bins("r0", "r1")), [on, "_bin"])
    overlap = (F.col("r0") < F.col("l1")) & (F.col("r1") > F.col("l0"))
    return met.where(overlap & (F.floor(F.greatest("l0", "r0") / width) == F.col("_bin"))).drop("_bin")


def element_refs(elements: DataFrame, chunks: DataFrame, limit: int = MAX_REFS) -> DataFrame:
    """Rows (doc_id, chunk_index, content_kinds, refs) of the chunks that elements other than text touch.

    An element without a span belongs to its document's first chunk. A chunk keeps
    the first ``limit`` elements; content_kinds lists their kinds, sorted.
    """
    shown = elements.where("kind <> 'text'").select("doc_id", "element_index", "kind", F.col("char_start").alias("r0"), F.col("char_end").alias("r1"))
    spans = chunks.select("doc_id", "chunk_index", F.col("char_start").alias("l0"), F.col("char_end").alias("l1"))
    made = ("doc_id", "chunk_index", "element_index", "kind")
    placed = span_pairs(spans, shown).select(*made)
    loose = spans.where("chunk_index = 0").join(shown.where("r0 IS NULL OR r1 IS NULL"), "doc_id").select(*made)
    pairs = placed.unionByName(loose)
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "chunk_index").orderBy("element_index"))).where(F.col("n") <= limit)
    kept = first.groupBy("doc_id", "chunk_index").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("content_kinds"), F.array_sort(F.collect_list("element_index")).alias("refs"))
    return kept.select("doc_id", "chunk_index", "content_kinds", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))
