"""From documents to chunks: windows, overlap, batches and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_chunks(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Fixed windows of size characters: id, doc_id, chunk_index, text, char_start, char_end.

    With an overlap, a chunk starts with the last overlap characters of the one
    before it, from their first space on. Null, empty and blank texts have no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    length = F.length("text")

    def window(start):
        """A window and the characters before it. It is cut here, so that the rows of chunks don't carry the whole text."""
        before = F.substring("text", F.greatest(start - overlap, F.lit(0)) + 1, F.least(start, F.lit(overlap)))
        return F.struct(start.alias("from"), F.least(start + size, length).cast("long").alias("end"), before.alias("tail"), F.substring("text", start + 1, F.lit(size)).alias("body"))

    full = docs.where(F.regexp_like("text", F.lit(r"\S")))
    each = full.select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), length - 1, F.lit(size)), window)))
    cut = F.when(F.instr("tail", " ") > 0, F.substring("tail", F.instr("tail", " ") + 1, F.length("tail"))).otherwise(F.col("tail")) if overlap else F.lit("")
    index = (F.col("from") / size).cast("long")
    return each.select(
        F.concat_ws("_", "doc_id", index).alias("id"), "doc_id", index.alias("chunk_index"), F.concat(cut, "body").alias("text"),
        (F.col("from") - F.length(cut)).cast("long").alias("char_start"), F.col("end").alias("char_end"),
    )


def truncated(docs: DataFrame, tokens: int) -> DataFrame:
    """Texts cut to 4 characters for each token allowed, and whether they were longer."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.substring(text, 1, 4 * tokens).alias("text"), (F.length(text) > 4 * tokens).alias("truncated"))


def batch_number(index, size: int):
    """1-based batch of a chunk."""
    return (F.floor(index / size) + 1).cast("long")


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct content hashes of texts that the cache doesn't hold."""
    wanted = texts.select(F.sha2(F.col("text"), 256).alias("content_hash")).where(F.col("content_hash").isNotNull())
    return wanted.distinct().join(cache.select("content_hash"), "content_hash", "left_anti")


def bad_vectors(vectors: DataFrame, dimension: int, max_chars: int = 100_000, max_metadata: int = 65_536) -> DataFrame:
    """Rows that may not be written, with the reason: vector missing, of the wrong length or with a value that isn't finite, text or metadata too long.

    vectors: id, vector, and text and metadata if there are such columns.
    """
    v = F.col("vector")
    reason = F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    if "text" in vectors.columns:
        reason = reason.when(F.length("text") > max_chars, "text")
    if "metadata" in vectors.columns:
        reason = reason.when(F.octet_length("metadata") > max_metadata, "metadata")
    return vectors.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())
