"""The chunkers as table functions that SQL calls."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.operators.chunkers import Piece, paragraph_pieces, recursive_pieces

_CHUNK = [StructField("chunk_index", LongType()), StructField("chunk", StringType()), StructField("char_start", LongType()), StructField("char_end", LongType())]


def overlapped_pieces(pieces: list[Piece], overlap: int) -> Iterator[tuple[str, int, int]]:
    """Chunks (text, start, end) that begin with the end of the chunk before them, as ``chunkers.overlapped`` does with columns."""
    before = ""
    for k, (text, start) in enumerate(pieces):
        raw = before[-overlap:] if k and overlap > 0 else ""
        tail = raw.split(" ", 1)[-1]
        yield (f"{tail} {text}" if tail else text), max(0, start - len(raw) - bool(tail)), start + len(text)
        before = text


def chunks(text: str | None, size: int, overlap: int = 0, strategy: str = "paragraph") -> Iterator[tuple[int, str, int, int]]:
    """Numbered chunks of one text; null and blank texts have none."""
    if text and text.strip():
        pieces = recursive_pieces(text, size) if strategy == "recursive" else paragraph_pieces(text, size)
        for k, chunk in enumerate(overlapped_pieces(pieces, overlap)):
            yield k, *chunk


class ChunkText:
    """chunk_text(text, size, overlap, strategy): the chunks of a text, for LATERAL joins; nothing is shuffled."""

    def eval(self, text: str, size: int, overlap: int, strategy: str) -> Iterator[tuple]:
        yield from chunks(text, size, overlap, strategy)


class ChunkTable:
    """chunk_table(TABLE(t) [PARTITION BY ...], size, overlap, strategy): the rows of t without ``text``, one for each chunk."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, strategy: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "text" not in rows.dataType.fieldNames():
            raise ValueError("the first argument is a table with a column text")
        clash = {f.name for f in _CHUNK} & set(rows.dataType.fieldNames())
        if clash:
            raise ValueError(f"the table has columns of the result: {sorted(clash)}")
        return AnalyzeResult(StructType([*(f for f in rows.dataType.fields if f.name != "text"), *_CHUNK]))

    def eval(self, rows: Row, size: int, overlap: int, strategy: str) -> Iterator[tuple]:
        kept = [rows[c] for c in rows.__fields__ if c != "text"]
        for chunk in chunks(rows["text"], size, overlap, strategy):
            yield *kept, *chunk


def register(spark: SparkSession) -> None:
    """Make chunk_text and chunk_table known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=StructType(_CHUNK)))
    spark.udtf.register("chunk_table", udtf(ChunkTable))
