"""Embedding of texts by a provider, with a cache of vectors that is written back."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "content_hash string, vector array<float>, model_key string"


class Provider(Protocol):
    """What turns texts into vectors. It is sent to the tasks, so it must be picklable; it looks after its own repeated requests."""

    model_key: str
    dimension: int
    #: Most texts of one call, and most tokens (of about 4 characters) of one text.
    batch: int
    tokens: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def checked_vectors(provider: Provider, texts: Sequence[str]) -> list[list[float]]:
    """One call's vectors; ValueError if their number, their length or a value isn't right."""
    vectors = [list(map(float, v)) for v in provider.embed(texts)]
    if len(vectors) != len(texts):
        raise ValueError(f"{provider.model_key}: {len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if len(v) != provider.dimension:
            raise ValueError(f"{provider.model_key}: a vector of {len(v)} numbers, not {provider.dimension}")
        if not all(map(math.isfinite, v)):
            raise ValueError(f"{provider.model_key}: a vector with a value that isn't finite")
    return vectors


def read_cache(spark: SparkSession, path: str, model_key: str) -> DataFrame:
    """Rows (content_hash, vector) of one model, one for each text, though several runs may have written it; the cache is made if it isn't there."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("model_key") == model_key)
    return rows.groupBy("content_hash").agg(F.min("vector").alias("vector"))


def _hashed(texts: DataFrame, tokens: int) -> DataFrame:
    cut = F.substring("text", 1, 4 * tokens)
    return texts.where(F.regexp_like("text", F.lit(r"\S"))).select("id", cut.alias("text"), F.sha2(cut, 256).alias("content_hash"), (F.length("text") > 4 * tokens).alias("truncated"))


def embed_missing(texts: DataFrame, path: str, provider: Provider, calls: int | None = None) -> None:
    """Embed what the cache lacks and append it.

    Texts (id, text) are told apart by what the model reads of them, so copies are merged before the shuffle and embedded once.
    ``calls`` bounds the calls at a time. The append is one commit: a run that fails leaves no vectors of half its texts. A task
    that is lost asks the provider again.
    """
    spark = texts.sparkSession
    known = read_cache(spark, path, provider.model_key).select("content_hash")
    wanted = _hashed(texts, provider.tokens).groupBy("content_hash").agg(F.any_value("text").alias("text")).join(known, "content_hash", "left_anti")

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), provider.batch):
                part = frame.iloc[at : at + provider.batch]
                yield pd.DataFrame({"content_hash": part["content_hash"], "vector": checked_vectors(provider, list(part["text"])), "model_key": provider.model_key})

    spread = wanted if calls is None else wanted.repartition(calls, "content_hash")
    spread.mapInPandas(embed, CACHE).write.mode("append").parquet(path)


def embed_texts(texts: DataFrame, path: str, provider: Provider, calls: int | None = None) -> DataFrame:
    """Rows (id, vector, truncated), one for each row of texts; null and blank texts have null vectors.

    What the cache at ``path`` lacks is embedded first. Only ids and hashes meet the vectors, not the texts.
    """
    embed_missing(texts, path, provider, calls)
    hashed = _hashed(texts, provider.tokens).select("id", "content_hash", "truncated")
    blank = texts.where(~F.coalesce(F.regexp_like("text", F.lit(r"\S")), F.lit(False))).select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(False).alias("truncated"))
    return hashed.join(read_cache(texts.sparkSession, path, provider.model_key), "content_hash").select("id", "vector", "truncated").unionByName(blank)
