"""A query over embedded texts. Its provider needs no network: a vector is the first bytes of its text's SHA-256."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.embedding import embed_missing, embed_texts
from tessera.plans.registry import query
from tessera.sources.scratch import scratch_folder
from tessera.sources.tables import read_table


class DigestProvider:
    """Vectors of the digest's bytes, from 0 to 255."""

    model_key, dimension, batch, tokens = "digest:document", 4, 96, 300

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(b) for b in hashlib.sha256(t.encode()).digest()[: self.dimension]] for t in texts]


_BYTES = ", ".join(f"CASE WHEN shown THEN CAST(CAST(concat('0x', substr(h, {2 * k + 1}, 2)) AS INTEGER) AS DOUBLE) ELSE -1 END AS v{k}" for k in range(4))


@query(f"WITH t AS (SELECT doc_id AS id, sha256(substr(text, 1, 1200)) AS h, coalesce(regexp_matches(text, '\\S'), false) AS shown, length(text) > 1200 AS long_text FROM documents) SELECT id, shown AND long_text AS truncated, {_BYTES} FROM t")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' vectors, where the cache holds those of the benchmark already; -1 for texts without one."""
    path, provider = scratch_folder(spark, "embeddings"), DigestProvider()
    embed_missing(read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), path, provider)
    found = embed_texts(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path, provider)
    return found.select("id", "truncated", *(F.coalesce(F.col("vector")[k].cast("double"), F.lit(-1.0)).alias(f"v{k}") for k in range(4)))
