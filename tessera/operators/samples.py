"""Seeded samples: a few documents of each group, and a run of neighbouring chunks of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a sample, and chunks of each.
DOCUMENTS, CHUNKS = 6, 4


def draw(seed: int, key: Column) -> Column:
    """A number below 2**32 that seed and key decide, alike in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def sample_documents(docs: DataFrame, seed: int, group: str, most: int = DOCUMENTS) -> DataFrame:
    """docs (doc_id, the group) with ``place``, 1 to ``most``: those of each group with the smallest draws, ties to the smaller doc_id.

    Each task keeps its own ``most`` of a group before anything is shuffled, so neither a table nor a large group is sorted.
    Rows without a doc_id are left out; a null group is a group.
    """
    order = Window.partitionBy(group).orderBy(draw(seed, F.col("doc_id")), "doc_id")
    return docs.where("doc_id IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def chunk_runs(sample: DataFrame, seed: int, run: int = CHUNKS) -> DataFrame:
    """Rows of sample (doc_id, chunk_count), one for each of ``run`` neighbouring chunks (all, if fewer) from a drawn one on, with ``chunk_index``. Documents without chunks go."""
    start = F.pmod(draw(seed + 1, F.col("doc_id")), F.greatest(F.lit(1), F.col("chunk_count") - run + 1))
    last = F.least(start + run, F.col("chunk_count").cast("long")) - 1
    return sample.where("chunk_count > 0").withColumn("chunk_index", F.explode(F.sequence(start, last)))
