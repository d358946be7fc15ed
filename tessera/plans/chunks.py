"""Queries of the chunkers, as operators and as SQL functions, against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunk_functions, samples
from tessera.plans.chunk_sql import paragraph_sql, recursive_sql
from tessera.plans.registry import query
from tessera.sources.tables import read_table, read_view, view_sql

SIZE, OVERLAP = 300, 40
#: The given texts have no blank lines, so some of their sentences' ends become some. Spark and DuckDB both take this.
TEXT = "SELECT doc_id, replace(replace(text, 'en. ', concat('en.', chr(10), chr(10), ' ')), 'er. ', concat('er.', chr(10), chr(10), chr(10))) AS text FROM {}"


def _sql_chunks(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    chunk_functions.register(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql(sql.format(TEXT.format("{docs}")), docs=docs)


def _shared(sql: str) -> str:
    return f"SELECT doc_id, chunk_index, text, char_start, char_end FROM ({sql})"


@query(_shared(paragraph_sql(TEXT.format("documents"), SIZE, OVERLAP)))
def sql_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by a LATERAL join with the table function."""
    return _sql_chunks(spark, sf_dir, f"SELECT t.doc_id, c.chunk_index, c.chunk AS text, c.char_start, c.char_end FROM ({{}}) t, LATERAL chunk_text(t.text, {SIZE}, {OVERLAP}, 'paragraph') c")


@query(_shared(recursive_sql(TEXT.format("documents"), SIZE, OVERLAP)))
def sql_recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the table function over the whole table, partitioned by document."""
    return _sql_chunks(spark, sf_dir, f"SELECT doc_id, chunk_index, chunk AS text, char_start, char_end FROM chunk_table(TABLE({{}}) PARTITION BY (doc_id), {SIZE}, {OVERLAP}, 'recursive')")


def _drawn(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 8) AS BIGINT)"


@query(
    f"{view_sql('documents_v')}, s AS (SELECT collection, doc_id, chunk_count, row_number() OVER (PARTITION BY collection ORDER BY {_drawn(7)}, doc_id) AS place FROM documents_v WHERE status = 'ready' AND chunk_count > 0 QUALIFY place <= 6), "
    f"r AS (SELECT *, {_drawn(8)} % greatest(1, chunk_count - 3) AS start FROM s) "
    "SELECT collection, doc_id, CAST(place AS INTEGER) AS place, unnest(range(start, least(start + 4, chunk_count))) AS chunk_index FROM r"
)
def sampled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ready documents of each collection, and four neighbouring chunks of each."""
    ready = read_view(spark, sf_dir, "documents_v").where((F.col("status") == "ready") & (F.col("chunk_count") > 0)).select("collection", "doc_id", "chunk_count")
    return samples.chunk_runs(samples.sample_documents(ready, 7, "collection"), 7).drop("chunk_count")
