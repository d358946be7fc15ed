"""Reading tables, and views of the given tables in the shape of a retrieval service's tables.

Each view is a list of expressions that Spark SQL and DuckDB both accept, so
that a query and its SQL start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment that trailing windows end at; the events span January 2024.
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

#: View name: (table, expressions).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "documents_v": (
        "documents",
        (
            "doc_id",
            "coalesce(source, 'none') AS collection",
            "concat('doc_', CAST(doc_id AS VARCHAR(20)), '.txt') AS filename",
            "doc_id % 10 + 1 AS collection_id",
            "lang",
            "text",
            "coalesce(n_chars, 0) AS file_size",
            "CAST(floor(coalesce(n_chars, 0) / 4) AS LONG) AS token_count",
            "CAST(ceil(coalesce(n_chars, 0) / 512) AS LONG) AS chunk_count",
            "CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'ready' END AS status",
        ),
    ),
    "document_meta_v": (
        "documents",
        (
            "doc_id",
            "concat('{\"lang\":\"', coalesce(lang, 'none'), '\",\"n\":', CAST(coalesce(n_chars, 0) AS VARCHAR(20)), "
            "',\"mark\":', CASE doc_id % 5 WHEN 0 THEN '7' WHEN 1 THEN '\"7\"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' ELSE '[7, {\"tenant\":\"t1\"}]' END, "
            "CASE WHEN doc_id % 3 = 0 THEN ',\"tenant\":\"t1\"' ELSE '' END, "
            "',\"place\":{\"page\":', CAST(doc_id % 4 AS VARCHAR(20)), ',\"boxes\":[1,2.5]}', "
            "CASE WHEN doc_id % 2 = 0 THEN ',\"page_no\":12' ELSE ',\"document_filename\":\"f.txt\"' END, "
            "',\"multimodal_elements\":[{\"element_index\":', CAST(doc_id % 6 AS VARCHAR(20)), '}]}') AS meta",
        ),
    ),
    "query_log_v": (
        "events",
        (
            "event_id",
            "ts AS created_at",
            "event_type AS collection_name",
            "concat('q', regexp_extract(props, '[0-9]+', 0)) AS query",
            "TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS LONG) AS result_count",
            "value AS latency_ms",
            "TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 100 AS avg_score",
        ),
    ),
    "access_log_v": (
        "events",
        (
            "event_id",
            "ts AS created_at",
            "CASE event_type WHEN 'view' THEN 'query.run' WHEN 'click' THEN 'chat.generate' WHEN 'purchase' THEN 'query.multi' WHEN 'signup' THEN 'vectors.upsert' ELSE 'query.batch' END AS action",
            "CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS LONG) AS status_code",
            "coalesce(event_type <> 'error', false) AS success",
            "user_id AS actor_id",
            "value AS latency_ms",
            "CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method",
            "concat('/v1/', event_type, '/', CAST(user_id AS VARCHAR(20))) AS path",
        ),
    ),
    "collections_v": (
        "supplier",
        (
            "s_suppkey AS collection_id",
            "s_name AS name",
            "3 + s_suppkey % 5 AS default_top_k",
            "CASE s_suppkey % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'hybrid' ELSE 'semantic' END AS default_mode",
            "CAST(s_suppkey % 4 AS DOUBLE) / 10 AS default_min_score",
        ),
    ),
    "uploads_v": (
        "orders",
        (
            "o_orderkey AS item_id",
            "o_custkey % 50 AS session_id",
            "CAST(20 + o_custkey % 50 AS LONG) AS total_files",
            "o_custkey % 50 = 13 AS canceled",
            "CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'canceled' ELSE 'uploaded' END AS item_status",
            "o_orderkey % 11 <> 0 AS has_document",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_custkey % 50 > 40 AND o_orderkey % 7 = 1 THEN 'processing' WHEN o_custkey % 50 > 40 AND o_orderkey % 7 = 2 THEN 'pending' ELSE 'ready' END AS document_status",
            "o_orderdate AS updated_at",
        ),
    ),
    "jobs_v": (
        "events",
        (
            "event_id AS job_id",
            "user_id AS source_id",
            "CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'done' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'retrying' END WHEN 'signup' THEN 'running' ELSE 'dead' END AS status",
            "ts AS created_at",
            "user_id AS key",
            "event_id % 3 AS epoch",
        ),
    ),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view of that name over its table; unused columns are pruned from the scan."""
    source, columns = VIEWS[name]
    return read_table(spark, sf_dir, source).selectExpr(*columns)


def view_sql(*names: str) -> str:
    """The same views as common table expressions of DuckDB."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
