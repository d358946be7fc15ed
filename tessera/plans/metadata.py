"""Queries over metadata as VARIANT: filters, containment, stored attributes, payloads and hits; their SQL reads the same as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metadata as meta
from tessera.operators import retrieval
from tessera.plans.queries import K, near_sql, vector_queries, vectors
from tessera.plans.registry import query
from tessera.sources.tables import read_view, view_sql

_SQL = view_sql("document_meta_v").replace("SELECT doc_id, concat(", "SELECT doc_id, CAST(concat(").replace(" AS meta", " AS JSON) AS meta")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "document_meta_v").withColumn("metadata", F.parse_json("meta"))


#: Column: (filters, the same in DuckDB's SQL).
FILTERS = {
    "equal_text": ({"lang": "en"}, "meta->>'$.lang' = 'en'"),
    "equal_number": ({"mark": 7}, "json_type(meta, '$.mark') = 'UBIGINT' AND meta->>'$.mark' = '7'"),
    "equal_digits": ({"mark": "7"}, "json_type(meta, '$.mark') = 'VARCHAR' AND meta->>'$.mark' = '7'"),
    "equal_true": ({"mark": True}, "json_type(meta, '$.mark') = 'BOOLEAN' AND meta->>'$.mark' = 'true'"),
    "unequal": ({"tenant": {"$ne": "t1"}}, "meta->>'$.tenant' IS DISTINCT FROM 't1'"),
    "ranged": ({"n": {"$gte": 300, "$lt": 2000.5}}, "CAST(meta->>'$.n' AS BIGINT) >= 300 AND CAST(meta->>'$.n' AS BIGINT) < 2000.5"),
    "ranged_mixed": ({"mark": {"$gt": 0}}, "json_type(meta, '$.mark') = 'UBIGINT' AND TRY_CAST(meta->>'$.mark' AS DOUBLE) > 0"),
    "one_of": ({"mark": {"$in": ["7", True]}, "lang": {"$ne": "de"}}, "json_type(meta, '$.mark') IN ('VARCHAR', 'BOOLEAN') AND meta->>'$.lang' <> 'de'"),
    "none_of": ({"lang": {"$in": []}}, "false"),
    "by_id": ({"id": {"$gte": 20}, "tenant": "t1"}, "doc_id >= 20 AND meta->>'$.tenant' = 't1'"),
}


@query(f"{_SQL} SELECT doc_id, {', '.join(f'coalesce({sql}, false) AS {name}' for name, (_, sql) in FILTERS.items())} FROM document_meta_v")
def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which filters each document passes; ``id`` stands for the document's own id."""
    docs, own = documents(spark, sf_dir), {"id": F.col("doc_id")}
    return docs.select("doc_id", *(meta.metadata_filter(f, F.col("metadata"), own).alias(name) for name, (f, _) in FILTERS.items()))


#: Column: (what is to be held, the same in DuckDB's SQL).
HELD = {
    "of_tenant": ({"tenant": "t1"}, "meta->>'$.tenant' = 't1'"),
    "on_page": ({"place": {"page": 2}}, "CAST(meta->>'$.place.page' AS BIGINT) = 2"),
    "with_box": ({"place": {"boxes": [2.5]}, "page_no": 12}, "len(list_filter(CAST(meta->'$.place.boxes' AS DOUBLE[]), lambda x: x = 2.5)) > 0 AND meta->>'$.page_no' = '12'"),
    "in_list": ({"mark": [{"tenant": "t1"}, 7]}, "json_type(meta, '$.mark') = 'ARRAY' AND meta->>'$.mark[1].tenant' = 't1' AND meta->>'$.mark[0]' = '7'"),
    "null_mark": ({"mark": None}, "json_type(meta, '$.mark') = 'NULL'"),
    "empty": ({}, "json_type(meta) = 'OBJECT'"),
    "list_is_no_object": ({"multimodal_elements": {}}, "json_type(meta, '$.multimodal_elements') = 'OBJECT'"),
}


@query(f"{_SQL} SELECT doc_id, {', '.join(f'coalesce({sql}, false) AS {name}' for name, (_, sql) in HELD.items())} FROM document_meta_v")
def metadata_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *(meta.contains(F.col("metadata"), wanted).alias(name) for name, (wanted, _) in HELD.items()))


@query("WITH " + near_sql("d.label IN (1, 4, 7) AND d.vec_id >= 10") + "SELECT query_id, id, rank, score FROM hits")
def semantic_metadata_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among the rows whose metadata passes a filter."""
    rows = vectors(spark, sf_dir).withColumn("metadata", F.parse_json(F.to_json(F.struct("label"))))
    kept = rows.where(meta.metadata_filter({"label": {"$in": [1, 4, 7]}, "id": {"$gte": 10}}, F.col("metadata"), {"id": F.col("id")}))
    return retrieval.vector_topk(vector_queries(spark, sf_dir), kept, K).withColumn("score", F.round("score", 6))


_TYPE, _VALUE = "json_type(meta, concat('$.', name))", "json_extract(meta, concat('$.', name))"


@query(
    f"{_SQL} SELECT doc_id, name, CASE {_TYPE} WHEN 'OBJECT' THEN concat('{meta.NESTED}', '{{\"boxes\":', meta->'$.place.boxes', ',\"page\":', meta->'$.place.page', '}}') "
    f"WHEN 'ARRAY' THEN concat('{meta.NESTED}', {_VALUE}) ELSE json_extract_string(meta, concat('$.', name)) END AS value, true AS restored "
    f"FROM (SELECT doc_id, meta, unnest(json_keys(meta)) AS name FROM document_meta_v) WHERE {_TYPE} <> 'NULL'"
)
def stored_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute as a store keeps it, and whether reading it back gives the metadata without nulls."""
    docs = documents(spark, sf_dir).withColumn("attributes", meta.encode_attributes(F.col("metadata")))
    back = meta.decode_attributes(F.col("attributes"))
    docs = docs.withColumn("restored", F.to_json(back) == F.regexp_replace(F.to_json("metadata"), r'"mark":null,', ""))
    return docs.select("doc_id", "restored", F.explode("attributes").alias("name", "v")).select("doc_id", "name", F.expr("CAST(v AS STRING)").alias("value"), "restored")


_PAYLOAD = "concat('{\"document_id\":\"d', CAST(doc_id AS VARCHAR(20)), '\",\"chunk_index\":', CAST(doc_id % 9 AS VARCHAR(20)), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(',\"text\":\"t\",\"id\":\"c', CAST(doc_id AS VARCHAR(20)), '\"') END, ',', substr(CAST(meta AS VARCHAR), 2))"


@query(
    f"{_SQL}, p AS (SELECT doc_id, CAST({_PAYLOAD} AS JSON) AS p FROM document_meta_v) SELECT coalesce(p->>'$.id', CAST(doc_id AS VARCHAR)) AS id, p->>'$.document_id' AS document_id, CAST(p->>'$.chunk_index' AS BIGINT) AS chunk_index, "
    "coalesce(p->>'$.text', '') AS text, CAST(p->>'$.page_no' AS BIGINT) AS page_no, CAST(p->>'$.char_start' AS BIGINT) AS char_start, p->>'$.document_filename' AS document_filename, CAST(p->'$.multimodal_elements' AS VARCHAR) AS multimodal_elements, "
    "array_to_string(list_sort(list_filter(json_keys(p), lambda x: x NOT IN ('id', 'document_id', 'chunk_index', 'text') AND json_type(p, concat('$.', x)) <> 'NULL')), ',') AS fields, "
    "array_to_string(list_sort(list_filter(json_keys(p), lambda x: x NOT IN ('id', 'document_id', 'chunk_index', 'text', 'multimodal_elements') AND json_type(p, concat('$.', x)) <> 'NULL')), ',') AS plain_fields FROM p"
)
def shaped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a store as hits, with elements and, for their names of metadata, without."""
    points = documents(spark, sf_dir).select(F.col("doc_id").alias("point_id"), F.parse_json(F.expr(_PAYLOAD.replace("VARCHAR)", "STRING)"))).alias("payload"))
    hits = meta.split_payload(points)
    names = lambda c: F.array_join(F.array_sort(F.map_keys(F.try_variant_get(c, "$", "map<string, variant>"))), ",")
    full = meta.shape_hits(hits, with_elements=True).withColumn("fields", names(F.col("metadata")))
    return meta.shape_hits(full).select("id", "document_id", "chunk_index", "text", "page_no", "char_start", "document_filename", "multimodal_elements", "fields", names(F.col("metadata")).alias("plain_fields"))
