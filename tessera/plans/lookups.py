"""Queries that find rows for requests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import context, lookups
from tessera.plans.registry import query
from tessera.sources.tables import AS_OF, read_table, read_view, view_sql

_VIEWS = view_sql("documents_v", "collections_v")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "documents_v")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "collections_v")


_REQUESTS = "o_orderkey AS request_id, o_custkey * 3 AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('Supplier#00000000', CAST(o_custkey % 10 AS VARCHAR(20))) END AS pin"


@query(
    f"{_VIEWS}, r AS (SELECT {_REQUESTS} FROM orders), f AS (SELECT r.*, c.name, d.status, c.name IS NOT NULL AND (pin IS NULL OR pin = c.name) AS seen FROM r LEFT JOIN (documents_v d JOIN collections_v c ON c.collection_id = d.collection_id) ON d.doc_id = r.doc_id) "
    "SELECT request_id, doc_id, CASE WHEN seen THEN name END AS collection_name, CASE WHEN seen THEN status END AS status, CASE WHEN NOT seen THEN 'not found' END AS error FROM f"
)
def requested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's document with its collection, if it exists in the pinned one."""
    requests = read_table(spark, sf_dir, "orders").selectExpr(*_REQUESTS.split(", ", 2))
    return lookups.requested_documents(requests, documents(spark, sf_dir), collections(spark, sf_dir))


_ASKED = ("o_custkey AS batch_id", "o_custkey % 10 + 1 AS collection_id", "o_orderkey % 600 AS doc_id")


@query(
    f"{_VIEWS}, a AS (SELECT {', '.join(_ASKED)} FROM orders), n AS (SELECT batch_id, count(*) > 12 AS large FROM a GROUP BY batch_id) "
    "SELECT DISTINCT a.batch_id, a.doc_id, status, CAST(NULL AS VARCHAR) AS error FROM a JOIN n ON n.batch_id = a.batch_id AND NOT large JOIN documents_v d ON d.doc_id = a.doc_id AND d.collection_id = a.collection_id AND lang = 'en' "
    "UNION ALL SELECT batch_id, NULL, NULL, 'too many' FROM n WHERE large"
)
def batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each batch that its tenant sees; batches are refused above 12 ids, as those given are small."""
    return lookups.batch_documents(read_table(spark, sf_dir, "orders").selectExpr(*_ASKED), documents(spark, sf_dir), F.col("lang") == "en", most=12)


_LOGGED = (
    "event_id",
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE concat('Supplier#00000000', CAST(event_id % 13 AS VARCHAR(20))) END AS collection_name",
    "CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS collection_id",
)


@query(f"{_VIEWS}, l AS (SELECT {', '.join(_LOGGED)} FROM events) SELECT event_id, l.collection_name, coalesce(l.collection_id, c.collection_id, -1) AS collection_id FROM l LEFT JOIN collections_v c ON c.name = l.collection_name")
def resolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log row with its collection's id, -1 where the name isn't known."""
    return lookups.resolve_collections(read_table(spark, sf_dir, "events").selectExpr(*_LOGGED), collections(spark, sf_dir)).fillna(-1, ["collection_id"])


_PLACE = "CASE doc_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN concat('{\"multimodal_elements\":[{\"element_index\":', CAST(doc_id % 3 AS VARCHAR(20)), '},{\"element_index\":\"x\"},7,{\"element_index\":0}]}') WHEN 2 THEN '{\"multimodal_elements\":3}' ELSE '{\"multimodal_elements\":[{\"element_index\":9},{\"element_index\":1}]}' END AS meta"
_ELEMENTS = "SELECT page_id AS document_id, CAST(i AS LONG) AS element_index, CASE WHEN i = 1 THEN 'image' ELSE 'table' END AS kind, concat('c', CAST(page_id AS VARCHAR(20))) AS caption, concat(url, '#', CAST(i AS VARCHAR(20))) AS text FROM {}"


@query(
    f"WITH e AS ({_ELEMENTS.format('pages, (SELECT unnest([0, 1, 2]) AS i)')}), "
    "r AS (SELECT doc_id AS hit_id, doc_id % 60 AS document_id, unnest(CASE doc_id % 4 WHEN 1 THEN [doc_id % 3, 0] WHEN 3 THEN [9, 1] ELSE [] END) AS element_index, generate_subscripts(CASE doc_id % 4 WHEN 1 THEN [doc_id % 3, 0] WHEN 3 THEN [9, 1] ELSE [] END, 1) AS place FROM documents), "
    "f AS (SELECT hit_id, string_agg(concat(e.element_index, ':', kind, ':', caption, ':', text), ' ' ORDER BY place) AS elements FROM r JOIN e USING (document_id, element_index) GROUP BY hit_id) "
    "SELECT doc_id AS hit_id, coalesce(elements, '') AS elements FROM documents LEFT JOIN f ON hit_id = doc_id"
)
def hydrated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that hits refer to; some references are malformed or lead nowhere."""
    hits = read_table(spark, sf_dir, "documents").selectExpr("doc_id AS hit_id", "doc_id % 60 AS document_id", _PLACE).withColumn("metadata", F.parse_json("meta"))
    elements = spark.sql(_ELEMENTS.format("{pages} LATERAL VIEW explode(array(0, 1, 2)) AS i").replace("VARCHAR(20)", "STRING"), pages=read_table(spark, sf_dir, "pages"))
    shown = F.transform("elements", lambda e: F.concat(e["element_index"].cast("string"), F.lit(":"), e["kind"], F.lit(":"), e["caption"], F.lit(":"), e["text"]))
    return lookups.hydrate_elements(hits, elements).select("hit_id", F.array_join(shown, " ").alias("elements"))


_DELIVERIES = ("event_id AS delivery_id", "user_id AS hook_id", "CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'delivered' END AS status", "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN event_id % 4 ELSE 0 END AS attempts", "CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 5 DAY END AS next_retry_at", "ts AS created_at")
_HOOKS = ("c_custkey AS hook_id", "concat('https://', c_name) AS url")


@query(
    f"WITH d AS (SELECT {', '.join(_DELIVERIES)} FROM events), h AS (SELECT {', '.join(_HOOKS)} FROM customer) SELECT delivery_id, d.hook_id, url, coalesce(attempts, 0) + 1 AS attempt FROM d JOIN h ON h.hook_id = d.hook_id "
    f"WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF}) ORDER BY created_at, delivery_id LIMIT 25"
)
def due_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 deliveries that one worker takes."""
    return lookups.due_deliveries(read_table(spark, sf_dir, "events").selectExpr(*_DELIVERIES), read_table(spark, sf_dir, "customer").selectExpr(*_HOOKS), F.expr(AS_OF), 25)


_SOURCES = ("c_custkey AS source_id", "CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS collection_name")


@query(
    f"{view_sql('jobs_v')}, s AS (SELECT {', '.join(_SOURCES)} FROM customer) SELECT job_id, source_id, status, count(*) OVER () AS total FROM jobs_v JOIN s USING (source_id) WHERE CASE WHEN job_id % 2 = 0 THEN 's3' ELSE 'r2' END = 's3' AND collection_name = 'a' ORDER BY created_at DESC, job_id DESC LIMIT 50"
)
def provider_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50 sync jobs of a provider's sources in one collection, and how many there are."""
    jobs = read_view(spark, sf_dir, "jobs_v").withColumn("provider", F.expr("CASE WHEN job_id % 2 = 0 THEN 's3' ELSE 'r2' END"))
    found = lookups.provider_jobs(jobs, read_table(spark, sf_dir, "customer").selectExpr(*_SOURCES), "s3", "a")
    latest = found.orderBy(F.desc("created_at"), F.desc("job_id")).limit(50)
    return latest.join(found.groupBy("provider").agg(F.count("*").alias("total")), "provider").select("job_id", "source_id", "status", "total")


_RUNS = ("doc_id", "CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN chunk_count - 1 ELSE chunk_count END AS inserted", "chunk_count AS expected", "file_size AS chars", "doc_id % 2 = 0 AS last")


@query(
    f"{_VIEWS}, r AS (SELECT {', '.join(_RUNS)} FROM documents_v WHERE doc_id % 3 <> 1), j AS (SELECT d.*, r.inserted, r.expected, r.chars, coalesce(status = 'processing' AND inserted > 0, false) AS done, coalesce(status = 'processing' AND inserted = 0 AND last, false) AS lost FROM documents_v d LEFT JOIN r ON r.doc_id = d.doc_id) "
    "SELECT doc_id, CASE WHEN done THEN inserted ELSE chunk_count END AS chunk_count, CASE WHEN done THEN CAST(floor(chars / 4) AS BIGINT) ELSE token_count END AS token_count, CASE WHEN done AND inserted < expected THEN concat('Partial: ', inserted, '/', expected, ' chunks embedded') "
    "WHEN lost THEN concat('All ', expected, ' chunk batches failed embedding/insert') END AS error_message, done OR lost AS changed, CASE WHEN done THEN 'ready' WHEN lost THEN 'failed' ELSE status END AS status FROM j"
)
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after runs of which some put in nothing or too little."""
    docs = documents(spark, sf_dir)
    runs = docs.where("doc_id % 3 <> 1").selectExpr(*_RUNS)
    return lookups.job_outcomes(docs.select("doc_id", "status", "chunk_count", "token_count"), runs)


_DOCUMENT_META = "CASE doc_id % 4 WHEN 0 THEN concat('{\"document_metadata\":{\"n\":', CAST(doc_id AS VARCHAR(20)), ',\"lang\":\"é\"}}') WHEN 3 THEN '{\"document_metadata\":{}}' ELSE '{\"b\":[1,2.5,null],\"a\":true}' END AS meta"
_SHOWN = "chr(10), chr(10), 'Retrieved elements:', chr(10), '- table', CASE WHEN coalesce(text, '') = '' THEN '' ELSE concat(': ', substr(text, 1, 600)) END, chr(10), '- image: c', doc_id, chr(10), '- image: short', chr(10), '- equation', chr(10), '- table: last'"


@query(
    "SELECT doc_id, sha256(concat(CASE doc_id % 4 WHEN 0 THEN concat(chr(10), 'Document metadata: {\"lang\": \"', chr(92), 'u00e9\", \"n\": ', doc_id, '}') WHEN 1 THEN concat(chr(10), 'Document metadata: {\"a\": true, \"b\": [1, 2.5, null]}') ELSE '' END, "
    f"CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat({_SHOWN}) END)) AS extra_hash FROM documents"
)
def source_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sources show beside their text: metadata and the first five of six elements."""
    element = lambda kind, summary=None, caption=None, text=None: F.struct(F.lit(kind).alias("kind"), *(c.cast("string").alias(n) for n, c in (("summary", F.lit(summary)), ("caption", caption if caption is not None else F.lit(None)), ("text", text if text is not None else F.lit(None)))))
    six = F.array(element("table", "", F.lit(""), F.col("text")), element("image", None, F.concat(F.lit("c"), F.col("doc_id")), F.col("text")), element("image", "short", F.lit("c")), element("equation"), element("table", None, None, F.lit("last")), element("table", "too many"))
    rows = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "text", _DOCUMENT_META).withColumn("elements", F.when(F.col("doc_id") % 3 == 0, F.slice(six, 1, 0)).otherwise(six))
    chunk = F.when(F.col("doc_id") % 4 != 1, F.lit(3))
    return rows.select("doc_id", F.sha2(F.concat(context.metadata_extra(F.parse_json("meta"), chunk), context.elements_extra(F.col("elements"))), 256).alias("extra_hash"))
