"""Queries of a retrieval service's catalogue, logs, lists, writes and context, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import query_terms
from tessera.operators import access, analytics, catalog, chunkers, context, ingest, retrieval, snapshots
from tessera.plans.chunk_sql import paragraph_sql, recursive_sql
from tessera.plans.registry import query
from tessera.sources import files
from tessera.sources.tables import AS_OF, read_table, read_view, view_sql


def _view(name: str):
    return lambda spark, sf_dir: read_view(spark, sf_dir, name)


documents, log, collections, uploads, jobs = map(_view, ("documents_v", "access_log_v", "collections_v", "uploads_v", "jobs_v"))

# --- predicates -------------------------------------------------------------


@query(f"{view_sql('collections_v')} SELECT collection_id, name FROM collections_v WHERE starts_with(lower(name), 'supplier#00000000')")
def collections_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections(spark, sf_dir).where(access.prefixed("name", "SUPPLIER#00000000")).select("collection_id", "name")


_ACTIONS = ("query.run", "query.multi", "query.batch", "chat.generate")
_DENIED = "action IN ('query.run', 'query.multi', 'query.batch', 'chat.generate') AND method = 'POST' AND status_code >= 500 AND status_code < 600 AND contains(lower(path), '/error')"


def _failed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(access.access_filter({"method": "post", "actor_id": None}, "/ERROR", "5xx", _ACTIONS))


@query(f"{view_sql('access_log_v')} SELECT event_id, path, action FROM access_log_v WHERE {_DENIED}")
def access_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed_posts(spark, sf_dir).select("event_id", "path", "action")


@query(f"{view_sql('access_log_v')} SELECT count(*) AS total FROM access_log_v WHERE {_DENIED}")
def access_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed_posts(spark, sf_dir).agg(F.count("*").alias("total"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def audit_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders")
    return rows.where(access.access_filter({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})).select("o_orderkey", "o_custkey")


@query(
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS LONG) AS k, coalesce(list_contains(json_keys(props), 'k'), false) AS has_k, coalesce(list_contains(json_keys(props), 'mcp'), false) AS has_mcp, "
    "coalesce(json_extract_string(concat('{\"mcp\":{\"server\":\"', event_type, '\"}}'), '$.mcp.server') = 'view', false) AS of_view FROM events"
)
def json_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.concat(F.lit('{"mcp":{"server":"'), "event_type", F.lit('"}}'))
    rows = read_table(spark, sf_dir, "events").withColumn("nested", nested)
    return rows.select(
        "event_id", access.json_text("props", "$.k").cast("long").alias("k"), access.json_has("props", "k").alias("has_k"), access.json_has("props", "mcp").alias("has_mcp"),
        F.coalesce(access.json_text("nested", "$.mcp.server") == "view", F.lit(False)).alias("of_view"),
    )


@query("SELECT doc_id, CASE WHEN source IS NULL OR source = '' THEN 'required' END AS error FROM documents WHERE lang = 'en'")
def tenant_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a tenant sees, as an administrator of all tenants would write them back."""
    seen = read_table(spark, sf_dir, "documents").where(access.tenant_visible("lang", "en"))
    return access.with_tenant(seen, "source", None, everyone=True).select("doc_id", "error")


@query(f"{view_sql('documents_v')} SELECT doc_id, filename FROM documents_v WHERE collection_id = 3")
def pinned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.pinned(documents(spark, sf_dir), "collection_id", 3).select("doc_id", "filename")


HOOKS = "VALUES (1, array('view', 'error'), null, true), (2, array('click', 'click'), array('c1', 'c2'), true), (3, array('view'), null, false), (4, array('error'), array('c0'), true)"


@query(
    "SELECT event_id, CAST(h.id AS LONG) AS hook_id FROM events e JOIN (VALUES (1, ['view', 'error'], NULL, true), (2, ['click', 'click'], ['c1', 'c2'], true), (3, ['view'], NULL, false), (4, ['error'], ['c0'], true)) h(id, ev, col, active) "
    "ON h.active AND list_contains(h.ev, e.event_type) AND (h.col IS NULL OR list_contains(h.col, concat('c', CAST(e.user_id % 4 AS VARCHAR))))"
)
def hook_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks = spark.sql(f"SELECT CAST(col1 AS LONG) AS hook_id, col2 AS events, col3 AS collections, col4 AS active FROM {HOOKS}")
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.expr("concat('c', user_id % 4)").alias("collection"))
    return access.hook_matches(events, hooks)


SCOPES = (("*:read",), ("collection:*", "document:write"), (), ("broken", ":x", "chat:"), ("query:run",))
_GRANTS = " ".join(f"WHEN {k} THEN [{', '.join(repr(s) for s in g)}]" for k, g in enumerate(SCOPES))


@query(
    f"WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'collection:read' WHEN 'click' THEN 'document:write' WHEN 'purchase' THEN 'query:run' ELSE 'chat:run' END AS req, CASE event_id % 5 {_GRANTS} END AS g FROM events) "
    "SELECT event_id, len(g) = 0 OR len(list_filter(g, lambda x: strpos(x, ':') > 1 AND strpos(x, ':') < length(x) AND split_part(x, ':', 1) IN ('*', split_part(req, ':', 1)) AND split_part(x, ':', 2) IN ('*', split_part(req, ':', 2)))) > 0 AS allowed FROM r"
)
def scopes_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = F.expr("CASE event_type WHEN 'view' THEN 'collection:read' WHEN 'click' THEN 'document:write' WHEN 'purchase' THEN 'query:run' ELSE 'chat:run' END")
    granted = F.coalesce(*[F.when(F.col("event_id") % 5 == k, F.array(*map(F.lit, g)).cast("array<string>")) for k, g in enumerate(SCOPES)])
    return read_table(spark, sf_dir, "events").select("event_id", access.scope_allows(granted, required).alias("allowed"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' OR (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 1")
def removable_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.keeps_one(read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM (SELECT max(source) FROM documents)")
def unseen_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose run isn't the last one; a missing run is another one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    # One row.
    last = docs.agg(F.max("source").alias("last"))
    return docs.crossJoin(F.broadcast(last)).where(~F.col("source").eqNullSafe(F.col("last"))).select("doc_id")


_CAUSE = "CASE event_id % 7 WHEN 0 THEN 'Connection timeout' WHEN 1 THEN 'HTTP 401' WHEN 2 THEN 'quota exceeded' WHEN 3 THEN 'Network down' WHEN 4 THEN 'invalid URL' WHEN 5 THEN 'broke' ELSE 'Unauthorized after timeout' END"
_MESSAGE = f"concat(coalesce(event_type, ''), ' failed: ', {_CAUSE}, ', api_key=', repeat('k', 45), ' and sk-abcdefgh', CAST(event_id AS VARCHAR(20)))"


@query(
    f"WITH m AS (SELECT event_id, {_MESSAGE} AS m FROM events), c AS (SELECT event_id, substr(regexp_replace(regexp_replace(m, 'sk-ant-[A-Za-z0-9_-]{{8,}}|sk-[A-Za-z0-9_-]{{8,}}|AIza[0-9A-Za-z_-]{{20,}}', '[REDACTED]', 'g'), '(?i)(api[_-]?key|authorization|bearer)([\"''\\s:=]+)([A-Za-z0-9_\\-]{{40,}})', '\\1\\2[REDACTED]', 'g'), 1, 500) AS message FROM m) "
    "SELECT event_id, message, CASE WHEN regexp_matches(lower(message), '401|unauthor') THEN 'auth_failed' WHEN regexp_matches(lower(message), '429|rate|quota') THEN 'rate_limited' WHEN regexp_matches(lower(message), 'timeout') THEN 'timeout' "
    "WHEN regexp_matches(lower(message), 'connection|network') THEN 'unreachable' WHEN regexp_matches(lower(message), 'invalid url') THEN 'misconfigured' ELSE 'unknown' END AS kind FROM c"
)
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.expr(_MESSAGE).alias("m"))
    return rows.select("event_id", access.scrubbed(F.col("m")).alias("message"), access.error_kind(F.col("m")).alias("kind"))


@query("SELECT event_id, concat('plain=', CASE WHEN length(props) > 6 THEN concat(substr(props, 1, 6), '...') ELSE props END, ' Token=[REDACTED] user=', CAST(user_id AS VARCHAR)) AS logged FROM events WHERE props IS NOT NULL AND user_id IS NOT NULL")
def logged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").where("props IS NOT NULL AND user_id IS NOT NULL")
    entries = F.create_map(F.lit("plain"), F.col("props"), F.lit("Token"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("more"), F.lit("x"))
    safe = access.redacted(entries, most=3, chars=6)
    return rows.select("event_id", F.array_join(F.transform(F.map_entries(safe), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("logged"))


SCHEMA = {"type": "object", "required": ["k", "lang"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "lang": {"enum": ["view", "click", "error"], "maxLength": 4}}}


@query(
    "WITH m AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS LONG) AS k, event_type AS t FROM events) "
    "SELECT event_id, CASE WHEN k IS NULL THEN 'k:required' WHEN event_id % 10 = 0 THEN 'lang:required' WHEN event_id % 10 = 1 THEN 'k:type' WHEN k < 10 THEN 'k:minimum' WHEN k > 90 THEN 'k:maximum' WHEN t NOT IN ('view', 'click', 'error') THEN 'lang:enum' WHEN length(t) > 4 THEN 'lang:maxLength' END AS error FROM m WHERE t IS NOT NULL"
)
def metadata_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.concat(F.lit('"k":'), F.when(F.col("event_id") % 10 == 1, F.concat(F.lit('"'), access.json_text("props", "$.k"), F.lit('"'))).otherwise(access.json_text("props", "$.k"))), F.lit('"j":1'))
    rows = read_table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    made = rows.select("event_id", F.concat(F.lit("{"), k, F.when(F.col("event_id") % 10 != 0, F.concat(F.lit(',"lang":"'), "event_type", F.lit('"'))).otherwise(""), F.lit("}")).alias("metadata"))
    return made.select("event_id", access.metadata_error("metadata", SCHEMA).alias("error"))


# --- reports ----------------------------------------------------------------


@query(
    f"{view_sql('access_log_v')}, a AS (SELECT action, count(*) AS n, CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS l FROM access_log_v GROUP BY 1) "
    "SELECT CAST(sum(n) AS LONG) AS queries, round(round(sum(n * l) / sum(n), 6), 2) AS avg_latency, round(sum(n) / 30, 2) AS per_day FROM a"
)
def weighted_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over groups of their rounded means, weighted by their counts."""
    groups = log(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), analytics.mean("latency_ms", 2).alias("l"))
    return groups.agg(F.sum("n").alias("queries"), F.round(F.round(F.sum(F.col("n") * F.col("l")) / F.sum("n"), 6), 2).alias("avg_latency"), F.round(F.sum("n") / 30, 2).alias("per_day"))


@query(
    f"{view_sql('documents_v', 'collections_v')} SELECT CASE WHEN grouping(name) = 1 THEN '(all)' ELSE name END AS name, count(doc_id) AS docs, CAST(coalesce(sum(file_size), 0) AS LONG) AS bytes, CAST(coalesce(sum(chunk_count), 0) AS LONG) AS chunks "
    "FROM collections_v c LEFT JOIN documents_v d ON c.collection_id = d.collection_id GROUP BY ROLLUP(name)"
)
def storage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collection's storage, and all of them, from one aggregation."""
    joined = collections(spark, sf_dir).select("collection_id", "name").join(documents(spark, sf_dir).select("collection_id", "doc_id", "file_size", "chunk_count"), "collection_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("file_size", "bytes"), ("chunk_count", "chunks"))]
    per = joined.rollup("name").agg(F.grouping("name").alias("g"), F.count("doc_id").alias("docs"), *sums)
    return per.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("name")).alias("name"), "docs", "bytes", "chunks")


@query(f"{view_sql('documents_v', 'collections_v')} SELECT c.collection_id, count(d.doc_id) AS document_count FROM collections_v c LEFT JOIN documents_v d ON c.collection_id = d.collection_id GROUP BY 1")
def recounted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.recounted(collections(spark, sf_dir).select("collection_id"), documents(spark, sf_dir), "collection_id", "document_count")


@query(
    f"{view_sql('access_log_v')} SELECT action, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM access_log_v GROUP BY action"
)
def latency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: values that occur."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)")
    return log(spark, sf_dir).groupBy("action").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(
    f"{view_sql('uploads_v')}, e AS (SELECT session_id, total_files, canceled, CASE WHEN item_status IN ('failed', 'canceled') THEN item_status WHEN NOT has_document AND document_status IS NULL THEN 'canceled' WHEN document_status = 'ready' THEN 'complete' WHEN document_status = 'failed' THEN 'failed' WHEN document_status = 'processing' THEN 'ingesting' ELSE 'queued' END AS s FROM uploads_v), "
    "n AS (SELECT session_id, max(total_files) AS t, bool_or(canceled) AS c, count(*) AS uploaded, " + ", ".join(f"count(*) FILTER (s = '{s}') AS n_{s}" for s in ("queued", "ingesting", "complete", "failed", "canceled")) + " FROM e GROUP BY 1) "
    "SELECT * EXCLUDE (t, c), CASE WHEN c THEN 'canceled' WHEN uploaded < t THEN 'uploading' WHEN n_queued + n_ingesting > 0 THEN 'ingesting' WHEN n_complete = 0 AND n_failed + n_canceled > 0 THEN 'failed' ELSE 'complete' END AS state FROM n"
)
def upload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = snapshots.effective_status(F.col("item_status"), F.col("has_document"), F.col("document_status"))
    return snapshots.session_summary(uploads(spark, sf_dir).withColumn("status", status))


@query(
    f"{view_sql('uploads_v')} SELECT item_id, CASE WHEN document_status IN ('pending', 'processing') THEN 0 WHEN document_status = 'failed' OR item_status IN ('failed', 'canceled') THEN 1 ELSE 2 END AS item_rank FROM uploads_v WHERE session_id = 7 ORDER BY item_rank, updated_at DESC, item_id LIMIT 20"
)
def upload_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's items: active ones first, failed ones next, the latest first."""
    rank = F.when(F.col("document_status").isin("pending", "processing"), 0).when((F.col("document_status") == "failed") | F.col("item_status").isin("failed", "canceled"), 1).otherwise(2)
    return uploads(spark, sf_dir).where("session_id = 7").withColumn("item_rank", rank).orderBy("item_rank", F.desc("updated_at"), "item_id").limit(20).select("item_id", "item_rank")


@query(
    f"{view_sql('jobs_v')}, s AS (SELECT source_id % 10 AS shard, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS processing, count(*) FILTER (status = 'retrying') AS retrying, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'running' AND created_at < {AS_OF} - INTERVAL 10 DAY) AS stale, source_id % 10 < 6 AS online FROM jobs_v WHERE source_id % 10 <> 9 OR status = 'done' GROUP BY ALL) "
    "SELECT shard, CASE WHEN NOT online AND pending + processing + retrying > 0 THEN 'down' WHEN NOT online OR dead > 0 OR stale > 0 OR retrying > 0 THEN 'degraded' ELSE 'ok' END AS status, "
    "array_to_string(list_filter([CASE WHEN NOT online AND pending + processing + retrying > 0 THEN 'worker_offline_with_active_queue' WHEN NOT online THEN 'worker_offline' END, CASE WHEN dead > 0 THEN 'dead_lettered_jobs' END, CASE WHEN stale > 0 THEN 'stale_processing_jobs' END, CASE WHEN retrying > 0 THEN 'retrying_jobs' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"
)
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    old = F.col("created_at") < F.expr(f"{AS_OF} - INTERVAL '10' DAY")
    stats = jobs(spark, sf_dir).where("source_id % 10 <> 9 OR status = 'done'").groupBy((F.col("source_id") % 10).alias("shard")).agg(
        n("pending").alias("pending"), n("running").alias("processing"), n("retrying").alias("retrying"), n("dead").alias("dead"), F.count_if((F.col("status") == "running") & old).alias("stale")
    )
    return snapshots.queue_health(stats.withColumn("online", F.col("shard") < 6)).select("shard", "status", "reasons")


# --- lists ------------------------------------------------------------------

SORTS = ("doc_id", "filename", "lang", "file_size", "token_count", "chunk_count")


def _pages_sql() -> str:
    one = "SELECT '{c}' AS by, '{d}' AS direction, doc_id FROM (SELECT doc_id FROM documents_v ORDER BY {c} {d} NULLS {n}, doc_id {d} LIMIT 6)"
    return " UNION ALL ".join(one.format(c=c, d=d, n="LAST" if d == "DESC" else "FIRST") for c in SORTS for d in ("ASC", "DESC"))


@query(f"{view_sql('documents_v')} {_pages_sql()}")
def documents_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page in each of the orders that the list offers."""
    docs, out = documents(spark, sf_dir).select(*SORTS), None
    for c in SORTS:
        for d in ("ASC", "DESC"):
            page = catalog.page(docs, c, "doc_id", 5, descending=d == "DESC").select(F.lit(c).alias("by"), F.lit(d).alias("direction"), "doc_id")
            out = page if out is None else out.unionByName(page)
    return out


@query("SELECT event_id, replace(replace(rtrim(to_base64(encode(concat('{\"created_at\":\"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END, '+00:00\",\"id\":\"', CAST(event_id AS VARCHAR), '\"}'))), '='), '+', '-'), '/', '_') AS cursor FROM events")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", catalog.cursor(F.col("ts"), F.col("event_id")).alias("cursor"))


@query(f"{view_sql('access_log_v')} SELECT event_id, action FROM access_log_v ORDER BY created_at DESC, event_id DESC LIMIT 12")
def recent_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("event_id")).limit(12).select("event_id", "action")


@query("SELECT collection_id AS source_id FROM (SELECT s_suppkey AS collection_id, s_acctbal, s_nationkey FROM supplier) WHERE s_acctbal <= 5000 AND s_nationkey % 5 <> 0 ORDER BY s_acctbal, source_id LIMIT 10")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_acctbal").alias("next_sync_at"), F.expr("CASE WHEN s_nationkey % 5 = 0 THEN 'syncing' ELSE 'idle' END").alias("status"))
    return snapshots.due(sources, F.lit(5000), 10).select("source_id")


# --- writes -----------------------------------------------------------------


@query("SELECT coalesce(n.event_type, o.event_type) AS event_type, user_id, CASE WHEN n.ts >= o.ts OR o.ts IS NULL THEN n.event_id ELSE o.event_id END AS event_id FROM (SELECT event_type, user_id, max(ts) AS ts, arg_max(event_id, {'ts': ts, 'e': event_id}) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) n FULL JOIN (SELECT event_type, user_id, max(ts) AS ts, arg_max(event_id, {'ts': ts, 'e': event_id}) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) o USING (event_type, user_id)")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table brought up to date by a batch; each side has one row a key."""
    events = read_table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id")
    one = lambda df: df.groupBy("event_type", "user_id").agg(F.max_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("x")).select("event_type", "user_id", "x.*")
    return snapshots.merge_latest(one(events.where("event_id % 3 <> 0")), one(events.where("event_id % 3 = 0")), ("event_type", "user_id"), "ts").select("event_type", "user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM (SELECT ts FROM events ORDER BY ts DESC LIMIT 100))")
def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the cut to the most recent rows."""
    return catalog.recent_cut(read_table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 100).select("event_id")


@query(f"SELECT event_id FROM events WHERE ts >= {AS_OF} - INTERVAL 14 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.kept_since(read_table(spark, sf_dir, "events"), "ts", AS_OF, 14).select("event_id")


_ASKED = "SELECT item_id * 7 AS doc_id FROM benchmark UNION ALL SELECT item_id * 7 FROM benchmark UNION ALL SELECT -1 - item_id FROM benchmark"


@query(f"SELECT a.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'deleted' END AS outcome FROM (SELECT DISTINCT doc_id FROM ({_ASKED})) a LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON a.doc_id = d.doc_id")
def delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(_ASKED.replace("benchmark", "{b}"), b=read_table(spark, sf_dir, "benchmark"))
    return snapshots.batch_delete(asked, read_table(spark, sf_dir, "documents"), "doc_id")[1]


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_ASKED}))")
def kept_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(_ASKED.replace("benchmark", "{b}"), b=read_table(spark, sf_dir, "benchmark"))
    return snapshots.batch_delete(asked, read_table(spark, sf_dir, "documents"), "doc_id")[0].select("doc_id")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN -label ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 77 FROM embeddings WHERE vec_id % 50 = 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = rows.where("id % 4 = 0").select("id", (-F.col("label")).alias("label")).unionByName(rows.where("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), F.lit(77).alias("label")))
    return catalog.upsert(rows, new, "id")


@query(
    "SELECT event_id, CASE WHEN event_id % 50 <> 0 AND event_type NOT IN ('error', 'signup') THEN 'delivered' WHEN event_id % 50 = 0 OR event_id % 4 + 1 > 3 THEN 'failed' ELSE 'pending' END AS state, "
    "CASE WHEN event_id % 50 <> 0 AND event_type IN ('error', 'signup') AND event_id % 4 + 1 <= 3 THEN CAST([10, 30, 90][event_id % 4 + 1] AS LONG) ELSE 0 END AS delay FROM events WHERE event_type IS NOT NULL"
)
def delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN NULL ELSE 200 END")
    made = snapshots.next_delivery(F.col("event_id") % 4 + 1, code, F.col("event_id") % 50 == 0)
    return read_table(spark, sf_dir, "events").where("event_type IS NOT NULL").select("event_id", made.alias("x")).select("event_id", "x.state", F.coalesce(F.col("x.delay"), F.lit(0)).cast("long").alias("delay"))


@query(
    f"{view_sql('jobs_v')} SELECT s.user_id AS source_id, j.job_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) s LEFT JOIN (SELECT source_id, arg_max(job_id, {{'t': created_at, 'j': job_id}}) AS job_id FROM jobs_v WHERE status IN ('pending', 'running') GROUP BY 1) j ON s.user_id = j.source_id"
)
def sync_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("source_id"))
    return snapshots.active_or_new(asked, jobs(spark, sf_dir))


@query(f"{view_sql('jobs_v')} SELECT job_id, coalesce(e.epoch, 0) <> j.epoch AS cancelled FROM jobs_v j LEFT JOIN (SELECT s_suppkey AS key, s_suppkey % 3 AS epoch FROM supplier) e ON j.key = e.key")
def cancelled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 3).alias("epoch"))
    return snapshots.current_jobs(jobs(spark, sf_dir), epochs).select("job_id", "cancelled")


@query(
    f"{view_sql('documents_v')}, e AS (SELECT event_id AS doc_id, 'embed' AS step, CASE event_type WHEN 'view' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, value / 50 AS progress FROM events WHERE event_id % 2 = 0 AND event_type IS NOT NULL) "
    "SELECT d.doc_id, CASE WHEN own THEN CASE status WHEN 'ready' THEN 'complete' WHEN 'failed' THEN 'failed' WHEN 'processing' THEN 'processing' ELSE 'queued' END ELSE step END AS step, "
    "CASE WHEN own THEN CASE status WHEN 'ready' THEN 1.0::DOUBLE WHEN 'processing' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, progress)) END AS progress "
    "FROM (SELECT d.doc_id, status, step, state, progress, state IS NULL OR (status IN ('ready', 'failed') AND state = 'running') AS own FROM documents_v d LEFT JOIN e ON d.doc_id = e.doc_id) d"
)
def document_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("CASE event_type WHEN 'view' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END")
    events = read_table(spark, sf_dir, "events").where("event_id % 2 = 0 AND event_type IS NOT NULL").select(F.col("event_id").alias("doc_id"), F.lit("embed").alias("step"), state.alias("state"), (F.col("value") / 50).alias("progress"))
    return snapshots.progress(documents(spark, sf_dir), events)


# --- chunks and elements ----------------------------------------------------


def _chunked(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    made = chunkers.chunk_documents(read_table(spark, sf_dir, "documents"), 512, 50, strategy)
    return made.withColumn("text_hash", F.sha2("text", 256)).drop("text")


def _chunk_oracle(sql: str) -> str:
    return f"SELECT concat(doc_id, '_', chunk_index) AS id, doc_id, chunk_index, char_start, char_end, sha256(text) AS text_hash FROM ({sql})"


@query(_chunk_oracle(paragraph_sql("SELECT doc_id, text FROM documents", 512, 50)))
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "paragraph")


@query(_chunk_oracle(recursive_sql("SELECT doc_id, text FROM documents", 512, 50)))
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "recursive")


#: The given texts are never blank: some are made so.
_BLANKED = "CASE doc_id % 50 WHEN 7 THEN concat(' ', chr(9), chr(10)) WHEN 8 THEN NULL WHEN 9 THEN '' ELSE text END AS text"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_BLANKED} FROM documents) WHERE text IS NULL OR NOT regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')")
def documents_without_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", _BLANKED)
    return chunkers.without_chunks(docs, chunkers.chunk_documents(docs, 512)).select("doc_id")


@query(
    "WITH " + "c AS (SELECT doc_id, unnest(range(0, length(text), 512)) AS f FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')) SELECT doc_id, CAST(f // 512 // 8 + 1 AS LONG) AS batch, count(*) AS chunks FROM c GROUP BY 1, 2"
)
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 chunks, as they would be embedded."""
    made = ingest.window_chunks(read_table(spark, sf_dir, "documents"), 512)
    return made.groupBy("doc_id", ingest.batch_number(F.col("chunk_index"), 8).alias("batch")).agg(F.count("*").alias("chunks"))


_LINES = "SELECT doc_id, replace(CASE doc_id % 4 WHEN 0 THEN concat('# ', text) WHEN 1 THEN concat('![ alt ](x.png) ', text) ELSE text END, chr(10), concat(chr(10), chr(10))) AS text FROM {d} WHERE text IS NOT NULL"
_ELEMENTS = (
    "WITH l AS (" + _LINES.format(d="documents") + "), b AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS raw, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS p FROM l), "
    "o AS (SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM b), "
    "s AS (SELECT doc_id, text, p, f + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS a, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS block FROM o), "
    "e AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS LONG) AS element_index, block, CAST(a AS LONG) AS char_start, CAST(a + length(block) AS LONG) AS char_end, "
    "CASE WHEN regexp_matches(block, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' WHEN starts_with(block, '#') THEN 'heading' WHEN regexp_matches(block, '^\\s*(\\$\\$|\\\\\\[|\\\\begin\\{equation\\})') OR (length(block) <= 500 AND regexp_matches(block, '[=^_]|\\\\(frac|sum|int|le|ge)') AND regexp_matches(block, '\\p{L}')) THEN 'equation' ELSE 'text' END AS kind FROM s WHERE block <> '') "
)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("{d}", "{docs}"), docs=read_table(spark, sf_dir, "documents"))
    return chunkers.block_elements(lines)


@query(_ELEMENTS + "SELECT doc_id, element_index, kind, char_start, char_end, sha256(block) AS text_hash FROM e")
def block_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken as blocks, some documents with a heading or an image in front."""
    return _elements(spark, sf_dir).select("doc_id", "element_index", "kind", "char_start", "char_end", F.sha2("text", 256).alias("text_hash"))


@query(
    _ELEMENTS + ", c AS (SELECT doc_id, CAST(f // 512 AS LONG) AS chunk_index, f AS c0, least(f + 512, n) AS c1 FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 512)) AS f FROM l WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]'))), "
    "t AS (SELECT c.doc_id, chunk_index, element_index, kind, row_number() OVER (PARTITION BY c.doc_id, chunk_index ORDER BY element_index) AS n FROM c JOIN e ON c.doc_id = e.doc_id AND char_start < c1 AND char_end > c0 WHERE kind <> 'text' QUALIFY n <= 8) "
    "SELECT doc_id, chunk_index, string_agg(DISTINCT kind, ',' ORDER BY kind) AS content_kinds, string_agg(CAST(element_index AS VARCHAR), ',' ORDER BY element_index) AS refs FROM t GROUP BY 1, 2"
)
def element_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("{d}", "{docs}"), docs=read_table(spark, sf_dir, "documents"))
    return chunkers.element_refs(chunkers.block_elements(lines), ingest.window_chunks(lines, 512))


@query(_ELEMENTS + "SELECT doc_id, element_index, kind FROM e WHERE doc_id = 8 ORDER BY element_index LIMIT 10 OFFSET 2")
def elements_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).where("doc_id = 8").orderBy("element_index").offset(2).limit(10).select("doc_id", "element_index", "kind")


@query("SELECT CAST(f // 512 AS LONG) AS chunk_index FROM (SELECT unnest(range(0, length(text), 512)) AS f FROM documents WHERE doc_id = 8) WHERE f // 512 >= 1 ORDER BY 1 LIMIT 5")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's chunks from an index on."""
    made = ingest.window_chunks(read_table(spark, sf_dir, "documents").where("doc_id = 8"), 512)
    return made.where("chunk_index >= 1").orderBy("chunk_index").limit(5).select("chunk_index")


_FILES = "SELECT page_id, concat('/in/', CAST(page_id AS VARCHAR(20)), CASE page_id % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.exe' WHEN 3 THEN '.json' WHEN 4 THEN '.png' ELSE '.html' END) AS path, CASE WHEN page_id % 6 = 1 AND page_id % 4 = 1 THEN concat('%PDF-', html) WHEN page_id % 24 = 6 THEN ' ' ELSE html END AS body FROM {p} WHERE html IS NOT NULL"


@query(
    "WITH f AS (" + _FILES.format(p="pages") + "), s AS (SELECT *, lower(regexp_extract(path, '\\.[^./]+$')) AS sfx FROM f) SELECT path, CAST(octet_length(encode(body)) AS LONG) AS size, sha256(body) AS content_hash, CASE WHEN sfx IN ('.txt', '.json') THEN 'plain' WHEN sfx = '.pdf' THEN 'pdf' ELSE 'rich' END AS route, "
    "CASE WHEN sfx = '.exe' THEN 'unsupported' WHEN sfx = '.png' OR (sfx = '.pdf' AND NOT starts_with(body, '%PDF-')) THEN 'content' WHEN sfx IN ('.txt', '.json') AND NOT regexp_matches(body, '\\S') THEN 'blank' END AS error FROM s"
)
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as if they were files of several types."""
    made = spark.sql(_FILES, p=read_table(spark, sf_dir, "pages")).select("path", F.col("body").cast("binary").alias("content"))
    return files.checked(made).drop("text")


# --- search and context -----------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("collection"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", "collection")


_NEAR = "near AS (SELECT q.vec_id AS query_id, q.label AS asked, d.vec_id AS id, CAST(d.label AS LONG) AS collection, round(greatest(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 0), 0), 9) AS s FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)"


@query(
    f"WITH {_NEAR}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY s DESC, id) AS r FROM near QUALIFY r <= 5) "
    "SELECT query_id, collection, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, collection, id) AS rank, round(s, 6) AS score FROM p WHERE s >= 0.1 QUALIFY rank <= 5"
)
def multi_collection_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's label is its collection."""
    return retrieval.multi_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir), 5, 0.1).withColumn("score", F.round("score", 6))


@query(
    f"{view_sql('collections_v')}, {_NEAR}, h AS (SELECT query_id, id, s, coalesce(CASE WHEN query_id % 40 = 0 THEN 2 END, c.default_top_k, 10) AS k, c.default_min_score AS m, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM near LEFT JOIN collections_v c ON c.collection_id = asked + 1 QUALIFY rank <= k) "
    "SELECT query_id, id, rank, round(s, 6) AS score FROM h WHERE m IS NULL OR s >= m"
)
def retrieve_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query doesn't say, its collection does; all are searched by vector here."""
    given = _asked(spark, sf_dir).select(
        "query_id", "vector", (F.col("collection") + 1).alias("collection_id"), F.when(F.col("query_id") % 40 == 0, F.lit(2).cast("long")).alias("top_k"), F.lit(None).cast("double").alias("min_score"),
        F.lit("semantic").alias("mode"), F.lit("").alias("query"),
    )
    filled = retrieval.with_defaults(given, collections(spark, sf_dir))
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.retrieve(filled, _vectors(spark, sf_dir), texts).withColumn("score", F.round("score", 6))


@query(f"WITH {_NEAR}, h AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM near QUALIFY rank <= 10) SELECT query_id, count(*) AS n_results, round(avg(round(s, 6)), 4) AS avg_score FROM h GROUP BY 1")
def query_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log keeps of each query: results and their mean score."""
    hits = retrieval.vector_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_results"), F.round(F.avg("score"), 4).alias("avg_score"))


@query(
    "WITH m AS (SELECT conv_id * 1000 + turn AS message_id, list_distinct_of AS x FROM (SELECT conv_id, turn, regexp_extract_all(concat(coalesce(text, ''), ' see ', CAST(turn AS VARCHAR), ' and ', CAST(conv_id AS VARCHAR), ' or ', CAST(turn AS VARCHAR)), '\\b\\d+\\b') AS list_distinct_of FROM conversations)), "
    "p AS (SELECT message_id, unnest(x) AS id, unnest(range(len(x))) AS place FROM m), f AS (SELECT message_id, id, min(place) AS place FROM p GROUP BY 1, 2), g AS (SELECT message_id, id, row_number() OVER (PARTITION BY message_id ORDER BY place) - 1 AS place FROM f) "
    "SELECT message_id, doc_id, CAST(place AS LONG) AS place FROM g JOIN documents d ON CAST(d.doc_id AS VARCHAR) = g.id"
)
def mentioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" see "), F.col("turn").cast("string"), F.lit(" and "), F.col("conv_id").cast("string"), F.lit(" or "), F.col("turn").cast("string"))
    messages = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), said.alias("text"))
    return context.mentioned(messages, read_table(spark, sf_dir, "documents").select("doc_id"))


@query(
    "WITH x AS (SELECT vec_id AS m, vec_id AS d, 0 AS g, 0 AS a FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT q.vec_id AS m, d.vec_id AS d, 1 AS g, min(d.vec_id - q.vec_id) AS a FROM embeddings q JOIN embeddings d ON d.vec_id BETWEEN q.vec_id AND q.vec_id + 4 WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id GROUP BY 1, 2), u AS (FROM x UNION ALL FROM r) "
    "SELECT m AS message_id, d AS doc_id, row_number() OVER (PARTITION BY m ORDER BY g, a, d) AS source_rank FROM u"
)
def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message names its own document and retrieves its neighbours, itself among them."""
    ids = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    asked = ids.where("id % 20 = 0")
    exact = asked.select(F.col("id").alias("message_id"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("place"))
    near = asked.select(F.col("id").alias("message_id"), F.explode(F.sequence("id", F.col("id") + 4)).alias("id")).join(ids, "id")
    return context.sources_in_order(exact, near.select("message_id", F.col("id").alias("doc_id"), (F.col("id") - F.col("message_id")).alias("rank")))


@query(
    "WITH RECURSIVE s AS (SELECT doc_id // 5 AS query_id, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS r, concat(' (document_id ', doc_id, ', filename doc_', doc_id, '.txt)') AS label, coalesce(text, '') AS text FROM documents), "
    "f AS (SELECT query_id, CAST(0 AS LONG) AS r, CAST(3000 AS LONG) AS remaining, true AS open, '' AS ctx FROM (SELECT DISTINCT query_id FROM s) "
    "UNION ALL SELECT f.query_id, s.r, CASE WHEN f.open AND room > 0 THEN remaining - length(head) - least(length(s.text), room) ELSE remaining END, f.open AND room > 0, CASE WHEN f.open AND room > 0 THEN concat(ctx, CASE WHEN s.r > 1 THEN concat(chr(10), chr(10), '---', chr(10), chr(10)) ELSE '' END, head, substr(s.text, 1, room)) ELSE ctx END "
    "FROM f JOIN (SELECT *, concat('[', r, ']', label, ' ') AS head FROM s) s ON s.query_id = f.query_id AND s.r = f.r + 1, LATERAL (SELECT remaining - length(head) - 16 AS room)) "
    "SELECT query_id, sha256(arg_max(ctx, r)) AS context_hash, length(arg_max(ctx, r)) AS chars FROM f GROUP BY 1"
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents that follow each other are one query's sources."""
    docs = read_table(spark, sf_dir, "documents").select(F.expr("doc_id div 5").alias("query_id"), F.col("doc_id").alias("rank"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = context.label(F.col("doc_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit(None), F.lit(None))
    made = context.context_blocks(docs.withColumn("label", named).withColumn("extra", F.lit("")), 3000)
    return made.select("query_id", F.sha2("context", 256).alias("context_hash"), F.length("context").cast("long").alias("chars"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_.:-]*'), lambda x: length(x) >= 2)) AS n_terms FROM documents")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(query_terms(F.col("text"))).cast("long").alias("n_terms"))
