"""The registered queries: each operator over the whole stand-in tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.filters import compile_filter
from tessera.functions.text import needs_keywords, query_terms
from tessera.operators import analytics, catalog, ingest, keyword_index, retrieval, sync, vector_index
from tessera.plans.registry import ORACLES, QUERIES, query
from tessera.sources.scratch import scratch_folder
from tessera.sources.tables import AS_OF, read_table, read_view, view_sql
from tessera.streaming.timelines import daily_counts

K = 10


# --- search by vector -------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def near_sql(where: str = "true", k: int = K) -> str:
    return (
        "near AS (SELECT q.vec_id AS query_id, d.vec_id AS id, d.label, "
        "round(greatest(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 0), 0), 9) AS s "
        f"FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND {where}), "
        "hits AS (SELECT query_id, id, label, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank "
        f"FROM near QUALIFY rank <= {k}) "
    )


def _six(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


@query("WITH " + near_sql() + "SELECT query_id, id, rank, score FROM hits")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(retrieval.vector_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), K))


@query("WITH " + near_sql() + "SELECT query_id, id, rank, score FROM hits")
def semantic_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, built over all vectors and searched exactly."""
    path = scratch_folder(spark, "vectors")
    vector_index.build_index(vectors(spark, sf_dir), path)
    return _six(vector_index.search_index(spark, path, vector_queries(spark, sf_dir), K))


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def semantic_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search of the index, tuned on other queries, finds 9 of 10 of the exact hits."""
    path = scratch_folder(spark, "vectors")
    vector_index.build_index(vectors(spark, sf_dir), path)
    others = vectors(spark, sf_dir).where("id % 20 = 10").select(F.col("id").alias("query_id"), "vector")
    probes = vector_index.probes_for(spark, path, others, K)
    found = vector_index.search_index(spark, path, vector_queries(spark, sf_dir), K, probes)
    share = vector_index.recall(found, retrieval.vector_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), K))
    return share.agg(F.count("*").alias("n_queries"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("reached"))


#: Name: (filters, the same in SQL).
FILTERED = {
    "semantic_filtered_eq": ({"label": 3}, "d.label = 3"),
    "semantic_filtered_ne": ({"label": {"$ne": 3}}, "d.label IS DISTINCT FROM 3"),
    "semantic_filtered_range": ({"label": {"$gte": 2, "$lt": 5}}, "d.label >= 2 AND d.label < 5"),
    "semantic_filtered_in": ({"label": {"$in": [1, 4, 7]}}, "d.label IN (1, 4, 7)"),
}


def _filtered(name: str) -> None:
    filters, where = FILTERED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir).where(compile_filter(filters))
        return _six(retrieval.vector_topk(vector_queries(spark, sf_dir), rows, K))

    run.__name__ = name
    query("WITH " + near_sql(where) + "SELECT query_id, id, rank, score FROM hits")(run)


for _name in FILTERED:
    _filtered(_name)


@query("WITH " + near_sql() + "SELECT query_id, id, rank, score FROM hits WHERE score >= 0.5")
def semantic_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.above(semantic_topk(spark, sf_dir), 0.5)


@query(
    "WITH " + near_sql() + "SELECT query_id, id, rank, score, CASE WHEN d.doc_id IS NOT NULL THEN concat('doc_', d.doc_id, '.txt') END AS filename FROM hits h LEFT JOIN documents d ON d.doc_id = h.id"
)
def filename_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_names(semantic_topk(spark, sf_dir), read_view(spark, sf_dir, "documents_v"))


@query(
    "WITH "
    + near_sql()
    + ", cases AS (SELECT q.vec_id AS query_id, q.label, c.n - 1 AS n_rel FROM embeddings q JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c USING (label) WHERE q.vec_id % 20 = 0), "
    "judged AS (SELECT h.*, h.label = c.label AND h.id <> h.query_id AS rel, n_rel FROM hits h JOIN cases c USING (query_id)) "
    "SELECT query_id, round(count(DISTINCT id) FILTER (rel) / any_value(n_rel), 4) AS recall, coalesce(round(1 / min(rank) FILTER (rel), 4), 0) AS reciprocal_rank, "
    "round(sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(any_value(n_rel), count(*)) + 1)]), 4) AS ndcg FROM judged GROUP BY query_id"
)
def eval_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is a vector; what has its label is relevant."""
    rows = vectors(spark, sf_dir)
    sizes = rows.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    cases = rows.where("id % 20 = 0").join(sizes, "label").select(F.col("id").alias("query_id"), "label", "n_relevant")
    hits = retrieval.vector_topk(cases.join(vector_queries(spark, sf_dir), "query_id"), rows, K)
    judged = hits.join(rows.select("id", F.col("label").alias("hit_label")), "id").join(cases, "query_id")
    return retrieval.evaluate(judged.withColumn("relevant", (F.col("hit_label") == F.col("label")) & (F.col("id") != F.col("query_id"))), cases)


@query(
    f"SELECT count(*) AS n_cases, {', '.join(f'coalesce(round(round(avg({c}), 9), 4), 0) AS avg_{c}' for c in ('recall', 'reciprocal_rank', 'ndcg'))} FROM ({ORACLES['eval_per_case']})"
)
def eval_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.averages(eval_per_case(spark, sf_dir))


# --- search by keyword ------------------------------------------------------


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def bm25_sql(k: int) -> str:
    return (
        "tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), "
        "stat AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tok), "
        "post AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY id, term), "
        "df AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
        "qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0), "
        "bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 9) AS s FROM qt JOIN df USING (term) JOIN post USING (term), stat GROUP BY query_id, id), "
        f"pool AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS br FROM bm QUALIFY br <= {k})"
    )


def keyword_sql(k: int) -> str:
    return (
        bm25_sql(k) + ", qterms AS (SELECT item_id AS query_id, len(l) AS n, unnest(l) AS term FROM (SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_.:-]*'), lambda x: length(x) >= 2) AS l FROM benchmark WHERE item_id % 20 = 0)), "
        "kw AS (SELECT p.query_id, p.id, p.br, round(count(*) FILTER (regexp_matches(lower(d.text), concat('(^|[^\\p{L}\\p{N}_])', replace(term, '.', '\\.'), CASE WHEN regexp_matches(term, '[.:-]$') THEN '[\\p{L}\\p{N}_]' ELSE '($|[^\\p{L}\\p{N}_])' END))) / any_value(q.n), 4) AS score "
        "FROM pool p JOIN documents d ON d.doc_id = p.id JOIN qterms q ON q.query_id = p.query_id GROUP BY p.query_id, p.id, p.br), "
        f"kwr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, br) AS rank FROM kw WHERE score > 0 QUALIFY rank <= {k})"
    )


@query("WITH " + bm25_sql(K) + " SELECT query_id, id, br AS rank, round(s, 6) AS score FROM pool")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(retrieval.bm25_topk(text_queries(spark, sf_dir), texts(spark, sf_dir), K))


@query("WITH " + bm25_sql(K) + " SELECT query_id, id, br AS rank, round(s, 6) AS score FROM pool")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored keyword index, built over all documents and then searched."""
    path = scratch_folder(spark, "keywords")
    keyword_index.build_keyword_index(texts(spark, sf_dir), path)
    return _six(keyword_index.search_keyword_index(spark, path, text_queries(spark, sf_dir), K))


@query("WITH " + keyword_sql(K) + " SELECT query_id, id, rank, score FROM kwr")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_topk(text_queries(spark, sf_dir), texts(spark, sf_dir), K)


@query(
    "WITH " + near_sql("q.vec_id IN (SELECT item_id FROM benchmark)", 50) + ", " + keyword_sql(50) + ", both_ AS (SELECT query_id, id, rank AS r1, NULL AS r2 FROM hits UNION ALL SELECT query_id, id, NULL, rank FROM kwr), "
    "f AS (SELECT query_id, id, min(r1) AS r1, min(r2) AS r2 FROM both_ GROUP BY query_id, id), g AS (SELECT *, round(coalesce(1 / (60 + r1), 0.0::DOUBLE) + coalesce(1 / (60 + r2), 0.0::DOUBLE), 12) AS raw FROM f) "
    "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank, round(raw * 61 / 2, 6) AS score FROM g QUALIFY rank <= 10"
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and texts are of one id; a query is a benchmark item with the vector of its id."""
    asked = text_queries(spark, sf_dir).join(vector_queries(spark, sf_dir), "query_id", "left")
    return retrieval.hybrid_topk(asked, vectors(spark, sf_dir), texts(spark, sf_dir), K)


@query(
    "WITH " + near_sql("q.vec_id IN (SELECT item_id FROM benchmark)", 35) + ", " + keyword_sql(35) + ", asks AS (SELECT item_id AS item, m, item_id * 3 + m AS query_id, 3 + m * 2 AS k FROM benchmark, range(3) r(m) WHERE item_id % 20 = 0), "
    "sem AS (SELECT a.query_id, id, rank, score FROM asks a JOIN hits h ON h.query_id = item WHERE m = 0 AND rank <= k), "
    "key AS (SELECT a.query_id, id, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, br) AS rank, score FROM asks a JOIN kw ON kw.query_id = item WHERE m = 1 AND br <= k AND score > 0), "
    "both_ AS (SELECT a.query_id, k, id, rank AS r1, NULL AS r2 FROM asks a JOIN hits h ON h.query_id = item WHERE m = 2 AND rank <= 5 * k "
    "UNION ALL SELECT a.query_id, k, id, NULL, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, br) FROM asks a JOIN kw ON kw.query_id = item WHERE m = 2 AND br <= 5 * k AND score > 0), "
    "f AS (SELECT query_id, k, id, min(r1) AS r1, min(r2) AS r2 FROM both_ GROUP BY query_id, k, id), g AS (SELECT *, round(coalesce(1 / (60 + r1), 0.0::DOUBLE) + coalesce(1 / (60 + r2), 0.0::DOUBLE), 12) AS raw FROM f), "
    "hyb AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank, round(raw * 61 / 2, 6) AS score FROM g QUALIFY rank <= k) "
    "SELECT * FROM sem UNION ALL SELECT * FROM key UNION ALL SELECT * FROM hyb"
)
def retrieve_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query by vector, by keyword and by both, each with its own top_k."""
    asked = text_queries(spark, sf_dir).join(vector_queries(spark, sf_dir), "query_id", "left")
    modes = F.posexplode(F.array(F.lit("semantic"), F.lit("keyword"), F.lit("hybrid"))).alias("m", "mode")
    each = asked.select("query_id", "query", "vector", modes).select((F.col("query_id") * 3 + F.col("m")).alias("query_id"), "query", "vector", "mode", (3 + F.col("m") * 2).cast("long").alias("top_k"), F.lit(None).cast("double").alias("min_score"))
    return _six(retrieval.retrieve(each, vectors(spark, sf_dir), texts(spark, sf_dir)))


@query("SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_.:-]*'), lambda x: length(x) >= 2), ' ') AS terms FROM conversations")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(query_terms(F.col("text")), " ").alias("terms"))


@query(
    "SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_.:-]*'), lambda x: regexp_full_match(x, '[a-z0-9][a-z0-9_-]{11,}') AND regexp_matches(x, '[0-9]'))) > 0 THEN 'hybrid' ELSE 'semantic' END AS mode FROM conversations"
)
def mode_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(needs_keywords(F.col("text")), "hybrid").otherwise("semantic")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", mode.alias("mode"))


# --- reports ----------------------------------------------------------------

COUNTS = "count(*) AS docs, CAST(coalesce(sum(chunk_count), 0) AS LONG) AS chunks, CAST(coalesce(sum(token_count), 0) AS LONG) AS tokens, CAST(coalesce(sum(file_size), 0) AS LONG) AS bytes, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in analytics.STATES
)


@query(f"{view_sql('documents_v')} SELECT collection, {COUNTS} FROM documents_v GROUP BY collection")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.catalogue_counts(read_view(spark, sf_dir, "documents_v"), "collection")


@query(f"{view_sql('documents_v')} SELECT {COUNTS} FROM documents_v")
def platform_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.catalogue_counts(read_view(spark, sf_dir, "documents_v"))


@query(
    f"{view_sql('documents_v', 'query_log_v')}, d AS (SELECT lang, count(*) AS docs, CAST(sum(file_size) AS LONG) AS bytes, CAST(sum(token_count) AS LONG) AS tokens FROM documents_v GROUP BY lang), "
    "q AS (SELECT CASE collection_name WHEN 'view' THEN 'en' WHEN 'click' THEN 'fr' END AS lang, count(*) AS queries, CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS avg_latency FROM query_log_v GROUP BY 1) "
    "SELECT d.lang, docs, bytes, tokens, round(tokens / 1e6 * 0.02, 4) AS cost, coalesce(queries, 0) AS queries, coalesce(avg_latency, 0) AS avg_latency FROM d LEFT JOIN q ON d.lang = q.lang"
)
def usage_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_view(spark, sf_dir, "query_log_v").withColumn("asked", F.expr("CASE collection_name WHEN 'view' THEN 'en' WHEN 'click' THEN 'fr' END"))
    return analytics.usage(read_view(spark, sf_dir, "documents_v"), log, "lang", "asked", 0.02)


PERIODS = " UNION ALL ".join(
    f"SELECT CAST({d} AS LONG) AS days, count(*) AS queries, coalesce(CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE), 0) AS avg_latency, coalesce(CAST(round(CAST(avg(avg_score) AS DECIMAL(28, 6)), 4) AS DOUBLE), 0) AS avg_score, coalesce(CAST(round(CAST(avg(result_count) AS DECIMAL(28, 6)), 1) AS DOUBLE), 0) AS avg_results FROM query_log_v WHERE created_at > {AS_OF} - INTERVAL {d} DAY HAVING count(*) > 0"
    for d in (1, 7, 30)
)


@query(f"{view_sql('query_log_v')} {PERIODS}")
def period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.period_stats(read_view(spark, sf_dir, "query_log_v"), AS_OF)


@query(f"{view_sql('query_log_v')} SELECT coalesce(query, 'unknown') AS name, count(*) AS events, CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS avg_latency FROM query_log_v WHERE created_at > {AS_OF} - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_values(analytics.since(read_view(spark, sf_dir, "query_log_v"), AS_OF, 7), "query", 10)


@query(f"{view_sql('access_log_v')} SELECT coalesce(action, 'unknown') AS name, count(*) AS events, CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS avg_latency FROM access_log_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def access_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_values(read_view(spark, sf_dir, "access_log_v"), "action", 8)


@query(
    f"{view_sql('access_log_v')} SELECT count(*) AS events, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS errors, coalesce(round(count(*) FILTER (success) / nullif(count(*), 0) * 100, 2), 0) AS success_rate, "
    "CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS avg_latency, round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency, count(DISTINCT actor_id) AS actors, count(*) FILTER (action LIKE 'query.%') AS queries FROM access_log_v"
)
def access_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.access_summary(read_view(spark, sf_dir, "access_log_v"))


def _timeline(unit: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analytics.timeline(read_view(spark, sf_dir, "access_log_v"), unit)

    run.__name__ = f"access_timeline_{unit}"
    query(
        f"{view_sql('access_log_v')} SELECT strftime(date_trunc('{unit}', created_at), '%Y-%m-%d %H:%M') AS at, count(*) AS events, count(*) FILTER (NOT success) AS errors, CAST(round(CAST(avg(latency_ms) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS avg_latency FROM access_log_v GROUP BY 1"
    )(run)


for _unit in ("hour", "day"):
    _timeline(_unit)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate over the table as it stands; tests run it as a stream too."""
    return daily_counts(read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("SELECT user_id, last.event_id AS event_id, last.event_type AS event_type FROM (SELECT user_id, arg_max({'event_id': event_id, 'event_type': event_type}, {'ts': ts, 'e': event_id}) AS last FROM events GROUP BY user_id)")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


# --- catalogue --------------------------------------------------------------


@query(f"{view_sql('documents_v')} SELECT doc_id, filename, file_size FROM documents_v ORDER BY file_size DESC, doc_id DESC LIMIT 21")
def documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(read_view(spark, sf_dir, "documents_v").select("doc_id", "filename", "file_size"), "file_size", "doc_id", 20)


@query(f"{view_sql('documents_v')} SELECT doc_id, filename, file_size FROM documents_v WHERE file_size < 500 OR (file_size = 500 AND doc_id < 100) ORDER BY file_size DESC, doc_id DESC LIMIT 21")
def documents_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(read_view(spark, sf_dir, "documents_v").select("doc_id", "filename", "file_size"), "file_size", "doc_id", 20, after=(500, 100))


@query(f"{view_sql('documents_v')} SELECT doc_id, filename, collection FROM documents_v WHERE contains(lower(filename), 'doc_1') OR contains(lower(collection), '.org')")
def documents_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "documents_v").where(catalog.contains("DOC_1", "filename") | catalog.contains(".ORG", "collection")).select("doc_id", "filename", "collection")


@query("SELECT doc_id, sha256(text) AS content_hash, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY source, text) END AS first_id, first_id <> doc_id AS deduped FROM documents WHERE source IS NOT NULL")
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.content_duplicates(read_table(spark, sf_dir, "documents").where("source IS NOT NULL"), "source")


# --- ingest and sync --------------------------------------------------------

CHUNKS = (
    "c AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 512)) AS f FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')), "
    "o AS (SELECT *, substr(text, greatest(f - 50, 0) + 1, least(f, 50)) AS tail FROM c), p AS (SELECT *, CASE WHEN contains(tail, ' ') THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END AS cut FROM o)"
)


@query(
    "WITH " + CHUNKS + " SELECT concat(doc_id, '_', CAST(f // 512 AS LONG)) AS id, doc_id, CAST(f // 512 AS LONG) AS chunk_index, sha256(concat(cut, substr(text, f + 1, 512))) AS text_hash, CAST(f - length(cut) AS LONG) AS char_start, CAST(least(f + 512, n) AS LONG) AS char_end FROM p"
)
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.window_chunks(read_table(spark, sf_dir, "documents"), 512, 50).withColumn("text_hash", F.sha2("text", 256)).drop("text")


@query("SELECT doc_id, sha256(substr(coalesce(text, ''), 1, 2000)) AS text_hash, length(coalesce(text, '')) > 2000 AS truncated FROM documents")
def token_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's feature is the cut at a model's limit, here 500 tokens."""
    return ingest.truncated(read_table(spark, sf_dir, "documents"), 500).select("doc_id", F.sha2("text", 256).alias("text_hash"), "truncated")


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read_table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("content_hash"))
    return ingest.cache_misses(read_table(spark, sf_dir, "documents"), cache)


@query(
    "WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN embedding[1:10] WHEN vec_id % 13 = 0 THEN list_transform(embedding, lambda x: CAST('nan' AS FLOAT)) ELSE embedding END AS vector, repeat('x', CAST(vec_id AS INT)) AS text FROM embeddings) "
    "SELECT id, CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> 64 THEN 'dimension' WHEN NOT list_bool_and([coalesce(isfinite(x), false) FOR x IN vector]) THEN 'not finite' ELSE 'text' END AS reason FROM v "
    "WHERE vector IS NULL OR len(vector) <> 64 OR NOT list_bool_and([coalesce(isfinite(x), false) FOR x IN vector]) OR length(text) > 400"
)
def vector_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some were spoilt, and texts of which some are too long."""
    bad = F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN slice(vector, 1, 10) WHEN id % 13 = 0 THEN transform(vector, x -> CAST('NaN' AS FLOAT)) ELSE vector END")
    return ingest.bad_vectors(vectors(spark, sf_dir).select("id", bad.alias("vector"), F.expr("repeat('x', CAST(id AS INT))").alias("text")), 64, max_chars=400)


#: A manifest, and a listing that lost some files, changed some and has some new.
REMOTE = {
    "manifest": "SELECT doc_id AS remote_id, concat('v', CAST(doc_id AS VARCHAR(20))) AS signature, {h}(text{w}) AS content_hash, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'ready' END AS status FROM {d}",
    "listing": "SELECT doc_id AS remote_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'w' ELSE 'v' END, CAST(doc_id AS VARCHAR(20))) AS signature, CASE WHEN doc_id % 15 = 0 THEN 'changed' ELSE {h}(text{w}) END AS content_hash FROM {d} WHERE doc_id % 7 <> 0"
    " UNION ALL SELECT doc_id + 1000000000, 'v', {h}(text{w}) FROM {d} WHERE doc_id % 11 = 0",
}
SYNC_SQL = (
    "WITH "
    + ", ".join(f"{k} AS ({v.format(h='sha256', w='', d='documents')})" for k, v in REMOTE.items())
    + ", diff AS (SELECT coalesce(m.remote_id, l.remote_id) AS remote_id, CASE WHEN l.remote_id IS NULL THEN 'deleted' WHEN m.remote_id IS NULL THEN 'created' "
    "WHEN m.status <> 'failed' AND (m.signature = l.signature OR m.content_hash = l.content_hash) THEN 'skipped' ELSE 'updated' END AS state FROM manifest m FULL JOIN listing l ON m.remote_id = l.remote_id) "
)


@query(SYNC_SQL + "SELECT remote_id, state FROM diff")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest, listing = (spark.sql(v.format(h="sha2", w=", 256", d="{docs}"), docs=docs) for v in REMOTE.values())
    return sync.sync_diff(manifest, listing)


@query(
    SYNC_SQL + "SELECT count(*) FILTER (state <> 'deleted') AS found, count(*) FILTER (state = 'created') AS created, count(*) FILTER (state = 'updated') AS updated, count(*) FILTER (state = 'skipped') AS skipped, "
    "count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state <> 'created') >= 10 AND count(*) FILTER (state = 'deleted') * 100 > count(*) FILTER (state <> 'created') * 50 AS guarded FROM diff"
)
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_counters(sync_diff(spark, sf_dir))


# The other queries register themselves.
from tessera.plans import archives, chunks, embedding, lookups, metadata, pages, service, streams  # noqa: E402, F401
