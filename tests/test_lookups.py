"""Rows for requests: nulls, unknown ids, repeats and empty sides."""

from pyspark.sql import functions as F

from tessera.operators import context, lookups


def test_requests_outside_the_pin_find_nothing(spark):
    docs = spark.createDataFrame([(1, 10, "ready"), (2, 20, None), (3, 99, "ready")], "doc_id long, collection_id long, status string")
    names = spark.createDataFrame([(10, "a"), (20, "b")], "collection_id long, name string")
    asked = spark.createDataFrame([(1, 1, None), (2, 1, "a"), (3, 1, "b"), (4, 2, None), (5, 3, None), (6, None, None), (7, 8, "a")], "request_id long, doc_id long, pin string")
    found = {r.request_id: (r.collection_name, r.status, r.error) for r in lookups.requested_documents(asked, docs, names).collect()}
    gone = (None, None, "not found")
    assert found == {1: ("a", "ready", None), 2: ("a", "ready", None), 3: gone, 4: ("b", None, None), 5: gone, 6: gone, 7: gone}


def test_batches_are_refused_whole(spark):
    docs = spark.createDataFrame([(k, k % 2, "ready", "t" if k < 5 else None) for k in range(8)], "doc_id long, collection_id long, status string, tenant string")
    asked = spark.createDataFrame([(1, 0, k) for k in (0, 0, 1, 2, 6)] + [(2, 1, k) for k in (1, 3, 5, 7, 1, 1)], "batch_id long, collection_id long, doc_id long")
    rows = lambda *a: sorted((r.batch_id, r.doc_id, r.error) for r in lookups.batch_documents(asked, docs, *a).collect())
    assert rows(F.col("tenant") == "t") == [(1, 0, None), (1, 2, None), (2, 1, None), (2, 3, None)]
    assert rows(None, 5) == [(1, 0, None), (1, 2, None), (1, 6, None), (2, None, "too many")]


def test_log_rows_keep_ids_and_columns(spark):
    log = spark.createDataFrame([("a", None, 1), ("a", 7, 2), (None, None, 3), ("", None, 4), ("z", None, 5)], "collection_name string, collection_id long, event_id long")
    names = spark.createDataFrame([(10, "a"), (9, "a")], "collection_id long, name string")
    found = lookups.resolve_collections(log, names)
    assert found.columns == log.columns
    assert {r.event_id: r.collection_id for r in found.collect()} == {1: 9, 2: 7, 3: None, 4: None, 5: None}


def test_elements_come_in_the_order_of_their_references(spark):
    hits = spark.createDataFrame([(1, 5, '{"multimodal_elements":[{"element_index":2},{"element_index":0},{"element_index":2},{"element_index":8},{"element_index":"q"},null,4]}'), (2, None, '{"multimodal_elements":[{"element_index":0}]}'), (3, 5, "[1]"), (4, 5, None)], "hit_id long, document_id long, meta string")
    elements = spark.createDataFrame([(5, 0, "image", None, "i"), (5, 2, "table", "c", None)], "document_id long, element_index long, kind string, caption string, text string")
    found = lookups.hydrate_elements(hits.withColumn("metadata", F.parse_json("meta")), elements)
    assert {r.hit_id: [e.element_index for e in r.elements] for r in found.collect()} == {1: [2, 0, 2], 2: [], 3: [], 4: []}
    assert lookups.hydrate_elements(hits.limit(0).withColumn("metadata", F.parse_json("meta")), elements).count() == 0


def test_deliveries_jobs_and_elements_to_enrich(spark):
    tried = spark.createDataFrame([(1, 1, "pending", None, None, 3), (2, 1, "pending", 2, 50, 1), (3, 1, "pending", 0, 51, 0), (4, 9, "pending", 0, None, 0), (5, 1, "failed", 0, None, 0)], "delivery_id long, hook_id long, status string, attempts long, next_retry_at long, created_at long")
    hooks = spark.createDataFrame([(1, "u")], "hook_id long, url string")
    assert [tuple(r) for r in lookups.due_deliveries(tried, hooks, F.lit(50), 5).collect()] == [(2, 1, "u", 3), (1, 1, "u", 1)]
    jobs = spark.createDataFrame([(1, 1, "s3"), (2, 2, "s3"), (3, 1, "r2"), (4, 8, "s3")], "job_id long, source_id long, provider string")
    sources = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, collection_name string")
    ids = lambda *a: sorted(r.job_id for r in lookups.provider_jobs(jobs, sources, *a).collect())
    assert ids("s3") == [1, 2] and ids("s3", "a") == [1] and ids("s3", None, 2) == [2] and ids("s3", "a", 2) == []
    elements = spark.createDataFrame([(1, k, "image" if k % 2 else "text", "ready" if k == 3 else "pending") for k in range(80)], "doc_id long, element_index long, kind string, enrichment_status string")
    assert sorted(r.element_index for r in lookups.elements_to_enrich(elements).collect()) == [k for k in range(80) if k % 2 and k != 3][:25]


def test_outcomes_leave_documents_that_others_took(spark):
    docs = spark.createDataFrame([(k, s, 1, 1) for k, s in enumerate(["processing", "processing", "processing", "processing", "ready", "processing"])], "doc_id long, status string, chunk_count long, token_count long")
    runs = spark.createDataFrame([(0, 3, 3, 42, True), (1, 2, 3, 42, True), (2, 0, 3, 42, True), (3, 0, 3, 42, False), (4, 3, 3, 42, True)], "doc_id long, inserted long, expected long, chars long, last boolean")
    found = {r.doc_id: (r.status, r.chunk_count, r.token_count, r.error_message, r.changed) for r in lookups.job_outcomes(docs, runs).collect()}
    assert found == {
        0: ("ready", 3, 10, None, True), 1: ("ready", 2, 10, "Partial: 2/3 chunks embedded", True), 2: ("failed", 1, 1, "All 3 chunk batches failed embedding/insert", True),
        3: ("processing", 1, 1, None, False), 4: ("ready", 1, 1, None, False), 5: ("processing", 1, 1, None, False),
    }


def test_what_sources_show_of_odd_metadata_and_elements(spark):
    rows = spark.createDataFrame([(1, '{"document_metadata":null,"z":1}', None), (2, '{"document_metadata":[1]}', None), (3, "[1]", None), (4, None, None), (5, '{"a":"' + "x" * 3000 + '"}', None), (6, '{"a":1}', 0)], "k long, meta string, chunk_index long")
    shown = {r.k: r.e for r in rows.select("k", context.metadata_extra(F.parse_json("meta"), F.col("chunk_index")).alias("e")).collect()}
    assert shown[1] == '\nDocument metadata: {"document_metadata": null, "z": 1}' and shown[2] == shown[3] == shown[4] == shown[6] == ""
    assert len(shown[5]) == len("\nDocument metadata: ") + 1600
    elements = spark.createDataFrame([(1, [("image", None, "", None)]), (2, []), (3, None)], "k long, elements array<struct<kind string, summary string, caption string, text string>>")
    assert {r.k: r.e for r in elements.select("k", context.elements_extra(F.col("elements")).alias("e")).collect()} == {1: "\n\nRetrieved elements:\n- image", 2: "", 3: ""}
