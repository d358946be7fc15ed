"""Joins that find rows for requests: documents by id, elements of hits, collections of log rows, due deliveries, jobs of a provider.

Sides that grow with the data are shuffled on their keys; which of them is small enough to send around is left to the
optimizer, which knows their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.metadata import ELEMENTS, metadata_field

#: Most documents of one batch, most elements that one run enriches, kinds that are enriched.
MAX_BATCH, MAX_ENRICHED = 100, 25
ENRICHED_KINDS = ("image", "table", "equation")


def requested_documents(requests: DataFrame, documents: DataFrame, collections: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, pin) with collection_name, status and ``error``: ``not found`` for unknown documents and those outside the pin.

    documents: doc_id, collection_id, status; collections: collection_id, name. A null pin
    is no pin. Every request has one row.
    """
    held = documents.select("doc_id", "collection_id", "status").join(collections.select("collection_id", F.col("name").alias("collection_name")), "collection_id").drop("collection_id")
    seen = F.col("collection_name").isNotNull() & (F.col("pin").isNull() | (F.col("pin") == F.col("collection_name")))
    found = requests.select("request_id", "doc_id", "pin").join(held, "doc_id", "left")
    return found.select("request_id", "doc_id", *(F.when(seen, F.col(c)).alias(c) for c in ("collection_name", "status")), F.when(~F.coalesce(seen, F.lit(False)), "not found").alias("error"))


def batch_documents(asked: DataFrame, documents: DataFrame, visible: Column | None = None, most: int = MAX_BATCH) -> DataFrame:
    """Rows (batch_id, doc_id, status, error) of the documents that batches (batch_id, collection_id, doc_id) ask for in their collection.

    A document asked for twice comes once; those of other collections and those that aren't ``visible`` are left
    out. A batch that names more than ``most`` ids, repeats included, is one row with an error. Ids of a batch are counted by its key before anything is joined.
    """
    sizes = asked.groupBy("batch_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select("batch_id")
    kept = asked.join(large, "batch_id", "left_anti").select("batch_id", "collection_id", "doc_id").distinct()
    rows = documents if visible is None else documents.where(visible)
    found = kept.join(rows.select("collection_id", "doc_id", "status"), ["collection_id", "doc_id"]).select("batch_id", "doc_id", "status", F.lit(None).cast("string").alias("error"))
    return found.unionByName(large.withColumn("error", F.lit("too many")), allowMissingColumns=True)


def resolve_collections(log: DataFrame, collections: DataFrame) -> DataFrame:
    """Log rows (collection_name, collection_id, ...) whose missing collection_id is filled by name; unknown names stay null.

    Rows that have an id or no name take no part in the join, so that they make no hot key.
    """
    open_rows = F.col("collection_id").isNull() & F.coalesce(F.col("collection_name") != "", F.lit(False))
    ids = collections.groupBy(F.col("name").alias("collection_name")).agg(F.min("collection_id").alias("_id"))
    filled = log.where(open_rows).join(ids, "collection_name", "left").withColumn("collection_id", F.col("_id")).drop("_id")
    return filled.select(*log.columns).unionByName(log.where(~open_rows))


def hydrate_elements(hits: DataFrame, elements: DataFrame) -> DataFrame:
    """hits (hit_id, document_id, metadata VARIANT) with ``elements``: those that the metadata refers to, in its order, as structs.

    elements: document_id, element_index, kind, caption, text. References without a whole number and those to
    no element are left out; a reference made twice counts twice. Hits without any have an empty array.
    """
    listed = F.try_variant_get(metadata_field(F.col("metadata"), ELEMENTS), "$", "array<variant>")
    refs = hits.select("hit_id", "document_id", F.posexplode(listed).alias("place", "ref"))
    refs = refs.withColumn("element_index", F.try_variant_get("ref", "$.element_index", "long")).where("element_index IS NOT NULL AND document_id IS NOT NULL").drop("ref")
    shown = F.struct("place", "element_index", "kind", "caption", "text")
    found = refs.join(elements.select("document_id", "element_index", "kind", "caption", "text"), ["document_id", "element_index"])
    lists = found.groupBy("hit_id").agg(F.array_sort(F.collect_list(shown)).alias("elements"))
    return hits.join(lists, "hit_id", "left").withColumn("elements", F.coalesce(F.transform("elements", lambda e: e.dropFields("place")), F.array().cast("array<struct<element_index: bigint, kind: string, caption: string, text: string>>")))


def due_deliveries(deliveries: DataFrame, hooks: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest pending deliveries that may be tried now, with their hook's url and the number of this attempt. Deliveries of hooks that are gone are left out."""
    ready = deliveries.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    rows = ready.join(hooks.select("hook_id", "url"), "hook_id").withColumn("attempt", F.coalesce("attempts", F.lit(0)) + 1)
    return rows.orderBy("created_at", "delivery_id").limit(limit).select("delivery_id", "hook_id", "url", "attempt")


def provider_jobs(jobs: DataFrame, sources: DataFrame, provider: str, collection: str | None = None, source: int | None = None) -> DataFrame:
    """A provider's jobs whose source still exists, with its collection, of one collection or one source if given."""
    held = sources.select("source_id", "collection_name")
    if collection is not None:
        held = held.where(F.col("collection_name") == collection)
    if source is not None:
        held = held.where(F.col("source_id") == source)
    return jobs.where(F.col("provider") == provider).join(held, "source_id")


def elements_to_enrich(elements: DataFrame, most: int = MAX_ENRICHED) -> DataFrame:
    """The first ``most`` pending images, tables and equations of each document."""
    pending = elements.where(F.col("kind").isin(*ENRICHED_KINDS) & (F.col("enrichment_status") == "pending"))
    return pending.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("element_index"))).where(F.col("place") <= most)


def job_outcomes(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents (doc_id, status, chunk_count, token_count, ...) after runs (doc_id, inserted, expected, chars, last), with ``changed`` and error_message.

    A run that put in chunks makes a document that is still in processing ready, with a message if some are missing. One that
    put in nothing fails it if it was the last attempt, and leaves it to the next otherwise. Documents that a cancellation or another run took meanwhile stay as they are.
    """
    rows = documents.withColumn("error_message", F.lit(None).cast("string")) if "error_message" not in documents.columns else documents
    joined = rows.join(runs.select("doc_id", "inserted", "expected", "chars", "last"), "doc_id", "left")
    done = F.coalesce((F.col("status") == "processing") & (F.col("inserted") > 0), F.lit(False))
    partial = F.when(F.col("inserted") < F.col("expected"), F.format_string("Partial: %d/%d chunks embedded", "inserted", "expected"))
    nothing = F.format_string("All %d chunk batches failed embedding/insert", "expected")
    failed = F.coalesce((F.col("inserted") == 0) & F.col("last") & (F.col("status") == "processing"), F.lit(False))
    new = {
        "chunk_count": F.when(done, F.col("inserted")).otherwise(F.col("chunk_count")),
        "token_count": F.when(done, F.floor(F.col("chars") / 4).cast("long")).otherwise(F.col("token_count")),
        "error_message": F.when(done, partial).when(failed, nothing).otherwise(F.col("error_message")),
        "changed": done | failed,
        "status": F.when(done, "ready").when(failed, "failed").otherwise(F.col("status")),
    }
    return joined.select(*(c for c in rows.columns if c not in new), *(v.alias(n) for n, v in new.items()))
