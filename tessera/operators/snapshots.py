"""New snapshots of tables: keyed merges, deletes with a report, purges, and the next states of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delays of a delivery's next attempts in seconds.
RETRY_DELAYS = (10, 30, 90)


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row for each key, the latest of both tables; rows as late as an old one replace it."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(F.col(at), F.col("_new"))).alias("last")
    return both.groupBy(*keys).agg(last).select(*keys, "last.*").select(old.columns)


def touched(cache: DataFrame, hits: DataFrame, keys: Sequence[str], now: Column, after: str = "1 hour") -> DataFrame:
    """A cache whose hit rows are dated now, if their last date is older than that long."""
    used = hits.select(*keys).distinct().withColumn("_hit", F.lit(True))
    stale = F.col("_hit").isNotNull() & (F.col("last_hit_at") < now - F.expr(f"INTERVAL {after}"))
    return cache.join(used, list(keys), "left").withColumn("last_hit_at", F.when(stale, now).otherwise(F.col("last_hit_at"))).drop("_hit")


def kept_since(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return rows.where(F.col(at) >= F.expr(f"{now} - INTERVAL '{days}' DAY"))


def batch_delete(requested: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, report): rows without the requested keys, and for each distinct requested key whether it was deleted or missing."""
    asked = requested.select(key).where(F.col(key).isNotNull()).distinct()
    found = rows.select(key).distinct().withColumn("_found", F.lit(True))
    report = asked.join(found, key, "left").select(key, F.when(F.col("_found"), "deleted").otherwise("missing").alias("outcome"))
    return rows.join(asked, key, "left_anti"), report


def recounted(groups: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """groups with the column set to the number of their rows, 0 for none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return groups.drop(column).join(counts, key, "left").withColumn(column, F.coalesce("_n", F.lit(0))).drop("_n")


def next_delivery(attempt: Column, status_code: Column, blocked: Column, delays: Sequence[int] = RETRY_DELAYS) -> Column:
    """State of a delivery after an attempt: delivered, failed, or pending with the delay in seconds."""
    delivered = F.coalesce(status_code.between(200, 299), F.lit(False)) & ~blocked
    last = blocked | (attempt > len(delays))
    delay = F.try_element_at(F.array(*map(F.lit, delays)), attempt.cast("int"))
    return F.struct(F.when(delivered, "delivered").when(last, "failed").otherwise("pending").alias("state"), F.when(~delivered & ~last, delay).alias("delay"))


def due(sources: DataFrame, now: Column, limit: int) -> DataFrame:
    """The longest due sources that aren't syncing."""
    return sources.where((F.col("next_sync_at") <= now) & (F.col("status") != "syncing")).orderBy("next_sync_at", "source_id").limit(limit)


def active_or_new(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each requested source its newest pending or running job, or null where a new one is to be made."""
    newest = jobs.where(F.col("status").isin("pending", "running")).groupBy("source_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
    return requests.select("source_id").distinct().join(newest, "source_id", "left")


def current_jobs(jobs: DataFrame, epochs: DataFrame) -> DataFrame:
    """Jobs with ``cancelled``: whether their key's epoch has moved on since."""
    now = epochs.select("key", F.col("epoch").alias("_epoch"))
    return jobs.join(now, "key", "left").withColumn("cancelled", F.coalesce(F.col("_epoch"), F.lit(0)) != F.col("epoch")).drop("_epoch")


def effective_status(item: Column, has_document: Column, document: Column) -> Column:
    """State of an uploaded item from its own and its document's."""
    of_document = F.when(document == "ready", "complete").when(document == "failed", "failed").when(document == "processing", "ingesting").otherwise("queued")
    return F.when(item.isin("failed", "canceled"), item).when(~has_document & document.isNull(), "canceled").otherwise(of_document)


def session_summary(items: DataFrame) -> DataFrame:
    """Counts of each state and the state of each upload session.

    items: session_id, total_files, canceled (of the session), status (effective).
    """
    n = {s: F.count_if(F.col("status") == s) for s in ("queued", "ingesting", "complete", "failed", "canceled")}
    uploaded = F.count("*")
    state = (
        F.when(F.max("canceled"), "canceled").when(uploaded < F.max("total_files"), "uploading").when(n["queued"] + n["ingesting"] > 0, "ingesting")
        .when((n["complete"] == 0) & (n["failed"] + n["canceled"] > 0), "failed").otherwise("complete")
    )
    return items.groupBy("session_id").agg(uploaded.alias("uploaded"), *[c.alias(f"n_{s}") for s, c in n.items()], state.alias("state"))


def queue_health(stats: DataFrame) -> DataFrame:
    """stats (pending, processing, retrying, dead, stale, online) with status and ordered reasons."""
    active = F.col("pending") + F.col("processing") + F.col("retrying") > 0
    reasons = F.array_compact(F.array(
        F.when(~F.col("online") & active, "worker_offline_with_active_queue").when(~F.col("online"), "worker_offline"),
        F.when(F.col("dead") > 0, "dead_lettered_jobs"), F.when(F.col("stale") > 0, "stale_processing_jobs"), F.when(F.col("retrying") > 0, "retrying_jobs"),
    ))
    status = F.when(F.array_contains(reasons, "worker_offline_with_active_queue"), "down").when(F.size(reasons) > 0, "degraded").otherwise("ok")
    return stats.withColumn("status", status).withColumn("reasons", F.array_join(reasons, ","))


def progress(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (doc_id, step, progress): a document's latest event, unless it has ended and the event hasn't; else what its state says.

    events: doc_id, step, state, progress, the latest of each document.
    """
    ended = F.col("status").isin("ready", "failed") & ~F.col("state").isin("complete", "failed")
    own = F.col("state").isNull() | ended
    step = F.when(F.col("status") == "ready", "complete").when(F.col("status").isin("failed", "processing"), F.col("status")).otherwise("queued")
    share = F.when(F.col("status") == "ready", 1.0).when(F.col("status") == "processing", 0.05).otherwise(0.0)
    joined = docs.select("doc_id", "status").join(events.withColumnRenamed("step", "_step"), "doc_id", "left")
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress")))
    return joined.select("doc_id", F.when(own, step).otherwise(F.col("_step")).alias("step"), F.when(own, share).otherwise(clamp).alias("progress"))
