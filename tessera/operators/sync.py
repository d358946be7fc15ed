"""Mirroring of a remote listing: what is new, changed, unchanged or gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deletes stop if so many files are tracked and more than this share is missing.
GUARD_TRACKED, GUARD_PERCENT = 10, 50


def sync_diff(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """State of every remote id: created, updated, skipped or deleted.

    manifest: remote_id, signature, content_hash, status (of its document, null if
    it is gone); listing: remote_id, signature, content_hash.
    """
    old, new = (d.select("remote_id", *(F.col(c).alias(f"{side}_{c}") for c in d.columns if c != "remote_id")) for d, side in ((manifest, "old"), (listing, "new")))
    both = old.withColumn("tracked", F.lit(True)).join(new.withColumn("listed", F.lit(True)), "remote_id", "full")
    alive = F.col("old_status").isNotNull() & (F.col("old_status") != "failed")
    same = (F.col("old_signature").eqNullSafe(F.col("new_signature")) & alive) | ((F.col("old_content_hash") == F.col("new_content_hash")) & alive)
    state = (
        F.when(F.col("listed").isNull(), "deleted")
        .when(F.col("tracked").isNull(), "created")
        .when(F.coalesce(same, F.lit(False)), "skipped")
        .otherwise("updated")
    )
    return both.select("remote_id", state.alias("state"))


def sync_counters(diff: DataFrame) -> DataFrame:
    """One row: counts of each state, and whether so many files are missing that nothing may be deleted."""
    gone, tracked = F.count_if(F.col("state") == "deleted"), F.count_if(F.col("state") != "created")
    return diff.agg(
        F.count_if(F.col("state") != "deleted").alias("found"),
        *(F.count_if(F.col("state") == s).alias(s) for s in ("created", "updated", "skipped")),
        gone.alias("deleted"),
        ((tracked >= GUARD_TRACKED) & (gone * 100 > tracked * GUARD_PERCENT)).alias("guarded"),
    )
