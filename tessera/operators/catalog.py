"""Lists with pages, joins of names, and removal of repeated documents."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(needle: str, *columns: str) -> Column:
    """Whether any of the columns holds the text, in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return found


def page(df: DataFrame, sort: str, key: str, limit: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """One page in the order of sort, then key; after is the (sort, key) of the last row seen.

    Returns limit + 1 rows where there are more, so that the caller knows.
    """
    if after is not None:
        s, k = F.col(sort), F.col(key)
        last, last_key = F.lit(after[0]), F.lit(after[1])
        beyond = (s < last) | ((s == last) & (k < last_key)) if descending else (s > last) | ((s == last) & (k > last_key))
        df = df.where(beyond)
    direction = F.desc if descending else F.asc
    return df.orderBy(direction(sort), direction(key)).limit(limit + 1)


def with_names(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with the filename of their document; null where there is none. The join's side is Spark's choice, by size."""
    return hits.join(docs.select(F.col("doc_id").alias("id"), "filename"), "id", "left")


def content_duplicates(docs: DataFrame, *scope: str) -> DataFrame:
    """Each document with the first of its scope that has the same text: doc_id, content_hash, first_id, deduped.

    Groups are pre-aggregated to a hash and its smallest id before they meet the rows again, so a
    frequent text isn't sorted in one task. A null text has no copies.
    """
    hashed = docs.select("doc_id", *scope, F.sha2(F.col("text"), 256).alias("content_hash"))
    keys = [*scope, "content_hash"]
    firsts = hashed.where(F.col("content_hash").isNotNull()).groupBy(*keys).agg(F.min("doc_id").alias("first_id"))
    joined = hashed.join(firsts, keys, "left").withColumn("first_id", F.coalesce("first_id", "doc_id"))
    return joined.select("doc_id", "content_hash", "first_id", (F.col("first_id") != F.col("doc_id")).alias("deduped"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key isn't new, and the new rows."""
    return old.join(new, key, "left_anti").unionByName(new)


def recent_cut(cache: DataFrame, at: str, rows: int) -> DataFrame:
    """A cache cut to its most recent rows; rows as recent as the last one kept stay too."""
    last = cache.orderBy(F.desc(at)).limit(rows).agg(F.min(at).alias("cut"))
    return cache.join(F.broadcast(last), F.col(at) >= F.col("cut")).drop("cut")


def latest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("last")).select(key, "last.*")


def first_per(df: DataFrame, n: int, by: str, *order: Column) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before the shuffle."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def cursor(at: Column, key: Column) -> Column:
    """A page's cursor: its last row's time, to the microsecond, and id as JSON in URL-safe base64 without padding."""
    whole = F.date_format(at, "ss.SSSSSS").endswith(".000000")
    time = F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    body = F.concat(F.lit('{"created_at":"'), time, F.lit('+00:00","id":"'), key.cast("string"), F.lit('"}'))
    return F.rtrim(F.translate(F.base64(body), "+/=\r\n", "-_ "))


def read_cursor(text: str) -> tuple[datetime, str]:
    """Time and id of a cursor; ValueError if it is none, or if its time has no zone."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        at, key = datetime.fromisoformat(found["created_at"]), found["id"]
    except (ValueError, TypeError, KeyError) as e:
        raise ValueError("not a cursor") from e
    if at.tzinfo is None or not isinstance(key, str):
        raise ValueError("not a cursor")
    return at, key


def cursor_allowed(sort: str) -> None:
    """A cursor goes with the order by creation only."""
    if sort != "created_at":
        raise ValueError("a cursor needs the order by created_at")
