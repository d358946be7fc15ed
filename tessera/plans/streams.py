"""Queries over the file connector and over streams with keyed state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import connector
from tessera.sources.scratch import scratch_folder
from tessera.sources.tables import read_table
from tessera.streaming.keyed import admissions, answered_requests, returned_leases
from tessera.streaming.runs import run_to_end, stream_in_parts

#: The events table is sparse, so its stand-ins for jobs and requests have longer times: seconds of a lease, in flight, known; jobs in flight.
LEASE, IN_FLIGHT, KNOWN, PLACES = 12 * 3600, 6 * 3600, 36 * 3600, 3


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def _put(docs: DataFrame, folder: str) -> None:
    """Documents as files of bounded size, a folder for each language."""
    docs.write.mode("append").partitionBy("lang").option("maxRecordsPerFile", 500).json(folder)


def _lines(files: DataFrame) -> DataFrame:
    """The documents in files of the connector, with the language of their folder."""
    lang = F.nullif(F.regexp_extract("path", "/lang=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = files.select(lang.alias("lang"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.select("lang", F.from_json("line", "doc_id long, text string").alias("d")).select("lang", "d.doc_id", "d.text")


@query("SELECT lang, count(*) AS documents, sum(doc_id) AS ids, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY lang")
def connector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, and read back by the connector."""
    connector.register(spark)
    folder = scratch_folder(spark, "files")
    _put(_documents(spark, sf_dir), folder)
    read = _lines(spark.read.format(connector.FORMAT).option("suffixes", ".json").load(folder))
    return read.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query("SELECT doc_id % 2 AS run, count(*) AS documents, sum(doc_id) AS ids, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY 1")
def connector_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a stream over a folder: even documents are there at the first, odd ones come before the second, which sees them only."""
    connector.register(spark)
    folder, out, progress = (scratch_folder(spark, name) for name in ("files", "synced", "progress"))
    docs = _documents(spark, sf_dir)
    for run in (0, 1):
        _put(docs.where(F.col("doc_id") % 2 == run), folder)
        stream = _lines(spark.readStream.format(connector.FORMAT).option("suffixes", ".json").load(folder))
        run_to_end(stream.select("doc_id", "text", F.lit(run).cast("long").alias("run")), out, progress)
    seen = spark.read.schema("doc_id long, text string, run long").parquet(out)
    return seen.groupBy("run").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")


def _halves(events: DataFrame) -> list[DataFrame]:
    """Events before and after a moment, as a stream gets them."""
    early = F.col("ts") < F.timestamp_add("day", F.lit(12), F.lit("2024-01-01").cast("timestamp_ntz"))
    return [events.where(early), events.where(~early)]


@query(
    f"""WITH e AS (SELECT event_id, ts, user_id, event_type = 'purchase' AS ends, lead(ts) OVER w AS next FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
lost AS (SELECT user_id AS job_id, ts AS last_beat, ts + INTERVAL {LEASE} SECOND AS given_back_at FROM e WHERE NOT ends
  AND CASE WHEN next IS NULL THEN ts + INTERVAL {LEASE} SECOND < (SELECT max(ts) - INTERVAL 1 HOUR FROM events) ELSE next > ts + INTERVAL {LEASE} SECOND END)
SELECT job_id, last_beat, given_back_at, CAST(row_number() OVER (PARTITION BY job_id ORDER BY last_beat) AS INTEGER) AS times FROM lost"""
)
def returned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for jobs: each event is a heartbeat, and a purchase ends the job."""
    events = _events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("job_id"), F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("ends"))
    back = stream_in_parts(_halves(events), lambda s: returned_leases(s, LEASE))
    return back.select("job_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_beat", "given_back_at")], "times")


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, coalesce(event_type = 'purchase', false) AS ends, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT event_id, user_id, i, ends, true AS admitted, CASE WHEN ends THEN 0 ELSE 1 END AS depth FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, e.ends, s.depth < {PLACES}, CASE WHEN e.ends THEN greatest(s.depth - 1, 0) ELSE least(s.depth + 1, {PLACES}) END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, user_id AS queue, admitted, depth FROM s WHERE NOT ends"""
)
def admitted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for queues: each event but a purchase asks for a place, and a purchase frees one."""
    events = _events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("queue"), F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("ends"))
    return stream_in_parts(_halves(events), lambda s: admissions(s, PLACES))


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' END"
_FINGERPRINT = "coalesce(event_type, 'none')"


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, {_OUTCOME} AS outcome, {_FINGERPRINT} AS fp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS BIGINT) AS of, 0 AS held, CAST(NULL AS VARCHAR) AS hfp, CAST(NULL AS BIGINT) AS hreq, CAST(0 AS BIGINT) AS hat FROM e GROUP BY user_id
  UNION ALL SELECT user_id, i, event_id,
    CASE WHEN outcome IS NOT NULL THEN NULL WHEN live = 0 THEN 'go' WHEN live = 1 THEN 'in_flight' WHEN hfp <> fp THEN 'conflict' ELSE 'replay' END,
    CASE WHEN outcome IS NULL AND live = 2 AND hfp = fp THEN hreq END,
    CASE WHEN outcome IS NOT NULL THEN CASE WHEN held <> 1 THEN held WHEN outcome = 'ok' AND us < hat + {1_000_000 * KNOWN} THEN 2 ELSE 0 END WHEN live = 0 THEN 1 ELSE live END,
    CASE WHEN outcome IS NULL AND live = 0 THEN fp ELSE hfp END, CASE WHEN outcome IS NULL AND live = 0 THEN event_id ELSE hreq END,
    CASE WHEN outcome IS NULL AND live = 0 OR outcome = 'ok' AND held = 1 THEN us ELSE hat END
  FROM (SELECT e.*, s.held, s.hfp, s.hreq, s.hat, CASE WHEN s.held > 0 AND e.us >= s.hat + CASE s.held WHEN 1 THEN {1_000_000 * IN_FLIGHT} ELSE {1_000_000 * KNOWN} END THEN 0 ELSE s.held END AS live FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT event_id, user_id AS key, answer, of FROM s WHERE answer IS NOT NULL"""
)
def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for keys: a purchase answers the request in flight, an error frees the key, and other events are requests whose type is their fingerprint."""
    events = _events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("key"), F.expr(_FINGERPRINT).alias("fingerprint"), F.expr(_OUTCOME).alias("outcome"))
    return stream_in_parts(_halves(events), lambda s: answered_requests(s, IN_FLIGHT, KNOWN))
