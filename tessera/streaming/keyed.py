"""Keyed state over streams: leases of jobs, admission to queues, and requests that may be repeated."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed values, in seconds: a lease without a heartbeat for this long (a lease of 1,800 of which less than 1,560 are left) is given back;
#: a request counts as in flight and its answer as known for this long.
LEASE, IN_FLIGHT, KNOWN = 240, 60, 24 * 3600
#: Fixed value: jobs in flight at most.
MAX_IN_FLIGHT = 10_000
_MICRO = 1_000_000


def _timed(events: DataFrame, key: str, late: str, *columns: str) -> DataFrame:
    """Rows with a key and a time, which is also given in microseconds, so that no time zone comes in; with the watermark."""
    kept = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return kept.select("event_id", "ts", F.unix_micros("ts").alias("at"), key, *columns).withWatermark("ts", late)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of one micro-batch by time, then id."""
    return sorted(rows, key=lambda r: (r["at"], r["event_id"] is None, r["event_id"] or 0))


class _Leases(StatefulProcessor):
    """State of a job: its last heartbeat and how often it was given back. A timer stands at the lease's end."""

    def __init__(self, lease: int):
        self.lease = lease * _MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "beat long, returned int")

    def _given_back(self, key: tuple, beat: int, returned: int) -> Row:
        return Row(job_id=key[0], last_beat=beat, given_back_at=beat + self.lease, times=returned)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        beat, returned = self.state.get() if self.state.exists() else (None, 0)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for r in _in_order(rows):
            at, ends = r["at"], r["ends"]
            if beat is not None and at > beat + self.lease:
                returned += 1
                yield self._given_back(key, beat, returned)
                beat = None
            beat = None if ends else at
        if beat is not None:
            self.handle.registerTimer(-(-(beat + self.lease) // 1000))
        self.state.update((beat, returned))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        beat, returned = self.state.get()
        if beat is not None:
            self.state.update((None, returned + 1))
            yield self._given_back(key, beat, returned + 1)


def returned_leases(events: DataFrame, lease: int = LEASE, late: str = "1 hour") -> DataFrame:
    """A stream (job_id, last_beat, given_back_at, times) of jobs that sent no heartbeat for ``lease`` seconds, each of which goes back to its queue.

    events: a stream of event_id, ts, job_id, ends (boolean): every row is a heartbeat, and one with ``ends`` finishes the job. A later row begins a new lease. A
    lease ends by event time: with the next row that comes too late, or when the watermark, ``late`` behind the newest row, has passed it. How rows
    fall into micro-batches changes nothing, as long as none is later than that. times counts a job's returns.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    back = _timed(events, "job_id", late, "ends").groupBy("job_id").transformWithState(_Leases(lease), f"job_id {kind}, last_beat long, given_back_at long, times int", "Append", "EventTime")
    return back.select("job_id", F.timestamp_micros("last_beat").alias("last_beat"), F.timestamp_micros("given_back_at").alias("given_back_at"), "times")


class _Admission(StatefulProcessor):
    """State of a queue: how many jobs it has in flight."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("depth", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.state.get()[0] if self.state.exists() else 0
        for r in _in_order(rows):
            if r["ends"]:
                n = max(n - 1, 0)
                continue
            admitted = n < self.most
            n = min(n + 1, self.most)
            yield Row(event_id=r["event_id"], queue=key[0], admitted=admitted, depth=n)
        self.state.update((n,))


def admissions(events: DataFrame, most: int = MAX_IN_FLIGHT, late: str = "1 hour") -> DataFrame:
    """A stream (event_id, queue, admitted, depth): whether each job that asks for its queue is let in, and how many are in flight then.

    events: a stream of event_id, ts, queue, ends (boolean); a row with ``ends`` frees a place. Micro-batches must come in order of time; rows within one are ordered here.
    """
    kind = events.schema["queue"].dataType.simpleString()
    return _timed(events, "queue", late, "ends").groupBy("queue").transformWithState(_Admission(most), f"event_id long, queue {kind}, admitted boolean, depth int", "Append", "None")


class _Requests(StatefulProcessor):
    """State of an idempotency key: what is in flight (its fingerprint, request and time), and the answer known (the same, and when it came)."""

    def __init__(self, in_flight: int, known: int):
        self.in_flight, self.known = in_flight * _MICRO, known * _MICRO
        self.longest = max(self.in_flight, self.known)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "done boolean, fingerprint string, request long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        out = []
        for r in _in_order(rows):
            at, event_id, outcome, fingerprint = r["at"], r["event_id"], r["outcome"], r["fingerprint"]
            if isinstance(outcome, str):
                if held is not None and not held[0]:
                    held = (True, held[1], held[2], at) if outcome == "ok" and at < held[3] + self.longest else None
                continue
            if held is not None and at >= held[3] + (self.known if held[0] else self.in_flight):
                held = None
            if held is None:
                held = (False, fingerprint, event_id, at)
                out.append((event_id, "go", None))
            elif not held[0]:
                out.append((event_id, "in_flight", None))
            elif held[1] != fingerprint:
                out.append((event_id, "conflict", None))
            else:
                out.append((event_id, "replay", held[2]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)
            # A request in flight may still be answered, so it is forgotten no sooner than an answer.
            self.handle.registerTimer((held[3] + self.longest) // 1000 + 1)
        yield from (Row(event_id=event_id, key=key[0], answer=answer, of=of) for event_id, answer, of in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())


def answered_requests(events: DataFrame, in_flight: int = IN_FLIGHT, known: int = KNOWN, late: str = "1 hour") -> DataFrame:
    """A stream (event_id, key, answer, of): what each request with an idempotency key is told.

    events: a stream of event_id, ts, key, fingerprint, outcome. A row without outcome is a request: ``go`` if nothing is known of its key, ``in_flight`` while an
    earlier one is worked on (for ``in_flight`` seconds), ``replay`` of the request ``of`` if that was answered within ``known`` seconds and has the same
    fingerprint, else ``conflict``. Outcome ``ok`` answers the request in flight, if that isn't older than both times; any other frees its key. Rows without a key aren't held back and don't come here. Micro-batches must
    come in order of time; rows within one are ordered here. State goes when its time is over by the watermark.
    """
    kind = events.schema["key"].dataType.simpleString()
    return _timed(events, "key", late, "fingerprint", "outcome").groupBy("key").transformWithState(_Requests(in_flight, known), f"event_id long, key {kind}, answer string, of long", "Append", "EventTime")
