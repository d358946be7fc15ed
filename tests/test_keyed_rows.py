"""Keyed state takes and gives rows, without a table for each key."""

from pyspark.sql import Row

from tessera.streaming import keyed


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: iter(self.timers)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def given(processor, rows):
    processor.init(Handle())
    return [r.asDict() for r in processor.handleInputRows((7,), iter(rows), None)]


def test_rows_of_a_key_in_order_of_time():
    asked = [Row(event_id=k, at=at, ends=e) for k, at, e in ((3, 30, False), (1, 10, False), (2, 10, None))]
    assert [(r["event_id"], r["admitted"], r["depth"]) for r in given(keyed._Admission(2), asked)] == [(1, True, 1), (2, True, 2), (3, False, 2)]
    second = 1_000_000
    beats = [Row(event_id=2, at=9 * second, ends=True), Row(event_id=1, at=0, ends=False)]
    assert given(keyed._Leases(5), beats) == [{"job_id": 7, "last_beat": 0, "given_back_at": 5 * second, "times": 1}]
    told = [Row(event_id=k, at=k, outcome=o, fingerprint="f") for k, o in ((3, None), (1, None), (2, "ok"))]
    assert [(r["event_id"], r["answer"], r["of"]) for r in given(keyed._Requests(5, 9), told)] == [(1, "go", None), (3, "replay", 1)]
