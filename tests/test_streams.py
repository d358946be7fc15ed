"""The file connector and keyed streams, with their production times, against plain Python."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import connector
from tessera.streaming import keyed, runs

BEGIN = datetime.datetime(2024, 1, 1)


def put(folder, name, body, second):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    os.utime(path, ns=(second * 10**9 + 7, second * 10**9 + 7))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    put(root, "a.txt", b"one", 100)
    put(root, "deep/er/b.MD", "zwei é".encode(), 101)
    put(root, "empty.txt", b"", 102)
    put(root, "c.exe", b"no", 103)
    put(root, "none", b"no", 103)
    put(root, "big.json", b"x" * 5000, 104)
    return root


def test_the_connector_lists_and_reads(spark, folder):
    connector.register(spark)
    read = spark.read.format(connector.FORMAT).option("partitionBytes", 10).load(f"file://{folder}")
    rows = {r.path[len(str(folder)) + 1 :]: r for r in read.collect()}
    assert sorted(rows) == ["a.txt", "big.json", "deep/er/b.MD"]
    assert bytes(rows["deep/er/b.MD"].content).decode() == "zwei é"
    assert rows["big.json"].sha256 == hashlib.sha256(b"x" * 5000).hexdigest() and rows["big.json"].size == 5000
    assert read.rdd.getNumPartitions() == 3
    listed = spark.read.format(connector.FORMAT).option("content", "false").option("suffixes", ".exe,.txt").load(f"file://{folder}")
    assert sorted((r.size, r.content, r.sha256) for r in listed.collect()) == [(2, None, None), (3, None, None)]
    assert spark.read.format(connector.FORMAT).load(f"file://{folder}/missing").count() == 0


def test_an_adapter_describes_files(folder):
    adapter = connector.Adapter(f"file://{folder}")
    found = list(adapter.iter_files())
    assert [adapter.metadata(f)["key"] for f in found] == ["a.txt", "big.json", "deep/er/b.MD"]
    assert adapter.metadata(found[2]) == {"root": f"file://{folder}", "key": "deep/er/b.MD", "name": "b.MD", "size": 7, "version": "101000000007-7"}
    assert [len(p.files) for p in connector.partitions([connector.Found(str(k), s, k) for k, s in enumerate([4, 4, 4, 90, 1, 9])], 10)] == [2, 1, 1, 2]
    assert connector.partitions([], 10) == []


def test_a_stream_of_the_connector_gets_new_versions_only(spark, folder, tmp_path):
    connector.register(spark)
    out, progress = f"file://{tmp_path}/out", f"file://{tmp_path}/progress"

    def run():
        stream = spark.readStream.format(connector.FORMAT).load(f"file://{folder}")
        runs.run_to_end(stream.select("path", "version"), out, progress)
        return sorted((r.path.rsplit("/", 1)[-1], r.version) for r in spark.read.schema("path string, version string").parquet(out).collect())

    first = run()
    assert [x[0] for x in first] == ["a.txt", "b.MD", "big.json"]
    assert run() == first
    put(folder, "a.txt", b"one more", 200)
    put(folder, "new.csv", b"1,2", 200)
    assert run() == sorted([*first, ("a.txt", "200000000007-8"), ("new.csv", "200000000007-3")])


def arrive(spark, rows, columns, batches):
    """Rows with seconds in place of ts, in that many parts by time."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    cut = [rows[len(rows) * k // batches : len(rows) * (k + 1) // batches] for k in range(batches)]
    return [spark.createDataFrame([(r[0], BEGIN + datetime.timedelta(seconds=r[1]), *r[2:]) for r in part], f"event_id long, ts timestamp, {columns}") for part in cut]


@pytest.mark.parametrize("batches", [1, 3])
def test_leases_end_without_heartbeats_however_rows_arrive(spark, batches):
    beats = [(1, 0, "a", False), (2, 60, "a", False), (3, 300, "a", False), (4, 541, "a", False), (5, 600, "a", True), (6, 10, "b", False), (7, 250, "b", True), (8, 20, "c", False), (9, 100000, "d", False), (10, 99000, None, False), (11, 9000, "c", False), (12, 9000, "c", True)]
    found = runs.stream_in_parts(arrive(spark, beats, "job_id string, ends boolean", batches), keyed.returned_leases).orderBy("job_id", "times").collect()
    seconds = lambda t: (t - BEGIN).total_seconds()
    assert [(r.job_id, seconds(r.last_beat), seconds(r.given_back_at), r.times) for r in found] == [("a", 300, 540, 1), ("c", 20, 260, 1)]


@pytest.mark.parametrize("batches", [1, 4])
def test_queues_admit_as_many_as_they_have_places(spark, batches):
    rows = [(k, k, "q", k in (5, 6, 7, 8, 9, 20)) for k in range(25)] + [(100, 3, "other", True), (101, 4, "other", False)]
    found = {r.event_id: (r.admitted, r.depth) for r in runs.stream_in_parts(arrive(spark, rows, "queue string, ends boolean", batches), lambda s: keyed.admissions(s, 4)).collect()}
    depth, wanted = 0, {101: (True, 1)}
    for k, _, _, ends in rows[:25]:
        if ends:
            depth = max(0, depth - 1)
        else:
            wanted[k] = (depth < 4, min(4, depth + 1))
            depth = min(4, depth + 1)
    assert found == wanted


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_requests_are_told_what_is_known(spark, batches):
    day = 24 * 3600
    rows = [
        (1, 0, "k", "f", None), (2, 10, "k", "f", None), (3, 20, "k", "f", "ok"), (4, 30, "k", "f", None), (5, 40, "k", "g", None), (6, 20 + day - 1, "k", "f", None), (7, 20 + day, "k", "f", None),
        (8, 0, "m", "f", None), (9, 59, "m", "f", None), (10, 60, "m", "f", None), (11, 70, "m", "f", "failed"), (12, 80, "m", "f", None), (13, 5, "n", "f", "ok"), (14, 6, "n", "f", None), (15, 7, None, "f", None), (16, 6 + day, "n", "f", "ok"), (17, 7 + day, "n", "f", None),
    ]
    found = {r.event_id: (r.answer, r.of) for r in runs.stream_in_parts(arrive(spark, rows, "key string, fingerprint string, outcome string", batches), keyed.answered_requests).collect()}
    assert found == {1: ("go", None), 2: ("in_flight", None), 4: ("replay", 1), 5: ("conflict", None), 6: ("replay", 1), 7: ("go", None), 8: ("go", None), 9: ("in_flight", None), 10: ("go", None), 12: ("go", None), 14: ("go", None), 17: ("go", None)}


def test_late_rows_are_left_out_and_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    parts = [*arrive(spark, [(1, 100000, "a", False)], "job_id string, ends boolean", 1), *arrive(spark, [(2, 50, "a", False), (3, 100010, "a", True)], "job_id string, ends boolean", 1)]
    found = runs.stream_in_parts(parts, keyed.returned_leases)
    assert found.where(F.col("times") > 0).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
