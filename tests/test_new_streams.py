"""Keyed state, expected heartbeats and changing files, in several batches and over restarts."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from armada.session import new_path
from armada.sources import synced
from armada.streaming.heartbeats import expected_health, heartbeats
from armada.streaming.running import drain
from armada.streaming.stateful import FailureRuns, state_alerts

START = datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, k string, ok boolean, body string"


def rows(count=600):
    chance, made = random.Random(6), []
    for i in range(count):
        at = START + timedelta(seconds=10 * i - (i * 37) % 40 + (4000 if i > 400 else 0), microseconds=i % 3)
        key = "hot" if i % 3 == 0 else f"k{i % 4}"
        made.append((i, at, key, chance.random() < 0.15, None))
    return made + [(9000, START, None, False, None), (9001, None, "k1", False, None)]


def write_parts(spark, made, folder, parts):
    size = -(-len(made) // parts)
    for at in range(0, len(made), size):
        spark.createDataFrame(made[at : at + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def plain_alerts(made, threshold, quiet, passed):
    found, last, run = [], {}, {}
    for number, at, key, ok, _ in sorted((r for r in made if r[1] and r[2]), key=lambda r: (r[1], r[0])):
        if at > passed:
            continue
        if quiet and key in last and at - last[key] > quiet:
            run[key] = 0
        run[key], last[key] = 0 if ok else run.get(key, 0) + 1, at
        if run[key] == threshold:
            found.append((key, at))
    return sorted(found)


def run_to_end(stream, path, schema):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").option("path", f"{path}/rows")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows")


@pytest.mark.parametrize("quiet", [None, "10 minutes"])
def test_alerts_from_keyed_state(spark, tmp_path, quiet):
    made, folder, path = rows(), str(tmp_path / "in"), new_path(spark, "alerts")
    stream = lambda: state_alerts(source(spark, folder), "k", "ts", "id", "ok", 5, quiet, "1 minute")
    write_parts(spark, made[:400], folder, 2)
    run_to_end(stream(), path, "target string, alert_at timestamp")
    write_parts(spark, made[400:], folder, 2)  # goes on from the checkpoint
    got = run_to_end(stream(), path, "target string, alert_at timestamp")
    passed = max(r[1] for r in made if r[1]) - timedelta(minutes=1)
    passed = passed.replace(microsecond=passed.microsecond // 1000 * 1000)
    want = plain_alerts(made, 5, timedelta(minutes=10) if quiet else None, passed)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_probes_of_a_batch_are_one_value_of_state():
    # What a target costs is its calls to the state store, so they must not grow with its probes.
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *values: calls.append((name, values)) or Store()

    runs = FailureRuns(2, None)
    runs.init(Store())
    frame = pd.DataFrame({"at": [5000 - i for i in range(70)], "tie": range(70), "ok": [False] * 70})
    calls.clear()
    assert list(runs.handleInputRows(("k",), iter([frame]), None)) == []
    assert [name for name, _ in calls] == ["appendValue", "registerTimer"] and calls[1][1] == (5,)
    assert len(calls[0][1][0][0]) == 70 * 17


def status(*states):
    nodes = ",".join(f'{{"address":"n{i}","status":"{s}"}}' for i, s in enumerate(states))
    return f'{{"cluster":{{"nodes":[{nodes}]}}}}'


def test_silent_clusters_show_in_every_window(spark, tmp_path):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), (None, 1)], "k string, expected_nodes int")
    start, end = F.lit(START), F.lit(START + timedelta(minutes=20))
    beats = heartbeats(expected, "k", start, end, "1 minute")
    assert beats.count() == 4 * 20
    made = []
    for i in range(16):
        at = START + timedelta(minutes=i, seconds=5)
        if i % 5 != 3:  # a window without any body
            made.append((2 * i, at, "a", True, status("CONNECTED", "CONNECTED") if i % 2 else status("CONNECTED")))
            made.append((2 * i + 1, at, "a", True, status("CONNECTED", "LOST")) if i % 4 == 1 else (2 * i + 1, at - timedelta(seconds=2), "b", True, "broken"))
    made += [(500, START + timedelta(minutes=4), "stranger", True, status("CONNECTED"))]
    folder, beat_folder = str(tmp_path / "in"), str(tmp_path / "beats")
    write_parts(spark, made, folder, 3)
    beats.coalesce(1).write.parquet(beat_folder)
    beat_stream = spark.readStream.schema(beats.schema).parquet(beat_folder)
    options = dict(cluster="k", body="body", ts="ts", tie="id", every="1 minute", delay="2 minutes")
    got = drain(expected_health(beat_stream, source(spark, folder), **options), "health")
    whole = expected_health(beats, spark.createDataFrame(made, SCHEMA), **options)
    limit = max(r[1] for r in made) - timedelta(minutes=2)
    want = whole.filter(F.col("window_start") + F.expr("INTERVAL 1 minute") <= F.lit(limit))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    named = {(r.window_start, r.k): r for r in got.collect()}
    quiet = [named[START + timedelta(minutes=3), k] for k in "abc"]
    assert all(r.reason == "no_response" and not r.healthy and r.nodes == 0 and r.offenders == [] for r in quiet)
    assert {r.reason for r in named.values()} >= {"no_response", "count_mismatch", "not_connected", "healthy"}
    assert len(named) == got.count() and not any(k == "stranger" for _, k in named)


def test_changed_files_are_delivered_once(spark, tmp_path):
    folder, state, path = tmp_path / "folder", str(tmp_path / "state"), new_path(spark, "synced")
    (folder / "deep").mkdir(parents=True)
    schema = "path string, modified timestamp, length long, content binary"

    def write(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    def run():
        table = run_to_end(synced.stream_synced(spark, str(folder), state, ".py"), path, schema)
        return sorted((os.path.basename(r.path), r.content.decode()) for r in table.collect())

    assert run() == []
    write("a.py", "one\ntwo\n", 1000)
    write("deep/b.py", "b", 1000)
    write("note.txt", "other", 1000)
    write(".hidden.py", "hidden", 1000)
    first = [("a.py", "one\ntwo\n"), ("b.py", "b")]
    assert run() == first
    assert run() == first  # nothing new
    write("a.py", "three\n", 2000)
    write("c.py", "", 1500)
    second = sorted([*first, ("a.py", "three\n"), ("c.py", "")])
    assert run() == second
    os.remove(folder / "deep/b.py")
    write("a.py", "four!\n", 2000)  # same time and length: the same state
    assert run() == second
    write("a.py", "five, longer\n", 2000)
    assert run() == sorted([*second, ("a.py", "five, longer\n")])
    table = spark.read.schema(schema).parquet(f"{path}/rows")
    now = {os.path.basename(r.path): r.content.decode() for r in synced.latest(table).collect()}
    assert now["a.py"] == "five, longer\n"
    found = [(r.pos, r.value) for r in synced.lines(table.where("length = 8")).orderBy("pos").collect()]
    assert found == [(0, "one"), (1, "two")]
