"""A stream over files in several batches must agree with the batch operator on closed windows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from armada.operators.sequences import failure_runs
from armada.session import new_path
from armada.sources.components import stream_components, trigger
from armada.sources.segments import write_rolled
from armada.streaming.alerts import failure_alerts, read_alerts
from armada.streaming.rollover import roll_closed_windows, rollover_segments
from armada.streaming.running import drain
from armada.streaming.snapshots import snapshot_last, stream_health

START = datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, k string, ok boolean, v int, bytes long"


def event(i):
    # Out of order by up to 40 seconds; a third of all rows belong to one key.
    late = (i * 37) % 40
    key = "hot" if i % 3 == 0 else f"k{i % 4}"
    return (i, START + timedelta(seconds=10 * i - late), key, (i * 7) % 11 == 0, i % 50, 1 + i % 9)


@pytest.fixture(scope="module")
def events(spark):
    rows = [event(i) for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def stream(spark, events, tmp_path_factory):
    # Four files, read one per batch in the order they were written.
    folder = str(tmp_path_factory.mktemp("stream"))
    for part in range(4):
        events.filter(F.floor(F.col("id") / 150) == part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_snapshots(events, stream):
    got = drain(snapshot_last(stream, "k", "v", "ts", "id", delay="1 minute"), "snap")
    whole = snapshot_last(events, "k", "v", "ts", "id")
    top = events.agg(F.max("ts")).first()[0] - timedelta(minutes=1)
    want = whole.filter(F.col("window_start") + F.expr("INTERVAL 1 minute") <= F.lit(top))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 50


@pytest.mark.parametrize("rows_per_task", [30, 2_000_000])
def test_alerts_match_runs(spark, events, stream, rows_per_task):
    path = new_path(spark, "alerts")
    writer = failure_alerts(
        stream, path, "k", "ts", "id", "ok", 5, "1 minute", "1 minute", rows_per_task
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, read_alerts(spark, path).collect()))
    # In plain Python over the closed slices.
    top = max(r[1] for r in map(event, range(600))) - timedelta(minutes=1)
    closed = top.replace(second=0, microsecond=0)
    rows = sorted((event(i) for i in range(600)), key=lambda r: (r[1], r[0]))
    runs, want = {}, []
    for _, ts, key, ok, _, _ in rows:
        if ts >= closed:
            continue
        runs[key] = 0 if ok else runs.get(key, 0) + 1
        if runs[key] == 5:
            want.append((key, ts))
    assert got == sorted(want) and len(want) > 10
    # Each alert lies in one batch run of the same target.
    batch = failure_runs(events.filter(F.col("ts") < F.lit(closed)), "k", "ts", "id", "ok", 5)
    assert batch.count() == len(want)


def test_rolled_windows(spark, events, stream):
    path = new_path(spark, "rolled")
    sink = roll_closed_windows(path, "ts", "id", "bytes", delay="1 minute", max_bytes=40)
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{path}/segments").select("id", "segment_start", "segment_no")
    top = max(event(i)[1] for i in range(600)) - timedelta(minutes=1)
    whole = rollover_segments(events, "ts", "id", "bytes", max_bytes=40, rows_per_task=25)
    want = whole.filter(F.col("segment_start") + F.expr("INTERVAL 10 minutes") <= F.lit(top))
    assert sorted(map(tuple, got.collect())) == sorted(
        map(tuple, want.select("id", "segment_start", "segment_no").collect())
    )
    assert want.agg(F.max("segment_no")).first()[0] > 3
    plain = rollover_segments(events, "ts", "id", "bytes", max_bytes=40)
    assert sorted(map(str, plain.collect())) == sorted(map(str, whole.collect()))
    # A repeated batch leaves the same rows.
    before = sorted(map(tuple, got.collect()))
    sink(events.filter(F.floor(F.col("id") / 150) == 3), 3)
    again = spark.read.parquet(f"{path}/segments").select("id", "segment_start", "segment_no")
    assert sorted(map(tuple, again.collect())) == before


def test_health_of_latest_body(spark, tmp_path):
    body = '{"cluster":{"nodes":[{"address":"h","status":"%s"}]}}'
    rows = [(1, START, "c", body % "LOST"), (2, START + timedelta(seconds=3), "c", body % "CONNECTED"),
            (3, START + timedelta(seconds=11), "c", body % "LOST"), (4, START + timedelta(hours=1), "z", "")]
    folder = str(tmp_path / "bodies")
    spark.createDataFrame(rows, "id int, ts timestamp, cluster string, body string").write.parquet(folder)
    expected = spark.createDataFrame([("c", 1)], "cluster string, expected_nodes int")
    source = spark.readStream.schema("id int, ts timestamp, cluster string, body string").parquet(folder)
    got = drain(stream_health(source, expected, "cluster", "body", "ts", "id"), "health")
    assert [(r["window_start"], r["healthy"], r["offenders"]) for r in got.orderBy("window_start").collect()] == [
        (START, True, []), (START + timedelta(seconds=10), False, ["h=LOST"])]


def test_component_folder(spark, tmp_path):
    folder = tmp_path / "synced"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.py").write_text("one\ntwo\n")
    (folder / "sub" / "b.py").write_text("three\n")
    (folder / "c.txt").write_text("no\n")
    lines = drain(stream_components(spark, str(folder), glob="*.py"), "components")
    assert sorted(r["value"] for r in lines.collect()) == ["one", "three", "two"]
    files = drain(stream_components(spark, str(folder), "binaryFile", glob="*.py"), "files")
    assert sorted(r["content"] for r in files.select("content").collect()) == [b"one\ntwo\n", b"three\n"]
    writer = stream_components(spark, str(folder)).writeStream.format("noop")
    query = trigger(writer.option("checkpointLocation", str(tmp_path / "p")), every="1 second").start()
    query.processAllAvailable()
    query.stop()


def test_rolled_files(spark, events, tmp_path):
    cut = rollover_segments(events, "ts", "id", "bytes", max_bytes=40)
    write_rolled(cut, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 600
    assert len(list((tmp_path / "out").glob("segment_start=*"))) == cut.select("segment_start").distinct().count()
    assert all(".zstd." in f.name for f in (tmp_path / "out").glob("*/*.parquet"))


def test_health_broadcasts_no_table(spark, tmp_path):
    # A stream plans by the size of files: many clusters in few bytes would be broadcast from the driver.
    bodies = spark.createDataFrame([(1, START, "c", "")], "id int, ts timestamp, cluster string, body string")
    spark.createDataFrame([("c", 1)], "cluster string, expected_nodes int").write.parquet(str(tmp_path / "expected"))
    expected = spark.read.parquet(str(tmp_path / "expected"))
    planned = stream_health(bodies, expected, "cluster", "body", "ts", "id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in planned and "Broadcast" not in planned
