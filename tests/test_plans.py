"""What the plans look like: skew splitting, push-down, map-side limits."""

import contextlib
import io
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from armada.operators import drift, lookups, sequences, upkeep
from armada.plans.upkeep import archive
from armada.session import shared_dir


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def small_skew_limits(spark):
    """Thresholds low enough for a test table to count as skewed."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark):
    """A third of all rows have one key."""
    return spark.range(0, 60000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("key"),
        F.concat(F.lit("text-"), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
    )


def test_hot_keys_of_lookups_are_split(spark, small_skew_limits):
    facts = skewed(spark)
    ports = spark.range(997).select("id", (F.col("id") * 2).cast("int").alias("number"))
    found = lookups.lookup_ports(facts, "key", ports, "id", "number")
    assert found.agg(F.sum("port"), F.count("*")).first()[1] == 60000
    found.collect()
    assert "skew=true" in plan(found)
    live = ports.filter("id < 500").select(F.col("id").alias("key"))
    kept = lookups.ignore_deleted(facts, live, ["key"])
    kept.collect()
    assert "skew=true" in plan(kept)


def test_hot_keys_are_split_before_an_aggregate_on_the_same_key(spark, small_skew_limits):
    ports = spark.range(997).select("id", (F.col("id") * 2).cast("int").alias("number"))
    found = lookups.lookup_ports(skewed(spark), "key", ports, "id", "number")
    total = found.groupBy("key").agg(F.max("port").alias("p"), F.max("text").alias("t"))
    assert total.count() == 997
    total.collect()
    assert "skew=true" in plan(total)


def test_drift_keeps_hot_objects_split(spark, small_skew_limits):
    expected = skewed(spark).select("key", F.col("text").alias("field"), F.lit("1").alias("value"))
    observed = spark.range(900).select(F.col("id").alias("key"), F.lit("x").alias("field"), F.lit("1").alias("value"))
    broken = drift.expected_vs_observed(expected, observed, ["key"])
    rows = broken.collect()
    assert "skew=true" in plan(broken)
    lost = skewed(spark).filter("key >= 900").select("key").distinct().count()
    assert sum(r["problem"] == "missing" for r in rows) == lost > 0


def test_filters_reach_the_scan(spark, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "events")
    spark.range(100).select(
        F.timestamp_seconds("id").alias("ts"), F.lit("node").alias("kind"), "id"
    ).write.parquet(path)
    kept = upkeep.retain(spark.read.parquet(path), "ts", "kind", datetime(2024, 1, 1))
    assert "GreaterThanOrEqual(ts,2023-12-18" in plan(kept)
    found = upkeep.event_search(spark.read.parquet(path).select("id", "kind"), kind="node")
    text = plan(found)
    assert "EqualTo(kind,node)" in text and "ts:" not in text


def test_few_points_per_group_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    text = plan(sequences.history_cap(df, "k", ["-id"], 10))
    assert text.count("WindowGroupLimit") >= 2


def test_archive_keeps_the_budget(spark, tmp_path):
    events = spark.range(900).select(
        "id", F.timestamp_seconds(F.col("id") * 3).alias("ts"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("c").alias("component"), F.lit(10).alias("size"),
    )
    for limit in (50, 2_000_000):
        path = str(tmp_path / f"archive-{limit}")
        archive(events, path, capacity=4000, max_bytes=100, rows_per_task=limit)
        back = spark.read.parquet(path)
        kept = {r["component"]: (r["n"], r["oldest"]) for r in back.groupBy("component").agg(
            F.count("*").alias("n"), F.min("id").alias("oldest")).collect()}
        assert kept == {"hot": (200, 300), "c": (200, 601)}
        assert back.agg(F.max("segment_no")).first()[0] > 3


def test_shared_folder_follows_the_setting(tmp_path):
    # The setting is fixed when a session starts, so this one gets a process of its own.
    script = f"""
from pyspark.sql import SparkSession
from armada.session import pin, shared_dir
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "{tmp_path}/shared/").getOrCreate())
assert shared_dir(spark) == "{tmp_path}/shared", shared_dir(spark)
assert pin(spark.range(5)).count() == 5
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert list((tmp_path / "shared").glob("*/rdd-*"))
