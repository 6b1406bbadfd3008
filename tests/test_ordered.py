"""The sliced way through large groups must give what one window per group gives."""

import random

import pytest
from pyspark.sql import functions as F

from armada.operators.ordered import numbered, running, slices, top_per_group
from armada.operators.sequences import (
    budget_keep,
    failure_runs,
    stable_order,
    time_to_success,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{rng.randrange(40)}")
        # Many equal timestamps, so the tie-breaker decides.
        rows.append((key, rng.randrange(60), i, rng.random() < 0.25, rng.randrange(50)))
    return spark.createDataFrame(rows, "k string, t int, id int, ok boolean, size int").withColumn(
        "ts", F.timestamp_seconds(F.col("t"))
    )


def same(left, right):
    a = sorted(map(str, left.collect()))
    b = sorted(map(str, right.collect()))
    assert a == b and a


@pytest.mark.parametrize("limit", [20, 100])
def test_running_sum_and_max(skewed, limit):
    for how in ("sum", "max"):
        args = (skewed, ["k"], ["-t", "-id"], F.col("size"), "r", how)
        plain = running(*args)
        sliced = running(*args, rows_per_task=limit)
        assert plain.schema == sliced.schema
        same(plain, sliced)


@pytest.mark.parametrize("n", [1, 15, 200])
def test_top_per_group(skewed, n):
    same(
        top_per_group(skewed, ["k"], ["-t", "id"], n),
        top_per_group(skewed, ["k"], ["-t", "id"], n, rows_per_task=25),
    )


def test_failure_runs(skewed):
    args = (skewed, "k", "ts", "id", "ok", 4)
    same(failure_runs(*args), failure_runs(*args, rows_per_task=30))


def test_time_to_success(skewed):
    args = (skewed, "k", "ts", "id", "ok", 5)
    same(time_to_success(*args), time_to_success(*args, rows_per_task=30))


def test_budget(skewed):
    args = (skewed, "k", ["-t", "-id"], "size", 1000)
    same(budget_keep(*args), budget_keep(*args, rows_per_task=30))


def test_null_sizes_take_no_room(skewed):
    holes = skewed.withColumn("size", F.when(F.col("id") % 3 > 0, F.col("size")))
    want = budget_keep(holes, "k", ["-t", "-id"], "size", 1000)
    for per_task in (3, 5, 7):
        same(want, budget_keep(holes, "k", ["-t", "-id"], "size", 1000, rows_per_task=per_task))
    filled = budget_keep(holes.fillna(0, ["size"]), "k", ["-t", "-id"], "size", 1000)
    same(want.drop("size"), filled.drop("size"))


def test_failure_runs_against_plain_python(skewed):
    by_key = {}
    for r in skewed.orderBy("t", "id").collect():
        by_key.setdefault(r["k"], []).append(r)
    want = []
    for key, rows in by_key.items():
        run = 0
        for r in [*rows, None]:
            if r is not None and not r["ok"]:
                run += 1
                continue
            if run >= 4:
                want.append((str(key), run))
            run = 0
    got = [
        (str(r["k"]), r["failures"])
        for r in failure_runs(skewed, "k", "ts", "id", "ok", 4, rows_per_task=30).collect()
    ]
    assert sorted(got) == sorted(want) and want


def test_first_success_against_plain_python(skewed):
    by_key = {}
    for r in skewed.orderBy("t", "id").collect():
        by_key.setdefault(r["k"], []).append(r)
    want = []
    for key, rows in by_key.items():
        limit = rows[0]["t"] + 5
        tried, verdict = 0, "FAIL"
        for r in rows:
            if r["t"] >= limit:
                break
            tried += 1
            if r["ok"]:
                verdict = "PASS"
                break
        want.append((str(key), verdict, tried))
    got = [
        (str(r["k"]), r["verdict"], r["attempts"])
        for r in time_to_success(skewed, "k", "ts", "id", "ok", 5, rows_per_task=30).collect()
    ]
    assert sorted(got) == sorted(want)
    assert {v for _, v, _ in want} == {"PASS", "FAIL"}


def test_copies_of_one_row(spark):
    """A third of all rows are the same row; every way must still agree with the plain one."""
    rows = [("a", 5, 5, False, 7)] * 100 + [
        (f"k{i % 9}", i % 13, i, i % 4 == 0, i % 6) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "k string, t int, id int, ok boolean, size int").withColumn(
        "ts", F.timestamp_seconds(F.col("t"))
    )
    args = (df, ["k"], ["t", "id"], F.col("size"), "r", "sum")
    same(running(*args), running(*args, rows_per_task=20))
    args = (df, ["k"], ["t", "id"], 30)
    same(top_per_group(*args), top_per_group(*args, rows_per_task=20))
    args = (df, "k", "ts", "id", "ok", 4)
    same(failure_runs(*args), failure_runs(*args, rows_per_task=20))
    plain = stable_order(df.drop("ts"), "k").collect()
    packed = stable_order(df.drop("ts"), "k", rows_per_task=15).collect()
    assert plain == packed and len(plain) == 300


def test_slices_are_even(spark):
    """No slice of a group of copies is much larger than asked for."""
    df = spark.range(4000).select(F.lit("a").alias("k"), F.lit(1).alias("t"))
    cut = slices(numbered(df), ["k"], ["t", "_row"], 4000, 500)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
