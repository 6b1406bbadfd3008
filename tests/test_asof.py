"""As-of joins against a plain version, with hot keys cut into slices."""

import random
from datetime import datetime, timedelta

import pytest

from armada.operators.asof import changes, in_force

START = datetime(2024, 1, 1)


def made(seed):
    chance = random.Random(seed)
    at = lambda: START + timedelta(minutes=chance.randint(0, 50))
    rows = [(i, chance.choice(["hot", "hot", "hot", "b", None]), at() if i % 17 else None) for i in range(300)]
    versions = [
        (chance.choice(["hot", "hot", "b", "c", None]), at() if i % 9 else None, i, f"v{i}", at() if i % 3 else None)
        for i in range(80)
    ]
    return rows, versions


def plain(rows, versions, before, until):
    found = []
    for number, key, ts in rows:
        held = None
        for k, since, tie, name, end in versions:
            if k == key and since is not None and ts is not None and (since < ts or (since == ts and not before)):
                if held is None or (since, tie) > held[:2]:
                    held = (since, tie, name, end)
        if held and until and held[3] is not None and ts >= held[3]:
            held = None
        found.append((number, key, ts, held[0] if held else None, held[2] if held else None))
    return found


@pytest.mark.parametrize("per_task, before, until", [(1_000_000, False, None), (20, False, None), (20, True, None), (20, False, "ends")])
def test_in_force(spark, per_task, before, until):
    rows, versions = made(per_task)
    left = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(3)
    right = spark.createDataFrame(versions, "key string, since timestamp, no long, name string, ends timestamp").repartition(3)
    got = in_force(left, right, ["key"], "ts", "since", ["name"], tie="no", until=until, before=before, rows_per_task=per_task).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, versions, before, until)))


def test_changes(spark):
    versions = [("a", START, 1), ("a", START + timedelta(1), 1), ("a", START + timedelta(2), 2), ("a", START + timedelta(3), None), ("b", START, 1)]
    table = spark.createDataFrame(versions, "key string, since timestamp, size int")
    got = {(r.key, r.since, r.size, r.previous and r.previous.size) for r in changes(table, ["key"], "since", ["size"], 2).collect()}
    assert got == {("a", START, 1, None), ("a", START + timedelta(2), 2, 1), ("a", START + timedelta(3), None, 2), ("b", START, 1, None)}
