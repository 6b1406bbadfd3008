"""The log cut against a plain walk over the rows."""

import random
from datetime import datetime, timedelta

import pytest

from armada.operators.logcut import followed, log_cut, reached

START = datetime(2024, 1, 1)


def plain_cut(rows, minutes, most):
    found, logs = [], {}
    for row in rows:
        if row[1] is not None:
            logs.setdefault(row[0], []).append(row)
    for own in logs.values():
        own.sort(key=lambda r: (r[1], r[2]))
        number, first, held = -1, None, 0
        for row in own:
            if first is None or row[1] >= first + timedelta(minutes=minutes) or held >= most:
                number, first, held = number + 1, row[1], 0
            held += max(0, row[3] or 0)
            found.append((*row, number, first))
    return found


def rows(seed, count=400):
    chance = random.Random(seed)
    made = []
    for i in range(count):
        log = chance.choice(["a", "a", "a", "b", None])
        at = START + timedelta(seconds=chance.choice([1, 7, 300]) * chance.randint(0, 40), microseconds=chance.randint(0, 1))
        made.append((log, at, i, chance.choice([0, 1, 5, 5, 30, None, -4])))
    return made + [("c", START, 9000, 100), ("d", None, 9001, 5)]


SCHEMA = "log string, ts timestamp, id long, bytes int"


@pytest.mark.parametrize("per_task, most", [(1_000_000, 40), (60, 1), (40, 10_000)])
def test_log_cut(spark, per_task, most):
    made = rows(most)
    table = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = log_cut(table, ["log"], "ts", "id", "bytes", "10 minutes", most, per_task).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_cut(made, 10, most)))


def test_nothing_to_cut(spark):
    assert log_cut(spark.createDataFrame([], SCHEMA), ["log"], "ts", "id", "bytes").count() == 0


@pytest.mark.parametrize("per_block", [1, 2, 7, 4_096])
def test_blocks_of_any_length(spark, per_block):
    made = rows(2)
    table = spark.createDataFrame(made, SCHEMA)
    got = log_cut(table, ["log"], "ts", "id", "bytes", "10 minutes", 20, rows_per_block=per_block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_cut(made, 10, 20)))


def test_only_entries_are_doubled(spark, monkeypatch):
    # Before, every row was joined anew in each round.
    doubled = []

    def counted(ways, log):
        doubled.append(ways.count())
        return followed(ways, log)

    monkeypatch.setattr("armada.operators.logcut.followed", counted)
    jumps = spark.range(1, 1001).selectExpr("'a' AS log", "id AS _n", "CASE WHEN id <= 997 THEN id + 3 END AS _next")
    got = reached(jumps, ["log"], 100)
    assert sorted(r._n for r in got.collect()) == list(range(4, 1001, 3)) and doubled[0] <= 1 + 3 * 10
