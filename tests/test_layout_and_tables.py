"""Layouts over several fields, sketches, outages and table components."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from armada.operators import distributions, outages, tables
from armada.sources import layout

START = datetime(2024, 1, 1)
FIELDS = ["kind", "user", "value", "ts", "note"]


def events(spark, count=4000):
    chance = random.Random(1)
    rows = [
        (chance.choice(["a", "a", "b", "c", None]), chance.randint(0, 99), chance.random(), START + timedelta(minutes=chance.randint(0, 9999)), f"n{chance.randint(0, 50)}")
        for _ in range(count)
    ]
    return spark.createDataFrame(rows, "kind string, user int, value double, ts timestamp, note string")


def test_any_field_skips_files(spark, tmp_path):
    df, path = events(spark), str(tmp_path / "curve")
    layout.write_curve(df, path, FIELDS, 48)
    table = spark.read.parquet(path)
    assert sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    asked = {"user": F.lit(7), "value": F.lit(0.31), "ts": F.lit(START + timedelta(minutes=4321)), "note": F.lit("n17")}
    for field, value in asked.items():
        files, touched = layout.files_touched(table, field, value).first()
        assert files > 30 and 4 * touched <= 3 * files, (field, files, touched)


def test_layout_of_little(spark, tmp_path):
    df = events(spark, 3).limit(0)
    layout.write_curve(df, str(tmp_path / "none"), FIELDS, 4)
    same = spark.createDataFrame([("a", 1)] * 50 + [(None, None)], "kind string, user int")
    layout.write_curve(same, str(tmp_path / "same"), ["kind", "user"], 4)
    assert spark.read.parquet(str(tmp_path / "same")).count() == 51
    with pytest.raises(ValueError):
        layout.write_curve(same, str(tmp_path / "x"), ["kind"] * 20, 4)


def test_sketches_merge(spark):
    df = events(spark, 3000).withColumn("value", F.when(F.col("user") % 10 != 0, F.col("value")))
    stored = distributions.segment_sketches(df, ["kind"], "ts", "1 day", F.col("value"), F.col("user"))
    merged = distributions.merged(stored, ["kind"], F.lit(START + timedelta(days=1)), F.lit(START + timedelta(days=4)))
    got = distributions.quantiles(merged, ["kind"], [0.0, 0.25, 0.5, 1.0]).collect()
    pdf = df.toPandas()
    pdf = pdf[(pdf.ts >= START + timedelta(days=1)) & (pdf.ts < START + timedelta(days=4))]
    for row in got:
        own = pdf[pdf.kind.isna()] if row.kind is None else pdf[pdf.kind == row.kind]
        values = own.value.dropna()
        assert row.n == len(values) and abs(row.n_distinct - own.user.nunique()) <= 3
        assert abs((values <= row.value).mean() - row.rank) <= 0.03 or row.value in (values.min(), values.max())
    whole = distributions.merged(stored, [])
    assert whole.first().n == pdf.shape[0] * 0 + df.where("value is not null").count()
    none = distributions.merged(stored, ["kind"], F.lit(START + timedelta(days=99)))
    assert distributions.quantiles(none, ["kind"], [0.5]).count() == 0


def plain_sweep(sessions):
    moments = sorted({t for s in sessions for t in s[1:3]})
    found = [(t, sum(s[1] <= t < s[2] for s in sessions)) for t in moments]
    kept, before = [], 0
    for t, down in found:
        if down != before:
            kept.append((t, down))
        before = down
    return kept


@pytest.mark.parametrize("per_task", [1_000_000, 15])
def test_outages(spark, per_task):
    chance = random.Random(3)
    probes = [
        (chance.choice(["hot", "hot", "b", "c", "d"]), START + timedelta(minutes=chance.randint(0, 3000)), chance.choice([True, False, None])) for _ in range(250)
    ] + [("e", None, False)]
    table = spark.createDataFrame(probes, "target string, ts timestamp, ok boolean").repartition(3)
    sessions = outages.failure_sessions(table, "target", "ts", "ok", "30 minutes")
    rows = sorted(map(tuple, sessions.collect()))
    gap, want = timedelta(minutes=30), []
    for target in "hot b c d".split():
        for ts in sorted(t for k, t, ok in probes if k == target and not ok and t):
            if want and want[-1][0] == target and ts <= want[-1][2]:
                want[-1] = (target, want[-1][1], ts + gap, want[-1][3] + 1)
            else:
                want.append((target, ts, ts + gap, 1))
    assert rows == sorted(want)
    swept = outages.down_at_once(sessions, rows_per_task=per_task).orderBy("at").collect()
    assert [(r.at, r.down) for r in swept] == plain_sweep(rows)
    assert [r.until for r in swept] == [r.at for r in swept[1:]] + [None]
    worst = outages.worst_by(outages.down_at_once(sessions), "1 day").collect()
    assert max(r.most_down for r in worst) == max(r.down for r in swept)
    assert outages.down_at_once(sessions.limit(0)).count() == 0


def test_table_component(spark, monkeypatch):
    class Gaps:
        """Rows a key waited for: state from row to row, several rows or none for one."""

        def __init__(self):
            self.last, self.rows = None, 0

        def process(self, row):
            self.rows += 1
            last, self.last = self.last, row["n"]
            return [(row["k"], i, None) for i in range(last + 1, row["n"])] if last is not None else None

        def finish(self):
            return [(None, None, self.rows)]

    monkeypatch.setattr(tables, "BATCH_ROWS", 7)
    rows = [("a", 1), ("a", 4), ("a", 30), ("b", 2), ("b", 3), ("c", 9), (None, 5), (None, 7)]
    table = spark.createDataFrame(rows, "k string, n int").repartition(3)
    tables.register_component(spark, "gaps", Gaps, "k string, n bigint, total bigint")
    got = tables.apply_table_component(table, "gaps", ["k"], ["n"]).collect()
    missing = sorted((str(r.k), r.n) for r in got if r.n is not None)
    assert missing == sorted([("a", i) for i in [2, 3, *range(5, 30)]] + [("None", 6)])
    assert sorted(r.total for r in got if r.total is not None) == [1, 2, 2, 3]
    table.createOrReplaceTempView("waited")
    assert spark.sql("SELECT count(*) FROM gaps(TABLE(waited) PARTITION BY k ORDER BY n) WHERE n IS NOT NULL").first()[0] == 28
