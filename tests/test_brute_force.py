"""Random inputs against a few lines of plain Python."""

import random
import re

from pyspark.sql import functions as F

from armada.functions import arguments
from armada.operators import drift, health, rendering, scraping, sequences


def test_templates(spark):
    rng = random.Random(11)
    pieces = ['{{ getenv "A" }}', '{{getenv "B"}}', '{{  getenv   "C" }}', '{{ getenv "D" }}', "{{ other }}",
              "{{", "}}", "$1", "\\", "\n", "text ", '{{ getenv "" }}', '"', "{{ getenv A }}"]
    files = [(f"c{i % 5}", i, "".join(rng.choices(pieces, k=rng.randrange(12)))) for i in range(150)]
    env = {(f"c{c}", n): rng.choice(pieces) for c in range(4) for n in "ABC" if rng.random() < 0.7}
    got = rendering.expand_templates(
        spark.createDataFrame(files, "cluster string, i int, body string"),
        spark.createDataFrame([(c, n, v) for (c, n), v in env.items()], "cluster string, name string, value string"),
        "cluster", ["i"],
    )
    pattern = re.compile(r'\{\{\s*getenv\s+"([^"]+)"\s*\}\}')
    want = []
    for cluster, i, body in files:
        def put(m, cluster=cluster):
            return env.get((cluster, m.group(1)), m.group(0))
        missing = sorted({n for n in pattern.findall(body) if (cluster, n) not in env})
        want.append((i, pattern.sub(put, body), missing))
    rows = got.select("i", "body", "unresolved").orderBy("i").collect()
    assert [tuple(r) for r in rows] == want


def test_any_contained(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("abc", k=rng.randrange(1, 14)))) for i in range(200)]
    needles = ["".join(rng.choices("abc", k=rng.randrange(3, 6))) for _ in range(20)]
    want = sorted(i for i, t in texts if any(n in t for n in needles))
    df = spark.createDataFrame(texts, "i int, t string")
    table = spark.createDataFrame([(n,) for n in needles], "text string")
    for found in (
        scraping.any_contained(df, "t", needles),
        scraping.any_contained(df, "t", table),
    ):
        assert sorted(r["i"] for r in found.collect()) == want
    assert 0 < len(want) < 200


def test_overrides(spark):
    rng = random.Random(8)
    words = ["-a", "-b", "-Xmx1g", "-Xmx2g", "-Xms1g", "x"]
    cases = [tuple(rng.choices(words, k=rng.randrange(5)) for _ in range(3)) + (rng.sample(["^-Xmx", "1g$", "b"], rng.randrange(3)),) for _ in range(120)]
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i int, args array<string>, a array<string>, r array<string>, x array<string>")
    got = df.orderBy("i").select(arguments.override_args(F.col("args"), F.col("a"), F.col("r"), F.col("x"))).collect()
    for (args, add, remove, patterns), row in zip(cases, got):
        left = [v for v in args if v not in remove and not any(re.search(p, v) for p in patterns)]
        assert row[0] == left + [v for v in add if v not in left]


def test_drift(spark):
    rng = random.Random(4)
    expected = {(rng.randrange(12), rng.choice("xyz")): str(rng.randrange(3)) for _ in range(40)}
    observed = {(rng.randrange(9), rng.choice("xyz")): str(rng.randrange(3)) for _ in range(30)}
    frame = "name int, field string, value string"
    # Everything is reported three times.
    got = drift.expected_vs_observed(
        spark.createDataFrame([(*k, v) for k, v in expected.items()] * 3, frame),
        spark.createDataFrame([(*k, v) for k, v in observed.items()] * 3, frame), ["name"])
    there = {n for n, _ in observed}
    want = {(n, "missing", None, None, None) for n, _ in expected if n not in there}
    want |= {(n, "mismatch", f, v, observed.get((n, f))) for (n, f), v in expected.items()
             if n in there and observed.get((n, f)) != v}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_health_and_first_group(spark):
    rng = random.Random(9)
    nodes = [(f"c{rng.randrange(30)}", f"n{i}", rng.choice(["CONNECTED"] * 9 + ["LOST"])) for i in range(90)]
    expected = {f"c{i}": sum(c == f"c{i}" for c, _, _ in nodes) + rng.choice([0, 0, 0, 1]) for i in range(33)}
    frame = spark.createDataFrame(nodes, "cluster string, node string, status string")
    verdicts = health.cluster_health(frame, spark.createDataFrame(list(expected.items()), "cluster string, expected_nodes int"))
    blamed = {}
    for r in health.cluster_offenders(frame, verdicts).collect():
        blamed.setdefault(r["cluster"], []).append(r["offender"])
    for r in verdicts.collect():
        own = [(n, s) for c, n, s in nodes if c == r["cluster"]]
        bad = [f"{n}={s}" for n, s in own if s != "CONNECTED"]
        if len(own) != expected[r["cluster"]]:
            assert not r["healthy"] and sorted(blamed.get(r["cluster"], [])) == sorted(f"{n}={s}" for n, s in own)
        else:
            assert r["healthy"] == (not bad) and sorted(blamed.get(r["cluster"], [])) == sorted(bad)

    groups = [(f"c{rng.randrange(20)}", f"g{rng.randrange(100)}", rng.choice([None, 0, 0, 1, 3])) for _ in range(60)]
    groups = list({(c, g): (c, g, n) for c, g, n in groups}.values())
    picked = sequences.pick_first_eligible(
        spark.createDataFrame([(f"c{i}",) for i in range(22)], "cluster string"),
        spark.createDataFrame(groups, "cluster string, role_group string, replicas int"))
    for r in picked.collect():
        own = [(g, n) for c, g, n in groups if c == r["cluster"]]
        names = [g for g, n in sorted(own, key=lambda x: x[0]) if n and n > 0] or [g for g, _ in sorted(own, key=lambda x: x[0])]
        assert r["selected_group"] == (names[0] if names else None)
