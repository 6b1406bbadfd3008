"""Hard negatives against a plain version, with ties, repeats, odd vectors and many stripes."""

import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from armada.llm import negatives
from texts import ordered


def plain_negatives(rows, positives=5, most=10):
    usable = [
        (i, label, [int((256 * x) // 1) for x in vector]) for i, vector, label in rows
        if label is not None and vector is not None and all(x is not None and abs(x) < float("inf") for x in vector)
    ]
    last = lambda i: (i is None, i or 0)
    found = []
    for at, (i, label, v) in enumerate(usable):
        if i is None or i % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, own) for k, (j, own, w) in enumerate(usable) if k != at]
        scores.sort(key=lambda r: (-r[0], last(r[1])))
        for s, j, _ in [r for r in scores if r[2] == label][:positives]:
            inside = [(t, k) for t, k, own in scores if own != label and 30 * s <= 100 * t <= 90 * s][:most]
            found += [(i, j, n, k, s, t) for n, (t, k) in enumerate(inside, 1)]
    return found


def vectors(seed, count, width, spread=0.3):
    chance = random.Random(seed)
    middles = [[chance.gauss(0, spread) for _ in range(width)] for _ in range(6)]
    return [[float(f"{m + chance.gauss(0, spread):.3f}") for m in chance.choice(middles)] for _ in range(count)]


def frame(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, stripe string")
    return table.repartition(parts)


def mined(table):
    return [tuple(r) for r in negatives.hard_negatives(table, F.col("vec_id") % 100 == 0).collect()]


@pytest.mark.parametrize("width, least, parallel", [(64, 1 << 16, 2), (20, 64, 9), (3, 16, 9)])
def test_hard_negatives(spark, monkeypatch, width, least, parallel):
    monkeypatch.setattr(negatives, "LEAST_STRIPE", least)
    monkeypatch.setattr(negatives, "TASKS_PER_CORE", parallel)
    chance = random.Random(width)
    rows = [(20 * i, v, chance.choice([0, 0, 0, 1, 2])) for i, v in enumerate(vectors(width, 300, width))]
    rows += [(5000 + i, rows[0][1], i % 2) for i in range(60)]  # ties with the first anchor
    rows += [rows[5], rows[5], (None, rows[5][1], 0), (None, rows[7][1], 1), (100, rows[0][1], 0)]
    rows += [(900, None, 1), (1000, rows[3][1], None), (7001, [float("nan")] * width, 1), (7002, [None] * width, 0)]
    rows += [(7003, [float("inf")] * width, 2), (7004, [], 1), (8000, [], 0), (7005, rows[9][1][:2], 1), (7006, [3000.0] * width, 1), (7100, [0.0] * width, 2)]
    assert ordered(mined(frame(spark, rows))) == ordered(plain_negatives(rows))


def test_hard_negatives_of_little(spark):
    assert mined(frame(spark, [(0, [1.0], 1)]).limit(0)) == []
    assert mined(frame(spark, [(0, [1.0, 2.0], 1), (3, [2.0, 1.0], 2)])) == []
    assert mined(frame(spark, [(0, [1.0], 1), (3, [2.0], 1), (5, [1.0], 2)])) == [(0, 3, 1, 5, 131072, 65536)]


def test_bounds_hold(spark):
    rows = vectors(8, 60, 48)
    table = frame(spark, [(i, v, 0) for i, v in enumerate(rows)])
    stored, width = negatives.stored(table, F.lit(True), "vec_id", "embedding", "label", 256)
    batch = stored.toArrow().combine_chunks().to_batches()[0]
    columns = {"row": batch.column("row").to_numpy(), "id": batch.column("id").to_numpy(), "label": batch.column("label").to_numpy()}
    for name, kind, size in (("vector", "<i8", width), ("means", "<f4", 16), ("deviations", "<f4", 16)):
        columns[name] = negatives.matrix(batch.column(name), kind, size)
    stripe = negatives.Stripe([columns], width)


    every = np.arange(len(rows))
    for i in every:
        anchor = {"levels": [(m[i : i + 1], d[i : i + 1]) for m, d in stripe.levels], "norm": stripe.norms[i]}
        exact = stripe.exact(every, stripe.vectors[i])
        for level in range(3):
            below, above = stripe.bounds(level, every, anchor)
            assert (below <= exact).all() and (exact <= above).all()
