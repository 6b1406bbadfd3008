"""Rows that share an id or have none, and periodic texts, against the plain version of repeated bytes."""

import hashlib
import random

import numpy as np
import pytest

from armada.llm import repeats
from texts import ordered, plain_repeats, prose


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, tag string, begin int").repartition(parts)


def found(spark, docs):
    return [tuple(r)[:5] for r in repeats.repeated_spans(frame(spark, docs)).collect()]


def test_each_string_has_its_leftmost_least_anchor():
    chance = np.random.default_rng(3)
    for values in (chance.integers(0, 4, 400).astype(np.uint64), chance.integers(0, 1 << 60, 400).astype(np.uint64)):
        for width in (1, 2, 5, 69):
            got = repeats.leftmost_least(values, width)
            assert got.tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]


@pytest.mark.parametrize("most", [400, 1])
def test_rows_without_id_are_told_apart(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    docs = []
    for i in range(150):  # each holds a passage twice, so no two results are alike
        part = prose(1000 + i, 30)
        docs.append((None, f"{part} {prose(5000 + i, 5)} {part}"))
    docs += [((1 << 63) - 1, docs[0][1]), (-(1 << 63), prose(9, 40)), (7, docs[1][1]), (7, prose(10, 60)), (7, prose(11, 60))]
    got = found(spark, docs)
    want = dict(zip(docs, plain_repeats(docs)))
    assert ordered(got) == ordered(want.values())
    whole = [r for r in got if r[0] is None and r[4] == hashlib.sha256(b"").hexdigest()]
    assert len(whole) == 2  # those that a row with an id holds as well


@pytest.mark.parametrize("most, size", [(400, 1_000_000), (2, 300)])
def test_periodic_texts(spark, monkeypatch, most, size):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", size)
    chance = random.Random(most)
    docs = [(1, "a" * 400), (2, "ab" * 150 + "a" * 120), (3, "abc" * 99 + "b"), (4, "x" + "a" * 99), (5, "b" * 100), (6, "b" * 99)]
    for i in range(25):
        unit = "".join(chance.choice("ab") for _ in range(chance.randint(1, 40)))
        text = unit * chance.randint(3, 12)
        at = chance.randrange(len(text))
        docs.append((10 + i, text[:at] + chance.choice(["", "c"]) + text[at:]))
    assert ordered(found(spark, docs)) == ordered(plain_repeats(docs))


def test_frequent_strings_are_told_in_order_without_a_join(spark):
    chance = random.Random(8)
    rows = [(chance.choice([1, 1, 1, 2, 3]), chance.randint(0, 1), d, 0, b, b + p) for d in range(60) for b in (0, 50) for p in chance.sample(range(30), 6)]
    rows += rows[:40]
    least = {}
    for high, low, doc, tag, _, place in rows:
        least[high, low] = min(least.get((high, low), (doc, tag, place)), (doc, tag, place))
    want = {}
    for high, low, doc, tag, context, place in rows:
        if (doc, tag, place) != least[high, low]:
            begin, end = want.get((doc, tag, context), (place, 0))
            want[doc, tag, context] = min(begin, place), max(end, place + repeats.LENGTH)
    size, parts = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    kept = {name: spark.conf.get(name) for name in (size, parts)}
    try:
        spark.conf.set(size, 7)
        for count in (1, 4, 40):
            spark.conf.set(parts, count)
            strings = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in repeats.DIGESTED)).repartition(3)
            spans = repeats.repeats_in_order(strings)
            assert sorted(tuple(r) for r in spans.collect()) == sorted((d, t, b, e) for (d, t, _), (b, e) in want.items())
            assert "Join" not in spans._jdf.queryExecution().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_shared_lengths():
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ab\0", b"abcd"]
    for other in (b"", b"a", b"ab\0", b"abcd", b"ab\0\0"):
        want = [next((i for i, (x, y) in enumerate(zip(k, other)) if x != y), min(len(k), len(other))) for k in keys]
        assert repeats.shared_lengths(keys, other).tolist() == want


def passages(count):
    """Texts of chance words round two passages that all have; every third ends or begins with an edge that few share."""
    first, second = prose(1, 60), prose(2, 60)
    near = [prose(30 + i, 4) for i in range(5)]
    return [
        (i, f"{prose(100 + 2 * i, 20)} {near[i % 5] if i % 3 == 0 else ''}{first}{near[i % 4] if i % 3 == 1 else ''} {prose(101 + 2 * i, 20)}{second}{i}")
        for i in range(count)
    ]


@pytest.mark.parametrize("size", [20_000, 100_000])
def test_contexts_of_frequent_anchors_are_not_made_rows_of_strings(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 20)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", size)
    plain, strings = repeats.repeats_in_order, []
    monkeypatch.setattr(repeats, "repeats_in_order", lambda rows: strings.append(rows.count()) or plain(rows))
    for count in (100, 400):
        docs = passages(count)
        assert ordered(found(spark, docs)) == ordered(plain_repeats(docs))
    assert strings[1] < 400 * 4  # each text has four edges of passages; a row for each string of their contexts makes 83,824
