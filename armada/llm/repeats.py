"""Removal of byte strings that occur earlier, by threshold-bounded interval expansion.

Every string of LENGTH bytes has one anchor: the least of its 69 hashes of 32 bytes, the leftmost of
equal ones, so equal strings have equal anchors at the same place. Strings side by side with one anchor
are its context. Anchors are sorted by hash and context; equal contexts are settled there: all but the
earliest are repeats as a whole. Contexts that share an anchor but differ meet in one bucket, where a Burrows-Wheeler transform of them is extended backwards,
breadth first: level by level it yields which neighbours of the suffix order differ within the first
l bytes, for l = 1, 2, ... up to LENGTH, where it stops. What is then still together shares LENGTH bytes,
and all but the earliest are repeats.

An anchor with very many different contexts (the edge of a passage in a large part of all texts) would make a bucket that
grows with the input. Its contexts are put in order by the bytes from the anchor on, and buckets are cut from that order:
equal strings lie side by side in it, so only those that the first or last row of a bucket begins with can stand
outside, and of these the earliest of the bucket goes on. A second order, by the bytes before the anchor backwards, does the
same with what is left; the few strings at its edges are compared by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm.common import mixed, staged, tables

LENGTH = 100
ANCHOR = 32
REACH = LENGTH - ANCHOR  # one less than the hashes of a string
MOST_CONTEXTS = 400  # different contexts of an anchor that meet in one bucket
BUCKET_BYTES = 1_000_000
BATCH_BYTES = 4_000_000

REPEAT, LAST, FIRST = 0, 1, 2
DIGESTED = ("high", "low", "doc", "tag", "context", "place")
AROUND = "hash long, doc long, tag long, begin long, left binary, right binary"
ANCHORED = ("hash", "context", "doc", "tag", "begin", "strings")

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 32-byte string, by doubling."""
    found, width = _BYTES[data], 1
    with np.errstate(over="ignore"):
        while width < ANCHOR:
            found = found[:-width] * np.uint64(0x9E3779B97F4A7C15) + found[width:]
            found ^= found >> np.uint64(29)
            found *= np.uint64(0xBF58476D1CE4E5B9)
            found ^= found >> np.uint64(32)
            width *= 2
    return found


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring values, the leftmost of equal ones."""

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    places, done = np.arange(len(values), dtype=np.int32), 1
    while done * 2 <= width:
        places = lesser(places[:-done], places[done:])
        done *= 2
    rest = width - done
    return lesser(places[:-rest], places[rest:]) if rest else places


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of strings with one anchor: first string, number of strings, anchor and its hash."""
    hashes = anchor_hashes(data)
    own = leftmost_least(hashes, REACH + 1)
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return begins, np.diff(begins, append=len(own)), own[begins], hashes[own[begins]]


def anchored(texts: DataFrame) -> DataFrame:
    """Rows (hash, context, doc, tag, begin, strings) of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES):
            found: list[list[np.ndarray]] = [[] for _ in ANCHORED]
            for text, doc, tag in zip(*(batch.column(n).to_pylist() for n in ("text", "doc", "tag"))):
                raw = text.encode()
                if len(raw) < LENGTH:
                    continue
                begins, strings, places, hashes = anchors(np.frombuffer(raw, np.uint8))
                own = [
                    xxhash.xxh64_intdigest(raw[begin:end], seed=seed) - (1 << 63)
                    for begin, end, seed in zip(begins.tolist(), (begins + strings + (LENGTH - 1)).tolist(), (places - begins).tolist())
                ]
                same = [np.full(len(begins), x, dtype=np.int64) for x in (doc, tag)]
                for column, values in zip(found, (hashes.view(np.int64), np.array(own, dtype=np.int64), *same, begins, strings)):
                    column.append(values)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=list(ANCHORED))

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in ANCHORED))


def settled(rows: DataFrame) -> DataFrame:
    """Rows with ``kind``: 1 repeats an earlier equal context as a whole, 0 may share more.

    Ranges are cut by hash, context, doc, tag and begin, so no anchor is too frequent for one task. The first
    row of a context in each range stays open; anchors seen once, away from the edges, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        before = None
        opening = True

        def kept(rows, last):
            nonlocal before, opening
            h, c = rows["hash"], rows["context"]
            up = np.concatenate([[before is not None and before[0] == h[0]], h[1:] == h[:-1]])
            repeat = np.concatenate([[before is not None and before[:2] == (h[0], c[0])], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
            own = np.stack([rows[n] for n in ("doc", "tag", "begin")])
            equal = repeat & np.concatenate([[before is not None and before[2] == tuple(own[:, 0])], (own[:, 1:] == own[:, :-1]).all(axis=0)])
            down = np.concatenate([up[1:], [last]])
            choose = up | down
            if opening:
                choose |= h == h[0]
            if last:
                choose |= h == h[-1]
            choose &= ~equal  # the same row again
            before, opening = (h[-1], c[-1], tuple(own[:, -1])), False
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[n][choose]) for n in ANCHORED] + [pa.array(repeat[choose].astype(np.int32))],
                names=[*ANCHORED, "kind"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch.column(n).to_numpy() for n in ANCHORED}
            if held is not None:
                new = {n: np.concatenate([held[n], new[n]]) for n in ANCHORED}
            if len(new["hash"]) > 1:
                yield kept({n: v[:-1] for n, v in new.items()}, bool(new["hash"][-1] == new["hash"][-2]))
            held = {n: v[-1:] for n, v in new.items()}
        if held is not None:
            yield kept(held, True)

    order = ("hash", "context", "doc", "tag", "begin")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, ", ".join(f"{n} long" for n in ANCHORED) + ", kind int")


def same_strings(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text, where in it, and the class of each string of ``length`` bytes in the texts.

    Suffixes are sorted by their first bytes, eight and then by doubling. The sort itself shows which
    neighbours differ within the widest doubling below ``length``; from there on neighbours are told
    apart level by level by backward extension: of two rows next to each other among those with one
    preceding byte, the extended ones differ within l + 1 bytes iff a border of level l lies between
    the rows. Everything is cyclic, as the transform is; strings over the end of a text are left out,
    so one sign can end all of them.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    total = len(joined)
    padded = np.resize(joined, total + 7).astype(np.uint64)
    key = np.zeros(total, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + total]
    width, level, shallow = 8, 0, None
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        fresh = np.concatenate([[False], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(total, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        if width >= length:
            break
        level, shallow = width, rank
        key = (rank * (int(rank.max()) + 1) + np.roll(rank, -width)).view(np.uint64)
        width *= 2
    preceding = joined[order - 1]
    extended = np.argsort(preceding, kind="stable")  # row m of the order comes from row extended[m]
    before = shallow[order] if level else np.zeros(total, dtype=np.int64)
    border = np.concatenate([[True], before[1:] != before[:-1]])
    first = np.concatenate([[True], preceding[extended[1:]] != preceding[extended[:-1]]])
    border |= first
    open_ = np.flatnonzero(~border)
    low, high = extended[open_ - 1], extended[open_]
    for _ in range(max(level, 1), length):
        sums = np.cumsum(border, dtype=np.int32)
        apart = sums[high] > sums[low]
        if apart.any():
            border[open_[apart]] = True
            open_, low, high = open_[~apart], low[~apart], high[~apart]
    classes = np.empty(total, dtype=np.int64)
    classes[order] = np.cumsum(border)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    closing = np.cumsum(sizes + 1) - 1
    inside = np.arange(total) - np.repeat(closing - sizes, sizes + 1)
    whole = inside + length <= np.repeat(sizes, sizes + 1)
    return owner[whole], inside[whole], classes[whole]


def later(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks all but the earliest (doc, tag, place) of each class; equal places are one."""
    order = np.lexsort((place, tag, doc, classes))
    starts = np.append(True, classes[order[1:]] != classes[order[:-1]])[: len(order)]
    lead = order[np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))]
    marks = np.empty(len(order), dtype=bool)
    marks[order] = np.any([x[order] != x[lead] for x in (doc, tag, place)], axis=0)
    return marks


def runs(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strings that start at the places, merged to (doc, tag, begin, end) spans."""
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    if not len(doc):
        return doc, tag, place, place
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + LENGTH)
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], tag[new], place[new], place[ends] + LENGTH


def _spans(doc, tag, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (doc, tag, begin, end)], names=["doc", "tag", "begin", "end"]
    )


SPANS = "doc long, tag long, begin long, end long"


def compared(contexts: DataFrame) -> DataFrame:
    """Spans of strings that occur earlier, within buckets of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def bucket(rows):
            texts = [r[4] for r in rows]
            owner, inside, classes = same_strings(texts)
            doc = np.array([r[1] for r in rows], dtype=np.int64)[owner]
            tag = np.array([r[2] for r in rows], dtype=np.int64)[owner]
            place = np.array([r[3] for r in rows], dtype=np.int64)[owner] + inside
            marks = later(doc, tag, place, classes)
            return _spans(*runs(doc[marks], tag[marks], place[marks]))

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("hash", "doc", "tag", "begin", "bytes"))):
                if size >= BUCKET_BYTES and held[-1][0] != row[0]:
                    yield bucket(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield bucket(held)

    return contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, SPANS)


def around_anchors(contexts: DataFrame) -> DataFrame:
    """Contexts as the bytes before their anchor, backwards (``left``), and those from the anchor on (``right``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 16):
            data = batch.column("bytes").to_pylist()
            hashes = anchor_hashes(np.frombuffer(b"".join(data), np.uint8))
            left, right, at = [], [], 0
            for d in data:
                place = int(hashes[at : at + len(d) - ANCHOR + 1].argmin())  # it is in all strings, and the least of each
                left.append(d[:place][::-1])
                right.append(d[place:])
                at += len(d)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("hash", "doc", "tag", "begin")), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["hash", "doc", "tag", "begin", "left", "right"],
            )

    return contexts.select("hash", "doc", "tag", "begin", "bytes").mapInArrow(run, AROUND)


def shared_lengths(keys: list[bytes], other: bytes) -> np.ndarray:
    """How many first bytes each key has in common with the other one."""
    width = len(other)
    if not width:
        return np.zeros(len(keys), dtype=np.int64)
    rows = np.frombuffer(b"".join(k[:width].ljust(width, b"\0") for k in keys), np.uint8).reshape(len(keys), width)
    alike = np.logical_and.accumulate(rows == np.frombuffer(other, np.uint8), axis=1).sum(axis=1)
    return np.minimum(alike, [len(k) for k in keys])


def sliced(contexts: DataFrame, side: str) -> DataFrame:
    """Rows of ``around_anchors`` that may be repeated outside their bucket, and spans known to repeat (both sides null).

    Rows are put in order by anchor and side, and buckets are cut where they are full, so no anchor is too
    frequent. Strings of one anchor that are equal share its bytes of the side as well: the rows with these bytes are
    neighbours, and unless the first or the last row of the bucket is one of them, all are inside.
    """
    other = "left" if side == "right" else "right"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, left_open = 0, True

        def bucket(rows, left_open, right_open):
            hashes, docs, tags, begins = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
            lefts, rights = [r[4] for r in rows], [r[5] for r in rows]
            owner, inside, classes = same_strings([a[::-1] + b for a, b in zip(lefts, rights)])
            doc, tag, place = docs[owner], tags[owner], begins[owner] + inside
            marks = later(doc, tag, place, classes)
            repeated = runs(doc[marks], tag[marks], place[marks])
            keys = lefts if side == "left" else rights
            reach = np.full(len(rows), -1, dtype=np.int64)
            for at, is_open in ((0, left_open), (-1, right_open)):
                if is_open:
                    reach = np.where(hashes == hashes[at], np.maximum(reach, shared_lengths(keys, keys[at])), reach)
            # Strings start this many bytes before their anchor; of the side they hold that many, or the rest.
            rest = np.flatnonzero(~marks)
            before = np.array([len(x) for x in lefts], dtype=np.int64)[owner[rest]] - inside[rest]
            may = (before if side == "left" else LENGTH - before) <= reach[owner[rest]]
            rest, before = rest[may], before[may]
            # What is left of a context is one row for each run of strings.
            new = np.flatnonzero(np.append(True, (owner[rest[1:]] != owner[rest[:-1]]) | (inside[rest[1:]] != inside[rest[:-1]] + 1))[: len(rest)])
            last = np.append(new[1:], len(rest))[: len(new)] - 1
            firsts, lasts = rest[new], rest[last]
            of = owner[firsts].tolist()
            count = len(repeated[0])
            columns = [
                np.concatenate([np.zeros(count, dtype=np.int64), hashes[of]]),
                np.concatenate([repeated[0], docs[of]]),
                np.concatenate([repeated[1], tags[of]]),
                np.concatenate([repeated[2], place[firsts]]),
            ]
            kept = [
                [None] * count + [lefts[i][:n] for i, n in zip(of, before[new].tolist())],
                [None] * count + [rights[i][: LENGTH - n] for i, n in zip(of, before[last].tolist())],
            ]
            end = np.concatenate([repeated[3], place[lasts] + LENGTH])
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), *(pa.array(c, pa.binary()) for c in kept), pa.array(end, pa.int64())],
                names=["hash", "doc", "tag", "begin", "left", "right", "end"],
            )

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("hash", "doc", "tag", "begin", "left", "right"))):
                if size >= BUCKET_BYTES:
                    same = held[-1][0] == row[0]
                    yield bucket(held, left_open, same)
                    held, size, left_open = [], 0, same
                held.append(row)
                size += len(row[4]) + len(row[5])
        if held:
            yield bucket(held, left_open, True)

    order = ("hash", side, other)
    return contexts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{AROUND}, end long")


def frequent(contexts: DataFrame) -> DataFrame:
    """Spans of strings that occur earlier, for anchors with very many contexts."""
    spans, rest = None, around_anchors(contexts)
    for side in ("right", "left"):
        found = staged(sliced(rest, side), f"sliced-{side}")
        own = found.where("left is null").select("doc", "tag", "begin", "end")
        spans = own if spans is None else spans.union(own)
        rest = found.where("left is not null").drop("end")
    return spans.union(digested(rest))


def window_digests(rows: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the strings of LENGTH bytes in each row of a byte matrix."""
    found, widths = _BYTES[rows] ^ mixed(np.array([seed], dtype=np.uint64))[0], {}

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a * np.uint64(0x9E3779B97F4A7C15) + b
        both ^= both >> np.uint64(29)
        both *= np.uint64(0xBF58476D1CE4E5B9)
        both ^= both >> np.uint64(32)
        return both

    width = 1
    with np.errstate(over="ignore"):
        while width <= LENGTH:
            widths[width] = found
            if 2 * width <= LENGTH:
                found = joined(found[:, :-width], found[:, width:])
            width *= 2
        done, total = 0, None
        strings = rows.shape[1] - LENGTH + 1
        for width in sorted(widths, reverse=True):
            if LENGTH - done >= width:
                part = widths[width][:, done : done + strings]
                total = part if total is None else joined(total, part)
                done += width
    return total


def digested(contexts: DataFrame) -> DataFrame:
    """The same for what two orders of ``frequent`` leave: the least (doc, place) of each string's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 16):
            data = [a[::-1] + b for a, b in zip(*(batch.column(n).to_pylist() for n in ("left", "right")))]
            sizes = np.array([len(d) for d in data])
            named = [batch.column(n).to_numpy() for n in ("doc", "tag", "begin")]
            for size in np.unique(sizes):
                same = np.flatnonzero(sizes == size)
                rows = np.frombuffer(b"".join(data[i] for i in same), np.uint8).reshape(len(same), size)
                strings = int(size) - LENGTH + 1
                high, low = (window_digests(rows, seed).view(np.int64).ravel() for seed in (1, 2))
                doc, tag, begin = (np.repeat(n[same], strings) for n in named)
                place = begin + np.tile(np.arange(strings), len(same))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (high, low, doc, tag, begin, place)], names=list(DIGESTED))

    strings = staged(contexts.mapInArrow(run, ", ".join(f"{n} long" for n in DIGESTED)), "strings")
    return repeats_in_order(strings)


def repeats_in_order(strings: DataFrame) -> DataFrame:
    """Spans of all but the earliest string of each digest, one per context.

    Ranges are cut by digest and place, so no string is too frequent for one task; which string comes before
    a range is known from the first and last row of each, and nothing is joined to the strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = first = None
        part = TaskContext.get().partitionId()

        def rows(found: dict[str, np.ndarray], edge: int) -> pa.RecordBatch:
            count = len(found["high"])
            numbers = [pa.array(found[n], pa.int64()) for n in DIGESTED]
            return pa.RecordBatch.from_arrays(
                [*numbers, pa.array([edge] * count, pa.int32()), pa.array([part] * count, pa.int32())], names=[*DIGESTED, "edge", "part"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch.column(n).to_numpy() for n in DIGESTED}
            last = {n: v[-1:].copy() for n, v in new.items()}
            digest = np.stack([new["high"], new["low"]])
            if before is None:
                first = tuple(int(new[n][0]) for n in DIGESTED)
                yield rows({n: v[:1] for n, v in new.items()}, FIRST)
                before = tuple(int(new[n][0]) for n in ("high", "low"))
                lead = first[2:4] + first[5:]
            # The earliest string of the digest at the beginning of the batch, and of each that begins in it.
            starts = np.concatenate([[(int(digest[0, 0]), int(digest[1, 0])) != before], (digest[:, 1:] != digest[:, :-1]).any(axis=0)])
            leads = np.stack([new[n] for n in ("doc", "tag", "place")])
            at = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
            held = np.where(at >= 0, leads[:, at], np.array(lead, dtype=np.int64)[:, None])
            later = (leads != held).any(axis=0)
            if later.any():
                yield rows({n: v[later] for n, v in new.items()}, REPEAT)
            before, lead = (int(digest[0, -1]), int(digest[1, -1])), tuple(int(x) for x in held[:, -1])
        if before is not None:
            yield rows(last, LAST)

    order = ("high", "low", "doc", "tag", "place")
    ranged = strings.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{n} long" for n in DIGESTED) + ", edge int, part int"
    marked = staged(ranged.mapInArrow(run, kinds), "digests")
    # Two rows a range: a first row is a repeat when a range before ends with its digest, at another place.
    by_digest = Window.partitionBy("high", "low").orderBy("part", F.desc("edge")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("doc", "tag", "place")
    edges = marked.where(F.col("edge") != REPEAT).withColumn("least", F.min(F.when(F.col("edge") == LAST, place)).over(by_digest))
    found = ("doc", "tag", "context", "place")
    firsts = edges.where((F.col("edge") == FIRST) & (F.col("least") != place)).select(*found)
    # Strings of one context overlap, so what is repeated of it is one span.
    return marked.where(F.col("edge") == REPEAT).select(*found).union(firsts).groupBy("doc", "tag", "context").agg(
        F.min("place").alias("begin"), (F.max("place") + LENGTH).alias("end")
    ).select("doc", "tag", "begin", "end")


def packed(texts: DataFrame) -> DataFrame:
    """Rows (doc, tag, packed): the bytes of each text, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in tables(batches, BATCH_BYTES):
            stored = [press.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(stored, pa.binary())], names=["doc", "tag", "packed"]
            )

    return texts.select("text", "doc", "tag").mapInArrow(run, "doc long, tag long, packed binary")


def cut_contexts(open_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (hash, contexts, doc, tag, begin, bytes) of the open anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 4):
            out = [[] for _ in range(6)]
            for doc, tag, stored, found in zip(*(batch.column(n).to_pylist() for n in ("doc", "tag", "packed", "found"))):
                raw = zstandard.decompress(stored)
                for row in found:
                    begin = row["begin"]
                    data = raw[begin : begin + row["strings"] + LENGTH - 1]
                    for column, value in zip(out, (row["hash"], row["contexts"], doc, tag, begin, data)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())],
                names=["hash", "contexts", "doc", "tag", "begin", "bytes"],
            )

    per_text = open_rows.groupBy("doc", "tag").agg(F.collect_list(F.struct("hash", "begin", "strings", "contexts")).alias("found"))
    joined = texts.join(per_text, ["doc", "tag"]).select("doc", "tag", "packed", "found")
    return joined.mapInArrow(run, "hash long, contexts long, doc long, tag long, begin long, bytes binary")


def removed(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (doc, tag, n_removed, n_spans, kept_sha256, spans) of texts with spans."""
    out = "doc long, tag long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 4):
            rows = []
            for doc, tag, stored, found in zip(*(batch.column(n).to_pylist() for n in ("doc", "tag", "packed", "found"))):
                raw = zstandard.decompress(stored)
                merged: list[list[int]] = []
                for begin, end in sorted((s["begin"], s["end"]) for s in found):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                rest, at = hashlib.sha256(), 0
                for begin, end in merged:
                    rest.update(raw[at:begin])
                    at = end
                rest.update(raw[at:])
                rows.append((doc, tag, sum(e - b for b, e in merged), len(merged), rest.hexdigest(), [{"begin": b, "end": e} for b, e in merged]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc", "tag", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    per_text = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    return texts.join(per_text, ["doc", "tag"]).select("doc", "tag", "packed", "found").mapInArrow(run, out)


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte is removed when a string of LENGTH bytes that covers it starts earlier too: in a smaller
    doc_id or in the same document. Null texts count as empty. Rows of one id and text are one
    document and get the same result; different texts under one id follow each other in the order of
    a hash; rows without id come last. An empty table gives none; other columns are ignored.
    """
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    # A hash of the text tells rows of one id apart; its sign puts those without id after all others.
    sign = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(-(1 << 63)))
    rows = rows.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(sign))
    long_rows = rows.where(F.octet_length("text") >= LENGTH)
    found = staged(anchored(long_rows.select("text", "doc", "tag")), "found-anchors")
    marked = staged(settled(found), "anchors")

    place = F.struct("doc", "tag", "begin", "strings")
    least = marked.where("kind = 0").groupBy("hash", "context").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    least = staged(least, "contexts")
    counts = least.groupBy("hash").agg(F.count("*").alias("contexts")).where("contexts > 1")
    open_rows = least.join(counts, "hash").select("hash", "least.*", "contexts")
    others = marked.where("kind = 0").join(
        least.where("n > 1").select("hash", "context", "least"), ["hash", "context"]
    ).where(place != F.col("least"))
    repeated = ("doc", "tag", "begin", (F.col("begin") + F.col("strings") + (LENGTH - 1)).alias("end"))
    whole = marked.where("kind = 1").select(*repeated).union(others.select(*repeated))

    stored = packed(long_rows)
    cut = staged(cut_contexts(open_rows, stored), "open")
    many = F.col("contexts") > MOST_CONTEXTS
    spans = staged(whole.union(compared(cut.where(~many))).union(frequent(cut.where(many))), "spans")
    found = removed(spans, stored).dropDuplicates(["doc", "tag"])
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    slim = rows.select(
        "doc_id", "doc", "tag", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
    )
    return slim.join(found, ["doc", "tag"], "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )
