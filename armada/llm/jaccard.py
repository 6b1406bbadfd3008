"""Similarity join on word shingles: size-banded tiles, bitmap signatures, exact intersection.

Equal sets are one class from the start. Of each class a few shingles become keys: in any one common
order, sets as similar as asked share at least COMMON of their first n - ceil(threshold * n) + COMMON
shingles. The order puts shingles of rare words first and shingles found in many texts last, as a
bounded sample shows them; it decides how many keys are shared by chance, not what is found. Rows of a key are a tile, ordered by size, and only
pairs inside the size band can match.

Three passes keep large groups of near copies linear in rows. The first compares neighbours of each tile
only and joins what is LOOSE or more alike to groups. The second takes tiles that still hold two groups,
cuts long ones into blocks, and compares all pairs across groups inside the band: a parity signature of
a bit for each one or two shingles gives a lower bound on the elements not shared, hence an upper bound on
the overlap, and what may still match is settled by intersecting the sorted arrays. Pairs that share a
passage alone are as many as the square of its texts, so they must fall by the signature: texts travel for
the others only. What matches joins groups, so every
link is inside one group. The third cuts the classes of each group into blocks; each two blocks meet
once, and all their overlaps come from one product of matrices. Of a block come, for each class, its
number of links and one class that it is connected with, so the pairs of a group are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import WORD, Scratch, gram_hashes, lower_ascii, share_of, staged, tables
from armada.llm.components import components

COMMON = 3
CELLS = 256  # of a signature, at least
WORDS_IN_TILE = 32  # 64-bit words of a signature in the rows of tiles, at most
SAMPLE = 4000  # texts from which frequent words and shingles are estimated; they only set the order
FREQUENT = 8  # texts of the sample that hold a frequent shingle
FREQUENT_WORD = 8  # times a word of the sample is found to be told from rare ones
WORDS_KNOWN = 50_000
TILE = 1000  # rows of one block of a tile
BATCH_BYTES = 4_000_000
MOST_WORDS = 100_000
BLOCK_SHINGLES = 1_000_000  # shingles of one block of a component, about
LOOSE = 50  # percent of likeness that makes neighbours of a tile one group
COLUMNS = 1024  # shingles that are multiplied at a time


class Hashes(dict):
    """Word hashes, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_KNOWN = Hashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle, none make none."""
    return weighed_shingles(text, n, {})[0]


def weighed_shingles(text: str | None, n: int, levels: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same, and with each the sum of the levels of its words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = min(n, len(words))
    hashes = np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    found = gram_hashes(hashes, n, seed=n)
    if not levels:
        return np.unique(found), np.zeros(0, dtype=np.int64)
    get = levels.get
    sums = np.concatenate([[0], np.cumsum(np.array([get(w, 0) for w in words], dtype=np.int64))])
    found, first = np.unique(found, return_index=True)
    return found, (sums[n:] - sums[:-n])[first]


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def signature(found: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of CELLS cells, or as many as the power of two up to the size of the set."""
    cells = max(CELLS, 1 << len(found).bit_length() >> 1)
    counts = np.bincount((found >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(counts.astype(np.uint8)).view("<i8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures along the last axis in that many words, if they have more: cells that fall together add up."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def unpacked(column: pa.ListArray) -> list[np.ndarray]:
    """The signatures of a column."""
    ends = np.cumsum(pc.list_value_length(column).to_numpy())
    return np.split(column.flatten().to_numpy().view(np.uint64), ends[:-1])


def frequencies(texts: DataFrame, n: int) -> tuple[np.ndarray, dict[bytes, int]]:
    """From a bounded sample: frequent shingles, most frequent last, and the level of frequent words."""
    total = texts.count()
    if not total:
        return np.zeros(0, dtype=np.uint64), {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, n).view(np.int64))], names=["shingle"])

    sample = texts.where(F.col("text").isNotNull() & (share_of(F.col("text"), "frequent") < SAMPLE / total))
    sample = staged(sample.select("text").distinct(), "sample")
    counts = (
        sample.mapInArrow(run, "shingle long").groupBy("shingle")
        .agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy("n", "shingle").collect()
    )
    words = (
        sample.select(F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_WORD)
        .orderBy(F.desc("n"), "word").limit(WORDS_KNOWN).collect()
    )
    levels = {r["word"].encode(): int(r["n"]).bit_length() for r in words}
    return np.array([r["shingle"] for r in counts], dtype=np.int64).view(np.uint64), levels


def described(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (doc_id, size, id, keys, bits); id is a hash of the whole set, null for an empty one."""
    last, levels = frequencies(texts, n)
    order = np.argsort(last)
    last_sorted = last[order]

    def keys(found: np.ndarray, sums: np.ndarray) -> np.ndarray:
        size = len(found)
        if 100 * size < percent * (size + 1):
            return found[:0]  # so small that only equal sets match
        wanted = min(size, size - least_overlap(size, percent) + COMMON)
        rank = np.zeros(size, dtype=np.int64)
        if len(last_sorted):
            at = np.minimum(np.searchsorted(last_sorted, found), len(last_sorted) - 1)
            rank = np.where(last_sorted[at] == found, order[at] + 1, 0)
        return found[np.lexsort((found, sums, rank))[:wanted]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES):
            sizes, ids, first, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, sums = weighed_shingles(text, n, levels)
                sums = sums if levels else np.zeros(len(found), dtype=np.int64)
                sizes.append(len(found))
                ids.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                first.append(keys(found, sums).view(np.int64))
                bits.append(signature(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                    pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["doc_id", "size", "id", "keys", "bits"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, size long, id long, keys array<bigint>, bits array<bigint>")


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, size, id, previous) that share their tile with another in the size band.

    ``previous`` is the row before in the tile, when it is in the band. Ranges are cut by key, size and
    id, so a tile of any length is spread, and copies of a row fall together and count once. In order of
    size the nearest row of a tile is next to it. Rows of the tiles at the edges of a range are kept in
    any case, for these may go on in the next range.
    """
    names = ("key", "size", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, opening = None, None, None  # rows held back; the row before them; the first key

        def kept(rows, following):
            """Rows that stay, given the row before and the one that follows (None at the end)."""
            nonlocal before, opening
            own = [np.concatenate([[x if before is None else before[i]], rows[n], [x if following is None else following[i]]])
                   for i, (n, x) in enumerate(zip(names, (0, 0, 0)))]
            key, size, ids = own
            near = (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])
            near[0] &= before is not None
            near[-1] &= following is not None
            opening = rows["key"][0] if opening is None else opening
            choose = near[:-1] | near[1:] | (rows["key"] == opening)
            if following is None:
                choose |= rows["key"] == rows["key"][-1]
            before = tuple(rows[n][-1] for n in names)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(rows[n][choose]) for n in names), pa.array(ids[:-2][choose], mask=~near[:-1][choose])],
                names=[*names, "previous"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch.column(n).to_numpy() for n in names}
            if held is not None:
                new = {n: np.concatenate([held[n], new[n]]) for n in names}
            different = np.ones(len(new["id"]), dtype=bool)
            different[1:] = (new["key"][1:] != new["key"][:-1]) | (new["id"][1:] != new["id"][:-1])
            new = {n: v[different] for n, v in new.items()}
            if len(new["id"]) > 1:
                yield kept({n: v[:-1] for n, v in new.items()}, tuple(new[n][-1] for n in names))
            held = {n: v[-1:] for n, v in new.items()}
        if held is not None:
            yield kept(held, None)

    ranged = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    return ranged.select(*names).mapInArrow(run, "key long, size long, id long, previous long")


def in_band(small, large, percent: int):
    return 100 * small >= percent * large


def may_match(total, apart, percent: int):
    """Whether sets of that total size, whose signatures differ in ``apart`` cells, may overlap enough."""
    return (100 + percent) * (total - apart) >= 2 * percent * total


def cells_apart(bits: list[np.ndarray]):
    """For signatures in an order in which their widths ascend inside tiles: a function of a row and the end of those
    that follow it in its tile, which gives the numbers of cells in which it differs from each of these."""
    words = np.array([len(x) for x in bits])
    number = np.zeros(len(bits), dtype=np.int64)  # of a row, among those of its width
    held = {}
    for width in np.unique(words).tolist():
        rows = np.flatnonzero(words == width)
        number[rows] = np.arange(len(rows))
        held[width, width] = np.stack([bits[i] for i in rows])

    def apart(i: int, end: int) -> np.ndarray:
        width, at, found = int(words[i]), i + 1, []
        while at < end:
            wide = int(words[at])
            stop = end if words[end - 1] == wide else at + int(np.searchsorted(words[at:end], wide, side="right"))
            if (wide, width) not in held:
                held[wide, width] = folded(held[wide, wide], width)
            others = held[wide, width][number[at] : number[at] + stop - at]
            found.append(np.bitwise_count(others ^ bits[i]).sum(axis=1).astype(np.int64))
            at = stop
        return found[0] if len(found) == 1 else np.concatenate(found)

    return apart


def tile_pairs(rows: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may match, by block of a tile.

    Rows are (key, size, id, label), signs (id, bits). A tile of more than TILE rows is cut into blocks by
    id, and each two blocks meet once; no pair of one component is looked at. As a row stands in many tiles,
    it has the signature in WORDS_IN_TILE words only.
    """
    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = [folded(x, WORDS_IN_TILE).view(np.int64) for x in unpacked(batch.column("bits"))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits, pa.list_(pa.int64()))], names=["id", "bits"])

    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    cut = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "size", "id", "label",
    )
    dealt = dealt.join(signs.select("id", "bits").mapInArrow(shorter, "id long, bits array<bigint>"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch | None:
            take = lambda n: table.column(n).to_numpy()
            size, ids, label, own = take("size"), take("id"), take("label"), take("own")
            low, high = take("low"), take("high")
            tile = np.concatenate([[0], np.flatnonzero((take("key")[1:] != take("key")[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1, [len(ids)]])
            apart = cells_apart([x for chunk in table.column("bits").chunks for x in unpacked(chunk)])
            ends = np.repeat(tile[1:], np.diff(tile))
            found_a, found_b = [], []
            for i in range(len(ids) - 1):
                end = ends[i]
                if i + 1 >= end:
                    continue
                end = i + 1 + int(np.searchsorted(size[i + 1 : end], 100 * size[i] // percent, side="right"))
                others = slice(i + 1, end)
                wanted = label[others] != label[i]
                if low[i] != high[i]:
                    wanted &= own[others] != own[i]
                if not wanted.any():
                    continue
                wanted &= may_match(size[others] + size[i], apart(i, end), percent)
                hits = ids[others][wanted]
                found_a.append(np.full(len(hits), ids[i]))
                found_b.append(hits)
            if not found_a:
                return None
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def finished(last: bool):
            """Whole tiles out of the held rows; the last tile waits unless all rows are there."""
            nonlocal held
            table = pa.Table.from_batches(held)
            cut = table.num_rows
            if not last:
                columns = [table.column(n).to_numpy() for n in ("key", "low", "high")]
                other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
                cut = int(other[-1]) + 1 if len(other) else 0
            held = table.slice(cut).to_batches()
            return pairs(table.slice(0, cut).combine_chunks()) if cut else None

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if (found := finished(False)) is not None:
                    yield found
        if held and (found := finished(True)) is not None:
            yield found

    tiled = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "size", "id")
    return tiled.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets, sorted arrays of hashes, are ``percent`` alike.

    Compressed texts travel, as they are several times smaller than their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 4):
            known: dict[int, np.ndarray] = {}

            def found(name: int, packed: bytes) -> np.ndarray:
                if name not in known:
                    known[name] = shingles(zstandard.decompress(packed).decode(), n)
                return known[name]

            good = []
            for x, y, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                one, two = found(x, left), found(y, right)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    first = sets.select(F.col("id").alias("a"), F.col("packed").alias("left"))
    second = sets.select(F.col("id").alias("b"), F.col("packed").alias("right"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long, good boolean").where("good").select("a", "b")


def bounded(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs of the size band that the signatures do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES):
            total = batch.column("sa").to_numpy() + batch.column("sb").to_numpy()
            sides = zip(unpacked(batch.column("ba")), unpacked(batch.column("bb")))
            apart = [np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum() for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(may_match(total, np.array(apart, dtype=np.int64), percent)))

    one = signs.select(F.col("id").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba"))
    two = signs.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb"))
    rows = pairs.join(one, "a").join(two, "b").where(in_band(F.least("sa", "sb"), F.greatest("sa", "sb"), percent))
    return rows.select("a", "b", "sa", "sb", "ba", "bb").mapInArrow(run, "a long, b long")


def sets_of(texts: DataFrame, members: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows (id, packed) of the wanted ids: the compressed text of one document of each.

    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in tables(batches, BATCH_BYTES):
            packed = [press.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 4):
            found = [shingles(zstandard.decompress(p).decode(), n) for p in batch.column("packed").to_pylist()]
            ids = [xxhash.xxh64_intdigest(f.tobytes()) - (1 << 63) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("packed")], names=["id", "packed"])

    one = members.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    packed = texts.where("text IS NOT NULL").mapInArrow(pack, f"doc_id {kind}, packed binary")
    chosen = packed.join(one.select("doc_id").distinct(), "doc_id", "left_semi").select("packed")
    chosen = chosen.union(packed.where("doc_id IS NULL").select("packed"))  # cannot be joined, so all of them
    found = chosen.mapInArrow(run, "id long, packed binary").where("id IS NOT NULL")
    return found.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("packed").alias("packed"))


def overlaps(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``first`` with those numbered ``second``."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(starts, append=len(values))
    del values, starts
    owner = owner[np.repeat(counts > 1, counts)]  # a shingle of one set alone is in no intersection
    counts = counts[counts > 1]
    ends = np.cumsum(counts)
    both = np.zeros((len(first), len(second)), dtype=np.float32)  # exact below 2 ** 24
    for start in range(0, len(counts), COLUMNS):
        own = counts[start : start + COLUMNS]
        held = np.zeros((len(sets), len(own)), dtype=np.float32)
        held[owner[ends[start] - own[0] : ends[start + len(own) - 1]], np.repeat(np.arange(len(own)), own)] = 1
        both += held[first] @ held[second].T
    return both.astype(np.int32)


def connected(good: np.ndarray, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each class is connected with, by links between the numbers ``first`` and ``second``."""
    place = ids.copy()
    most = np.iinfo(np.int64).max
    while True:
        before = place.copy()
        place[first] = np.minimum(place[first], np.where(good, place[second], most).min(axis=1, initial=most))
        place[second] = np.minimum(place[second], np.where(good, place[first][:, None], most).min(axis=0, initial=most))
        if (place == before).all():
            return place


def linked(classes: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (id, links, place) by block: the documents of all classes there that are similar enough, and the
    least id that the class is connected with.

    Classes are (id, label, size, copies). The classes of a label are cut into blocks by id, and each two
    blocks meet once.
    """
    blocks = classes.groupBy("label").agg(
        F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    cut = classes.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.join(sets, "id")
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "id", "copies", "packed",
    )
    names = ("label", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None  # rows (own, id, copies, set) of the two blocks at hand

        def counted() -> pa.RecordBatch:
            own, ids, copies, found = zip(*held)
            own, copies, sizes = np.array(own), np.array(copies, dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)
            ids = np.array(ids, dtype=np.int64)
            first, second = np.flatnonzero(own == at[1]), np.flatnonzero(own == at[2])
            both = overlaps(found, first, second)
            # 100 * both >= percent * (sum of sizes - both), a row at a time
            good = np.empty(both.shape, dtype=bool)
            for i, size in enumerate(sizes[first]):
                good[i] = (100 + percent) * both[i].astype(np.int64) >= percent * (size + sizes[second])
            del both
            links = np.zeros(len(ids), dtype=np.int64)
            if at[1] == at[2]:
                np.fill_diagonal(good, False)
            else:
                links[second] = copies[first] @ good
            links[first] = good @ copies[second]
            some = links > 0
            place = connected(good, first, second, ids) if some.any() else ids
            return pa.RecordBatch.from_arrays(
                [pa.array(x[some]) for x in (ids, links, place)], names=["id", "links", "place"]
            )

        for batch in batches:
            for part in tables([batch], BATCH_BYTES // 4):
                columns = [part.column(c).to_pylist() for c in (*names, "own", "id", "copies", "packed")]
                for *place, own, number, copies, packed in zip(*columns):
                    if place != at:
                        if held:
                            yield counted()
                        held, at = [], place
                    held.append((own, number, copies, shingles(zstandard.decompress(packed).decode(), n)))
        if held:
            yield counted()

    tiled = dealt.repartition(*names).sortWithinPartitions(*names)
    return tiled.mapInArrow(run, "id long, links long, place long")


def near_duplicates(
    documents: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", count_links: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Words are runs without ASCII white space, A-Z lower-cased. Sets of ``n``-word shingles link when
    100 * intersection >= ``percent`` * union. component_id is the least doc_id of the component.
    n_links counts all other documents that a document links with, those of equal sets included; without
    ``count_links`` the column is left out, for callers that only need components.
    Null and wordless texts have no shingles and stand alone; so do rows without doc_id, whose
    component_id is null unless an equal text has one. Repeated rows are equal texts. An empty table
    gives none; other columns are ignored. Sets are told apart by 64-bit hashes.
    """
    if percent < 67:
        raise ValueError("below 67 percent, small sets may match that share fewer than COMMON shingles")
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    staged = Scratch(texts.sparkSession)
    rows = staged(described(texts, n, percent), "sets")
    members = rows.select("doc_id", "size", "id")
    keyed = rows.where("size(keys) > 0")
    tiles = staged(neighbours(keyed.select(F.explode("keys").alias("key"), "size", "id"), percent), "tiles")
    # A pair shares COMMON keys, so both its classes are in as many tiles; their sets are cut once.
    wanted = tiles.groupBy("id").agg(F.count("*").alias("tiles")).where(F.col("tiles") >= COMMON).select("id")
    wanted = staged(wanted, "wanted")
    signs = keyed.select("id", "size", "bits").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    signs = staged(signs, "signatures")
    sets = staged(sets_of(texts, members, wanted, n), "near-sets")
    near = (
        tiles.where("previous IS NOT NULL AND previous <> id")
        .groupBy(F.least("id", "previous").alias("a"), F.greatest("id", "previous").alias("b"))
        .agg(F.count("*").alias("common")).where(F.col("common") >= COMMON)
    )
    near = staged(bounded(near.select("a", "b"), signs, LOOSE), "near")

    first = staged(verified(near, sets, n, LOOSE), "first-links")
    groups = components(first)

    shared = tiles.select("key", "size", "id").join(wanted, "id", "left_semi")
    marked = staged(shared.join(groups, "id", "left").withColumn("label", F.coalesce("label", "id")), "marked")
    open_keys = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = staged(marked.join(open_keys, "key", "left_semi"), "open-tiles")
    pairs = tile_pairs(left, signs, percent).groupBy("a", "b").agg(F.count("*").alias("common")).where(F.col("common") >= COMMON)
    pairs = staged(bounded(pairs.select("a", "b"), signs, percent), "pairs")
    second = staged(verified(pairs, sets, n, percent), "second-links")
    if not second.isEmpty():
        groups = components(first.union(second))
    staged.free("tiles", "wanted", "signatures", "near", "first-links", "marked", "open-tiles", "pairs", "second-links")

    copies = members.where("id IS NOT NULL").groupBy("id", "size").agg(F.count("*").alias("copies"))
    copies = staged(copies, "copies")
    found = staged(linked(groups.join(copies, "id"), sets, n, percent), "links")
    staged.free("near-sets")
    labels = components(found.select(F.col("id").alias("a"), F.col("place").alias("b")))

    named = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = staged(named, "named")
    least = named.where("id IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    result = named.join(least, "label", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "id"
    )
    if not count_links:
        return staged.result(result.drop("id"), "components")
    per_link = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = copies.join(per_link, "id", "left").select(
        F.col("id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("found")
    )
    result = result.join(per_class, F.col("id") == F.col("class_id"), "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("found", F.lit(0)).alias("n_links")
    )
    return staged.result(result, "components")
