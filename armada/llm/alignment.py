"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, by spill counting.

Both tokenizers encode every text; byte offsets where tokens of both end cut them into groups, and
each token of a group is linked with each token of the other side. The documents of a task are kept
as runs: of each document its linked pairs, and of each radix of side A the run's pairs in side-major
order, each with the number of its documents that hold it, all compressed by zstandard and written to
the shared folder. A heap merges the runs of a radix, FAN at a time, until each pair has one count. In
side-major order the pairs of one A token are neighbours, so its highest count is known when the last
of them is read; counts then stream back to the runs of which they were made, and from there to the
documents.

What is shuffled of the pairs has been counted per run before, so a token found in every document is
one short list a run. A radix holds a fixed range of A ids, so its totals are bounded by the two
vocabularies and not by the data. Document records are moved once, each with its own run.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import staged, tables
from armada.llm.counting import byte_characters

RADIX_BITS = 8  # ids of side A that share all but these lowest bits form a radix
FAN = 256  # runs merged at a time
RUN_RECORDS = 1_000_000
RUN_DOCUMENTS = 20_000
BATCH_BYTES = 4_000_000
LARGE_GROUP = 4096  # links
LONG_WHITE = re.compile(r"\s{1000}")
LAST = (1 << 31) - 1

# How a byte-level file cuts texts before merging, and the blank of the other side.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "\u2581"

_RUNS = (
    "run long, radix int, head binary, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, "
    "n_groups array<bigint>, n_links array<bigint>, digests array<string>, body binary"
)
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed; whole numbers as steps from one to the next."""
    parts = [len(arrays[0]).to_bytes(8, "little")]
    for values in arrays:
        parts.append(np.diff(values.astype("<i8"), prepend=0).reshape(-1, 1).view(np.uint8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return [np.zeros(0, dtype=np.int64)] * 2
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 8, size)
    return [np.cumsum(np.ascontiguousarray(p.T).view("<i8").ravel()) for p in planes]


class Pair:
    """Two tokenizers, and texts aligned by them a batch at a time."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.path_a, self.whole = path_a, None
        with open(path_a, encoding="utf-8") as f:
            stored = json.load(f)
        names, special = byte_characters(), {t["content"] for t in stored["added_tokens"]}
        ids = {bytes(names[c] for c in t): i for t, i in stored["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        order = [ids[bytes(names[c] for c in a + b)] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the ids of the byte-level file do not follow the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            bytes_a[i] = token
        bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace(BLANK, " ").encode() for p, one in pieces]
        self.bytes = bytes_a, bytes_b
        self.lengths = tuple(np.array(list(map(len, x)), dtype=np.int64) for x in self.bytes)
        self.bits = tuple(len(x).bit_length() for x in self.bytes)
        # Names of ids with the sign that follows: a comma, or after the last of a group its end.
        self.names = [f"{i}{sign}" for own, signs in zip(self.bytes, (",|", ",;")) for i in range(len(own)) for sign in signs]

    def ids_a(self, text: str) -> list[int]:
        """Ids of side A. Over very long white space the faster library runs out of stack."""
        if not LONG_WHITE.search(text):
            return self.a.encode_ordinary(text)
        if self.whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path_a)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def gives_back(self, data: bytes, a: list[int], b: list[int]) -> bool:
        first, second = self.bytes
        return b"".join(map(first.__getitem__, a)) == data == b"".join(map(second.__getitem__, b))

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text sizes (A and B tokens, groups, links) and digest; and records (text, pair, times), by text."""
        found, shift = [], np.zeros(len(texts), dtype=np.int64)
        encoded = self.b.encode([t or "" for t in texts], num_threads=1)
        for i, (text, b) in enumerate(zip(texts, encoded)):
            if not text:
                continue
            a, data = self.ids_a(" " + text), (" " + text).encode()
            if self.gives_back(data, a, b):
                found.append((i, a, b))
                shift[i] = len(data)
        sizes, digests = np.zeros((len(texts), 4), dtype=np.int64), [""] * len(texts)
        none = np.zeros(0, dtype=np.int64)
        if not found:
            return sizes, digests, none, none, none
        whole, a, b = zip(*found)
        whole = np.array(whole)
        counts = [np.array(list(map(len, x)), dtype=np.int64) for x in (a, b)]
        ids = [np.fromiter(chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in zip((a, b), counts)]
        ends = [np.cumsum(size[i]) for size, i in zip(self.lengths, ids)]  # bytes, over all texts
        common = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(common, e) for e in ends]
        in_group = [np.bincount(g, minlength=len(common)) for g in group]
        last = [np.append(g[1:] != g[:-1], True) for g in group]
        stops = np.searchsorted(common, np.cumsum(shift[whole])) + 1  # groups up to the end of each text
        groups = np.diff(stops, prepend=0)
        links = np.concatenate([[0], np.cumsum(in_group[0] * in_group[1])])[stops]
        sizes[whole] = np.stack([*counts, groups, np.diff(links, prepend=0)], axis=1)

        # Tokens of both sides in order of groups, A before B.
        total = [np.cumsum(n) for n in in_group]
        code = np.zeros(len(ids[0]) + len(ids[1]), dtype=np.int64)
        code[np.arange(len(ids[0])) + (total[1] - in_group[1])[group[0]]] = 2 * ids[0] + last[0]
        code[np.arange(len(ids[1])) + total[0][group[1]]] = 2 * (ids[1] + len(self.bytes[0])) + last[1]
        name, at = self.names.__getitem__, 0
        for i, n in zip(whole.tolist(), (counts[0] + counts[1]).tolist()):
            digests[i] = hashlib.sha256("".join(map(name, code[at : at + n].tolist()))[:-1].encode()).hexdigest()
            at += n

        owner = np.repeat(whole, groups)
        keys, times = self.records(ids, in_group, owner)
        bits = sum(self.bits)
        return sizes, digests, keys >> bits, keys & ((1 << bits) - 1), times

    def records(self, ids: list[np.ndarray], in_group: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, A id, B id) as one number, and how many links each stands for."""
        first = [np.cumsum(n) - n for n in in_group]
        links = in_group[0] * in_group[1]
        bits, low = sum(self.bits), self.bits[1]
        usual = np.flatnonzero(links <= LARGE_GROUP)
        reps = links[usual]
        which = np.repeat(usual, reps)
        step = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        a = ids[0][first[0][which] + step // in_group[1][which]]
        b = ids[1][first[1][which] + step % in_group[1][which]]
        keys = np.sort((owner[which] << bits) | (a << low) | b)
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        keys, times = keys[begins], np.diff(begins, append=len(keys))
        large = np.flatnonzero(links > LARGE_GROUP)
        if not len(large):
            return keys, times
        parts = [(keys, times)]
        for g in large.tolist():  # of a long group only distinct ids are paired
            (a, n), (b, m) = (
                np.unique(own[f[g] : f[g] + c[g]], return_counts=True) for own, f, c in zip(ids, first, in_group)
            )
            pairs = (owner[g] << bits) | (a[:, None] << low) | b
            parts.append((pairs.ravel(), (n[:, None] * m).ravel()))
        return summed(*(np.concatenate(x) for x in zip(*parts)))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def runs_of(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Runs as rows: one body with its documents, and one head for each radix met."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_RUNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pair(path_a, path_b)
        task, number = TaskContext.get().partitionId(), 0
        held, records, documents = [], 0, 0

        def spilled() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            digests = [d for h in held for d in h[2]]
            shifts = np.cumsum([0, *(len(h[0]) for h in held)])
            owner = np.concatenate([h[3] + s for h, s in zip(held, shifts)])
            pairs, times = (np.concatenate([h[i] for h in held]) for i in (4, 5))
            keys, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            body = packed(owner, rank, times)
            radix = keys >> (known.bits[1] + RADIX_BITS)
            keys = ((keys >> known.bits[1]) << 32) | (keys & ((1 << known.bits[1]) - 1))
            first = np.flatnonzero(np.diff(radix, prepend=-1))
            heads = [packed(keys[i:j], counts[i:j]) for i, j in zip(first, [*first[1:], len(keys)])]
            rest = [None] * len(heads)
            lists = [pa.array([x, *rest], t) for x, t in zip(
                (ids, *sizes.T, digests), [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string())])]
            name = (task << 32) | number
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (1 + len(heads)), pa.int64()),
                    pa.array([-1, *radix[first].tolist()], pa.int32()),
                    pa.array([None, *heads], pa.binary()), *lists, pa.array([body, *rest], pa.binary()),
                ],
                schema=schema,
            )

        for batch in tables(batches, BATCH_BYTES):
            found = known.aligned(batch.column("text").to_pylist())
            held.append((batch.column("doc_id"), *found))
            records += len(found[4])
            documents += batch.num_rows
            if records >= RUN_RECORDS or documents >= RUN_DOCUMENTS:
                yield spilled()
                held, records, documents, number = [], 0, 0, number + 1
        if held:
            yield spilled()

    return rows.mapInArrow(run, _RUNS)


def merged(heads: DataFrame, groups: int) -> DataFrame:
    """Heads (radix, run, head) merged by a heap to one of each radix and group of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def counted() -> pa.RecordBatch:
            keys, counts = [], []
            for key, n in heapq.merge(*(zip(*(x.tolist() for x in unpacked(h))) for h in held)):
                if keys and keys[-1] == key:
                    counts[-1] += n
                else:
                    keys.append(key)
                    counts.append(n)
            head = packed(np.array(keys, dtype=np.int64), np.array(counts, dtype=np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([head], pa.binary())],
                names=["radix", "run", "head"],
            )

        for batch in batches:
            for *place, head in zip(*(batch.column(c).to_pylist() for c in ("radix", "place", "head"))):
                if place != at:
                    if held:
                        yield counted()
                    held, at = [], place
                held.append(head)
        if held:
            yield counted()

    placed = heads.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("place"), "run", "head")
    tiled = placed.repartition("radix", "place").sortWithinPartitions("radix", "place", "run")
    return tiled.mapInArrow(run, "radix int, run long, head binary")


def totals(heads: DataFrame, runs: int) -> DataFrame:
    """One head for each radix, with the counts over all runs."""
    while True:
        runs = max(1, -(-runs // FAN))
        heads = merged(heads, runs)
        if runs == 1:
            return heads


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair has the highest count of its A token; pairs are in side-major order."""
    side = keys >> 32
    first = np.flatnonzero(np.diff(side, prepend=-1))
    most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.concatenate([first, [len(keys)]])))
    return counts == most


def answered(total: DataFrame, heads: DataFrame, runs: int) -> DataFrame:
    """For each run and radix the counts of its pairs, twice as high, and one more where highest."""
    groups = max(1, -(-runs // FAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = answers = None
        for batch in batches:
            names, radixes, given = [], [], []
            for radix, number, head in zip(*(batch.column(c).to_pylist() for c in ("radix", "run", "head"))):
                own, counts = unpacked(head)
                if number < 0:
                    keys, answers = own, 2 * counts + highest(own, counts)
                    continue
                names.append(number)
                radixes.append(radix)
                given.append(packed(answers[np.searchsorted(keys, own)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(radixes, pa.int32()), pa.array(given, pa.binary())],
                names=["run", "radix", "head"],
            )

    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("place")
    every = total.select("radix", places, F.lit(-1).cast("long").alias("run"), "head").union(
        heads.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("place"), "run", "head")
    )
    tiled = every.repartition("radix", "place").sortWithinPartitions("radix", "place", "run")
    return tiled.mapInArrow(run, "run long, radix int, head binary")


def contributed(answers: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row per document, from the records of its run and the counts of the run's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("radix")[i].as_py() != LAST:
                    found.append(unpacked(batch.column("head")[i].as_py())[0])
                    continue
                take = lambda n: batch.column(n)[i].values
                owner, link, times = (x if len(x) else x for x in bodies_of(batch.column("body")[i].as_py()))
                counts = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
                found = []
                ids = take("doc_ids")
                best, sums = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
                if len(owner):
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    best[owner[first]] = np.add.reduceat((counts[link] & 1) * times, first)
                    sums[owner[first]] = np.add.reduceat((counts[link] >> 1) * times, first)
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(take, ("n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(sums), take("digests")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    every = answers.unionByName(bodies.withColumn("radix", F.lit(LAST)), allowMissingColumns=True)
    tiled = every.repartition("run").sortWithinPartitions("run", "radix")
    return tiled.mapInArrow(run, _RESULT)


def bodies_of(data: bytes) -> list[np.ndarray]:
    found = unpacked(data)
    return found if len(found) == 3 else [np.zeros(0, dtype=np.int64)] * 3


class Alignment:
    """The runs of a table, and what is read from them."""

    def __init__(self, documents: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text"):
        rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.table = staged(runs_of(rows, path_a, path_b), "alignment-runs")
        self.heads = self.table.where("radix >= 0").select("radix", "run", "head")
        self.runs = self.table.where("radix < 0").count()

    def pairs(self) -> DataFrame:
        """Rows (a, b, documents, highest): every linked pair of ids, for mapping one vocabulary to the other."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for head in batch.column("head").to_pylist():
                    keys, counts = unpacked(head)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts), pa.array(highest(keys, counts))],
                        names=["a", "b", "documents", "highest"],
                    )

        total = totals(self.heads, self.runs).select("head")
        return total.mapInArrow(run, "a long, b long, documents long, highest boolean")

    def documents(self) -> DataFrame:
        answers = answered(totals(self.heads, self.runs), self.heads, self.runs)
        return contributed(answers, self.table.where("radix < 0").drop("radix", "head"))


def alignment(documents: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` names a byte-level BPE file of the tokenizers library, ``path_b`` a sentencepiece model
    that puts a blank before; both must be on every executor. Special strings are plain text. Null and
    empty texts, and texts that the tokens of one side do not give back byte for byte, have no tokens:
    zeros and the empty string. Each row is a document: repeated rows, also without an id, each count and
    each give their row. An empty table gives none; other columns are ignored.
    """
    return Alignment(documents, path_a, path_b, doc_id, text).documents()
