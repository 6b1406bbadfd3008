"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, least significant first. Level 0 holds the first chunk of every
id and a bitmap of those that go on; level 1 the second chunk of these, and so on. A directory holds
the number of set bits before every 512th bit, so the place of any id's next chunk is one lookup and
one count of at most 64 bytes: any token is read on its own, without decoding a block.

A segment is one such structure with the ids of whole documents. Files are Parquet, one segment a
row, so Spark's commit keeps them whole when executors are lost and any file system it knows works.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm.common import tables
from armada.session import new_path

MAGIC = b"DAC1"
DIRECTORY = 512
SEGMENT_TOKENS = 1 << 20
BATCH_BYTES = 4_000_000
MOST_WORDS = 200_000
LATIN_END = "\u0250"
# Latin letters and signs after them, which make one piece each; without U+0130, that in lower case ends in a mark.
LETTERS_AND_SIGNS = re.compile(
    r"([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:;=-@\[-`{-~]*)"
).fullmatch
# Texts that keep their case until they are cut: special strings, and signs of which case or joining depends on others.
KEPT = re.compile(r"[<\u0130\u0250-\U0010ffff]").search
END_ID = 1

_SCHEMA = (
    "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, data binary"
)


def encode(ids: np.ndarray) -> bytes:
    """Magic, number of ids, number of levels, then of each level: size, bytes, bitmap, directory."""
    levels, rest = [], ids.astype(np.uint32)
    count = len(rest)
    while True:
        onward = rest > 0xFF
        chunk = (rest & 0xFF).astype(np.uint8).tobytes()
        if not onward.any():
            levels.append(struct.pack("<QB", len(rest), 0) + chunk)
            break
        bitmap = np.packbits(onward, bitorder="little").tobytes()
        sums = np.add.reduceat(onward, np.arange(0, len(onward), DIRECTORY), dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u8").tobytes()
        levels.append(struct.pack("<QB", len(rest), 1) + chunk + bitmap + directory)
        rest = rest[onward] >> 8
    return MAGIC + struct.pack("<QB", count, len(levels)) + b"".join(levels)


class Segment:
    """Reads ids from an encoded segment without decoding it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.count, levels = struct.unpack_from("<QB", data, 4)
        at = 13
        self.levels = []
        for _ in range(levels):
            size, onward = struct.unpack_from("<QB", data, at)
            at += 9
            chunk = np.frombuffer(data, np.uint8, size, at)
            at += size
            bitmap = directory = None
            if onward:
                bitmap = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
                at += len(bitmap)
                directory = np.frombuffer(data, "<u8", -(-size // DIRECTORY), at)
                at += 8 * len(directory)
            self.levels.append((chunk, bitmap, directory))

    @staticmethod
    def ones(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // DIRECTORY
        bits = np.unpackbits(bitmap[block * DIRECTORY // 8 : i // 8 + 1], bitorder="little")
        return int(directory[block]) + int(bits[: i - block * DIRECTORY].sum())

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for level, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * level)
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self.ones(bitmap, directory, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, reading only their own bytes at each level."""
        values = np.zeros(stop - start, dtype=np.uint32)
        places = np.arange(stop - start)
        for level, (chunk, bitmap, directory) in enumerate(self.levels):
            values[places] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if bitmap is None or start == stop:
                break
            bits = np.unpackbits(bitmap[start // 8 : (stop + 7) // 8], bitorder="little")
            onward = bits[start % 8 : start % 8 + stop - start].astype(bool)
            places = places[onward]
            start = self.ones(bitmap, directory, start)
            stop = start + len(places)
        return values


class Encoder:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    Only for tokenizers whose pieces never hold white space, which is where texts are cut, and that
    give the digit zero an id of its own: words are encoded many at a time with zeros between them. The
    tokenizer lower-cases, and its pieces end where a letter meets a sign. Latin letters in lower case are therefore
    one piece, which its normalizer and its pattern leave as it is; they are encoded without these, and
    end with the id that marks the end of a piece.
    """

    TOGETHER = 1000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        (self.zero,) = self.ids(["0"])[0]
        suffix, pieces = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        if not suffix:
            raise ValueError("the tokenizer does not mark the ends of words")
        self.closing = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.closing[[number for piece, number in pieces.items() if piece.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def plain(word: str) -> tuple[str, str]:
        """The word and its last sign apart, and in lower case, where that is sure to change no id."""
        sign = ""
        # In lower case U+0130 ends in a mark, no letter, and the library keeps that and the sign together.
        if word[-1:] in (",", ".") and len(word) > 1 and word[-2].lower().isalpha() and word[-2] < LATIN_END:
            word, sign = word[:-1], word[-1]
        if word.isascii() and "<" not in word:
            word = word.lower()
        return word, sign

    def learn(self, words: set[str]) -> None:
        """Store the ids of new words."""
        if not words:
            return
        forms, stems, others = [], set(), set()
        for word in words:
            found = LETTERS_AND_SIGNS(word)
            if found:
                stem, signs = found.groups()
                stem = stem.lower()
                stems.add(stem)
            else:
                stem, signs = self.plain(word)
                others.add(stem)
            if signs:
                others.add(signs)
            if signs or stem != word:
                forms.append((word, stem, signs))
        known = self.known
        self.encode_letters(list(stems.difference(known)))
        self.encode(others.difference(known))
        for word, stem, signs in forms:
            known[word] = known[stem] + known[signs] if signs else known[stem]

    def stored(self, group: list[str], data: bytes, begins: list[int], ends: list[int]) -> None:
        if len(begins) != len(group):
            raise ValueError("the tokenizer does not keep words apart")
        for word, i, j in zip(group, begins, ends):
            self.known[word] = data[i:j]

    def encode_letters(self, words: list[str]) -> None:
        """Ids of words of Latin letters in lower case, as little-endian 32-bit numbers."""
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group in groups:
            (found,) = self.letters.encode_batch_fast([" ".join(group)], add_special_tokens=False)
            numbers = np.array(found.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.closing[numbers]) + 1)).tolist()
            self.stored(group, numbers.tobytes(), [0, *ends[:-1]], ends)

    def encode(self, words: set[str]) -> None:
        """Ids as little-endian 32-bit numbers."""
        plain = [w for w in words if "0" not in w]
        groups = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        for group, found in zip(groups, self.ids([" 0 ".join(group) for group in groups])):
            numbers = np.array(found, dtype="<u4")
            cuts = np.flatnonzero(numbers == self.zero)
            data = numbers.tobytes()
            self.stored(group, data, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)])
        rest = [w for w in words if "0" in w]
        for word, found in zip(rest, self.ids(rest)):
            self.known[word] = np.array(found, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        lines = [t if KEPT(t) else t.lower() for t in texts]
        split = pc.split_pattern(pa.array([t.replace("\n", " ") if "\n" in t else t for t in lines], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > MOST_WORDS:  # frequent words are in every batch, and stay
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.learn(set(words).difference(self.known))
        found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        order = coded.indices.to_numpy()
        lengths = sizes[order]
        ends = np.cumsum(lengths)
        first = (np.cumsum(sizes) - sizes)[order] - (ends - lengths)  # from a place in the texts to one in the ids of the words
        data = ids[np.repeat(first, lengths) + np.arange(len(first) and ends[-1])].tobytes()
        cuts = 4 * np.concatenate([[0], ends])[split.offsets.to_numpy()]
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield data[begin:end]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(documents: DataFrame, path: str, folder: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents to ``folder`` in ascending order of doc_id, null first.

    Null texts hold the end id alone, as do empty ones. Repeated rows each keep their place, those of
    one id side by side in the order of a hash of their texts, by which rows without id, however many,
    are spread over ranges as well. An empty table writes no segment. Other columns
    are ignored. Texts are put in order before they are encoded, for the ranges are found by a pass of
    its own, which then only reads ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held_ids, lengths, held = [], [], []
        size = 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def segment() -> pa.RecordBatch:
            data = encode(np.frombuffer(b"".join(held), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([held_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([size], pa.int64()), pa.array([data], pa.binary()),
                ],
                names=["part", "segment", "doc_ids", "lengths", "n_tokens", "data"],
            )

        for batch in tables(batches, BATCH_BYTES):
            found = encoder(path)([t or "" for t in batch.column("text").to_pylist()])
            for name, ids in zip(batch.column("doc_id").to_pylist(), found):
                held_ids.append(name)
                held.append(ids + end)
                lengths.append(len(held[-1]) // 4)
                size += lengths[-1]
                if size >= SEGMENT_TOKENS:
                    yield segment()
                    held_ids, lengths, held, size, number = [], [], [], 0, number + 1
        if held:
            yield segment()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """Segments of a folder with ``start``, the number of ids in all segments before them.

    The sums are taken over one row per file and then inside a file.
    """
    files = spark.read.schema(_SCHEMA).parquet(folder)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    starts = files.select("part", "segment", "n_tokens").join(F.broadcast(parts), "part")
    starts = starts.select(
        "part", "segment", (F.col("first") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    )
    return files.join(F.broadcast(starts), ["part", "segment"])


def token_digests(spark, folder: str) -> DataFrame:
    """One row per stored document, read from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stored, at = Segment(row["data"]), 0
                starts, sums = [], []
                data = memoryview(stored.slice(0, len(stored)).astype("<u4").tobytes())
                for length in row["lengths"]:
                    starts.append(row["start"] + at)
                    sums.append(zlib.crc32(data[4 * at : 4 * (at + length)]))
                    at += length
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                        pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = read_tokens(spark, folder).select("doc_ids", "lengths", "data", "start")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(documents: DataFrame, path: str) -> DataFrame:
    """Write the documents' ids to a new folder of the shared place and read them back."""
    spark = documents.sparkSession
    folder = new_path(spark, "tokens")
    write_tokens(documents, path, folder)
    return token_digests(spark, folder)
