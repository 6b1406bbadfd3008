"""Quality rules and a classifier on hashed word and character n-grams.

Rules come first: too few words, or too many words in repeated runs. What passes is judged by a
logistic regression on hashed counts of words, word pairs and character runs, trained on labelled
rows and calibrated on rows kept out of training, against a fixed threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import gram_hashes, mixed, tables
from armada.llm.learning import fitted, labelled_sample, trained

SAMPLE = {0: 2000, 1: 3000}  # labelled texts used for training, about, by class
BUCKETS = 4096
CHARACTER_RUNS = (2, 4)
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
THRESHOLD = 0.5
BATCH_BYTES = 4_000_000
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_numbers(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    give = known.setdefault
    return np.fromiter((give(w, len(known)) for w in words), dtype=np.uint64, count=len(words))


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside runs of eight words that are found twice or more in the text."""
    grams = gram_hashes(numbers, REPEAT_WINDOW)
    if len(grams) < 2:
        return 0
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    edges = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def rule_counts(text: str, words: list[bytes], numbers: np.ndarray) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)] if "\n" in text else []
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
    )


def features(data: bytes, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Logarithms of hashed n-gram counts, of unit length: words and pairs, then character runs."""
    half = BUCKETS // 2
    ids = [hashes % np.uint64(half), gram_hashes(hashes, 2) % np.uint64(half)]
    letters = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    for n in CHARACTER_RUNS:
        if len(letters) >= n:
            run = np.zeros(len(letters) - n + 1, dtype=np.uint32)
            for i in range(n):
                run = run * np.uint32(0x01000193) + letters[i : i + len(run)]
            ids.append(((run * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(half) + np.uint32(half))
    counts = np.bincount(np.concatenate([i.astype(np.int64) for i in ids]), minlength=BUCKETS)
    found = np.log1p(counts, dtype=np.float32)
    return found / max(1e-6, float(np.sqrt((found * found).sum())))


def word_hashes(numbers: np.ndarray, known: dict[bytes, int], spread: list[int]) -> np.ndarray:
    """Hashes of words that are the same in every batch and task, from numbers that are not."""
    import xxhash

    if len(spread) < len(known):
        spread.extend(map(xxhash.xxh64_intdigest, list(known)[len(spread) :]))
    return np.array(spread, dtype=np.uint64)[numbers.astype(np.int64)]


def _prepared(texts: list[str]):
    known: dict[bytes, int] = {}
    parts = []
    for text in texts:
        data = text.encode()
        words = data.split()
        parts.append((text, data, words, word_numbers(words, known)))
    spread: list[int] = []
    if known:
        word_hashes(np.zeros(0, dtype=np.uint64), known, spread)
    table = np.array(spread, dtype=np.uint64)
    for text, data, words, numbers in parts:
        yield text, data, words, numbers, mixed(table[numbers.astype(np.int64)]) if words else numbers


def train(texts: list[str], labels: list[int]) -> bytes:
    """A pickled (weights, bias); without labels of both classes everything scores 1."""
    if len(set(labels)) < 2:
        return pickle.dumps(None)
    rows = np.array([features(d, w, h) for _, d, w, _, h in _prepared(texts)], dtype=np.float32)
    truth = np.array(labels)
    held = np.arange(len(truth)) % 5 == 0
    weights, bias = fitted(rows[~held], truth[~held], steps=150, rate=0.2)
    # Calibration: scale and shift that fit the labels kept out of training.
    if len(set(truth[held])) == 2:
        scale, shift = fitted((rows[held] @ weights + bias)[:, None], truth[held])
        scale = max(float(scale[0]), 1e-3)
        weights, bias = weights * scale, bias * scale + shift
    return pickle.dumps((weights.astype(np.float32), float(bias)))


def quality_model(documents: DataFrame, labels: DataFrame) -> bytes:
    return trained(labelled_sample(documents, labels, "quality", SAMPLE, "quality"), train)


def quality(documents: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, score and kept.

    Null, empty and wordless texts have no words, fail the rules and are not kept. Repeated rows each
    give their row; an empty table gives none. Other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = pickle.loads(model)
        for batch in tables(batches, BATCH_BYTES):
            counts, scores = [], []
            for text, data, words, numbers, hashes in _prepared([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(rule_counts(text, words, numbers))
                if stored is None or not words:
                    scores.append(1.0 if words else 0.0)
                else:
                    z = float(features(data, words, hashes) @ stored[0]) + stored[1]
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(scores, pa.float64())], names=["doc_id", *names, "score"]
            )

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, {', '.join(n + ' long' for n in names)}, score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD)
    )
