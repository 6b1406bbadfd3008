"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

The ordinary dictionary is trained on windows of ordinary texts. Toxic texts are mostly ordinary
words, so the toxic dictionary is trained on what sets them apart: the words whose beginning or end
is far more frequent among toxic texts than chance allows. It is put before the ordinary content; a
window without such words then compresses alike with both, and the bytes that the toxic dictionary
saves are evidence. Near copies count once in training, for one text copied often would make its own
words look telling. What windows save is turned into a probability on texts kept out of the
dictionaries.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import tables
from armada.llm.learning import fitted, labelled_sample, trained

SAMPLE = {0: 3000, 1: 1500}  # labelled texts used for training, about, by class
WORDS = 6
STRIDE = 6
ENDS = range(4, 11)  # bytes of a beginning or an end of a word, the space beside it included
EVIDENCE = 22.0  # log-likelihood ratio, in nats, for a part of a word to count as toxic
PURITY = 0.98
DICTIONARY = 32_768
BATCH_BYTES = 4_000_000

PARAMETERS = dict(
    compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=5, chain_log=16, hash_log=16,
    window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
)


def windows(text: str) -> list[bytes]:
    """Runs of words, lower case, with a space on either side."""
    words = text.encode().lower().split()
    return [
        b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, max(1, len(words) - (WORDS - STRIDE)), STRIDE)
    ] if words else []


def parts(word: bytes) -> set[bytes]:
    closed = b" " + word + b" "
    found = {closed}
    for n in ENDS:
        if n < len(closed):
            found.add(closed[:n])
            found.add(closed[-n:])
    return found


def fresh(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones: two of the eight least five-word hashes decide."""
    seen: set[int] = set()
    kept = []
    for text in texts:
        words = text.encode().lower().split()
        least = sorted({phrase_hash(words[i : i + 5]) for i in range(max(1, len(words) - 4))})[:8]
        if sum(h in seen for h in least) < min(2, len(least)):
            kept.append(text)
        seen.update(least)
    return kept


def phrase_hash(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(words))


def telling(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words and word ends of toxic texts that are no chance finds, those with most evidence last."""
    counts, others, words = Counter(), Counter(), Counter()
    for text in toxic:
        own = set(text.encode().lower().split())
        words.update(own)
        counts.update(set().union(*map(parts, own)) if own else ())
    for text in ordinary:
        own = set(text.encode().lower().split())
        others.update(x for x in (set().union(*map(parts, own)) if own else ()) if x in counts)
    share = len(toxic) / max(1, len(toxic) + len(ordinary))

    def evidence(a: int, b: int) -> float:
        pure = a / (a + b)
        if pure < PURITY:
            return 0.0
        return a * np.log(pure / share) + (b * np.log((1 - pure) / (1 - share)) if b else 0.0)

    held: dict[bytes, list[bytes]] = {}
    first = {part: e for part, n in counts.items() if n > 4 and (e := evidence(n, others[part])) > EVIDENCE}
    for word in words:
        for part in parts(word):
            if part in first:
                held.setdefault(part, []).append(word)
    # Strongest first; a weaker part must stand on words that the stronger ones do not explain.
    explained: set[bytes] = set()
    chosen = []
    for part in sorted(first, key=lambda p: (-first[p], -len(p), p)):
        rest = [w for w in held[part] if w not in explained]
        support = min(counts[part], sum(words[w] for w in rest))
        if support and evidence(support, others[part]) > EVIDENCE:
            chosen.append(part)
            explained.update(rest)
    return chosen[::-1]


class Pair:
    """The two compressors of a model."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.settings = zstandard.ZstdCompressionParameters(**PARAMETERS)
        self.compressors = [self.compressor(ordinary), self.compressor(toxic + ordinary)]

    def compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        stored = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        stored.precompute_compress(compression_params=self.settings)
        return zstandard.ZstdCompressor(dict_data=stored, compression_params=self.settings)

    def saved(self, text: str) -> np.ndarray:
        plain, toxic = (c.compress for c in self.compressors)
        # Said twice, a window always shrinks, so no saving is lost to blocks that are stored as they are.
        return np.array([len(plain(w + w)) - len(toxic(w + w)) for w in windows(text)] or [0])

    def features(self, text: str) -> list[float]:
        """Most bytes saved in a window, and the sum over windows, in logarithms."""
        gains = np.maximum(self.saved(text), 0)
        return [float(np.log1p(gains.max())), float(np.log1p(gains.sum()))]


def train(texts: list[str], labels: list[int]) -> bytes:
    """A pickled model; without texts of both classes it is empty and every score is 0."""
    by_class = [fresh([t for t, y in zip(texts, labels) if y == value]) for value in (0, 1)]
    if min(map(len, by_class)) < 8:
        return pickle.dumps(None)
    ordinary, toxic = ([t for i, t in enumerate(own) if i % 4] for own in by_class)
    held = [(t, y) for y, own in enumerate(by_class) for i, t in enumerate(own) if i % 4 == 0]
    samples = [w for t in ordinary for w in windows(t)]
    step = max(1, len(samples) // 20_000)
    try:
        plain = zstandard.train_dictionary(DICTIONARY, samples[::step]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        plain = b"".join(samples)[-DICTIONARY:]
    found = telling(toxic, ordinary)
    apart = b"\0".join(found) + b"\0"
    # Ordinary windows that still look toxic, for part of a telling word is in them, become ordinary.
    first = Pair(plain, apart)
    doubtful = {w for t in ordinary for w, gain in zip(windows(t), first.saved(t)) if gain > 0}
    plain = b"".join(sorted(doubtful))[-DICTIONARY:] + plain
    pair = Pair(plain, apart)
    weights, bias = fitted([pair.features(t) for t, _ in held], [y for _, y in held], even=False)
    return pickle.dumps((plain, apart, np.maximum(weights, 0.0), bias))


def scores(model: bytes, texts: list[str]) -> list[float]:
    stored = pickle.loads(model)
    if stored is None:
        return [0.0] * len(texts)
    plain, apart, weights, bias = stored
    pair = Pair(plain, apart)
    return [float(1 / (1 + np.exp(-np.clip(np.dot(weights, pair.features(t)) + bias, -30, 30)))) for t in texts]


def toxicity_model(documents: DataFrame, labels: DataFrame, usable=None) -> bytes:
    """Train on labelled texts for which ``usable`` (a condition on labels) holds."""
    known = labels if usable is None else labels.where(usable)
    return trained(labelled_sample(documents, known, "toxic", SAMPLE, "toxicity"), train)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(documents: DataFrame, model: bytes, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, score, predicted, and the carried columns.

    Null, empty and wordless texts get the score of a text without evidence. Repeated rows each give
    their row; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES):
            found = scores(model, [t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(c for c, n in zip(batch.columns, batch.schema.names) if n != "_text"), pa.array(found, pa.float64())],
                names=[*(n for n in batch.schema.names if n != "_text"), "_score"],
            )

    kept = [F.col("doc_id").alias("_id"), *([F.struct(*carry).alias("_carry")] if carry else [])]
    rows = documents.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text").dtypes) + ", _score double"
    scored = rows.mapInArrow(run, schema)
    return scored.select(
        F.col("_id").alias("doc_id"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
        *(F.col(f"_carry.{c}").alias(c) for c in carry if c != "doc_id"),
    )


def labelled_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside the held-out fold and score every document."""
    model = toxicity_model(documents, labels, ~held_out(F.col("doc_id")))
    return toxicity(documents, model).withColumn("held_out", held_out(F.col("doc_id")))
