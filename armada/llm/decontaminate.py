"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every run of GRAM words is hashed, and of each WINDOW neighbouring hashes the least is kept. A shared
span of GRAM + WINDOW - 1 words holds one whole window, whose least hash is kept on both sides, so no
such span is missed. Documents that share a fingerprint with the benchmark are then compared with
the benchmark's windows word by word, which extends the hits and throws out chance ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.llm.common import lower_ascii, staged

SPAN = 10
GRAM = 4
WINDOW = SPAN - GRAM + 1
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 100_000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where inner functions use it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased words; none for null."""
    found = F.split(F.coalesce(lower_ascii(text), F.lit("")), BREAK)
    return F.filter(found, lambda w: w != "")


def grams(hashes: Column, n: int) -> Column:
    """A hash of each n consecutive values of a bound array, none when there are fewer."""
    return F.when(
        F.size(hashes) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(hashes) - n + 1),
            lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(n))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def least(hashes: Column, window: int) -> Column:
    """The distinct least values of all windows of a bound array, none when there are fewer values."""
    return F.when(
        F.size(hashes) >= window,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.size(hashes) - window + 1),
                lambda i: F.array_min(F.slice(hashes, i, F.lit(window))),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(found: Column, short: list[int]) -> Column:
    """Fingerprints of a word list: winnowed ones, and all runs of the lengths of short items."""

    def of(hashes):
        kept = [let(grams(hashes, GRAM), lambda g: least(g, WINDOW))]
        for n in short:
            kept.append(grams(hashes, n))
        return F.array_distinct(F.concat(*kept)) if short else kept[0]

    return let(F.transform(found, lambda w: F.xxhash64(w)), of)


def windows(found: Column, length: Column) -> Column:
    """Each run of ``length`` words as (at, length, phrase)."""

    def of(bound):
        return F.when(
            (length > 0) & (F.size(bound) >= length),
            F.transform(
                F.sequence(F.lit(1), F.size(bound) - length + 1),
                lambda i: F.struct(
                    i.cast("int").alias("at"), length.alias("length"),
                    F.array_join(F.slice(bound, i, length), " ").alias("phrase"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<at:int,length:int,phrase:string>>"))

    return let(found, of)


def covered(spans: Column) -> Column:
    """Words inside any of the (at, length) spans."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(held, span):
        end = span["at"] + span["length"]
        new = F.greatest(F.lit(0), end - F.greatest(held["end"], span["at"]))
        return F.struct(F.greatest(held["end"], end).alias("end"), (held["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(spans), state, add, lambda held: held["total"])


def contamination(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; the digest is then of the empty string. Items
    without words have no window. Repeated document rows (same id and text) each give their row;
    rows that share an id but not the text are judged apart, null ids too. Benchmark rows of one id
    count as one item. Empty tables give no rows or no hits. Other columns are ignored.
    """
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")
    ).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(SPAN)))
    items = staged(items, "items")
    short = sorted(r["length"] for r in items.where(F.col("length") < SPAN).select("length").distinct().collect())
    marks = items.select(F.explode(fingerprints(F.col("words"), short)).alias("mark")).distinct()
    phrases = items.select("item", F.explode(windows(F.col("words"), F.col("length"))).alias("w")).select(
        "item", F.col("w.length").alias("length"), F.col("w.phrase").alias("phrase")
    )
    phrases = phrases.groupBy("length", "phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counted = staged(marks, "marks")
    if counted.count() <= BROADCAST_ROWS:
        counted = F.broadcast(counted)

    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "key", F.xxhash64(F.lit("key"), "doc_id", "text")
    )
    read = staged(
        texts.select(
            "doc_id", "key",
            let(
                words(F.col("text")),
                lambda w: F.struct(F.size(w).cast("long").alias("n_words"), fingerprints(w, short).alias("marks")),
            ).alias("r"),
        ).select("doc_id", "key", "r.*"),
        "fingerprints",
    )
    suspects = (
        read.select("key", F.explode("marks").alias("mark")).join(counted, "mark", "left_semi").select("key").distinct()
    )
    found = (
        texts.join(suspects, "key", "left_semi").dropDuplicates(["key", "doc_id"])
        .select("key", "doc_id", words(F.col("text")).alias("words"))
    )
    runs = F.concat(*(windows(F.col("words"), F.lit(n)) for n in [*short, SPAN]))
    hits = (
        found.select("key", "doc_id", F.explode(runs).alias("w"))
        .select("key", "doc_id", "w.*")
        .join(phrases, ["length", "phrase"])
        .groupBy("key", "doc_id")
        .agg(
            covered(F.collect_set(F.struct("at", "length"))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select(F.col("key").alias("hit_key"), F.col("doc_id").alias("hit_id"), "n_hit", "items")
    )
    items_found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return read.join(
        hits, (F.col("key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left"
    ).select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
