"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm import decontaminate, jaccard, mixing, storing, toxicity
from armada.llm.common import read, staged
from armada.session import tune

# Rows without an id get one above these bounds, from their text, inside a stage.
NO_ID = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """``_key``: the id, or for rows without one a number made from the text."""
    made = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), made))


def whole(docs: DataFrame):
    """All columns but the text as one, so that no name can clash with an operator's own."""
    return F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("_row")


def opened(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels outside the held-out fold."""
    usable = ~toxicity.held_out(F.col("doc_id"))
    model = toxicity.toxicity_model(docs, read(spark, sf_dir, "labels"), usable)
    rows = docs.select("doc_id", "text", whole(docs), F.col("text").alias("_text_kept"))
    scored = toxicity.toxicity(rows, model, carry=("_row", "_text_kept")).where("predicted = 0")
    return opened(scored.withColumnRenamed("_text_kept", "text"), docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id; rows that repeat once."""
    rows = keyed(docs).withColumn("_hash", F.xxhash64("text"))  # an id may have several texts, judged apart
    pairs = rows.select(F.struct("_key", "_hash").alias("_own"), "text")
    found = jaccard.near_duplicates(pairs, n=5, percent=80, doc_id="_own", count_links=False)
    kept = found.where("doc_id = component_id").select("doc_id._key", "doc_id._hash").distinct()
    chosen = rows.join(kept, ["_key", "_hash"], "left_semi")
    return chosen.dropDuplicates(["_key", "_hash"]).select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = keyed(docs).withColumn("_hash", F.xxhash64("text"))
    pairs = rows.select(F.struct("_key", "_hash").alias("_own"), "text")
    found = decontaminate.contamination(pairs, read(spark, sf_dir, "benchmark"), doc_id="_own")
    bad = staged(found.where("contaminated").select("doc_id._key", "doc_id._hash").distinct(), "contaminated")
    return rows.join(bad, ["_key", "_hash"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; n_chars follows a text that is taken in part."""
    rows = docs.select("doc_id", "text", "source", whole(docs))
    taken = mixing.repeated(mixing.mix(rows, carry=("text", "_row")).where("taken > 0"))
    return opened(taken, docs.columns).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to files in order of doc_id and read back."""
    return storing.stored_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("mixing", mixed),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(tune(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs


ORACLE_SQL = None  # the classifier and the tokenizer are not SQL; tests hold run() against a plain version

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
