"""Bounded labelled samples and training in one task."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import share_of


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int], salt: str) -> DataFrame:
    """Rows (text, label): about ``most[class]`` of each class, chosen by a hash of the id.

    ``documents`` has doc_id and text, ``labels`` doc_id and the label column. An id is used once: of
    repeated rows the greatest text and label count. The chosen ids are few by construction, so they
    are broadcast and texts are filtered where they are read.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(list(most))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    wanted = F.lit(False)
    for value, bound in most.items():
        share = bound / max(1, sizes.get(value, 0))
        wanted |= (F.col("label") == value) & (share_of(F.col("doc_id"), salt) < share)
    chosen = known.where(wanted).groupBy("doc_id").agg(F.max("label").alias("label"))
    return (
        documents.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    )


def trained(sample: DataFrame, train: Callable[[list[str], list[int]], bytes]) -> bytes:
    """Run ``train`` on the whole bounded sample in one task; the model comes back as bytes."""

    def run(frames):
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *frames]).sort_values("doc_id")
        yield pd.DataFrame({"model": [train(list(rows["text"]), [int(x) for x in rows["label"]])]})

    rows = sample.select("doc_id", "text", "label").repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else train([], [])


def fitted(features, labels, steps: int = 400, rate: float = 0.3, ridge: float = 1e-4, even: bool = True):
    """Weights and bias of a logistic regression by Adam on all rows; ``even``: classes weigh alike."""
    import numpy as np

    x, y = np.asarray(features, dtype=np.float32), np.asarray(labels, dtype=np.float32)
    weight = np.zeros(x.shape[1] + 1, dtype=np.float32)
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    if not even:
        share[:] = 1 / max(1, len(y))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weight[:-1] + weight[-1], -30, 30)))
        error = (p - y) * share
        gradient = np.append(x.T @ error + ridge * weight[:-1], error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weight -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weight[:-1], float(weight[-1])
