"""Hard-negative mining by segment summaries.

Each vector is stored with the mean and the deviation of each of its segments. Over a segment of m
components the inner product of two vectors is m times the product of the means, give or take m times
the product of the deviations. Summed over segments this bounds a score from both sides. Coarse
segments are looked at first; vectors that the bounds leave open go on to finer segments, and only
what is left after the finest is scored exactly.

Vectors are spread by a hash over stripes of bounded size. Anchors, a stated share of all rows, meet
every stripe in batches; a task holds one stripe and streams the anchors past it. First the best of
the anchor's own label are found, then, for the range of scores that each positive sets, the best of
the other labels. A stripe gives at most as many rows as are asked for, so what is merged after it is
small, however often one vector is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armada.llm.common import staged

LEVELS = (1, 4, 16)  # segments, each level cutting those of the one before
STRIPE_VALUES = 1 << 22  # components of all vectors of a stripe
LEAST_STRIPE = 1 << 16
TASKS_PER_CORE = 2

_STORED = "row long, id long, label long, anchor boolean, vector binary, means binary, deviations binary"


def stored(embeddings: DataFrame, anchor: Column, vec_id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """Vectors of whole numbers with their summaries, and their padded length."""
    known = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & known).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
    )
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    finest = LEVELS[-1]
    width = -(-longest // finest) * finest
    most = math.isqrt((1 << 62) // width)
    rows = rows.where(F.forall("vector", lambda x: F.abs(x) <= most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            values = np.zeros((len(lists), width), dtype=np.int64)
            values[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            cut = values.reshape(len(lists), finest, -1).astype(np.float64)
            means, deviations = cut.mean(axis=2), cut.std(axis=2)
            names = (task << 40) + seen + np.arange(len(lists))
            seen += len(lists)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names), *(batch.column(c) for c in ("id", "label", "anchor")),
                    pa.array([v.tobytes() for v in values.astype("<i8")], pa.binary()),
                    pa.array([v.tobytes() for v in means.astype("<f4")], pa.binary()),
                    pa.array([v.tobytes() for v in deviations.astype("<f4")], pa.binary()),
                ],
                names=["row", "id", "label", "anchor", "vector", "means", "deviations"],
            )

    return staged(rows.mapInArrow(run, _STORED), "vectors"), width


class Stripe:
    """The vectors of a stripe, in order of labels, with their summaries at each level."""

    def __init__(self, rows: list[dict[str, np.ndarray]], width: int):
        take = lambda n: np.concatenate([r[n] for r in rows])
        self.width = width
        self.row, self.id, self.label = take("row"), take("id"), take("label")
        self.vectors = take("vector")
        self.most = int(np.abs(self.vectors).max(initial=0))
        self.small = self.vectors.astype(np.float32) if self.most**2 * width < 1 << 24 else None
        self.levels = levels(take("means"), take("deviations"), width)
        self.norms = np.sqrt((self.levels[0][0].astype(np.float64) ** 2 + self.levels[0][1].astype(np.float64) ** 2).sum(axis=1))

    def exact(self, which: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Inner products as whole numbers; floating point is used only where it is exact."""
        most = max(self.most, int(np.abs(vector).max(initial=0))) ** 2 * self.width
        if self.small is not None and most < 1 << 24:
            return (self.small[which] @ vector.astype(np.float32)).astype(np.int64)
        if most < 1 << 53:
            return (self.vectors[which].astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
        return self.vectors[which] @ vector

    def bounds(self, level: int, which, anchor) -> tuple[np.ndarray, np.ndarray]:
        means, deviations = self.levels[level]
        mean, deviation = anchor["levels"][level]
        middle, around = means[which] @ mean[0], deviations[which] @ deviation[0]
        around = around + (1 + 1e-4 * self.norms[which] * anchor["norm"])  # what rounding may do
        return middle - around, middle + around

    def ordered(self, which: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
        """Numbers of the first ``count`` of ``which`` by falling score, ties by id."""
        if len(which) > 4 * count:
            least = np.partition(scores, -count)[-count]
            near = np.flatnonzero(scores >= least)
        else:
            near = np.arange(len(which))
        return near[np.lexsort((self.id[which[near]], -scores[near]))[:count]]

    def positives(self, anchor, count: int) -> list[tuple[int, int]]:
        """The best (id, score) of the anchor's label, itself left out."""
        low, high = np.searchsorted(self.label, [anchor["label"], anchor["label"] + 1])
        which = np.arange(low, high)
        which = which[self.row[which] != anchor["row"]]
        for level in range(len(LEVELS)):
            if len(which) <= count:
                break
            below, above = self.bounds(level, which, anchor)
            which = which[above >= np.partition(below, -count)[-count]]
        scores = self.exact(which, anchor["vector"])
        best = self.ordered(which, scores, count)
        return list(zip(self.id[which[best]].tolist(), scores[best].tolist()))

    def negatives(self, anchor, ranges: list[tuple[int, int]], count: int) -> list[list[tuple[int, int]]]:
        """For each range of scores the best (id, score) of other labels inside it."""
        which = np.flatnonzero(self.label != anchor["label"])
        for level in range(len(LEVELS)):
            below, above = self.bounds(level, which, anchor)
            wanted = np.zeros(len(which), dtype=bool)
            for low, high in ranges:
                sure = below[(above <= high) & (below >= low)]
                least = max(low, np.partition(sure, -count)[-count]) if len(sure) >= count else low
                wanted |= (above >= least) & (below <= high)
            which = which[wanted]
        scores = self.exact(which, anchor["vector"])
        found = []
        for low, high in ranges:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            best = inside[self.ordered(which[inside], scores[inside], count)] if len(inside) else inside
            found.append(list(zip(self.id[which[best]].tolist(), scores[best].tolist())))
        return found


def levels(means: np.ndarray, deviations: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and deviations at each level, times the root of the segment length."""
    found = []
    means, squares = means.astype(np.float64), deviations.astype(np.float64) ** 2
    for segments in LEVELS:
        mean = means.reshape(len(means), segments, -1)
        inside = squares.reshape(len(means), segments, -1).mean(axis=2) + mean.var(axis=2)
        root = math.sqrt(width / segments)
        found.append(((mean.mean(axis=2) * root).astype(np.float32), (np.sqrt(inside) * root).astype(np.float32)))
    return found


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


NO_ID = np.iinfo(np.int64).max  # stands for a missing id inside a task, after all others


def against(rows: DataFrame, anchors: DataFrame, stripes: int, width: int, of, schema: str) -> DataFrame:
    """``of(stripe, anchor)`` for every anchor and stripe, as rows of ``schema``."""
    place = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")
    own = rows.select(F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(0).alias("kind"), *rows.columns)
    other = anchors.select(place, F.lit(1).alias("kind"), *anchors.columns)
    tiled = own.unionByName(other, allowMissingColumns=True).repartition("stripe")
    tiled = tiled.sortWithinPartitions("stripe", "kind", "label", "row")
    names = [c.split()[0] for c in schema.split(", ")]

    def columns(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        ids = part.column("id")
        return {
            "row": part.column("row").to_numpy(), "label": part.column("label").to_numpy(),
            "id": ids.fill_null(NO_ID).to_numpy(),
            "vector": matrix(part.column("vector"), "<i8", width),
            "means": matrix(part.column("means"), "<f4", LEVELS[-1]),
            "deviations": matrix(part.column("deviations"), "<f4", LEVELS[-1]),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, stripe = [], None, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("stripe", "kind")])
            cuts = np.flatnonzero(np.any(marks[:, 1:] != marks[:, :-1], axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if at != marks[0, start]:
                    held, at, stripe = [], marks[0, start], None
                if not marks[1, start]:
                    held.append(columns(part))
                    continue
                if not held:
                    continue
                stripe = stripe or Stripe(held, width)
                found: list[tuple] = []
                given = columns(part)
                every = levels(given["means"], given["deviations"], width)
                ranges = part.column("positives").to_pylist() if "positives" in part.schema.names else None
                for i in range(part.num_rows):
                    anchor = {n: given[n][i] for n in ("row", "label", "vector")}
                    anchor["levels"] = [(m[i : i + 1], d[i : i + 1]) for m, d in every]
                    anchor["norm"] = float(np.linalg.norm(anchor["vector"].astype(np.float64)))
                    anchor["positives"] = ranges and ranges[i]
                    found.extend(of(stripe, anchor))
                data = list(zip(*found)) if found else [[] for _ in names]
                arrays = [pa.array([None if c == "id" and x == NO_ID else x for x in d], pa.int64()) for c, d in zip(names, data)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return tiled.mapInArrow(run, schema)


def first(rows: DataFrame, keys: tuple[str, ...], count: int) -> DataFrame:
    """The first ``count`` rows of each key by falling score, ties by id; their place is ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    embeddings: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are inner products of these. ``anchor`` (a condition on the
    given columns) chooses the anchors. Positives are an anchor's ``positives`` best other rows of its
    label; of the rows of other labels that score from ``low`` to ``high`` percent of a positive, the
    ``negatives`` best are returned. Higher scores come first, ties by smaller id, null ids last.

    Rows with a null label or vector, or a null or non-finite component, take no part; nor do those with a
    component so large that a score would not fit a long (2 ** 31 / sqrt(length) after scaling). Shorter
    vectors count as if zeros followed. Repeated rows are rows of their own, each an anchor where chosen,
    and a positive of its copies. An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows, width = stored(embeddings, anchor, vec_id, vector, label, scale)
    count = rows.count()
    smallest = -(-count * width // LEAST_STRIPE)
    stripes = max(1, -(-count * width // STRIPE_VALUES), min(smallest, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    rows, chosen = rows.drop("anchor"), rows.where("anchor").drop("anchor")

    def own(stripe: Stripe, given) -> list[tuple]:
        return [(given["row"], i, s) for i, s in stripe.positives(given, positives)]

    best = first(against(rows, chosen, stripes, width, own, "row long, id long, score long"), ("row",), positives)
    best = staged(best, "positives")

    def other(stripe: Stripe, given) -> list[tuple]:
        scores = [p["score"] for p in given["positives"]]
        found = stripe.negatives(given, [(-(-low * s // 100), high * s // 100) for s in scores], negatives)
        return [(given["row"], p["rank"], i, s) for p, some in zip(given["positives"], found) for i, s in some]

    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asked = chosen.join(lists, "row").select(*chosen.columns, "positives")
    found = against(rows, asked, stripes, width, other, "row long, place long, id long, score long")
    found = first(found, ("row", "place"), negatives)
    names = chosen.select("row", F.col("id").alias("anchor_id"))
    given = best.select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["row", "place"]).join(names, "row").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
WITH typed AS (
    SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
vectors AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM typed
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
