"""Searching metric scrapes and other texts for names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many names the search is one expression per name inside the JVM.
INLINE_NEEDLES = 32

# Characters by which names without an inner word are looked up.
GRAM = 8


def metric_present(
    scrapes: DataFrame, target: str, body: str, metric: str, exact: bool = False
) -> DataFrame:
    """A3: does any scrape of the target contain the metric?

    By default a plain substring, which comments and longer names also match. ``exact`` wants the
    name at the start of a sample line, ended by a label set or a space.
    """
    hit = F.col(body).contains(metric)
    if exact:
        quoted = r"\Q" + metric.replace(r"\E", r"\E\\E\Q") + r"\E"
        hit = F.col(body).rlike(rf"(?m)^{quoted}(?:\{{|[ \t])")
    return scrapes.groupBy(target).agg(
        F.count(F.lit(1)).alias("scrapes"),
        F.bool_or(F.coalesce(hit, F.lit(False))).alias("present"),
    )


def _bound(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once for all uses inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: str) -> Column:
    return F.split(F.col(text), r"[^\p{L}\p{N}]+", -1)


def _grams(text: str, n: int) -> Column:
    """Distinct runs of n characters."""

    def runs(letters: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(letters) - n + 1)
        cut = F.transform(places, lambda i: F.array_join(F.slice(letters, i, F.lit(n)), ""))
        return F.when(F.size(letters) >= n, F.array_distinct(cut)).otherwise(
            F.array().cast("array<string>")
        )

    return _bound(F.split(F.col(text), "", -1), runs)


def any_contained(
    df: DataFrame, col: str, needles: list[str] | DataFrame, needle: str = "text"
) -> DataFrame:
    """Rows whose text contains at least one needle. The empty needle is in every text.

    A short list becomes one expression. A table is joined: each needle is filed under its longest
    inner word, which has other signs on both sides and so is a whole word of any text that holds
    the needle; needles without one, under their first characters. Only pairs that share this key
    are compared in full.
    """
    if isinstance(needles, list):
        if len(needles) <= INLINE_NEEDLES:
            hit = F.lit(False)
            for word in needles:
                hit = hit | F.col(col).contains(word)
            return df.filter(hit)
        needles = df.sparkSession.createDataFrame([(w,) for w in needles], f"{needle} string")

    words = needles.select(F.col(needle).alias("_needle")).filter("_needle IS NOT NULL").distinct()
    inner = _bound(_words("_needle"), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    filed = words.withColumn("_key", longest["w"])
    few = filed.filter("_key IS NULL").withColumn("_n", F.least(F.length("_needle"), F.lit(GRAM)))
    lengths = sorted(r["_n"] for r in few.select("_n").distinct().collect())
    if 0 in lengths:
        return df.filter(F.col(col).isNotNull())
    texts = df.select(F.col(col).alias("_text"), F.xxhash64(col).alias("_hash")).filter("_text IS NOT NULL")
    keys = F.transform(F.array_distinct(_words("_text")), lambda w: F.struct(F.lit(0).alias("n"), w.alias("k")))
    for n in lengths:
        found = F.transform(_grams("_text", n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("k")))
        keys = F.concat(keys, found)
    wanted = filed.filter("_key IS NOT NULL").select("_needle", F.lit(0).alias("_n"), "_key").unionByName(
        few.select("_needle", "_n", F.expr("left(_needle, _n)").alias("_key"))
    )
    met = (
        texts.select("_hash", F.inline(keys))
        .join(wanted, (F.col("n") == F.col("_n")) & (F.col("k") == F.col("_key")))
        .select("_hash", "_needle")
        .distinct()
    )
    holds = (F.xxhash64(df[col]) == met["_hash"]) & df[col].contains(met["_needle"])
    return df.join(met, holds, "left_semi")
