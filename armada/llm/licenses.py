"""License scans by diagonal voting, with DataFrame functions only.

All runs of GRAM words of every text are joined by hash to the places where they stand in license
texts. A shared run votes for the diagonal on which it lies: the place in the document where the
license text would begin. Diagonals that are near each other are one place of a text with words put
in or left out. Places with votes enough are then verified word by word.

Short phrases are license texts as well: a place of theirs needs every vote and every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.llm.common import staged
from armada.llm.decontaminate import grams, let, words

GRAM = 3
GAP = 3  # diagonals this near belong to one place
SHARE = 0.8  # of a license text's words that must be found
SENTINEL = 0x6C6963656E736573  # a row that every document brings along, whatever it holds
BROADCAST_ROWS = 100_000

# Phrases with the labels they give, and the words by which common licenses are granted.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LICENSES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ),
    "gpl-2": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "licensed under the GNU General Public License, version 2",
    ),
    "gpl-3": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "licensed under the GNU General Public License, version 3",
    ),
    "lgpl": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation",
    ),
    "cc-by": ("licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-sa": ("licensed under a Creative Commons Attribution ShareAlike 4.0 International License",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}


def templates_of(spark: SparkSession, phrases: dict[str, str], licenses: dict[str, tuple[str, ...]], share: float) -> DataFrame:
    """Rows (template, label, base, words, length, least): ``least`` votes are needed for a place.

    A word that differs costs at most GRAM runs, so no place with ``share`` of the words on one diagonal
    has fewer votes than that.
    """
    every = [(label, True, text) for text, label in sorted(phrases.items())]
    every += [(label, False, text) for label, texts in sorted(licenses.items()) for text in texts]
    listed = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("base"), F.lit(c).alias("text")) for a, b, c in every))
    rows = spark.range(1).select(F.posexplode(listed).alias("template", "t")).select("template", "t.label", "t.base", words(F.col("t.text")).alias("words"))
    rows = rows.withColumn("length", F.size("words"))
    runs = F.col("length") - (GRAM - 1)
    lost = F.floor(F.col("length") * F.lit(1 - share) + F.lit(1e-9)).cast("int") * GRAM
    return rows.withColumn("least", F.when(F.col("base"), runs).otherwise(F.greatest(F.lit(1), runs - lost)))


def rolling(found: Column) -> Column:
    """Hashes of all runs of GRAM words, the sentinel before them."""
    hashes = let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: grams(h, GRAM))
    return F.concat(F.array(F.lit(SENTINEL)), hashes)


def votes(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows (doc_id, key, n_words, template, diagonal, votes); template -1 counts the copies of a row."""
    places = templates.select("template", F.posexplode(rolling(F.col("words"))).alias("at", "hash"))
    places = places.where("at > 0").select("hash", "template", (F.col("at") - 1).alias("place"))
    every = F.lit(SENTINEL).alias("hash"), F.lit(-1).alias("template"), F.lit(-1).alias("place")
    places = places.union(templates.sparkSession.range(1).select(*every))
    rolled = documents.select(
        "doc_id", F.xxhash64("text").alias("key"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), rolling(w).alias("runs"))).alias("r"),
    ).select("doc_id", "key", "r.n_words", F.posexplode("r.runs").alias("at", "hash"))
    # The license texts are a parameter, a few hundred words: their places may be broadcast.
    met = rolled.join(F.broadcast(places), "hash")
    return met.groupBy("doc_id", "key", "n_words", "template", (F.col("at") - 1 - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes")
    )


def candidates(voted: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows (doc_id, key, places): places with votes enough, neighbouring diagonals in one."""
    document = Window.partitionBy("doc_id", "key")
    copies = F.max(F.when(F.col("template") == -1, F.col("votes"))).over(document)
    hits = voted.withColumn("votes", F.col("votes") / copies).where("template >= 0")
    hits = hits.join(F.broadcast(templates), "template")
    # Phrases stand for themselves: two of them side by side are two places.
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= F.when(F.col("base"), 0).otherwise(GAP), 0).otherwise(1)
    islands = hits.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
    merged = islands.groupBy("doc_id", "key", "template", "island", "label", "base", "words", "length", "least").agg(
        F.min("diagonal").alias("first"), F.collect_set("diagonal").alias("diagonals"), F.sum("votes").alias("votes")
    ).where("votes >= least")
    return merged.groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("label", "base", "words", "length", "first", "diagonals")).alias("places")
    )


def verified(found: Column, places: Column) -> Column:
    """Of each place: label, base, first word and the share of the license words that stand on its diagonals."""

    def checked(w, place):
        stands = lambda i: F.exists(
            place["diagonals"], lambda d: (d + i >= 0) & (F.get(w, d + i) == F.element_at(place["words"], i + 1))
        )
        same = F.size(F.filter(F.sequence(F.lit(0), place["length"] - 1), stands))
        return F.struct(
            place["label"].alias("label"), place["base"].alias("base"), place["first"].cast("long").alias("first"),
            (same / place["length"]).alias("share"),
        )

    return let(found, lambda w: F.transform(places, lambda place: checked(w, place)))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_scan(
    documents: DataFrame, phrases: dict[str, str] | None = None, licenses: dict[str, tuple[str, ...]] | None = None,
    share: float = SHARE, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    Words are lower-cased runs of ASCII letters and digits and all non-ASCII characters. n_base counts the
    places of ``phrases``, all of them; first_word and last_word are the first words of the first and the
    last such place, null without one. ``labels`` adds those of ``licenses`` of which a place holds
    ``share`` of the words. score is the highest such share of any place with votes enough, 1 with a phrase,
    0 without place. ``found`` lists the places (label, base, first, share) that count.

    Null and wordless texts have no words. Repeated rows each give their row; texts that share an id are
    judged apart, null ids too. An empty table gives none; other columns are ignored.
    """
    spark = documents.sparkSession
    phrases, licenses = phrases or PHRASES, licenses or LICENSES
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    templates = templates_of(spark, phrases, licenses, share)
    voted = staged(votes(texts, templates), "license-votes")
    suspects = staged(candidates(voted, templates), "license-places")
    renamed = suspects.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "places")
    if suspects.count() <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    keyed = texts.withColumn("key", F.xxhash64("text"))
    same = (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    checked = keyed.join(renamed, same).select("own_id", "own_key", verified(words(F.col("text")), F.col("places")).alias("places"))
    checked = checked.dropDuplicates(["own_id", "own_key"])

    base = F.filter("places", lambda p: p["base"] & (p["share"] == 1))
    kept = F.filter("places", lambda p: F.when(p["base"], p["share"] == 1).otherwise(p["share"] >= share))
    checked = checked.select(
        "own_id", "own_key", base.alias("base"), kept.alias("kept"),
        F.array_max(F.transform(F.filter("places", lambda p: ~p["base"] | (p["share"] == 1)), lambda p: p["share"])).alias("best"),
    )
    firsts = F.transform("base", lambda p: p["first"])
    return voted.where("template = -1").join(checked, same, "left").select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("votes"))).alias("copy"),
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        F.coalesce(joined(F.transform("base", lambda p: p["label"])), F.lit("")).alias("base_labels"),
        F.coalesce(joined(F.transform("kept", lambda p: p["label"])), F.lit("")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
        F.coalesce(F.array_sort("kept"), F.array().cast("array<struct<label:string,base:boolean,first:bigint,share:double>>")).alias("found"),
    ).drop("copy")
