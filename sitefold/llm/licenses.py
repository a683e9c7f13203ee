"""License scan by diagonal voting, in DataFrame operations only.

All rolling word pairs of all texts are hashed and joined to the positions of the same
pairs in the templates. A template that lies in a text puts its hits on one diagonal (text
position less template position); an inserted or missing word moves the rest to a
neighbouring diagonal. Hits are combined by diagonal before the shuffle, neighbouring
diagonals are merged, and a span counts if enough of the template's pairs are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences of this scan's own labels; at most 64 words each, as a template's pairs are bits.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "gnu lesser general public license": "lgpl",
}
#: Share of a template's pairs that a span needs, words by which its parts may be shifted.
LEAST_COVER, SLACK = 0.8, 2
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_pairs(spark: SparkSession) -> DataFrame:
    """A row per word pair of every template; fixed text, so its size is bounded."""
    rows = []
    for number, phrase in enumerate([*BASE, *TEMPLATES]):
        words = phrase.split(" ")
        for at in range(len(words) - 1):
            rows.append(
                F.struct(
                    F.lit(number).alias("template"),
                    F.lit(at).alias("at"),
                    F.lit(words[at]).alias("w1"),
                    F.lit(words[at + 1]).alias("w2"),
                )
            )
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.withColumn("pair_hash", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, least_cover: float = LEAST_COVER, slack: int = SLACK) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``) with its license labels.

    Words are runs of ``0-9a-z`` and of characters beyond ASCII after lower-casing A-Z.
    ``n_base``: places of base phrases, ``first_word`` and ``last_word``: the smallest and
    largest start among them (null without any), ``base_labels``; ``labels`` adds those of
    templates found in part (``least_cover`` of their pairs, parts shifted by up to
    ``slack`` words); ``score`` is the best share found, 0 to 1. Null and empty texts have
    no words and no labels; rows that repeat are each scanned; other columns are not read.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), letters, letters.lower())
    words = F.array_remove(F.split(text, _NOT_WORD, -1), "")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), words.alias("words"))
    pairs = rows.select(
        "doc_id",
        "row_no",
        F.size("words").alias("n_words"),
        F.posexplode_outer("words").alias("place", "first"),
        "words",
    ).select(
        "doc_id", "row_no", "n_words", "place", "first",
        F.get("words", F.col("place") + 1).alias("second"),
    )
    grams = template_pairs(docs.sparkSession)
    same = (
        (F.xxhash64("first", "second") == grams["pair_hash"])
        & (pairs["first"] == grams["w1"])
        & (pairs["second"] == grams["w2"])
    )
    # fixed templates, a few hundred rows
    hits = pairs.join(F.broadcast(grams), same, "left")
    diagonals = hits.groupBy(
        "row_no", "template", (F.col("place") - F.col("at")).alias("diagonal")
    ).agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )
    by_diagonal = Window.partitionBy("row_no", "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal)) > slack
    far = far | (F.col("low") - F.lag("high").over(by_diagonal) > slack + 1)
    merged = diagonals.withColumn("far", F.coalesce(far.cast("int"), F.lit(0)))
    merged = merged.withColumn("part", F.sum("far").over(by_diagonal))
    # what a template is: looked up by its number, so that rows and aggregates stay narrow
    phrases = [*BASE, *TEMPLATES]
    base = F.col("template") < len(BASE)
    pairs_of = F.get(F.array(*[F.lit(p.count(" ")) for p in phrases]), F.col("template"))
    label = F.get(F.array(*[F.lit(x) for x in [*BASE.values(), *TEMPLATES.values()]]), F.col("template"))
    whole = base & (F.bit_count("bits") == pairs_of)
    parts = merged.groupBy("row_no", "template", "part").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.bit_or("bits").alias("bits"),
        F.sum(whole.cast("long")).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("low"),
        F.max(F.when(whole, F.col("diagonal"))).alias("high"),
    )
    cover = F.bit_count("bits") / pairs_of
    found = parts.select(
        "*",
        label.alias("label"),
        F.when(base, F.when(F.col("places") > 0, F.lit(1.0))).when(cover >= least_cover, cover).alias("cover"),
    )
    base_label = F.when(base & (F.col("places") > 0), F.col("label"))
    per_row = found.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("low").cast("long").alias("first_word"),
        F.max("high").cast("long").alias("last_word"),
        # at most one entry for each label
        F.array_join(F.sort_array(F.collect_set(base_label)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("cover").isNotNull(), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return per_row.drop("row_no")
