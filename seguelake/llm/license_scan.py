"""License notices in texts, by diagonal voting on word k-grams.

All rolling k-gram hashes of a text are joined to the k-gram positions of the
templates.  Every hit votes for a diagonal, text position minus template position.
A phrase stands where one diagonal has all of the phrase's votes.  For a notice,
neighbouring diagonals (words put in or left out) are merged, and the merged span
is verified: enough of the template's k-grams, on a stretch of the text not much
longer than the template.

Only DataFrame functions are used.  The templates are a fixed, small table, so
they are broadcast and their hashes prefilter the grams inside each row: only hits
leave the row.

Nulls and odd cases: a null or empty text has no words, no places and score 0;
repeated rows and ids are reported row by row; null ids are kept; very long texts
are scanned whole; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: phrases and labels to be found exactly
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: wordings of common public notices
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "public-domain",
}
PHRASE_K, NOTICE_K = 2, 3


def pair_hash(words: Column) -> Column:
    """Hashes of neighbouring entries of a hash array."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def triple_hash(pairs: Column, words: Column) -> Column:
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.zip_with(F.slice(pairs, F.lit(1), n), F.slice(words, F.lit(3), n), lambda a, b: F.xxhash64(a, b))


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """Add ``__words`` (count), ``__g2`` and ``__g3`` (gram hashes in order)."""
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), NOT_WORD), "")
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("__g2", pair_hash(F.col("__h")))
    return df.withColumns({"__words": F.size("__h").cast("long"), "__g3": triple_hash(F.col("__g2"), F.col("__h"))}).drop("__h")


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, t_pos, t_grams, label, exact): one row per k-gram of each template."""
    rows = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in NOTICES.items()]
    base = with_grams(spark.createDataFrame(rows, "template string, label string, exact boolean"), "template")
    chosen = base.withColumn("grams", F.when(F.col("exact"), F.col("__g2")).otherwise(F.col("__g3")))
    return chosen.select("template", "label", "exact", F.size("grams").alias("t_grams"), F.posexplode("grams").alias("t_pos", "gram"))


def scan(docs: DataFrame, min_cover: float = 0.6, slack: int = 3, stretch: float = 1.5) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = template_grams(docs.sparkSession)
    hashes = {k: [r.gram for r in templates.filter(F.col("exact") == (k == PHRASE_K)).select("gram").distinct().collect()] for k in (PHRASE_K, NOTICE_K)}

    def hits(grams: str, k: int) -> Column:
        at = F.array_compact(F.transform(grams, lambda g, i: F.when(g.isin(hashes[k]), i)))
        return F.transform(at, lambda i: F.struct(i.alias("d_pos"), F.get(grams, i).alias("gram")))

    rows = with_grams(docs.select(docs["doc_id"], docs["text"].alias("__text")), "__text")
    rows = rows.select("doc_id", F.col("__words").alias("n_words"), F.concat(hits("__g2", PHRASE_K), hits("__g3", NOTICE_K)).alias("hits"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # tells repeated ids apart; used on this one branch only
    found = rows.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).join(F.broadcast(templates), F.col("hit.gram") == F.col("gram"), "left")
    keys = ["row", "doc_id", "n_words", "template", "label", "exact", "t_grams"]
    voted = found.withColumn("diagonal", F.col("hit.d_pos") - F.col("t_pos"))
    votes = voted.groupBy(*keys, "diagonal").agg(F.collect_set("t_pos").alias("at"), F.min("hit.d_pos").alias("low"), F.max("hit.d_pos").alias("high"))
    # neighbouring diagonals of a notice form one span; diagonals of a phrase stand alone
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("exact") | F.lag("diagonal").over(line).isNull() | (F.col("diagonal") - F.lag("diagonal").over(line) > slack)
    spans = votes.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(line)).groupBy(*keys, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"), F.min("diagonal").alias("start"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    cover = F.col("votes") / F.col("t_grams")
    tight = F.col("high") - F.col("low") + NOTICE_K <= stretch * (F.col("t_grams") + NOTICE_K - 1)
    place = F.col("exact") & (F.col("votes") == F.col("t_grams"))
    notice = ~F.col("exact") & tight & (cover >= min_cover)
    strength = F.when(place, 1.0).when(~F.col("exact") & tight, cover)
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(place | notice, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(strength), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
