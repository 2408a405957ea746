"""License scan by diagonal voting, in DataFrame functions only.

Words are lower-cased runs of letters and digits. The rolling word k-grams of every text (k = 3; 2 where a template
has two words only) are joined by hash to the places of the same grams in the templates, and compared word by word.
Every hit votes for its diagonal, the text place less the template place. Neighbouring diagonals of a template are
merged, which allows for words put in or left out, and a merged span is verified by the share of the template's
grams that it has. Templates that are phrases must stand as they are: their diagonals are not merged.

The templates are a parameter, a small set: up to ``BROADCAST_ROWS`` grams they are broadcast, more are joined by
shuffle. Texts are exploded and voted on where they are read; only hits and one row for each document are shuffled.

Null texts are empty and have no words. Rows are told apart by their place, so repeated rows and ids each have a
result. Null ids are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import words

BROADCAST_ROWS = 200_000
#: Diagonals this near are one span of a notice, and the share of its grams that verifies it.
BAND, COVERED = 3, 0.6


class Template(NamedTuple):
    name: str
    label: str
    text: str
    phrase: bool


# The phrases of the base scan.
PHRASES = [
    Template("phrase-mit", "mit", "mit license", True),
    Template("phrase-apache", "apache", "apache license", True),
    Template("phrase-gpl", "gpl", "general public license", True),
]
#: Notices in common use.
NOTICES = [
    Template("mit-released", "mit", "Released under the MIT License", False),
    Template("apache-licensed", "apache-2.0", "Licensed under the Apache License, Version 2.0", False),
    Template("gpl-licensed", "gpl-3.0", "This work is licensed under the GNU General Public License, version 3", False),
    Template("cc-by-nc", "cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", False),
    Template("cc-by", "cc-by-4.0", "Licensed under CC BY 4.0", False),
    Template("cc-by-sa", "cc-by-sa-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", False),
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files, to deal in the Software without restriction", False),
    Template("apache-grant", "apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy "
             "of the License at", False),
    Template("gpl-grant", "gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation", False),
    Template("bsd-grant", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", False),
    Template("mpl-notice", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", False),
]


def template_grams(templates: Sequence[Template]) -> list[tuple]:
    """(template, label, phrase, n_grams, place, word, word, word or null) of every gram."""
    rows = []
    for t in templates:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t.text))
        k = 3 if len(w) >= 3 else 2
        if len(w) < 2:
            raise ValueError(f"a template needs two words: {t.name}")
        for p in range(len(w) - k + 1):
            rows.append((t.name, t.label, t.phrase, len(w) - k + 1, p, *[*w[p : p + k], None][:3]))
    return rows


def _templates(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    rows = template_grams(templates)
    schema = "template string, label string, phrase boolean, n_grams int, place int, t0 string, t1 string, t2 string"
    grams = spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("t0", "t1"))
    return F.broadcast(grams) if len(rows) <= BROADCAST_ROWS else grams


def license_spans(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), id_col: str = "doc_id",
                  text_col: str = "text", band: int = BAND, covered: float = COVERED) -> DataFrame:
    """Per row: the id, n_words and spans (template, label, phrase, first word, end, coverage), verified or not."""
    grams = _templates(docs.sparkSession, templates)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    n = F.greatest(F.size("w"), F.lit(1))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))
    at = rows.select("row", "id", "n_words", F.posexplode_outer(zipped).alias("pos", "g")).select(
        "row", "id", "n_words", "pos", F.col("g.a").alias("w0"), F.col("g.b").alias("w1"), F.col("g.c").alias("w2"))
    at = at.withColumn("h", F.xxhash64("w0", "w1"))
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")))
    hits = at.join(grams, (at["h"] == grams["h"]) & same, "left").where(
        F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    votes = hits.groupBy("row", "id", "n_words", "template", "label", "phrase", "n_grams", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.count("template").alias("votes"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.max(F.when(F.col("t2").isNull(), 2).otherwise(3)).alias("k"))
    within = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(within)
    votes = votes.withColumn("new", F.when(gap <= F.when(F.col("phrase"), 0).otherwise(band), 0).otherwise(1))
    votes = votes.withColumn("island", F.sum("new").over(within))
    spans = votes.groupBy("row", "template", "island").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("phrase").alias("phrase"),
        F.least(F.sum("votes") / F.first("n_grams"), F.lit(1.0)).alias("coverage"), F.min("a").cast("long").alias("first"),
        (F.max("b") + F.max("k")).cast("long").alias("end"))
    one = F.when(F.col("template").isNotNull(), F.struct(
        "template", "label", "phrase", "first", "end", "coverage", (F.col("coverage") >= F.when(F.col("phrase"), 1.0).otherwise(covered)).alias("verified")))
    return spans.groupBy("row").agg(
        F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.sort_array(F.collect_list(one)).alias("spans")).drop("row")
