"""Operator 8, license scans by MinHash bands over overlapping text windows (DataFrame functions only).

Words are runs of a-z and 0-9 after lower-casing; a shingle is five words, by hash. A template of s shingles belongs to
class c, the power of two not under s. For each class the text is covered by windows of 2c shingles that start every c
shingles, so that any run of c shingles lies within one. A window that contains at least CONTAINED of a
template has a similarity with it of at least 0.8 s / (2 c + 0.2 s) > 0.19, so that one of BANDS minimum hashes (bands
of one row) agrees with probability over 1 - 0.81 ** 96 > 1 - 2e-9; such windows retrieve the template. Retrieved pairs
are then verified exactly: the window must contain at least CONTAINED of the template's shingles.

Windows that share no shingle with any template cannot match and are skipped before hashing.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

SHINGLE, CONTAINED, BANDS = 5, 0.8, 96
_random = random.Random(8)
MOST_BROADCAST = 1000  # templates; more are joined by shuffling
MOST_LITERAL = 100_000  # template shingles that a plan's literal may hold; more are joined
SEEDS = tuple(_random.getrandbits(64) - 2**63 for _ in range(BANDS))

# Notices by which public licenses are referred to, as (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)


def shingled(df: DataFrame, text: str) -> DataFrame:
    """df with the column shingles: the hashes of its text's shingles in order (none for null or under five words)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    df = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    word = F.col("_words")
    made = F.transform(F.sequence(F.lit(0), F.size(word) - SHINGLE), lambda k: F.xxhash64(*[word[k + i] for i in range(SHINGLE)]))
    # The row number keeps filters on shingles from being pushed below, where each would hash the words anew.
    return df.withColumns({"shingles": F.when(F.size(word) >= SHINGLE, made).otherwise(F.array().cast("array<bigint>")), "_row": F.monotonically_increasing_id()}).drop("_words")


def minima(shingles: Column) -> Column:
    """BANDS minimum hashes; x xor seed stands for a permutation."""
    least = lambda seed: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(seed))))
    return F.array(*map(least, SEEDS))


def size_class(size: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(size.cast("double")))).cast("int")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def templates_from(spark: SparkSession, folder: str) -> DataFrame:
    """A template table of the whole license texts in the files of a folder, each named by its license."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("license"), F.col("value").alias("text"))
    return files.select(F.xxhash64("license").alias("template_id"), "license", "text")


def license_scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, template_id, license, start, containment: every window of a text that contains at least CONTAINED of a template.

    docs has doc_id and text, templates template_id, license and text; templates under five words match nothing. start
    is the window's first word. Null and empty texts match nothing; repeated rows give repeated matches. Other columns
    are ignored. Up to MOST_LITERAL shingles of templates become one literal of the plan, more are joined; up to MOST_BROADCAST
    templates are broadcast, more are joined by shuffling.
    """
    known = shingled(templates.select("template_id", "license", "text"), "text").select("template_id", "license", F.array_distinct("shingles").alias("wanted"))
    known = known.filter(F.size("wanted") > 0).withColumn("class", size_class(F.size("wanted")))
    known = materialize(known, "templates")
    n, total, sizes = known.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0)), F.collect_set("class")).first()
    texts, literal = shingled(docs.select("doc_id", "text"), "text").drop("text"), None
    if total <= MOST_LITERAL:
        every = known.select(F.explode("wanted").alias("s")).distinct().collect()
        literal = F.from_json(F.lit(str(sorted(r.s for r in every))), "array<bigint>")
        texts = texts.filter(F.arrays_overlap("shingles", literal) & (F.col("_row") >= 0))
    else:
        texts = materialize(texts, "shingled")  # so that row numbers are the same in both uses
        held = texts.select("_row", F.explode(F.array_distinct("shingles")).alias("s")).join(known.select(F.explode("wanted").alias("s")).distinct(), "s", "left_semi")
        texts = texts.join(held.select("_row").distinct(), "_row", "left_semi")
    classes = F.array(*[F.lit(c) for c in sorted(sizes)]).cast("array<int>")
    windows = texts.withColumn("class", F.explode(classes))
    windows = windows.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("shingles") - 1, F.col("class"))))
    windows = windows.select("doc_id", "class", "start", F.array_distinct(F.slice("shingles", F.col("start") + 1, 2 * F.col("class"))).alias("held"), F.monotonically_increasing_id().alias("window"))
    windows = windows.filter(F.arrays_overlap("held", literal)) if literal is not None else windows
    banded = lambda df, of: df.select("*", F.posexplode(minima(F.col(of))).alias("band", "hash"))
    asked = banded(known, "wanted")
    asked = F.broadcast(asked) if n <= MOST_BROADCAST else asked
    retrieved = banded(windows, "held").join(asked, ["class", "band", "hash"])
    pairs = retrieved.dropDuplicates(["window", "template_id"])
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    return pairs.select("doc_id", "template_id", "license", "start", share.alias("containment")).filter(F.col("containment") >= CONTAINED)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's licenses: the best containment and the first window's word."""
    found = license_scan(table(spark, sf_dir, "documents"), template_table(spark))
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("start"))


def _values() -> str:
    return ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE_SQL = {
    "op8_license_scan": f"""
WITH t(template_id, license, text) AS (VALUES {_values()}),
tw AS (SELECT template_id, license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM t),
ts AS (SELECT DISTINCT template_id, license, w[i:i+4] AS shingle FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT *, count(*) OVER (PARTITION BY template_id) AS n FROM ts),
tc AS (SELECT *, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS c FROM tn),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
dd AS (SELECT doc_id, i - 1 AS p, w[i:i+4] AS shingle FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw)),
h AS (SELECT doc_id, template_id, license, n, c, p, tc.shingle FROM dd JOIN tc USING (shingle)),
x AS (SELECT *, (p // c) * c AS start FROM h UNION ALL SELECT *, (p // c - 1) * c AS start FROM h WHERE p >= c),
y AS (SELECT doc_id, template_id, license, start, count(DISTINCT shingle) / n AS containment FROM x GROUP BY doc_id, template_id, license, start, n)
SELECT doc_id, license, max(containment) AS containment, min(start)::INTEGER AS start FROM y WHERE containment >= 0.8 GROUP BY doc_id, license"""
}
