"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are five of them, hashed to 64 bits. A template of t
shingles belongs to the class m, the least power of two that is at least max(2, t). For each class, a text is cut into
windows of 2m shingles, one every m, so that any m shingles in a row lie in one window whole. BANDS one-row bands hold
MinHash values, each of a hash of its own. A window that holds 0.8 of a template shares at least 0.19 of the joint
shingles with it, and so misses all BANDS = 48 bands with a probability of at most 0.81 ** 48 < 5e-5. Every retrieved
pair is then verified: the exact share of the template's shingles in the window.

A verified match lacks at most a fifth of the template's shingles, so it holds one of any set of more shingles than
that, and one of a few words that more shingles than that have. Documents without any such word are passed over first,
and then those without any such shingle; that loses nothing. Both lists stand in the plan, and where they are longer
than MOST_LITERALS all documents go on.

Null and empty texts match nothing. Texts of under five words are one shingle of what they have. Templates need five
words; without templates nothing matches. A (document, text, template) is one row, with its best window (the first of
the best); repeated rows of one id and text are one. Other columns of documents, of whatever names, are not read. A very
long text is one row until it is cut into windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled
from .license_texts import FULL_TEXTS

SHINGLE, BANDS, LEAST = 5, 48, 0.8
#: Above this many template shingles the template side is joined by shuffle.
BROADCAST_ROWS = 200_000
#: With more template words or shingles than this, documents are not looked through for them before windows are cut.
MOST_LITERALS = 2_000

#: Notices as their publishers word them (fixed values): license, kind, text. Then whole texts.
TEMPLATES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *FULL_TEXTS,
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id int, license string, kind string, template string")


def templates_of_files(spark: SparkSession, path: str) -> DataFrame:
    """Templates from a folder of license texts, a file each, named by its file; their kind is not known."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("license"), F.col("value").alias("template"))
    return files.select(F.xxhash64("license").cast("int").alias("template_id"), "license", F.lit("unknown").alias("kind"), "template")


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(own: Column) -> Column:
    """Hashes of the word shingles, in order."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (SHINGLE - 1), F.lit(1)))
    made = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(own, i, SHINGLE), " ")))
    return F.when(F.size(own) == 0, F.array().cast("array<bigint>")).otherwise(made)


def band_values(own: Column) -> Column:
    """MinHash values: the least hash of the shingles, for each band's hash."""
    return F.array(*(F.array_min(F.transform(own, _hashed(k))) for k in range(BANDS)))


def _hashed(band: int):
    return lambda x: F.xxhash64(x, F.lit(band))


def windows(own: Column, m: int) -> Column:
    """(m, start, hashes) of the windows of a class."""
    last = F.greatest(F.ceil((F.size(own) - 2 * m) / m), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda j: F.struct(F.lit(m).alias("m"), (j * m).cast("int").alias("start"), F.slice(own, (j * m + 1).cast("int"), 2 * m).alias("w")))


def size_class(n: int) -> int:
    return max(2, 1 << max(0, n - 1).bit_length())


def prepared(templates: DataFrame) -> DataFrame:
    own = settled(templates, "own", words(F.col("template"))).where(F.size("own") >= SHINGLE)
    own = settled(own, "t", F.array_distinct(shingles(F.col("own"))))
    return own.withColumn("m", F.greatest(F.lit(2), F.pow(F.lit(2), F.ceil(F.log2(F.size("t")))).cast("int")))


def anchors_of(words_: list[str], hashes: list[int], least: float) -> tuple[set[str], set[int]]:
    """Words and shingles of a template without which no text holds the share `least` of its shingles.

    A match may lack so many shingles; more than those hold one of the words, and the shingles are more than those.
    """
    where: dict[int, list[int]] = {}
    for i, h in enumerate(hashes):
        where.setdefault(h, []).append(i)
    spare = len(where) - math.ceil(least * len(where) - 1e-9)
    by_word: dict[str, set[int]] = {}
    for h, places in where.items():
        for w in {w for i in places for w in words_[i : i + SHINGLE]}:
            by_word.setdefault(w, set()).add(h)
    chosen: set[str] = set()
    held: set[int] = set()
    for w in sorted(by_word, key=lambda w: (-len(w), w)):
        if len(held) > spare:
            break
        if by_word[w] - held:
            chosen.add(w)
            held |= by_word[w]
    return chosen, set(sorted(held)[: spare + 1])


def anchor_words(templates: DataFrame, least: float = LEAST) -> tuple[list[str], list[int], list[int]]:
    """Words of which each match holds one, the classes, and shingles of which each match holds one; all are bounded by the templates."""
    rows = prepared(templates).select("own", "m", shingles(F.col("own")).alias("s")).collect()
    found = [anchors_of(r["own"], r["s"], least) for r in rows]
    return sorted(set().union(*(w for w, _ in found))), sorted({r["m"] for r in rows}), sorted(set().union(*(x for _, x in found)))


def scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, template_id, license, kind, containment, word (of the best window, from 0), n_windows."""
    anchors, classes, shared = anchor_words(templates, least)
    known = prepared(templates).select("template_id", "license", "kind", "m", "t").withColumn("value", F.explode(band_values(F.col("t"))))
    if not anchors or known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5("text").alias("row"))
    own = settled(own, "own", words(F.col("text"))).drop("text").where(F.lit(True) if len(anchors) > MOST_LITERALS else F.arrays_overlap("own", F.array(*map(F.lit, anchors))) if anchors else F.lit(False))
    own = settled(own, "s", shingles(F.col("own"))).drop("own")
    if len(shared) <= MOST_LITERALS:
        own = own.where(F.arrays_overlap("s", F.array(*map(F.lit, shared)).cast("array<bigint>")))
    cut = F.concat(*(windows(F.col("s"), m) for m in classes)) if classes else F.expr("array(named_struct('m', 2, 'start', 0, 'w', s))")
    own = own.select("doc_id", "row", F.explode(cut).alias("x")).select("doc_id", "row", "x.*")
    hits = own.select("doc_id", "row", "m", "start", "w", F.explode(band_values(F.col("w"))).alias("value")).join(known, ["m", "value"])
    share = F.size(F.array_intersect("t", "w")) / F.size("t")
    good = hits.select("doc_id", "row", "template_id", "license", "kind", "start", share.alias("containment")).where(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("start")).alias("back")))
    found = good.groupBy("doc_id", "row", "template_id", "license", "kind").agg(best.alias("best"), F.count_distinct("start").alias("n_windows"))
    return found.select("doc_id", "template_id", "license", "kind", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("int").alias("word"), "n_windows")
