"""License scans: which license notices stand in a text, and where.

Texts and templates are cut into shingles of five words. Windows of three times a template's length, one
starting at every multiple of its length, overlap so that a notice up to twice as long as the template lies
whole in one. MinHash bands of one row retrieve templates for windows: with containment 0.8 a window and its
template have a Jaccard similarity of 0.25 or more, and 24 bands miss it with a chance of 0.75^24 = 0.1 % at
most. Retrieved pairs are then checked by exact containment of the template's shingles.

A band matches only if the template's least shingle of that band stands in the window and is the window's
least, so windows are formed only around places where a text has such a shingle: all others cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflux.llm.common import let
from cityflux.plans.scratch import materialize

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24
# Window length and step in lengths of the template.
SPAN = 3

# Wording of notices as they are published.
NOTICES = [
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-short", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def plain_words(text: Column) -> Column:
    """Words in lower case; what is no letter or digit separates them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """The shingles of words ``w`` in order; fewer words than a shingle are one shingle, no words none."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(many)


def _hashes(w: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles, without building their texts."""
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(size)])

    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(one(F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - size), one))


def _ranked(hashes: Column, band: Column) -> Column:
    """(value under the band's order, hash) of the least hash."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, band).alias("v"), h.alias("h"))))


def templates(spark, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """license, shingles (distinct), n of them, and per band the template's least shingle hash."""
    literal = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("notice")) for a, b in notices])
    rows = spark.range(1).select(F.inline(literal))
    cut = rows.select("license", let(plain_words(F.col("notice")), lambda w: F.struct(F.array_distinct(shingles(w)).alias("s"), F.array_distinct(_hashes(w)).alias("h"))).alias("x"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), _ranked(F.col("x.h"), b)["h"].alias("h")))
    return cut.select("license", F.col("x.s").alias("shingles"), F.size("x.s").alias("n"), bands.alias("bands")).filter("n > 0")


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment (best of its windows), word (where that window starts, from 0), windows (that contain it).

    One row per row of docs and license found; several licenses of one text come each. Null and empty texts have none.
    Rows with equal doc_id and text are one. Null doc_ids stay null. Empty table: no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    # The notices are a bounded list of the caller's; so are their bands.
    table = materialize(templates(spark, notices), "notices")
    bands = table.select("license", "shingles", "n", F.explode("bands").alias("b")).select("license", "shingles", "n", "b.band", "b.h")
    leasts = sorted({r["h"] for r in bands.select("h").distinct().collect()})
    # Around a hit only the words that a window with it can reach are kept.
    reach = SPAN * (table.agg(F.max("n")).first()[0] or 0)

    def around(w: Column, x: Column) -> Column:
        low = F.greatest(x["i"] - reach, F.lit(0))
        return F.struct(x["h"].alias("h"), x["i"].alias("i"), low.alias("low"), F.slice(w, low + 1, 2 * reach + SHINGLE).alias("near"))

    def places(w: Column) -> Column:
        numbered = F.transform(_hashes(w), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.transform(F.filter(numbered, lambda x: x["h"].isin(leasts)), lambda x: around(w, x))

    # Outer, as an inner one would have the optimiser compute the places once more to test that there are any.
    cut = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.explode_outer(let(plain_words(F.col("text")), places)).alias("x"))
    at = cut.filter(F.col("x").isNotNull()).select("doc_id", "_text", "x.*")
    met = at.join(F.broadcast(bands), "h")
    # The windows of SPAN * n shingles, one at every multiple of n, that have place i in them.
    last = F.floor(F.col("i") / F.col("n")).cast("int")
    starts = F.transform(F.sequence(F.greatest(last - (SPAN - 1), F.lit(0)), last), lambda k: k * F.col("n"))
    inside = F.slice("near", F.col("start") - F.col("low") + 1, SPAN * F.col("n") + SHINGLE - 1)
    windows = met.withColumn("start", F.explode(starts)).withColumn("_words", inside).drop("near")
    retrieved = windows.filter(_ranked(_hashes(F.col("_words")), F.col("band"))["h"] == F.col("h"))
    share = F.size(F.array_intersect("shingles", shingles(F.col("_words")))) / F.col("n")
    checked = retrieved.withColumn("share", share).filter(F.col("share") >= containment)
    best = F.max_by(F.struct("share", "start"), F.struct(F.col("share"), -F.col("start")))
    rows = checked.groupBy("doc_id", "_text", "license").agg(best.alias("best"), F.count_distinct("start").cast("long").alias("windows"))
    return rows.select("doc_id", "license", F.col("best.share").alias("containment"), F.col("best.start").cast("long").alias("word"), "windows")


def oracle(notices: list[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT) -> str:
    """The same in SQL, by exact containment of every window."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in notices)
    cut = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END"
    return f"""
WITH t AS (SELECT license, list_distinct({grams}) AS s FROM (SELECT license, {cut.format('notice')} AS w FROM (VALUES {values}) AS v(license, notice))),
ts AS (SELECT license, len(s) AS n, unnest(s) AS g FROM t WHERE len(s) > 0),
d AS (SELECT DISTINCT doc_id, hash(text) AS text, {cut.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, text, unnest(g) AS g, unnest(range(len(g))) AS i FROM (SELECT doc_id, text, {grams} AS g FROM d)),
hits AS (SELECT doc_id, text, license, n, ds.g, i, unnest(range(greatest(i // n - {SPAN - 1}, 0), i // n + 1)) AS k FROM ds JOIN ts ON ds.g = ts.g),
windows AS (SELECT doc_id, text, license, k * n AS start, count(DISTINCT g) / n AS share FROM hits GROUP BY doc_id, text, license, k, n HAVING share >= {containment})
SELECT doc_id, license, max(share)::DOUBLE AS containment, arg_max(start, (share, -start))::BIGINT AS word, count(*)::BIGINT AS windows
FROM windows GROUP BY doc_id, text, license"""
