"""Licence scans: the Dice coefficient over word bigrams between passages and licence templates.

Passages are the lines of a text, and its paragraphs of several lines. Two exact bounds keep the work small: a passage
must hold a word from a set that any match must meet, and its number of bigrams must be within reach of a template's.
In what is left of a text without the passages that match, windows of a template's size are compared as well, so that a notice
may share its line or paragraph with other words.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepath.llm.tables import stored, text_or_empty

# Notices of common licences. A licence may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Function words, too common in any prose to look for.
_COMMON = frozenset("a an and any are as at be but by can do for found from has have if in including into is it its no not of on or other that the this to under was with without you your".split())

MOST_BROADCAST_BYTES = 16_000_000  # of templates; a larger library is joined by a shuffle


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: str) -> Column:
    """The distinct pairs of neighbouring words; none for fewer than two words."""
    pairs = F.expr(f"transform(sequence(0, greatest(size({words}) - 2, 0)), i -> concat_ws(' ', {words}[i], {words}[i + 1]))")
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def telling_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every passage that matches a template holds one.

    A match shares at least ``least / (2 - least)`` of a template's b bigrams, so it misses fewer than m of them. Words
    that stand in m bigrams or more between them can't all be missing. Uncommon words go first.
    """
    out: set[str] = set()
    for _, text in templates:
        words = _template_words(text)
        pairs = set(zip(words, words[1:]))
        missing = len(pairs) - ceil(least / (2 - least) * len(pairs) - 1e-9) + 1
        chosen: set[str] = set()
        ranked = sorted(set(words), key=lambda w: (w in _COMMON, len(w) < 3 and not w.isdigit(), -sum(w in p for p in pairs), w))
        for w in ranked:
            if sum(bool(chosen & set(p)) for p in pairs) >= missing:
                break
            chosen.add(w)
        out |= chosen
    return sorted(out)


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.85, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(id, license, dice, n_passages)``: the licences of each document, with the best coefficient and the passages that match.

    A passage counts for its best template only (of equals, the first licence by name). Windows are passages, too: those of as many words as
    a template that begin with one of its bigrams, outside of lines and paragraphs that match; of overlapping ones the best counts. Documents without a match, null and
    empty ones among them, have no row. A document with several licences has several rows; repeated rows of a document count their
    passages together, and a null id is an id of its own. Templates of fewer than two words match nothing.
    """
    known = [(name, t) for name, t in templates if len(_template_words(t)) > 1]
    if not known:
        raise ValueError("no template has two words")
    lists = [(name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})) for name, t in known for w in [_template_words(t)]]
    word = "|".join(telling_words(known, least))
    telling = rf"(?<![\p{{L}}\p{{N}}])(?:{word})(?![\p{{L}}\p{{N}}])"
    body = F.lower(text_or_empty(text))
    lines = F.split(body, "\n")
    paragraphs = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.trim(p).contains("\n"))
    passages = (
        docs.where(body.rlike(telling))
        .select(F.col(f"`{id}`").alias("id"), F.md5(body).alias("key"), F.monotonically_increasing_id().alias("at"), F.posexplode(F.concat(lines, paragraphs)).alias("line", "p"))
        .where(F.col("p").rlike(telling))
        .withColumn("words", words_of(F.col("p")))
    )
    # A coefficient d needs sizes within d / (2 - d) of each other: each template meets the passages of these sizes.
    reach = [
        (n, name, pairs, len(pairs))
        for name, pairs in lists
        for n in range(ceil(len(pairs) * least / (2 - least) - 1e-9), floor(len(pairs) * (2 - least) / least + 1e-9) + 1)
    ]
    table = docs.sparkSession.createDataFrame(reach, "n int, license string, template array<string>, b int")
    if sum(len(p) for _, _, pairs, _ in reach for p in pairs) <= MOST_BROADCAST_BYTES:
        table = F.broadcast(table)  # the library is given by the caller, not by the data
    sized = passages.where(F.size("words") > min(r[0] for r in reach)).select("id", "key", "p", "at", "line", bigrams("words").alias("pairs"))
    met = sized.withColumn("n", F.size("pairs")).join(table, "n")
    dice = 2 * F.size(F.array_intersect("pairs", "template")) / (F.col("n") + F.col("b"))
    scored = met.withColumn("dice", dice).where(F.col("dice") >= least)
    best = scored.groupBy("id", "at", "line").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("m"), F.first("key").alias("key"), F.first("p").alias("p"))
    whole = stored(best.select("id", "key", "p", F.col("m.license").alias("license"), (-F.col("m.minus")).alias("dice")), "license_passages")
    texts = docs.where(body.rlike(telling)).select(F.col(f"`{id}`").alias("id"), F.md5(body).alias("key"), body.alias("body"))
    inside = _windows(texts, whole, known, least)
    return (
        whole.select("id", "license", "dice")
        .unionByName(texts.select("id", "key").join(inside, "key").select("id", "license", "dice"))
        .groupBy("id", "license")
        .agg(F.max("dice").alias("dice"), F.count("*").alias("n_passages"))
        .withColumnRenamed("id", id)
    )


def _windows(texts: DataFrame, whole: DataFrame, known: list[tuple[str, str]], least: float) -> DataFrame:
    """``(key, license, dice)`` of the windows that match outside of the passages that do, once for equal texts."""
    spark = texts.sparkSession
    rows = []
    for t, (name, text) in enumerate(known):
        w = _template_words(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        rows.append((t, name, pairs, len(pairs), len(w), ceil(len(pairs) * least / (2 - least) - 1e-9)))
    table = spark.createDataFrame(rows, "t int, license string, template array<string>, b int, long int, need int")
    small = sum(len(p) for r in rows for p in r[2]) <= MOST_BROADCAST_BYTES // 20
    side = lambda df: F.broadcast(df) if small else df

    def near(parts: DataFrame) -> DataFrame:
        """Where enough bigrams of a template stand within its size: the places of the first of them."""
        pair = F.transform(F.expr("sequence(0, size(words) - 2)"), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
        at = parts.where(F.size("words") > 1).select("key", "part", F.posexplode(pair).alias("pos", "pair"))
        met = at.join(side(table.select("t", F.explode("template").alias("pair"))), "pair")
        spots = met.groupBy("key", "part", "t").agg(F.array_sort(F.collect_set("pos")).alias("spots")).join(side(table), "t").where("size(spots) >= need")
        first = F.expr("filter(spots, (x, i) -> i + need <= size(spots) and get(spots, i + need - 1) <= x + long - 2)")
        return spots.withColumn("first", first).where(F.size("first") > 0)

    keys = stored(near(texts.select("key", F.lit(0).alias("part"), words_of(F.col("body")).alias("words"))).select("key").distinct(), "texts_near_licenses")
    taken = whole.groupBy("key").agg(F.collect_set("p").alias("taken"))
    gone = lambda p: F.array_contains(F.coalesce("taken", F.array().cast("array<string>")), p)
    lines = lambda p: F.array_join(F.transform(F.split(p, "\n"), lambda x: F.when(gone(x), "\0").otherwise(x)), "\n")
    left = F.transform(F.split("body", r"\n\s*\n"), lambda p: F.when(gone(p), "\0").otherwise(lines(p)))
    parts = stored(
        texts.select("key", "body").join(keys, "key", "left_semi").dropDuplicates(["key"]).join(taken, "key", "left")
        .select("key", F.posexplode(F.split(F.array_join(left, "\n"), "\0")).alias("part", "body"))
        .select("key", "part", words_of(F.col("body")).alias("words")),
        "license_text_parts",
    )
    # A window that would leave the text is moved to its edge.
    at = near(parts).withColumn("x", F.explode("first")).drop("spots", "first").join(parts, ["key", "part"])
    at = at.withColumn("start", F.greatest(F.lit(0), F.least(F.col("x"), F.size("words") - F.col("long"))))
    cut = at.select("key", "part", "license", "template", "b", "start", "long", F.expr("slice(words, start + 1, long)").alias("window"))
    dice = 2 * F.size(F.array_intersect("pairs", "template")) / (F.size("pairs") + F.col("b"))
    hits = cut.withColumn("pairs", bigrams("window")).withColumn("dice", dice).where(F.col("dice") >= least)
    one = F.struct((-F.col("dice")).alias("minus"), "license", "start", (F.col("start") + F.col("long")).alias("end"))
    ranked = hits.groupBy("key", "part").agg(F.array_sort(F.collect_set(one)).alias("hits"))
    apart = F.expr(
        "aggregate(hits, slice(hits, 1, 0), (kept, h) -> if(exists(kept, k -> k.start < h.end and h.start < k.end), kept, concat(kept, array(h))))"
    )
    return ranked.select("key", F.explode(apart).alias("h")).select("key", "h.license", (-F.col("h.minus")).alias("dice"))
