"""License scans with DataFrame functions only.

A notice can match anywhere in a text, so texts are read through overlapping windows: for each
class of template lengths n, windows of 1.5 n words (rounded up) that begin at every fourth part of
that. A copy of up to 1.125 n words then lies wholly in a window. Window and template are compared by
MinHash over shingles of five words, in bands of one row. The least Jaccard similarity of a window
that holds at least `share` of a template's shingles follows from their sizes: 1/4 for a notice of
five words, 0.41 or more for the others. Each class of lengths has so many bands (65 for that notice,
31 to 35 for the others) that such a window misses all of them with a probability of at most `miss`.
Templates so retrieved are verified exactly: the share of the template's shingles, as words, that the
window holds.

Only windows around anchor words are made. Anchors are words of a template that stand in so many of
its shingles (over a fifth) that no text can hold 0.8 of them without an anchor; so nothing is
lost, and texts without any anchor are dropped by a plain search before words are split.

A text is cut to segments (of SEGMENT words, or the longest window's) that overlap by the longest
window, so that a row's windows are bounded however long the text is.

Words are runs of a-z and 0-9 after A-Z are lowered; a template under five words is one shingle of
all of them. Null or empty texts, and texts without a match, give no row. Rows of null id match like
others. Repeated ids are one document in the result, which has one row for each id and template: the
best window's containment and its first word (the earliest on a tie).
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE = 5
#: Words whose windows are made in one row, at least.
SEGMENT = 4096
#: Anchors that are searched for in whole texts before these are split to words; with more, all texts are split.
SEARCHED = 64
#: Templates of up to so many characters in all are sent to all tasks; more are joined by a shuffle.
BROADCAST_CHARS = 4 << 20


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def anchors(templates: dict[str, str], share: float = 0.8) -> set[str]:
    """For each template few long words without which fewer than share of its distinct shingles can occur."""
    out: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        every = set(_shingles(words))
        need = math.ceil(share * len(every) - 1e-9)
        free = lambda: sum(not (set(s) & out) for s in every)
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if free() < need:
                break
            out.add(word)
    return out


def window_size(n_words: int) -> int:
    """The class of a template's length: at least 1.5 n words, in steps of an eighth, so that classes stay few."""
    size = 8
    while size < 1.5 * n_words:
        size = math.ceil(size * 1.125)
    return size


def _shingle_array(words: Column, start: Column, end: Column) -> Column:
    """The shingles that lie in words[start:end) (from 0); one of all words if there are fewer than five."""
    n = end - start
    whole = F.array(F.array_join(F.slice(words, start + 1, n), " "))
    runs = F.transform(F.sequence(start, end - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    return F.array_distinct(F.when(n >= SHINGLE, runs).otherwise(whole))


def least_jaccard(n_words: int, n_shingles: int, share: float = 0.8) -> float:
    """Of a full window that just holds the share of a template with n_shingles distinct shingles."""
    need = max(1, math.ceil(share * n_shingles - 1e-9))
    return need / (n_shingles + max(need, window_size(n_words) - SHINGLE + 1) - need)


def bands_for(templates: dict[str, str], share: float = 0.8, miss: float = 1e-8) -> dict[int, int]:
    """For each class of lengths as many bands as make all of them missed with a probability of miss at most."""
    out: dict[int, int] = {}
    for text in templates.values():
        words = template_words(text)
        j = least_jaccard(len(words), len(set(_shingles(words))), share)
        wide = window_size(len(words))
        out[wide] = max(out.get(wide, 1), math.ceil(math.log(miss) / math.log(1 - j)) if j < 1 else 1)
    return out


def _signature(shingles: Column, bands: Column) -> Column:
    """bands least hashes: the shingle's hash mixed with the band's number."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def _template_rows(spark: SparkSession, templates: dict[str, str], bands: dict[int, int]) -> DataFrame:
    """(template, wide, wanted, bands): a row for each template."""
    rows = [{"template": k, "wide": (wide := window_size(len(template_words(v)))), "bands": bands[wide], "words": template_words(v)} for k, v in templates.items()]
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<template:string,wide:int,bands:int,words:array<string>>>")).alias("t")).select("t.*")
    return listed.select("template", "wide", "bands", _shingle_array(F.col("words"), F.lit(0), F.size("words")).alias("wanted"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, share: float = 0.8, miss: float = 1e-8) -> DataFrame:
    """(id_col, template, containment, first_word) for every document and template that it holds."""
    templates = TEMPLATES if templates is None else templates
    bands = bands_for(templates, share, miss)
    wide = sorted(bands)
    marks = sorted(anchors(templates, share))
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds = F.lit(len(marks) > SEARCHED)
    for mark in marks[: 0 if len(marks) > SEARCHED else None]:
        holds = holds | F.col("low").contains(mark)
    # a generator, so that the optimizer doesn't lower a text again for each anchor
    texts = docs.select(F.col(id_col).alias("id"), F.explode(F.array(low)).alias("low")).where(holds)
    whole = texts.select("id", F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != "").alias("all"))
    # segments: the windows that begin in one have all of their words in its row
    length = max([SEGMENT, *wide])
    segment = lambda g: F.struct((g * length).alias("base"), F.slice("all", g * length + 1, length + wide[-1] if wide else length).alias("words"))
    last = F.floor((F.greatest(F.size("all"), F.lit(1)) - 1) / F.lit(length)).cast("int")
    split = whole.select("id", F.explode(F.transform(F.sequence(F.lit(0), last), segment)).alias("s")).select("id", "s.*")
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(marks), F.col("base") + i)), lambda i: i.isNotNull())

    def windows(size: int) -> Column:
        """(wide, first word, words) of the segment's windows of a size that hold an anchor."""
        step = max(1, size // 4)
        # the windows that hold the anchor's place p begin at multiples of step from p - size + 1 to p
        least, most = F.col("base"), F.col("base") + F.lit(length - 1)
        low = lambda p: F.ceil(F.greatest(p - F.lit(size - 1), least) / F.lit(step)).cast("int")
        high = lambda p: F.floor(F.least(p, most) / F.lit(step)).cast("int")
        some = lambda p: F.when(low(p) <= high(p), F.sequence(low(p), high(p))).otherwise(F.array().cast("array<int>"))
        firsts = F.array_distinct(F.flatten(F.transform("at", some)))
        return F.transform(firsts, lambda g: F.struct(F.lit(size).alias("wide"), (g * step).alias("first"), F.slice("words", g * step - F.col("base") + 1, size).alias("own")))

    placed = split.withColumn("at", at).where("size(at) > 0")
    cut = placed.select("id", F.explode(F.concat(*map(windows, wide))).alias("w")).select("id", "w.*")
    shingled = cut.select("id", "wide", "first", _shingle_array(F.col("own"), F.lit(0), F.size("own")).alias("held"))
    n_bands = F.element_at(F.create_map(*[F.lit(x) for pair in bands.items() for x in pair]), F.col("wide"))
    signed = shingled.select("id", "wide", "first", "held", F.posexplode(_signature(F.col("held"), n_bands)).alias("band", "value"))
    listed = _template_rows(docs.sparkSession, templates, bands)
    keys = listed.select("template", "wide", F.posexplode(_signature(F.col("wanted"), F.col("bands"))).alias("band", "value"))
    wanted = listed.select("template", "wanted")
    if sum(map(len, templates.values())) <= BROADCAST_CHARS:
        keys, wanted = F.broadcast(keys), F.broadcast(wanted)
    hits = signed.join(keys, ["wide", "band", "value"]).join(wanted, "template")
    contained = (F.size(F.array_intersect("held", "wanted")) / F.size("wanted")).alias("containment")
    found = hits.select("id", "template", "first", contained).where(F.col("containment") >= share)
    best = found.groupBy("id", "template").agg(F.max(F.struct("containment", (-F.col("first")).alias("back"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "template", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("first_word"))
