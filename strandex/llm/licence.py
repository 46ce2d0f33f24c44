"""Licence scans: a trained paragraph classifier, scored and confirmed with DataFrame functions only."""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandex.llm.common import table

UNKNOWN = "unknown"
#: Least probability of a family, and least share of word pairs in common with one of its templates.
CONFIDENCE, SIMILARITY = 0.6, 0.8
#: Word pairs that confirm; a template that has fewer confirms only a paragraph that has all of them and little else.
PAIRS = 3
#: Where a paragraph ends: at a blank line, or where a line ends a sentence. Lines that are broken inside a sentence stay together.
BREAK = r"\r?\n[ \t\r]*(?:\n[ \t\r]*)+|(?<=[.!?:;])[ \t\r]*\n"
SLOTS, SEED = 512, 3

# Notices and opening words of well-known licences.
TEMPLATES = {
    "apache-2.0": [
        "Apache License",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the terms of the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "GNU General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPLv3.",
        "GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "GNU General Public License Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPLv2.",
        "GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain under CC0.",
    ],
    "proprietary": [
        "Copyright (c) 2020 Example Corp. All rights reserved.",
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: A feature is an n-gram that has one of these words; a paragraph without them has no feature.
ANCHORS = (
    "license licenses licensed licensing licence licences licensed licencing copyright copyrighted spdx apache mit gnu gpl gplv2 gplv3 lgpl agpl affero bsd mozilla mpl cc cc0 creative commons "
    "redistribution redistribute permission permitted unauthorized proprietary reserved warranty domain waived"
).split()
_OTHERS = [
    "the license plate of the car was {w}", "a driver's license is {w} {w}", "we need permission to {w}", "this {w} is licensed under the {w} {w} license version {n}", "copyright law in {w} {w}",
    "released under the {w} license", "{w} in the public domain of {w}", "the creative {w} of the commons {w}", "distributed under the eclipse {w} license {n}", "tickets are reserved for {w}",
    "warranty of {w} {w} for {n} years", "{w} {w} apache helicopter {w}", "{w} studies at mit with {w}", "all seats reserved {w}", "house of commons {w} {w}", "{w} license {w}", "the {w} gnu {w} antelope",
    "{w} {w} mit {w} {w}", "{w} mit der {w} und mit dem {w}", "mit {w} {w}", "{w} mit {w}, mit {w} und mit {w}", "sie kam mit {w} cc {w}", "{w} com permission de {w} {w}",
]
_TOKEN = re.compile(r"[a-z0-9]+")
_ANCHORS = frozenset(ANCHORS)


def _grams(words: list[str], low: int = 1, high: int = 3) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def grams(text: str) -> set[str]:
    """The features of a paragraph: its distinct runs of one to three words that have an anchor."""
    return {g for g in _grams(_TOKEN.findall(text.lower())) if not _ANCHORS.isdisjoint(g.split(" "))}


def _examples(rnd: random.Random) -> tuple[list[str], list[str]]:
    """Paragraphs made from the templates by changing their surroundings and words, and ones that only look alike."""
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8)))
    texts, names = [], []
    for name, templates in TEMPLATES.items():
        for template in templates:
            for k in range(40):
                words = template.split()
                if k and len(words) > 8 and rnd.random() < 0.5:
                    words = words[: rnd.randint(8, len(words))]
                if k and rnd.random() < 0.3:
                    words[0:0] = rnd.choice(["This file is", "Note:", "*", "//", "#", "Copyright 2021 J. Doe.", word()]).split()
                if k and rnd.random() < 0.3:
                    words += [word() for _ in range(rnd.randint(1, 6))]
                if k and len(words) > 12 and rnd.random() < 0.3:
                    words[rnd.randrange(6, len(words))] = word()
                texts.append(" ".join(words))
                names.append(name)
    for _ in range(1600):
        text = rnd.choice(_OTHERS)
        while "{" in text:
            text = text.replace("{w}", word(), 1).replace("{n}", str(rnd.randint(1, 9)), 1)
        texts.append(text + " " + " ".join(word() for _ in range(rnd.randint(0, 9))))
        names.append(UNKNOWN)
    return texts, names


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    heat: float

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for g in grams(text):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        e = np.exp((z - z.max()) / self.heat)
        return e / e.sum()


@lru_cache(maxsize=1)
def default_model(seed: int = SEED) -> Model:
    """Softmax regression with an L1 penalty, by proximal gradient steps; its heat is fitted on paragraphs it hasn't seen."""
    rnd = random.Random(seed)
    texts, names = _examples(rnd)
    classes = (*TEMPLATES, UNKNOWN)
    found = [grams(t) for t in texts]
    counts: dict[str, int] = {}
    for g in found:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    vocabulary = sorted(g for g, n in counts.items() if n >= 8)
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float64)
    for i, g in enumerate(found):
        x[i, [at[w] for w in g if w in at]] = 1
    y = np.eye(len(classes))[[classes.index(n) for n in names]]
    held = np.array([rnd.random() < 0.25 for _ in texts])
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
    xt, yt = x[~held], y[~held]
    step = 4.0
    for _ in range(250):
        z = xt @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - yt) / len(xt)
        w, b = w - step * (xt.T @ g), b - step * g.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * 2e-5, 0)
    z, truth = x[held] @ w + b, y[held].argmax(axis=1)

    def loss(heat: float) -> float:
        s = z / heat
        top = s.max(axis=1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    heat = min(np.linspace(0.3, 3.0, 55), key=loss)
    weights = {g: tuple(round(float(v), 2) for v in w[i]) for g, i in at.items() if np.abs(w[i]).max() >= 0.05}
    return Model(classes, tuple(round(float(v), 3) for v in b), weights, float(heat))


def _slot(gram: str) -> int:
    """Where Spark's xxhash64 of the same string puts it."""
    signed = xxhash.xxh64_intdigest(gram, 42)
    return (signed - (1 << 64) if signed >> 63 else signed) % SLOTS


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _spans(words: Column, n: int) -> Column:
    """The runs of n words of an array, space-joined."""
    last = F.size(words) - n + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def _with_anchor(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(a) for a in dict.fromkeys(ANCHORS)]))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, family, probability, similarity, confirmed)``: a row for each paragraph of a known family.

    A paragraph, numbered from 0, ends at a blank line or where a line ends a sentence (BREAK). Words are runs of a-z and 0-9
    of the lower-cased text, features their distinct runs of one to three words that have an anchor: the vocabulary that the model is
    trained on has no others. The family is the likeliest class if its probability is at least CONFIDENCE, else the
    paragraph is unknown and gives no row; one without any anchor has no feature, which the model calls unknown, so it isn't scored at all.
    A family is confirmed if one of its templates and the paragraph share at least SIMILARITY of the word pairs of the smaller, and
    PAIRS of them; with a template of fewer pairs, such as a title, of both. Rows of ``docs`` that repeat give their rows
    again; null and empty texts and empty tables give none; other columns aren't read. All of it is one projection
    over the scan: no shuffle, no Python.
    """
    model = model or default_model()
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for g, w in model.weights.items():
        slots[_slot(g)].append({"g": g, "w": w})
    weights = _literal(slots, "array<array<struct<g:string,w:array<double>>>>")
    shapes = _literal(
        [{"family": name, "pairs": sorted(set(_grams(_TOKEN.findall(t.lower()), 2, 2)))} for name, ts in TEMPLATES.items() for t in ts],
        "array<struct<family:string,pairs:array<string>>>",
    )
    zero = F.array(*[F.lit(float(b)) for b in model.bias])
    names = F.array(*[F.lit(c) for c in model.classes])
    anchor = r"(?<![a-z0-9])(?:" + "|".join(dict.fromkeys(ANCHORS)) + r")(?![a-z0-9])"
    lines = F.filter(
        F.transform(F.split(F.col(text_col), BREAK), lambda line, i: F.struct(i.alias("paragraph"), F.lower(line).alias("line"))),
        lambda x: x["line"].rlike(anchor),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(lines).alias("x"))
    rows = rows.select("doc_id", F.col("x.paragraph").alias("paragraph"), F.filter(F.split("x.line", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    features = F.filter(F.array_distinct(F.concat(*[_spans(F.col("words"), n) for n in (1, 2, 3)])), lambda g: _with_anchor(F.split(g, " ")))
    rows = rows.withColumn("grams", features).withColumn("pairs", F.array_distinct(_spans(F.col("words"), 2)))
    slot = lambda g: F.element_at(weights, (F.pmod(F.xxhash64(g), F.lit(SLOTS)) + 1).cast("int"))
    known = F.flatten(F.transform("grams", lambda g: F.filter(slot(g), lambda e: e["g"] == g)))
    rows = rows.withColumn("z", F.aggregate(known, zero, lambda acc, e: F.zip_with(acc, e["w"], lambda a, b: a + b)))
    rows = rows.withColumn("e", F.transform("z", lambda v: F.exp((v - F.array_max("z")) / model.heat)))
    rows = rows.withColumn("probability", F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    best = F.element_at(names, F.array_position("e", F.array_max("e")).cast("int"))
    rows = rows.withColumn("family", F.when(F.col("probability") >= CONFIDENCE, best).otherwise(F.lit(UNKNOWN)))

    def alike(t: Column) -> Column:
        both = F.size(F.array_intersect("pairs", t["pairs"]))
        few, many = F.least(F.size("pairs"), F.size(t["pairs"])), F.greatest(F.size("pairs"), F.size(t["pairs"]))
        return both / F.greatest(F.when(both >= PAIRS, few).otherwise(many), F.lit(1))

    own = F.transform(F.filter(shapes, lambda t: t["family"] == F.col("family")), alike)
    similarity = F.coalesce(F.array_max(own), F.lit(0.0))
    found = F.struct("family", F.round("probability", 6).alias("probability"), similarity.alias("similarity"))
    # a plain filter would be pushed down and have the model evaluated again for itself
    rows = rows.select("doc_id", "paragraph", F.explode(F.filter(F.array(found), lambda r: r["family"] != UNKNOWN)).alias("r"))
    return rows.select("doc_id", "paragraph", "r.*", (F.col("r.similarity") >= SIMILARITY).alias("confirmed"))


def op2_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
