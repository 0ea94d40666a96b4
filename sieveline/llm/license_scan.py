"""Licence scans: a word n-gram logistic regression names a paragraph's licence family; its templates confirm it.

The model is trained on the driver from the templates below (a fixed, bounded set); tables are scanned in DataFrame functions
only. Features are the words and word pairs of the templates. Every template has an anchor word, so that a text without any
has no licence paragraph and costs one search; all other paragraphs are scored whole.
"""

from __future__ import annotations

import functools
import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statements by which works name their licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. The software is provided as is, without warranty of any kind.",
        "SPDX-License-Identifier: MIT",
        "Available under the MIT License.",
        "Lizenziert unter der MIT-Lizenz.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache 2.0",
    ),
    "bsd": (
        "This software is released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "This software is released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GPL",
        "GPLv2",
        "GPLv3",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "GNU LGPL",
        "LGPLv3",
    ),
    "mpl": (
        "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC-ND 4.0 for non-commercial use.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under the CC0 1.0 Universal license.",
        "Released into the public domain; no copyright is claimed.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder.",
        "All rights reserved. Confidential and proprietary; no licence is granted.",
    ),
}
ANCHORS = ("licens", "licenc", "copyright", "rights reserved", "public domain", "redistribution", "permission is hereby")
#: Features of at least this weight over the unknown class are telling, unless all their words are ordinary ones or numbers.
TELLING = 0.5
ORDINARY = frozenset(
    "a above all also and any are as associated at be been binary by can charge claimed clause code compliance conditions confidential contains copy "
    "creative dealing deal dedicated details disclaimer documentation domain either except file files following for form forms foundation free from "
    "general granted has hereby holder identifier in international into is it kind later lesser library list may met modification modify must "
    "nc no not notice obtain obtaining of only or org part permission permitted person prior program project proprietary provided public "
    "publication published redistribute reproduced reserved restriction retain rights sa see software source subject terms text that the this "
    "der unter to under universal use uses v version with without work written you your attribution available commercial non nd released".split()
)
#: Words that tell only in a pair: alone they are words of other languages or topics.
PAIRED = frozenset(("mit", "cc", "commons", "warranty"))
#: Pairs of ordinary words of another language.
ORDINARY_PAIRS = frozenset(("der mit",))
UNKNOWN = "unknown"
#: Identifiers of licences without a family here: statements of them are trained as unknown.
OTHER_IDS = ("ISC", "Zlib", "Unlicense", "EPL-2.0", "AGPL-3.0-only", "0BSD", "WTFPL", "OFL-1.1", "BSL-1.0", "EUPL-1.2", "PostgreSQL", "NCSA")
#: Templates of so many words are names of a licence: they are trained whole, and texts that only sound like licences are made without their words.
SHORT = 2
#: Share of the best template's n-grams that a paragraph must hold.
CONFIRM = 0.6
#: Held-out paragraphs of no licence that may get a family, in the calibration of the threshold.
FALSE_SHARE = 0.005
_WORD = "[a-z0-9]+"


def grams_of(text: str) -> list[str]:
    """Distinct words and word pairs, in the way of grams_column."""
    w = re.findall(_WORD, text.lower())
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # the last one is UNKNOWN
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float


def _paragraphs(rng: random.Random, n: int) -> list[tuple[str, int]]:
    """Training paragraphs with the position of their family: worn copies of templates, and texts that only sound like them."""
    families = [*TEMPLATES]
    filler = "the a and of to in is that it with for on as was by this from are an be or at not have which page note report about people year time work world first new also more other".split()
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts if len(t.split()) > SHORT for w in re.findall(_WORD, t.lower())})
    out = []
    for k in range(n):
        words = rng.choices(filler, k=rng.randint(0, 12))
        if k % 3:
            f = rng.randrange(len(families))
            own = rng.choice(TEMPLATES[families[f]]).split()
            own = own if len(own) <= SHORT else [w for w in own if rng.random() > 0.06]
            at = rng.randint(0, len(words))
            words[at:at] = own
        else:
            f = len(families)
            if k % 15 == 0:
                out.append((" ".join([*words, "SPDX-License-Identifier:", rng.choice(OTHER_IDS)]), f))
                continue
            words += rng.choices(vocabulary, k=rng.randint(1, 8))
            words += [rng.choice(("license", "licensed", "copyright", "redistribution", "licence"))]
            rng.shuffle(words)
        out.append((" ".join(words), f))
    return out


@functools.lru_cache(maxsize=1)
def train(n: int = 3000, seed: int = 11, epochs: int = 200) -> LicenceModel:
    """Multinomial logistic regression with L2 on n made paragraphs; the threshold is calibrated on as many others."""
    families = (*TEMPLATES, UNKNOWN)
    features = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(t)})
    at = {g: i for i, g in enumerate(features)}

    def matrix(rows):
        x = np.zeros((len(rows), len(features)))
        for i, (t, _) in enumerate(rows):
            x[i, [at[g] for g in grams_of(t) if g in at]] = 1
        return x

    rng = random.Random(seed)
    rows, held = _paragraphs(rng, n), _paragraphs(rng, n)
    x, y = matrix(rows), np.eye(len(families))[[f for _, f in rows]]
    w, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    vw, vb = np.zeros_like(w), np.zeros_like(b)

    def soft(x):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(epochs):
        d = (soft(x) - y) / len(rows)
        vw = 0.9 * vw - 1.5 * (x.T @ d + 2e-5 * w)
        vb = 0.9 * vb - 1.5 * d.sum(axis=0)
        w, b = w + vw, b + vb
    p = soft(matrix(held))
    unknown = np.array([f for _, f in held]) == len(families) - 1
    wrong = np.sort(p[unknown, :-1].max(axis=1))[::-1]
    threshold = max(0.5, float(wrong[int(FALSE_SHARE * len(wrong))]))
    return LicenceModel(families, {g: [round(float(v), 5) for v in w[i]] for g, i in at.items()}, [round(float(v), 5) for v in b], threshold)


def grams_column(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    pairs = F.transform(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(F.concat(words, pairs))


def _literal(value, kind: str) -> Column:
    """A constant of a nested type; the optimiser folds it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@functools.lru_cache(maxsize=1)
def telling_features() -> tuple[str, ...]:
    """The model's features that a paragraph of a licence may be known by where it has no anchor."""
    model = train()
    odd = lambda w: w not in ORDINARY and not w.isdigit()
    strong = [g for g, w in model.weights.items() if max(w[:-1]) - w[-1] >= TELLING]
    alone = {g for g in strong if " " not in g and odd(g) and g not in PAIRED}
    pairs = {g for g in strong if " " in g and any(map(odd, g.split())) and not alone & set(g.split()) and g not in ORDINARY_PAIRS}
    return tuple(sorted(g for g in alone | pairs if not any(a in g for a in ANCHORS)))


def gate_pattern() -> str:
    """What a lower-cased text must hold to be scored: an anchor, or a telling feature between bounds of words."""
    words = "|".join("[^a-z0-9]+".join(g.split()) for g in telling_features())
    return f"{'|'.join(ANCHORS)}|(?<![a-z0-9])(?:{words})(?![a-z0-9])"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _score(text: Column, model: LicenceModel, confirm: float) -> Column:
    """struct(family, probability, overlap) of a text."""
    zero = _literal(model.bias, "array<double>")
    weights = _literal(model.weights, "map<string,array<double>>")
    names = _literal(list(model.families), "array<string>")
    templates = _literal([[grams_of(t) for t in TEMPLATES.get(f, ())] for f in model.families], "array<array<array<string>>>")

    def named(grams: Column, logits: Column) -> Column:
        top = F.array_max(logits)
        best = F.array_position(logits, top).cast("int")
        probability = 1 / F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))
        overlap = F.coalesce(F.array_max(F.transform(F.element_at(templates, best), lambda t: F.size(F.array_intersect(t, grams)) / F.size(t))), F.lit(0.0))
        family = lambda p: F.when((p["probability"] >= model.threshold) & (p["overlap"] >= confirm), F.element_at(names, p["best"])).otherwise(UNKNOWN)
        return _let(F.struct(best.alias("best"), probability.alias("probability"), overlap.alias("overlap")), lambda p: F.struct(family(p).alias("family"), p["probability"].alias("probability"), p["overlap"].alias("overlap")))

    def scored(grams: Column) -> Column:
        known = F.array_intersect(grams, F.map_keys(weights))
        logits = F.aggregate(known, zero, lambda acc, g: F.zip_with(acc, F.try_element_at(weights, g), lambda a, b: a + b))
        return _let(logits, lambda z: named(grams, z))

    return _let(grams_column(text), scored)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that the optimiser computes once and does not copy into its uses."""
    return rows.withColumn(name, F.explode(F.array(value)))


def scan_licenses(docs: DataFrame, model: LicenceModel | None = None, confirm: float = CONFIRM) -> DataFrame:
    """One row per paragraph that speaks of a licence: doc_id, paragraph (number of its first line, from 1), family, probability, overlap, text.

    Lines that hold an anchor or a telling feature are scored each. Between the lines that are named so and blank lines, two or
    more lines that hold one, also across a line's end, are scored as one paragraph: it is a row where it is named, in the place
    of its lines, or where no line of it holds one by itself. family is the model's where its probability reaches the calibrated
    threshold and the paragraph holds the `confirm` share of the n-grams of one of that family's templates (overlap); else
    "unknown". Null and empty texts, and those without anchor and telling feature, give no rows; repeated rows give theirs each; a
    null doc_id stays null; an empty table gives no rows. Other columns are not read.
    """
    model = model or train()
    gate = lambda c: F.lower(c).rlike(gate_pattern())
    rows = docs.select("doc_id", F.col("text").alias("_text")).where(gate(F.col("_text")))
    # blocks end at the line end before a blank line: each separator is one line end
    rows = _once(rows, "_blocks", F.split("_text", r"\n(?=[^\S\n]*(?:\n|$))")).drop("_text")
    blocks = F.filter(F.transform("_blocks", lambda b, i: F.struct(i.alias("i"), b.alias("text"))), lambda b: gate(b["text"]))
    blocks = F.transform(blocks, lambda b: F.struct(F.aggregate(F.slice(F.col("_blocks"), F.lit(1), b["i"]), F.lit(1), lambda n, x: n + _newlines(x) + 1).alias("first"), F.split(b["text"], r"\r?\n").alias("lines")))
    rows = rows.select("doc_id", F.explode(blocks).alias("_block")).select("doc_id", F.col("_block.first").alias("_first"), F.col("_block.lines").alias("_lines"))
    rows = _once(rows, "_scores", F.transform("_lines", lambda x: F.when(gate(x), _score(x, model, confirm))))
    ends = F.transform(F.filter(F.transform("_scores", lambda s, i: F.struct(i.alias("i"), s["family"].alias("f"))), lambda s: F.coalesce(s["f"] != UNKNOWN, F.lit(False))), lambda s: s["i"])
    rows = _once(rows, "_ends", F.concat(F.array(F.lit(-1)), ends, F.array(F.size("_lines"))))
    # each part: the lines after one end, with the named line that ends it
    rows = rows.select("doc_id", "_first", "_lines", "_scores", "_ends", F.explode(F.sequence(F.lit(1), F.size("_ends") - 1)).alias("_k"))
    low, high = F.element_at("_ends", F.col("_k")), F.element_at("_ends", F.col("_k") + 1)
    part = lambda c: F.slice(F.col(c), low + 2, high - low - 1)
    rows = rows.select("doc_id", (F.col("_first") + low + 1).alias("_first"), part("_lines").alias("_lines"), part("_scores").alias("_scores"),
        F.get("_lines", high).alias("_named"), F.get("_scores", high).alias("_named_score"))
    rows = _once(rows, "_whole", F.array_join("_lines", "\n"))
    full = F.size(F.filter("_lines", lambda x: x.rlike(r"\S"))) > 1
    rows = _once(rows, "_score", F.when(full & gate(F.col("_whole")), _score(F.col("_whole"), model, confirm)))
    found = lambda at, score, text: F.struct(at.cast("int").alias("paragraph"), score["family"].alias("family"), score["probability"].alias("probability"), score["overlap"].alias("overlap"), text.alias("text"))
    blank = F.size(F.split(F.regexp_extract("_whole", r"^((?:[^\S\n]*\n)*)", 1), "\n")) - 1
    whole = F.array(found(F.col("_first") + blank, F.col("_score"), F.trim(F.col("_whole"))))
    lines = F.filter(F.transform("_lines", lambda x, i: found(F.col("_first") + i, F.get("_scores", i), x)), lambda r: r["family"].isNotNull())
    one = F.col("_score").isNotNull() & ((F.col("_score.family") != UNKNOWN) | (F.size(lines) == 0))
    named = F.when(F.col("_named_score").isNotNull(), F.array(found(F.col("_first") + F.size("_lines"), F.col("_named_score"), F.col("_named")))).otherwise(F.array().cast("array<struct<paragraph:int,family:string,probability:double,overlap:double,text:string>>"))
    return rows.select("doc_id", F.explode(F.concat(F.when(one, whole).otherwise(lines), named)).alias("_r")).select("doc_id", "_r.*")
