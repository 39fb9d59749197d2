"""License scans: a trained paragraph classifier with template confirmation.

A paragraph is a line. Features are the words and word pairs of the license
templates, by presence; a sparse (L1) multinomial logistic regression with the
classes of ``TEMPLATES`` and ``unknown`` is fitted on the driver to varied
templates and to a bounded sample of the corpus's own lines (the first four of
``SAMPLE`` documents of at most 8 kB), and
its temperature is set on held-back variants so that probabilities are
calibrated. A prediction counts when its probability is at least ``CERTAIN``
and the words of the paragraph agree with a template of that family.

The scan is one pass of DataFrame functions without a shuffle. Each feature
contains one of the gate words, so a line without gate words has no feature
and is ``unknown`` by construction; only the other lines are scored.

Defined results: null or empty text has no paragraph; blank lines are not
paragraphs; a document without a confirmed paragraph has license ``none``;
ties go to the family that sorts first. Rows keep their multiplicity.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 400  # documents whose lines teach the unknown class
CERTAIN, AGREE = 0.5, 0.6

#: Short public notices of each family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GPL v2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
}
#: Sentences with license words that grant nothing.
NEAR_MISSES = (
    "You need a valid driver license to rent a car in this state.",
    "The restaurant lost its liquor license after the inspection.",
    "All rights reserved by the publisher of this version.",
    "The public library is open to any person free of charge.",
    "MIT researchers released a new version of the study.",
    "The general terms of the contract are permitted by law.",
    "Software engineers may use this file to obtain a copy of the source.",
    "The foundation published the work in the public interest.",
)
#: Function words. A feature needs another word beside them.
FUNCTION_WORDS = frozenset("""a all an and any are as at be been by can for from has have in is it may no not of on or that
the this to use used was were will with you your""".split())
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


TEMPLATE_WORDS = [set(tokens(t)) for ts in TEMPLATES.values() for t in ts]


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]  # features x classes
    bias: tuple[float, ...]
    gate: tuple[str, ...]


def _variants(words: list[str], noise: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    out = [words]
    for _ in range(n):
        lo = int(rng.integers(0, max(1, len(words) // 3)))
        part = words[lo:lo + max(3, int(rng.integers(len(words) // 2, len(words) + 1)))]
        part = [w for w in part if rng.random() > 0.06] or words
        around = [noise[int(i)] for i in rng.integers(0, len(noise), int(rng.integers(0, 8)))] if noise else []
        out.append(around[:len(around) // 2] + part + around[len(around) // 2:])
    return out


def agrees(words: list[str]) -> bool:
    """Whether a line agrees with a template of some family, as in ``scored``."""
    own = set(words)
    return any(max(len(own & t) / len(own), len(own & t) / len(t)) >= AGREE for t in TEMPLATE_WORDS)


def train(unlicensed: list[str], seed: int = 3, l1: float = 4e-4, steps: int = 300) -> Model:
    """Fit on template variants and on ``unlicensed`` lines; equal lines count
    once, and lines that agree with a template teach nothing."""
    rng = np.random.default_rng(seed)
    classes = tuple(sorted(TEMPLATES)) + (UNKNOWN,)
    plain = [t for t in map(list, dict.fromkeys(map(tuple, map(tokens, unlicensed)))) if t and not agrees(t)]
    others = plain + [tokens(t) for t in NEAR_MISSES] * 5
    noise = [w for t in others[:200] for w in t[:20]]
    rows = [(v, c) for c, family in enumerate(classes[:-1]) for t in TEMPLATES[family]
            for v in _variants(tokens(t), noise, rng, 24)]
    rows += [(t, len(classes) - 1) for t in others]
    rows += [([], len(classes) - 1)] * 20
    common = Counter(w for t in plain for w in set(t))
    names = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))})
    # a feature's gate word, its rarest in lines without license, only chooses the lines to score
    gate_of = {g: min(ws, key=lambda w: (common[w], -len(w), w)) for g in names
               if (ws := [w for w in g.split(" ") if len(w) > 1 and not w.isdigit() and w not in FUNCTION_WORDS])}
    names = [g for g in names if g in gate_of]
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (t, _) in enumerate(rows):
        x[i, [at[g] for g in grams(t) if g in at]] = 1
    y = np.eye(len(classes))[[c for _, c in rows]]
    held = np.arange(len(rows)) % 5 == 4
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    share = (1 / np.maximum(1, y[~held].sum(axis=0)))[y[~held].argmax(axis=1)]
    share /= share.sum()
    # equal rows (most unlicensed lines have no feature) count once, with their weight
    both, where = np.unique(np.hstack([x[~held], y[~held]]), axis=0, return_inverse=True)
    share = np.bincount(where.ravel(), share)
    seen, wanted = both[:, :len(names)], both[:, len(names):]
    for _ in range(steps):
        gap = (_softmax(seen @ w + b) - wanted) * share[:, None]
        w -= 1.0 * (seen.T @ gap)
        w = np.sign(w) * np.maximum(np.abs(w) - l1, 0)
        b -= 1.0 * gap.sum(axis=0)
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda h: -np.mean(np.log(
        _softmax((x[held] @ w + b) / h)[np.arange(held.sum()), y[held].argmax(axis=1)] + 1e-9)))
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    gate = sorted({gate_of[names[i]] for i in used})
    return Model(classes, tuple(names[i] for i in used), tuple(tuple((w[i] / heat).tolist()) for i in used),
                 tuple((b / heat).tolist()), tuple(gate))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train with lines of the SAMPLE documents of smallest hash (of those of
    at most 8 kB) that name no license."""
    few = (docs.where(F.octet_length(text_col) <= 8192).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))
           .orderBy("h", "t").limit(SAMPLE).collect())
    lines = [x for r in few for x in (r["t"] or "").split("\n")[:4]
             if x.strip() and not re.search(r"licen[sc]|copyright|spdx|public domain", x, re.I)]
    return train(lines)


def _plain(line: Column) -> Column:
    """Words in lower case with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")), F.lit(" "))


def _gate(model: Model) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(model.gate)})(?![a-z0-9])"


def _constant(value, kind: str) -> Column:
    """A nested literal (folded once when the plan is made)."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def scored(model: Model, lines: Column) -> Column:
    """array<struct(paragraph, family, probability, agreement)> of gated lines
    (n, t). Each step is a transform of its own: a later one reads the values
    that an earlier one made."""
    table = _constant([{"n": f" {n} ", "w": w} for n, w in zip(model.features, model.weights)],
                      "array<struct<n:string,w:array<double>>>")
    start = _constant(model.bias, "array<double>")
    summed = F.transform(lines, lambda s: F.struct(s["n"], s["t"], F.aggregate(
        F.filter(table, lambda f: F.contains(s["t"], f["n"])), start,
        lambda acc, f: F.zip_with(acc, f["w"], lambda a, v: a + v)).alias("z")))
    topped = F.transform(summed, lambda s: F.struct(
        s["n"], F.array_distinct(F.split(F.trim(s["t"]), " ")).alias("words"), s["z"], F.array_max(s["z"]).alias("top")))
    placed = F.transform(topped, lambda s: F.struct(
        s["n"], s["words"], F.array_position(s["z"], s["top"]).cast("int").alias("c"),
        (F.lit(1.0) / F.aggregate(s["z"], F.lit(0.0), lambda acc, v: acc + F.exp(v - s["top"]))).alias("p")))
    names = _constant(model.classes, "array<string>")
    templates = _constant([[sorted(set(tokens(t))) for t in TEMPLATES.get(c, ())] for c in model.classes],
                          "array<array<array<string>>>")

    def agreement(words: Column, own: Column) -> Column:
        shared = F.size(F.array_intersect(words, own))
        # a part of the template, or the template within more text
        return F.greatest(shared / F.size(words), shared / F.size(own))

    return F.transform(placed, lambda s: F.struct(
        s["n"].alias("paragraph"), F.element_at(names, s["c"]).alias("family"), s["p"].alias("probability"),
        F.aggregate(F.element_at(templates, s["c"]), F.lit(0.0),
                    lambda best, own: F.greatest(best, agreement(s["words"], own))).alias("agreement")))


def paragraphs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, found): ``found`` lists number, family, probability
    and agreement of each line with gate words."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    gate = _gate(model)
    rows = docs.select(F.col(id_col), F.filter(lines, lambda x: F.trim(x) != "").alias("__lines"),
                       F.coalesce(F.col(text_col), F.lit("")).rlike(gate).alias("__any"))
    numbered = F.when(F.col("__any"), F.filter(F.transform("__lines", lambda x, i: F.struct(
        i.alias("n"), F.when(x.rlike(gate), _plain(x)).alias("t"))), lambda s: s["t"].isNotNull()))
    none = F.array().cast("array<struct<n:int,t:string>>")
    rows = rows.select(id_col, F.size("__lines").cast("long").alias("n_paragraphs"),
                       F.coalesce(numbered, none).alias("__gated"))
    return rows.select(id_col, "n_paragraphs", F.size("__gated").cast("long").alias("n_scored"),
                       scored(model, F.col("__gated")).alias("found"))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_paragraphs, n_scored, n_licensed,
    license, probability, agreement, families)."""
    model = model or fit(docs, id_col, text_col)
    rows = paragraphs(docs, model, id_col, text_col)
    sure = F.filter("found", lambda p: (p["family"] != UNKNOWN) & (p["probability"] >= CERTAIN)
                    & (p["agreement"] >= AGREE))
    rows = rows.withColumn("__sure", sure)
    best = F.array_max(F.transform("__sure", lambda p: F.struct(
        p["probability"].alias("p"), p["agreement"].alias("a"), (-p["paragraph"]).alias("n"),
        p["family"].alias("f"))))
    rows = rows.withColumn("__best", best)
    return rows.select(
        id_col, "n_paragraphs", "n_scored", F.size("__sure").cast("long").alias("n_licensed"),
        F.coalesce("__best.f", F.lit("none")).alias("license"), F.coalesce("__best.p", F.lit(0.0)).alias("probability"),
        F.coalesce("__best.a", F.lit(0.0)).alias("agreement"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__sure", lambda p: p["family"]))), ",").alias("families"))
