"""License families of paragraphs, by DataFrame functions alone.

A trained paragraph classifier: word 1- and 2-grams of training paragraphs feed
a multinomial logistic regression with an `unknown` class, whose probabilities
are calibrated by a temperature fitted on sentences that are not in the
training set.  A prediction counts when its probability reaches
MIN_PROBABILITY and a template of the family has MIN_OVERLAP of its n-grams in
the paragraph.  Paragraphs are lines, and runs of adjacent lines without a
blank one between them, as a wrapped notice is torn over several: runs have
RUN_LINES lines and RUN_WORDS words at most (more than any template has).  Of
all sets of notices that share no line, the one that matches most n-grams of
templates in all counts, then the one of fewest notices, then of fewest lines,
then the one that ends first: a wrapped notice outweighs its own pieces, and
notices on adjacent lines outweigh the run that holds them.  The set comes from
a dynamic program along the lines whose state is the last RUN_LINES of them, so
time grows with the number of notices, however many stand in one text.

Only runs that hold a word of `gate()` are classified.  The gate follows from
the templates and loses nothing: of each template it has so many words that
the n-grams without them are less than MIN_OVERLAP of it, so a run with none of
its words confirms no template (tests compare with a scan of all runs).

The model is small and fixed in size (it is fitted on the sentences below), so
its tables are literals of the plan, n-grams in buckets by crc32: one narrow
pass, no join, no shuffle, no Python on the executors.  The default model is
fitted once a process.  Defined results: a null or empty text has no
paragraph; a text without a family has null license and probability 0; ties go
to the family first by name; repeated rows each give a row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.62
RUN_LINES, RUN_WORDS = 16, 60
#: Buckets of the table of weights.
BUCKETS = 512

# Notices of public licence families, in their usual words; each is a template and a training paragraph.
TEMPLATES = {
    "agpl": [
        "GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the AGPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0", "Apache License, Version 2.0, January 2004", "Released under the Apache License.", "Distributed under the Apache 2.0 license.",
    ],
    "bsd": [
        "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD 3-Clause License", "BSD 2-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under the Creative Commons Attribution-NonCommercial License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "Available under the Creative Commons Attribution-NonCommercial-ShareAlike License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Available under the Creative Commons Attribution-ShareAlike License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License, version 3", "Released under the GPL license.", "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": ["ISC License", "SPDX-License-Identifier: ISC", "Licensed under the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the LGPL.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "MIT License", "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify and merge.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
    "public-domain": ["This work is in the public domain.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."],
}
UNKNOWN = [
    "The driver must hold a valid license.", "Her license was renewed in the spring.", "They released the record under a new name.", "A version of the work was shown in public.",
    "The general was a public man and free of charge.", "He reserved all the seats on the right.", "The software is sold under contract.", "The foundation published its terms.",
    "Licensed premises must close at ten.", "The files were copied to the source.", "You may use the room under the roof.", "Permission to land was not granted.", "The creative team shared the work.",
    "All rights of way are open to the public.", "We are licensed to sell and to serve.", "The source of the river is in the hills.",
    "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: BSL-1.0", "The Zlib License", "Eclipse Public License, version 2.0", "Boost Software License", "Licensed under the Zlib license.",
    "A license is required to drive this car.", "She studied at MIT and holds a pilot license.", "The domain of the function is the real line.", "The table was reserved for the general public.", "The wish was granted and the work was done.",
    "All rights reserved for members only.", "All seats are reserved for members of the club.", "Civil rights reserved a place in her speeches.", "The rights to the film were reserved by the studio.", "All tables reserved until nine.",
    "The public domain of the king was sold.", "This work is in the public interest.", "The house is in the public park.", "Work in the public sector is steady.",
    "Free software is a matter of taste.", "The Mozilla office is in the city.", "The Apache people lived in the south.", "An Apache helicopter, version two, was shown.", "The commons were a creative place.", "The house of commons sat until four.",
    "He redistributed the land and used it in modified form.", "A copy of the letter was sent to any person who asked.", "The licence fee pays for public radio.", "BSD is short for many things.", "The clause has three parts.", "Permission is needed to use the hall for any purpose with or without a fee.",
]
# Sentences for the calibration only, none of them above.
HELD_OUT = {
    "agpl": ["You may copy it under the terms of the GNU Affero General Public License version 3."], "apache": ["This module is distributed under the terms of the Apache License, Version 2.0.", "Apache License 2.0"],
    "bsd": ["Distributed under a 3-clause BSD license.", "The code is BSD licensed."], "cc-by": ["Text is available under Creative Commons Attribution 4.0."], "cc-by-nc": ["Shared as Creative Commons Attribution-NonCommercial 3.0 (CC BY-NC)."],
    "cc-by-nc-sa": ["Published as CC BY-NC-SA 3.0, Attribution-NonCommercial-ShareAlike."], "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License 3.0."],
    "gpl": ["You can use it under the GNU General Public License, version 2.", "It is free software under the GPL."], "isc": ["This package has the ISC license."], "lgpl": ["The library is covered by the GNU Lesser General Public License."],
    "mit": ["This project is licensed under the MIT License - see the file for details.", "MIT licensed."], "mpl": ["The files are subject to the Mozilla Public License, version 1.1."],
    "proprietary": ["Copyright 2019 by the publisher, all rights reserved.", "No part of this book may be reproduced, all rights reserved."], "public-domain": ["The author has placed it in the public domain.", "Released into the public domain (CC0)."],
    "unknown": [
        "The licensed guide met us at the gate.", "A public license board sits in the town.", "He reserved the right to answer.", "The software was free for a month.", "She modified the terms of the lease.", "Rights and duties were read out.", "The version in the library is older.",
        "They redistribute food to the poor.", "The domain was sold last year.", "A creative mind needs no permission.", "The general manager used the source.", "It was granted free of charge to the school.", "Copies of the notice hang in all rooms.", "The clause was struck from the contract.",
    ],
}
_OPENINGS = ["", "Note that this text is ", "See the file for details. ", "Copyright 2020 the authors. ", "Notice: "]
#: Words that the gate takes late and last, as other texts have many of them.
FREQUENT = frozenset("code copy copyright file free general met program public published software source terms text use used version work works".split())
STOP_WORDS = frozenset("a all along an and any are as at be by can for found from have if in into is it may not of on one or out part that the this to under was with without you your 0 1 2 3 4".split())


def grams(text: str) -> set[str]:
    """Word 1- and 2-grams of a paragraph, as the DataFrame form makes them."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))} - {""}


def gate() -> list[str]:
    """Words of which a run must hold one to confirm any template."""
    every = [grams(t) for own in TEMPLATES.values() for t in own]
    spread = {w: sum(w in t for t in every) for t in every for w in t if " " not in w}
    chosen: set[str] = set()
    for t in sorted(every, key=lambda t: (len(t), sorted(t))):
        without = set(t)
        for w in sorted((w for w in t if " " not in w), key=lambda w: (w not in chosen, (w in FREQUENT) + 2 * (w in STOP_WORDS), -spread[w], w)):
            if len(without) < MIN_OVERLAP * len(t):
                break
            chosen.add(w)
            without = {g for g in without if w not in g.split(" ")}
    return sorted(chosen)


class Model:
    """Weights by n-gram and class, fitted by full-batch gradient steps with an L2 penalty."""

    def __init__(self, penalty: float = 0.02, rounds: int = 400):
        rows = [(o + t, name) for name, own in [*TEMPLATES.items(), ("unknown", UNKNOWN)] for t in own for o in _OPENINGS]
        rows += [(t.replace("2.0", v).replace("4.0", v).replace("version 3", f"version {v}"), name) for name, own in TEMPLATES.items() for t in own for v in ("1", "2", "3")]
        self.families = [*sorted(TEMPLATES), "unknown"]
        self.vocabulary = sorted({g for t, _ in rows for g in grams(t)})
        x, y = self._matrix(rows)
        self.weights, self.bias = self._fit(x, y, penalty, rounds)
        x, y = self._matrix([(t, name) for name, own in HELD_OUT.items() for t in own])
        z = x @ self.weights + self.bias
        losses = {t: -np.log(self._soft(z * t)[y == 1]).mean() for t in np.geomspace(0.25, 16, 25).round(4).tolist()}
        self.temperature = min(losses, key=losses.get)

    def _matrix(self, rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        place = {g: k for k, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(place)))
        for k, (t, _) in enumerate(rows):
            x[k, [place[g] for g in grams(t) if g in place]] = 1
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)), np.eye(len(self.families))[[self.families.index(name) for _, name in rows]]

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        speed = np.zeros_like(w)
        for _ in range(rounds):
            error = (self._soft(x @ w + b) - y) / len(x)
            speed = 0.9 * speed - 8.0 * (x.T @ error + penalty / len(x) * w)
            w, b = w + speed, b - error.sum(axis=0)
        return w, b


@cache
def default_model() -> Model:
    return Model()


def _constant(value: object, kind: str) -> Column:
    """The value as one literal of that type."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _grams(paragraph: Column) -> Column:
    w = F.split(F.trim(F.regexp_replace(F.lower(paragraph), "[^a-z0-9]+", " ")), " ")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, pairs))


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value computed once, which a plain reference inside a lambda is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _judge(paragraph: Column, model: Model) -> Column:
    """Struct of probability, family and matched n-grams (0 without enough overlap) of the likeliest family of one paragraph."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for g, row in zip(model.vocabulary, model.weights, strict=True):
        buckets[zlib.crc32(g.encode()) % BUCKETS][g] = [round(float(v), 6) for v in row]
    table = _constant(buckets, "array<map<string, array<double>>>")
    families, bias = _constant(model.families, "array<string>"), _constant([float(v) for v in model.bias], "array<double>")
    templates = _constant([[sorted(grams(t)) for t in TEMPLATES.get(f, [])] for f in model.families], "array<array<array<string>>>")
    weights = lambda g: F.element_at(F.element_at(table, (F.crc32(g.cast("binary")) % BUCKETS).cast("int") + 1), g)

    def of_known(known: Column) -> Column:
        total = F.aggregate(known, F.array(*[F.lit(0.0)] * len(model.families)), lambda acc, g: F.zip_with(acc, g["w"], lambda a, b: a + b))
        size = F.sqrt(F.greatest(F.size(known), F.lit(1)).cast("double"))
        return _let(F.zip_with(total, bias, lambda a, b: (a / size + b) * model.temperature), lambda logits: of_logits(F.transform(known, lambda g: g["g"]), logits))

    def of_logits(known: Column, logits: Column) -> Column:
        matched = lambda t: _let(F.size(F.array_intersect(known, t)), lambda n: F.when(n / F.size(t) >= MIN_OVERLAP, n))
        return _let(F.array_max(logits), lambda top: _let(F.array_position(logits, top).cast("int"), lambda k: F.struct(
            (F.lit(1.0) / F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))).alias("probability"),
            F.element_at(families, k).alias("family"),
            F.coalesce(F.array_max(F.transform(F.element_at(templates, k), matched)), F.lit(0)).alias("matched"),
        )))

    return _let(F.filter(F.transform(_grams(paragraph), lambda g: F.struct(g.alias("g"), weights(g).alias("w"))), lambda g: g["w"].isNotNull()), of_known)


def _runs(lines: Column) -> Column:
    """first, last and text of each line, and of each run of adjacent lines that are not blank, that holds a word of the gate."""

    def from_line(line: Column) -> Column:
        def run(k: Column) -> Column:
            return _let(F.slice(lines, line["i"] + 1, k), lambda own: F.struct(
                line["i"].alias("first"), (line["i"] + k - 1).alias("last"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"),
                (F.exists(own, lambda x: x["hot"]) & ((k == 1) | (~F.exists(own, lambda x: x["words"] == 0) & (F.aggregate(own, F.lit(0), lambda n, x: n + x["words"]) <= RUN_WORDS)))).alias("ok"),
            ))

        return F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN_LINES), F.size(lines) - line["i"])), run), lambda r: r["ok"])

    near = F.filter(lines, lambda x: (x["words"] > 0) & F.exists(F.slice(lines, x["i"] + 1, RUN_LINES), lambda y: y["hot"]))
    return F.flatten(F.transform(near, from_line))


def _chosen(notices: Column) -> Column:
    """The set of notices (first, last, j; by last line, then first) that share no line and match most: number, families, likeliest one.

    The fold keeps, for the lines that a later notice may begin behind, the best
    set that ends there at the latest.
    """
    state = "struct<last: int, matched: int, n: int, lines: int, families: array<string>, probability: double, license: string>"
    none = F.struct(F.lit(-1).alias("last"), *[F.lit(0).alias(c) for c in ("matched", "n", "lines")], F.array().cast("array<string>").alias("families"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("license")).cast(state)

    def step(kept: Column, r: Column) -> Column:
        before = F.element_at(F.filter(kept, lambda s: s["last"] < r["first"]), -1)
        likelier = lambda s: r["j"]["probability"] > s["probability"]
        longer = lambda s: F.struct(
            r["last"].alias("last"), (s["matched"] + r["j"]["matched"]).alias("matched"), (s["n"] + 1).alias("n"), (s["lines"] + r["last"] - r["first"] + 1).alias("lines"),
            F.array_union(s["families"], F.array(r["j"]["family"])).alias("families"),
            F.when(likelier(s), r["j"]["probability"]).otherwise(s["probability"]).alias("probability"), F.when(likelier(s), r["j"]["family"]).otherwise(s["license"]).alias("license"),
        ).cast(state)
        worth = lambda s: F.struct(s["matched"], -s["n"], -s["lines"])
        return _let(before, lambda p: _let(longer(p), lambda new: _let(F.element_at(kept, -1), lambda top: F.when(worth(new) <= worth(top), kept).otherwise(
            _let(F.concat(F.filter(kept, lambda s: s["last"] < r["last"]), F.array(new)), lambda own: F.slice(own, F.greatest(F.size(own) - RUN_LINES, F.lit(1)), RUN_LINES + 1))
        ))))

    return F.element_at(F.aggregate(notices, F.array(none), step), -1)


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, license (likeliest confirmed), probability, licenses (all confirmed), n_notices."""
    model = model or default_model()
    hot = f"(?<![a-z0-9])(?:{'|'.join(gate())})(?![a-z0-9])"
    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.filter(F.split(text, r"\n+"), lambda p: F.length(F.trim(p)) > 0)
    rows = documents.select("doc_id", F.when(F.length(text) > 0, F.size(paragraphs)).otherwise(0).alias("n_paragraphs"), F.when(F.lower(text).rlike(hot), F.split(text, r"\n")).otherwise(F.array().cast("array<string>")).alias("lines"))
    rows = rows.withColumn("lines", F.transform("lines", lambda p, i: F.struct(i.alias("i"), p.alias("text"), F.size(F.regexp_extract_all(p, F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("words"), F.lower(p).rlike(hot).alias("hot"))))
    rows = rows.withColumn("runs", _runs(F.col("lines"))).drop("lines")
    # equal runs stand together and are judged once
    rows = rows.withColumn("runs", F.array_sort(F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["last"].alias("last"), r["first"].alias("first")))))
    head = lambda r, i: F.when((i == 0) | (F.get("runs", i - 1)["text"] != r["text"]), i)
    rows = rows.withColumn("heads", F.filter(F.transform("runs", head), lambda i: i.isNotNull()))
    rows = rows.withColumn("judged", F.transform("heads", lambda i, k: F.struct(i.alias("i"), (F.coalesce(F.get("heads", k + 1), F.size("runs")) - i).alias("n"), _judge(F.get("runs", i)["text"], model).alias("j"))))
    sure = F.filter("judged", lambda r: (r["j"]["family"] != "unknown") & (r["j"]["probability"] >= MIN_PROBABILITY) & (r["j"]["matched"] > 0))
    rows = rows.withColumn("sure", F.flatten(F.transform(sure, lambda h: F.transform(F.slice("runs", h["i"] + 1, h["n"]), lambda r: F.struct(r["last"].alias("last"), r["first"].alias("first"), h["j"].alias("j"))))))
    rows = rows.withColumn("sure", F.array_sort("sure")).drop("judged", "heads", "runs")
    rows = rows.withColumn("sure", _chosen(F.col("sure")))
    return rows.select("doc_id", "n_paragraphs", F.col("sure.license").alias("license"), F.round("sure.probability", 6).alias("probability"), F.concat_ws(",", F.array_sort("sure.families")).alias("licenses"), F.col("sure.n").alias("n_notices"))
