"""Notices that are wrapped, short, reworded or not in the templates."""

import re

import numpy as np
import pytest

from barflow.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
APACHE = "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
CASES = [
    (BSD, "bsd"), (GPL, "gpl"), (APACHE, "apache"), (MIT, "mit"), ("The tale of a river.\n\n" + BSD + "\n\nThe end.", "bsd"), ("A long story begins here\n" + MIT + "\nand it ends here.", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: MPL-2.0", "mpl"),
    ("The MIT License (MIT)", "mit"), ("All rights\nreserved.", "proprietary"), ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This project is licensed under the MIT License - see the file for details", "mit"), ("This module is distributed under the terms of the Apache License, Version 2.0.", "apache"), ("You can use it under the GNU General Public License, version 2.", "gpl"),
    ("All rights\n\nreserved.", None), ("SPDX-License-Identifier: Zlib", None), ("He lost his driver license\nin the general store.", None), ("The garden was open to the public\nand free of charge.", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r for r in licenses.scan(rows).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_notice(found, k):
    text, family = CASES[k]
    assert found[k].license == family, (text, found[k])
    assert found[k].n_notices == (family is not None)


MORE = [
    ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"), ("GNU Lesser General Public License", "lgpl"), ("GNU Affero General Public License, version 3", "agpl"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"), ("SPDX-License-Identifier: ISC", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "isc"),
    ("All rights reserved for members only seats.", None), ("All seats were reserved.", None), ("A pilot license is needed.\nMIT is far away.", None), ("SPDX-License-Identifier: EPL-2.0", None),
]


def brute(text, model):
    """The whole scan without a gate: every line and every run is judged."""
    lines = [(i, t, len(re.findall("[A-Za-z0-9]+", t))) for i, t in enumerate((text or "").split("\n"))] if text else []
    found = []
    for i, _, n in lines:
        for k in range(1, min(licenses.RUN_LINES, len(lines) - i) + 1):
            own = lines[i : i + k]
            if not n or k > 1 and (any(x[2] == 0 for x in own) or sum(x[2] for x in own) > licenses.RUN_WORDS):
                continue
            known = licenses.grams(" ".join(x[1] for x in own)) & set(model.vocabulary)
            x = np.zeros(len(model.vocabulary))
            x[[model.vocabulary.index(g) for g in known]] = 1 / max(len(known), 1) ** 0.5
            z = (x @ model.weights + model.bias) * model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = model.families[int(z.argmax())]
            shares = [(len(known & licenses.grams(t)), len(licenses.grams(t))) for t in licenses.TEMPLATES.get(family, [])]
            matched = max((a for a, b in shares if a / b >= licenses.MIN_OVERLAP), default=0)
            if family != "unknown" and p.max() >= licenses.MIN_PROBABILITY and matched:
                found.append((i, i + k - 1, family, p.max(), matched))
    sets = [((0, 0, 0), [])]  # of the lines up to each one: matched, fewest notices, fewest lines; the set itself
    for e in range(len(lines)):
        top = sets[-1]
        for f in sorted(x for x in found if x[1] == e):
            (m, n, k), own = sets[f[0]]
            if (m + f[4], n - 1, k - (f[1] - f[0] + 1)) > top[0]:
                top = (m + f[4], n - 1, k - (f[1] - f[0] + 1)), [*own, f]
        sets.append(top)
    sure = sets[-1][1]
    best = max(sure, key=lambda f: f[3], default=None)
    return best and best[2], ",".join(sorted({f[2] for f in sure})), len(sure)


def test_scan_against_brute_force(spark):
    """Notices, torn and joined at random, beside near misses and other words, very long texts, ties and repeated rows."""
    rng = np.random.default_rng(2)
    model = licenses.Model()
    pool = [w for own in [*licenses.TEMPLATES.values(), licenses.UNKNOWN, *licenses.HELD_OUT.values()] for t in own for w in [t]]
    texts = [t for t, _ in [*CASES, *MORE]]
    for _ in range(80):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            own = pool[int(rng.integers(len(pool)))].split()
            own = own[int(rng.integers(0, 3)) :] if rng.random() < 0.3 else own
            words += [*own, *rng.choice(["tree", "the", "this", "river", "work", "is", "free"], int(rng.integers(0, 4)))]
        texts.append("".join(w + ("\n" if rng.random() < 0.15 else "\n\n" if rng.random() < 0.03 else " ") for w in words))
    texts += ["MIT License\n" * 30, "All rights\nreserved.\n" * 12, (GPL + "\n") * 3, BSD + "\n" + MIT + "\n" + APACHE, "MIT License\nISC License\n" * 5]
    texts += [texts[-1], None, "", "\n\n", "the river " * 30_000 + "\nReleased under the MIT License.\n" + "a tree " * 30_000]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lines string").repartition(4)
    got = {r.doc_id: (r.license, r.licenses, r.n_notices) for r in licenses.scan(rows, model).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute(t, model), t
    assert sum(g[2] for g in got.values()) > 60


@pytest.mark.parametrize("text,family", MORE)
def test_families_and_near_misses(text, family):
    assert brute(text, licenses.Model())[0] == family


def test_gate_covers_every_template():
    words = set(licenses.gate())
    assert not words & licenses.STOP_WORDS
    for own in licenses.TEMPLATES.values():
        for t in own:
            g = licenses.grams(t)
            assert len([x for x in g if not words & set(x.split(" "))]) < licenses.MIN_OVERLAP * len(g)


def test_calibration():
    """The temperature is fitted on sentences that training has not seen, and lies inside its range."""
    seen = {t for own in [*licenses.TEMPLATES.values(), licenses.UNKNOWN] for t in own}
    assert not seen & {t for own in licenses.HELD_OUT.values() for t in own}
    assert 0.25 < licenses.Model().temperature < 16


def test_adjacent_notices_each_count(spark):
    rows = spark.createDataFrame([(0, "MIT License\n" * 300), (1, "All rights reserved.\nMIT License"), (2, (GPL + "\n") * 20), (3, MIT + "\n" + MIT)], "doc_id long, text string")
    assert {r.doc_id: r.n_notices for r in licenses.scan(rows).collect()} == {0: 300, 1: 2, 2: 20, 3: 2}


def test_time_grows_with_the_notices(spark):
    """A text of eight times the notices takes less than sixteen times as long."""
    import time

    def seconds(n):
        rows = spark.createDataFrame([(1, "MIT License\nand a tree\n" * n)], "doc_id long, text string")
        began = time.time()
        assert licenses.scan(rows).collect()[0].n_notices == n
        return time.time() - began

    seconds(1000)
    assert seconds(16_000) < 16 * max(seconds(2000), 0.5)


def test_default_model_is_fitted_once():
    assert licenses.default_model() is licenses.default_model()
