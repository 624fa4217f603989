from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from barflow.llm import audit
from barflow.llm.audit import FILTERS

DOCS = "doc_id long, text string, source string, part string, mask string, n long, first string, spread int"
LABELS = "doc_id long, quality int, toxic int, mask string"


def fails(docs):
    """The letters of the filters that each row fails, one text at a time."""
    out = []
    for k, t, *_ in docs:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if k is not None and any(j is not None and j < k and (u or "") == t for j, u, *_ in docs) else set()
        out.append(f)
    return out


def brute(docs, labels):
    """Every order replayed filter by filter."""
    failed = fails(docs)
    says = lambda k, c: any(r[0] == k and r[c] == 1 for r in labels if k is not None)
    out = set()
    for part in {d[2] or "" for d in docs}:
        rows = [(d, f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        share = dict.fromkeys(FILTERS, 0)
        steps = []
        for order in permutations(FILTERS):
            left = rows
            for k, c in enumerate(order):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                share[c] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), sum(c in f for _, f in rows) - len(gone), sum(f == {c} for _, f in rows), sum(says(d[0], 1) for d, _ in gone), sum(says(d[0], 2) for d, _ in gone)))
        out |= {(*s, share[s[1][s[2] - 1]]) for s in steps}
    return out


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(5)
    many = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \t\n", many, "a b " * 150, many.upper(), many + " |", "a b % A", "Straße ÄÖ", "x y", many + " long" * 30_000]
    rows = [(int(rng.integers(0, 40)) if rng.random() < 0.9 else None, texts[int(rng.integers(len(texts)))], [None, "", "p", "q"][int(rng.integers(4))], "z", "m", 1, "f", 2) for _ in range(120)]
    rows += rows[:5]
    labels = [(int(k), [0, 1, None][int(rng.integers(3))], [0, 1, None][int(rng.integers(3))], "m") for k in rng.integers(0, 40, 30)] + [(None, 1, 1, "m")]
    got = audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert {tuple(r) for r in got.collect()} == brute(rows, labels) and got.count() == 600 * 3


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(none, labels).count() == 0
    one = audit.audit(none.unionByName(spark.createDataFrame([(1, "x", None, "z", "m", 1, "f", 2)], DOCS)), labels)
    assert one.agg(F.sum("shapley")).first()[0] == 600 // 5 * 120 and one.filter("good_lost > 0").count() == 0


def test_survivors_by_counting():
    counts = np.random.default_rng(3).integers(0, 9, (2, 3, 32))
    want = np.array([[[sum(c[m] for m in range(32) if not m & s) for s in range(32)] for c in p] for p in counts])
    assert (audit.survivors(counts) == want).all()
