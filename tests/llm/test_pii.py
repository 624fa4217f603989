import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import pii

SCHEMA = "doc_id long, text string, rid string, base int, w string, email string, m int"
# the formats as they are stated, for a plain search
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def right(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    """Counts and hash of the base spans of one text."""
    spans = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if right(k, m.group())]
    return (*[sum(s[0] == k for s in spans) for k in PLAIN], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in spans})


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "r", 1, "w", "e", 2) for k, t in enumerate(texts)], SCHEMA)


def check_base(spark, texts):
    rows = pii.digest(pii.find(frame(spark, texts))).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        want = brute(t)
        assert tuple(r)[1:6] == want[:5], (t or "")[:200]
        assert want[5] <= set(r.spans.split(",")) | {""}
    return rows


def test_base_spans_by_plain_search(spark):
    rng = np.random.default_rng(6)
    pieces = ["a@b.c", "x.y+z@mail-1.example.org", "@", ".", "1.2.3.4", "256.1.1.1", "010.001.0.255", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "+49 30", "-", " ", "  ", "é", "😀", "_", "12", "3", "ab", "@x", ".y", "\n", "(", ")", "+", "%"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(1, 14)))) for _ in range(400)]
    check_base(spark, [None, "", " \n", "a@b.c_d@e.f g@h.i-j@k.l", "1.2.3.4.5.6.7.8.9", "000.00.0.0 0.0.0.00256", *texts])


def test_long_runs(spark):
    """Texts of one piece over and over and an address behind: short ones by plain search, long ones must end soon and keep the address."""
    pieces = ["a", "1", ".", "1.", "a.", "@", "a@", "a@b.", "+1(", "1 ", "+", "- ", "\n", "\U0001f600"]
    made = lambda n: [p * (n // len(p)) + " | me@home.net" for p in pieces]
    check_base(spark, made(2000))
    for r, t in zip(pii.digest(pii.find(frame(spark, made(300_000)))).orderBy("doc_id").collect(), made(300_000), strict=True):
        assert f"email:{len(t) - 11}:{len(t)}" in r.spans


def test_many_spans_of_one_text(spark):
    rows = check_base(spark, ["1.2.3.4 😀 a@b.c " * 6000])
    assert rows[0].n_ip == rows[0].n_email == 6000


def contexts():
    """Texts whose contexts give unseen identifiers away, and texts that must stay clean."""
    shown = [f"Some words first. Phone: +1 (555) 010-{k:04d} and more text." for k in range(30)] + [f"please dial now +44 20 7946 {k:04d} thank you" for k in range(30)]
    hidden = ["Our Phone: 555-0199-77 is new.", "please dial now (020) 7946-0999 today"]
    clean = [f"We counted now 555-0199-{k:02d} of the same kind." for k in range(20)] + ["Phone: yes, dial now please", "Phone: 12"]
    return shown, hidden, clean


def test_contexts_find_unseen_identifiers(spark):
    shown, hidden, clean = contexts()
    rows = check_base(spark, shown + hidden + clean)
    for r, t in zip(rows, shown + hidden + clean, strict=True):
        added = set(filter(None, r.spans.split(","))) - brute(t)[5]
        if t in hidden:
            value = "555-0199-77" if "Our" in t else "(020) 7946-0999"
            assert added == {f"phone:{t.index(value)}:{t.index(value) + len(value)}"}
        else:
            assert not added, t


def test_rounds_carry_trust_on(spark):
    """Instances found in one round make a further pattern sure in the next."""
    texts = [f"x Phone: +1 (555) 010-{k:04d} y" for k in range(30)]
    texts += [t for k in range(10) for t in (f"x Phone: 555-01{k:02d}-77 y", f"x Fernruf: 555-01{k:02d}-77 y")] + ["z Fernruf: 0301-556677 w"]
    found = pii.learn(frame(spark, texts))[2]
    assert {(r.pattern, r.kind) for r in found[0].collect()} == {("phone:", 3), ("fernruf:", 3)}
    last = pii.find(frame(spark, texts)).filter(F.col("doc_id") == len(texts) - 1).first()
    assert [(s.kind, s.start, s.end) for s in last.added] == [(3, 11, 22)]


def test_added_spans_touch_no_base_span(spark):
    texts = [f"a Card: 4111 1111 1111 1111 {k}" for k in range(3)] + [f"a Card: {v} z" for v in ("4242424242424242", "5555555555554444", "378282246310005000", "6011111111111117", "4000056655665556", "5105105105105100", "30569309025904000")] + ["a Card: 4111 1111 1111 1111abc"]
    r = pii.find(frame(spark, texts)).filter(F.col("doc_id") == len(texts) - 1).first()
    assert [(s.start, s.end) for s in r.base] == [(8, 27)] and r.added == []


def test_odd_tables(spark):
    assert pii.digest(pii.find(frame(spark, []))).count() == 0
    twice = frame(spark, ["a@b.c"]).unionByName(frame(spark, ["a@b.c"])).unionByName(frame(spark, ["+1 23456789"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id, r.spans) if r.doc_id is not None else (9, r.spans) for r in pii.digest(pii.find(twice)).collect()) == [(0, "email:0:5"), (0, "email:0:5"), (9, "phone:0:11")]


def test_no_python_workers(spark):
    plan = pii.digest(pii.find(frame(spark, ["a@b.c"])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
