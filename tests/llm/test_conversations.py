import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pytest

from barflow.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, piece int, cost string, first int"
BLANKS = " \t\n\v\f\r"


def damaged(rows):
    """Rows of one conversation after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        role = "user" if code == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute(rows):
    """The cheapest edits by recursion, least letters first among equals."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = lambda state, c: {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(c) >= 0 and c != ""
    fill = lambda state: "a" if state == "u" else "u"

    @lru_cache(None)
    def best(i, state, put=0):
        """(cost, audit, edits)."""
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if put < 2:
            c, a, e = best(i, fill(state), put + 1)
            found.append((c + 5, "I" + a, (("user" if fill(state) == "u" else "assistant") + ":", *e)))
        if i < len(rows):
            c, a, e = best(i + 1, state)
            found.append((c + 2, "D" + a, e))
            if faults[i] not in ("blank", "duplicate"):
                more, role, text = 5 * (faults[i] == "truncated"), rows[i][1], rows[i][2]
                if fits(state, role[:1]):
                    c, a, e = best(i + 1, role[:1])
                    found.append((c + more, "K" + a, (f"{role}:{text}", *e)))
                c, a, e = best(i + 1, fill(state))
                found.append((c + more + 1, "R" + a, (("user:" if fill(state) == "u" else "assistant:") + text, *e)))
        return min(found, default=(10**9, "", ()))

    cost, audit, edits = best(0, "")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(edits).encode()).hexdigest())


def drawn(rng, conv, n):
    roles = ["user", "assistant", "system", "User", "", None, "sys", "agent"]
    texts = ["Yes.", "No!", "Well", "Well then? \n", "", " \t", None, "a.b", "ok... ", "é?", "x "]
    p = [0.35, 0.3, 0.1, 0.05, 0.03, 0.05, 0.06, 0.06]
    rows = []
    for k in range(n):
        turn = None if rng.random() < 0.1 else int(k if rng.random() < 0.8 else rng.integers(0, n + 3))
        rows.append((conv, turn, roles[int(rng.choice(len(roles), p=p))], texts[int(rng.integers(len(texts)))] if rng.random() < 0.5 else f"t{k}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(12)
    rows = [r for conv in range(120) for r in drawn(rng, conv, int(rng.integers(1, 14)))] + drawn(rng, None, 6)
    rows += [(500, 3, "user", "again.")] * 7 + [(501, None, None, None)] * 3 + [(502, 0, "user", "word " * 50_000)]
    rows += [r for k in range(503, 506) for r in drawn(rng, k, 90)]
    return rows


@pytest.mark.parametrize("long_rows", [8192, 4])
def test_repair_by_brute_force(spark, cases, long_rows):
    """Also with conversations of more than four rows repaired in pieces."""
    got = {r.conv_id: tuple(r)[1:] for r in cv.digest(cv.repair(cv.damage(frame(spark, cases)), long_rows)).collect()}
    ids = {r[0] for r in cases}
    assert set(got) == ids
    for k in ids:
        assert got[k] == brute(damaged([r for r in cases if r[0] == k])), k


def test_pieces_carry_the_turns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(40)]
    out = cv.repair(frame(spark, rows), 8).orderBy("piece").collect()
    assert len(out) > 1 and "".join(r.audit for r in out) == "K" * 40 and [t.text for r in out for t in r.turns] == [r[3] for r in rows]
    assert {r.cost for r in out} == {0}
    whole = cv.repair(frame(spark, rows)).collect()
    assert len(whole) == 1 and whole[0].piece is None and len(whole[0].turns) == 40


def test_long_texts_make_pieces(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{'word ' * 1000}{k}.") for k in range(30)]
    a, b = (cv.digest(cv.repair(frame(spark, rows), long_bytes=n)).collect() for n in (20_000, 8 << 20))
    assert a == b and cv.repair(frame(spark, rows), long_rows=10, long_bytes=20_000).count() > 2


def test_none_left_and_no_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = cv.digest(cv.repair(cv.damage(frame(spark, [(gone, 0, "user", "x.")])))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.digest(cv.repair(cv.damage(frame(spark, [])))).count() == 0


def test_query_by_brute_force(spark, sf_dir):
    from barflow.llm.queries import op11_conversations

    held: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        held.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversations(spark, sf_dir).collect()}
    assert got == {k: brute(damaged(rows)) for k, rows in held.items()} and len(got) > 5
